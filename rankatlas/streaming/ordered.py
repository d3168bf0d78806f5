"""Keyed walks over a stream in the order of event time: rows wait in state until the watermark has passed them.

A walk then sees what a batch walk over all rows would see, whatever the micro-batches held and in
which order; timers on event time close what is open when no row comes any more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from rankatlas.operators.audit import BLOCK_MINUTES

DAY = 86_400
#: Rows that a worker gathers before it sums them or puts them into state.
GATHERED = 500_000


class InOrder(StatefulProcessor):
    """Rows of a key, whole numbers with the second first, in order and a UTC day at a time.

    Rows wait in a map of days, those of a day as bytes, so that a worker holds one day of one key
    and what it has gathered (GATHERED rows), however long the watermark lets rows wait. Subclasses
    have TAKEN, the columns of a row, COLUMNS of the output, HELD, a value state's schema, and
    walk() and due(); merged() may sum rows.
    """

    TAKEN: list[str] = []
    COLUMNS: list[str] = []
    HELD = ""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "day long", "rows binary")
        self.held = handle.getValueState("held", self.HELD)

    def merged(self, rows: np.ndarray) -> np.ndarray:
        """Rows, of which those that a walk needn't tell apart may be one."""
        return rows

    def walk(self, key: tuple, held: tuple | None, rows: np.ndarray) -> tuple[tuple, pd.DataFrame]:
        """What is held after a day's rows, or some of them, and rows to give out."""
        raise NotImplementedError

    def due(self, key: tuple, held: tuple) -> tuple[int, list[tuple], tuple | None]:
        """The second at which what is held ends by itself, what it gives out then, and what is held after it."""
        raise NotImplementedError

    def _kept(self, day: int) -> np.ndarray:
        found = self.waiting.getValue((day,))
        return np.frombuffer(bytes(found[0]) if found else b"", np.int64).reshape(-1, len(self.TAKEN))

    def _keep(self, rows: np.ndarray) -> None:
        rows = rows[np.argsort(rows[:, 0], kind="stable")]
        for part in np.split(rows, np.flatnonzero(np.diff(rows[:, 0] // DAY)) + 1):
            day = int(part[0, 0]) // DAY
            self.waiting.updateValue((day,), (self.merged(np.concatenate([self._kept(day), part])).tobytes(),))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        new, size, first = [], 0, None
        for part in rows:
            if len(part):
                new.append(part[self.TAKEN].astype(np.int64).to_numpy())
                size, least = size + len(part), int(new[-1][:, 0].min())
                first = least if first is None else min(first, least)
            if size >= GATHERED:
                new = [self.merged(np.concatenate(new))]
                size = len(new[0])
                if size > GATHERED // 2:
                    self._keep(new[0])
                    new, size = [], 0
        if new:
            self._keep(np.concatenate(new))
        if first is not None:
            self.handle.registerTimer(max(first * 1000, timerValues.getCurrentWatermarkInMs() + 1))
        yield pd.DataFrame([], columns=self.COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        passed, out, nexts = timerValues.getCurrentWatermarkInMs(), [], []
        held = tuple(self.held.get()) if self.held.exists() else None
        for day in sorted(int(x[0]) for x in self.waiting.keys()):
            if day * DAY * 1000 > passed:
                nexts.append(day * DAY)
                break
            rows = self._kept(day)
            now = rows[:, 0] * 1000 <= passed
            if now.any():
                held, given = self.walk(key, held, rows[now])
                yield given
            if not now.all():
                rest = rows[~now]
                self.waiting.updateValue((day,), (rest.tobytes(),))
                nexts.append(int(rest[:, 0].min()))
                break
            self.waiting.removeKey((day,))
        while held is not None:
            ends, given, after = self.due(key, held)
            if ends * 1000 > passed:
                nexts.append(ends)
                break
            out, held = out + given, after
        self.held.update(held) if held is not None else self.held.clear()
        if nexts:
            self.handle.registerTimer(max(min(nexts) * 1000, passed + 1))
        yield pd.DataFrame(out, columns=self.COLUMNS)

    def close(self) -> None:
        pass


class RateWindows(StatefulProcessor):
    """Windows of many clients, a bucket of them a key: each client's are anchored at the first request after the last one.

    A client has few requests, so state and timers of its own would cost more than its walk. A
    bucket's waiting rows (client, second) and open windows (client, start, requests, what was left
    at the first request too many or -1) are one value each, arrays of whole numbers as bytes.
    """

    COLUMNS = ["client", "start", "requests", "retry_after"]

    def __init__(self, seconds: int, most: int):
        self.seconds, self.most = seconds, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "waiting binary, held binary")

    def _kept(self) -> tuple[np.ndarray, np.ndarray]:
        waiting, held = self.state.get() if self.state.exists() else (b"", b"")
        return np.frombuffer(bytes(waiting), np.int64).reshape(-1, 2), np.frombuffer(bytes(held), np.int64).reshape(-1, 4)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        new = [part[["client", "second"]].to_numpy(np.int64) for part in rows]
        waiting, held = self._kept()
        waiting = np.concatenate([waiting, *new])
        if len(waiting):
            self.state.update((waiting.tobytes(), held.tobytes()))
            self.handle.registerTimer(max(int(waiting[:, 1].min()) * 1000, timerValues.getCurrentWatermarkInMs() + 1))
        yield pd.DataFrame([], columns=self.COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        passed, out = timerValues.getCurrentWatermarkInMs(), []
        waiting, held = self._kept()
        now = waiting[:, 1] * 1000 <= passed
        ready, rest = waiting[now], waiting[~now]
        opened = {c: [start, n, left] for c, start, n, left in held.tolist()}
        for client, second in ready[np.argsort(ready[:, 1], kind="stable")].tolist():
            w = opened.get(client)
            if w is None or second - w[0] >= self.seconds:
                if w is not None:
                    out.append((client, *w))
                w = opened[client] = [second, 0, -1]
            w[1] += 1
            if w[1] == self.most + 1:
                w[2] = w[0] + self.seconds - second
        for client in [c for c, w in opened.items() if (w[0] + self.seconds) * 1000 <= passed]:
            out.append((client, *opened.pop(client)))
        nexts = [w[0] + self.seconds for w in opened.values()] + ([int(rest[:, 1].min())] if len(rest) else [])
        if nexts:
            self.state.update((rest.tobytes(), np.array([(c, *w) for c, w in opened.items()], np.int64).tobytes()))
            self.handle.registerTimer(max(min(nexts) * 1000, passed + 1))
        else:
            self.state.clear()
        given = pd.DataFrame(out, columns=self.COLUMNS).astype("Int64")
        yield given.assign(retry_after=given["retry_after"].mask(given["retry_after"] < 0))

    def close(self) -> None:
        pass


class BlockEpisodes(InOrder):
    """An engine's blocks with their number in a day anchored at the first, and how long each lasts."""

    TAKEN = ["second", "request_id"]
    COLUMNS = ["engine", "request_id", "second", "nth", "minutes"]
    HELD = "start long, count long"

    def walk(self, key, held, rows):
        rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
        (start, count), at, nths = held or (0, 0), 0, []
        while at < len(rows):
            if not count or rows[at, 0] - start >= DAY:
                start, count = int(rows[at, 0]), 0
            end = int(np.searchsorted(rows[:, 0], start + DAY))
            nths.append(np.arange(count + 1, count + 1 + end - at))
            at, count = end, count + end - at
        nth = np.concatenate(nths)
        minutes = np.array(BLOCK_MINUTES)[np.minimum(nth, len(BLOCK_MINUTES)) - 1]
        return (start, count), pd.DataFrame(dict(zip(self.COLUMNS, ([key[0]] * len(nth), rows[:, 1], rows[:, 0], nth, minutes), strict=True)))

    def due(self, key, held):
        return held[0] + DAY, [], None


class Quota(InOrder):
    """An engine's hours, each anchored at the first request after the last one, beside its UTC day's requests so far.

    Requests of one second are one row: they are never of two hours or days. limits: per_hour * 2**32 + per_day.
    """

    TAKEN = ["second", "requests", "blocked", "limits"]
    COLUMNS = ["engine", "start", "in_hour", "in_day", "state"]
    HELD = "start long, in_hour long, day long, in_day long, blocked boolean, per_hour long, per_day long"
    HOUR = 3600

    def _verdict(self, key, held):
        start, hour, day, in_day, blocked, per_hour, per_day = held
        state = "blocked" if blocked else "throttled" if hour >= per_hour or in_day >= per_day else "healthy"
        return (key[0], start, hour, in_day, state)

    def merged(self, rows):
        rows = rows[np.argsort(rows[:, 0], kind="stable")]
        first = np.flatnonzero(np.diff(rows[:, 0], prepend=rows[0, 0] - 1))
        return np.column_stack([rows[first, 0], np.add.reduceat(rows[:, 1], first), *(np.maximum.reduceat(rows[:, i], first) for i in (2, 3))])

    def walk(self, key, held, rows):
        rows, at, out = self.merged(rows), 0, []
        today = int(rows[0, 0]) // DAY
        start, hour, day, in_day, blocked, per_hour, per_day = held or (0, 0, today, 0, False, 0, 0)
        while at < len(rows):
            if hour and rows[at, 0] - start >= self.HOUR:
                out.append(self._verdict(key, (start, hour, day, in_day, blocked, per_hour, per_day)))
                hour = 0
            if not hour:
                start, blocked = int(rows[at, 0]), False
            if day != today:
                day, in_day = today, 0
            end = int(np.searchsorted(rows[:, 0], start + self.HOUR))
            part, at = rows[at:end], end
            n, limits = int(part[:, 1].sum()), int(part[-1, 3])
            hour, in_day, blocked, per_hour, per_day = hour + n, in_day + n, blocked or bool(part[:, 2].any()), limits >> 32, limits & 0xFFFFFFFF
        return (start, hour, day, in_day, blocked, per_hour, per_day), pd.DataFrame(out, columns=self.COLUMNS)

    def due(self, key, held):
        """The hour ends by itself; the day's count stays until its day is over."""
        if held[1]:
            return held[0] + self.HOUR, [self._verdict(key, held)], (0, 0, *held[2:4], False, *held[5:])
        return (held[2] + 1) * DAY, [], None


def _by_second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Requests of an engine and second as one row, as far as a task can hold GATHERED of them."""

    def summed() -> pa.Table:
        table = pa.Table.from_batches(new)
        sums = table.group_by(["engine", "second"], use_threads=False).aggregate([("requests", "sum"), ("blocked", "max")])
        return sums.select(["engine", "second", "requests_sum", "blocked_max"]).rename_columns(table.column_names).cast(table.schema)

    new, size = [], 0
    for batch in batches:
        new.append(batch)
        size += batch.num_rows
        if size >= GATHERED:
            new = summed().to_batches()
            size = sum(x.num_rows for x in new)
            if size > GATHERED // 2:
                yield from new
                new, size = [], 0
    if new:
        yield from summed().to_batches()


def _walk(rows: DataFrame, key: str, late: str, processor: InOrder, schema: str) -> DataFrame:
    """rows: the key, and what the processor takes."""
    timed = rows.select(key, F.timestamp_seconds("second").alias("ts"), *(F.col(c).cast("long").alias(c) for c in processor.TAKEN)).withWatermark("ts", late)
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return timed.groupBy(key).transformWithStateInPandas(processor, schema, "Append", "EventTime")


def rate_windows_stream(log: DataFrame, seconds: int = 60, most: int = 120, late: str = "1 hour", buckets: int = 64) -> DataFrame:
    """rate_audit() of a stream (client, second), for rows that are late by up to `late` (README: open defect under much disorder): client, start, requests, retry_after.

    A window is given out when a later request or the watermark has ended it. Clients share state
    in `buckets`, which should grow with the rows that wait, 16 bytes each.
    """
    bucket = F.pmod(F.xxhash64("client"), F.lit(buckets)).alias("bucket")
    rows = log.select(bucket, F.col("client").cast("long").alias("client"), F.timestamp_seconds("second").alias("ts"), "second").withWatermark("ts", late)
    log.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return rows.groupBy("bucket").transformWithStateInPandas(RateWindows(seconds, most), "client long, start long, requests long, retry_after long", "Append", "EventTime")


def block_episode_stream(log: DataFrame, late: str = "1 hour") -> DataFrame:
    """block_episodes() of a stream (engine, request_id, second, outcome), for rows that are late by up to `late` (README: open defect under much disorder)."""
    return _walk(log.filter(F.col("outcome") == "blocked"), "engine", late, BlockEpisodes(), "engine string, request_id long, second long, nth int, minutes int")


def quota_audit_stream(log: DataFrame, limits: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each engine's anchored hours as they end: start, requests in the hour, requests by then of the UTC day of its last one, and blocked, throttled or healthy.

    log: engine, second, outcome. limits: engine, per_hour, per_day, a static table; an engine
    without limits is never throttled. Both buckets are one state of the engine, which grows with
    the seconds that wait, not with their requests; these are summed before they meet by engine.
    """
    most = F.lit((1 << 31) - 1)
    each = log.select("engine", F.col("second").cast("long").alias("second"), F.lit(1).cast("long").alias("requests"), F.coalesce(F.col("outcome") == "blocked", F.lit(False)).cast("long").alias("blocked"))
    bounded = each.mapInArrow(_by_second, each.schema).join(limits, "engine", "left")
    packed = F.coalesce("per_hour", most).cast("long") * F.lit(1 << 32) + F.coalesce("per_day", most).cast("long")
    return _walk(bounded.withColumn("limits", packed), "engine", late, Quota(), "engine string, start long, in_hour long, in_day long, state string")


class ScanClock(StatefulProcessor):
    """A scan from its start to its last point, or to the end of its time."""

    COLUMNS = ["scan_id", "status", "second", "points_done"]

    def __init__(self, single: int, batch: int):
        self.single, self.batch = single, batch

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.scan = handle.getValueState("scan", "started long, limit long, total long, ended boolean")
        self.points = handle.getListState("points", "second long")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802
        scan = tuple(self.scan.get()) if self.scan.exists() else (-1, 0, 0, False)
        new, out = [], []
        for part in rows:
            for second, total, in_batch in part[["second", "points_total", "in_batch"]].itertuples(index=False):
                if pd.notna(total):
                    scan = (int(second), (self.batch if in_batch else self.single) * 60, int(total), scan[3])
                    if not scan[3]:
                        self.handle.registerTimer(max((scan[0] + scan[1]) * 1000 + 1, timerValues.getCurrentWatermarkInMs() + 1))
                else:
                    new.append((int(second),))
        if new and not scan[3]:
            self.points.appendList(new)
        if scan[0] >= 0 and not scan[3]:
            done = self._in_time(scan)
            if len(done) >= scan[2]:
                for t in self.handle.listTimers():
                    self.handle.deleteTimer(t)
                out.append((key[0], "completed", done[scan[2] - 1] if scan[2] else scan[0], scan[2]))
                scan = (*scan[:3], True)
                self.points.clear()
        self.scan.update(scan)
        yield pd.DataFrame(out, columns=self.COLUMNS)

    def _in_time(self, scan: tuple) -> list[int]:
        """The points up to the end of a scan's time, in order."""
        return sorted(int(x[0]) for x in (self.points.get() if self.points.exists() else []) if x[0] <= scan[0] + scan[1])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802
        scan = tuple(self.scan.get())
        if scan[3]:
            yield pd.DataFrame([], columns=self.COLUMNS)
            return
        done = self._in_time(scan)
        self.scan.update((*scan[:3], True))
        self.points.clear()
        yield pd.DataFrame([(key[0], "failed", scan[0] + scan[1], len(done))], columns=self.COLUMNS)

    def close(self) -> None:
        pass


def timeout_stream(events: DataFrame, single: int = 30, batch: int = 360, late: str = "10 minutes") -> DataFrame:
    """How each scan of a stream ended, once: scan_id, status, second, points_done.

    events: scan_id, second, and for a scan's start points_total and in_batch, which are null for a
    done point. A scan is completed by its last point, whichever row comes last, and that cancels
    its timer; it has failed when the watermark passes `single` minutes after its start, or `batch`
    for one of a batch. Points after that time don't count, points that are late but belong before
    it do; an ended scan stays as it is.
    """
    rows = events.select("scan_id", F.timestamp_seconds("second").alias("ts"), "second", F.col("points_total").cast("long").alias("points_total"), F.coalesce("in_batch", F.lit(False)).alias("in_batch")).withWatermark("ts", late)
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return rows.groupBy("scan_id").transformWithStateInPandas(ScanClock(single, batch), "scan_id long, status string, second long, points_done long", "Append", "EventTime")
