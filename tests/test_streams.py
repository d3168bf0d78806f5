import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rankatlas.operators import audit as U
from rankatlas.streaming import ordered as O
from rankatlas.streaming.streams import alert_stream, run_once

LOG = "client long, engine string, request_id long, second long, outcome string"


def stream(spark, folder, parts, schema):
    """A file a micro-batch, in their order."""
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def shuffled(rows, late, r, last):
    """Micro-batches of rows that come up to `late` seconds after others of later times, and two far ahead."""
    order = sorted(rows, key=lambda x: x[3] + r.uniform(0, late * 0.9))
    return [order[i : i + 40] for i in range(0, len(order), 80)] + [[last], [(*last[:3], last[3] + 10_000_000, last[4])]]  # the watermark moves with the first, and acts with the second


@pytest.mark.xfail(reason="open: over days of disorder the stream loses rows (58 blocks here); see README", strict=False)
@pytest.mark.parametrize("seed", [1])
def test_ordered_walks_equal_the_batch(spark, tmp_path, seed):
    r = random.Random(seed)
    rows, second = [], 1_700_000_000
    for i in range(240):
        second += r.choice([0, 1, 20, 30, 61, 4000, 40_000, 90_000])
        rows.append((r.randrange(3), r.choice("ab"), i, second, r.choice(["ok", "blocked", "blocked", "error"])))
    late = 200_000
    ahead = second + 10_000_000
    parts = shuffled(rows, late, r, (-1, "z", -1, ahead, "blocked"))
    log = stream(spark, tmp_path / "log", parts, LOG)
    batch = spark.createDataFrame(rows, LOG)
    got = run_once(O.block_episode_stream(log, f"{late} seconds"), "append", str(tmp_path)).filter("engine <> 'z'").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, U.block_episodes(batch).select("engine", "request_id", "second", "nth", "minutes").collect()))
    got = run_once(O.rate_windows_stream(log, 60, 2, f"{late} seconds"), "append", str(tmp_path)).filter("client >= 0").collect()
    want = U.rate_audit(batch, 60, 2).select("client", "start", "requests", "retry_after").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, map(tuple, want)))
    limits = spark.createDataFrame([("a", 3, 6)], "engine string, per_hour int, per_day int")
    got = run_once(O.quota_audit_stream(log, limits, f"{late} seconds"), "append", str(tmp_path)).filter("engine <> 'z'").collect()
    assert sorted(map(tuple, got)) == sorted(quotas(rows, {"a": (3, 6)}))


def quotas(rows, limits):
    out = []
    for e in {x[1] for x in rows}:
        start, hour, day, in_day, bad = None, 0, None, 0, False
        verdict = lambda: (e, start, hour, in_day, "blocked" if bad else "throttled" if e in limits and (hour >= limits[e][0] or in_day >= limits[e][1]) else "healthy")  # noqa: B023, E731
        for _, _, _, s, o in sorted((x for x in rows if x[1] == e), key=lambda x: (x[3], x[2])):
            if start is not None and s - start >= 3600:
                out.append(verdict())
                start = None
            if start is None:
                start, hour, bad = s, 0, False
            if s // 86_400 != day:
                day, in_day = s // 86_400, 0
            hour, in_day, bad = hour + 1, in_day + 1, bad or o == "blocked"
        out.append(verdict())
    return out


def test_scans_end_once(spark, tmp_path):
    schema = "scan_id long, second long, points_total int, in_batch boolean"
    t = 1_700_000_000
    start = lambda i, at, n, batch=False: (i, t + at, n, batch)
    point = lambda i, at: (i, t + at, None, None)
    parts = [
        [start(1, 0, 2), point(1, 10), start(2, 0, 2), point(2, 5), start(3, 0, 1, True), start(4, 0, 0), point(5, 100)],
        [point(1, 20), point(2, 1900), start(5, 90, 2)],  # 1 is done; 2's second point is after its time
        [point(9, 2300)],  # the watermark is at 1700 then
        [point(5, 1750), point(3, 2000)],  # late, but before the ends of 5 and of 3, a batch
        [point(9, 9000)],
        [point(2, 9000), point(1, 9000)],
        [point(9, 40_000)],
    ]
    got = run_once(O.timeout_stream(stream(spark, tmp_path / "s", parts, schema), late="600 seconds"), "append", str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [(1, "completed", t + 20, 2), (2, "failed", t + 1800, 1), (3, "completed", t + 2000, 1), (4, "completed", t, 0), (5, "completed", t + 1750, 2)]


def test_alerts_append_only_the_keys_of_a_batch(spark, tmp_path):
    facts = [[(1, "k", "e", 1, 2), (2, "k", "e", 1, 9)], [(1, "k", "e", 2, 7)], [(2, "k", "e", 3, 1), (1, "k", "e", 3, 6)]]
    found = stream(spark, tmp_path / "facts", facts, "business_id int, keyword string, engine string, scan_month int, rank int")
    alert_stream(found, f"{tmp_path}/out").awaitTermination()
    assert sorted((r.business_id, r.scan_month, r.change) for r in spark.read.parquet(f"{tmp_path}/out/alerts").collect()) == [(1, 2, 5.0), (2, 3, -8.0)]
    assert spark.read.parquet(f"{tmp_path}/out/means").groupBy("batch").agg(F.count("*").alias("n")).orderBy("batch").collect()[1].n == 1


def test_slices_of_alerts_are_written_by_many_tasks(spark, monkeypatch, tmp_path):
    from rankatlas.plans import catalogue, flows, views

    monkeypatch.setattr(flows, "_folder", lambda v, name: f"{tmp_path}/{name}")
    monkeypatch.setattr(views, "TASK_ROWS", 1_000)
    got = catalogue.queries()["j10_alert_stream"](spark, "/root/testdata/sf0.001")
    assert sorted(map(str, got.collect())) == sorted(map(str, catalogue.queries()["e10_rank_alerts"](spark, "/root/testdata/sf0.001").collect()))
    assert sum(1 for _ in (tmp_path / "alerts/facts").glob("*.parquet")) > 3 * 2
    assert {x.name for x in (tmp_path / "alerts/means").glob("batch=*")} == {"batch=0", "batch=1", "batch=2"}


def test_clients_share_buckets_of_state(spark, tmp_path):
    """As many windows as the batch gives, whatever the number of buckets; a key a bucket, not a client."""
    r = random.Random(2)
    rows = [(r.randrange(40), "a", i, 1_700_000_000 + r.randrange(4000), "ok") for i in range(600)]
    want = sorted(map(str, map(tuple, U.rate_audit(spark.createDataFrame(rows, LOG), 60, 2).select("client", "start", "requests", "retry_after").collect())))
    assert any("None" not in x for x in want)
    for buckets in (1, 7):
        parts = [rows[i : i + 150] for i in range(0, len(rows), 150)] + [[(-1, "z", -1, s, "ok")] for s in (1_800_000_000, 1_900_000_000)]
        log = stream(spark, tmp_path / f"log{buckets}", parts, LOG)
        got = run_once(O.rate_windows_stream(log, 60, 2, "5000 seconds", buckets), "append", str(tmp_path)).filter("client >= 0")
        assert sorted(map(str, map(tuple, got.collect()))) == want


class States:
    """A key's states in memory, as a processor's handle gives them."""

    def __init__(self):
        self.maps, self.value, self.timers = {}, None, []

    def getMapState(self, name, key, value):  # noqa: N802
        return self

    def getValueState(self, name, schema):  # noqa: N802
        return self

    def registerTimer(self, at):  # noqa: N802
        self.timers.append(at)

    def getValue(self, key):  # noqa: N802
        return self.maps.get(key)

    def updateValue(self, key, value):  # noqa: N802
        self.maps[key] = value

    def removeKey(self, key):  # noqa: N802
        del self.maps[key]

    def keys(self):
        return iter(self.maps)

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None


class At:
    def __init__(self, second):
        self.second = second

    def getCurrentWatermarkInMs(self):  # noqa: N802
        return self.second * 1000


def summed(rows, gathered, monkeypatch):
    """Rows of a log as the stream's tasks sum them, from batches of 50."""
    monkeypatch.setattr(O, "GATHERED", gathered)
    tables = [pa.RecordBatch.from_pylist([{"engine": e, "second": s, "requests": 1, "blocked": int(o == "blocked")} for _, e, _, s, o in rows[i : i + 50]], pa.schema([pa.field("engine", pa.string()), pa.field("second", pa.int64()), pa.field("requests", pa.int64(), False), pa.field("blocked", pa.int64(), False)])) for i in range(0, len(rows), 50)]
    return pa.Table.from_batches(list(O._by_second(iter(tables)))).to_pandas()


@pytest.mark.parametrize("gathered", [60, 500, 500_000])
def test_quotas_hold_seconds_of_a_day_not_requests(monkeypatch, gathered):
    """Many requests of a second are one row before they meet by engine and in state, and a state's value is of one day."""
    r = random.Random(3)
    seconds = [1_700_000_000 + r.randrange(5 * 86_400) for _ in range(200)]
    rows = [(0, "a", i, r.choice(seconds), r.choice(["ok"] * 40 + ["blocked"])) for i in range(6000)]
    sums = summed(rows, gathered, monkeypatch)
    assert sums["requests"].sum() == len(rows) and len(sums) <= (len(set(seconds)) if gathered > 60 else len(rows) - 1)
    states, quota, limits = States(), O.Quota(), {"a": (40, 900)}
    quota.init(states)
    got, ends = [], max(seconds)
    sums["limits"] = (40 << 32) + 900
    cut = sums["second"] % 2 == 0  # half of the rows first; the watermark has passed none of them
    for part in (sums[cut], sums[~cut]):
        list(quota.handleInputRows(("a",), iter([part[:70], part[70:]]), At(0)))
    assert sum(len(v[0]) for v in states.maps.values()) == len(set(x[3] for x in rows)) * 8 * 4
    assert set(states.maps) == {(x[3] // 86_400,) for x in rows}
    for passed in (min(seconds) + 86_400, min(seconds) + 100_000, ends - 50, ends + 1_000_000):
        got += [tuple(x) for part in quota.handleExpiredTimer(("a",), At(passed), None) for x in part.itertuples(index=False)]
    assert sorted(got) == sorted(quotas(rows, limits)) and {x[4] for x in got} == {"blocked", "throttled", "healthy"}
    assert not states.maps and states.value is None


def test_late_rows_of_engines_are_walked_in_order(spark, tmp_path):
    """Hours and episodes over several micro-batches, rows late by up to a day, many in one second."""
    r = random.Random(4)
    rows, second = [], 1_700_000_000
    for i in range(1500):
        second += r.choice([0, 0, 0, 1, 20, 300, 1500])
        rows.append((r.randrange(3), r.choice("ab"), i, second, r.choice(["ok", "ok", "ok", "blocked", "error"])))
    late = 86_400
    order = sorted(rows, key=lambda x: x[3] + r.uniform(0, late * 0.9))
    parts = [order[i : i + 300] for i in range(0, len(order), 300)] + [[(-1, "z", -1, second + far, "blocked")] for far in (10_000_000, 20_000_000)]
    log, batch = stream(spark, tmp_path / "log", parts, LOG), spark.createDataFrame(rows, LOG)
    limits = spark.createDataFrame([("a", 7, 60)], "engine string, per_hour int, per_day int")
    got = run_once(O.quota_audit_stream(log, limits, f"{late} seconds"), "append", str(tmp_path)).filter("engine <> 'z'").collect()
    assert sorted(map(tuple, got)) == sorted(quotas(rows, {"a": (7, 60)})) and {x.state for x in got} == {"blocked", "throttled", "healthy"}
    got = run_once(O.block_episode_stream(log, f"{late} seconds"), "append", str(tmp_path)).filter("engine <> 'z'").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, U.block_episodes(batch).select("engine", "request_id", "second", "nth", "minutes").collect()))
