"""Request logs: quotas, streaks, anchored windows and block episodes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def usage(log: DataFrame, per_hour: int, per_day: int) -> DataFrame:
    """Requests of each engine by hour, with its day's and both limits' verdict."""
    hours = log.groupBy("engine", F.floor(F.col("second") / 3600).alias("hour")).agg(F.count("*").alias("in_hour"), F.count_if(F.col("outcome") == "blocked").alias("blocked"))
    day = Window.partitionBy("engine", F.floor(F.col("hour") / 24))
    out = hours.withColumn("in_day", F.sum("in_hour").over(day))
    state = F.when(F.col("blocked") > 0, "blocked").when((F.col("in_hour") >= per_hour) | (F.col("in_day") >= per_day), "throttled").otherwise("healthy")
    return out.withColumn("state", state)


def group_quota(log: DataFrame, group: list[str], limit: int) -> DataFrame:
    """A group's requests together by UTC day, against one limit."""
    days = log.filter(F.col("engine").isin(group)).groupBy(F.floor(F.col("second") / 86_400).alias("day")).agg(F.count("*").alias("requests"))
    return days.withColumn("over", F.col("requests") >= limit)


def usage_by_month(log: DataFrame, credits: dict[str, int]) -> DataFrame:
    """Requests of each engine in each UTC month beside its month's credits, and the percent used."""
    from rankatlas.operators.analytics import month_of

    most = F.create_map(*(F.lit(x) for kv in credits.items() for x in kv))
    used = log.groupBy("engine", month_of(F.col("second")).alias("month")).agg(F.count("*").alias("used")).withColumn("most", F.try_element_at(most, F.col("engine")))
    return used.withColumn("percent", F.round(100 * F.col("used") / F.col("most"), 4))


def error_streaks(log: DataFrame, base_ms: int = 1000, most_ms: int = 300_000) -> DataFrame:
    """Consecutive errors of an engine so far, and the back-off they call for: gaps and islands over successes.

    Streaks are counted within days, and what a day hands on to the next is found in a table of one
    row an engine and day, so that a few engines' requests don't meet in a few tasks.
    """
    bad = F.col("outcome") != "ok"
    days = log.withColumn("day", F.floor(F.col("second") / 86_400))
    order = ["second", "request_id"]
    own = Window.partitionBy("engine", "day").orderBy(*order)
    marked = days.withColumn("island", F.sum((~bad).cast("int")).over(own))
    within = F.sum(bad.cast("int")).over(Window.partitionBy("engine", "day", "island").orderBy(*order))
    at = F.struct(*order)
    last_ok = days.groupBy("engine", "day").agg(F.max(F.when(~bad, at)).alias("last_ok"))
    ends = days.join(last_ok, ["engine", "day"]).groupBy("engine", "day").agg(F.count_if(bad & (F.col("last_ok").isNull() | (at > F.col("last_ok")))).alias("tail"), F.first(F.col("last_ok").isNotNull()).alias("had_ok"))
    by_day = Window.partitionBy("engine").orderBy("day")
    run = ends.withColumn("run", F.sum(F.col("had_ok").cast("int")).over(by_day)).withColumn("open", F.sum("tail").over(Window.partitionBy("engine", "run").orderBy("day")))
    carried = run.select("engine", "day", F.coalesce(F.lag("open").over(by_day), F.lit(0)).alias("carry"))
    out = marked.withColumn("within", within).join(carried, ["engine", "day"])
    out = out.withColumn("streak", F.when(bad, F.col("within") + F.when(F.col("island") == 0, F.col("carry")).otherwise(0)).otherwise(0))
    wait = F.least(F.lit(base_ms) * F.pow(F.lit(2.0), F.col("streak")), F.lit(float(most_ms))).cast("long")
    return out.select("request_id", "engine", "streak", F.when(F.col("streak") > 0, wait).otherwise(F.lit(0)).alias("backoff_ms"))


def _islands(seconds: DataFrame, key: str, gap: int) -> DataFrame:
    """Runs of a key's seconds, each a row, without a gap of `gap`. A window of that length always starts anew after one, so runs are walked apart.

    Gaps are looked for within days, and what a day begins with is found in a table of one row a key
    and day, so that a few keys' rows don't meet in a few tasks.
    """
    days = seconds.withColumn("day", F.floor(F.col("second") / 86_400))
    within = Window.partitionBy(key, "day").orderBy("second")
    marked = days.withColumn("starts", F.coalesce((F.col("second") - F.lag("second").over(within) >= gap).cast("long"), F.lit(0)))
    of_day = marked.groupBy(key, "day").agg(F.min("second").alias("first"), F.max("second").alias("last"), F.sum("starts").alias("inner"))
    by_day = Window.partitionBy(key).orderBy("day")
    opens = F.coalesce(F.col("first") - F.lag("last").over(by_day) >= gap, F.lit(True)).cast("long")
    base = of_day.withColumn("opens", opens).withColumn("base", F.sum(F.col("opens") + F.col("inner")).over(by_day) - F.col("inner")).select(key, "day", "base")
    so_far = F.sum("starts").over(within.rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("so_far", so_far).join(base, [key, "day"]).withColumn("island", F.col("base") + F.col("so_far")).drop("day", "starts", "base", "so_far")


def rate_audit(log: DataFrame, seconds: int = 60, most: int = 120) -> DataFrame:
    """Each client's windows, anchored at the first request after the last window, with how many it made.

    A flagged window has over `most`; retry_after is what was left of it, in whole seconds, at the
    first request too many. Requests of one second are one row before the anchors are walked, and a
    run without a gap of a window's length is a group of its own.
    """

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        out, start, count, over = [], None, 0, None
        client = rows["client"].iloc[0]
        for s, n in rows.sort_values("second")[["second", "n"]].itertuples(index=False):
            if start is None or s - start >= seconds:
                if start is not None:
                    out.append((client, start, count, over))
                start, count, over = int(s), 0, None
            count += int(n)
            if count > most and over is None:
                over = start + seconds - int(s)
        out.append((client, start, count, over))
        return pd.DataFrame(out, columns=["client", "start", "requests", "retry_after"]).astype({"retry_after": "Int64"})

    each = _islands(log.groupBy("client", "second").agg(F.count("*").alias("n")), "client", seconds)
    island = Window.partitionBy("client", "island")
    spans = each.withColumns({"first": F.min("second").over(island), "last": F.max("second").over(island), "so_far": F.sum("n").over(island.orderBy("second"))})
    # a run shorter than a window is one window; only longer ones are walked
    short = F.col("last") - F.col("first") < seconds
    first_over = F.max(F.when(F.col("so_far") > most, F.col("first") + seconds - F.col("second")))
    one = spans.filter(short).groupBy("client", "island").agg(F.min("first").alias("start"), F.sum("n").alias("requests"), first_over.alias("retry_after")).drop("island")
    more = spans.filter(~short).select("client", "island", "second", "n").groupBy("client", "island").applyInPandas(walk, "client long, start long, requests long, retry_after long")
    return one.unionByName(more).withColumn("flagged", F.col("requests") > most)


BLOCK_MINUTES = (15, 120, 1440)


def block_episodes(log: DataFrame, day: int = 86_400) -> DataFrame:
    """Blocks of each engine with their number in a day anchored at the first, and how long each lasts.

    Anchors are found among the distinct seconds with a block, at most 86,400 a day whatever the log,
    and runs of those without a day's gap are walked apart; blocks are then numbered within their
    own anchor's day.
    """

    def walk(rows: pd.DataFrame) -> pd.DataFrame:
        seconds, start, anchors = sorted(rows["second"].tolist()), None, []
        for s in seconds:
            if start is None or s - start >= day:
                start = s
            anchors.append(start)
        return pd.DataFrame({"engine": rows["engine"].iloc[0], "second": seconds, "anchor": anchors})

    blocks = log.filter(F.col("outcome") == "blocked").select("engine", "request_id", "second")
    anchors = _islands(blocks.select("engine", "second").distinct(), "engine", day).groupBy("engine", "island").applyInPandas(walk, "engine string, second long, anchor long")
    order = Window.partitionBy("engine", "anchor").orderBy("second", "request_id")
    nth = F.row_number().over(order)
    minutes = F.element_at(F.array(*(F.lit(m) for m in BLOCK_MINUTES)), F.least(nth, F.lit(len(BLOCK_MINUTES))))
    return blocks.join(anchors, ["engine", "second"]).select("engine", "request_id", "second", nth.alias("nth"), minutes.alias("minutes"))


def engine_status(log: DataFrame, depths: DataFrame) -> DataFrame:
    """Each engine's counts, last request, waiting points, and until when its last block holds (null if it never had one)."""
    seen = log.groupBy("engine").agg(F.count("*").alias("requests"), F.count_if(F.col("outcome") == "error").alias("errors"), F.count_if(F.col("outcome") == "blocked").alias("blocks"), F.max("second").alias("last"))
    until = block_episodes(log).groupBy("engine").agg(F.max(F.col("second") + F.col("minutes") * 60).alias("blocked_until"))
    return seen.join(depths.filter("engine is not null"), "engine", "left").join(until, "engine", "left").withColumn("depth", F.coalesce("depth", F.lit(0)))
