"""Streaming forms of the audits and counts; each takes and returns a streaming DataFrame."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankatlas.operators.lineage import shared_folder


def read_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table's files as a stream, with the schema of what is there."""
    path = f"{folder.rstrip('/')}/{name}.parquet"
    schema = spark.read.parquet(path).schema
    rows = spark.readStream.schema(schema).parquet(f"{folder.rstrip('/')}/{name}.parque[t]")
    # event times must have a zone; the session's is UTC
    return rows.withColumns({f.name: F.col(f.name).cast("timestamp") for f in schema if f.dataType.simpleString() == "timestamp_ntz"})


def quota_stream(log: DataFrame, length: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Requests of each engine in UTC windows."""
    w = F.window("ts", length)
    return log.withWatermark("ts", late).groupBy(w, "engine").agg(F.count("*").alias("requests"), F.count_if(F.col("outcome") == "error").alias("errors"))


def group_quota_stream(log: DataFrame, group: list[str], late: str = "1 day") -> DataFrame:
    return log.filter(F.col("engine").isin(group)).withWatermark("ts", late).groupBy(F.window("ts", "1 day")).agg(F.count("*").alias("requests"))


def progress_stream(points: DataFrame, keys: list[str]) -> DataFrame:
    return points.groupBy(*keys).agg(F.count("*").alias("points_total"), F.count_if(F.col("status") == "completed").alias("points_done"))


def dedupe_stream(facts: DataFrame, keys: list[str], late: str = "1 day", time: str = "ts") -> DataFrame:
    """At-least-once rows once, within the watermark."""
    return facts.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)


def review_days_stream(snapshots: DataFrame, late: str = "7 days") -> DataFrame:
    """Snapshots a business and UTC day, for append mode: a day is final, and later rows of it don't count, once the watermark has passed its end."""
    days = snapshots.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "business_id").agg(F.count("*").alias("snapshots"))
    return days.select("business_id", F.col("window.start").alias("day"), "snapshots")


def review_months(days: DataFrame) -> DataFrame:
    """Months of what review_days_stream() has written."""
    return days.groupBy("business_id", (F.year("day") * 12 + F.month("day")).alias("month")).agg(F.sum("snapshots").alias("snapshots"))


def rate_audit_stream(log: DataFrame, seconds: int = 60, most: int = 120, late: str = "1 hour") -> DataFrame:
    """Each client's anchored windows as they end: client, start, requests, flagged. For append mode.

    log: client, second, and ts as event time. A client's state is the open window's start and
    count; it ends with the first request after it, or when the watermark passes its end. Rows of a
    micro-batch are put in order; a row older than the open window counts as part of it.
    """
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def walk(key, parts, state: GroupState):
        out, (start, count) = [], state.get if state.exists else (None, 0)
        if state.hasTimedOut:
            out.append((key[0], start, count, count > most))
            state.remove()
        else:
            for s in sorted(int(x) for p in parts for x in p["second"]):
                if start is None or s - start >= seconds:
                    if start is not None:
                        out.append((key[0], start, count, count > most))
                    start, count = s, 0
                count += 1
            state.update((start, count))
            state.setTimeoutTimestamp(max((start + seconds) * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["client", "start", "requests", "flagged"])

    rows = log.withWatermark("ts", late).select("client", "second", "ts").groupBy("client")
    return rows.applyInPandasWithState(walk, "client long, start long, requests long, flagged boolean", "start long, requests long", "append", GroupStateTimeout.EventTimeTimeout)


def run_once(stream: DataFrame, mode: str = "complete", folder: str | None = None) -> DataFrame:
    """Runs what is there to its end and gives the result as a table.

    It is written as Parquet with its checkpoint in the cluster's shared folder: in append mode by
    the file sink, in complete mode by each micro-batch in place of the one before.
    """
    path = f"{folder or shared_folder(stream.sparkSession)}/stream-{uuid.uuid4().hex}"
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/progress").trigger(availableNow=True)
    if mode == "append":
        q = writer.format("parquet").option("path", f"{path}/rows").start()
    else:
        q = writer.foreachBatch(lambda df, number: df.write.mode("overwrite").parquet(f"{path}/rows")).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/rows")


def moved(batch: DataFrame, last: DataFrame | None, least: float = 3) -> tuple[DataFrame, DataFrame]:
    """Alerts of a batch of facts against the means before, and the means after.

    Means are of a business, keyword and engine in its newest scan month; an alert is a move of
    `least` or more since the scan before.
    """
    keys = ["business_id", "keyword", "engine"]
    means = batch.groupBy(*keys, "scan_month").agg(F.avg("rank").alias("mean"))
    all_ = means if last is None else last.unionByName(means)
    order = Window.partitionBy(*keys).orderBy("scan_month")
    stepped = all_.withColumn("change", F.col("mean") - F.lag("mean").over(order))
    alerts = stepped.join(means.select(*keys, "scan_month"), [*keys, "scan_month"], "left_semi").filter(F.abs("change") >= least).select(*keys, "scan_month", F.round("change", 4).alias("change"))
    after = all_.groupBy(*keys).agg(F.max_by("mean", "scan_month").alias("mean"), F.max("scan_month").alias("scan_month")).select(*keys, "scan_month", "mean")
    return alerts, after


def alert_stream(facts: DataFrame, folder: str, least: float = 3):
    """Writes each micro-batch's alerts under folder/alerts and its keys' newest means under folder/means, both by the batch's number, so that a repeated batch replaces itself.

    Scans should come whole and in order. Only keys of the batch are looked up among the means
    before, and only theirs are written; nothing else is rewritten.
    """
    spark, keys = facts.sparkSession, ["business_id", "keyword", "engine"]

    def run(batch: DataFrame, number: int) -> None:
        last = None
        if number:
            kept = spark.read.parquet(f"{folder}/means").filter(F.col("batch") < number).join(batch.select(*keys).distinct(), keys, "left_semi")
            last = kept.groupBy(*keys).agg(F.max("scan_month").alias("scan_month"), F.max_by("mean", "scan_month").alias("mean"))
        alerts, after = moved(batch, last, least)
        alerts.write.mode("overwrite").parquet(f"{folder}/alerts/batch={number}")
        after.write.mode("overwrite").parquet(f"{folder}/means/batch={number}")

    return ingest_stream(facts, run, f"{folder}/progress")


def ingest_stream(observations: DataFrame, batch: Callable[[DataFrame, int], None], folder: str):
    """Each micro-batch goes to a function that must be idempotent by its number; progress is kept in the folder."""
    return observations.writeStream.foreachBatch(batch).option("checkpointLocation", folder).trigger(availableNow=True).start()
