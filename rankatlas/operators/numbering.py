"""Numbers in an order over a whole table, without one task that sees it all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import checkpoint


def numbered(rows: DataFrame, groups: list[str], order: list[str | Column], index: str = "index", size: str | None = None) -> DataFrame:
    """Rows with `index`, their place from 0 in their group's order, and with `size`, the group's rows, if named.

    Rows are dealt out by ranges of group and order, so a large group lies in many tasks; each task
    numbers its own rows, and the sums of the tasks before it, a row for each task and group, move
    them up. Rows that tie in `order` get different numbers. Null groups are a group of their own.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups_of = [F.col(f"`{c}`") for c in groups]
    dealt = rows.repartitionByRange(parts, *groups_of, *order).sortWithinPartitions(*groups_of, *order)
    held = checkpoint(dealt.withColumn("_task", F.spark_partition_id()).withColumn("_place", F.monotonically_increasing_id() % (1 << 33)))
    spans = held.groupBy("_task", *groups_of).agg(F.min("_place").alias("_first"), F.count("*").alias("_rows"))
    whole = Window.partitionBy(*groups_of)
    before = F.coalesce(F.sum("_rows").over(whole.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    moved = spans.select(F.col("_task").alias("_of"), *(g.alias(f"_group{i}") for i, g in enumerate(groups_of)), (before - F.col("_first")).alias("_up"), F.sum("_rows").over(whole).alias("_size"))
    same = F.col("_task") == F.col("_of")
    for i, g in enumerate(groups_of):
        same &= g.eqNullSafe(F.col(f"_group{i}"))
    more = [F.col("_size").alias(size)] if size else []
    return held.join(moved, same).select(*(F.col(f"`{c}`") for c in rows.columns), (F.col("_place") + F.col("_up")).alias(index), *more)
