"""Shared pieces of the text operators: reading, row keys and cutting lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def rest_of(docs: DataFrame, text_col: str) -> list[Column]:
    """One column, `carried`: all columns but the text."""
    return [F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != text_col)).alias("carried")]


def schema_of(fields: str, frame: DataFrame) -> StructType:
    """These fields, and `carried` if the frame has it."""
    found = StructType.fromDDL(fields)
    return found.add(frame.schema["carried"]) if "carried" in frame.columns else found


def restored(cut: DataFrame, docs: DataFrame, text: str, text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """The columns of docs from a result that carries them, with a new text, and n_chars to match."""
    out = []
    for c in docs.columns:
        if c == text_col:
            out.append(F.col(text).alias(c))
        elif c == chars_col:
            out.append(F.length(text).cast(docs.schema[c].dataType).alias(c))
        else:
            out.append(F.col("carried").getField(c).alias(c))
    return cut.select(*out)


def _row(docs: DataFrame, id_col: str, text_col: str) -> list[Column]:
    """doc_id, text (null: empty), and what tells a document from others: no_id, id_key and row_key.

    row_key is a hash of id and text. id_key is the id, or another hash of the text where there is
    none, so the two differ between different documents unless 64 bits collide under one id, or
    128 bits without.
    """
    text, own = F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.col(id_col).cast("long")
    return [own.alias("doc_id"), text.alias("text"), own.isNull().alias("no_id"), F.coalesce(own, F.xxhash64(F.lit("none"), text)).alias("id_key"), F.xxhash64(own, text).alias("row_key")]


#: The columns that tell a document from others; IDENTITY for joins, with no_id for an order.
IDENTITY = ["id_key", "row_key"]


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", deal: bool = True, carry: bool = False) -> DataFrame:
    """Rows of docs with the columns that tell documents apart, dealt by them unless `deal` is false.

    Rows that agree in id and text share them and so any result. Every use of this frame reads
    all of its columns, so Spark shuffles the texts once and reuses that exchange.
    """
    out = docs.select(*_row(docs, id_col, text_col), *(rest_of(docs, text_col) if carry else []))
    return out.repartition(*IDENTITY) if deal else out


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder for intermediate data: spark.checkpoint.dir, or the context's checkpoint folder; a temporary one only where there is none and the driver is all there is."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        found = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    if not found and not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return found or tempfile.mkdtemp(prefix="spark-")


def written(df: DataFrame, name: str) -> DataFrame:
    """Written as Parquet in the shared folder and read again."""
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts lineage through the cluster's shared folder; sets a folder only where none is configured."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        context.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


def batched(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 8 << 20, least: float = 4, carry: bool = False) -> tuple[DataFrame, int]:
    """keyed() rows with `batch`, a number that deals them evenly into groups of about `size` bytes of text or fewer; and all bytes.

    Groups by batch fit in one Python call; there are at least `least` for each shuffle partition.
    """
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    plain = docs.select(*_row(docs, id_col, text_col), *(rest_of(docs, text_col) if carry else []))
    return plain.withColumn("batch", F.pmod(F.col("row_key"), F.lit(max(int(least * parts), total // size + 1)))), total
