"""Reading and writing tables; snapshots are rewritten, facts are appended."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_table(spark: SparkSession, name: str, folder: str, schema: StructType | str | None = None) -> DataFrame:
    """A Parquet table of a folder; a schema spares Spark from reading footers for one."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def read_jdbc(spark: SparkSession, url: str, name: str, column: str, lower: int, upper: int, parts: int = 32, **options: str) -> DataFrame:
    """A live database's table, read in ranges of a numeric column."""
    return spark.read.format("jdbc").options(url=url, dbtable=name, partitionColumn=column, lowerBound=lower, upperBound=upper, numPartitions=parts, **options).load()


def read_pages(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """Stored pages: Parquet with url and html, or one text file a page."""
    if kind == "parquet":
        return spark.read.parquet(path)
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("url"), F.col("value").alias("html"))


API_SCHEMA = "webPages struct<value:array<struct<name:string,url:string,snippet:string,dateLastCrawled:string>>,totalEstimatedMatches:bigint>, places struct<value:array<struct<name:string,url:string,phone:string,address:struct<streetAddress:string,addressLocality:string,addressRegion:string,postalCode:string>,geo:struct<latitude:double,longitude:double>>>>"


def read_api_results(responses: DataFrame, body: str = "body") -> tuple[DataFrame, DataFrame]:
    """Places and web pages of JSON search responses, each with its position; a response without any gives a row of nulls."""
    parsed = responses.withColumn("r", F.from_json(body, API_SCHEMA))
    keep = [c for c in responses.columns if c != body]
    places = parsed.select(*keep, F.posexplode_outer("r.places.value").alias("position", "p")).select(*keep, (F.col("position") + 1).alias("position"), "p.name", "p.url", "p.phone", "p.address", "p.geo")
    pages = parsed.select(*keep, F.posexplode_outer("r.webPages.value").alias("position", "p")).select(*keep, (F.col("position") + 1).alias("position"), "p.name", "p.url", "p.snippet")
    return places, pages


def read_path(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """What append() has written; a filter on its partition columns reads their folders only."""
    return (spark.read if schema is None else spark.read.schema(schema)).parquet(path)


def overwrite_partitions(df: DataFrame, path: str, partition_by: list[str]) -> None:
    """Writes these rows in place of the partitions that they belong to; others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)


def append(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    df.write.mode("append").partitionBy(*(partition_by or [])).parquet(path)


def upsert(target: DataFrame, source: DataFrame, keys: list[str], update: list[str] | None = None) -> DataFrame:
    """A new snapshot: rows of either; where both have a key, the named columns come from source if it has a value there.

    Null keys match nothing, so such rows of either side are kept as they are.
    """
    update = [c for c in source.columns if c not in keys] if update is None else update
    t, s = target.withColumn("__old", F.lit(True)).alias("t"), source.alias("s")
    joined = t.join(s, reduce(lambda a, b: a & b, (F.col(f"t.{k}") == F.col(f"s.{k}") for k in keys)), "full_outer")
    old = F.col("t.__old").isNotNull()

    def pick(c: str) -> Column:
        if c not in source.columns:
            return F.col(f"t.{c}")
        first, second = (F.col(f"s.{c}"), F.col(f"t.{c}")) if c in update else (F.col(f"t.{c}"), F.col(f"s.{c}"))
        return F.when(old, F.coalesce(first, second) if c in update else F.col(f"t.{c}")).otherwise(F.col(f"s.{c}"))

    return joined.select(*(pick(c).alias(c) for c in target.columns))


def update_where(df: DataFrame, condition: Column, sets: dict[str, Column]) -> DataFrame:
    return df.withColumns({c: F.when(condition, v).otherwise(F.col(c)) for c, v in sets.items()})


def delete_where(df: DataFrame, condition: Column) -> DataFrame:
    """Rows for which the condition isn't true; unknown stays."""
    return df.filter(~F.coalesce(condition, F.lit(False)))


def apply_updates(df: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Values of changes where they have any, by a unique key."""
    new = [c for c in changes.columns if c != key]
    joined = df.join(changes.select(key, *(F.col(c).alias(f"__{c}") for c in new)), key, "left")
    return joined.select(*(F.coalesce(F.col(f"__{c}"), F.col(c)).alias(c) if c in new else F.col(c) for c in df.columns))


def apply_defaults(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items() if c in df.columns})


def page_envelope(df: DataFrame, page: int, limit: int, order: list[Column]) -> DataFrame:
    """One row: a page of rows as JSON with its place among all; the page is small by its limit."""
    total = df.agg(F.count("*").alias("total"))
    rows = df.orderBy(*order).offset((page - 1) * limit).limit(limit).agg(F.to_json(F.collect_list(F.struct(*df.columns))).alias("data"))
    return rows.crossJoin(total).select("data", "total", F.lit(page).alias("page"), F.lit(limit).alias("limit"), F.ceil(F.col("total") / limit).alias("total_pages"))


def jdbc_bounds(spark: SparkSession, url: str, name: str, column: str, **options: str) -> tuple[int, int]:
    """The least and largest value of a numeric column, as the database itself finds them; 0 and 0 for an empty table."""
    row = spark.read.format("jdbc").options(url=url, query=f"SELECT min({column}) AS low, max({column}) AS high FROM {name}", **options).load().first()
    return int(row[0] or 0), int(row[1] or 0)


def read_jdbc_table(spark: SparkSession, url: str, name: str, column: str, parts: int = 32, **options: str) -> DataFrame:
    """read_jdbc() in ranges between the bounds that the table has now; filters and columns go to the database."""
    low, high = jdbc_bounds(spark, url, name, column, **options)
    return read_jdbc(spark, url, name, column, low, max(high, low + 1), parts, **options)


def save_facts(df: DataFrame, table: str, month: str = "scan_month", key: str = "point_id", buckets: int = 8) -> None:
    """Facts as a table of the catalogue: a folder a month, within it files by hash of the key, so that months are pruned and joins and sums by key need no shuffle."""
    df.repartition(buckets, key).write.mode("overwrite").partitionBy(month).bucketBy(buckets, key).sortBy(key).format("parquet").saveAsTable(table)
