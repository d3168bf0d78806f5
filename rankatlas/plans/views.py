"""The ranking tables as views of the star schema, in SQL that Spark and DuckDB share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rankatlas.sources.tables import read_table

BASE = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "pages", "documents", "conversations")
#: {seconds} stands for a timestamp's whole seconds since 1970.
SECONDS = {"spark": "unix_timestamp(ts)", "duckdb": "CAST(floor(epoch(ts)) AS BIGINT)"}

#: What Spark reads instead of a part of a view's SQL. DuckDB rounds a rating's tenfold, which may itself be rounded onto a tie;
#: Spark's round() works on the decimals of the double, which may lie just below it.
SPARK = {"REPARTITION(point_id)": "REPARTITION({parts}, point_id)", "round(1 + value % 4, 1)": "round((1 + value % 4) * 10) / 10"}
#: What it reads where orders are more than TASK_ROWS to each of the session's partitions.
DEALT_ORDERS = {"FROM orders JOIN": "FROM (SELECT /*+ REPARTITION({orders}, o_custkey) */ * FROM orders) JOIN"}

VIEWS = {
    "area": "SELECT n_nationkey AS area_id, n_name AS area, n_regionkey AS state_id, CAST(24 + n_nationkey * 0.5 AS DOUBLE) AS lat, CAST(-80 - n_nationkey * 0.25 AS DOUBLE) AS lng, CAST(3 AS DOUBLE) AS radius_miles, n_nationkey % 5 <> 4 AS is_active FROM nation",
    "category": "SELECT DISTINCT p_type AS slug, CAST(NULL AS STRING) AS parent, TRUE AS is_active FROM part UNION ALL SELECT DISTINCT p_type || '/' || p_brand AS slug, p_type AS parent, p_brand <> 'Brand#9' AS is_active FROM part",
    "keyword": "SELECT p_type || '/' || p_brand AS category, p_name AS keyword, count(*) AS priority FROM part GROUP BY p_type, p_brand, p_name",
    "business": "SELECT c_custkey AS business_id, c_name AS name, c_mktsegment AS category, CAST(c_nationkey AS STRING) AS city, CASE WHEN c_nationkey % 2 = 0 THEN 'FL' ELSE 'GA' END AS state, CAST(c_custkey AS STRING) || ' Main St' AS address, c_nationkey AS area_id, CASE WHEN c_acctbal < 0 THEN NULL ELSE round(1 + c_acctbal / 2500, 1) END AS rating, c_custkey * 7 % 500 AS reviews, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE '561' || lpad(CAST(c_custkey % 9000 AS STRING), 7, '0') END AS phone, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE 'https://www.Shop' || CAST(c_custkey % 90 AS STRING) || '.example/x' END AS website, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE 'info@shop' || CAST(c_custkey AS STRING) || '.example' END AS email, c_custkey % 50 = 1 AS is_mine, c_custkey % 20 = 3 AS is_competitor, c_custkey % 10 <> 0 AS is_active, c_custkey * 37 % 1000 AS last_seen, CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE c_custkey * 11 % 400 END AS enriched_hours, CAST(24 + c_nationkey * 0.5 + (c_custkey % 97) * 0.001 AS DOUBLE) AS lat, CAST(-80 - c_nationkey * 0.25 - (c_custkey % 89) * 0.001 AS DOUBLE) AS lng FROM customer",
    "point": "SELECT o_orderkey AS point_id, c_nationkey AS area_id, o_orderpriority AS engine, 'kw' || CAST(o_custkey % 8 AS STRING) AS keyword, year(o_orderdate) * 12 + month(o_orderdate) AS scan_month, CAST(floor((o_orderkey % 49) / 7) AS INT) AS grid_row, CAST(o_orderkey % 7 AS INT) AS grid_col, CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'pending' ELSE 'failed' END AS status FROM orders JOIN customer ON o_custkey = c_custkey",
    "ranking": "SELECT l_orderkey AS point_id, l_suppkey AS business_id, l_linenumber AS rank, CASE WHEN l_tax > 0.06 THEN 'ads' ELSE 'local' END AS result_type FROM lineitem",
    "ranked": "SELECT s_suppkey AS business_id, s_name AS name, s_nationkey AS area_id, s_suppkey % 10 = 1 AS is_mine, s_suppkey % 10 = 3 AS is_competitor, s_suppkey * 7 % 500 AS reviews, CASE WHEN s_acctbal < 0 THEN NULL ELSE round(1 + s_acctbal / 2500, 1) END AS rating FROM supplier",
    "fact": "SELECT p.point_id, area_id, engine, keyword, scan_month, grid_row, grid_col, status, business_id, rank FROM (SELECT point_id, business_id, min(rank) AS rank FROM (SELECT /*+ REPARTITION(point_id) */ * FROM ranking) GROUP BY point_id, business_id) r JOIN point p ON r.point_id = p.point_id",
    "review": "SELECT event_id AS snapshot_id, user_id AS business_id, event_type AS source, {seconds} AS captured, round(1 + value % 4, 1) AS rating, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) + CAST(floor(event_id / 50) AS BIGINT) AS review_count FROM events",
    "request": "SELECT event_id AS request_id, {seconds} AS second, user_id AS client, event_type AS engine, CASE WHEN event_type = 'error' OR event_id % 11 = 0 THEN 'error' WHEN event_id % 17 = 0 THEN 'blocked' ELSE 'ok' END AS outcome FROM events",
    "schedule": "SELECT n_nationkey AS schedule_id, n_name AS name, n_regionkey % 2 = 0 AS is_active, n_nationkey AS created FROM nation",
}
#: Rankings to a task where all of them are grouped.
TASK_ROWS = 500_000
#: Parts up to which Spark writes a shuffle as a file a part (spark.shuffle.sort.bypassMergeThreshold); for more, a task holds and sorts all the rows that it reads.
DIRECT_PARTS = 200
NEEDS = {"point": (), "fact": ("ranking", "point")}


def parts_of(rows: int) -> int:
    """Parts of TASK_ROWS rows; of up to three times as many, where that keeps them at DIRECT_PARTS."""
    return max(min(-(-rows // TASK_ROWS), DIRECT_PARTS), -(-rows // (3 * TASK_ROWS)))


class Views:
    """Attributes are the views of one folder of tables as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._made = spark, sf_dir, {}

    @property
    def parts(self) -> int:
        """Into how many parts rankings are dealt: their number grows with the table (a count that reads no column), so that a task's groups don't."""
        if "parts" not in self._made:
            least = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
            self._made["parts"] = max(least, parts_of(self.lineitem.count()))
        return self._made["parts"]

    @property
    def order_parts(self) -> int:
        """Into how many parts orders are dealt where they meet their customers, 0 where the session's partitions do."""
        if "order_parts" not in self._made:
            n = parts_of(self.orders.count())
            self._made["order_parts"] = n if n > int(self.spark.conf.get("spark.sql.shuffle.partitions")) else 0
        return self._made["order_parts"]

    def dealt(self, name: str, *keys: str) -> DataFrame:
        """A view of about a row a ranking, dealt by keys; for groups that are about as many as the rows, of which a partial sum leaves few out."""
        return getattr(self, name).repartition(self.parts, *keys)

    def spread(self, name: str, key: str, rows: int = 20_000) -> DataFrame:
        """A view of small rows dealt by a key, some rows a task: a small file is one task's, and what is built of each row, such as a page, would be too."""
        df, least = getattr(self, name), int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        return df.repartition(max(least, -(-df.count() // rows)), key)

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._made:
            if name in VIEWS:
                text = VIEWS[name].replace("{seconds}", SECONDS["spark"])
                for shared, own in SPARK.items():
                    text = text.replace(shared, own)
                if name == "point" and self.order_parts:
                    for shared, own in DEALT_ORDERS.items():
                        text = text.replace(shared, own.replace("{orders}", str(self.order_parts)))
                if "{parts}" in text:
                    text = text.replace("{parts}", str(self.parts))
                sources = {x: getattr(self, x) for x in (*BASE, *NEEDS.get(name, ())) if f" {x}" in text}
                for x, df in sources.items():
                    df.createOrReplaceTempView(x)
                self._made[name] = self.spark.sql(text)
            else:
                self._made[name] = read_table(self.spark, name, self.sf_dir)
        return self._made[name]


def with_views(names: tuple[str, ...], query: str) -> str:
    """DuckDB SQL of a query over these views."""
    order: list[str] = []

    def add(name: str) -> None:
        for x in NEEDS.get(name, ()):
            add(x)
        if name not in order:
            order.append(name)

    for n in names:
        add(n)
    made = ", ".join(f"{n} AS ({VIEWS[n].replace('{seconds}', SECONDS['duckdb'])})" for n in order)
    return (f"WITH {made} " if made else "") + f"SELECT * FROM ({query})"
