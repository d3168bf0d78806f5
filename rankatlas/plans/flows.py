"""Queries over what moves: streams in micro-batches of the tables, ingest with lasting ids, layout of facts, whole plans."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankatlas.operators import analytics as A
from rankatlas.operators import catalog as C
from rankatlas.operators import planning as P
from rankatlas.operators import resolve as R
from rankatlas.operators.lineage import checkpoint, shared_folder
from rankatlas.plans.catalogue import ENGINES, query
from rankatlas.sources import tables as T

# --- streams: a table in slices of time, some rows a slice late, and a last row far ahead that ends what is open

SLICES = 3
#: Requests to a bucket of clients that share state.
BUCKET_ROWS = 50_000


def _folder(v, name: str) -> str:
    return f"{shared_folder(v.spark)}/{name}-{uuid.uuid4().hex}"


def as_stream(v, rows: DataFrame, last: DataFrame, number: str) -> tuple[DataFrame, str]:
    """Rows with `second` as a stream, a file a micro-batch: slices of time in order, but each fifth `number` comes with the next slice; and how late that is."""
    ends = rows.agg(F.min("second"), F.max("second")).first()
    width = max(1, ((ends[1] or 0) - (ends[0] or 0)) // SLICES + 1)
    at = F.floor((F.col("second") - F.lit(ends[0] or 0)) / width) + (F.col(number) % 5 == 0).cast("int")
    path = _folder(v, "slices")
    for i in range(SLICES + 1):
        rows.filter(at == i).coalesce(1).write.mode("append").parquet(path)
    for far in (1, 2):  # the first moves the watermark, the second lets it take effect
        last.withColumn("second", F.lit((ends[1] or 0) + far * 1_000_000_000)).select(*rows.columns).coalesce(1).write.mode("append").parquet(path)
    return v.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path), f"{2 * width} seconds"


def _request_stream(v) -> tuple[DataFrame, str]:
    rows = v.request.select("client", "engine", "request_id", "second", "outcome")
    last = v.spark.createDataFrame([(-1, "none", -1, 0, "blocked")], "client long, engine string, request_id long, second long, outcome string")
    return as_stream(v, rows, last.select(*(F.col(f.name).cast(f.dataType) for f in rows.schema)), "request_id")


def _walk(key: str, length: int, rows: str) -> str:
    """SQL of each row's anchor: the first row of its key, or the first one `length` seconds or more after the last anchor."""
    return f"""SELECT * FROM (WITH RECURSIVE b AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY second, request_id) AS k FROM ({rows})),
      walk AS (SELECT {key}, k, request_id, second, second AS start FROM b WHERE k = 1
      UNION ALL SELECT b.{key}, b.k, b.request_id, b.second, CASE WHEN b.second - w.start >= {length} THEN b.second ELSE w.start END FROM walk w JOIN b ON b.{key} = w.{key} AND b.k = w.k + 1)
      SELECT * FROM walk)"""


_NTH = "row_number() OVER (PARTITION BY engine, start ORDER BY second, request_id)"
_EPISODES = f"SELECT engine, request_id, second, CAST({_NTH} AS INT) AS nth, CASE least({_NTH}, 3) WHEN 1 THEN 15 WHEN 2 THEN 120 ELSE 1440 END AS minutes FROM ({_walk('engine', 86_400, "SELECT * FROM request WHERE outcome = 'blocked'")})"


@query(_EPISODES, "request")
def j5_block_episode_stream(v):
    from rankatlas.streaming.ordered import block_episode_stream
    from rankatlas.streaming.streams import run_once

    log, late = _request_stream(v)
    return run_once(block_episode_stream(log, late), "append").filter("engine <> 'none'")


@query(_EPISODES, "request")
def j5_block_episodes_batch(v):
    from rankatlas.operators.audit import block_episodes

    return block_episodes(v.request)


_WINDOWS = f"SELECT client, start, count(*) AS requests FROM ({_walk('client', 60, 'SELECT * FROM request')}) GROUP BY client, start"


@query(_WINDOWS, "request")
def j2_rate_windows_stream(v):
    """All windows come from the stream itself."""
    from rankatlas.streaming.ordered import rate_windows_stream
    from rankatlas.streaming.streams import run_once

    log, late = _request_stream(v)
    return run_once(rate_windows_stream(log, 60, 3, late, max(64, v.request.count() // BUCKET_ROWS)), "append").filter("client >= 0").select("client", "start", "requests")


@query(_WINDOWS, "request")
def j2_rate_windows(v):
    from rankatlas.operators.audit import rate_audit

    return rate_audit(v.request, 60, 3).select("client", "start", "requests")


_HOURS = f"SELECT engine, start, count(*) AS in_hour, max(second) AS last, bool_or(outcome = 'blocked') AS bad FROM ({_walk('engine', 3600, 'SELECT * FROM request')}) w JOIN (SELECT request_id, outcome FROM request) r USING (request_id) GROUP BY engine, start"


@query(f"SELECT engine, start, in_hour, in_day, CASE WHEN bad THEN 'blocked' WHEN engine <> 'view' AND (in_hour >= 4 OR in_day >= 60) THEN 'throttled' ELSE 'healthy' END AS state FROM (SELECT h.engine, h.start, h.in_hour, h.bad, count(*) AS in_day FROM ({_HOURS}) h JOIN (SELECT engine, second FROM request) r ON r.engine = h.engine AND r.second <= h.last AND r.second // 86400 = h.last // 86400 GROUP BY ALL)", "request")
def j3_quota_audit_stream(v):
    """Limits come from a static table, which lacks one engine."""
    from rankatlas.streaming.ordered import quota_audit_stream
    from rankatlas.streaming.streams import run_once

    log, late = _request_stream(v)
    limits = v.request.select("engine").distinct().filter("engine <> 'view'").withColumns({"per_hour": F.lit(4), "per_day": F.lit(60)})
    return run_once(quota_audit_stream(log, limits, late), "append").filter("engine <> 'none'")


_SCANS = "SELECT client AS scan_id, second, row_number() OVER (PARTITION BY client ORDER BY second, request_id) - 1 AS k FROM request"


@query(f"SELECT scan_id, CASE WHEN n >= 3 THEN 'completed' ELSE 'failed' END AS status, CASE WHEN n >= 3 THEN third ELSE started + most END AS second, least(n, 3) AS points_done FROM (SELECT s.scan_id, s.second AS started, s.most, count(p.second) AS n, min(p.second) FILTER (p.k = 3) AS third FROM (SELECT *, CASE WHEN scan_id % 2 = 0 THEN 1440 ELSE 7200 END * 60 AS most FROM ({_SCANS}) WHERE k = 0) s LEFT JOIN ({_SCANS}) p ON p.scan_id = s.scan_id AND p.k > 0 AND p.second <= s.second + s.most GROUP BY ALL)", "request")
def j7_timeout_stream(v):
    """A client's first request starts a scan, and its next three are the scan's points; a day or five days are its time."""
    from pyspark.sql import Window

    from rankatlas.streaming.ordered import timeout_stream
    from rankatlas.streaming.streams import run_once

    k = F.row_number().over(Window.partitionBy("client").orderBy("second", "request_id"))
    rows = v.request.withColumn("k", k).filter("k <= 4").select(F.col("client").alias("scan_id"), "request_id", "second", F.when(F.col("k") == 1, 3).alias("points_total"), F.when(F.col("k") == 1, F.col("client") % 2 == 1).alias("in_batch"))
    last = v.spark.createDataFrame([(-1, -1, 0, None, None)], "scan_id long, request_id long, second long, points_total int, in_batch boolean")
    log, late = as_stream(v, rows, last.select(*(F.col(f.name).cast(f.dataType) for f in rows.schema)), "request_id")
    return run_once(timeout_stream(log, single=1440, batch=7200, late=late), "append").filter("scan_id >= 0")


_MOVES = "SELECT business_id, keyword, engine, scan_month, round(change, 4) AS change FROM (SELECT *, mean - lag(mean) OVER (PARTITION BY business_id, keyword, engine ORDER BY scan_month) AS change FROM (SELECT business_id, keyword, engine, scan_month, avg(rank) AS mean FROM fact GROUP BY ALL)) WHERE abs(change) >= 3"


@query(_MOVES, "fact")
def j10_alert_stream(v):
    """Alerts as the stream itself writes them, scans in three micro-batches."""
    from rankatlas.streaming.streams import alert_stream

    facts = v.dealt("fact", "business_id", "keyword", "engine").select("business_id", "keyword", "engine", "scan_month", "rank")
    path, third = _folder(v, "alerts"), F.ntile(3)
    from pyspark.sql import Window

    months = facts.select("scan_month").distinct().withColumn("part", third.over(Window.orderBy("scan_month")))
    dealt = checkpoint(facts.join(F.broadcast(months), "scan_month"))
    for i in (1, 2, 3):
        # a third comes in as many files as its tasks write; the stream goes on from its checkpoint and takes what is new as one micro-batch
        dealt.filter(F.col("part") == i).select(*facts.columns).write.mode("append").parquet(f"{path}/facts")
        alert_stream(v.spark.readStream.schema(facts.schema).parquet(f"{path}/facts"), path).awaitTermination()
    return v.spark.read.parquet(f"{path}/alerts").drop("batch")


# --- ingest


def _three_batches(v) -> list[DataFrame]:
    """Each business is seen by its place id, then by its phone alone, and then by both, which joins what were two entities."""
    b = v.business.select("business_id", "name", "city", "lat", "lng", "rating", "reviews")
    number = F.lpad(F.col("business_id").cast("string"), 9, "0")
    place, phone = F.concat(F.lit("place"), number), F.concat(F.lit("5"), number)

    def seen(i: int, place, phone) -> DataFrame:
        own = (F.col("business_id") * 3 + i).cast("long")
        return b.select(own.alias("obs_id"), F.lit(i).cast("long").alias("observed_at"), F.concat("name", F.lit(f" seen {i}")).alias("name"), place.cast("string").alias("place_id"), phone.cast("string").alias("phone"), F.lit(None).cast("string").alias("website"), "city", "lat", "lng", "rating", F.col("reviews").alias("review_count"), F.lit("maps").alias("source"), (own % 50).alias("point_id"), F.lit(1).alias("rank"))

    return [seen(0, place, F.lit(None)), seen(1, F.lit(None), phone), seen(2, place, phone)]


@query("SELECT 3 * business_id AS id, name || ' seen 0' AS name, 'place' || lpad(CAST(business_id AS VARCHAR), 9, '0') AS place_id, '5' || lpad(CAST(business_id AS VARCHAR), 9, '0') AS phone, 0 AS first_seen, 2 AS last_seen, 3 AS rankings, 3 * (rating IS NOT NULL)::INT AS snapshots FROM business", "business")
def j1_lasting_entities(v):
    """Entities with their facts after three batches: ids of the first batch stay, and those of the second are aliases."""
    folder = _folder(v, "ingest")
    for number, batch in enumerate(_three_batches(v)):
        R.ingest(batch, number, folder, order=("place_id", "phone"))
    known = R.entities(v.spark, folder).select("id", "name", "place_id", "phone", "first_seen", "last_seen")
    for name in ("rankings", "snapshots"):
        count = R.facts(v.spark, folder, name).groupBy(F.col("business_id").alias("id")).agg(F.count("*").cast("int").alias(name))
        known = known.join(count, "id", "full")
    return known.withColumn("snapshots", F.coalesce("snapshots", F.lit(0))).withColumns({c: F.col(c).cast("int") for c in ("first_seen", "last_seen")})


@query("SELECT business_id, point_id, count(*) AS n FROM (SELECT 3 * business_id AS business_id, (3 * business_id + i) % 50 AS point_id FROM business CROSS JOIN (VALUES (0), (1), (2)) t(i)) GROUP BY ALL", "business")
def j1_any_order(v):
    """The same batches, the last first: the entities are the same, under the ids that came first."""
    folder = _folder(v, "ingest")
    for number, batch in enumerate(reversed(_three_batches(v))):
        R.ingest(batch, number, folder, order=("place_id", "phone"))
    first = F.floor(F.col("business_id") / 3) * 3
    return R.facts(v.spark, folder).groupBy(first.alias("business_id"), "point_id").agg(F.count("*").alias("n"))


@query("SELECT a.business_id, count(*) AS n_close FROM (SELECT business_id, business_id % 20 AS phone, substr(md5(CAST(business_id // 3 AS VARCHAR)), 1, 8 + business_id % 3) AS name FROM business) a JOIN (SELECT business_id % 20 AS phone, substr(md5(CAST(business_id // 3 AS VARCHAR)), 1, 8 + business_id % 3) AS name FROM business) b ON a.phone = b.phone AND levenshtein(a.name, b.name) <= 3 GROUP BY a.business_id", "business")
def c13_close_names(v):
    """Names under twenty phones, with those within three edits under the same one, found by shared parts."""
    name = F.substring(F.md5(F.floor(F.col("business_id") / 3).cast("string")), F.lit(1), (8 + F.col("business_id") % 3).cast("int"))
    names = v.business.select("business_id", (F.col("business_id") % 20).cast("string").alias("norm_phone"), name.alias("norm_name"))
    return R.close_names(names, names).groupBy("business_id").agg(F.countDistinct("other_business_id").alias("n_close"))


_AWAY = "SELECT business_id, is_mine, lat, (lng - 98 + 540) % 360 - 180 AS lng FROM business"


@query(f"SELECT ours, business_id, nth, round(miles, 4) AS miles FROM (SELECT *, row_number() OVER (PARTITION BY ours ORDER BY round(miles, 6), business_id) AS nth FROM (SELECT a.business_id AS ours, b.business_id, 2 * 3958.8 * atan2(sqrt(h), sqrt(1 - h)) AS miles FROM (SELECT * FROM ({_AWAY}) WHERE is_mine) a JOIN ({_AWAY}) b ON a.business_id <> b.business_id, LATERAL (SELECT pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lng - a.lng) / 2), 2) AS h)) WHERE miles <= 40) WHERE nth <= 7", "business")
def c19_across_the_date_line(v):
    """Businesses moved to where longitudes turn from 180 to -180, and a reach that crosses areas."""
    away = v.business.select("business_id", "is_mine", "lat", (F.pmod(F.col("lng") - 98 + 540, F.lit(360.0)) - 180).alias("lng"))
    return C.nearby(away, 40, 7)


# --- plans, layout, metrics with all their columns

_WHOLE = "SELECT area_id, slug, coalesce(keyword, slug) AS keyword, coalesce(priority, 1) AS priority, engine FROM (SELECT * FROM area WHERE is_active) CROSS JOIN (SELECT * FROM category WHERE is_active) c LEFT JOIN keyword k ON c.slug = k.category CROSS JOIN (VALUES ('1-URGENT'), ('2-HIGH'), ('5-LOW')) e(engine)"


def _whole_plan(v) -> DataFrame:
    return P.expand_scan_plan(v.area, v.category, v.keyword, ["1-URGENT", "2-HIGH", "5-LOW", "unknown"], tuple(ENGINES))


@query(_WHOLE, "area category keyword")
def c7_whole_plan(v):
    """All keywords of all active categories in all active areas."""
    return _whole_plan(v)


@query(f"SELECT area_id, slug, keyword, engine, row_number() OVER (PARTITION BY engine ORDER BY priority DESC, area_id, slug, keyword) AS turn FROM ({_WHOLE})", "area category keyword")
def f8_whole_queue(v):
    return P.queue_order(_whole_plan(v)).select("area_id", "slug", "keyword", "engine", "turn")


@query("SELECT scan_month, count(*) AS n, sum(rank)::BIGINT AS ranks FROM fact WHERE scan_month BETWEEN 23940 AND 23960 GROUP BY scan_month", "fact")
def a5_months_of_facts(v):
    """Facts appended by month in two parts, one of them twice by overwriting its months, and read for some months only."""
    path = _folder(v, "facts")
    columns = ["point_id", "business_id", "rank", "scan_month"]
    T.append(v.fact.filter("scan_month < 23950").select(*columns), path, ["scan_month"])
    T.append(v.fact.filter("scan_month >= 23950").select(*columns), path, ["scan_month"])
    T.overwrite_partitions(v.fact.filter("scan_month = 23950").select(*columns), path, ["scan_month"])
    return T.read_path(v.spark, path).filter("scan_month BETWEEN 23940 AND 23960").groupBy("scan_month").agg(F.count("*").alias("n"), F.sum("rank").alias("ranks"))


@query("SELECT p.area_id, p.keyword, p.engine, p.scan_month, grid_row, grid_col, min(rank) AS rank, CASE WHEN min(rank) IS NOT NULL THEN 7 END AS business_id, CASE WHEN min(rank) IS NOT NULL THEN (SELECT name FROM ranked WHERE business_id = 7) END AS name FROM point p LEFT JOIN (SELECT point_id, rank FROM fact WHERE business_id = 7) f ON p.point_id = f.point_id WHERE p.scan_month = 23960 GROUP BY ALL", "fact point ranked")
def d12_named_heatmap(v):
    """A given scan, with the business's name where it ranks."""
    return A.geo_heatmap(v.fact, v.point, 7, scan=23960, businesses=v.ranked)


_SHARES = "SELECT t.business_id, t.area_id, t.scan_month, round(100.0 * top_points / points, 4) AS solv FROM (SELECT business_id, area_id, scan_month, count(*) AS top_points FROM fact WHERE rank <= 3 AND point_id IN (SELECT point_id FROM point WHERE status = 'completed') GROUP BY ALL) t JOIN (SELECT area_id, scan_month, count(*) AS points FROM point WHERE status = 'completed' GROUP BY ALL) p ON t.area_id = p.area_id AND t.scan_month = p.scan_month"


@query(f"SELECT *, round(solv - before, 4) AS change FROM (SELECT *, lag(solv) OVER (PARTITION BY business_id, area_id ORDER BY scan_month) AS before FROM ({_SHARES}))", "fact point")
def d13_solv_trend(v):
    shares = A.solv(v.fact, v.point, ["area_id", "scan_month"])
    return A.solv_trend(shares, ["area_id"]).select("business_id", "area_id", "scan_month", "solv", "before", "change")


_VELOCITY = "SELECT business_id, CASE WHEN rate > 5 THEN 'accelerating' WHEN rate >= 1 THEN 'stable' WHEN rate = 0 AND captured - first >= 7776000 THEN 'stale' ELSE 'slowing' END AS velocity FROM (SELECT *, round((review_count - least_) / 3.0, 4)::DOUBLE AS rate FROM (SELECT *, min(review_count) OVER (PARTITION BY business_id ORDER BY captured RANGE BETWEEN 7776000 PRECEDING AND CURRENT ROW) AS least_, min(captured) OVER (PARTITION BY business_id) AS first, row_number() OVER (PARTITION BY business_id ORDER BY captured DESC, snapshot_id DESC) AS nth FROM review) WHERE nth = 1)"
_MOMENTUM = "SELECT business_id, CASE WHEN new - old < -0.5 THEN 'rising' WHEN new - old > 0.5 THEN 'falling' ELSE 'stable' END AS momentum FROM (SELECT business_id, arg_max(mean, scan_month) AS new, arg_min(mean, scan_month) AS old FROM (SELECT *, row_number() OVER (PARTITION BY business_id ORDER BY scan_month DESC) AS nth FROM (SELECT business_id, scan_month, avg(rank) AS mean FROM fact GROUP BY ALL)) WHERE nth <= 3 GROUP BY business_id)"


@query("SELECT b.business_id, name, is_mine, avg_rank, keywords, areas, engines, reviews, rating, " + ", ".join(f"e{e[0]}" for e in ENGINES) + f", velocity, momentum FROM (SELECT * FROM ranked WHERE is_mine OR is_competitor) b LEFT JOIN (SELECT business_id, round(avg(rank), 4) AS avg_rank, count(DISTINCT keyword) AS keywords, count(DISTINCT area_id) AS areas, count(DISTINCT engine) AS engines, " + ", ".join(f"round(avg(rank) FILTER (engine = '{e}'), 4) AS e{e[0]}" for e in ENGINES) + f" FROM fact GROUP BY business_id) f USING (business_id) LEFT JOIN ({_VELOCITY}) USING (business_id) LEFT JOIN ({_MOMENTUM}) USING (business_id)", "fact ranked review")
def d17_whole_profile(v):
    return A.competitor_profile(v.fact, v.ranked, A.review_velocity(v.review), A.ranking_momentum(v.fact), ENGINES)


_SPREAD = "SELECT area_id, keyword, business_id, rank + business_id * 13 % 17 AS rank FROM fact"


@query(f"SELECT area_id, keyword, round(mine, 4) AS mine, round(theirs, 4) AS theirs, round(mine - theirs, 4) AS gap, CASE WHEN mine - theirs >= 10 OR (mine IS NULL AND theirs <= 3) THEN 'high' WHEN mine - theirs >= 5 THEN 'medium' ELSE 'low' END AS opportunity FROM (SELECT m.area_id, keyword, min(mean) FILTER (is_mine) AS mine, min(mean) FILTER (is_competitor) AS theirs FROM (SELECT area_id, keyword, business_id, avg(rank) AS mean FROM ({_SPREAD}) GROUP BY ALL) m JOIN ranked b ON m.business_id = b.business_id GROUP BY ALL) WHERE theirs IS NOT NULL", "fact ranked")
def d21_gap_classes(v):
    """Ranks spread by business, so that gaps of all classes come up."""
    return A.competitor_gap(v.dealt("fact", "business_id").withColumn("rank", F.col("rank") + F.col("business_id") * 13 % 17), v.ranked)


_SIDES = "SELECT point_id, status, area_id * 10 + point_id % 10 AS area_id, business_id % 4 AS business_id, min(rank) AS rank FROM fact GROUP BY ALL"


@query(f"SELECT area_id, mine, theirs, CASE WHEN coalesce(mine, 0) < 40 AND coalesce(theirs, 0) < 40 THEN 'neither' WHEN coalesce(mine, 0) >= 40 AND coalesce(theirs, 0) >= 40 AND abs(coalesce(mine, 0) - coalesce(theirs, 0)) <= 10 THEN 'contested' WHEN coalesce(mine, 0) > coalesce(theirs, 0) THEN 'mine' ELSE 'competitor' END AS holder FROM (SELECT t.area_id, max(round(100.0 * n / points, 4)) FILTER (business_id = 0) AS mine, max(round(100.0 * n / points, 4)) FILTER (business_id = 1) AS theirs FROM (SELECT area_id, business_id, count(*) AS n FROM ({_SIDES}) WHERE rank <= 3 AND status = 'completed' GROUP BY ALL) t JOIN (SELECT area_id * 10 + point_id % 10 AS area_id, count(*) AS points FROM point WHERE status = 'completed' GROUP BY 1) p ON t.area_id = p.area_id WHERE business_id < 2 GROUP BY t.area_id)", "fact point")
def d20_holder_classes(v):
    """Four camps of businesses in tenths of areas, so that every kind of holder comes up."""
    tenth = (F.col("area_id") * 10 + F.col("point_id") % 10).alias("area_id")
    facts = v.fact.groupBy("point_id", "status", tenth, (F.col("business_id") % 4).alias("business_id")).agg(F.min("rank").alias("rank"))
    points = v.point.select("point_id", "status", tenth)
    camps = v.ranked.select((F.col("business_id") % 4).alias("business_id")).distinct().select("business_id", (F.col("business_id") == 0).alias("is_mine"), (F.col("business_id") == 1).alias("is_competitor"))
    return A.geo_dominance(facts, points, camps)


# --- rows that compare all that an operator gives


@query("SELECT page_id, length(url) AS chars FROM pages WHERE page_id % 2 = 0")
def a1_declared_schema(v):
    """A table read by a declared schema, so that no footer is read for one."""
    return T.read_table(v.spark, "pages", v.sf_dir, "page_id bigint, url string").filter("page_id % 2 = 0").select("page_id", F.length("url").alias("chars"))


@query("SELECT category, keyword, count(*) OVER (PARTITION BY category) - row_number() OVER (PARTITION BY category ORDER BY priority DESC, keyword) + 1 AS priority FROM keyword", "keyword")
def a4_seed_keywords(v):
    """Priorities of all categories' keywords, from lists of them."""
    lists = v.keyword.groupBy(F.col("category").alias("slug")).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("priority")).alias("p"), "keyword"))), lambda k: k["keyword"]).alias("keywords"))
    return P.keyword_priorities(lists)


@query("WITH RECURSIVE t AS (SELECT s_suppkey AS descendant, s_suppkey AS ancestor, 0 AS depth FROM supplier UNION ALL SELECT descendant, ancestor // 2, depth + 1 FROM t WHERE ancestor > 1) SELECT CAST(ancestor AS VARCHAR) AS ancestor, CAST(descendant AS VARCHAR) AS descendant, depth FROM t")
def c6_deep_closure(v):
    """A tree of as many levels as the suppliers' number has binary digits."""
    slug, up = F.col("s_suppkey").cast("string"), F.floor(F.col("s_suppkey") / 2)
    return C.category_closure(v.supplier.select(slug.alias("slug"), F.when(up > 0, up.cast("string")).alias("parent"))).select("ancestor", "descendant", "depth")


@query("SELECT business_id, business_id % 50 AS point_id, CAST(business_id % 9 AS INT) AS rank, 0 AS observed_at FROM business UNION ALL SELECT business_id, (business_id + 1000000000) % 50, CAST((business_id + 1000000000) % 9 AS INT), 1 FROM business WHERE business_id % 2 = 0", "business")
def i10_rankings(v):
    """The ranking row of every observation."""
    from rankatlas.plans.catalogue import _observations

    seen = _observations(v).withColumns({"point_id": F.col("obs_id") % 50, "rank": (F.col("obs_id") % 9).cast("int")})
    known = seen.select("obs_id", F.when(F.col("obs_id") >= 1_000_000_000, F.col("obs_id") - 1_000_000_000).otherwise(F.col("obs_id")).alias("business_id"))
    return R.build_facts(seen, known)[0].withColumn("observed_at", F.col("observed_at").cast("int"))


@query("SELECT business_id, 'google' AS source, rating, reviews AS review_count FROM business WHERE rating IS NOT NULL UNION ALL SELECT business_id, 'bing', rating, reviews FROM business WHERE business_id % 2 = 0 AND rating IS NOT NULL", "business")
def i10_snapshots(v):
    """The review snapshot of every observation that has a rating and a count."""
    from rankatlas.plans.catalogue import _observations

    seen = _observations(v).withColumns({"point_id": F.col("obs_id") % 50, "rank": F.lit(1)})
    known = seen.select("obs_id", F.when(F.col("obs_id") >= 1_000_000_000, F.col("obs_id") - 1_000_000_000).otherwise(F.col("obs_id")).alias("business_id"))
    return R.build_facts(seen, known)[1].select("business_id", "source", "rating", "review_count")


@query("SELECT DISTINCT o_orderkey, o_custkey FROM orders")
def j8_deduped_rows(v):
    """Every order arrives twice, the second time in a later micro-batch; the rows that stay."""
    from rankatlas.streaming.streams import dedupe_stream, run_once

    path, orders = _folder(v, "twice"), v.orders.select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("timestamp").alias("ts"))
    for _ in range(2):
        orders.coalesce(1).write.mode("append").parquet(path)
    rows = v.spark.readStream.schema("o_orderkey long, o_custkey long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(path)
    return run_once(dedupe_stream(rows, ["o_orderkey", "o_custkey"], "100000 days"), "append").select("o_orderkey", "o_custkey")


@query("SELECT business_id % 7 AS run_id, count(*) AS total, count(*) FILTER (business_id % 3 > 0) AS enriched, count(*) FILTER (business_id % 3 = 0) AS processed_without, 0::BIGINT AS skipped, 0::BIGINT AS failed, string_agg(mail, ',' ORDER BY found_at) AS emails FROM (SELECT business_id, CASE WHEN business_id % 3 > 0 AND row_number() OVER (PARTITION BY business_id % 7, 'm' || business_id % 40, business_id % 3 > 0 ORDER BY last_seen * 100000 + business_id) = 1 THEN 'm' || business_id % 40 END AS mail, last_seen * 100000 + business_id AS found_at FROM business) GROUP BY 1", "business")
def d9_runs_in_order(v):
    """Runs of enrichment, each with its distinct addresses in the order in which they were found."""
    found = F.col("business_id") % 3 > 0
    log = v.business.select((F.col("business_id") % 7).alias("run_id"), F.when(found, "success").otherwise("no_email_found").alias("status"), F.when(found, F.concat(F.lit("m"), (F.col("business_id") % 40).cast("string"))).alias("email"), (F.col("last_seen") * 100_000 + F.col("business_id")).alias("created_at"))
    return A.enrichment_summary(log)
