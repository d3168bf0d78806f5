"""Every query of the ranking library by name, with its SQL over the same views."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankatlas.functions import scalars as S
from rankatlas.operators import analytics as A
from rankatlas.operators import audit as U
from rankatlas.operators import catalog as C
from rankatlas.operators import planning as P
from rankatlas.plans.views import Views, with_views

ENGINES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
_found: dict[str, tuple[Callable[[Views], DataFrame], str | None]] = {}


def query(sql: str | None = None, needs: str = ""):
    """Registers a function of views under its name; `needs` names the views of its SQL."""

    def add(f):
        _found[f.__name__] = f, sql and with_views(tuple(needs.split()), sql)
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from rankatlas.plans import flows, more, pages  # noqa: F401  register their own

    return {n: (lambda spark, sf_dir, f=f: f(Views(spark, sf_dir))) for n, (f, _) in _found.items()}


def oracle_sql() -> dict[str, str]:
    from rankatlas.plans import flows, more, pages  # noqa: F401

    return {n: sql for n, (_, sql) in _found.items() if sql}


# --- quality of tables


@query("SELECT count(*) AS kept, count(*) FILTER (NOT ok) AS rejected FROM (SELECT coalesce(rating >= 2, FALSE) AND coalesce(length(name) BETWEEN 1 AND 100, FALSE) AS ok FROM business)".replace("count(*) AS kept", "count(*) FILTER (ok) AS kept"), "business")
def a8_validate(v):
    good, bad = C.validate(v.business, {"rating": ("must be 2 or more", F.col("rating") >= 2), "name": ("must have 1 to 100 characters", F.length("name").between(1, 100))})
    return good.agg(F.count("*").alias("kept")).crossJoin(bad.agg(F.count("*").alias("rejected")))


@query("SELECT business_id, coalesce(rating, 0) AS rating, coalesce(phone, 'none') AS phone FROM business", "business")
def a9_defaults(v):
    from rankatlas.sources.tables import apply_defaults

    return apply_defaults(v.business.select("business_id", "rating", "phone"), {"rating": 0.0, "phone": "none"})


@query("SELECT l_orderkey, count(*) AS violations FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P') GROUP BY l_orderkey")
def a10_fk_violations(v):
    return C.fk_violations(v.lineitem, v.orders.filter("o_orderstatus <> 'P'"), "l_orderkey", "o_orderkey")


@query("SELECT point_id, business_id, count(*) AS copies FROM ranking GROUP BY point_id, business_id HAVING count(*) > 1", "ranking")
def a11_unique_violations(v):
    return C.unique_violations(v.ranking, ["point_id", "business_id"])


@query("SELECT r.point_id, r.business_id, r.rank FROM ranking r JOIN point p ON r.point_id = p.point_id WHERE NOT (p.engine = '5-LOW' AND p.area_id = 3)", "ranking point")
def a12_cascade_delete(v):
    gone = v.point.filter("engine = '5-LOW' AND area_id = 3").select("area_id", "engine").distinct()
    scans = v.point.select("area_id", "engine").distinct()
    points = v.point.withColumn("scan_id", F.concat_ws("|", "area_id", "engine"))
    kept = C.cascade_delete(scans.withColumn("scan_id", F.concat_ws("|", "area_id", "engine")), points, v.ranking, gone.select(F.concat_ws("|", "area_id", "engine").alias("scan_id")))[2]
    return kept.join(v.point.select("point_id"), "point_id", "left_semi").select("point_id", "business_id", "rank")


@query("SELECT area_id, area FROM area WHERE NOT coalesce(area_id % 4 = 0, FALSE)", "area")
def a13_delete_where(v):
    from rankatlas.sources.tables import delete_where

    return delete_where(v.area, F.col("area_id") % 4 == 0).select("area_id", "area")


@query("SELECT business_id, CASE WHEN business_id % 100 = 0 THEN 5.0 ELSE rating END AS rating, name FROM business", "business")
def a15_apply_updates(v):
    from rankatlas.sources.tables import apply_updates

    changes = v.business.filter("business_id % 100 = 0").select("business_id", F.lit(5.0).alias("rating"))
    return apply_updates(v.business.select("business_id", "rating", "name"), changes, "business_id")


@query("SELECT coalesce(b.business_id, n.id) AS business_id, coalesce(n.rating, b.rating) AS rating FROM (SELECT business_id, rating FROM business WHERE business_id % 3 <> 0) b FULL JOIN (SELECT business_id AS id, CASE WHEN business_id % 2 = 0 THEN 1.5 END AS rating FROM business WHERE business_id % 5 = 0) n ON b.business_id = n.id", "business")
def a6_upsert(v):
    from rankatlas.sources.tables import upsert

    target = v.business.filter("business_id % 3 <> 0").select("business_id", "rating")
    source = v.business.filter("business_id % 5 = 0").select("business_id", F.when(F.col("business_id") % 2 == 0, 1.5).alias("rating"))
    return upsert(target, source, ["business_id"])


@query("SELECT point_id, CASE WHEN status = 'pending' THEN 'failed' ELSE status END AS status FROM point", "point")
def a7_update_where(v):
    from rankatlas.sources.tables import update_where

    return update_where(v.point.select("point_id", "status"), F.col("status") == "pending", {"status": F.lit("failed")})


# --- filters and lists


@query("SELECT area_id, area FROM area WHERE is_active", "area")
def b1_active(v):
    return C.active(v.area).select("area_id", "area")


@query("SELECT business_id, name, rating FROM business WHERE is_active AND category = 'MACHINERY' AND rating >= 2.5 AND phone IS NOT NULL AND website IS NOT NULL", "business")
def b2_filter_businesses(v):
    return C.filter_businesses(v.business, category="MACHINERY", min_rating=2.5, has_phone=True, has_website=True).select("business_id", "name", "rating")


@query("SELECT business_id, city FROM business WHERE is_active AND lower(city) = lower('7')", "business")
def b3_city(v):
    return C.filter_businesses(v.business, city="7").select("business_id", "city")


@query("SELECT business_id FROM business b WHERE EXISTS (SELECT 1 FROM fact f WHERE f.business_id = b.business_id AND engine = '2-HIGH')", "business fact")
def b6_ranked_by(v):
    return C.ranked_by(v.business, v.fact, "2-HIGH").select("business_id")


@query("SELECT business_id, name FROM business WHERE is_active AND is_mine", "business")
def b7_mine(v):
    return C.filter_businesses(v.business, is_mine=True).select("business_id", "name")


@query("SELECT business_id, name, last_seen FROM business WHERE is_active AND (contains(lower(name), '00012') OR contains(lower(address), '00012') OR contains(lower(city), '00012') OR contains(lower(website), '00012') OR contains(phone, '00012')) ORDER BY last_seen DESC, business_id LIMIT 50", "business")
def b8_search(v):
    return C.search(v.business, "00012").select("business_id", "name", "last_seen")


@query("SELECT point_id, scan_month FROM point WHERE engine = '1-URGENT' AND status = 'completed' AND area_id = 4", "point")
def b9_filter_scans(v):
    return C.filter_scans(v.point, status="completed", engine="1-URGENT", area=4).select("point_id", "scan_month")


@query("SELECT business_id, enriched_hours FROM business WHERE is_active AND website IS NOT NULL AND email IS NULL AND (enriched_hours IS NULL OR enriched_hours > 168) ORDER BY enriched_hours DESC NULLS FIRST, business_id LIMIT 500", "business")
def b12_enrichment_candidates(v):
    return C.enrichment_candidates(v.business).select("business_id", "enriched_hours")


@query("SELECT area_id, engine, CASE WHEN count(*) > 0 THEN CAST(round(100.0 * count(*) FILTER (status = 'completed') / count(*)) AS INT) ELSE 0 END AS percent FROM point GROUP BY area_id, engine", "point")
def b14_percent(v):
    return v.point.groupBy("area_id", "engine").agg(S.percent(F.count_if(F.col("status") == "completed"), F.count("*")).alias("percent"))


@query("SELECT point_id, CASE WHEN status IN ('completed', 'failed', 'cancelled') THEN status ELSE 'cancelled' END AS status FROM point", "point")
def b15_cancel(v):
    return P.cancel(v.point.select("point_id", "status"))


@query("SELECT engine, CASE WHEN engine LIKE '1%' THEN 'bing' ELSE 'google' END AS family, count(*) AS points FROM point GROUP BY engine", "point")
def b16_engine_family(v):
    named = v.point.withColumn("id", F.when(F.col("engine").startswith("1"), F.concat(F.lit("bing_"), "engine")).otherwise(F.lit("google_maps")))
    return named.groupBy("engine", S.engine_family(F.col("id")).alias("family")).agg(F.count("*").alias("points"))


@query("SELECT business_id, scan_month, rank FROM fact WHERE keyword = 'kw3' AND area_id = 5 AND engine = '3-MEDIUM' AND scan_month BETWEEN 23965 AND 23980", "fact")
def b17_filter_trend(v):
    return C.filter_trend(v.fact, keyword="kw3", area=5, engine="3-MEDIUM", start=23965, end=23980).select("business_id", "scan_month", "rank")


@query("SELECT page_id, contains(lower(html), 'captcha') OR contains(lower(html), 'unusual traffic') OR contains(lower(html), 'our systems have detected') OR contains(lower(html), 'sorry/index') OR contains(lower(html), 'recaptcha') AS blocked FROM pages")
def b18_blocked_pages(v):
    return v.pages.select("page_id", S.is_blocked_page(F.col("html")).alias("blocked"))


@query("SELECT page_id, octet_length(encode(html)) AS bytes FROM pages WHERE octet_length(encode(html)) <= 5242880 AND contains(lower(html), '<html')")
def b19_usable_pages(v):
    return C.usable_pages(v.pages).filter(F.lower("html").contains("<html")).select("page_id", "bytes")


@query("SELECT business_id, snapshot_id FROM (SELECT *, row_number() OVER (PARTITION BY business_id ORDER BY captured DESC, snapshot_id DESC) AS nth FROM review) WHERE nth <= 100", "review")
def b21_review_history(v):
    return C.review_history(v.review).select("business_id", "snapshot_id")


# --- joins


@query("SELECT p.point_id, a.area, p.engine FROM point p LEFT JOIN area a ON p.area_id = a.area_id", "point area")
def c1_scans_with_dims(v):
    return v.point.join(v.area, "area_id", "left").select("point_id", "area", "engine")


@query("SELECT b.business_id, b.category, n.n FROM business b LEFT JOIN (SELECT category, count(*) AS n FROM business GROUP BY category) n ON b.category = n.category", "business")
def c2_businesses_with_category(v):
    return v.business.join(v.business.groupBy("category").agg(F.count("*").alias("n")), "category", "left").select("business_id", "category", "n")


@query("SELECT business_id, point_id, rank, nth FROM (SELECT *, row_number() OVER (PARTITION BY business_id ORDER BY scan_month DESC, point_id) AS nth FROM fact) WHERE nth <= 100", "fact")
def c3_rank_history(v):
    return C.rank_history(v.fact).select("business_id", "point_id", "rank", "nth")


@query("SELECT p.point_id, coalesce(n, 0) AS n_results, first FROM point p LEFT JOIN (SELECT point_id, count(*) AS n, min(rank) AS first FROM fact GROUP BY point_id) f ON p.point_id = f.point_id", "point fact")
def c4_scan_results(v):
    out = C.scan_results(v.fact, v.point, v.ranked)
    return out.select("point_id", "n_results", F.get_json_object("results", "$[0].rank").cast("int").alias("first"))


@query("SELECT c.slug, c.parent, children, coalesce(nc, 0) AS n_children, keywords, coalesce(nk, 0) AS n_keywords FROM category c LEFT JOIN (SELECT parent AS s, string_agg(slug, ',' ORDER BY slug) AS children, count(*) AS nc FROM category WHERE is_active AND parent IS NOT NULL GROUP BY parent) ch ON c.slug = ch.s LEFT JOIN (SELECT category AS s, string_agg(keyword, ',' ORDER BY priority DESC, keyword) AS keywords, count(*) AS nk FROM keyword GROUP BY category) k ON c.slug = k.s", "category keyword")
def c5_category_overview(v):
    return C.category_overview(v.category, v.keyword)


@query("WITH RECURSIVE tree AS (SELECT slug AS ancestor, slug AS descendant, 0 AS depth FROM category UNION ALL SELECT c.parent, t.descendant, t.depth + 1 FROM tree t JOIN category c ON t.ancestor = c.slug WHERE c.parent IS NOT NULL) SELECT * FROM tree", "category")
def c6_category_closure(v):
    return C.category_closure(v.category)


_PLAN = "SELECT area_id, slug, coalesce(keyword, slug) AS keyword, coalesce(priority, 1) AS priority, engine FROM (SELECT * FROM area WHERE is_active) CROSS JOIN (SELECT * FROM category WHERE is_active) c LEFT JOIN (SELECT category, keyword, priority, row_number() OVER (PARTITION BY category ORDER BY priority DESC, keyword) AS nth FROM keyword) k ON c.slug = k.category CROSS JOIN (VALUES ('1-URGENT'), ('2-HIGH')) e(engine) WHERE nth IS NULL OR nth <= 5"


def _plan(v):
    return P.expand_scan_plan(v.area, v.category, v.keyword, ["1-URGENT", "2-HIGH", "unknown"], tuple(ENGINES), per_category=5)


@query(_PLAN, "area category keyword")
def c7_scan_plan(v):
    return _plan(v)


@query("SELECT area_id, r AS grid_row, c AS grid_col, round(round(lat + u - r * (2 * u / 6), 7), 4) AS lat, round(round(lng - w + c * (2 * w / 6), 7), 4) AS lng FROM (SELECT *, radius_miles / 69 AS u, radius_miles / (69 * cos(radians(lat))) AS w FROM area) CROSS JOIN range(7) a(r) CROSS JOIN range(7) b(c)", "area")
def c8_expand_points(v):
    return P.expand_points(v.area).select("area_id", "grid_row", "grid_col", F.round("point_lat", 4).alias("lat"), F.round("point_lng", 4).alias("lng"))


@query("SELECT point_id, area_id FROM point WHERE status = 'pending'", "point")
def c16_recovery_plan(v):
    return P.recovery_plan(v.point, ["area_id", "engine", "scan_month"])[0].select("point_id", "area_id")


@query("SELECT DISTINCT area_id, keyword FROM fact WHERE business_id IN (SELECT business_id FROM ranked WHERE is_competitor) EXCEPT SELECT area_id, keyword FROM fact WHERE business_id IN (SELECT business_id FROM ranked WHERE is_mine)", "fact ranked")
def c17_keyword_gap(v):
    return A.keyword_gap(v.fact, v.ranked)


@query("SELECT DISTINCT area_id, keyword FROM fact WHERE business_id IN (SELECT business_id FROM ranked WHERE is_competitor) EXCEPT SELECT area_id, keyword FROM fact WHERE business_id IN (SELECT business_id FROM ranked WHERE is_mine)", "fact ranked")
def c17_keyword_gap_all(v):
    return A.keyword_gap(v.fact, v.ranked)


@query("SELECT coalesce(x.business_id, y.business_id) AS business_id, coalesce(x.grid_row, y.grid_row) AS grid_row, coalesce(x.grid_col, y.grid_col) AS grid_col, before, after, CASE WHEN before IS NULL THEN 'new' WHEN after IS NULL THEN 'lost' WHEN after < before THEN 'improved' WHEN after > before THEN 'declined' ELSE 'unchanged' END AS change FROM (SELECT business_id, grid_row, grid_col, min(rank) AS before FROM fact WHERE scan_month % 2 = 0 GROUP BY ALL) x FULL JOIN (SELECT business_id, grid_row, grid_col, min(rank) AS after FROM fact WHERE scan_month % 2 = 1 GROUP BY ALL) y ON x.business_id = y.business_id AND x.grid_row = y.grid_row AND x.grid_col = y.grid_col", "fact")
def c18_compare_scans(v):
    return A.compare_scans(v.fact.filter("scan_month % 2 = 0"), v.fact.filter("scan_month % 2 = 1"))


@query("SELECT ours, business_id, nth, round(miles, 4) AS miles FROM (SELECT *, row_number() OVER (PARTITION BY ours ORDER BY round(miles, 6), business_id) AS nth FROM (SELECT a.business_id AS ours, b.business_id, 2 * 3958.8 * atan2(sqrt(h), sqrt(1 - h)) AS miles FROM (SELECT *, 1 AS one FROM business WHERE is_mine) a JOIN business b ON a.business_id <> b.business_id, LATERAL (SELECT pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lng - a.lng) / 2), 2) AS h)) WHERE miles <= 2) WHERE nth <= 5", "business")
def c19_nearby(v):
    return C.nearby(v.business, 2, 5)


# --- metrics


@query("SELECT count(*) AS total, CAST(ceil(count(*) / 20) AS BIGINT) AS total_pages FROM business WHERE is_active", "business")
def d1_page_counts(v):
    return C.page_counts(C.active(v.business), 20)


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS rows, {'count(*) FILTER (is_active)' if active else 'NULL::BIGINT'} AS active FROM {t}" for t, active in (("area", 1), ("category", 1), ("business", 1), ("point", 0), ("ranking", 0))), "area category business point ranking")
def d2_system_stats(v):
    return C.system_stats(area=v.area, category=v.category, business=v.business, point=v.point, ranking=v.ranking)


@query("SELECT area_id, engine, scan_month, count(*) FILTER (status = 'completed') AS points_done, count(*) FILTER (status = 'failed') AS points_failed, count(*) AS points_total, CAST(round(100.0 * count(*) FILTER (status = 'completed') / count(*)) AS INT) AS percent FROM point GROUP BY area_id, engine, scan_month", "point")
def d4_scan_progress(v):
    return P.scan_progress(v.point, ["area_id", "engine", "scan_month"])


@query("SELECT area_id, engine, scan_month, CASE WHEN d >= t THEN 'completed' WHEN t = d + f THEN 'failed' ELSE 'running' END AS new_status, CASE WHEN d < t AND t = d + f THEN 'Only ' || d || '/' || t || ' points completed' END AS message FROM (SELECT area_id, engine, scan_month, count(*) FILTER (status = 'completed') AS d, count(*) FILTER (status = 'failed') AS f, count(*) AS t FROM point GROUP BY ALL)", "point")
def d5_reduce_status(v):
    return P.reduce_status(P.scan_progress(v.point, ["area_id", "engine", "scan_month"])).select("area_id", "engine", "scan_month", "new_status", "message")


@query("SELECT engine, count(*) AS depth FROM point WHERE status = 'pending' GROUP BY ROLLUP (engine)", "point")
def d7_pending_depth(v):
    return P.pending_depth(v.point)


@query("SELECT CAST(floor(second / 86400) AS BIGINT) AS day, count(*) AS requests, count(*) >= 200 AS over FROM request WHERE engine IN ('click', 'view', 'purchase') GROUP BY 1", "request")
def d8_group_quota(v):
    return U.group_quota(v.request, ["click", "view", "purchase"], 200)


@query("SELECT business_id, area_id, keyword, engine, scan_month, round(avg(rank), 4) AS avg_rank, min(rank) AS best, max(rank) AS worst FROM fact GROUP BY ALL", "fact")
def d11_rank_trend(v):
    return A.rank_trend(v.dealt("fact", "business_id", "keyword"))


@query("SELECT p.area_id, p.keyword, p.engine, p.scan_month, grid_row, grid_col, min(rank) AS rank FROM point p JOIN (SELECT area_id, keyword, engine, max(scan_month) AS m FROM point GROUP BY ALL) l ON p.area_id = l.area_id AND p.keyword = l.keyword AND p.engine = l.engine AND p.scan_month = l.m LEFT JOIN (SELECT point_id, rank FROM fact WHERE business_id = 7) f ON p.point_id = f.point_id GROUP BY ALL", "fact point")
def d12_geo_heatmap(v):
    return A.geo_heatmap(v.fact, v.point, 7)


_SOLV = "SELECT t.business_id, t.area_id, t.keyword, t.engine, top_points, points, round(100.0 * top_points / points, 4) AS solv FROM (SELECT business_id, area_id, keyword, engine, count(*) AS top_points FROM fact WHERE rank <= 3 AND point_id IN (SELECT point_id FROM point WHERE status = 'completed') GROUP BY ALL) t JOIN (SELECT area_id, keyword, engine, count(*) AS points FROM point WHERE status = 'completed' GROUP BY ALL) p ON t.area_id = p.area_id AND t.keyword = p.keyword AND t.engine = p.engine"


@query(f"SELECT *, CASE WHEN solv >= 70 THEN 'green' WHEN solv >= 40 THEN 'yellow' ELSE 'red' END AS gauge FROM ({_SOLV})", "fact point")
def d13_solv(v):
    return A.solv(v.fact, v.point, ["area_id", "keyword", "engine"])


@query("SELECT business_id, best, worst, count(*) FILTER (rank <= 3) AS top_points, round(avg(rank), 4) AS avg_rank, count(*) FILTER (rank = best) AS n_best, count(*) FILTER (rank = worst) AS n_worst FROM (SELECT *, min(rank) OVER (PARTITION BY business_id) AS best, max(rank) OVER (PARTITION BY business_id) AS worst FROM fact) GROUP BY business_id, best, worst", "fact")
def d14_quick_stats(v):
    return A.quick_stats(v.fact)


@query("SELECT engine, CASE WHEN rank <= 3 THEN '1-3' WHEN rank <= 7 THEN '4-7' WHEN rank <= 15 THEN '8-15' ELSE '16+' END AS band, count(*) AS points FROM fact GROUP BY ALL", "fact")
def d15_band_histogram(v):
    return A.band_histogram(v.fact)


@query("SELECT *, coalesce(greatest(e1, e2, e3, e4, e5) - least(e1, e2, e3, e4, e5) >= 1, FALSE) AS opportunity FROM (SELECT business_id, keyword, " + ", ".join(f"round(avg(rank) FILTER (engine = '{e}'), 4) AS e{e[0]}" for e in ENGINES) + " FROM fact GROUP BY business_id, keyword)", "fact")
def d16_cross_engine(v):
    return A.cross_engine(v.dealt("fact", "business_id", "keyword"), ENGINES)


@query("SELECT b.business_id, name, is_mine, avg_rank, keywords, areas, engines, reviews, rating FROM ranked b LEFT JOIN (SELECT business_id, round(avg(rank), 4) AS avg_rank, count(DISTINCT keyword) AS keywords, count(DISTINCT area_id) AS areas, count(DISTINCT engine) AS engines FROM fact GROUP BY business_id) f ON b.business_id = f.business_id WHERE is_mine OR is_competitor", "fact ranked")
def d17_competitor_comparison(v):
    return A.competitor_comparison(v.fact, v.ranked)


@query("SELECT area_id, keyword, count(*) AS businesses, round(avg(rating), 4) AS avg_rating, string_agg(CAST(business_id AS STRING), ',' ORDER BY nth) FILTER (nth <= 3) AS top FROM (SELECT m.*, reviews, rating, row_number() OVER (PARTITION BY m.area_id, keyword ORDER BY mean, reviews DESC, m.business_id) AS nth FROM (SELECT area_id, keyword, business_id, avg(rank) AS mean FROM fact GROUP BY ALL) m JOIN ranked b ON m.business_id = b.business_id) GROUP BY area_id, keyword", "fact ranked")
def d18_market_overview(v):
    return A.market_overview(v.dealt("fact", "business_id"), v.ranked)


@query("SELECT business_id, keyword, " + ", ".join(f"min(rank) FILTER (area_id = {a}) AS a{a}" for a in range(25)) + " FROM fact GROUP BY business_id, keyword", "fact")
def d19_keyword_area_matrix(v):
    return A.keyword_area_matrix(v.dealt("fact", "business_id", "keyword"), [r.area_id for r in v.area.select("area_id").orderBy("area_id").collect()])


@query("SELECT business_id, keyword, area_id, min(rank) AS rank FROM fact GROUP BY ALL", "fact")
def d19_keyword_area_ranks(v):
    return A.keyword_area_ranks(v.dealt("fact", "business_id", "keyword"))


@query("SELECT area_id, mine, theirs, CASE WHEN coalesce(mine, 0) < 40 AND coalesce(theirs, 0) < 40 THEN 'neither' WHEN coalesce(mine, 0) >= 40 AND coalesce(theirs, 0) >= 40 AND abs(coalesce(mine, 0) - coalesce(theirs, 0)) <= 10 THEN 'contested' WHEN coalesce(mine, 0) > coalesce(theirs, 0) THEN 'mine' ELSE 'competitor' END AS holder FROM (SELECT s.area_id, max(solv) FILTER (is_mine) AS mine, max(solv) FILTER (is_competitor) AS theirs FROM (SELECT t.area_id, business_id, round(100.0 * n / points, 4) AS solv FROM (SELECT area_id, business_id, count(*) AS n FROM fact WHERE rank <= 3 AND point_id IN (SELECT point_id FROM point WHERE status = 'completed') GROUP BY ALL) t JOIN (SELECT area_id, count(*) AS points FROM point WHERE status = 'completed' GROUP BY area_id) p ON t.area_id = p.area_id) s JOIN ranked b ON s.business_id = b.business_id GROUP BY s.area_id)", "fact point ranked")
def d20_geo_dominance(v):
    return A.geo_dominance(v.fact, v.point, v.ranked)


@query("SELECT business_id, keyword, areas, round(hi - lo, 4) AS gap, CASE WHEN hi - lo >= 10 THEN 'high' WHEN hi - lo >= 5 THEN 'medium' ELSE 'low' END AS opportunity FROM (SELECT business_id, keyword, count(*) AS areas, min(mean) AS lo, max(mean) AS hi FROM (SELECT business_id, keyword, area_id, avg(rank) AS mean FROM fact GROUP BY ALL) GROUP BY ALL) WHERE areas > 1", "fact")
def d21_geo_gap(v):
    return A.geo_gap(v.dealt("fact", "business_id", "keyword"))


_DELTA = "SELECT snapshot_id, business_id, source, captured, review_count - lag(review_count) OVER (PARTITION BY business_id, source ORDER BY captured, snapshot_id) AS delta FROM review"


@query(f"SELECT business_id, CAST(year(make_timestamp(captured * 1000000)) * 12 + month(make_timestamp(captured * 1000000)) AS INT) AS month, sum(delta)::BIGINT AS gained FROM ({_DELTA}) WHERE delta > 0 GROUP BY 1, 2", "review")
def d22_reviews_per_period(v):
    return A.reviews_per_month(v.review)


@query("SELECT business_id, count(*) FILTER (result_type = 'ads') AS ads, count(*) AS results FROM ranking GROUP BY business_id", "ranking")
def d23_ad_signal(v):
    return A.ad_signal(v.ranking)


@query("SELECT business_id, n AS filled, CASE WHEN n = 4 THEN 'complete' ELSE 'partial' END AS profile FROM (SELECT business_id, (phone IS NOT NULL)::INT + (website IS NOT NULL)::INT + (email IS NOT NULL)::INT + (rating IS NOT NULL)::INT AS n FROM business)", "business")
def d24_profile_completeness(v):
    return A.profile_completeness(v.business, ["phone", "website", "email", "rating"])


@query(f"SELECT engine, count(*) * 49 AS tasks, round(count(*) * 49 * CASE engine WHEN '1-URGENT' THEN 13.0 ELSE 2.0 END / 3600, 4)::DOUBLE AS hours, CAST(ceil(count(*) * 49 / CASE engine WHEN '1-URGENT' THEN 200 ELSE 900 END) AS BIGINT) AS days FROM ({_PLAN}) GROUP BY engine", "area category keyword")
def d26_estimate_plan(v):
    return P.estimate_plan(_plan(v), {"1-URGENT": (13.0, 200), "2-HIGH": (2.0, 900)})


@query("SELECT *, CASE WHEN blocked > 0 THEN 'blocked' WHEN in_hour >= 40 OR in_day >= 200 THEN 'throttled' ELSE 'healthy' END AS state FROM (SELECT engine, hour, in_hour, blocked, sum(in_hour) OVER (PARTITION BY engine, floor(hour / 24))::BIGINT AS in_day FROM (SELECT engine, CAST(floor(second / 3600) AS BIGINT) AS hour, count(*) AS in_hour, count(*) FILTER (outcome = 'blocked') AS blocked FROM request GROUP BY 1, 2))", "request")
def d27_usage(v):
    return U.usage(v.request, 40, 200)


_BLOCKS = "WITH RECURSIVE b AS (SELECT engine, second, row_number() OVER (PARTITION BY engine ORDER BY second, request_id) AS k FROM request WHERE outcome = 'blocked'), walk AS (SELECT engine, k, second, second AS start, 1 AS nth FROM b WHERE k = 1 UNION ALL SELECT b.engine, b.k, b.second, CASE WHEN b.second - w.start >= 86400 THEN b.second ELSE w.start END, CASE WHEN b.second - w.start >= 86400 THEN 1 ELSE w.nth + 1 END FROM walk w JOIN b ON b.engine = w.engine AND b.k = w.k + 1) SELECT engine, max(second + CASE nth WHEN 1 THEN 15 WHEN 2 THEN 120 ELSE 1440 END * 60) AS blocked_until FROM walk GROUP BY engine"
#: Requests name other engines than points; these five stand for each other.
_SAME = {"1-URGENT": "click", "2-HIGH": "view", "3-MEDIUM": "purchase", "4-NOT SPECIFIED": "signup", "5-LOW": "error"}


@query(f"SELECT r.*, blocked_until, coalesce(depth, 0) AS depth FROM (SELECT engine, count(*) AS requests, count(*) FILTER (outcome = 'error') AS errors, count(*) FILTER (outcome = 'blocked') AS blocks, max(second) AS last FROM request GROUP BY engine) r LEFT JOIN ({_BLOCKS}) u ON r.engine = u.engine LEFT JOIN (SELECT CASE engine {' '.join(f"WHEN '{k}' THEN '{x}'" for k, x in _SAME.items())} END AS engine, count(*) AS depth FROM point WHERE status = 'pending' GROUP BY 1) d ON r.engine = d.engine", "request point")
def d28_engine_status(v):
    named = F.create_map(*(F.lit(x) for kv in _SAME.items() for x in kv))
    return U.engine_status(v.request, P.pending_depth(v.point.withColumn("engine", named[F.col("engine")])))


@query("SELECT business_id, " + ", ".join(f"bool_or(engine = '{e}') AS has{e[0]}" for e in ENGINES) + " FROM fact GROUP BY business_id", "fact")
def d29_source_badges(v):
    return A.source_badges(v.fact, ENGINES)


# --- order


@query("SELECT point_id, business_id, rank, row_number() OVER (PARTITION BY point_id ORDER BY rank, business_id) AS position FROM fact", "fact")
def e1_assign_rank(v):
    return v.fact.select("point_id", "business_id", "rank", F.row_number().over(Window.partitionBy("point_id").orderBy("rank", "business_id")).alias("position"))


@query("SELECT point_id, business_id, min(rank) AS rank FROM ranking GROUP BY point_id, business_id", "ranking")
def e2_best_ranks(v):
    return A.best_ranks(v.ranking)


@query("SELECT business_id, source, snapshot_id, rating, review_count FROM review QUALIFY row_number() OVER (PARTITION BY business_id, source ORDER BY captured DESC, snapshot_id DESC) = 1", "review")
def e4_latest_reviews(v):
    return A.latest_reviews(v.review)


@query(_DELTA, "review")
def e5_review_deltas(v):
    return A.review_deltas(v.review)


@query("SELECT business_id, rate, CASE WHEN rate > 5 THEN 'accelerating' WHEN rate >= 1 THEN 'stable' WHEN rate = 0 AND captured - first >= 7776000 THEN 'stale' ELSE 'slowing' END AS velocity FROM (SELECT *, round((review_count - least_) / 3.0, 4)::DOUBLE AS rate FROM (SELECT *, min(review_count) OVER (PARTITION BY business_id ORDER BY captured RANGE BETWEEN 7776000 PRECEDING AND CURRENT ROW) AS least_, min(captured) OVER (PARTITION BY business_id) AS first, row_number() OVER (PARTITION BY business_id ORDER BY captured DESC, snapshot_id DESC) AS nth FROM review) WHERE nth = 1)", "review")
def e6_review_velocity(v):
    return A.review_velocity(v.review)


@query("SELECT business_id, scans, round(new - old, 4) AS move, CASE WHEN new - old < -0.5 THEN 'rising' WHEN new - old > 0.5 THEN 'falling' ELSE 'stable' END AS momentum FROM (SELECT business_id, count(*) AS scans, arg_max(mean, scan_month) AS new, arg_min(mean, scan_month) AS old FROM (SELECT *, row_number() OVER (PARTITION BY business_id ORDER BY scan_month DESC) AS nth FROM (SELECT business_id, scan_month, avg(rank) AS mean FROM fact GROUP BY ALL)) WHERE nth <= 3 GROUP BY business_id)", "fact")
def e7_ranking_momentum(v):
    return A.ranking_momentum(v.fact)


@query("SELECT area_id, keyword, engine, max(scan_month) FILTER (nth = 1) AS latest, max(scan_month) FILTER (nth = 2) AS previous FROM (SELECT *, row_number() OVER (PARTITION BY area_id, keyword, engine ORDER BY scan_month DESC) AS nth FROM (SELECT DISTINCT area_id, keyword, engine, scan_month FROM point)) GROUP BY ALL", "point")
def e8_latest_scan(v):
    return A.latest_scan(v.point)


@query("SELECT area_id, business_id, round(mean, 4) AS avg_rank, nth FROM (SELECT m.*, row_number() OVER (PARTITION BY m.area_id ORDER BY mean, reviews DESC NULLS LAST, m.business_id) AS nth FROM (SELECT area_id, business_id, avg(rank) AS mean FROM fact GROUP BY ALL) m LEFT JOIN ranked b ON m.business_id = b.business_id) WHERE nth <= 5", "fact ranked")
def e9_top_k(v):
    return A.top_k(v.fact, v.ranked)


@query("SELECT business_id, keyword, engine, scan_month, round(change, 4) AS change FROM (SELECT *, mean - lag(mean) OVER (PARTITION BY business_id, keyword, engine ORDER BY scan_month) AS change FROM (SELECT business_id, keyword, engine, scan_month, avg(rank) AS mean FROM fact GROUP BY ALL)) WHERE abs(change) >= 3", "fact")
def e10_rank_alerts(v):
    return A.rank_alerts(v.dealt("fact", "business_id", "keyword", "engine"))


@query("SELECT request_id, engine, streak, CASE WHEN streak > 0 THEN least(1000 * pow(2.0, streak), 300000.0)::BIGINT ELSE 0 END AS backoff_ms FROM (SELECT *, sum((outcome <> 'ok')::INT) OVER (PARTITION BY engine, island ORDER BY second, request_id)::BIGINT AS streak FROM (SELECT *, sum((outcome = 'ok')::INT) OVER (PARTITION BY engine ORDER BY second, request_id RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM request))", "request")
def e14_error_streaks(v):
    return U.error_streaks(v.request)


@query("SELECT business_id, engine, scan_month, CASE WHEN move < 0 THEN 'up' WHEN move > 0 THEN 'down' WHEN move = 0 THEN 'flat' END AS arrow FROM (SELECT *, round(mean - lag(mean) OVER (PARTITION BY business_id, engine ORDER BY scan_month), 6) AS move FROM (SELECT business_id, engine, scan_month, avg(rank) AS mean FROM fact GROUP BY ALL))", "fact")
def e15_trend_arrow(v):
    return A.trend_arrow(v.dealt("fact", "business_id", "engine"))


@query("SELECT point_id, string_agg(CAST(business_id AS STRING), ',' ORDER BY nth) AS leaders FROM (SELECT *, row_number() OVER (PARTITION BY point_id ORDER BY rank, business_id) AS nth FROM fact) WHERE nth <= 3 GROUP BY point_id", "fact")
def e16_point_leaders(v):
    return A.point_leaders(v.fact)


@query("SELECT business_id, engine, keyword, scan_month, avg_rank FROM (SELECT *, row_number() OVER (PARTITION BY business_id, engine, keyword ORDER BY scan_month DESC) AS nth FROM (SELECT business_id, engine, keyword, scan_month, round(avg(rank), 4) AS avg_rank FROM fact GROUP BY ALL)) WHERE nth = 1", "fact")
def e17_latest_ranks(v):
    return A.latest_ranks(v.dealt("fact", "business_id", "keyword", "engine"))


@query("SELECT business_id, name, last_seen FROM business ORDER BY last_seen DESC, business_id LIMIT 20 OFFSET 40", "business")
def f6_page(v):
    return C.page(v.business, 3, 20, [F.desc("last_seen"), F.col("business_id")]).select("business_id", "name", "last_seen")


@query(f"SELECT area_id, slug, keyword, engine, row_number() OVER (PARTITION BY engine ORDER BY priority DESC, area_id, slug, keyword) AS turn FROM ({_PLAN})", "area category keyword")
def f8_queue_order(v):
    return P.queue_order(_plan(v)).select("area_id", "slug", "keyword", "engine", "turn")


@query("SELECT keyword FROM fact WHERE business_id = 3 INTERSECT SELECT keyword FROM fact WHERE business_id = 13", "fact")
def g5_keyword_sets(v):
    return v.fact.filter("business_id = 3").select("keyword").intersect(v.fact.filter("business_id = 13").select("keyword"))


# --- scalars over the tables


@query(r"SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(lower(text), '\b(llc|inc|corp|ltd|co|company|corporation|incorporated|limited)\b', '', 'g'), '[^a-z0-9_\t\n\x0B\f\r ]', '', 'g'), '[\t\n\x0B\f\r ]+', ' ', 'g')) AS name FROM documents")
def h1_normalize_name(v):
    return v.documents.select("doc_id", S.normalize_name(F.col("text")).alias("name"))


@query(r"SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(lower(text), '\b(llc|inc|corp|ltd|co|company|corporation|incorporated|limited)\b', '', 'g'), '[^a-z0-9_\t\n\x0B\f\r ]', '', 'g'), '[\t\n\x0B\f\r ]+', ' ', 'g')) AS name FROM documents")
def h1_normalize_whole(v):
    return v.documents.select("doc_id", S.normalize_name(F.col("text")).alias("name"))


@query("SELECT business_id, '+1' || phone AS e164, '(' || substr(phone, 1, 3) || ') ' || substr(phone, 4, 3) || '-' || substr(phone, 7) AS shown FROM business", "business")
def h4_phones(v):
    e164 = S.normalize_phone(F.col("phone"))
    return v.business.select("business_id", e164.alias("e164"), S.format_phone(e164).alias("shown"))


@query("SELECT a.area_id, b.area_id AS other, round(2 * 3958.8 * atan2(sqrt(h), sqrt(1 - h)), 4) AS miles FROM area a JOIN area b ON a.area_id + 1 = b.area_id, LATERAL (SELECT pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lng - a.lng) / 2), 2) AS h)", "area")
def h6_haversine(v):
    other = v.area.select((F.col("area_id") - 1).alias("area_id"), F.col("area_id").alias("other"), F.col("lat").alias("lat2"), F.col("lng").alias("lng2"))
    return v.area.join(other, "area_id").select("area_id", "other", F.round(S.haversine_miles(F.col("lat"), F.col("lng"), F.col("lat2"), F.col("lng2")), 4).alias("miles"))


@query(r"SELECT doc_id, CASE WHEN length(d) = 10 THEN '+1' || d END AS phone FROM (SELECT doc_id, regexp_replace(regexp_extract(text, '\(?\d{3}\)?[\s.-]?\d{3}[\s.-]?\d{4}'), '[^0-9]', '', 'g') AS d FROM documents)")
def h13_us_phone(v):
    return v.documents.select("doc_id", S.us_phone(F.col("text")).alias("phone"))


@query(r"SELECT doc_id, array_to_string(list_transform(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}'), lambda x: lower(x)), ',') AS emails FROM documents")
def h19_emails(v):
    return v.documents.select("doc_id", F.array_join(S.emails_in(F.col("text")), ",").alias("emails"))


@query()
def j2_rate_audit(v):
    return U.rate_audit(v.request)


@query()
def j5_block_episodes(v):
    return U.block_episodes(v.request)


# --- resolution, extraction, streams


def _observations(v):
    """Businesses, a fifth with a place id, and copies of half of them that are seen later under a longer name and a slightly moved place."""
    b = v.business.select(F.col("business_id").alias("obs_id"), F.lit(0).cast("long").alias("observed_at"), "name", F.when(F.col("business_id") % 5 == 0, F.concat(F.lit("place"), "business_id")).alias("place_id"), "phone", "website", "city", "lat", "lng", "rating", F.col("reviews").alias("review_count"), F.lit("maps").alias("source"))
    copies = b.filter("obs_id % 2 = 0").withColumns({"obs_id": F.col("obs_id") + 1_000_000_000, "observed_at": F.lit(1).cast("long"), "name": F.concat("name", F.lit(" LLC")), "lat": F.col("lat") + 0.0001, "phone": F.when(F.col("obs_id") % 3 > 0, F.col("phone")), "source": F.lit("bing")})
    return b.unionByName(copies)


@query()
def i9_resolve_entities(v):
    from rankatlas.operators.resolve import resolve_entities

    return resolve_entities(_observations(v))


@query()
def i9_resolve_strict(v):
    from rankatlas.operators.resolve import resolve_entities

    return resolve_entities(_observations(v), phone_requires_name=True)


@query("SELECT business_id % 400 AS entity, arg_min(name, business_id) AS name, arg_max(phone, business_id) FILTER (phone IS NOT NULL) AS phone, arg_max(website, business_id) FILTER (website IS NOT NULL) AS website, arg_max(rating, business_id) FILTER (rating IS NOT NULL) AS rating, arg_max(reviews, business_id) FILTER (rating IS NOT NULL) AS reviews, max(business_id) AS last_seen FROM business GROUP BY 1", "business")
def e12_survive(v):
    from rankatlas.operators.resolve import survive

    seen = v.business.select((F.col("business_id") % 400).alias("entity"), F.col("business_id").alias("obs_id"), F.col("business_id").alias("observed_at"), "name", "phone", "website", "rating", "reviews")
    return survive(seen, ["name"], ["phone", "website"], {"review": ["rating", "reviews"]}, key="entity")


@query()
def i1_harvest_emails(v):
    from rankatlas.operators.extract import harvest_emails

    return harvest_emails(v.pages).select("page_id", F.array_join("emails", ",").alias("emails"))


@query()
def i2_contact_links(v):
    from rankatlas.operators.extract import contact_links

    return contact_links(v.pages).select("url", "target", "nth")


@query()
def i4_extract_listings(v):
    from rankatlas.operators.extract import extract_listings

    return extract_listings(v.pages.select("page_id", "html"), r"(?s)<h[1-3][^>]*>(.*?)</h[1-3]>", {"link": r"href=\"([^\"]+)\"", "first_paragraph": r"(?s)<p>(.*?)</p>"})


@query("SELECT page_id, CASE WHEN length(html) = 0 THEN 'none' WHEN starts_with(url, 'https://') AND regexp_matches(lower(html), '<meta[^>]*viewport') THEN 'modern' ELSE 'outdated' END AS website_quality FROM pages")
def i12_website_quality(v):
    from rankatlas.operators.extract import website_quality

    return website_quality(v.pages).select("page_id", "website_quality")


@query("SELECT CAST(floor(second / 3600) AS BIGINT) AS hour, engine, count(*) AS requests, count(*) FILTER (outcome = 'error') AS errors FROM request GROUP BY 1, 2", "request")
def j3_quota_stream(v):
    from rankatlas.streaming.streams import quota_stream, read_stream, run_once

    log = read_stream(v.spark, v.sf_dir, "events").select("ts", F.col("event_type").alias("engine"), F.when((F.col("event_type") == "error") | (F.col("event_id") % 11 == 0), "error").when(F.col("event_id") % 17 == 0, "blocked").otherwise("ok").alias("outcome"))
    out = run_once(quota_stream(log))
    return out.select(F.floor(F.unix_timestamp("window.start") / 3600).alias("hour"), "engine", "requests", "errors")


@query("SELECT CAST(floor(second / 86400) AS BIGINT) AS day, count(*) AS requests FROM request WHERE engine IN ('click', 'view') GROUP BY 1", "request")
def j4_group_quota_stream(v):
    from rankatlas.streaming.streams import group_quota_stream, read_stream, run_once

    log = read_stream(v.spark, v.sf_dir, "events").select("ts", F.col("event_type").alias("engine"))
    return run_once(group_quota_stream(log, ["click", "view"])).select(F.floor(F.unix_timestamp("window.start") / 86400).alias("day"), "requests")


@query("SELECT o_orderpriority AS engine, count(*) AS points_total, count(*) FILTER (o_orderstatus = 'F') AS points_done FROM orders GROUP BY 1")
def j6_progress_stream(v):
    from rankatlas.streaming.streams import progress_stream, read_stream, run_once

    points = read_stream(v.spark, v.sf_dir, "orders").select(F.col("o_orderpriority").alias("engine"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("pending").alias("status"))
    return run_once(progress_stream(points, ["engine"]))


@query("SELECT user_id AS business_id, year(ts) * 12 + month(ts) AS month, count(*) AS snapshots FROM events WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 7 DAY FROM events) GROUP BY 1, 2")
def j9_review_months_stream(v):
    from rankatlas.streaming.streams import read_stream, review_days_stream, review_months, run_once

    rows = read_stream(v.spark, v.sf_dir, "events").select("ts", F.col("user_id").alias("business_id"))
    return review_months(run_once(review_days_stream(rows), "append"))


# --- more of plans and metrics


@query("SELECT schedule_id, a.area_id FROM (SELECT * FROM schedule WHERE schedule_id % 2 = 0) CROSS JOIN (SELECT area_id FROM area WHERE is_active) a UNION ALL SELECT schedule_id, unnest([schedule_id, 1]) FROM schedule WHERE schedule_id % 2 = 1", "schedule area")
def c9_expand_schedules(v):
    lists = v.schedule.withColumn("area_ids", F.when(F.col("schedule_id") % 2 == 1, F.array(F.col("schedule_id"), F.lit(1))).otherwise(F.array().cast("array<int>")))
    return P.expand_schedules(lists, v.area)


@query("SELECT area_id, engine, CASE WHEN d > 0 THEN round(100 + 50.0 / d * t, 4) END AS eta FROM (SELECT area_id, engine, count(*) FILTER (status = 'completed') AS d, count(*) AS t FROM point GROUP BY ALL)", "point")
def d6_eta(v):
    progress = P.scan_progress(v.point, ["area_id", "engine"])
    return P.eta(progress, F.lit(100.0), F.lit(150.0)).select("area_id", "engine", F.round("eta", 4).alias("eta"))


@query("SELECT count(*) AS total, count(*) FILTER (email IS NOT NULL AND website IS NOT NULL AND business_id % 13 <> 5) AS enriched, count(*) FILTER (email IS NULL AND website IS NOT NULL AND business_id % 13 <> 5) AS processed_without, count(*) FILTER (website IS NULL) AS skipped, count(*) FILTER (business_id % 13 = 5 AND website IS NOT NULL) AS failed, string_agg(DISTINCT email, ',' ORDER BY email) AS emails FROM business", "business")
def d9_enrichment_summary(v):
    status = F.when(F.col("website").isNull(), "no_website").when(F.col("business_id") % 13 == 5, "error").when(F.col("email").isNull(), "no_email_found").otherwise("success")
    return A.enrichment_summary(v.business.withColumn("status", status))


@query()
def d25_discovery_stats(v):
    from rankatlas.operators.resolve import resolve_entities

    return A.discovery_stats(resolve_entities(_observations(v)))


@query("SELECT business_id, concat_ws(',', CASE WHEN reviews < 50 THEN 'few_reviews' END, CASE WHEN website IS NULL THEN 'no_https' END, CASE WHEN phone IS NULL THEN 'no_phone' END, CASE WHEN last_seen < 500 THEN 'stale' END) AS weaknesses FROM business", "business")
def d30_weaknesses(v):
    return A.weaknesses(v.business)


@query("SELECT count(*) FILTER (left_ = n) AS pending, count(*) FILTER (left_ BETWEEN 1 AND n - 1) AS running, count(*) FILTER (left_ = 0 AND scan_month = 23970) AS completed_today FROM (SELECT area_id, engine, keyword, scan_month, count(*) AS n, count(*) FILTER (status = 'pending') AS left_ FROM point GROUP BY ALL)", "point")
def d31_scan_counts(v):
    left = F.count_if(F.col("status") == "pending")
    scans = v.point.groupBy("area_id", "engine", "keyword", F.col("scan_month").alias("day")).agg(F.when(left == F.count("*"), "pending").when(left > 0, "running").otherwise("completed").alias("status"))
    return P.scan_counts(scans, F.lit(23970))


@query("SELECT business_id, CASE WHEN is_mine THEN 1 WHEN is_competitor THEN 2 WHEN business_id IN (SELECT business_id FROM fact WHERE rank <= 5) THEN 3 WHEN enriched_hours IS NULL THEN 4 WHEN enriched_hours > 300 THEN 5 ELSE 6 END AS tier FROM business", "business fact")
def i11_enrichment_priority(v):
    return A.enrichment_priority(v.business, v.fact, 300)


@query("SELECT page_id, CASE WHEN url LIKE 'https://%' THEN regexp_extract(lower(url), '^https://(www\\.)?([^/?#:]+)', 2) ELSE regexp_extract(lower(url), '^http://(www\\.)?([^/?#:]+)', 2) END AS domain FROM pages")
def h2_normalize_domain(v):
    return v.pages.select("page_id", S.normalize_domain(F.col("url")).alias("domain"))


@query("SELECT a.business_id, b.business_id AS other, levenshtein(a.name, b.name) <= 3 AS close FROM business a JOIN business b ON b.business_id = a.business_id * 3 + 7", "business")
def h3_levenshtein(v):
    b = v.business.select(F.col("business_id").alias("other"), F.col("name").alias("name2"))
    return v.business.join(b, F.col("other") == F.col("business_id") * 3 + 7).select("business_id", "other", S.names_close(F.col("name"), F.col("name2")).alias("close"))


@query("SELECT business_id, CASE WHEN reviews % 3 = 0 THEN reviews * 100 WHEN reviews % 3 = 1 THEN reviews END AS n FROM business", "business")
def h9_compact_number(v):
    text = F.when(F.col("reviews") % 3 == 0, F.concat((F.col("reviews") / 10).cast("string"), F.lit("K"))).when(F.col("reviews") % 3 == 1, F.format_number("reviews", 0)).otherwise("n/a")
    return v.business.select("business_id", S.compact_number(text).alias("n"))


@query("SELECT business_id, coalesce(email IS NOT NULL AND NOT (business_id % 2 = 0), FALSE) AS valid FROM business", "business")
def h18_email_valid(v):
    mail = F.when(F.col("business_id") % 2 == 0, F.regexp_replace("email", "^info@", "noreply@")).otherwise(F.col("email"))
    return v.business.select("business_id", S.email_valid(mail).alias("valid"))
