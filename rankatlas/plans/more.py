"""More queries of the ranking library: lookups, orders, scalars, extraction from built pages, ingest and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankatlas.functions import scalars as S
from rankatlas.operators import analytics as A
from rankatlas.operators import audit as U
from rankatlas.operators import catalog as C
from rankatlas.operators import extract as X
from rankatlas.operators import planning as P
from rankatlas.operators import resolve as R
from rankatlas.plans.catalogue import ENGINES, _observations, _plan, query
from rankatlas.sources import tables as T

# --- sources


@query("SELECT business_id AS obs_id, 1 AS position, name, phone, CASE WHEN business_id % 3 > 0 THEN city END AS city FROM business WHERE business_id % 2 = 0 UNION ALL SELECT business_id, NULL, NULL, NULL, NULL FROM business WHERE business_id % 2 = 1", "business")
def a2_api_places(v):
    """Responses with one place each, or none."""
    place = F.struct("name", "phone", F.struct(F.when(F.col("business_id") % 3 > 0, F.col("city")).alias("addressLocality")).alias("address"))
    body = F.when(F.col("business_id") % 2 == 0, F.to_json(F.struct(F.struct(F.array(place).alias("value")).alias("places")))).otherwise(F.lit("{}"))
    places, _ = T.read_api_results(v.business.select(F.col("business_id").alias("obs_id"), body.alias("body")))
    return places.select("obs_id", "position", "name", "phone", F.col("address.addressLocality").alias("city"))


@query("SELECT a.area_id, k.category, k.keyword, k.priority FROM area a CROSS JOIN (SELECT category, keyword, priority FROM keyword) k WHERE a.area_id < 3 AND k.category LIKE 'PROMO/%'", "area keyword")
def a4_seed_plan(v):
    """Seeded keywords of a tree that is built from the tables: each list's order is its priority."""
    lists = v.keyword.filter(F.col("category").startswith("PROMO/")).groupBy("category").agg(F.sort_array(F.collect_list(F.struct("priority", "keyword")), asc=False).alias("k"))
    words = lists.select("category", F.explode("k").alias("k")).select("category", "k.keyword", "k.priority")
    return v.area.filter("area_id < 3").select("area_id").crossJoin(words)


@query("SELECT business_id, name, CASE WHEN rating IS NULL THEN 'rating: must be from 1 to 5' ELSE '' END || CASE WHEN rating IS NULL AND phone IS NULL THEN ', ' ELSE '' END || CASE WHEN phone IS NULL THEN 'phone: must have 9 to 50 characters' ELSE '' END AS errors FROM business WHERE rating IS NULL OR phone IS NULL", "business")
def a8_rejected(v):
    rules = {"rating": C.rule(F.col("rating"), "int", 1, 5), "phone": C.rule(F.col("phone"), "length", 9, 50), "name": C.rule(F.col("name"), "nonempty"), "state": C.rule(F.col("state"), "enum", "FL", "GA")}
    return C.validate(v.business, rules)[1].select("business_id", "name", "errors")


@query("SELECT 'orders.o_custkey' AS key, CAST(o_custkey AS VARCHAR) AS value, count(*) AS violations FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 7 <> 3) GROUP BY o_custkey UNION ALL SELECT 'customer.c_nationkey', CAST(c_nationkey AS VARCHAR), count(*) FROM customer WHERE c_custkey % 7 <> 3 AND c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_nationkey <> 8) GROUP BY c_nationkey")
def a10_all_fk_violations(v):
    tables = {"orders": v.orders, "customer": v.customer.filter("c_custkey % 7 <> 3"), "nation": v.nation.filter("n_nationkey <> 8")}
    return C.all_fk_violations(tables, [("orders", "o_custkey", "customer", "c_custkey"), ("customer", "c_nationkey", "nation", "n_nationkey")])


@query("SELECT business_id, CASE WHEN category IN ('MACHINERY', 'BUILDING') THEN NULL ELSE category END AS category FROM business", "business")
def a12_set_null(v):
    gone = v.business.filter("category IN ('MACHINERY', 'BUILDING')").select(F.col("category").alias("slug")).distinct()
    return C.set_null(v.business.select("business_id", "category"), "category", gone, "slug")


@query("SELECT count(*) AS total, 3 AS page, 20 AS limit_, CAST(ceil(count(*) / 20.0) AS BIGINT) AS total_pages, (SELECT string_agg(business_id, ',' ORDER BY business_id) FROM (SELECT business_id FROM business WHERE is_active ORDER BY business_id LIMIT 20 OFFSET 40)) AS ids FROM business WHERE is_active", "business")
def a14_page_envelope(v):
    out = T.page_envelope(C.active(v.business).select("business_id"), 3, 20, [F.col("business_id")])
    ids = F.array_join(F.transform(F.from_json("data", "array<struct<business_id:long>>"), lambda x: x["business_id"].cast("string")), ",")
    return out.select("total", "page", F.col("limit").alias("limit_"), "total_pages", ids.alias("ids"))


# --- filters, lookups, orders


@query("SELECT business_id, state FROM business WHERE is_active AND state = 'FL' AND is_competitor", "business")
def b2_state(v):
    return C.filter_businesses(v.business, state="FL", is_competitor=True).select("business_id", "state")


@query("SELECT business_id, name FROM business WHERE is_active AND is_competitor", "business")
def b7_competitors(v):
    return C.filter_businesses(v.business, is_competitor=True).select("business_id", "name")


@query("SELECT business_id, name FROM business WHERE business_id = 77", "business")
def b10_by_id(v):
    return C.by_id(v.business, "business_id", 77).select("business_id", "name")


@query("SELECT business_id, name FROM business WHERE business_id IN (SELECT business_id FROM ranking WHERE result_type = 'ads') AND category IN ('MACHINERY', 'BUILDING')", "business ranking")
def b11_in_ids(v):
    named = C.in_ids(v.business, "category", ["MACHINERY", "BUILDING"])
    return C.project(C.in_ids(named, "business_id", v.ranking.filter("result_type = 'ads'")), ["business_id", "name"])


@query("SELECT business_id, enriched_hours FROM business WHERE is_active AND website IS NOT NULL AND (enriched_hours IS NULL OR enriched_hours > 100) AND category IN ('MACHINERY') AND business_id IN (SELECT o_custkey FROM orders) ORDER BY enriched_hours DESC NULLS FIRST, business_id LIMIT 500", "business")
def b12_chosen_candidates(v):
    return C.enrichment_candidates(v.business, 100, only_missing=False, ids=v.orders.select(F.col("o_custkey").alias("business_id")), categories=["MACHINERY"]).select("business_id", "enriched_hours")


@query("SELECT business_id, name, email FROM business", "business")
def b13_project(v):
    return C.project(v.business, ["business_id", "name", "email"])


@query("SELECT schedule_id, name, schedule_id IN (SELECT area_id FROM area WHERE is_active) AS is_running FROM schedule", "schedule area")
def b20_with_flag(v):
    return C.with_flag(v.schedule, C.active(v.area).select(F.col("area_id").alias("schedule_id")), "schedule_id", "is_running").select("schedule_id", "name", "is_running")


@query("SELECT schedule_id, created FROM schedule ORDER BY created DESC, schedule_id", "schedule")
def f1_newest(v):
    return C.newest(v.schedule, "created", "schedule_id").select("schedule_id", "created")


@query("SELECT business_id, last_seen FROM business ORDER BY last_seen DESC, business_id", "business")
def f2_last_seen_first(v):
    return C.last_seen_first(v.business).select("business_id", "last_seen")


@query("SELECT area_id, area FROM area ORDER BY area, area_id", "area")
def f3_by_name(v):
    return C.by_name(v.area, "area_id", "area").select("area_id", "area")


@query("SELECT point_id, grid_row, grid_col FROM point WHERE area_id = 3 ORDER BY grid_row, grid_col, point_id", "point")
def f4_ordered_points(v):
    return C.ordered_points(C.filter_scans(v.point, area=3)).select("point_id", "grid_row", "grid_col")


@query("SELECT business_id, last_seen FROM business WHERE last_seen < 500 OR (last_seen = 500 AND business_id > 40) ORDER BY last_seen DESC, business_id LIMIT 20", "business")
def f6_page_after(v):
    return C.page_after(v.business, 20, "last_seen", "business_id", (500, 40)).select("business_id", "last_seen")


@query("SELECT DISTINCT business_id FROM business WHERE business_id NOT IN (SELECT business_id FROM ranking)", "business ranking")
def g3_remaining(v):
    return C.remaining(v.business, v.ranking, "business_id")


@query("SELECT business_id, coalesce(phone, website, 'none') AS first FROM business", "business")
def g2_first_non_empty(v):
    some = lambda c: F.filter(F.array(F.col(c)), lambda x: x.isNotNull())
    return v.business.select("business_id", A.first_non_empty(some("phone"), some("website"), F.array(F.lit("none")))[0].alias("first"))


# --- joins and metrics


@query("SELECT p.point_id, a.area, c.category, parent FROM (SELECT *, 'PROMO' || CASE WHEN point_id % 3 = 0 THEN '/Brand#5' WHEN point_id % 3 = 1 THEN '' ELSE '/none' END AS category FROM point) p LEFT JOIN area a ON p.area_id = a.area_id LEFT JOIN (SELECT slug AS category, parent, slug FROM category) c ON p.category = c.slug".replace("c.category, parent", "p.category, parent"), "point area category")
def c1_scans_with_category(v):
    kind = F.concat(F.lit("PROMO"), F.when(F.col("point_id") % 3 == 0, "/Brand#5").when(F.col("point_id") % 3 == 1, "").otherwise("/none"))
    return C.scans_with_dims(v.point.withColumn("category", kind), v.area, v.category).select("point_id", "area", "category", "parent")


_PARTS = "SELECT p_partkey AS business_id, p_type || '/' || p_brand AS category FROM part"


@query(f"SELECT b.business_id, b.category, c.parent AS category_parent, c.is_active AS category_active FROM ({_PARTS}) b LEFT JOIN category c ON b.category = c.slug", "category")
def c2_parts_with_category(v):
    parts = v.part.select(F.col("p_partkey").alias("business_id"), F.concat_ws("/", "p_type", "p_brand").alias("category"))
    return C.businesses_with_category(parts, v.category).select("business_id", "category", "category_parent", "category_active")


@query("SELECT f.point_id, f.rank, f.business_id, name, row_number() OVER (PARTITION BY f.point_id ORDER BY f.rank, f.business_id) AS nth FROM fact f JOIN ranked b ON f.business_id = b.business_id", "fact ranked")
def c4_scan_result_rows(v):
    """The JSON documents of scan_results(), read back row by row."""
    parsed = F.from_json("results", "array<struct<rank:int,business_id:long,name:string>>")
    rows = C.scan_results(v.fact, v.point, v.ranked).select("point_id", F.posexplode(parsed).alias("nth", "r"))
    return rows.select("point_id", "r.rank", "r.business_id", "r.name", (F.col("nth") + 1).alias("nth"))


@query(f"SELECT c.slug, coalesce(n, 0) AS n_businesses FROM category c LEFT JOIN (SELECT category, count(*) AS n FROM ({_PARTS}) GROUP BY category) b ON c.slug = b.category", "category")
def c5_category_businesses(v):
    parts = v.part.select(F.col("p_partkey").alias("business_id"), F.concat_ws("/", "p_type", "p_brand").alias("category"))
    return C.category_overview(v.category, v.keyword, parts).select("slug", "n_businesses")


@query("SELECT area_id, engine, scan_month FROM point GROUP BY ALL HAVING count(*) FILTER (status = 'pending') = 0", "point")
def c16_completed_scans(v):
    return P.recovery_plan(v.point, ["area_id", "engine", "scan_month"])[1]


@query("SELECT area_id, engine, scan_month, CASE WHEN d >= t THEN 'completed' WHEN d + f = t THEN 'failed' WHEN scan_month < 23960 THEN 'failed' ELSE 'running' END AS new_status FROM (SELECT area_id, engine, scan_month, count(*) FILTER (status = 'completed') AS d, count(*) FILTER (status = 'failed') AS f, count(*) AS t FROM point GROUP BY ALL) WHERE scan_month % 5 > 0 UNION ALL SELECT DISTINCT area_id, engine, scan_month, 'cancelled' FROM point WHERE scan_month % 5 = 0", "point")
def d5_timed_out(v):
    """A scan's age is taken from its month; every fifth month's scans were cancelled and stay so."""
    progress = P.scan_progress(v.point, ["area_id", "engine", "scan_month"])
    was = F.when(F.col("scan_month") % 5 == 0, "cancelled").otherwise("running")
    age = F.when(F.col("scan_month") < 23960, 31).otherwise(30)
    return P.reduce_status(progress, was, age).select("area_id", "engine", "scan_month", "new_status")


@query("SELECT point_id, CASE WHEN status = 'pending' AND scan_month < CASE WHEN area_id % 2 = 0 THEN 23950 ELSE 23970 END THEN 'failed' WHEN status = 'pending' THEN 'running' ELSE status END AS status FROM point", "point")
def j7_timeouts(v):
    """A month counts as a minute; areas of even number are batches with a longer limit."""
    scans = v.point.select("point_id", F.when(F.col("status") == "pending", "running").otherwise(F.col("status")).alias("status"), (F.col("scan_month") * 60).alias("started"), (F.col("area_id") % 2 == 0).alias("in_batch"))
    return P.timeouts(scans, F.lit(23999 * 60), single=29, batch=49).select("point_id", "status")


@query("SELECT b.business_id, e1, e2, e3, e4, e5, avg_rank FROM (SELECT business_id, " + ", ".join(f"round(avg(rank) FILTER (engine = '{e}'), 4) AS e{e[0]}" for e in ENGINES) + ", round(avg(rank), 4) AS avg_rank FROM fact GROUP BY business_id) f RIGHT JOIN (SELECT business_id FROM ranked WHERE is_mine OR is_competitor) b ON f.business_id = b.business_id", "fact ranked")
def d17_competitor_profile(v):
    out = A.competitor_profile(v.fact, v.ranked, A.review_velocity(v.review), A.ranking_momentum(v.fact), ENGINES)
    return out.select("business_id", "e1", "e2", "e3", "e4", "e5", "avg_rank")


@query("SELECT * FROM (SELECT area_id, keyword, round(mine, 4) AS mine, round(theirs, 4) AS theirs, round(mine - theirs, 4) AS gap, CASE WHEN mine - theirs >= 10 OR (mine IS NULL AND theirs <= 3) THEN 'high' WHEN mine - theirs >= 5 THEN 'medium' ELSE 'low' END AS opportunity FROM (SELECT m.area_id, keyword, min(mean) FILTER (is_mine) AS mine, min(mean) FILTER (is_competitor) AS theirs FROM (SELECT area_id, keyword, business_id, avg(rank) AS mean FROM fact GROUP BY ALL) m JOIN ranked b ON m.business_id = b.business_id GROUP BY ALL) WHERE theirs IS NOT NULL)", "fact ranked")
def d21_competitor_gap(v):
    return A.competitor_gap(v.dealt("fact", "business_id"), v.ranked)  # as the join with businesses asks, which would else deal the means anew


@query("SELECT engine, month, used, most, round(100.0 * used / most, 4) AS percent FROM (SELECT engine, CAST(year(make_timestamp(second * 1000000)) * 12 + month(make_timestamp(second * 1000000)) AS INT) AS month, count(*) AS used, CASE engine WHEN 'click' THEN 1000 WHEN 'view' THEN 6600 END AS most FROM request GROUP BY 1, 2)", "request")
def d27_usage_by_month(v):
    return U.usage_by_month(v.request, {"click": 1000, "view": 6600})


@query("SELECT business_id, count(*) FILTER (c = 'improved') AS improved, count(*) FILTER (c = 'declined') AS declined, count(*) FILTER (c = 'new') AS new, count(*) FILTER (c = 'lost') AS lost, count(*) FILTER (c = 'unchanged') AS unchanged FROM (SELECT business_id, CASE WHEN before IS NULL THEN 'new' WHEN after IS NULL THEN 'lost' WHEN after < before THEN 'improved' WHEN after > before THEN 'declined' ELSE 'unchanged' END AS c FROM (SELECT business_id, grid_row, grid_col, min(rank) FILTER (scan_month % 2 = 0) AS before, min(rank) FILTER (scan_month % 2 = 1) AS after FROM fact GROUP BY ALL)) GROUP BY business_id", "fact")
def e11_scan_changes(v):
    return A.scan_changes(A.compare_scans(v.fact.filter("scan_month % 2 = 0"), v.fact.filter("scan_month % 2 = 1")))


@query("SELECT business_id % 400 AS entity, coalesce(arg_min(phone, business_id) FILTER (business_id % 3 = 1 AND phone IS NOT NULL), arg_min(phone, business_id) FILTER (business_id % 3 = 0 AND phone IS NOT NULL)) AS phone FROM business GROUP BY 1", "business")
def e13_survive_by_source(v):
    seen = v.business.select((F.col("business_id") % 400).alias("entity"), F.col("business_id").alias("obs_id"), F.col("business_id").alias("observed_at"), "phone", F.element_at(F.array(F.lit("maps"), F.lit("places"), F.lit("other")), (F.col("business_id") % 3 + 1).cast("int")).alias("source"))
    return R.survive_by_source(seen, ["phone"], ["places", "maps"], key="entity")


@query("SELECT point_id, string_agg(CAST(business_id AS STRING), ',' ORDER BY rank, business_id) AS leaders FROM fact GROUP BY point_id", "fact")
def e16_point_lists(v):
    return A.point_leaders(v.fact, None)


@query("SELECT area_id, slug, keyword, priority, engine FROM (SELECT a.area_id, c.slug, coalesce(k.keyword, c.slug) AS keyword, coalesce(k.priority, 1) AS priority, '1-URGENT' AS engine FROM (SELECT * FROM area WHERE is_active AND area_id IN (SELECT area_id FROM mine)) a CROSS JOIN (SELECT * FROM category WHERE is_active AND slug IN (SELECT category FROM mine)) c LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY category ORDER BY priority DESC, keyword) AS nth FROM keyword) k ON c.slug = k.category AND k.nth <= 5)".replace("mine)", "(SELECT s_nationkey AS area_id, 'PROMO/Brand#' || CAST(s_suppkey % 9 AS VARCHAR) AS category FROM supplier WHERE s_suppkey % 2 = 1))"), "area category keyword")
def e18_quick_plan(v):
    own = v.ranked.withColumn("is_mine", F.col("business_id") % 2 == 1).withColumn("category", F.concat(F.lit("PROMO/Brand#"), (F.col("business_id") % 9).cast("string")))
    return P.quick_plan(v.area, v.category, v.keyword, own, "1-URGENT", tuple(ENGINES))


@query("SELECT schedule_id, p.area_id, slug, keyword, engine FROM ({PLAN}) p JOIN schedule s ON p.area_id IN (s.schedule_id, 1) WHERE s.schedule_id % 2 = 1 AND s.schedule_id <> 1 AND engine = '2-HIGH'".replace("{PLAN}", "SELECT area_id, slug, coalesce(keyword, slug) AS keyword, engine FROM (SELECT * FROM area WHERE is_active) CROSS JOIN (SELECT * FROM category WHERE is_active) c LEFT JOIN (SELECT category, keyword, row_number() OVER (PARTITION BY category ORDER BY priority DESC, keyword) AS nth FROM keyword) k ON c.slug = k.category AND nth <= 5 CROSS JOIN (VALUES ('1-URGENT'), ('2-HIGH')) e(engine)"), "area category keyword schedule")
def c9_scheduled_plan(v):
    wanted = v.schedule.filter("schedule_id % 2 = 1 AND schedule_id <> 1").select("schedule_id", F.array(F.col("schedule_id"), F.lit(1)).alias("area_ids"), F.array().cast("array<string>").alias("slugs"), F.array(F.lit("2-HIGH")).alias("engines"))
    return P.plan_schedules(wanted, v.area, _plan(v)).select("schedule_id", "area_id", "slug", "keyword", "engine")


# --- scalars on built columns


@query("SELECT business_id, rating, reviews, CASE WHEN rating > 0 AND rating <= 5 THEN rating END AS valid, CASE WHEN business_id % 2 = 0 THEN category END AS category FROM business", "business")
def h10_labels(v):
    """H10 to H12: labels that are built from rating, reviews and category, and read back."""
    label = F.concat(F.lit("Rated "), F.col("rating").cast("string"), F.lit(" out of 5, "), F.col("reviews").cast("string"), F.lit(" user reviews"))
    line = F.when(F.col("business_id") % 2 == 0, F.concat(F.lit("$$ · "), "category")).otherwise(F.concat("category", F.lit(" · $10-20")))
    reviews = F.coalesce(S.reviews_of_label(label), F.when(F.col("rating").isNull(), F.col("reviews")))
    return v.business.select("business_id", S.rating_of_label(label).alias("rating"), reviews.alias("reviews"), S.valid_rating(F.col("rating")).alias("valid"), S.category_of_line(line).alias("category"))


@query("SELECT business_id, 'A shop at ' || CAST(business_id AS VARCHAR) || ' Old Oak Blvd. since' AS text, CAST(business_id AS VARCHAR) || ' Old Oak Blvd.' AS street, 'https://shop' || CAST(business_id AS VARCHAR) || '.example/a?b' AS target, 'https://shop' || CAST(business_id AS VARCHAR) || '.example' AS origin, CASE WHEN business_id % 3 = 0 THEN NULL ELSE 'x' END AS some FROM business", "business")
def h14_texts(v):
    """H14 to H17, H20: streets in texts, wrapped targets, origins, blanks."""
    number = F.col("business_id").cast("string")
    text = F.concat(F.lit("A shop at "), number, F.lit(" Old Oak Blvd. since"))
    target = F.concat(F.lit("https://shop"), number, F.lit(".example/a?b"))
    wrapped = F.concat(F.lit("//search.example/l/?uddg="), F.url_encode(target))
    blank = F.when(F.col("business_id") % 3 == 0, "  ").otherwise(" x ")
    return v.business.select("business_id", text.alias("text"), S.street_address(text).alias("street"), S.unwrap_redirect(wrapped).alias("target"), S.url_origin(S.website_url(target)).alias("origin"), S.non_empty(blank).alias("some"))



@query("SELECT business_id, CASE WHEN business_id % 8 IN (0, 6, 7) THEN TRUE ELSE FALSE END AS valid FROM business", "business")
def h18_email_rules(v):
    """One kind of address each: good, sender, example, asset, two signs, no dot, good, and a domain that only looks like junk."""
    n = F.col("business_id").cast("string")
    kinds = [F.concat(F.lit("x"), n, F.lit("@shop.example")), F.lit("no-reply@shop.example"), F.lit("a@example.com"), F.concat(F.lit("logo"), n, F.lit("@2x.png")), F.lit("two@at@shop.example"), F.lit("a@b"), F.concat(F.lit("Sales."), n, F.lit("@Shop.Co")), F.lit("a@x.sentry.io")]
    mail = F.element_at(F.array(*kinds), (F.col("business_id") % 8 + 1).cast("int"))
    return v.business.select("business_id", S.email_valid(mail).alias("valid"))


@query("SELECT business_id, '+1' || phone AS phone, CASE WHEN reviews <= 3 THEN '1-3' WHEN reviews <= 7 THEN '4-7' WHEN reviews <= 15 THEN '8-15' ELSE '16+' END AS band, round(lat + 3 / 69.0 - 2 * (2 * 3 / 69.0 / 6), 6) AS row2 FROM business", "business")
def k_sql_functions(v):
    from rankatlas.functions.sql import register

    register(v.spark)
    v.business.createOrReplaceTempView("business_k")
    return v.spark.sql("SELECT business_id, normalize_phone(phone) AS phone, rank_band(CAST(reviews AS INT)) AS band, round(g.point_lat, 6) AS row2 FROM business_k, LATERAL grid_points(lat, lng, 3, 7) g WHERE g.grid_row = 2 AND g.grid_col = 0")


# --- pages that are built from the tables, and what is read from them


def _local_pages(v) -> DataFrame:
    """A page of local results for each area and category of businesses, in the order of reviews."""
    text = lambda *p: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in p))
    site = F.coalesce(text("<a class='x' href=\"", F.col("website"), "\">site</a>"), F.lit(""))
    item = text("<div data-x='1'><h2>", F.col("name"), "</h2><span aria-label='Rated ", F.coalesce(F.col("rating").cast("string"), F.lit("-")), " out of 5, ", F.col("reviews").cast("string"), " user reviews'></span><p class=\"address\">", F.col("address"), "</p>", F.coalesce(F.col("phone"), F.lit("")), site, "</div>")
    return v.business.groupBy(F.concat_ws("/", "area_id", "category").alias("page")).agg(F.concat(F.lit("<html>"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("business_id"), item.alias("item")))), lambda x: x["item"]), ""), F.lit("</html>")).alias("html"))


@query("SELECT CAST(area_id AS STRING) || '/' || category AS page, CAST(row_number() OVER (PARTITION BY area_id, category ORDER BY business_id) AS INT) AS rank, name, address, '+1' || phone AS phone, rating, CAST(reviews AS BIGINT) AS reviews, website FROM business", "business")
def i4_extract_local(v):
    return X.extract_local(_local_pages(v)).select("page", "rank", "name", "address", "phone", "rating", "reviews", "website")


@query("SELECT business_id, name, '+1' || phone AS phone, website, city, lat, lng FROM business WHERE business_id % 5 < 4", "business")
def i5_extract_jsonld(v):
    """One kind of document each: single, in a list, wrapped in an item list, in a graph; and a kind that is no business."""
    one = F.struct(F.when(F.col("business_id") % 5 == 4, "WebPage").when(F.col("business_id") % 2 == 0, "Restaurant").otherwise("LocalBusiness").alias("@type"), "name", F.col("phone").alias("telephone"), F.col("website").alias("url"), F.struct(F.col("city").alias("addressLocality")).alias("address"), F.struct(F.col("lat").alias("latitude"), F.col("lng").alias("longitude")).alias("geo"))
    kinds = [F.to_json(one), F.to_json(F.array(one)), F.to_json(F.struct(F.lit("ItemList").alias("@type"), F.array(F.struct(one.alias("item"))).alias("itemListElement"))), F.to_json(F.struct(F.array(one).alias("@graph"))), F.to_json(one)]
    html = F.concat(F.lit("<script type=\"application/ld+json\">"), F.element_at(F.array(*kinds), (F.col("business_id") % 5 + 1).cast("int")), F.lit("</script>"))
    return X.extract_jsonld(v.business.select("business_id", html.alias("html"))).select("business_id", "name", "phone", "website", "city", "lat", "lng")


def _organic_pages(v) -> DataFrame:
    target = F.concat(F.lit("https://www.shop"), F.col("business_id").cast("string"), F.lit(".example/p"))
    link = F.when(F.col("business_id") % 2 == 0, F.concat(F.lit("//r.example/l/?uddg="), F.url_encode(target), F.lit("&amp;x=1"))).otherwise(target)
    link = F.when(F.col("business_id") % 11 == 0, F.lit("/inner")).otherwise(link)
    snippet = F.concat(F.lit("At "), F.col("business_id").cast("string"), F.lit(" Long Oak Ave, call "), F.coalesce("phone", F.lit("us")))
    block = F.concat(F.lit("<div class=\"links result\"><h2><a href=\""), link, F.lit("\"><b>"), F.col("name"), F.lit("</b></a></h2><a class=\"result__snippet\">"), snippet, F.lit("</a></div>"))
    return v.business.groupBy("area_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("business_id", block.alias("b")))), lambda x: x["b"]), "").alias("html"))


_ORGANIC = "SELECT area_id, business_id, CAST(row_number() OVER (PARTITION BY area_id ORDER BY business_id) AS INT) AS position, name AS title, phone FROM business WHERE business_id % 11 <> 0"


@query(f"SELECT area_id, position, title, 'https://www.shop' || business_id || '.example/p' AS url, 'www.shop' || business_id || '.example' AS domain, 'At ' || business_id || ' Long Oak Ave, call ' || coalesce(phone, 'us') AS snippet FROM ({_ORGANIC})", "business")
def i6_extract_organic(v):
    return X.extract_organic(_organic_pages(v))


@query(f"SELECT area_id, CAST(row_number() OVER (PARTITION BY area_id ORDER BY position) AS INT) AS rank, title AS name, business_id || ' Long Oak Ave' AS address, '+1' || phone AS phone, 'https://www.shop' || business_id || '.example' AS website FROM ({_ORGANIC}) WHERE phone IS NOT NULL", "business")
def i8_listings_from_snippets(v):
    return X.listings_from_snippets(X.extract_organic(_organic_pages(v)))


@query("SELECT area_id, CAST(row_number() OVER (PARTITION BY area_id ORDER BY first) - 1 AS INT) AS position, text FROM (SELECT area_id, 'where is ' || category AS text, min(business_id) AS first FROM business GROUP BY ALL)", "business")
def i7_extract_related(v):
    html = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("business_id", "category"))), lambda x: F.concat(F.lit("<div data-q=\"where is "), x["category"], F.lit("\"></div>"))), "")
    return X.extract_related(v.business.groupBy("area_id").agg(html.alias("html"))).select("area_id", "position", "text")


def _harvest(v) -> tuple[DataFrame, DataFrame]:
    """Candidates and the pages that were fetched for them: a home page, and a contact page for every second."""
    url = F.when(F.col("business_id") % 9 == 0, "ftp://no").otherwise(F.col("website"))
    sites = v.business.select("business_id", F.when(F.col("website").isNotNull(), F.concat(url, F.lit("/"), F.col("business_id").cast("string"))).alias("url"), "email", F.lit(None).cast("long").alias("last_enriched_at"))
    home = sites.filter("business_id % 7 <> 0").select(S.website_url(F.col("url")).alias("home"), F.lit(0).alias("step"), F.when(F.col("business_id") % 2 == 0, F.lit("<p>none</p>")).otherwise(F.concat(F.lit("<p>home"), F.col("business_id").cast("string"), F.lit("@shop.example</p>"))).alias("html"))
    contact = sites.filter("business_id % 7 <> 0 AND business_id % 4 < 2").select(S.website_url(F.col("url")).alias("home"), F.lit(2).alias("step"), F.concat(F.lit("<a href=\"mailto:mail"), F.col("business_id").cast("string"), F.lit("@shop.example\">x</a>")).alias("html"))
    pages = home.unionByName(contact).filter("home is not null")
    return sites, X.harvest_emails(pages).select("home", "step", "emails")


_ENRICH = "SELECT business_id, CASE WHEN website IS NULL THEN 'no_website' WHEN business_id % 9 = 0 THEN 'invalid_url' WHEN business_id % 7 = 0 THEN 'error' WHEN business_id % 2 = 1 OR business_id % 4 < 2 THEN 'success' ELSE 'no_email_found' END AS status, CASE WHEN website IS NULL OR business_id % 9 = 0 OR business_id % 7 = 0 THEN NULL WHEN business_id % 2 = 1 THEN 'home' || business_id || '@shop.example' WHEN business_id % 4 < 2 THEN 'mail' || business_id || '@shop.example' END AS found, email FROM business"


@query(f"SELECT business_id, status, found AS email FROM ({_ENRICH})", "business")
def i3_resolve_enrichment(v):
    return X.resolve_enrichment(*_harvest(v)).select("business_id", "status", "email")


@query(f"SELECT business_id, coalesce(found, email) AS email, CASE WHEN status NOT IN ('no_website', 'invalid_url') THEN 1000 END AS last_enriched_at FROM ({_ENRICH})", "business")
def i3_apply_enrichment(v):
    sites, harvested = _harvest(v)
    return X.apply_enrichment(sites, X.resolve_enrichment(sites, harvested), F.lit(1000)).select("business_id", "email", F.col("last_enriched_at").cast("int").alias("last_enriched_at"))


@query("SELECT source, count(*) AS snapshots, sum(review_count)::BIGINT AS reviews FROM (SELECT 'google' AS source, rating, reviews AS review_count FROM business UNION ALL SELECT 'bing', rating, reviews FROM business WHERE business_id % 2 = 0) WHERE rating IS NOT NULL GROUP BY source", "business")
def i10_build_facts(v):
    seen = _observations(v).withColumns({"point_id": F.col("obs_id") % 50, "rank": F.lit(1)})
    known = seen.select("obs_id", F.col("obs_id").alias("business_id"))
    _, snapshots = R.build_facts(seen, known)
    return snapshots.groupBy("source").agg(F.count("*").alias("snapshots"), F.sum("review_count").alias("reviews"))


# --- streams


@query("SELECT user_id AS client, count(*) AS requests FROM events GROUP BY user_id")
def j2_rate_audit_stream(v):
    """The anchored windows of a stream, ended by a watermark that a last row of each client pushes on; all requests are in one."""
    from rankatlas.streaming.streams import rate_audit_stream, read_stream, run_once

    rows = read_stream(v.spark, v.sf_dir, "events").select(F.col("user_id").alias("client"), F.unix_timestamp("ts").alias("second"), "ts")
    done = run_once(rate_audit_stream(rows, seconds=60, most=3, late="0 seconds"), "append")
    batch = U.rate_audit(v.request, 60, 3)
    # windows still open at the stream's end stay in its state; the batch form has them
    still = batch.select("client", "start", "requests").join(done.select("client", "start"), ["client", "start"], "left_anti")
    return done.select("client", "requests").unionByName(still.select("client", "requests")).groupBy("client").agg(F.sum("requests").alias("requests"))


@query("SELECT count(*) AS rows FROM (SELECT DISTINCT o_orderkey, o_custkey FROM orders)")
def j8_dedupe_stream(v):
    """Every order arrives twice and counts once."""
    from rankatlas.streaming.streams import dedupe_stream, read_stream, run_once

    orders = read_stream(v.spark, v.sf_dir, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").alias("ts"))
    twice = orders.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    return run_once(dedupe_stream(twice, ["o_orderkey", "o_custkey"]), "append").agg(F.count("*").alias("rows"))


@query("SELECT business_id, keyword, engine, scan_month, round(change, 4) AS change FROM (SELECT *, mean - lag(mean) OVER (PARTITION BY business_id, keyword, engine ORDER BY scan_month) AS change FROM (SELECT business_id, keyword, engine, scan_month, avg(rank) AS mean FROM fact WHERE scan_month < 23980 GROUP BY ALL)) WHERE abs(change) >= 3 AND scan_month < 23960 UNION ALL SELECT business_id, keyword, engine, scan_month, round(change, 4) FROM (SELECT *, mean - lag(mean) OVER (PARTITION BY business_id, keyword, engine ORDER BY scan_month) AS change FROM (SELECT business_id, keyword, engine, scan_month, avg(rank) AS mean FROM fact GROUP BY ALL)) WHERE abs(change) >= 3 AND scan_month >= 23960", "fact")
def j10_rank_alerts(v):
    """Two batches, as the stream's micro-batches take them: months before 23960, then the rest against the last means."""
    from rankatlas.streaming.streams import moved

    facts = v.dealt("fact", "business_id", "keyword", "engine").select("business_id", "keyword", "engine", "scan_month", "rank")
    first, means = moved(facts.filter("scan_month < 23960"), None)
    second, _ = moved(facts.filter("scan_month >= 23960"), means)
    return first.unionByName(second)


@query()
def j1_ingest(v):
    """Observations in two batches into a dimension and facts in the shared folder; the rankings of both."""
    import uuid

    from rankatlas.operators.lineage import shared_folder

    folder = f"{shared_folder(v.spark)}/ingest-{uuid.uuid4().hex}"
    seen = _observations(v).withColumns({"point_id": F.col("obs_id") % 50, "rank": F.lit(1)})
    for number in (0, 1):
        R.ingest(seen.filter(F.col("observed_at") == number), number, folder)
    return v.spark.read.parquet(f"{folder}/rankings").select("business_id", "point_id", "rank", "batch")
