import pytest
from pyspark.sql import functions as F

from rankatlas.operators import analytics as A
from rankatlas.operators import audit as U
from rankatlas.operators import extract as X
from rankatlas.operators import catalog as C
from rankatlas.operators import planning as P
from rankatlas.operators.resolve import ingest, resolve_entities, survive
from rankatlas.sources import schemas
from rankatlas.sources import tables as T


def test_grid(spark):
    area = spark.createDataFrame([(1, 26.0, -80.0, 3.0)], "area_id int, lat double, lng double, radius_miles double")
    for n in (3, 5, 7, 9):
        rows = {(r.grid_row, r.grid_col): r for r in P.expand_points(area, n).collect()}
        mid, corner = rows[n // 2, n // 2], rows[0, 0]
        assert len(rows) == n * n and (mid.point_lat, mid.point_lng) == (26.0, -80.0)
        assert corner.point_lat > 26 and corner.point_lng < -80
    with pytest.raises(ValueError, match="grid size"):
        P.check_grid(1, strict=False)


def test_share_of_voice(spark):
    points = spark.createDataFrame([(i, "completed", 1) for i in range(49)], "point_id int, status string, area_id int")
    facts = spark.createDataFrame([(i, 7, 1 + (i >= 28) * 5, 1) for i in range(49)], "point_id int, business_id int, rank int, area_id int")
    row = A.solv(facts, points, ["area_id"]).first()
    assert (row.top_points, row.points, row.solv, row.gauge) == (28, 49, 57.1429, "yellow")


OBS = "obs_id long, observed_at long, name string, place_id string, phone string, website string, city string, lat double, lng double"


def test_resolution_follows_chains_and_repeats(spark):
    rows = [
        (1, 1, "Joe's Pizza", None, "5615263512", "https://joes.example", "Boca", 26.0, -80.0),
        (2, 2, "Joes Pizza LLC", None, None, None, None, 26.0001, -80.0001),
        (3, 3, "Other", None, "(561) 526-3512", None, None, None, None),
        (4, 4, "Joes Pizza", None, None, None, None, 27.0, -80.0),
        (5, 5, "Joe", None, None, "www.joes.example/x", "BOCA", None, None),
        (6, 6, None, None, None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, OBS)
    got = {r.obs_id: (r.business_id, r.match_type, r.confidence) for r in resolve_entities(df).collect()}
    assert got == {1: (1, "new", 0), 2: (1, "name_location", 95), 3: (1, "phone", 90), 4: (4, "new", 0), 5: (1, "domain_city", 80), 6: (6, "new", 0)}
    strict = {r.obs_id: r.match_type for r in resolve_entities(df, phone_requires_name=True).collect()}
    assert strict[3] == "new"
    twice = df.unionByName(df.withColumns({"obs_id": F.col("obs_id") + 100, "observed_at": F.col("observed_at") + 100}))
    again = {r.obs_id: r.business_id for r in resolve_entities(twice).collect()}
    assert all(again[i + 100] == again[i] for i in (1, 2, 3, 4, 5))


def test_fuzzy_names_of_a_shared_phone(spark):
    names = ["Alpha Bakery", "Zed Motors", "Zed Motor", "Zed Motors", "Alfa Bakery"]
    df = spark.createDataFrame([(i, i, n, None, "5615263512", None, None, None, None) for i, n in enumerate(names)], OBS)
    got = {r.obs_id: (r.business_id, r.match_type) for r in resolve_entities(df, phone_requires_name=True).collect()}
    assert got == {0: (0, "new"), 1: (1, "new"), 2: (1, "fuzzy_name_phone"), 3: (1, "fuzzy_name_phone"), 4: (0, "fuzzy_name_phone")}


def test_survivorship(spark):
    df = spark.createDataFrame([(1, 1, 1, "A", None, 4.0, 10), (1, 2, 2, "B", "w", 5.0, None), (1, 3, 3, "C", None, None, 7)], "business_id int, obs_id int, observed_at int, name string, website string, rating double, n int")
    row = survive(df, ["name"], ["website"], {"review": ["rating", "n"]}).first()
    assert (row.name, row.website, row.rating, row.n, row.last_seen) == ("A", "w", 5.0, None, 3)


def test_pages(spark):
    html = """<html><head><script type="application/ld.json">{"@type":"Restaurant","name":"Joe","telephone":"561-526-3512","email":"ld@shop.de"}</script></head>
    <body><a href="mailto:First@Shop.de">m</a><p>second@shop.de</p><b>x@sentry.io</b><a href="/contact-us">Write</a><a href="team.html">People</a><a href="https://else.example/about">y</a></body></html>"""
    pages = spark.createDataFrame([("https://shop.de/a/b", html), ("https://none.de/", None)], "url string, html string")
    mails = {r.url: r.emails for r in X.harvest_emails(pages).collect()}
    assert mails == {"https://shop.de/a/b": ["first@shop.de", "second@shop.de", "ld@shop.de"], "https://none.de/": []}
    assert [r.target for r in X.contact_links(pages).orderBy("nth").collect()] == ["https://shop.de/contact-us", "https://shop.de/a/team.html"]
    found = X.extract_jsonld(pages).first()
    assert (found.name, found.phone) == ("Joe", "+15615263512")
    listed = X.extract_listings(spark.createDataFrame([("u", '<h3>A</h3> 4.5 <h3>B</h3> 561-526-3512 <h3>A</h3>')], "url string, html string"), r"<h3>(.*?)</h3>", {"rating": r"(\d\.\d)"})
    assert [(r.rank, r.name, r.rating, r.phone) for r in listed.orderBy("rank").collect()] == [(1, "A", "4.5", None), (2, "B", None, "+15615263512")]


def test_listings_of_a_long_page(spark):
    pages = [("many", "<h3>A</h3>" * 1500 + "".join(f"<h3>n{i}</h3>" for i in range(1200))), ("none", "<p>x</p>"), ("empty", ""), ("null", None)]
    listed = X.extract_listings(spark.createDataFrame(pages, "url string, html string"), r"<h3>(.*?)</h3>", {})
    assert [(r.url, r.rank, r.name) for r in listed.orderBy("rank").collect()] == [("many", i + 1, n) for i, n in enumerate(["A", *(f"n{i}" for i in range(1200))])]


def test_block_ladder_and_rates(spark):
    log = spark.createDataFrame([(i, i * 100, 1, "e", "blocked") for i in range(4)], "request_id long, second long, client long, engine string, outcome string")
    assert [r.minutes for r in U.block_episodes(log).orderBy("nth").collect()] == [15, 120, 1440, 1440]
    assert sorted((r.start, r.requests) for r in U.rate_audit(log, 150, 1).collect()) == [(0, 2), (200, 2)]


def test_tables(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    source = spark.createDataFrame([(2, None), (3, "c")], "k int, v string")
    assert sorted(map(tuple, T.upsert(target, source, ["k"]).collect())) == [(1, "a"), (2, "b"), (3, "c")]
    row = T.page_envelope(target, 1, 1, [F.col("k")]).first()
    assert (row.total, row.total_pages, row.data) == (2, 2, '[{"k":1,"v":"a"}]')
    assert T.delete_where(target, F.col("v") == "a").count() == 1
    body = '{"places":{"value":[{"name":"P","phone":"1"}]},"webPages":{"value":[{"name":"W","url":"u"}]}}'
    places, pages = T.read_api_results(spark.createDataFrame([("q", body)], "query string, body string"))
    assert places.first().name == "P" and pages.first().position == 1


def test_null_keys_stay_as_they_are(spark):
    target = spark.createDataFrame([(None, "keep"), (1, "a")], "k int, v string")
    source = spark.createDataFrame([(None, "new"), (1, "b")], "k int, v string")
    assert sorted(map(str, map(tuple, T.upsert(target, source, ["k"]).collect()))) == ["(1, 'b')", "(None, 'keep')", "(None, 'new')"]


@pytest.mark.parametrize("lat", [26.0, 47.6, -61.0])
def test_near_places_match_at_any_latitude(spark, lat):
    import math

    east = 0.029 / (69 * math.cos(math.radians(lat)))
    rows = [(1, 1, "Same Name", None, None, None, None, lat, 10.0), (2, 2, "Same Name", None, None, None, None, lat, 10.0 + east), (3, 3, "Same Name", None, None, None, None, lat, 10.0 + 2 * east), (4, 4, "Same Name", None, None, None, None, lat, 10.0 + 4 * east)]
    got = {r.obs_id: (r.business_id, r.match_type) for r in resolve_entities(spark.createDataFrame(rows, OBS)).collect()}
    # the third is near the second only, not near the first of its cell
    assert got == {1: (1, "new"), 2: (1, "name_location"), 3: (1, "name_location"), 4: (4, "new")}


def test_nearby_reaches_as_far_as_asked(spark):
    rows = [(1, True, 47.0, 10.0), (2, False, 47.12, 10.0), (3, False, 47.0, 10.2), (4, False, 48.0, 10.0)]
    df = spark.createDataFrame(rows, "business_id int, is_mine boolean, lat double, lng double")
    assert [r.business_id for r in C.nearby(df, 10, 5).orderBy("nth").collect()] == [2, 3]


def test_deep_tree(spark):
    rows = [(f"c{i}", f"c{i - 1}" if i else None) for i in range(12)]
    got = {(r.ancestor, r.descendant): r.depth for r in C.category_closure(spark.createDataFrame(rows, "slug string, parent string")).collect()}
    assert got == {(f"c{i}", f"c{j}"): j - i for j in range(12) for i in range(j + 1)}


def test_geographic_shares(spark):
    points = spark.createDataFrame([(a * 100 + i, "completed", a) for a in range(4) for i in range(100)], "point_id int, status string, area_id int")
    share = {(0, 1): 50, (0, 2): 45, (1, 1): 30, (1, 2): 39, (2, 1): 60, (2, 2): 41, (3, 2): 40}
    facts = spark.createDataFrame([(a * 100 + i, b, 1, a) for (a, b), n in share.items() for i in range(n)], "point_id int, business_id int, rank int, area_id int")
    names = spark.createDataFrame([(1, True, False), (2, False, True)], "business_id int, is_mine boolean, is_competitor boolean")
    assert {r.area_id: r.holder for r in A.geo_dominance(facts, points, names).collect()} == {0: "contested", 1: "neither", 2: "mine", 3: "competitor"}
    ranks = spark.createDataFrame([(0, "k", 1, 14), (0, "k", 2, 3), (1, "k", 2, 2), (2, "k", 1, 8), (2, "k", 2, 3), (3, "k", 2, 9)], "area_id int, keyword string, business_id int, rank int")
    assert {r.area_id: r.opportunity for r in A.competitor_gap(ranks, names).collect()} == {0: "high", 1: "high", 2: "medium", 3: "low"}


def test_streaks_cross_days(spark):
    seconds = [10, 20, 86_410, 86_420, 2 * 86_400 + 5, 4 * 86_400, 4 * 86_400 + 1, 4 * 86_400 + 2]
    outcomes = ["ok", "error", "error", "error", "error", "error", "ok", "error"]
    log = spark.createDataFrame([(i, s, "e", o) for i, (s, o) in enumerate(zip(seconds, outcomes, strict=True))], "request_id long, second long, engine string, outcome string")
    assert [r.streak for r in U.error_streaks(log).orderBy("request_id").collect()] == [0, 1, 2, 3, 4, 5, 0, 1]


def test_retry_after(spark):
    log = spark.createDataFrame([(1, s) for s in (100, 100, 110, 120, 130, 159, 160, 300)], "client long, second long")
    got = [(r.start, r.requests, r.retry_after, r.flagged) for r in U.rate_audit(log, 60, 3).orderBy("start").collect()]
    assert got == [(100, 6, 40, True), (160, 1, None, False), (300, 1, None, False)]


def test_stream_forms(spark, tmp_path):
    from rankatlas.streaming import streams as St

    def stream(rows, schema, name):
        for i, part in enumerate(rows):
            spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/{name}")
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{name}")

    schema = "client long, second long"
    parts = [[(1, 1000), (1, 1010), (1, 1020), (2, 1005)], [(1, 1061), (2, 1400)], [(3, 9000)]]
    rows = stream(parts, schema, "log").withColumn("ts", F.timestamp_seconds("second"))
    done = {(r.client, r.start): (r.requests, r.flagged) for r in St.run_once(St.rate_audit_stream(rows, 60, 2, "10 seconds"), "append", str(tmp_path)).collect()}
    assert done == {(1, 1000): (3, True), (2, 1005): (1, False), (1, 1061): (1, False), (2, 1400): (1, False)}
    # a day that the watermark has passed is final: what comes later is dropped
    day = 86_400
    parts = [[(1, 10), (1, 20)], [(1, 20 * day)], [(1, 21 * day)], [(1, 30)], [(1, 40 * day)]]
    late = stream(parts, schema, "late").select(F.col("client").alias("business_id"), F.timestamp_seconds("second").alias("ts"))
    days = St.run_once(St.review_days_stream(late), "append", str(tmp_path))
    assert {(r.month, r.snapshots) for r in St.review_months(days).collect()} == {(1970 * 12 + 1, 4)}
    facts = [[(1, "k", "e", 1, 2)], [(1, "k", "e", 2, 7)], [(1, "k", "e", 3, 6)]]
    found = stream(facts, "business_id int, keyword string, engine string, scan_month int, rank int", "facts")
    St.alert_stream(found, f"{tmp_path}/out").awaitTermination()
    assert [(r.scan_month, r.change) for r in spark.read.parquet(f"{tmp_path}/out/alerts").collect()] == [(2, 5.0)]


def test_ingest_keeps_entities(spark, tmp_path):
    schema = OBS + ", point_id long, rank int, source string, rating double, review_count long"
    first = [(1, 1, "A", "p1", "5615263512", None, "x", 1.0, 1.0, 7, 1, "google_maps", 4.0, 9)]
    second = [(2, 2, "B", "p1", None, "https://b.example", "x", None, None, 8, 2, "bing_api", None, 3), (3, 3, "C", None, "5615263512", None, None, None, None, 8, 3, "bing_api", 5.0, 2)]
    for _ in range(2):  # a repeated batch replaces itself
        for number, rows in enumerate((first, second)):
            ingest(spark.createDataFrame(rows, schema), number, str(tmp_path))
    assert {(r.business_id, r.rank, r.batch) for r in spark.read.parquet(f"{tmp_path}/rankings").collect()} == {(1, 1, 0), (1, 2, 1), (1, 3, 1)}
    assert {(r.source, r.review_count) for r in spark.read.parquet(f"{tmp_path}/snapshots").collect()} == {("google", 9), ("bing", 2)}
    last = spark.read.parquet(f"{tmp_path}/entities/batch=1").collect()
    assert [(r.obs_id, r.name, r.website, r.phone) for r in last] == [(1, "A", "https://b.example", "5615263512")]


def test_seeds_and_schemas(spark):
    areas, categories, keywords = P.seed_dimensions(spark)
    assert (areas.count(), categories.count(), keywords.count(), categories.filter("parent is null").count()) == (3, 12, 53, 6)
    assert {r.keyword: r.priority for r in keywords.filter("category = 'pizza'").collect()} == {"pizza near me": 4, "best pizza": 3, "pizza delivery": 2, "pizzeria near me": 1}
    assert len(schemas.SCHEMAS) == 10 and len(schemas.FOREIGN_KEYS) == 10
    frames = {n: spark.createDataFrame([], s) for n, s in schemas.SCHEMAS.items()}
    assert all(c in frames[t].columns and p in frames for t, c, p, _ in schemas.FOREIGN_KEYS)


def test_enrichment_log(spark):
    sites = spark.createDataFrame([(1, "shop.de", None), (2, None, 5), (3, "ftp://x", 6), (4, "gone.de", None)], "business_id int, url string, last_enriched_at int").withColumn("email", F.lit(None).cast("string"))
    pages = spark.createDataFrame([("https://shop.de", 0, []), ("https://shop.de", 1, ["a@shop.de", "b@shop.de"]), ("https://shop.de", 2, ["c@shop.de"])], "home string, step int, emails array<string>")
    found = X.resolve_enrichment(sites, pages)
    assert {r.business_id: (r.status, r.email) for r in found.collect()} == {1: ("success", "a@shop.de"), 2: ("no_website", None), 3: ("invalid_url", None), 4: ("error", None)}
    assert {r.business_id: r.last_enriched_at for r in X.apply_enrichment(sites, found, F.lit(9)).collect()} == {1: 9, 2: 5, 3: 6, 4: 9}
    assert X.enrichment_log(found, F.lit(9)).filter("business_id = 1").first().data_added == '{"email":"a@shop.de","allEmails":["a@shop.de","b@shop.de"]}'
