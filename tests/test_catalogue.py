import math
import re
from collections import Counter

import duckdb
import pytest

from rankatlas.operators.resolve import RULES
from rankatlas.plans import catalogue
from rankatlas.plans.views import Views

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_matches_sql(spark, duck, name):
    got = catalogue.queries()[name](spark, FOLDER)
    cursor = duck.execute(catalogue.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(columns) == sorted(got.columns)
    rows = sorted(str(tuple(r[c] for c in columns)) for r in got.collect())
    assert rows == sorted(str(tuple(r)) for r in cursor.fetchall())


def test_whole_text_is_normalised(spark, tmp_path):
    spark.createDataFrame([(1, "Ab, " * 500 + "LLC End!")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert catalogue.queries()["h1_normalize_whole"](spark, str(tmp_path)).first().name == "ab " * 500 + "end"


def miles(a, b):
    y, x = math.radians(b.lat - a.lat), math.radians(b.lng - a.lng)
    h = math.sin(y / 2) ** 2 + math.cos(math.radians(a.lat)) * math.cos(math.radians(b.lat)) * math.sin(x / 2) ** 2
    return 2 * 3958.8 * math.asin(math.sqrt(h))


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[-1] + 1))
        row = new
    return row[-1]


@pytest.mark.parametrize("name", ["i9_resolve_entities", "i9_resolve_strict"])
def test_resolution_uses_all_rules(spark, name):
    seen = sorted(catalogue._observations(Views(spark, FOLDER)).collect(), key=lambda r: (r.observed_at, r.obs_id))
    short = {r.obs_id: " ".join(re.sub(r"[^a-z0-9_ ]", "", re.sub(r"\b(llc|inc|co)\b", "", r.name.lower())).split()) for r in seen}
    domain = {r.obs_id: r.website and re.search(r"//(?:www\.)?([^/]+)", r.website.lower())[1] for r in seen}
    phone = lambda a, b: a.phone and a.phone == b.phone
    rules = {
        "place_id": lambda a, b: a.place_id and a.place_id == b.place_id,
        "phone": phone,
        "name_location": lambda a, b: short[a.obs_id] == short[b.obs_id] and miles(a, b) < 0.031,
        "fuzzy_name_phone": lambda a, b: phone(a, b) and distance(short[a.obs_id], short[b.obs_id]) <= 3,
        "domain_city": lambda a, b: domain[a.obs_id] and domain[a.obs_id] == domain[b.obs_id] and a.city.lower() == b.city.lower(),
    }
    del rules["phone" if name == "i9_resolve_strict" else "fuzzy_name_phone"]
    want = {}
    for i, b in enumerate(seen):
        up, rule = next(((a.obs_id, rule) for rule, same in rules.items() for a in seen[:i] if same(a, b)), (b.obs_id, "new"))
        want[b.obs_id] = want[up][0] if up != b.obs_id else up, rule, RULES.get(rule, 0)
    got = {r.obs_id: (r.business_id, r.match_type, r.confidence) for r in catalogue.queries()[name](spark, FOLDER).collect()}
    assert got == want
    kinds = Counter(rule for _, rule, _ in want.values())
    assert {"new", "place_id", "domain_city"} < set(kinds) and len(kinds) >= 4
    if name == "i9_resolve_entities":
        assert {r.match_type: r.observations for r in catalogue.queries()["d25_discovery_stats"](spark, FOLDER).collect()} == kinds


def test_gaps_and_areas_are_whole(spark):
    found = catalogue.queries()
    fact, ranked = Views(spark, FOLDER).fact.collect(), Views(spark, FOLDER).ranked.collect()
    ours, theirs = ({r.business_id for r in ranked if r[c]} for c in ("is_mine", "is_competitor"))
    gaps = {(r.area_id, r.keyword) for r in fact if r.business_id in theirs} - {(r.area_id, r.keyword) for r in fact if r.business_id in ours}
    assert {tuple(r) for r in found["c17_keyword_gap_all"](spark, FOLDER).select("area_id", "keyword").collect()} == gaps
    assert {r.area_id for r in found["d19_keyword_area_ranks"](spark, FOLDER).collect()} == {r.area_id for r in fact} > {0, 1, 2, 3}


def test_ratings_are_rounded_as_in_sql(spark, tmp_path):
    values = [x / 100 for x in range(0, 60_000, 5)]
    duck = duckdb.connect()
    duck.execute("CREATE TABLE events AS SELECT i::BIGINT AS event_id, TIMESTAMP '2024-01-01' AS ts, i::BIGINT AS user_id, 'view' AS event_type, v AS value, 'n 1' AS props FROM (SELECT unnest(range(len($1))) AS i, unnest($1) AS v)", [values])
    duck.execute(f"COPY events TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    got = catalogue.queries()["e4_latest_reviews"](spark, str(tmp_path)).select("business_id", "rating").collect()
    want = duck.execute(f"SELECT business_id, rating FROM ({catalogue.oracle_sql()['e4_latest_reviews']})").fetchall()
    assert sorted(map(tuple, got)) == sorted(want)
