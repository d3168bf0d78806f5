import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from rankatlas.operators import geo as G
from rankatlas.operators import resolve as R
from rankatlas.operators.components import components, followed
from rankatlas.operators.numbering import numbered

from .test_catalogue import distance

OBS = "obs_id long, observed_at long, name string, place_id string, phone string, website string, city string, lat double, lng double, point_id long, rank int, source string, rating double, review_count long"


def observation(i, at, name="N", place=None, phone=None, site=None, city=None, lat=None, lng=None):
    return (i, at, name, place, phone, site, city, lat, lng, i % 5, 1, "google_maps", 4.0, i)


def groups(rows):
    out = {}
    for obs, entity in rows:
        out.setdefault(entity, set()).add(obs)
    return sorted(map(sorted, out.values()))


@pytest.mark.parametrize("strict", [False, True])
def test_batches_in_any_order_give_the_entities_of_one(spark, tmp_path, strict):
    r = random.Random(int(strict))
    names = ["Alpha Bakery", "Alpha Bakary", "Zed Motors", "Zed Motor LLC", "Other"]
    rows = [
        observation(i, r.randrange(99), r.choice(names), r.choice([None, None, "", f"p{r.randrange(12)}"]), r.choice([None, None, f"561526{r.randrange(8):04d}"]), r.choice([None, None, f"https://www.s{r.randrange(6)}.example"]), r.choice(["", "Boca", "BOCA", "Delray"]), *r.choice([(None, None), (26.0 + r.randrange(4) * 1e-4, r.choice([180.0 - 1e-4, -180.0 + 1e-4, -80.0]))]))
        for i in range(60)
    ]
    # joined only by way of others: an entity of each of the first two batches meets in the third
    rows += [observation(100, 5, "Quality Shop", "pq"), observation(101, 1, "Wonder Works", None, "5619990000"), observation(102, 9, "Elsewhere", "pq", "5619990000")]
    parts = [rows[0:20] + rows[60:61], rows[20:40] + rows[61:62], rows[40:60] + rows[62:63]]
    found = []
    for n, order in enumerate([[2, 1, 0], [None]] if strict else [[0, 1, 2], [2, 1, 0], [None]]):
        folder = f"{tmp_path}/{n}"
        for number, k in enumerate(order):
            for _ in range(2 if [n, k] == [0, 1] else 1):  # a repeated batch replaces itself
                R.ingest(spark.createDataFrame(rows if k is None else parts[k], OBS), number, folder, phone_requires_name=strict)
        assigned = [(x.obs_id, x.business_id) for x in R.facts(spark, folder, "assigned").collect()]
        known = R.entities(spark, folder).collect()
        assert sorted(o for o, _ in assigned) == sorted(x[0] for x in rows)
        for name in ("rankings", "snapshots"):
            facts = [x.business_id for x in R.facts(spark, folder, name).collect()]
            assert len(facts) == len(rows) and set(facts) <= {x.id for x in known}
        # the values of an entity don't depend on the order either
        values = sorted((min(o for o, e in assigned if e == x.id), x.name, x.place_id, x.phone, x.website, x.lat, x.lng, x.first_seen, x.last_seen) for x in known)
        found.append((groups(assigned), list(map(str, values))))
    assert all(f == found[0] for f in found) and 1 < len(found[0][0]) < len(rows)
    assert any({100, 101, 102} <= set(g) for g in found[0][0]) != strict


def test_an_id_stays_when_older_rows_come(spark, tmp_path):
    R.ingest(spark.createDataFrame([observation(7, 10, "New", "p")], OBS), 0, str(tmp_path))
    R.ingest(spark.createDataFrame([observation(3, 1, "Old", "p"), observation(4, 2, "Else", "q", "5615263512")], OBS), 1, str(tmp_path))
    R.ingest(spark.createDataFrame([observation(9, 20, "Both", "p", "5615263512")], OBS), 2, str(tmp_path))
    assert [(x.id, x.name, x.phone, x.first_seen) for x in R.entities(spark, str(tmp_path)).collect()] == [(4, "Old", "5615263512", 1)]
    assert {x.business_id for x in R.facts(spark, str(tmp_path)).collect()} == {4}


def test_empty_place_ids_match_nothing(spark):
    rows = [observation(1, 1, "A", ""), observation(2, 2, "B", " "), observation(3, 3, "C", "x"), observation(4, 4, "D", "x ")]
    assert {x.obs_id: x.business_id for x in R.resolve_entities(spark.createDataFrame(rows, OBS)).collect()} == {1: 1, 2: 2, 3: 3, 4: 3}


@pytest.mark.parametrize("seed", [1, 2])
def test_close_names_equal_brute_force(spark, seed):
    r = random.Random(seed)
    names = {"".join(r.choice("ab c") for _ in range(r.randint(1, 12))).strip() or "a" for _ in range(150)}
    names |= {n[:k] + r.choice(["", "x", "xy"]) + n[k + r.randint(0, 2) :] or "b" for n in sorted(names) for k in [r.randrange(len(n))]}
    rows = [(r.choice("pq"), n) for n in sorted(names)]
    df = spark.createDataFrame(rows, "norm_phone string, norm_name string")
    got = R.close_names(df, df).collect()
    want = {(p, a, b) for p, a in rows for q, b in rows if p == q and distance(a, b) <= 3}
    assert {(x.norm_phone, x.norm_name, x.other_norm_name) for x in got} == want and len(got) == len(want)


def test_short_names_equal_brute_force(spark):
    """All names of up to three letters, the empty one too, and some about the length from which names are cut into parts."""
    r = random.Random(5)
    names = ["", *("".join(x) for n in (1, 2, 3) for x in itertools.product("ab", repeat=n)), "aaaaaaaaaaaa", "abababababab", "aaaaaaaaaaab"]
    names += ["".join(r.choice("ab0") for _ in range(r.randint(9, 15))) for _ in range(80)]
    rows = sorted(set(names))
    df = spark.createDataFrame([("p", n) for n in rows], "norm_phone string, norm_name string")
    got = [(x.norm_name, x.other_norm_name) for x in R.close_names(df, df).collect()]
    assert sorted(got) == sorted((a, b) for a in rows for b in rows if distance(a, b) <= 3)


def test_keys_of_names_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(R, "TASK_NAMES", 10, raising=False)
    df = spark.range(200).select(F.lit("p").alias("norm_phone"), F.md5(F.col("id").cast("string")).substr(1, 8).alias("norm_name"))
    plan = R.close_names(df, df)._jdf.queryExecution().optimizedPlan().toString()
    assert ", 20" in plan and "Repartition" in plan


def test_most_find_their_earliest_close_name_without_pairs(spark, monkeypatch):
    """A phone of names that are nearly all close to one another, and some that aren't close to the first ones."""
    r, paired, made = random.Random(3), [], R.close_names
    monkeypatch.setattr(R, "close_names", lambda left, right: paired.append(left.count()) or made(left, right))
    names = [f"shop {i:010d} of the bay" for i in r.sample(range(1000), 300)] + ["".join(r.choice("xyz") for _ in range(14)) for _ in range(40)]
    names = [*names[:250], *names[300:], *names[250:300], *(n[:-1] + "q" for n in names[300:])]
    rows = [observation(i, i // 2, n, phone="5615263512") for i, n in enumerate(dict.fromkeys(names))]
    edges = R.match_edges(spark.createDataFrame(rows, OBS), phone_requires_name=True)
    got = {x.obs_id: x.parent.obs_id for x in edges.filter("rule = 'fuzzy_name_phone'").collect()}
    first = {x[0]: next(y[0] for y in rows if distance(x[2], y[2]) <= 3) for x in rows}
    assert got == {x: y for x, y in first.items() if x != y}
    assert sum(paired) <= 90  # only those that none of the first ones is close to


def test_keys_of_observations_are_worked_out_once(spark):
    edges = R.match_edges(spark.createDataFrame([observation(1, 1, phone="5615263512"), observation(2, 2, phone="5615263512")], OBS))
    assert "regexp" not in edges._jdf.queryExecution().optimizedPlan().toString() and edges.count() == 1


def test_cells_of_places_are_not_broadcast(spark):
    places = spark.createDataFrame([("a", 1.0, 2.0), ("a", 1.0001, 2.0), ("b", 1.0, 2.0)], "norm_name string, lat double, lng double")
    pairs = R.near_places(places, places)
    assert pairs.count() == 5 and "BroadcastHashJoin" not in pairs._jdf.queryExecution().executedPlan().toString()


def test_many_names_on_one_phone(spark):
    n = 20_000
    df = spark.range(n).select(F.lit("p").alias("norm_phone"), F.md5((F.col("id") / 2).cast("long").cast("string")).substr(F.lit(1), (18 + F.col("id") % 2).cast("int")).alias("norm_name"))
    pairs = R.close_names(df, df)
    assert pairs.filter("norm_name <> other_norm_name").count() >= n  # each finds its twin
    met = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "piece" in met  # names meet by their parts


def miles(a, b):
    y, x = math.radians(b[0] - a[0]), math.radians(b[1] - a[1])
    h = math.sin(y / 2) ** 2 + math.cos(math.radians(a[0])) * math.cos(math.radians(b[0])) * math.sin(x / 2) ** 2
    return 2 * 3958.8 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


@pytest.mark.parametrize(("lat", "lng", "spread"), [(26.0, -80.0, 0.3), (26.0, 180.0, 0.3), (-61.0, -180.0, 0.6), (89.85, 10.0, 0.2), (-89.99, 0.0, 0.02), (90.0, 0.0, 0.0)])
def test_nearest_equals_brute_force(spark, lat, lng, spread):
    r = random.Random(3)
    stretch = min(180.0, spread / max(math.cos(math.radians(lat)), 1e-3))
    places = [(i, max(-90.0, min(90.0, lat + r.gauss(0, 1) * spread / 3)), (lng + r.uniform(-1, 1) * stretch + 540) % 360 - 180) for i in range(120)]
    places += [(200 + i, *places[0][1:]) for i in range(12)]  # many at one place
    df = spark.createDataFrame(places, "id long, lat double, lng double")
    got = sorted((x.id, x.nth, x.other) for x in G.nearest(df.filter("id % 3 = 0"), df, 9, 4).collect())
    want = []
    for i, *a in places:
        if i % 3 == 0:
            near = sorted((round(miles(a, b), 6), j) for j, *b in places if j != i and miles(a, b) <= 9)[:4]
            want += [(i, k + 1, j) for k, (_, j) in enumerate(near)]
    assert got == sorted(want) and want


@pytest.mark.parametrize(("lat", "lng"), [(26.0, 180.0), (-45.0, -180.0), (89.95, 40.0), (89.899, 0.0), (-90.0, 0.0)])
def test_near_places_meet_at_the_edges_of_the_map(spark, lat, lng):
    r = random.Random(4)
    wide = 0.0006 / max(math.cos(math.radians(lat)), 1e-4)
    places = [("n", max(-90.0, lat + r.uniform(-0.0006, 0.0006)) if lat > -90 else -90 + r.uniform(0, 0.0006), (lng + r.uniform(-1, 1) * min(wide, 180) + 540) % 360 - 180, i) for i in range(60)]
    df = spark.createDataFrame(places, "norm_name string, lat double, lng double, id int")
    got = R.near_places(df, df).select("id", "other_id").distinct().collect()
    want = {(a[3], b[3]) for a in places for b in places if miles(a[1:3], b[1:3]) < R.NEAR_MILES}
    assert {tuple(x) for x in got} == want and len(want) > 60


def test_components_and_links(spark):
    r = random.Random(5)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(40)] + [(5000, 5000), (None, 3)]
    root = {x: x for e in edges if None not in e for x in e}
    for _ in range(300):
        for a, b in edges:
            if a is not None:
                root[a] = root[b] = min(root[a], root[b])
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {x.node: x.root for x in got} == root and len(got) == len(root)
    assert not components(spark.createDataFrame([], "a long, b long")).collect()
    chain = spark.createDataFrame([(i, i + 1) for i in range(37)] + [(100, 37)], "old long, id long")
    assert {x.old: x.id for x in followed(chain).collect()} == {i: 37 for i in [*range(37), 100]}


@pytest.mark.parametrize("groups", [[], ["g"]])
def test_numbers_follow_the_order_in_every_group(spark, groups):
    r = random.Random(6)
    rows = [(r.choice(["a", "a", "a", "b", None]), r.choice([None, *range(40)]), i) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, x int, i int").repartition(7)
    got = numbered(df, groups, [F.desc("x"), "i"], "nth", "size").collect()
    for g in {x[0] for x in rows} if groups else {"all"}:
        mine = sorted((x for x in rows if not groups or x[0] == g), key=lambda x: (x[1] is None, -(x[1] or 0), x[2]))
        assert sorted((x.nth, x.i) for x in got if not groups or x.g == g) == [(n, x[2]) for n, x in enumerate(mine)]
        assert {x["size"] for x in got if not groups or x.g == g} == {len(mine)}
    held = {x for x in itertools.chain.from_iterable([[r.g] for r in got])}
    assert held == {"a", "b", None} and not numbered(df.limit(0), groups, ["x"]).collect()


def test_dense_towns_begin_with_smaller_cells(spark, monkeypatch):
    """A reach of forty miles over a town of one: rings are added until cells hold few, and the nearest stay the same."""
    def town(n, spread):
        return spark.range(n).select("id", (26 + spread * (F.col("id") * 37 % n) / n).alias("lat"), (-80 - spread * (F.col("id") * 91 % n) / n).alias("lng"))

    dense, wide = town(2_000, 0.01), town(20, 1.0)
    few = lambda df: df.select(F.col("lat").alias("lat2"), F.col("lng").alias("lng2"))
    assert G._rings(dense, few(dense), 40, 3) > 5 and G._rings(wide, few(wide), 40, 3) == 3
    df = dense.unionByName(wide.withColumn("id", F.col("id") + 2_000))
    asked = df.filter("id % 50 = 0")
    got = sorted(tuple(r) for r in G.nearest(asked, df, 40, 4).select("id", "nth", "other").collect())
    monkeypatch.setattr(G, "MET", 1 << 60)  # the rings as they were
    assert got == sorted(tuple(r) for r in G.nearest(asked, df, 40, 4).select("id", "nth", "other").collect()) and len(got) > 160
