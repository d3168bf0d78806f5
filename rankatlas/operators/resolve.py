"""Resolving observed listings into businesses, set-based, and merging their attributes."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankatlas.functions.scalars import engine_family, haversine_miles, names_close, non_empty, normalize_domain, normalize_name, normalize_phone
from rankatlas.operators.components import components, followed
from rankatlas.operators.geo import cells_around, own_cells
from rankatlas.operators.lineage import checkpoint

# Confidence of each rule, in the order in which they are tried.
RULES = {"place_id": 100, "phone": 90, "name_location": 95, "fuzzy_name_phone": 85, "domain_city": 80}
NEAR_MILES = 0.031
#: Degrees of latitude in NEAR_MILES; the side of a cell.
CELL = NEAR_MILES / 69.0
#: Edits that names may be apart, and the parts a name is cut into, of which one at least is then untouched.
EDITS, PARTS = 3, 4
#: Names of up to so many characters meet by what is left of them without EDITS characters; of longer ones there would be too many rests.
SHORT = 12
#: Names to a task: their keys are about a hundred times as many.
TASK_NAMES = 15_000
#: Observations to a task where their names, phones and sites are normalised.
TASK_OBSERVATIONS = 100_000
#: Places to a task where they meet in cells, about nine rows each.
TASK_PLACES = 100_000
#: How many of a phone's earliest names are looked through at once for a close one, before pairs are made.
LOOKS = (16, 64)


def _when() -> Column:
    return F.struct("observed_at", "obs_id")


def _earliest(df: DataFrame, keys: list[str], rule: str) -> DataFrame:
    """Edges to the earliest observation with the same keys: minima summed before the shuffle, so no pairs in a group."""
    with_keys = df.dropna(subset=keys)
    first = with_keys.groupBy(*keys).agg(F.min(_when()).alias("parent"))
    return with_keys.join(first, keys).filter(_when() > F.col("parent")).select("obs_id", "parent", F.lit(rule).alias("rule"))


def near_places(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of places (name, lat, lng and their own columns) of one name and within NEAR_MILES; right's columns have `other_` before them.

    Places meet in cells: a left one looks into its own and all around it, a right one lies in its
    own. Cells are dealt by the places' number and merged: the ninefold rows of the left are no
    table to broadcast, however small they were before.
    """
    least = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(least, -(-max(left.count(), right.count()) // TASK_PLACES))
    there = right.select(*(F.col(c).alias(f"other_{c}") for c in right.columns), F.explode(own_cells(F.col("lat"), F.col("lng"), CELL)).alias("other_cell"))
    around = left.withColumn("cell", F.explode(cells_around(F.col("lat"), F.col("lng"), CELL)))
    around, there = around.repartition(parts, "cell", "norm_name"), there.repartition(parts, "other_cell", "other_norm_name")
    met = around.hint("merge").join(there, (F.col("cell") == F.col("other_cell")) & (F.col("norm_name") == F.col("other_norm_name")))
    return met.filter(haversine_miles(F.col("lat"), F.col("lng"), F.col("other_lat"), F.col("other_lng")) < NEAR_MILES).drop("cell", "other_cell")


def _near(df: DataFrame) -> DataFrame:
    """Edges between equal names at near places, from each to the earliest one of the other places.

    Observations of one name at one place are one candidate, so copies make no pairs.
    """
    placed = df.dropna(subset=["norm_name", "lat", "lng"]).filter("norm_name <> ''")
    places = checkpoint(placed.groupBy("norm_name", "lat", "lng").agg(F.min(_when()).alias("p")))
    earliest = near_places(places.drop("p"), places).groupBy("norm_name", "lat", "lng").agg(F.min("other_p").alias("parent"))
    return placed.join(earliest, ["norm_name", "lat", "lng"]).filter(_when() > F.col("parent")).select("obs_id", "parent", F.lit("name_location").alias("rule"))


def _part(size: Column, i: Column) -> tuple[Column, Column]:
    """Start and length of the i-th of PARTS even parts of a name of `size` characters; the last ones take what is over."""
    base, over = F.floor(size / PARTS).cast("int"), size % PARTS
    first_long = PARTS - over
    return i * base + F.greatest(i - first_long, F.lit(0)), base + (i >= first_long).cast("int")


def _cuts(spark: SparkSession, sizes: set[int]) -> DataFrame:
    """What a name of `size` characters loses to leave EDITS fewer than `of`, both of `sizes`, each way a row: the places p1 to p3, or places after its end."""
    gone = lambda size, of: combinations(range(1, size + 1), min(size, size - of + EDITS))
    rows = [(size, of, *g, *range(size + 1, size + 1 + EDITS - len(g))) for size in sizes for of in sizes & set(range(size, size + EDITS + 1)) for g in gone(size, of)]
    return spark.createDataFrame(rows, "size int, of int, p1 int, p2 int, p3 int").coalesce(1)


def close_names(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of names (norm_phone, norm_name) under one phone within EDITS; right's columns have `other_` before them.

    Names meet only where they share a key, however many one phone has. Where the longer one has
    up to SHORT characters, the two share all but EDITS of its characters in their order, and the
    key is such a rest of each. Of PARTS parts of a longer name one at least is untouched by fewer
    edits, and moves by no more than the edits that are left: it looks for each part of the lengths
    up to its own where it can stand. Keys are dealt by the number of names, and equal names meet
    as they are.
    """
    size, spark = F.length("norm_name"), left.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    alike = left is right
    found = [df.agg(F.count("*"), F.collect_set(F.when(size <= SHORT, size))).first() for df in ([left] if alike else [left, right])]
    parts = max(least, -(-max(n for n, _ in found) // TASK_NAMES))
    cuts = F.broadcast(_cuts(spark, {x for _, sizes in found for x in sizes}))
    # a small file is one task's, and so would all keys of its names be
    left = left.repartition(parts, "norm_phone", "norm_name")
    right = left if alike else right.repartition(parts, "norm_phone", "norm_name")

    meet = ["norm_phone", "of", "piece"]

    def dealt(df: DataFrame, columns: list[str]) -> DataFrame:
        return df.select(*columns, "of", "piece").repartition(parts, *meet)

    def rests_of(df: DataFrame) -> DataFrame:
        rows, name, char = df.join(cuts, size == F.col("size")), F.col("norm_name"), lambda p: F.substring("norm_name", p, F.lit(1))
        # of characters that are alike and stand together the first ones go, so that a rest comes about once
        for p, before in (("p1", F.lit(0)), ("p2", F.col("p1")), ("p3", F.col("p2"))):
            rows = rows.filter((F.col(p) == 1) | (F.col(p) > size) | (F.col(p) - 1 == before) | (char(F.col(p)) != char(F.col(p) - 1)))
        piece = lambda start, end: F.substring(name, F.col(start) + 1, F.col(end) - F.col(start) - 1)
        rest = F.concat(F.substring(name, F.lit(1), F.col("p1") - 1), piece("p1", "p2"), piece("p2", "p3"), F.substring(name, F.col("p3") + 1, size))
        return dealt(rows.withColumn("piece", F.xxhash64(rest)), df.columns)

    def parts_of(df: DataFrame) -> DataFrame:
        rows = df.filter(size > SHORT - EDITS).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
        start, n = _part(size, F.col("i"))
        return dealt(rows.withColumns({"of": size, "piece": F.xxhash64("i", F.substring("norm_name", start + 1, n))}), df.columns)

    def looked_for(df: DataFrame) -> DataFrame:
        rows = df.filter(size > SHORT).withColumn("less", F.explode(F.sequence(F.lit(0), F.lit(EDITS)))).withColumn("of", size - F.col("less")).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
        start, n = _part(F.col("of"), F.col("i"))
        back, ahead = F.floor((EDITS - F.col("less")) / 2).cast("int"), F.floor((EDITS + F.col("less")) / 2).cast("int")
        low, high = F.greatest(start - back, F.lit(0)), F.least(start + ahead, size - n)
        pieces = F.array_distinct(F.transform(F.when(low <= high, F.sequence(low, high)), lambda at: F.xxhash64("i", F.substring("norm_name", at + 1, n))))
        return dealt(rows.withColumn("piece", F.explode(pieces)), df.columns)

    gives = [*left.columns, *(f"other_{c}" for c in right.columns if c != "norm_phone")]
    longer = F.greatest(size, F.length("other_norm_name"))

    def met(a: DataFrame, b: DataFrame, only: Column) -> DataFrame:
        others = b.select(*meet, *(F.col(c).alias(f"other_{c}") for c in b.columns if c not in meet))
        pairs = a.join(others, meet).filter((F.col("norm_name") != F.col("other_norm_name")) & only)
        return pairs.filter(names_close(F.col("norm_name"), F.col("other_norm_name"), EDITS)).select(*gives)

    rests = rests_of(left)
    short = met(rests, rests if alike else rests_of(right), longer == F.col("of"))
    down = met(looked_for(left), parts_of(right), F.lit(True))
    up = met(parts_of(left), looked_for(right), F.lit(True))
    pairs = short.unionByName(down).unionByName(up).repartition(parts, "norm_phone", "norm_name").distinct()
    named = right.select("norm_phone", "norm_name", *(F.col(c).alias(f"other_{c}") for c in right.columns if c != "norm_phone"))
    return left.join(named, ["norm_phone", "norm_name"]).select(*gives).unionByName(pairs)


def with_keys(observations: DataFrame) -> DataFrame:
    """Observations with what the rules compare; what is empty is null and matches nothing."""
    return observations.withColumns({"place_id": non_empty(F.col("place_id")), "norm_name": non_empty(normalize_name(F.col("name"))), "norm_phone": normalize_phone(F.col("phone")), "domain": non_empty(normalize_domain(F.col("website"))), "low_city": non_empty(F.lower("city"))})


def _earliest_close(names: DataFrame) -> DataFrame:
    """Of names (norm_phone, norm_name, p) each with the least p of those close to it under its phone, itself included, as `parent`.

    A phone's first names are looked through in their order, so that where its names are close to
    one another most find theirs without making pairs; only those that find none there are paired.
    """
    order = Window.partitionBy("norm_phone").orderBy("p")
    first = names.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= sum(LOOKS)).groupBy("norm_phone").agg(F.array_sort(F.collect_list(F.struct("p", "norm_name"))).alias("first"))
    looks = [F.slice("first", sum(LOOKS[:i]) + 1, n) for i, n in enumerate(LOOKS)]
    found = [F.get(F.filter(x, lambda y: names_close(F.col("norm_name"), y["norm_name"], EDITS)), F.lit(0))["p"] for x in looks]
    looked = checkpoint(names.join(first, "norm_phone").select(*names.columns, F.coalesce(*found).alias("parent")))
    rest = looked.filter("parent IS NULL").select("norm_phone", "norm_name")
    others = names.join(rest.select("norm_phone").distinct(), "norm_phone", "left_semi")
    paired = close_names(rest, others).groupBy("norm_phone", "norm_name").agg(F.min("other_p").alias("parent"))
    return looked.filter("parent IS NOT NULL").select("norm_phone", "norm_name", "parent").unionByName(paired)


def match_edges(observations: DataFrame, phone_requires_name: bool = False) -> DataFrame:
    """Edges of all rules from each observation to an earlier one.

    What the rules compare is worked out once, by as many tasks as there are observations for, and kept.
    """
    least = int(observations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = observations.repartition(max(least, -(-observations.count() // TASK_OBSERVATIONS)), "obs_id")
    df = checkpoint(with_keys(dealt).select("obs_id", "observed_at", "place_id", "norm_name", "norm_phone", "domain", "low_city", "lat", "lng"))
    edges = _earliest(df, ["place_id"], "place_id").unionByName(_near(df)).unionByName(_earliest(df, ["domain", "low_city"], "domain_city"))
    if not phone_requires_name:
        return edges.unionByName(_earliest(df, ["norm_phone"], "phone"))
    names = df.dropna(subset=["norm_phone", "norm_name"]).groupBy("norm_phone", "norm_name").agg(F.min(_when()).alias("p"))
    near = _earliest_close(checkpoint(names))
    close = df.join(near, ["norm_phone", "norm_name"]).filter(_when() > F.col("parent"))
    return edges.unionByName(close.select("obs_id", "parent", F.lit("fuzzy_name_phone").alias("rule")))


def resolve_entities(observations: DataFrame, order: tuple[str, ...] = tuple(RULES), phone_requires_name: bool = False) -> DataFrame:
    """obs_id, business_id (the first observation of the entity), match_type and confidence.

    Each observation takes the first rule in `order` that gives it an earlier one, the earliest
    under that rule; following those to the end gives the entity. Observations without a match are
    new. Known businesses join as observations with the oldest times. Nulls match nothing. Merged
    attributes are not matched again; run it on the result once more for that.
    """
    rank = F.array_position(F.array(*(F.lit(r) for r in order)), F.col("rule"))
    best = match_edges(observations, phone_requires_name).withColumn("nth", rank).filter("nth > 0").groupBy("obs_id").agg(F.min(F.struct("nth", "parent", "rule")).alias("b"))
    tree = checkpoint(observations.select("obs_id").join(best, "obs_id", "left").select("obs_id", F.coalesce("b.parent.obs_id", "obs_id").alias("up"), F.col("b.rule").alias("rule")))
    while True:
        above = tree.select(F.col("obs_id").alias("up"), F.col("up").alias("top"))
        step = checkpoint(tree.join(above, "up").select("obs_id", F.col("top").alias("up"), "rule", (F.col("top") != F.col("up")).alias("moved")))
        tree = step.drop("moved")
        if not step.filter("moved").limit(1).count():
            break
    confidence = F.create_map(*(F.lit(x) for kv in RULES.items() for x in kv))
    return tree.select("obs_id", F.col("up").alias("business_id"), F.coalesce("rule", F.lit("new")).alias("match_type"), F.coalesce(confidence[F.col("rule")], F.lit(0)).alias("confidence"))


def survive(resolved: DataFrame, first: list[str], last: list[str], pairs: dict[str, list[str]], key: str = "business_id", when: str = "observed_at") -> DataFrame:
    """One row an entity: first-seen values, last non-null values, and groups of values that change together."""
    at = F.struct(when, "obs_id")
    aggs = [F.min_by(c, at).alias(c) for c in first] + [F.max_by(c, F.when(F.col(c).isNotNull(), at)).alias(c) for c in last]
    for name, columns in pairs.items():
        aggs.append(F.max_by(F.struct(*columns), F.when(F.col(columns[0]).isNotNull(), at)).alias(name))
    out = resolved.groupBy(key).agg(*aggs, F.max(when).alias("last_seen"))
    return out.select(key, *first, *last, *(F.col(f"{n}.{c}").alias(c) for n, cs in pairs.items() for c in cs), "last_seen")


def survive_by_source(resolved: DataFrame, columns: list[str], precedence: list[str], key: str = "business_id") -> DataFrame:
    """Each value from the best source that has one."""
    nth = F.array_position(F.array(*(F.lit(s) for s in precedence)), F.col("source"))
    return resolved.groupBy(key).agg(*(F.min_by(c, F.when(F.col(c).isNotNull() & (nth > 0), F.struct(nth.alias("n"), "observed_at", "obs_id"))).alias(c) for c in columns))


def build_facts(observations: DataFrame, resolved: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A ranking row an observation, and a review snapshot where rating and count are both there, by family of its source."""
    full = observations.join(resolved.select("obs_id", "business_id"), "obs_id")
    snapshots = full.filter("rating is not null and review_count is not null").select("business_id", engine_family(F.col("source"), strict=False).alias("source"), "rating", "review_count", F.col("observed_at").alias("captured"))
    return full.select("business_id", "point_id", "rank", "observed_at"), snapshots


#: What ingest() keeps under its folder, each written by batch and never again.
STATE = {
    "keys": "rule string, key string, id long",
    "places": "norm_name string, lat double, lng double, id long",
    "names": "norm_phone string, norm_name string, id long",
    "aliases": "old long, id long",
}
FIRST, LAST, TOGETHER = ("name", "city"), ("place_id", "phone", "website"), ("lat", "lng")


def _kept(spark: SparkSession, folder: str, name: str, number: int | None) -> DataFrame:
    """A table of the batches before `number`, or of all."""
    schema = f"{STATE[name]}, batch int"
    if number == 0:
        return spark.createDataFrame([], STATE[name])
    rows = spark.read.schema(schema).parquet(f"{folder}/{name}")
    return (rows if number is None else rows.filter(F.col("batch") < number)).drop("batch")


def _current(rows: DataFrame, aliases: DataFrame, column: str = "id") -> DataFrame:
    """Rows with today's ids."""
    new = aliases.select(F.col("old").alias(column), F.col("id").alias("_now"))
    return rows.join(new, column, "left").withColumn(column, F.coalesce("_now", column)).drop("_now").select(*rows.columns)


def _partial(rows: DataFrame) -> DataFrame:
    """Each entity's first and last values beside their times, which merge by the same minima and maxima."""
    at = _when()
    first = [F.min(F.struct(F.struct("observed_at", "obs_id").alias("at"), F.col(c).alias("value"))).alias(c) for c in FIRST]
    last = [F.max(F.when(F.col(c).isNotNull(), F.struct(at.alias("at"), F.col(c).alias("value")))).alias(c) for c in LAST]
    both = F.max(F.when(F.col(TOGETHER[0]).isNotNull(), F.struct(at.alias("at"), *TOGETHER))).alias("together")
    return rows.groupBy("id").agg(*first, *last, both, F.min("observed_at").alias("first_seen"), F.max("observed_at").alias("last_seen"))


def entities(spark: SparkSession, folder: str) -> DataFrame:
    """The businesses that ingest() knows: id, first-seen and last non-null values, first_seen and last_seen."""
    rows = _current(spark.read.parquet(f"{folder}/parts").drop("batch"), followed(_kept(spark, folder, "aliases", None)))
    merged = rows.groupBy("id").agg(*(F.min(c).alias(c) for c in FIRST), *(F.max(c).alias(c) for c in (*LAST, "together")), F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))
    return merged.select("id", *(F.col(f"{c}.value").alias(c) for c in (*FIRST, *LAST)), *(f"together.{c}" for c in TOGETHER), "first_seen", "last_seen")


def facts(spark: SparkSession, folder: str, name: str = "rankings") -> DataFrame:
    """Rankings, snapshots or assigned (obs_id to business_id) of all batches, under the ids of entities()."""
    return _current(spark.read.parquet(f"{folder}/{name}"), followed(_kept(spark, folder, "aliases", None)), "business_id")


def ingest(batch: DataFrame, number: int, folder: str, order: tuple[str, ...] = tuple(RULES), phone_requires_name: bool = False) -> None:
    """One batch of observations into the entities and facts under a folder; for ingest_stream().

    An entity is what the rules in `order` join, over any number of observations, so batches in any
    order give the same entities. Its id stays for good, or becomes an alias of another's when a
    batch joins the two; entities() and facts() follow aliases, so no fact loses its entity. A
    batch looks up only its own keys, and near places and names, among those that are kept; the
    graph that is solved has its observations and the entities it meets. Every table is appended
    to, under the batch's number, in place of an earlier try of the same batch; nothing is rewritten.
    """
    spark = batch.sparkSession
    seen = checkpoint(with_keys(batch.dropDuplicates(["obs_id"])))
    known = _kept(spark, folder, "aliases", number)
    known = followed(known) if number else known
    one = {"place_id": F.col("place_id"), "domain_city": F.concat_ws("\n", F.when(F.col("low_city").isNotNull(), F.col("domain")), F.when(F.col("domain").isNotNull(), F.col("low_city")))}
    if not phone_requires_name:
        one["phone"] = F.col("norm_phone")
    # equal keys: every row of a key is joined to the key's least id
    keyed = [seen.select(F.lit(rule).alias("rule"), non_empty(c).alias("key"), F.col("obs_id").alias("id")).filter("key IS NOT NULL") for rule, c in one.items() if rule in order]
    empty = spark.createDataFrame([], STATE["keys"])
    keys = checkpoint(reduce(DataFrame.unionByName, keyed, empty))
    held = _kept(spark, folder, "keys", number)
    held = checkpoint(_current(held.join(keys.select("rule", "key").distinct(), ["rule", "key"], "left_semi"), known)) if number else held
    rows = keys.unionByName(held)
    stars = rows.join(rows.groupBy("rule", "key").agg(F.min("id").alias("least")), ["rule", "key"]).select(F.col("id").alias("a"), F.col("least").alias("b"))
    edges = [stars, seen.select(F.col("obs_id").alias("a"), F.col("obs_id").alias("b"))]
    met = [held.select("id")]
    new = {"keys": keys.join(held.select("rule", "key"), ["rule", "key"], "left_anti")}

    def theta(name: str, columns: list[str], rule: str, wanted: DataFrame, near) -> None:
        """Edges of a rule that compares more than equal keys, within the batch and to what is kept."""
        nodes = checkpoint(wanted.groupBy(*columns).agg(F.min("obs_id").alias("id")))
        same = wanted.join(nodes, columns).select(F.col("obs_id").alias("a"), F.col("id").alias("b"))
        shared = "norm_name" if name == "places" else "norm_phone"
        old = _kept(spark, folder, name, number)
        old = checkpoint(_current(old.join(nodes.select(shared).distinct(), shared, "left_semi").select(*old.columns), known)) if number else old
        pairs = checkpoint(near(nodes, nodes.unionByName(old)).select(F.col("id").alias("a"), F.col("other_id").alias("b")))
        edges.extend([same, pairs])
        met.append(old.join(pairs.select(F.col("b").alias("id")), "id", "left_semi").select("id"))
        new[name] = nodes.join(old.select(*columns), columns, "left_anti")

    if "name_location" in order:
        theta("places", ["norm_name", "lat", "lng"], "name_location", seen.dropna(subset=["norm_name", "lat", "lng"]), near_places)
    if phone_requires_name and "fuzzy_name_phone" in order:
        theta("names", ["norm_phone", "norm_name"], "fuzzy_name_phone", seen.dropna(subset=["norm_phone", "norm_name"]), close_names)
    found = components(reduce(DataFrame.unionByName, edges))
    old = reduce(DataFrame.unionByName, met).distinct().withColumn("old", F.lit(True))
    marked = found.join(old, found.node == old.id, "left").select("node", "root", F.col("old").isNotNull().alias("old"))
    # an entity that is there keeps its id; of several the least one does
    named = marked.groupBy("root").agg(F.coalesce(F.min(F.when(F.col("old"), F.col("node"))), F.min("node")).alias("id"))
    final = checkpoint(marked.join(named, "root").select("node", "id", "old"))
    ids = final.select("node", F.col("id").alias("_id"))
    put = lambda df, name: df.write.mode("overwrite").parquet(f"{folder}/{name}/batch={number}")
    put(final.filter("old AND node <> id").select(F.col("node").alias("old"), "id"), "aliases")
    for name in ("keys", "places", "names"):
        rows = new[name].join(ids, F.col("id") == F.col("node")).withColumn("id", F.col("_id")).drop("node", "_id").distinct() if name in new else spark.createDataFrame([], STATE[name])
        put(rows, name)
    put(_partial(seen.join(ids, F.col("obs_id") == F.col("node")).withColumn("id", F.col("_id"))), "parts")
    assigned = final.select(F.col("node").alias("obs_id"), F.col("id").alias("business_id")).join(seen.select("obs_id"), "obs_id", "left_semi")
    put(assigned, "assigned")
    rankings, snapshots = build_facts(batch, assigned)
    put(rankings, "rankings")
    put(snapshots, "snapshots")
