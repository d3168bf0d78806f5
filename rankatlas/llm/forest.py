"""Near duplicates by a MinHash LSH forest over word shingles, exact verification, and classes.

Each tree of the forest sorts texts by a string of minima; texts that share a prefix meet there.
Prefixes start at their full depth and are shortened until a pair at the threshold meets in some
tree with the target's chance, and until of the pairs that some probe texts really have, found by
brute force, as large a share meets. Where a shortened prefix gathers too many texts, it grows back
to its full depth, and those texts are hung into as many more trees as make up for it. Every pair
that is proposed is verified on whole shingle sets.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .arrays import Rolling, let_go, mix, pieces, spans, text_bytes, word_hashes, words
from .frames import checkpoint


def meeting_chance(similarity: float, depth: int, trees: int) -> float:
    """Of a pair, to share a prefix of this depth in one of the trees."""
    return 1 - (1 - similarity**depth) ** trees


def shortened(threshold: float, trees: int, deepest: int, target: float, met: dict[int, int]) -> int:
    """The longest prefix that reaches the target both for a pair at the threshold and for the pairs measured.

    met: how many pairs have this as their deepest common prefix in any tree.
    """
    pairs = sum(met.values())
    for depth in range(deepest, 0, -1):
        found = sum(n for d, n in met.items() if d >= depth)
        if meeting_chance(threshold, depth, trees) >= target and found >= target * pairs:
            return depth
    return 1


def more_trees(threshold: float, deepest: int, target: float) -> int:
    """How many trees give a pair at the threshold the target's chance at full depth."""
    return math.ceil(math.log(1 - target) / math.log(1 - threshold**deepest))


def shingles(data: np.ndarray, at: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of `size` words of texts that lie end to end, and n + 1 offsets into them."""
    start, end, first = words(data, at)
    grams = Rolling(word_hashes(data, start, end)).grams(size)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))[: len(grams)]
    ok = np.arange(len(grams)) + size <= first[1:][text]
    return grams[ok], np.concatenate([[0], np.cumsum(np.maximum(np.diff(first) - size + 1, 0))])


def _minima(grams: np.ndarray, first: np.ndarray, trees: int, deepest: int, depth: int, seed: int) -> np.ndarray:
    """Of each nonempty range of grams, by tree, the first `depth` of its `deepest` minima."""
    rng = np.random.default_rng(seed)
    factors = rng.integers(1, 1 << 63, trees * deepest, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    terms = rng.integers(0, 1 << 63, trees * deepest, dtype=np.uint64)
    used = [x.reshape(trees, deepest)[:, :depth].ravel() for x in (factors, terms)]
    return np.stack([np.minimum.reduceat((grams * f + t) >> np.uint64(32), first) for f, t in zip(*used, strict=True)], 1).reshape(len(first), trees, depth)


def _prefixes(minima: np.ndarray, seed: int) -> np.ndarray:
    """A hash of each tree's string of minima."""
    out = np.zeros(minima.shape[:2], np.uint64) + np.arange(minima.shape[1], dtype=np.uint64) + np.uint64(seed << 32)
    for d in range(minima.shape[2]):
        out = mix(out * np.uint64(31) + minima[:, :, d])
    return out


_BASE, _MORE = 11, 12


def _mark_rows(keys: pa.Array, has: np.ndarray, prefix: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([keys.take(pa.array(np.repeat(has, prefix.shape[1]))), pa.array(prefix.ravel().view(np.int64))], ["text_key", "prefix"])


def _marks(size: int, trees: int, deepest: int, depth: int):
    def run(batches):
        let_go()
        for batch in batches:
            for part in pieces(batch, "text"):
                grams, first = shingles(*text_bytes(part.column("text")), size)
                has = np.nonzero(np.diff(first) > 0)[0]
                if len(has):
                    yield _mark_rows(part.column("text_key"), has, _prefixes(_minima(grams, first[has], trees, deepest, depth, _BASE), _BASE))

    return run


def _more_marks(trees: int, deepest: int):
    """Of shingle sets, at full depth."""

    def run(batches):
        for batch in batches:
            for part in pieces(batch, "shingles"):
                data, at = text_bytes(part.column("shingles"))
                first = at // 8
                has = np.nonzero(np.diff(first) > 0)[0]
                if len(has):
                    yield _mark_rows(part.column("text_key"), has, _prefixes(_minima(np.frombuffer(data.tobytes(), np.uint64), first[has], trees, deepest, deepest, _MORE), _MORE))

    return run


def _measured(probes: list[tuple[bytes, np.ndarray]], size: int, threshold: float, trees: int, deepest: int):
    """The pairs of texts and probes over the threshold, by brute force, as counts of their deepest common prefixes."""
    keys, sets = [k for k, _ in probes], [v for _, v in probes]
    lengths = np.array([len(v) for v in sets])
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    known, begin, count = np.unique(flat[order], return_index=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), lengths)[order]
    theirs = _minima(flat, np.cumsum(lengths) - lengths, trees, deepest, deepest, _BASE)
    may = np.zeros(1 << 20, bool)
    may[(known >> np.uint64(44)).astype(np.int64)] = True

    def run(batches):
        met = np.zeros(deepest + 1, np.int64)
        for batch in batches:
            for part in pieces(batch, "text"):
                grams, first = shingles(*text_bytes(part.column("text")), size)
                at = np.nonzero(may[(grams >> np.uint64(44)).astype(np.int64)])[0]
                where = np.minimum(np.searchsorted(known, grams[at]), len(known) - 1)
                hit = known[where] == grams[at]
                text = np.searchsorted(first, at[hit], side="right") - 1
                pair = np.unique(text * len(known) + where[hit])
                text, where = pair // len(known), pair % len(known)
                n = count[where]
                common = np.repeat(text, n) * len(sets) + owner[np.repeat(begin[where], n) + spans(n)]
                common, shared = np.unique(common, return_counts=True)
                text, probe = common // len(sets), common % len(sets)
                near = shared >= threshold * lengths[probe] - 1e-9
                for t, p, c in zip(text[near].tolist(), probe[near].tolist(), shared[near].tolist(), strict=True):
                    own = np.unique(grams[first[t] : first[t + 1]])
                    if c < threshold * (len(own) + lengths[p] - c) - 1e-9 or part.column("text_key")[t].as_py() == keys[p]:
                        continue
                    same = _minima(own, np.zeros(1, np.int64), trees, deepest, deepest, _BASE)[0] == theirs[p]
                    met[int(np.cumprod(same, axis=1).sum(1).max())] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(deepest + 1)), pa.array(met)], ["depth", "pairs"])

    return run


def measure(keyed: DataFrame, probes: int, longest: int, size: int, threshold: float, trees: int, deepest: int) -> dict[int, int]:
    """By depth, the linked pairs of some probe texts with all texts that have it as their deepest common prefix.

    Probes are a bounded sample for choosing the depth only: at most `probes` texts of at most
    `longest` bytes, those of least key hash.
    """
    # keys first, so that no task sends texts that aren't chosen
    keys = keyed.filter(F.octet_length("text") <= longest).select("text_key").orderBy(F.xxhash64("text_key"), "text_key").limit(probes).distinct()
    sample = keyed.join(F.broadcast(keys), "text_key").dropDuplicates(["text_key"]).collect()
    chosen = {}
    for r in sample:
        grams, first = shingles(*text_bytes(pa.array([r.text])), size)
        if first[-1]:
            chosen[bytes(r.text_key)] = np.unique(grams)
    if not chosen:
        return {}
    found = keyed.mapInArrow(_measured(list(chosen.items()), size, threshold, trees, deepest), "depth long, pairs long")
    return {r.depth: r.n for r in found.groupBy("depth").agg(F.sum("pairs").alias("n")).collect()}


def _common(x: list[np.ndarray], y: list[np.ndarray], width: int = 2048) -> np.ndarray:
    """How many values each set of x has in common with each of y: products of 0/1 matrices, `width` values at a time."""
    flat = [np.concatenate(s) if s else np.zeros(0, np.uint64) for s in (x, y)]
    shared = np.intersect1d(*flat)
    out = np.zeros((len(x), len(y)), np.float32)
    cells = []
    for s, values in zip((x, y), flat, strict=True):
        at = np.searchsorted(shared, values)
        ok = shared[np.minimum(at, len(shared) - 1)] == values if len(shared) else np.zeros(len(values), bool)
        row, at = np.repeat(np.arange(len(s)), [len(v) for v in s])[ok], at[ok]
        order = np.argsort(at, kind="stable")
        cells.append((row[order], at[order]))
    for first in range(0, len(shared), width):
        sides = []
        for s, (row, at) in zip((x, y), cells, strict=True):
            lo, hi = np.searchsorted(at, [first, first + width])
            m = np.zeros((len(s), min(width, len(shared) - first)), np.float32)
            m[row[lo:hi], at[lo:hi] - first] = 1
            sides.append(m)
        out += sides[0] @ sides[1].T
    return out


def _stars(linked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of a symmetric 0/1 matrix: each node that isn't the first of its component, and that first one."""
    new, nodes, heads = linked.any(1), [], []
    for head in np.nonzero(new)[0].tolist():
        if not new[head]:
            continue
        new[head], front = False, np.array([head])
        while len(front):
            front = np.nonzero(linked[front].any(0) & new)[0]
            new[front] = False
            nodes.append(front)
            heads.append(np.full(len(front), head))
    return (np.concatenate(nodes), np.concatenate(heads)) if nodes else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _block_links(threshold: float):
    """Of two blocks of a crowd (or one and itself): each text's links, and edges that join what is linked.

    A pair that meets in several crowds is counted in the one of least prefix.
    """

    def run(group: pa.Table) -> pa.Table:
        key, block = group.column("text_key").combine_chunks(), np.asarray(group.column("block"))
        prefix, i, j = (group.column(c)[0].as_py() for c in ("prefix", "i", "j"))
        sets = [np.frombuffer(v, np.uint64) for v in group.column("shingles").to_pylist()]
        others = [np.array([c for c in v if c < prefix], np.int64) for v in group.column("crowds").to_pylist()]
        left, right = np.nonzero(block == i)[0], np.nonzero(block == j)[0]
        pick = lambda s: ([s[k] for k in left], [s[k] for k in right])
        sizes = np.array([len(s) for s in sets], np.float64)
        common = _common(*pick(sets)).astype(np.float64)
        similar = common >= threshold * (sizes[left][:, None] + sizes[right][None, :] - common) - 1e-9
        similar &= _common(*pick(others)) == 0
        if i == j:
            np.fill_diagonal(similar, False)
        linked = np.zeros((len(sets), len(sets)), bool)
        linked[np.ix_(left, right)] = similar
        linked |= linked.T
        n = linked.sum(1)
        has = np.nonzero(n)[0]
        node, head = _stars(linked)
        keys = pa.concat_arrays([key.take(pa.array(has)), key.take(pa.array(node))])
        heads = pa.concat_arrays([pa.nulls(len(has), key.type), key.take(pa.array(head))])
        counts = pa.concat_arrays([pa.array(n[has], pa.int64()), pa.nulls(len(node), pa.int64())])
        return pa.Table.from_arrays([keys, heads, counts], ["text_key", "head", "n"])

    return run


def _sets(size: int):
    def run(batches):
        let_go()
        for batch in batches:
            for part in pieces(batch, "text"):
                data, at = text_bytes(part.column("text"))
                grams, first = shingles(data, at, size)
                packed = [np.unique(grams[a:b]).tobytes() for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("text_key"), pa.array(packed, pa.binary())], ["text_key", "shingles"])

    return run


def components(links: DataFrame) -> DataFrame:
    """node, label: the least node that each node of the links (a, b) is connected with.

    Each round takes the least label among neighbours and then that label's own label, and is cut
    by a checkpoint; the driver sees one count a round. Minima are summed before the shuffle.
    """
    both = checkpoint(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = checkpoint(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")))
    while True:
        spread = both.join(labels.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("near"))
        jumped = labels.select(F.col("node").alias("label"), F.col("label").alias("above"))
        new = labels.join(jumped, "label", "left").join(spread.withColumnRenamed("a", "node"), "node")
        new = checkpoint(new.select("node", F.least("label", "above", "near").alias("label"), (F.least("above", "near") < F.col("label")).alias("moved")))
        if not new.filter("moved").limit(1).count():
            return new.select("node", "label")
        labels = new.select("node", "label")


def near_duplicates(docs: DataFrame, size: int = 5, threshold: float = 0.8, trees: int = 16, deepest: int = 8, target: float = 0.999, crowd: int = 32, gathered: int = 1024, block: int = 1024, probes: int = 200, longest_probe: int = 1 << 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Classes of texts whose shingle sets have a Jaccard similarity of `threshold` or more.

    Returns a row a row of docs: doc_id, text_key (md5 of the text), class_key, class_id (least id
    in the class, null if none has one), n_copies (rows with this text) and n_links (verified links
    to other texts). Shingles are `size` words `[^\\x20\\x09-\\x0D]+`; a text with fewer words,
    an empty or null one has none and is only linked with copies of itself; a text of any length is
    one set. Equal texts are one node, so copies make no pairs; other columns are ignored; an empty
    table gives no rows.

    The depth of prefixes is shortened() by what measure() finds. Up to `crowd` texts under a prefix
    are paired as rows. A larger crowd is compared whole: cut into blocks of about `block` texts and
    4 MB of shingles, each two blocks in a task of their own, which returns counts and joining edges
    instead of pairs. Where a prefix has over `gathered` texts, they go into more_trees() at full
    depth instead, which all but 0.00001 of pairs at the threshold meet in; crowds there, near
    copies for the most part, are compared whole at any size. So no link is lost to a crowd's size,
    and of very many texts that only resemble each other, those are compared that share a whole
    string of minima.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keyed = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), F.unhex(F.md5(text.cast("binary"))).alias("text_key"))
    nodes, keyed = keyed.select("doc_id", "text_key"), keyed.select("text_key", "text")
    depth = shortened(threshold, trees, deepest, target, measure(keyed, probes, longest_probe, size, threshold, trees, deepest))
    marks = checkpoint(keyed.mapInArrow(_marks(size, trees, deepest, depth), "text_key binary, prefix long").distinct())
    sizes = lambda rows: rows.groupBy("prefix").agg(F.count("*").alias("texts")).filter("texts > 1")

    def paired(rows: DataFrame, full: DataFrame) -> DataFrame:
        few = rows.join(full.filter(F.col("texts") <= crowd).select("prefix"), "prefix").select("prefix", "text_key")
        return few.withColumnRenamed("text_key", "a").join(few.withColumnRenamed("text_key", "b"), "prefix").filter("a < b").select("a", "b")

    full = sizes(marks)
    near = checkpoint(paired(marks, full).distinct())
    crowd_rows = checkpoint(marks.join(full.filter(F.col("texts") > crowd), "prefix"))
    needed = near.select(F.explode(F.array("a", "b")).alias("text_key")).unionByName(crowd_rows.select("text_key")).distinct()
    sets = checkpoint(keyed.join(needed, "text_key").mapInArrow(_sets(size), "text_key binary, shingles binary").dropDuplicates(["text_key"]))
    too_many = crowd_rows.filter(F.col("texts") > gathered).select("text_key").distinct()
    deep = checkpoint(sets.join(too_many, "text_key", "left_semi").mapInArrow(_more_marks(more_trees(threshold, deepest, 0.99999), deepest), "text_key binary, prefix long"))
    deep_full = sizes(deep)
    proposed = checkpoint(near.unionByName(paired(deep, deep_full)).distinct())
    deep_crowds = deep.join(deep_full.filter(F.col("texts") > crowd).select("prefix"), "prefix").select("prefix", "text_key")
    many = checkpoint(crowd_rows.filter(F.col("texts") <= gathered).select("prefix", "text_key").unionByName(deep_crowds))
    crowds = many.groupBy("text_key").agg(F.collect_set("prefix").alias("crowds"))
    sets = sets.join(crowds, "text_key", "left")

    members = sets.filter("crowds is not null").withColumn("prefix", F.explode("crowds"))
    wide = F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum(F.octet_length("shingles").cast("long")) / (4 << 20))).cast("int")
    dealt = members.join(members.groupBy("prefix").agg(wide.alias("blocks")), "prefix").withColumn("block", F.pmod(F.xxhash64("text_key"), F.col("blocks")).cast("int"))
    dealt = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"i": F.least("block", "with"), "j": F.greatest("block", "with")})
    compared = dealt.select("prefix", "i", "j", "block", "text_key", "shingles", "crowds").groupBy("prefix", "i", "j").applyInArrow(_block_links(threshold), "text_key binary, head binary, n long")
    crowded = checkpoint(compared)

    @pandas_udf("boolean")
    def similar(x: pd.Series, y: pd.Series) -> pd.Series:
        out = []
        for a, b in zip(x, y, strict=True):
            a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
            if min(len(a), len(b)) < threshold * max(len(a), len(b)) - 1e-9:
                out.append(False)
                continue
            common = len(a) + len(b) - len(np.union1d(a, b))
            out.append(common >= threshold * (len(a) + len(b) - common) - 1e-9)
        return pd.Series(out, dtype=bool)

    with_b = proposed.join(sets.select(F.col("text_key").alias("b"), F.col("shingles").alias("theirs"), F.col("crowds").alias("their_crowds")), "b")
    with_both = with_b.join(sets.select(F.col("text_key").alias("a"), "shingles", "crowds"), "a").filter(~F.coalesce(F.arrays_overlap("crowds", "their_crowds"), F.lit(False)))
    links = checkpoint(with_both.filter(similar("shingles", "theirs")).select("a", "b"))
    edges = crowded.filter("head is not null").select(F.col("text_key").alias("a"), F.col("head").alias("b"))
    label = components(links.unionByName(edges)).select(F.col("node").alias("text_key"), F.col("label").alias("linked"))
    degree = links.select(F.explode(F.array("a", "b")).alias("text_key"), F.lit(1).cast("long").alias("n")).unionByName(crowded.filter("n is not null").select("text_key", "n"))
    degree = degree.groupBy("text_key").agg(F.sum("n").alias("n_links"))
    texts = nodes.groupBy("text_key").agg(F.count("*").alias("n_copies"), F.min("doc_id").alias("least"))
    texts = texts.join(label, "text_key", "left").join(degree, "text_key", "left").select("text_key", "n_copies", "least", F.coalesce("linked", "text_key").alias("class_key"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    classes = texts.groupBy("class_key").agg(F.min("least").alias("class_id"))
    name = lambda c: F.lower(F.hex(c)).alias(c)
    return nodes.join(texts.drop("least").join(classes, "class_key"), "text_key").select("doc_id", name("text_key"), name("class_key"), "class_id", "n_copies", "n_links")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """The rows of docs, one of each class: the one of least id; those without id come last, then the least md5 of the text.

    Of rows that agree in id and text, the one whose other columns come first as JSON stays. Null
    and empty texts are one class of equal texts; a text of any length is one row; columns may have
    any names; an empty table gives no rows.
    """
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, **more)
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    key, least, nth = (next(n for n in (x + "_" * i for i in range(99)) if n not in docs.columns) for x in ("__key", "__least", "__nth"))
    first = found.groupBy("class_key").agg(F.min(place).alias("f")).select(F.col("f.doc_id").alias(least), F.col("f.text_key").alias(key))
    id_ = F.col(f"`{id_col}`").cast("long")
    marked = docs.withColumn(key, F.md5(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary")))
    stay = marked.join(first.withColumnRenamed(key, key + "2"), (F.col(key) == F.col(key + "2")) & id_.eqNullSafe(F.col(least)), "left_semi")
    rest = F.to_json(F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != text_col)))
    return stay.withColumn(nth, F.row_number().over(Window.partitionBy(key, id_).orderBy(rest))).filter(F.col(nth) == 1).select(*(F.col(f"`{c}`") for c in docs.columns))


def digests(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "class_id", "n_copies", "n_links", "text_key", "class_key")
