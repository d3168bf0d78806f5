"""A dataset's Merkle manifest: a root for all rows, and for each row a witness that leads to it.

Leaves are appended in order. What is appended joins open subtrees of its height; the leaves under
both then have one more sibling in their witness. Aligned blocks of leaves are appended apart, and
their roots are appended to the next tree in turn, so no task sees more than one block.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankatlas.operators.numbering import numbered

from .frames import written
from .spellings import CRC32_SQL, crc32_sql


def digest(*parts: str) -> str:
    """Lowercase hex sha256 of the parts as one text."""
    return hashlib.sha256("".join(parts).encode()).hexdigest()


class Frontier:
    """An append-only sequence of nodes: its open subtrees from left to right, and each node's witness so far."""

    def __init__(self, keep: bool = True):
        self.open: list[tuple[int, str, int]] = []  # height, root and first node
        self.count = 0
        self.witness: list[list[str]] | None = [] if keep else None

    def append(self, node: str) -> None:
        self.open.append((0, node, self.count))
        self.count += 1
        if self.witness is not None:
            self.witness.append([])
        while len(self.open) > 1 and self.open[-1][0] == self.open[-2][0]:
            self._join()

    def _join(self) -> None:
        """The last two open subtrees, of one height, become one; each one's nodes get the other's root."""
        height, right, middle = self.open.pop()
        _, left, first = self.open.pop()
        if self.witness is not None:
            for w in self.witness[first:middle]:
                w.append(right)
            for w in self.witness[middle:]:
                w.append(left)
        self.open.append((height + 1, digest(left, right), first))

    def close(self, height: int = 0) -> str:
        """The root, at `height` at least: a subtree without a sibling becomes its own digest."""
        while len(self.open) > 1 or self.open[-1][0] < height:
            if len(self.open) > 1 and self.open[-1][0] == self.open[-2][0]:
                self._join()
            else:
                own, node, first = self.open[-1]
                self.open[-1] = (own + 1, digest(node), first)
        return self.open[0][1]


def height_of(size: int) -> int:
    """Levels above the leaves of a tree of `size` leaves."""
    return (size - 1).bit_length()


def fold(node: str, index: int, size: int, siblings: list[str]) -> tuple[str, list[str]]:
    """The root that a node at a place in a tree of `size` leaves leads to, and the siblings that are left."""
    used = 0
    while size > 1:
        if index ^ 1 < size:
            other, used = siblings[used], used + 1
            node = digest(other, node) if index & 1 else digest(node, other)
        else:
            node = digest(node)
        index, size = index >> 1, (size + 1) >> 1
    return node, siblings[used:]


def leaf(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    """The digest of a row: each field by its UTF-8 length and value, or a dash for null."""
    def field(c: Column) -> Column:
        value = c.cast("string")
        return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))

    return F.sha2(F.concat(*map(field, (doc_id, source, lang, n_chars, text))), 256)


def _in_order(block: pa.Table) -> tuple[pa.Table, list[str], int]:
    """A block's rows by index, their hashes, and the height at which its root stands."""
    block = block.sort_by("index")
    at = np.asarray(block.column("index"))
    if len(at) and (np.diff(at) != 1).any():
        raise ValueError("a block lacks a node or has one twice")
    return block, block.column("hash").to_pylist(), block.column("size")[0].as_py()


def block_roots(nodes: DataFrame, bits: int) -> DataFrame:
    """The roots of aligned blocks of 2**bits nodes, as nodes of the next tree: tree, index, size and hash."""
    def run(block: pa.Table) -> pa.Table:
        block, hashes, size = _in_order(block)
        frontier = Frontier(keep=False)
        for x in hashes:
            frontier.append(x)
        root = frontier.close(min(bits, height_of(size)))
        return pa.table({"tree": block.column("tree")[:1], "index": [block.column("index")[0].as_py() >> bits], "size": [-(-size >> bits)], "hash": [root]})

    return nodes.withColumn("block", F.shiftright("index", bits)).groupBy("tree", "block").applyInArrow(run, "tree long, index long, size long, hash string")


def witnesses(nodes: DataFrame, bits: int) -> DataFrame:
    """For nodes (tree, index, size, hash): tree, index, size, hash, top (their tree's root) and path, their siblings from below.

    Each round appends the roots of the blocks below, so there are as many rounds as digits of the
    largest tree's size in base 2**bits; paths grow on the way back.
    """
    if (nodes.agg(F.max("size")).first()[0] or 0) <= 1:
        return nodes.select("tree", "index", "size", "hash", F.col("hash").alias("top"), F.array().cast("array<string>").alias("path"))
    above = witnesses(written(block_roots(nodes, bits), "block-roots"), bits)

    def run(block: pa.Table, over: pa.Table) -> pa.Table:
        block, hashes, size = _in_order(block)
        frontier = Frontier()
        for x in hashes:
            frontier.append(x)
        frontier.close(min(bits, height_of(size)))
        rest = over.column("path")[0].as_py()
        out = block.select(["tree", "index", "size", "hash"])
        out = out.append_column("top", pa.array([over.column("top")[0].as_py()] * len(out), pa.string()))
        return out.append_column("path", pa.array([w + rest for w in frontier.witness], pa.list_(pa.string())))

    mine = nodes.withColumn("block", F.shiftright("index", bits)).groupBy("tree", "block")
    theirs = above.select("tree", F.col("index").alias("block"), "top", "path").groupBy("tree", "block")
    return mine.cogroup(theirs).applyInArrow(run, "tree long, index long, size long, hash string, top string, path array<string>")


def manifest(docs: DataFrame, tampered: Column | None = None, bits: int = 10, id_col: str = "doc_id", source_col: str = "source", lang_col: str = "lang", chars_col: str = "n_chars", text_col: str = "text") -> DataFrame:
    """A row a row of docs: doc_id, lang, index and size (its place in its language's tree), leaf, subroot, root, siblings, folded_root and verified.

    Within a language leaves ascend by id, nulls first, then by leaf; equal rows stand side by side.
    Languages ascend bytewise, null first. A tree's nodes join two by two, and a last one alone becomes its own
    digest, until one is left. Each leaf is folded again along its siblings; where `tampered` holds,
    the leaf is worked out anew from the row as it is then, with n_chars one higher (null stays), and
    so fails. Texts of any length are digested whole, null and empty ones differ; other columns are
    ignored, whatever their names; an empty table gives no rows.

    Texts are read once and never shuffled; rows of two digests are sorted by ranges. Blocks of
    2**bits leaves are groups of their own, however large a language, and equal rows are told apart
    by their place, so that they are dealt out too.
    """
    own, chars = F.col(id_col).cast("long"), F.col(chars_col).cast("long")
    of = lambda n: leaf(own, F.col(source_col), F.col(lang_col), n, F.col(text_col))
    shown = F.when(tampered & chars.isNotNull(), of(chars + 1)) if tampered is not None else F.lit(None).cast("string")
    rows = docs.select(own.alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), of(chars).alias("hash"), shown.alias("shown"), F.monotonically_increasing_id().alias("place"))
    leaves = numbered(written(rows, "leaves"), ["lang"], ["doc_id", "hash", "place"], "index", "size").drop("place")
    trees = written(numbered(leaves.filter("index = 0").select("lang", "size"), [], ["lang"], "tree"), "trees")
    named = written(leaves.drop("size").join(trees.withColumnRenamed("lang", "of"), F.col("lang").eqNullSafe(F.col("of"))).drop("of"), "numbered-leaves")
    blocks = witnesses(written(block_roots(named.select("tree", "index", "size", "hash"), bits), "block-roots"), bits)
    over = written(blocks.select("tree", F.col("index").alias("block"), "top", "path"), "block-witnesses")
    subroots = over.filter("block = 0").select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("index"), F.lit(trees.count()).cast("long").alias("size"), F.col("top").alias("hash"))
    tops = witnesses(written(subroots, "subroots"), bits).select(F.col("index").alias("tree"), F.col("size").alias("trees"), F.col("top").alias("root"), F.col("path").alias("root_path"))
    over = over.join(tops, "tree")

    def run(block: pa.Table, over: pa.Table) -> pa.Table:
        block, hashes, size = _in_order(block)
        frontier = Frontier()
        for x in hashes:
            frontier.append(x)
        frontier.close(min(bits, height_of(size)))
        path, to_root = over.column("path")[0].as_py(), over.column("root_path")[0].as_py()
        subroot, root, tree, trees = (over.column(c)[0].as_py() for c in ("top", "root", "tree", "trees"))
        siblings = [w + path + to_root for w in frontier.witness]
        folded = []
        for own, now, i, w in zip(hashes, block.column("shown").to_pylist(), block.column("index").to_pylist(), siblings, strict=True):
            middle, left = fold(now or own, i, size, w)
            folded.append(fold(middle, tree, trees, left)[0])
        n = len(block)
        out = {"doc_id": block.column("doc_id"), "lang": block.column("lang"), "index": block.column("index"), "size": block.column("size"), "leaf": block.column("hash")}
        out |= {"subroot": pa.array([subroot] * n), "root": pa.array([root] * n), "siblings": pa.array(siblings, pa.list_(pa.string())), "folded_root": pa.array(folded), "verified": pa.array([x == root for x in folded])}
        return pa.table(out)

    mine = named.withColumn("block", F.shiftright("index", bits)).groupBy("tree", "block")
    fields = "doc_id long, lang string, index long, size long, leaf string, subroot string, root string, siblings array<string>, folded_root string, verified boolean"
    return mine.cogroup(over.groupBy("tree", "block")).applyInArrow(run, fields)


#: What append() keeps under its folder, by batch: trees as they are after it, new and changed nodes of each round, changed subroots.
KEPT = {"trees": "tree long, lang string, size long, last_id long", "nodes": "tree long, index long, hash string", "subroots": "tree long, hash string"}


def _kept(docs: DataFrame, path: str, fields: str, number: int, keys: list[str]) -> DataFrame:
    """Rows of the batches before `number`, the newest for each key."""
    spark = docs.sparkSession
    if not number:
        return spark.createDataFrame([], fields)
    rows = spark.read.schema(f"{fields}, batch int").parquet(path).filter(F.col("batch") < number)
    others = [c for c in rows.columns if c not in (*keys, "batch")]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("r"))
    return newest.select(*keys, *(F.col(f"r.{c}").alias(c) for c in others))


def append(docs: DataFrame, folder: str, number: int, bits: int = 10, id_col: str = "doc_id", source_col: str = "source", lang_col: str = "lang", chars_col: str = "n_chars", text_col: str = "text") -> str | None:
    """Appends a batch of rows to the manifest kept under a folder; the new root, as manifest() has it for all rows so far (None: no rows).

    The kept rows aren't read again: new leaves take the places after a language's last one, only
    blocks with a new node are appended to, round by round, and everything is written under the
    batch's number in place of an earlier try of the same batch. Ids must be there and be greater
    than all that a language has; otherwise nothing is written and an error says so.
    """
    spark = docs.sparkSession
    own = F.col(id_col).cast("long")
    found = docs.select(own.alias("doc_id"), F.col(lang_col).cast("string").alias("lang"), leaf(own, F.col(source_col), F.col(lang_col), F.col(chars_col).cast("long"), F.col(text_col)).alias("hash"), F.monotonically_increasing_id().alias("place"))
    leaves = numbered(written(found, "leaves"), ["lang"], ["doc_id", "hash", "place"], "at", "more").drop("place")
    new = leaves.groupBy("lang").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"), F.max("more").alias("more"), F.count_if(F.col("doc_id").isNull()).alias("no_id"))
    trees = _kept(docs, f"{folder}/trees", KEPT["trees"], number, ["tree"])
    next_tree = (trees.agg(F.max("tree")).first()[0] if number else None) or 0
    met = written(new.join(trees.select(F.col("lang").alias("of"), "tree", "size", F.col("last_id").alias("before")), F.col("lang").eqNullSafe(F.col("of")), "left").drop("of"), "trees")
    if not met.filter("no_id > 0 OR first_id <= before").isEmpty():
        raise ValueError("ids must be greater than those that are kept")
    fresh = numbered(met.filter("tree IS NULL").drop("tree"), [], ["lang"], "tree").withColumn("tree", F.col("tree") + next_tree + 1)
    grown = written(met.filter("tree IS NOT NULL").unionByName(fresh).select("tree", "lang", F.coalesce("size", F.lit(0)).alias("old"), (F.coalesce("size", F.lit(0)) + F.col("more")).alias("size"), "last_id"), "trees")
    changed = written(leaves.join(grown.withColumnRenamed("lang", "of").drop("last_id"), F.col("lang").eqNullSafe(F.col("of"))).select("tree", (F.col("at") + F.col("old")).alias("index"), "size", "hash"), "nodes")
    level, most = 0, grown.agg(F.max("size")).first()[0] or 0
    while True:
        changed.select("tree", "index", "hash").write.mode("overwrite").parquet(f"{folder}/nodes/round={level}/batch={number}")
        if most <= 1:
            break
        block = F.shiftright("index", bits).alias("block")
        first = changed.groupBy("tree", block).agg(F.min("index").alias("from"), F.max("size").alias("size"))
        kept = _kept(docs, f"{folder}/nodes/round={level}", KEPT["nodes"], number, ["tree", "index"]).withColumn("block", F.shiftright("index", bits))
        beside = kept.join(first, ["tree", "block"]).filter(F.col("index") < F.col("from")).select("tree", "index", "size", "hash")
        changed = written(block_roots(changed.unionByName(beside), bits), "nodes")
        level, most = level + 1, -(-most >> bits)
    changed.select("tree", "hash").write.mode("overwrite").parquet(f"{folder}/subroots/batch={number}")
    grown.select("tree", "lang", "size", "last_id").write.mode("overwrite").parquet(f"{folder}/trees/batch={number}")
    named = _kept(docs, f"{folder}/trees", KEPT["trees"], number + 1, ["tree"]).join(_kept(docs, f"{folder}/subroots", KEPT["subroots"], number + 1, ["tree"]), "tree")
    top = numbered(named.select("lang", "hash"), [], ["lang"], "index", "size").select(F.lit(0).cast("long").alias("tree"), "index", "size", "hash")
    row = witnesses(written(top, "subroots"), bits).select("top").first()
    return row and row.top


def altered(every: int = 7, id_col: str = "doc_id") -> Column:
    """Rows whose id's crc32, of its decimal digits, `every` divides."""
    return F.coalesce(F.crc32(F.col(id_col).cast("long").cast("string")) % every == 0, F.lit(False))


def digests(found: DataFrame) -> DataFrame:
    """The contract's columns from manifest()'s."""
    return found.select("doc_id", "leaf", "subroot", "root", F.sha2(F.array_join("siblings", ""), 256).alias("proof_sha256"), "folded_root", "verified")


def _sql() -> str:
    field = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(({c})::VARCHAR) || ':' || {c} END"
    row = lambda n: "sha256(" + " || ".join(map(field, ("doc_id", "source", "lang", n, "text"))) + ")"
    crc = crc32_sql("list_transform(string_split(doc_id::VARCHAR, ''), lambda c: unicode(c)::BIGINT)")
    return f"""
WITH RECURSIVE {CRC32_SQL.strip()},
leaves AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce('x' || lang, '') AS k, {row("n_chars")} AS leaf,
    CASE WHEN n_chars IS NOT NULL AND {crc} % 7 = 0 THEN {row("n_chars + 1")} END AS shown
  FROM documents, crc_table),
placed AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY k) AS size FROM leaves),
nodes AS (
  SELECT k, 0 AS level, i, size, leaf AS h FROM placed
  UNION ALL SELECT k, level + 1, i // 2, (max(size) + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM nodes WHERE size > 1 GROUP BY k, level, i // 2),
subroots AS (SELECT k, h, row_number() OVER (ORDER BY k) - 1 AS i, count(*) OVER () AS size FROM nodes WHERE size = 1),
tops AS (
  SELECT 0 AS level, i, size, h FROM subroots
  UNION ALL SELECT level + 1, i // 2, (max(size) + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM tops WHERE size > 1 GROUP BY level, i // 2),
siblings AS (
  SELECT p.r, n.level, n.h FROM placed p JOIN nodes n ON n.k = p.k AND n.i = xor(p.i >> n.level, 1)
  UNION ALL SELECT p.r, 1000 + n.level, n.h FROM placed p JOIN subroots s USING (k) JOIN tops n ON n.i = xor(s.i >> n.level, 1)),
proofs AS (SELECT r, sha256(string_agg(h, '' ORDER BY level)) AS proof_sha256 FROM siblings GROUP BY r),
up AS (
  SELECT r, k, 0 AS level, i, size, coalesce(shown, leaf) AS h FROM placed
  UNION ALL SELECT u.r, u.k, u.level + 1, u.i // 2, (u.size + 1) // 2, sha256(CASE WHEN n.h IS NULL THEN u.h WHEN u.i % 2 = 0 THEN u.h || n.h ELSE n.h || u.h END)
  FROM up u LEFT JOIN nodes n ON n.k = u.k AND n.level = u.level AND n.i = xor(u.i, 1) WHERE u.size > 1),
higher AS (
  SELECT u.r, 0 AS level, s.i, s.size, u.h FROM up u JOIN subroots s USING (k) WHERE u.size = 1
  UNION ALL SELECT u.r, u.level + 1, u.i // 2, (u.size + 1) // 2, sha256(CASE WHEN n.h IS NULL THEN u.h WHEN u.i % 2 = 0 THEN u.h || n.h ELSE n.h || u.h END)
  FROM higher u LEFT JOIN tops n ON n.level = u.level AND n.i = xor(u.i, 1) WHERE u.size > 1)
SELECT p.doc_id, p.leaf, s.h AS subroot, t.h AS root, coalesce(proof_sha256, sha256('')) AS proof_sha256, f.h AS folded_root, f.h = t.h AS verified
FROM placed p JOIN subroots s USING (k) JOIN tops t ON t.size = 1 LEFT JOIN proofs USING (r) JOIN higher f ON f.r = p.r AND f.size = 1"""


ORACLE_SQL = _sql()
