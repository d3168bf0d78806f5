"""Exact top-k inner-product search by pivot-table elimination."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .frames import checkpoint


def choose_pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Vectors far from each other: each next one is the farthest from those before."""
    chosen, far = [0], ((sample - sample[0]) ** 2).sum(1)
    while len(chosen) < min(count, len(sample)):
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


def distances(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.stack([np.sqrt(((vectors - p) ** 2).sum(1)) for p in pivots], 1)


def upper_bounds(queries: np.ndarray, query_table: np.ndarray, rows: np.ndarray, row_table: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each query and group of neighbouring rows, what no inner product between them exceeds.

    A group's least and greatest distance to a pivot bound the distance of any of its rows from
    below; the largest bound over all pivots counts, and with both norms it gives an upper one.
    """
    low = np.zeros((len(queries), len(starts)))
    nearest, farthest = np.minimum.reduceat(row_table, starts), np.maximum.reduceat(row_table, starts)
    for p in range(row_table.shape[1]):
        np.maximum(low, nearest[None, :, p] - query_table[:, p, None], out=low)
        np.maximum(low, query_table[:, p, None] - farthest[None, :, p], out=low)
    norms = np.maximum.reduceat((rows**2).sum(1), starts)
    # the tables are rounded to single precision, by a share of the distances: give the bound that much room
    room = 1e-3 + 1e-6 * (query_table.max(1)[:, None] + farthest.max(1)[None])
    return ((queries**2).sum(1)[:, None] + norms[None] - np.square(np.maximum(low - room, 0))) / 2 * (1 + 1e-12) + 1


def search_block(queries: np.ndarray, query_keys: np.ndarray, query_table: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, row_keys: np.ndarray, row_table: np.ndarray, k: int, group: int = 128) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each query's k best of a block of rows: index of the query, id and score.

    Rows are laid out by their nearest pivot and the distance to it, and cut into groups. Each query
    takes its groups by falling bound, one at first and then four times as many at each step, and
    stops where no bound reaches its k-th score; queries that want the same group share one product.
    """
    order = np.lexsort((row_table.min(1), row_table.argmin(1)))
    rows, row_ids, row_keys, row_table = rows[order], row_ids[order], row_keys[order], row_table[order]
    starts = np.arange(0, len(rows), group)
    bound = upper_bounds(queries, query_table, rows, row_table, starts)
    turn = np.empty(bound.shape, np.int8)
    np.put_along_axis(turn, np.argsort(-bound, axis=1, kind="stable"), np.ceil(np.log(np.arange(len(starts)) + 1) / math.log(4)).astype(np.int8)[None], 1)
    least = np.full(len(queries), -np.inf)
    q, ids, scores = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    for step in range(int(turn.max(initial=-1)) + 1):
        found = []
        for g, first in enumerate(starts.tolist()):
            wants = np.nonzero((turn[:, g] == step) & (bound[:, g] >= least))[0]
            if not len(wants):
                continue
            last = min(first + group, len(rows))
            product = queries[wants] @ rows[first:last].T
            product[query_keys[wants][:, None] == row_keys[None, first:last]] = -np.inf
            a, b = np.divmod(np.flatnonzero(product >= np.maximum(least[wants], -1e300)[:, None]), product.shape[1])
            found.append((wants[a], row_ids[first + b], product[a, b]))
        if found:
            q, ids, scores = (np.concatenate([x, *(f[i] for f in found)]) for i, x in enumerate((q, ids, scores)))
            best = np.lexsort((ids, -scores, q))
            q, ids, scores = q[best], ids[best], scores[best]
            at = np.searchsorted(q, np.arange(len(queries) + 1))
            keep = np.arange(len(q)) - at[q] < k
            full = np.nonzero(np.diff(at) >= k)[0]
            least[full] = scores[at[full] + k - 1]
            q, ids, scores = q[keep], ids[keep], scores[keep]
    return q, ids, scores


def _matrix(column: pa.ChunkedArray, kind: str) -> np.ndarray:
    """Rows of packed numbers of one length."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1).astype(float)


def top_k(vectors: DataFrame, k: int = 20, every: int = 20, scale: int = 64, pivots: int = 24, sample: int = 2000, block: int = 8192, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Each query's k highest integer inner products over all other rows, ties to the smaller id.

    Components become floor(scale * x). Queries are the rows whose id is divisible by `every`; a
    query's own row is not its candidate, but other rows with its id are, and rows that repeat an
    id or a vector are queries and candidates each. Rows with a null id, or whose vector is null,
    empty, or holds null or non-finite components, take no part; other columns are ignored. Vectors
    of another length than the pivots' are compared within their own length only. A table of fewer
    rows gives fewer ranks; an empty one gives no rows. Returns query_id, rank, vec_id, score.

    The pivots come from a bounded sample (`sample` rows, a parameter); only those few vectors pass
    the driver. Queries and rows are dealt into blocks of at most about `block` rows; each pair of
    blocks is one group, whose k best per query are merged by rank. That every query meets every
    block of rows is the search's own task; the blocks hold its memory to two blocks in a group.
    """
    clean = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    clean = clean.filter(F.col("vec_id").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(math.inf))))
    first = clean.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("v").toPandas()["v"]
    by_length: dict[int, list] = {}
    for v in first:
        by_length.setdefault(len(v), []).append(v)
    chosen = {n: choose_pivots(np.floor(scale * np.array(v.tolist() if hasattr(v, "tolist") else v, float)), pivots) for n, v in by_length.items()}

    def tables(batches):
        for batch in batches:
            lists = batch.column("v")
            flat, size = np.asarray(lists.flatten()), np.asarray(pa.compute.list_value_length(lists)).astype(np.int64)
            at = np.cumsum(size) - size
            for n in np.unique(size).tolist():
                rows = np.nonzero(size == n)[0]
                v = np.floor(scale * flat[at[rows][:, None] + np.arange(n)])
                table = distances(v, chosen.get(n, np.zeros((1, n))))
                packed = lambda m, kind: pa.array([x.tobytes() for x in m.astype(kind)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(rows)), packed(v, "<f8"), packed(table, "<f4"), pa.array(np.full(len(rows), n, np.int32))], ["vec_id", "v", "distances", "size"])

    numbered = clean.mapInArrow(tables, "vec_id long, v binary, distances binary, size int").withColumn("row", F.monotonically_increasing_id())
    table = checkpoint(numbered)  # from here on a row keeps its number
    asked = F.col("vec_id") % every == 0
    counts = table.agg(F.count("*"), F.count_if(asked)).first()
    parts, query_parts = (max(1, -(-n // block)) for n in counts)
    deal = lambda n: F.pmod(F.xxhash64("row"), F.lit(n))
    all_of = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    ours = table.filter(asked).withColumn("q", deal(query_parts)).withColumn("c", all_of(parts))
    theirs = table.withColumn("c", deal(parts)).withColumn("q", all_of(query_parts))

    def pair(queries: pa.Table, rows: pa.Table) -> pa.Table:
        if not queries.num_rows or not rows.num_rows:
            return pa.table({c: pa.array([], pa.int64()) for c in ("query_id", "query_row", "vec_id", "score")})
        ids, keys = (np.asarray(queries.column(c)) for c in ("vec_id", "row"))
        side = lambda t: (_matrix(t.column("v"), "<f8"), np.asarray(t.column("row")), _matrix(t.column("distances"), "<f4"))
        vectors, row_keys, row_table = side(rows)
        q, found, scores = search_block(*side(queries), vectors, np.asarray(rows.column("vec_id")), row_keys, row_table, k)
        return pa.table({"query_id": ids[q], "query_row": keys[q], "vec_id": found, "score": scores.astype(np.int64)})

    best = ours.groupBy("q", "c", "size").cogroup(theirs.groupBy("q", "c", "size")).applyInArrow(lambda a, b: pair(a, b), "query_id long, query_row long, vec_id long, score long")
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE_SQL = """
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
scored AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.r <> c.r AND len(q.e) = len(c.e) WHERE q.vec_id % 20 = 0)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM scored) WHERE rank <= 20"""
