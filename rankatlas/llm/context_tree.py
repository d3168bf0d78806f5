"""Language-model scoring by context-tree weighting over bytes.

Every byte is eight binary decisions, each with a context tree of its own over the bytes before it.
A node of a tree keeps how often a zero and a one followed; its Krichevsky-Trofimov estimate and the
product over its longer contexts are weighted by halves, from the longest contexts up. A trained
tree then gives each decision one probability that mixes all depths.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .arrays import let_go, pieces, runs, text_bytes, word_hashes, words
from .frames import batched, checkpoint

_HALF = math.log(0.5)
#: Contexts of so many bytes are worked out together in one group; shorter ones, 257 at most, on the driver.
_JOINT = 2
#: Keys of words have this bit, which those of grams (seven bytes at most) don't.
WORDS = 1 << 62


def lowered(data: np.ndarray) -> np.ndarray:
    return np.where((data >= 65) & (data <= 90), data + 32, data).astype(np.uint8)


def grams(data: np.ndarray, at: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the depth bytes before and each byte of the texts and of a zero after each; and n + 1 offsets into them.

    Before a text there are zeros.
    """
    n = len(at) - 1
    wide = np.zeros(len(data) + n * (depth + 1), np.uint8)
    place = np.arange(len(data)) + np.repeat(np.arange(n) * (depth + 1) + depth, np.diff(at))
    wide[place] = data
    offsets = at + np.arange(n + 1) * (depth + 1)
    key = np.zeros(max(len(wide) - depth, 0), np.uint64)
    for i in range(depth + 1):
        key = key << np.uint64(8) | wide[i : len(wide) - depth + i]
    ok = np.ones(len(wide), bool)  # windows that end in a text or its closing zero: all but the padding
    ok[(offsets[:-1, None] + np.arange(depth)).ravel()] = False
    return key[ok[depth:]], at + np.arange(n + 1)


def token_keys(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    start, end, first = words(data, at)
    return ((word_hashes(data, start, end) >> np.uint64(2)) | np.uint64(WORDS)).astype(np.int64), first


def counted(key: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, below 2**63, and how many of each are for training (train: 0 or 1)."""
    packed = np.sort(key.astype(np.uint64) << np.uint64(1) | train.astype(np.uint64))
    key = packed >> np.uint64(1)
    a, b = runs(key)
    total = np.concatenate([np.zeros(1, np.int64), np.cumsum((packed & np.uint64(1)).astype(np.int64))])
    return key[a].astype(np.int64), total[b] - total[a]


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of several counted() results, together."""
    key, n = np.concatenate([k for k, _ in parts]), np.concatenate([n for _, n in parts])
    order = np.argsort(key)
    key = key[order]
    a, b = runs(key)
    total = np.concatenate([np.zeros(1, np.int64), np.cumsum(n[order])])
    return key[a], total[b] - total[a]


def looked_up(known: np.ndarray, value: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Values of keys, all of them known; keys are looked up in order, which is kind to caches."""
    order = np.argsort(key)
    out = np.empty(len(key), value.dtype)
    out[order] = value[np.searchsorted(known, key[order])]
    return out


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Logarithm of the Krichevsky-Trofimov estimate of a zeros and b ones."""

    def log_gamma(x: np.ndarray, more: float) -> np.ndarray:
        u, inverse = np.unique(x, return_inverse=True)
        return np.array([math.lgamma(v + more) for v in u.tolist()])[inverse]

    return log_gamma(a, 0.5) + log_gamma(b, 0.5) - math.log(math.pi) - log_gamma(a + b, 1.0)


def joined(estimate: np.ndarray, children: np.ndarray) -> np.ndarray:
    return np.logaddexp(_HALF + estimate, _HALF + children)


class Subtree:
    """The trees' nodes from `_JOINT` bytes of context down to `depth`, for whole groups of joint context."""

    def __init__(self, key: np.ndarray, count: np.ndarray, depth: int):
        symbol, context = (key & np.uint64(255)).astype(np.int64), (key >> np.uint64(8)).astype(np.int64)
        step = np.arange(8)
        self.node = ((1 << step) | (symbol[:, None] >> (8 - step))).ravel()
        self.bit = ((symbol[:, None] >> (7 - step)) & 1).ravel().astype(bool)
        weight = np.repeat(count, 8)
        code, at = np.unique(np.repeat(context, 8) << 8 | self.node, return_inverse=True)
        zeros, ones = np.bincount(at, weight * ~self.bit, len(code)), np.bincount(at, weight * self.bit, len(code))
        weighted = log_kt(zeros, ones)
        mixed = np.where(self.bit, ones[at], zeros[at])
        mixed = (mixed + 0.5) / (zeros + ones + 1)[at]
        levels = []
        for d in range(depth - 1, _JOINT - 1, -1):
            code, up = np.unique((code >> 8 & ((1 << 8 * d) - 1)) << 8 | (code & 255), return_inverse=True)
            below = np.bincount(up, weighted, len(code))
            zeros, ones = np.bincount(up, zeros, len(code)), np.bincount(up, ones, len(code))
            estimate = log_kt(zeros, ones)
            weighted, at = joined(estimate, below), up[at]
            levels.append((zeros, ones, np.exp(_HALF + estimate - weighted), at))
        for zeros, ones, stop, at in levels:
            own = (np.where(self.bit, ones[at], zeros[at]) + 0.5) / (zeros + ones + 1)[at]
            mixed = stop[at] * own + (1 - stop[at]) * mixed
        self.code, self.zeros, self.ones, self.weighted, self.mixed = code, zeros, ones, weighted, mixed


def upper_levels(context: np.ndarray, node: np.ndarray, zeros: np.ndarray, ones: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From the nodes at one byte of context: what a decision gets from contexts under two bytes, by bit, and the weight left for longer ones."""
    a, b, pair = np.zeros((256, 256)), np.zeros((256, 256)), np.zeros((256, 256))
    a[context, node], b[context, node], pair[context, node] = zeros, ones, below
    estimate = log_kt(a.ravel(), b.ravel()).reshape(256, 256)
    weighted = joined(estimate, pair)
    root_a, root_b = a.sum(0), b.sum(0)
    root = log_kt(root_a, root_b)
    stop0, stop1 = np.exp(_HALF + root - joined(root, weighted.sum(0))), np.exp(_HALF + estimate - weighted)
    share = []
    for c, root_c in ((a, root_a), (b, root_b)):
        own0, own1 = (root_c + 0.5) / (root_a + root_b + 1), (c + 0.5) / (a + b + 1)
        share.append(stop0 * own0 + (1 - stop0) * stop1 * own1)
    return np.stack(share), (1 - stop0) * (1 - stop1)


def _groups(work, chunk: int):
    """Applies work to tables that hold whole groups of the sorted column "joint"."""

    def run(batches):
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows > chunk:
                table = pa.Table.from_batches(held)
                joint = np.asarray(table.column("joint"))
                whole = int(np.searchsorted(joint, joint[-1]))
                if whole:
                    yield from work(table.slice(0, whole)).to_batches()
                held = table.slice(whole).to_batches()
                rows = sum(b.num_rows for b in held)
        if rows:
            yield from work(pa.Table.from_batches(held)).to_batches()

    return run


def _parts(rows: pa.Table):
    for batch in rows.to_batches():
        yield from pieces(batch, "text", 1 << 20)


def score(docs: DataFrame, depth: int = 5, folds: int = 7, held: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """log10 probabilities of every whole text, under a unigram base and under the weighted trees.

    Training texts are those whose crc32(id as text) modulo `folds` is not `held`; rows without id
    train. A-Z become lower case; null texts are empty. Base tokens are words and one end. The
    trees code the text's bytes and a closing zero byte, from zeros before the text, with contexts
    of up to `depth` bytes (2 to 6); they are learnt from all training texts and then fixed.
    Repeated rows count and are scored each; a text of any length is scored whole; other columns are
    ignored, whatever their names. An empty table gives no rows.

    Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes and
    bits_per_byte. Counts are summed in each task before a shuffle. Texts are dealt once into
    batches; each sends its distinct keys and gets their values back, so no table of contexts or
    words is broadcast; only the nodes under two bytes of context, 65,280 at most, pass the driver.
    A word that only one batch holds needs no way back.
    """
    if not _JOINT <= depth <= 6:
        raise ValueError("depth must be 2 to 6")
    trains = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds != held, F.lit(True))
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")).withColumn("train", trains)

    def count_grams(batches):
        let_go()
        for batch in batches:
            for part in pieces(batch, "text", 2 << 20):
                data, at = text_bytes(part.column("text"))
                key, first = grams(lowered(data), at, depth)
                key, n = counted(key, np.repeat(np.asarray(part.column("train")).astype(np.int64), np.diff(first)))
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], ["key", "n"])

    joint = F.shiftright("key", 8).bitwiseAND((1 << 8 * _JOINT) - 1)
    counts = checkpoint(plain.mapInArrow(count_grams, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")))
    grouped = counts.withColumn("joint", joint).repartition("joint").sortWithinPartitions("joint")

    def nodes(rows: pa.Table) -> pa.Table:
        tree = Subtree(np.asarray(rows.column("key")).astype(np.uint64), np.asarray(rows.column("n")), depth)
        return pa.table({"context": tree.code >> 8 & 255, "node": tree.code & 255, "zeros": tree.zeros, "ones": tree.ones, "below": tree.weighted})

    sums = grouped.mapInArrow(_groups(nodes, 1 << 16), "context long, node long, zeros double, ones double, below double").groupBy("context", "node").agg(*(F.sum(c).alias(c) for c in ("zeros", "ones", "below"))).toPandas()
    share, rest = upper_levels(sums["context"].to_numpy(np.int64), sums["node"].to_numpy(np.int64), *(sums[c].to_numpy(float) for c in ("zeros", "ones", "below")))

    def values(rows: pa.Table) -> pa.Table:
        key = np.asarray(rows.column("key")).astype(np.uint64)
        tree = Subtree(key, np.asarray(rows.column("n")), depth)
        context = np.repeat((key >> np.uint64(8) & np.uint64(255)).astype(np.int64), 8)
        p = share[tree.bit.astype(np.int64), context, tree.node] + rest[context, tree.node] * tree.mixed
        # rounded to single precision, which halves what goes back
        return pa.table({"key": rows.column("key"), "value": np.log10(p).reshape(-1, 8).sum(1).astype(np.float32).astype(float)})

    gram_values = grouped.mapInArrow(_groups(values, 1 << 16), "key long, value double")

    texts = batched(docs, id_col, text_col, size=14 << 20, least=0.25)[0].withColumn("train", trains)
    by_batch = texts.groupBy("batch")

    def keys(rows: pa.Table, of) -> pa.Table:
        """A batch's distinct grams or words, with training counts."""
        let_go()
        found: list = []
        for part in _parts(rows):
            data, at = text_bytes(part.column("text"))
            key, first = of(lowered(data), at)
            found.append(counted(key, np.repeat(np.asarray(part.column("train")).astype(np.int64), np.diff(first))))
            if len(found) == 6:  # what parts share is held once
                found = [merged(found)]
        key, n = merged(found)
        return pa.table({"key": key, "batch": np.full(len(key), rows.column("batch")[0].as_py(), np.int64), "n": n})

    fields = "key long, batch long, n long"
    gram_rows = by_batch.applyInArrow(lambda rows: keys(rows, lambda data, at: grams(data, at, depth)), fields).select("key", "batch")
    # what is asked of the words is asked above one exchange by key; a key has one row a batch at most
    by_key = Window.partitionBy("key")
    word_rows = by_batch.applyInArrow(lambda rows: keys(rows, token_keys), fields)
    word_rows = word_rows.withColumns({"total": F.sum("n").over(by_key), "batches": F.count("*").over(by_key), "least": F.min("batch").over(by_key)})
    stats = word_rows.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count_if((F.col("total") > 0) & (F.col("batch") == F.col("least"))).alias("v"))
    ends = plain.agg(F.count_if("train").alias("ends"))
    word_values = word_rows.filter("batches > 1").select("key", "batch", F.col("total").cast("double").alias("value"))
    back = gram_rows.join(gram_values, "key").select("key", "batch", "value").unionByName(word_values)

    def total(rows: pa.Table, found: pa.Table) -> pa.Table:
        let_go()
        key = np.asarray(found.column("key")) if found.num_rows else np.zeros(0, np.int64)
        value = np.asarray(found.column("value")) if found.num_rows else np.zeros(0)
        order = np.argsort(key)
        key, value = key[order], value[order]
        cut = int(np.searchsorted(key, WORDS))
        local: list = []
        for part in _parts(rows):
            data, at = text_bytes(part.column("text"))
            word, first = token_keys(lowered(data), at)
            local.append(counted(word, np.repeat(np.asarray(part.column("train")).astype(np.int64), np.diff(first))))
        own, own_n = merged(local)
        own_n = own_n.astype(float)
        own_n[np.searchsorted(own, key[cut:])] = value[cut:]
        done = []
        for part in _parts(rows):
            data, at = text_bytes(part.column("text"))
            data = lowered(data)
            gram, first = grams(data, at, depth)
            # sums text by text, so that long batches don't lose digits
            log_p = np.add.reduceat(looked_up(key[:cut], value[:cut], gram.astype(np.int64)), first[:-1])
            word, word_first = token_keys(data, at)
            c = looked_up(own, own_n, word)
            known = np.concatenate([np.zeros(1, np.int64), np.cumsum(c > 0)])[word_first]
            logs = np.append(np.log10(c + 1), 0.0)
            text_logs = np.where(np.diff(word_first) > 0, np.add.reduceat(logs, word_first[:-1]), 0.0)
            done.append(pa.table({"doc_id": part.column("doc_id"), "held_out": pa.array(~np.asarray(part.column("train"))), "n_words": np.diff(word_first), "known_words": np.diff(known), "logs": text_logs, "score": log_p, "n_bytes": np.diff(at)}))
        return pa.concat_tables(done)

    scored = by_batch.cogroup(back.groupBy("batch")).applyInArrow(lambda rows, found: total(rows, found), "doc_id long, held_out boolean, n_words long, known_words long, logs double, score double, n_bytes long")
    end = ends.scalar()
    n, v = stats.select("n").scalar() + end, stats.select("v").scalar() + (end > 0).cast("long")
    out = scored.withColumn("__n", n).withColumn("__v", v).withColumn("__end", end)
    return out.select(
        "doc_id",
        "held_out",
        (F.col("n_words") + 1).alias("n_tokens"),
        (F.col("known_words") + (F.col("__end") > 0).cast("long")).alias("n_known"),
        F.col("__n").alias("train_tokens"),
        (F.col("logs") + F.log10(F.col("__end") + 1.0) - (F.col("n_words") + 1) * F.log10((F.col("__n") + F.col("__v") + 1).cast("double"))).alias("base_score"),
        "score",
        "n_bytes",
        (-F.col("score") / math.log10(2) / (F.col("n_bytes") + 1)).alias("bits_per_byte"),
    )
