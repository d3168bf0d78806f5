"""Line dedup by a deletion-neighbourhood join over words."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .arrays import Rolling, let_go, pieces, powers, spans, text_bytes, word_hashes, words
from .frames import IDENTITY, checkpoint, keyed, restored, schema_of


def _lines(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (without the newline) of all lines, by text; and n + 1 offsets into them come from their texts' starts."""
    cut = np.nonzero(data == 10)[0]
    start = np.sort(np.concatenate([at[:-1], cut + 1]), kind="stable")
    text = np.searchsorted(at[:-1], start, side="right") - 1
    # empty texts share a start with the next one: give each its own line
    counts = np.bincount(np.searchsorted(at, cut, side="right") - 1, minlength=len(at) - 1) + 1 if len(at) > 1 else np.zeros(0, np.int64)
    text = np.repeat(np.arange(len(at) - 1), counts)
    index = spans(counts)
    start = np.where(index == 0, at[:-1][text], 0)
    inner = np.nonzero(index > 0)[0]
    start[inner] = cut + 1
    end = np.where(np.append(text[1:], -1) == text, np.append(start[1:], 0) - 1, at[1:][text])
    return start, end


_EDGES = ["head", "tail", "short_head", "short_tail"]
#: What tells a document from others, in the order of documents.
_OWN = ["no_id", *IDENTITY]
_OWN_FIELDS = "no_id boolean, id_key long, row_key long"


class Lines:
    """The lines of a table's texts with their words' hashes."""

    def __init__(self, column: pa.Array):
        self.data, self.at = text_bytes(column)
        self.start, self.end = _lines(self.data, self.at)
        cut = np.bincount(np.searchsorted(self.at, np.nonzero(self.data == 10)[0], side="right") - 1, minlength=max(len(self.at) - 1, 0))
        count = cut + 1 if len(self.at) > 1 else cut
        self.text, self.index = np.repeat(np.arange(len(count)), count), spans(count)
        word_start, word_end, _ = words(self.data, self.at)
        self.rolling = Rolling(word_hashes(self.data, word_start, word_end))
        self.first, self.last = np.searchsorted(word_start, self.start), np.searchsorted(word_start, self.end)

    def hashes(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return self.rolling.ranges(a, b).view(np.int64)


def _line_rows(batches):
    let_go()
    for batch in batches:
        for part in pieces(batch, "text"):
            x = Lines(part.column("text"))
            has = np.nonzero(x.last > x.first)[0]
            a, b = x.first[has], x.last[has]
            of = pa.array(x.text[has])
            # halves of the line and of one a word shorter; the side and the length are part of an edge
            edges = []
            for half in ((b - a) // 2, (b - a - 1) // 2):
                edges += [x.hashes(a, a + half), x.hashes(b - half, b) ^ np.int64(0x5BD1E995)]
            columns = [*(part.column(c).take(of) for c in _OWN), pa.array(x.index[has].astype(np.int32)), pa.array(x.hashes(a, b)), pa.array((b - a).astype(np.int32)), *map(pa.array, edges)]
            yield pa.RecordBatch.from_arrays(columns, [*_OWN, "line", "hash", "n_words", *_EDGES])


def _line_text(batches):
    let_go()
    for batch in batches:
        for part in pieces(batch, "text"):
            x = Lines(part.column("text"))
            begins = np.searchsorted(x.text, np.arange(part.num_rows))
            wanted = part.column("wanted")
            inner, row = wanted.flatten(), np.repeat(np.arange(part.num_rows), np.asarray(pc.list_value_length(wanted)))
            at = begins[row] + np.asarray(inner.field("line"))
            raw = x.data.tobytes()
            text = [b" ".join(raw[a:b].split()) for a, b in zip(x.start[at].tolist(), x.end[at].tolist(), strict=True)]
            of = pa.array(row)
            columns = [*(part.column(c).take(of) for c in _OWN), *(inner.field(c) for c in ("line", "hash", "head", "tail")), pa.array([t.decode("utf-8", "replace") for t in text], pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [*_OWN, "line", "hash", "head", "tail", "words"])


def _variants(batches):
    """Each line's hash, as position -1, and its hash without each of the words that an edit may lie at: outside a half that it shares."""
    for batch in batches:
        for part in pieces(batch, "words", 1 << 18):
            data, at = text_bytes(part.column("words"))
            start, end, first = words(data, at)
            word = word_hashes(data, start, end)
            n = np.diff(first)
            row, skip = np.repeat(np.arange(len(n)), n + 1), spans(n + 1) - 1
            # the words' hashes weighted by position: what follows the skipped word moves up by one
            sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(word * p, dtype=np.uint64)]) for p in _weights(first, n)]
            a, b, at_skip = first[:-1][row], first[1:][row], first[:-1][row] + np.maximum(skip, 0)
            whole = skip < 0
            head = np.where(whole, sums[0][b] - sums[0][a], sums[0][at_skip] - sums[0][a])
            rest = np.where(whole, np.uint64(0), sums[1][b] - sums[1][np.minimum(at_skip + 1, b)])
            value = head + rest + (n[row] - ~whole).astype(np.uint64) * np.uint64(0xA24BAED4963EE407)
            half = (n[row] - 1) // 2
            may = whole | (np.asarray(part.column("head"))[row] & (skip >= half)) | (np.asarray(part.column("tail"))[row] & (skip < n[row] - half))
            of, value, skip = pa.array(row[may]), value[may], skip[may]
            yield pa.RecordBatch.from_arrays([*(part.column(c).take(of) for c in (*_OWN, "line", "hash")), pa.array(value.view(np.int64)), pa.array(skip.astype(np.int32))], [*_OWN, "line", "hash", "variant", "skip"])


def _weights(first: np.ndarray, n: np.ndarray) -> list[np.ndarray]:
    up = powers(int(n.max(initial=0)) + 2)[0]
    place = spans(n)
    return [up[place], up[np.maximum(place - 1, 0)]]


def within_one_word(a: str, b: str) -> bool:
    """Whether one word's insertion, deletion or substitution at most makes the lines equal."""
    x, y = a.split(" "), b.split(" ")
    if abs(len(x) - len(y)) > 1:
        return False
    head = 0
    while head < min(len(x), len(y)) and x[head] == y[head]:
        head += 1
    tail = 0
    while tail < min(len(x), len(y)) - head and x[-1 - tail] == y[-1 - tail]:
        tail += 1
    return max(len(x), len(y)) - head - tail <= 1


def _cut(batches):
    let_go()
    for batch in batches:
        for part in pieces(batch, "text"):
            x = Lines(part.column("text"))
            lists = part.column("gone")
            row = np.repeat(np.arange(part.num_rows), np.asarray(pc.fill_null(pc.list_value_length(lists), 0)))
            inner = lists.flatten()
            begins = np.searchsorted(x.text, np.arange(part.num_rows))
            gone = np.zeros(len(x.start), bool)
            gone[begins[row] + np.asarray(inner.field("line"))] = True
            near = np.zeros(len(x.start), bool)
            near[begins[row] + np.asarray(inner.field("line"))] = np.asarray(inner.field("near")).astype(bool)
            raw, kept = x.data.tobytes(), [[] for _ in range(part.num_rows)]
            left = np.nonzero(~gone)[0]
            for t, a, b in zip(x.text[left].tolist(), x.start[left].tolist(), x.end[left].tolist(), strict=True):
                kept[t].append(raw[a:b])
            done = [b"\n".join(k) for k in kept]
            per = lambda v: pa.array(np.bincount(x.text, weights=v, minlength=part.num_rows).astype(np.int64))
            cols = [part.column("doc_id"), per(np.ones(len(x.text))), per(gone), per(near), pa.array([d.decode("utf-8", "replace") for d in done], pa.string()), pa.array([hashlib.sha256(d).hexdigest() for d in done], pa.string())]
            names = ["doc_id", "n_lines", "n_removed", "n_near", "kept", "kept_sha256"]
            if "carried" in part.schema.names:
                cols, names = [*cols, part.column("carried")], [*names, "carried"]
            yield pa.RecordBatch.from_arrays(cols, names)


def _place(*more: str):
    return F.struct(*_OWN, "line", *more)


def drop_repeated_lines(docs: DataFrame, near_words: int = 8, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """Removes each line that is equal or near to an earlier one, anywhere in the table.

    Lines are split at newlines and compared as words `[^\\x20\\x09-\\x0D]+`; those without a word
    stay. Equal lines: all words. Near lines: one word inserted, deleted or changed, among lines of
    `near_words` words or more (2 at least): in shorter ones a word is too large a part of the line
    for the two to say the same. A line goes if an earlier line is within that bound, whether or
    not that one goes too. Earlier is a smaller id, then an earlier line; rows without id come
    last; different texts under one id stand in the order of a hash of both. Rows that agree in id
    and text are one document and keep the same lines each. Null texts are empty; a text or a line
    of any length is one row; other columns are ignored; an empty table gives no rows. Returns a
    row a row of docs: doc_id, n_lines, n_removed, n_near, kept, kept_sha256; with `carry` also a
    struct of the other columns.

    Equal lines are found by minima of hashes, summed before the shuffle. A single edit leaves the
    first or the last half of the shorter line as it is, so only lines that share a half with a
    different line emit their deletion variants. A line without its i-th word that
    equals another without its i-th, or equals another whole line, is within the bound, so minima
    over equal variants find the earliest and no pairs within a group are made; each line's one
    match is verified word by word.
    """
    if near_words < 2:
        raise ValueError("near_words must be 2 or more")
    rows = keyed(docs, id_col, text_col, deal=False).mapInArrow(_line_rows, f"{_OWN_FIELDS}, line int, hash long, n_words int, " + ", ".join(f"{e} long" for e in _EDGES))
    # every use reads n, and the filter is what a join adds, so that Spark works these out once
    kinds = rows.filter("hash is not null").groupBy("hash").agg(F.min(_place("n_words", *_EDGES)).alias("first"), F.count("*").alias("n"))
    earliest = F.struct(*(F.col(f"first.{c}").alias(c) for c in (*_OWN, "line")))
    repeated = kinds.filter("n > 1").select("hash", earliest.alias("first"))
    even = F.col("first.n_words") % 2 == 0
    edges = F.array("first.head", "first.tail", F.when(even, F.col("first.short_head")), F.when(even, F.col("first.short_tail")))
    # edges carry the hash alone, which leads back to the line
    long_ = kinds.filter((F.col("first.n_words") >= near_words) & (F.col("n") > 0)).select("hash", F.posexplode(edges).alias("side", "edge")).filter("edge is not null")
    shared = long_.groupBy("edge").agg(F.count("*").alias("n")).filter("n > 1").select("edge")
    matched = long_.join(shared, "edge").groupBy("hash").agg(F.max(F.col("side") % 2 == 0).alias("head"), F.max(F.col("side") % 2 == 1).alias("tail"))
    lines = kinds.filter("n > 0").join(matched, "hash").select(*(F.col(f"first.{c}").alias(c) for c in (*IDENTITY, "line")), "hash", "head", "tail")
    wanted = lines.groupBy(*IDENTITY).agg(F.collect_list(F.struct("line", "hash", "head", "tail")).alias("wanted"))
    found = checkpoint(wanted.unionByName(repeated, allowMissingColumns=True))
    equal = rows.select("hash", *_OWN, "line").join(found.filter("first is not null").select("hash", "first"), "hash").filter(_place() > F.col("first")).select(*IDENTITY, "line", F.lit(False).alias("near"))
    texts = keyed(docs, id_col, text_col, carry=carry)
    # one row a hash; every use reads all columns, so that texts are searched for these lines once
    chosen = texts.join(found.filter("wanted is not null").select(*IDENTITY, "wanted"), IDENTITY).mapInArrow(_line_text, f"{_OWN_FIELDS}, line int, hash long, head boolean, tail boolean, words string").repartition("hash")
    emitted = chosen.mapInArrow(_variants, f"{_OWN_FIELDS}, line int, hash long, variant long, skip int")
    again = emitted.groupBy("variant").agg(F.count("*").alias("n")).filter("n > 1").select("variant")
    variants = emitted.join(again, "variant")
    leads = variants.groupBy("variant", "skip").agg(F.min(_place("hash")).alias("lead"), F.count("*").alias("n"))
    # across lengths: a whole line against lines without any one word
    whole = leads.filter("skip < 0").select("variant", F.col("lead").alias("whole"))
    less = leads.filter("skip >= 0").groupBy("variant").agg(F.min("lead").alias("less"))
    both = whole.join(less, "variant").select("variant", "whole", "less")
    same = variants.join(leads.filter("skip >= 0 and n > 1").select("variant", "skip", "lead"), ["variant", "skip"])
    across = variants.join(both, "variant").withColumn("lead", F.when(F.col("skip") < 0, F.col("less")).otherwise(F.col("whole")))
    columns = [*_OWN, "line", "hash", "lead"]
    pairs = same.select(columns).unionByName(across.select(columns)).filter(_place("hash") > F.col("lead")).groupBy("hash", *IDENTITY, "line").agg(F.min("lead").alias("lead"))

    @pandas_udf("boolean")
    def verified(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([within_one_word(x, y) for x, y in zip(a, b, strict=True)], dtype=bool)

    text_of = chosen.mapInArrow(lambda batches: (b.select(["hash", "words"]) for b in batches), "hash long, words string")
    near = pairs.join(text_of, "hash").join(text_of.select(F.col("hash").alias("lead_hash"), F.col("words").alias("lead_words")), F.col("lead.hash") == F.col("lead_hash"))
    near = near.filter(verified("words", "lead_words")).select(*IDENTITY, "line", F.lit(True).alias("near"))
    gone = equal.unionByName(near).groupBy(*IDENTITY).agg(F.collect_set(F.struct("line", "near")).alias("gone"))
    return texts.join(gone, IDENTITY, "left").mapInArrow(_cut, schema_of("doc_id long, n_lines long, n_removed long, n_near long, kept string, kept_sha256 string", texts))


def dedup_lines(docs: DataFrame, text_col: str = "text", **more) -> DataFrame:
    """The rows of docs with repeated lines gone from the text; rows that lose every word go.

    Null and empty texts have no lines with words and stay as they are; all columns stay, whatever their
    names; an empty table gives no rows.
    """
    cut = drop_repeated_lines(docs, text_col=text_col, carry=True, **more)
    has_word = lambda c: F.col(c).rlike(r"[^\x20\x09-\x0D]")
    return restored(cut.filter((F.col("n_removed") == 0) | has_word("kept")), docs, "kept", text_col)


def digests(cut: DataFrame) -> DataFrame:
    return cut.select("doc_id", "n_lines", "n_removed", "n_near", "kept_sha256")
