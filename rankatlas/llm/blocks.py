"""Exact removal of repeated word passages by fixed-block anchors.

Each text is cut into non-overlapping blocks of words; a window of twice a block less one word or
more holds a whole block of its own text wherever it lies. The block hashes are the index and every
rolling window of a block's length probes it; what hits is where a passage can repeat. Neighbouring
windows that hit by one anchor are extended to a segment, and segments and then single windows are
matched exactly by the hash of all their words.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import Rolling, covered, let_go, pieces, runs, sliding_min, spans, text_bytes, word_hashes, words
from .frames import IDENTITY, batched, restored, schema_of

_BUCKET = 16 << 20
#: A window is sent as 30 bits of its hash beside two flags: starts several times in its batch, is a block of the index.
_FINGER, _SEVERAL, _INDEXED = (1 << 30) - 1, np.uint32(1 << 30), np.uint32(1 << 31)


class Words:
    """The words of a table's texts and the rolling hash of the words' hashes."""

    def __init__(self, column: pa.Array):
        self.data, self.at = text_bytes(column)
        self.start, self.end, self.first = words(self.data, self.at)
        self.rolling = Rolling(word_hashes(self.data, self.start, self.end))
        self.text = np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all n-word windows, and which of them lie within one text."""
        grams = self.rolling.grams(n)
        return grams, np.arange(len(grams)) + n <= self.first[1:][self.text[: len(grams)]]


class Entries:
    """A batch's distinct windows of a block's length in the order of bucket and hash, as they are sent and answered."""

    def __init__(self, w: Words, block: int, buckets: int):
        self.grams, ok = w.grams(block)
        self.at = np.nonzero(ok)[0]
        grams = self.grams[self.at]
        code = (grams >> np.uint64(34)).astype(np.int64) % buckets << 30 | (grams & np.uint64(_FINGER)).astype(np.int64)
        self.order = np.argsort(code, kind="stable")
        self.code = code[self.order]
        self.a, self.b = runs(self.code)
        self.bucket = self.code[self.a] >> 30
        self.c, self.d = runs(self.bucket)


def _probe(rows: pa.Table, block: int, buckets: int) -> pa.Table:
    """Of one batch, for each bucket, its entries with their flags."""
    let_go()
    w = Words(rows.column("text"))
    x = Entries(w, block, buckets)
    if not len(x.a):
        return pa.table({"bucket": pa.array([], pa.int64()), "batch": pa.array([], pa.int64()), "windows": pa.array([], pa.binary())})
    indexed = ((x.at - w.first[w.text[x.at]]) % block == 0)[x.order]
    value = (x.code[x.a] & _FINGER).astype(np.uint32) | np.where(x.b - x.a > 1, _SEVERAL, np.uint32(0)) | np.where(np.logical_or.reduceat(indexed, x.a), _INDEXED, np.uint32(0))
    return pa.table({"bucket": x.bucket[x.c], "batch": np.full(len(x.c), rows.column("batch")[0].as_py(), np.int64), "windows": pa.array([value[i:j].astype("<u4").tobytes() for i, j in zip(x.c.tolist(), x.d.tolist(), strict=True)], pa.binary())})


def _hits(rows: pa.Table) -> pa.Table:
    """Of one bucket, for each batch, two bits an entry: it starts in two places or more; and it is a block of the index besides."""
    data, at = text_bytes(rows.column("windows"))
    value = np.frombuffer(data.tobytes(), "<u4")
    finger = value & np.uint32(_FINGER)
    order = np.argsort(finger, kind="stable")
    a, b = runs(finger[order])
    flags = np.bitwise_or.reduceat(value[order], a)
    several = np.empty(len(value), bool)
    several[order] = np.repeat((b - a > 1) | (flags & _SEVERAL > 0), b - a)
    hit = np.empty(len(value), bool)
    hit[order] = np.repeat(flags & _INDEXED > 0, b - a)
    hit &= several
    cuts = list(zip((at[:-1] // 4).tolist(), (at[1:] // 4).tolist(), strict=True))
    pack = lambda x: pa.array([np.packbits(x[i:j]).tobytes() for i, j in cuts], pa.binary())
    return pa.table({"bucket": rows.column("bucket"), "batch": rows.column("batch"), "several": pack(several), "hits": pack(hit)})


#: What tells a document from others, with the batch that it lies in.
_OWN = ["batch", "no_id", *IDENTITY]
_OWN_FIELDS = "batch long, no_id boolean, id_key long, row_key long"
_LOW = np.uint64((1 << 32) - 1)


def _found(rows: pa.Table, w: Words, text, first, count, **more) -> pa.Table:
    """Ranges of windows beside what tells their documents from others."""
    of = pa.array(text)
    own = {c: rows.column(c).combine_chunks().take(of) for c in _OWN}
    return pa.table(own | {"begin": pa.array((first - w.first[text]).astype(np.int64)), "count": pa.array(count.astype(np.int64))} | {k: pa.array(v.view(np.int64)) for k, v in more.items()})


def _places(rows: pa.Table) -> dict[tuple[int, int], int]:
    """A row for each document of a table; repeats of a document are alike."""
    return dict(zip(zip(*(rows.column(c).to_pylist() for c in IDENTITY), strict=True), range(rows.num_rows), strict=True))


def _extend(rows: pa.Table, answers: pa.Table, window: int, block: int, buckets: int) -> pa.Table:
    """Runs of windows under one anchor: of a window's blocks that hit, the least-hashed one. All its blocks must start in two places."""
    w = Words(rows.column("text"))
    x = Entries(w, block, buckets)
    grams, hit, several = x.grams, np.zeros(len(x.grams), bool), np.zeros(len(x.grams), bool)
    size = dict(zip(x.bucket[x.c].tolist(), zip(x.c.tolist(), x.d.tolist(), strict=True), strict=True)) if len(x.a) else {}
    for name, flags in (("several", several), ("hits", hit)):
        entry = np.zeros(len(x.a), bool)
        for bucket, raw in zip(answers.column("bucket").to_pylist(), answers.column(name).to_pylist(), strict=True):
            i, j = size[bucket]
            entry[i:j] = np.unpackbits(np.frombuffer(raw, np.uint8), count=j - i).astype(bool)
        flags[x.at[x.order]] = np.repeat(entry, x.b - x.a)
    need, summed = window - block + 1, np.concatenate([np.zeros(1, np.int64), np.cumsum(several)])
    all_several = summed[need:] - summed[:-need] == need
    # of equal upper halves the leftmost: the same in every copy of the window
    none = ~_LOW
    least = sliding_min(np.where(hit, np.minimum(grams & ~_LOW, none - _LOW - np.uint64(1)), none) | np.arange(len(grams), dtype=np.uint64), window - block + 1)
    text = w.text[: len(least)]
    fine = np.nonzero((np.arange(len(least)) + window <= w.first[1:][text]) & ((least & ~_LOW) != none) & all_several)[0] if len(least) else np.zeros(0, np.int64)
    gaps = np.cumsum(np.diff(fine, prepend=-1) > 1)
    own = (least[fine] & _LOW).astype(np.int64)
    a, b = runs(gaps * (len(grams) + 1) + own)
    first, count = fine[a], b - a
    return _found(rows, w, text[first], first, count, anchor=grams[own[a]], content=w.rolling.ranges(first, first + count + window - 1))


def _single(rows: pa.Table, wanted: pa.Table, window: int) -> pa.Table:
    """The windows of the wanted segments, one by one."""
    if not wanted.num_rows or not rows.num_rows:
        rows, wanted = rows.slice(0, 0), wanted.slice(0, 0)
    w, place = Words(rows.column("text")), _places(rows)
    text = np.array([place[k] for k in zip(*(wanted.column(c).to_pylist() for c in IDENTITY), strict=True)], np.int64)
    count = np.asarray(wanted.column("count"))
    text, first = np.repeat(text, count), np.repeat(w.first[text] + np.asarray(wanted.column("begin")), count) + spans(count)
    return _found(rows, w, text, first, np.ones(len(first), np.int64), content=w.rolling.ranges(first, first + window))


def _joined(w: Words, gone: np.ndarray) -> list[bytes]:
    """Each text's kept words, joined by one space."""
    length = (w.end - w.start)[~gone] + 1
    source = np.repeat(w.start[~gone], length) + spans(length)
    joined = np.append(w.data, np.uint8(32))[np.minimum(source, len(w.data))]
    joined[np.cumsum(length) - 1] = 32
    ends = np.concatenate([[0], np.cumsum(length)])[np.concatenate([[0], np.cumsum(~gone)])[w.first]]
    raw = joined.tobytes()
    return [raw[a : max(a, b - 1)] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def _cleaned(w: Words, gone: np.ndarray) -> list[bytes]:
    """The texts as they were, without the removed words and the blanks after each."""
    after = np.minimum(np.append(w.start[1:], len(w.data)), w.at[1:][w.text])
    left = ~covered(len(w.data), w.start[gone], after[gone])
    cuts = np.concatenate([[0], np.cumsum(left)])[w.at]
    raw = w.data[left].tobytes()
    return [raw[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


def _cut(rows: pa.Table, found: pa.Table, window: int, carry: bool) -> pa.Table:
    done, lists = [], found.column("found").combine_chunks()
    spot = _places(found)
    for batch in rows.to_batches():
        for part in pieces(batch, "text", 1 << 19):
            w = Words(part.column("text"))
            where = [spot.get(k) for k in zip(*(part.column(c).to_pylist() for c in IDENTITY), strict=True)]
            row = [i for i, x in enumerate(where) if x is not None]
            mine = lists.take(pa.array([where[i] for i in row], pa.int64()))
            inner = mine.flatten()
            text = np.repeat(np.array(row, np.int64), np.asarray(pc.list_value_length(mine)))
            begin = w.first[text] + np.asarray(inner.field("begin"))
            gone = covered(len(w.start), begin, begin + np.asarray(inner.field("count")) + window - 1)
            removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[w.first])
            out = {"doc_id": part.column("doc_id"), "n_words": pa.array(np.diff(w.first)), "n_removed": pa.array(removed.astype(np.int64))}
            texts = _cleaned(w, gone) if carry else _joined(w, gone)
            out["kept"] = pa.array([x.decode("utf-8", "replace") for x in texts], pa.string())
            if carry:
                out["carried"] = part.column("carried")
            else:
                out["kept_sha256"] = pa.array([hashlib.sha256(x).hexdigest() for x in texts], pa.string())
            done.append(pa.table(out))
    return pa.concat_tables(done)


def _place() -> object:
    return F.struct("no_id", *IDENTITY, "begin")


def remove_passages(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """Removes every word covered by a window of `window` words that also starts earlier.

    Words are `[^\\x20\\x09-\\x0D]+`; windows lie in one text and are judged on the input. Earlier
    is a smaller id, or an earlier start in the same text. Rows without id come after all others;
    different texts under one id, or without one, stand in the order of a hash of both; rows that
    agree in id and text are one document and get the same result each. Texts with fewer words
    than a window, null or empty ones keep what they have; a text of any length is in one batch;
    other columns are ignored; an empty table gives no rows.

    Returns doc_id, n_words, n_removed, kept (the kept words joined by one space) and kept_sha256;
    with `carry` kept has the text's own blanks, and a struct of the other columns follows instead
    of the digest. The texts are shuffled once and read for the probe, the extension and the cut. A
    batch sends a window once, in four bytes, however often it holds it, and gets two bits back;
    hashes cut so short can only propose too much, as all that is removed is matched by full ones.
    Buckets are as many as keep the windows of one to those of `_BUCKET` bytes of text, so batches
    and buckets stay of one size as the table grows, and no more rows are sent than there are
    windows. The choice of the earliest is a minimum taken before a shuffle, so a passage that is
    everywhere costs each batch one entry.
    """
    block = window // 2
    texts, total = batched(docs, id_col, text_col, size=2 << 20, least=4, carry=carry)
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // _BUCKET + 1)
    grouped = texts.groupBy("batch")
    probes = grouped.applyInArrow(lambda rows: _probe(rows, block, buckets), "bucket long, batch long, windows binary")
    hits = probes.groupBy("bucket").applyInArrow(_hits, "bucket long, batch long, several binary, hits binary")
    ranges_of = _OWN_FIELDS + ", begin long, count long"
    found = grouped.cogroup(hits.groupBy("batch")).applyInArrow(lambda rows, hits: _extend(rows, hits, window, block, buckets), ranges_of + ", anchor long, content long")
    kinds = found.groupBy("anchor", "content").agg(F.min(_place()).alias("earliest"))
    mixed = kinds.groupBy("anchor").agg(F.count("*").alias("kinds")).filter("kinds > 1").select("anchor")
    placed = found.join(kinds, ["anchor", "content"]).withColumn("later", _place() > F.col("earliest"))
    wanted = placed.filter("not later").join(mixed, "anchor").select("batch", *IDENTITY, "begin", "count").distinct()
    single = grouped.cogroup(wanted.groupBy("batch")).applyInArrow(lambda rows, wanted: _single(rows, wanted, window), ranges_of + ", content long")
    leads = single.groupBy("content").agg(F.min(_place()).alias("earliest"))
    later = single.join(leads, "content").filter(_place() > F.col("earliest"))
    ranges = placed.filter("later").select("batch", *IDENTITY, "begin", "count").unionByName(later.select("batch", *IDENTITY, "begin", "count"))
    lists = ranges.groupBy("batch", *IDENTITY).agg(F.collect_list(F.struct("begin", "count")).alias("found"))
    fields = "doc_id long, n_words long, n_removed long, kept string" + ", kept_sha256 string" * (not carry)
    return grouped.cogroup(lists.groupBy("batch")).applyInArrow(lambda rows, found: _cut(rows, found, window, carry), schema_of(fields, texts))


def dedup_passages(docs: DataFrame, text_col: str = "text", **more) -> DataFrame:
    """The rows of docs with repeated passages gone from the text; rows that lose every word go.

    Null and empty texts have no passages and stay as they are; rows without an id come last; a text of any
    length is one row; other columns stay, whatever their names; an empty table gives no rows.
    """
    cut = remove_passages(docs, text_col=text_col, carry=True, **more)
    return restored(cut.filter((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words"))), docs, "kept", text_col)


def digests(cut: DataFrame) -> DataFrame:
    """The contract's columns from remove_passages()'s."""
    return cut.select("doc_id", "n_words", "n_removed", "kept_sha256")
