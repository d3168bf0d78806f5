"""Token counts by a two-tier lookup: a broadcast table of frequent pre-tokens, and a memory of the others in each worker.

A text's token count is the sum over its pre-tokens, so only their lengths are needed, and no
pre-token has to meet its equals from other tasks.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import KEPT, let_go, mix, pieces, spans, text_bytes
from .bpe import byte_names
from .frames import written

OTHER, LETTER, NUMBER, SPACE, UNKNOWN = 0, 1, 2, 3, 255
#: Bytes of the longest pre-token that has an exact key: its bytes and its length in 16 bytes.
SHORT = 15
_MASK = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def exact_keys(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit halves for each range of at most SHORT bytes: the bytes themselves, and their number on top."""
    padded = np.concatenate([data, np.zeros(16, np.uint8)])
    loads = np.ndarray((len(data) + 9,), "<u8", padded, strides=(1,))
    size = end - start
    low = loads[start] & _MASK[np.minimum(size, 8)]
    high = loads[start + 8] & _MASK[np.clip(size - 8, 0, 8)]
    return low, high | size.astype(np.uint64) << np.uint64(56)


def key_bytes(low: int, high: int) -> bytes:
    return (low.to_bytes(8, "little") + high.to_bytes(8, "little"))[: high >> 56]


class Table:
    """Lengths by exact key in open addressing: `low`, `high` and `length` by slot, high 0 where it is free."""

    def __init__(self, keys: list[tuple[int, int]], lengths: list[int]):
        self.bits = max(4, (4 * len(keys)).bit_length())
        self.low, self.high, self.length = np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.uint64), np.zeros(1 << self.bits, np.int64)
        for (low, high), n in zip(keys, lengths, strict=True):
            slot = int(self._slot(np.array([low], np.uint64), np.array([high], np.uint64))[0])
            while self.high[slot]:
                slot = (slot + 1) % len(self.high)
            self.low[slot], self.high[slot], self.length[slot] = low, high, n

    def _slot(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return (mix(low ^ high * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The length of each key, 0 where the table lacks it."""
        out, left = np.zeros(len(low), np.int64), np.arange(len(low))
        slot = self._slot(low, high)
        while len(left):
            there = self.high[slot]
            hit = (there == high[left]) & (self.low[slot] == low[left])
            out[left[hit]] = self.length[slot[hit]]
            on = ~hit & (there != 0)
            left, slot = left[on], (slot[on] + 1) % len(self.high)
        return out


class PreTokens:
    """Cuts texts as the byte-level pre-tokenizer of a tokenizer file does, all texts of a window at once."""

    def __init__(self, path: str, keep: int = 400_000):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec["pre_tokenizer"] or {}
        if spec["normalizer"] or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex") or spec["model"]["type"] != "BPE":
            raise ValueError("a byte-level BPE without normalizer and prefix space is needed")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that depend on their neighbours are not supported")
        library = Tokenizer.from_file(path)
        self.cut, self.model = library.pre_tokenizer, library.model
        named = sorted((t["content"].encode() for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile(b"|".join(map(re.escape, named))) if named else None
        self.letters = str.maketrans({chr(b): c for b, c in enumerate(byte_names())})
        self.kind = np.full(0x110000, UNKNOWN, np.uint8)
        self._learn(np.arange(0x300))
        self.known: dict[bytes, int] = {}
        self.keep = keep

    def _learn(self, codes: np.ndarray) -> None:
        """Kinds of characters, asked of the library: its Unicode tables are not Python's."""
        alone = lambda c, by: len(self.cut.pre_tokenize_str(by + c)) == 1
        for code in codes.tolist():
            c = chr(code)
            self.kind[code] = LETTER if alone(c, "a") else NUMBER if alone(c, "1") else OTHER if alone(c, "!") else SPACE

    def kinds(self, codes: np.ndarray) -> np.ndarray:
        out = self.kind[codes]
        if (out == UNKNOWN).any():
            self._learn(np.unique(codes[out == UNKNOWN]))
            out = self.kind[codes]
        return out

    def split(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the pre-tokens of texts that lie end to end with offsets `at`, and places of special tokens.

        The rules, in order: an apostrophe that begins a pre-token takes s, t, m, d, re, ve or ll
        after it; letters, numbers and others are runs that take one blank before them; of white
        space before another character the last one stands alone or is that blank.
        """
        edges, specials = [at[:-1][np.diff(at) > 0]], []
        if self.special is not None:
            for m in self.special.finditer(data.tobytes()):
                a, b = m.span()
                if np.searchsorted(at, a, "right") == np.searchsorted(at, b - 1, "right"):  # within one text
                    specials.append((a, b))
            edges.append(np.array([x for s in specials for x in s if x < len(data)], np.int64))
        edge = np.concatenate(edges)
        lead = np.nonzero((data & 0xC0) != 0x80)[0] if len(data) and data.max() > 127 else None
        codes = data.astype(np.int32) if lead is None else _code_points(data, lead)
        kind, n = self.kinds(codes), len(codes)
        head = np.zeros(n + 3, bool)
        head[edge if lead is None else np.searchsorted(lead, edge)] = True
        head[n:] = True
        start = head[:n].copy()
        start[1:] |= kind[1:] != kind[:-1]
        after = np.nonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & ~head[1:n])[0] + 1
        start[after - 1] = True
        start[after[codes[after - 1] == 32]] = False
        quote = np.nonzero(codes == 39)[0]
        quote = quote[start[quote] & ~head[quote + 1]]
        one = codes[quote + 1]
        two = np.where(head[quote + 2], 0, codes[np.minimum(quote + 2, n - 1)])
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        start[quote[short | long] + 1] = False
        for chosen, width in ((short, 2), (long, 3)):
            ends = quote[chosen] + width
            start[ends[ends < n]] = True
        begin = np.nonzero(start)[0]
        if lead is not None:
            begin = lead[begin]
        end = np.append(begin[1:], len(data))[: len(begin)]
        inside = np.array(specials, np.int64).reshape(-1, 2)
        if len(inside):
            near = np.searchsorted(inside[:, 0], begin, "right") - 1
            plain = (near < 0) | (begin >= inside[near, 1])
            begin, end = begin[plain], end[plain]
        return begin, end, inside[:, 0]

    def length(self, token: bytes) -> int:
        """Tokens of one pre-token."""
        return len(self.model.tokenize(token.decode("latin-1").translate(self.letters)))

    def lengths(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray, table: Table) -> np.ndarray:
        """Tokens of each pre-token: from the table, or from this worker's memory, or by encoding it once."""
        out, size = np.zeros(len(begin), np.int64), end - begin
        short = np.nonzero(size <= SHORT)[0]
        out[short] = table.find(*exact_keys(data, begin[short], end[short]))
        miss = np.nonzero(out == 0)[0]
        if len(miss):
            size = size[miss]
            ends = np.concatenate([[0], np.cumsum(size)])
            text = data[np.repeat(begin[miss], size) + spans(size)]
            coded = pa.Array.from_buffers(pa.large_binary(), len(miss), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(text)]).dictionary_encode()
            distinct, known = coded.dictionary.to_pylist(), self.known
            found = list(map(known.get, distinct))
            if len(known) > self.keep:
                known.clear()
            for i, x in enumerate(found):
                if x is None:
                    found[i] = self.length(distinct[i])
                    if len(distinct[i]) <= 64:
                        known[distinct[i]] = found[i]
            out[miss] = np.array(found, np.int64)[np.asarray(coded.indices)]
        return out


def _code_points(data: np.ndarray, lead: np.ndarray) -> np.ndarray:
    """The characters that begin at `lead`, of valid UTF-8."""
    first = data[lead].astype(np.int32)
    out = first.copy()
    for least, most, bits, more in ((0xC0, 0xE0, 0x1F, 1), (0xE0, 0xF0, 0x0F, 2), (0xF0, 0x100, 0x07, 3)):
        at = np.nonzero((first >= least) & (first < most))[0]
        code = first[at] & bits
        for k in range(1, more + 1):
            code = code << 6 | (data[lead[at] + k] & 0x3F)
        out[at] = code
    return out


def windows(data: np.ndarray, at: np.ndarray, size: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Stretches of about `size` bytes of texts: first and last byte, offsets of the texts' parts in it, and the text of each part.

    A longer text is cut before white space that follows a visible ASCII character: there a pre-token
    ends whatever stands around it, and no special token holds white space.
    """
    parts, owner = [at[:1]], []
    for i in np.nonzero(np.diff(at) > 0)[0].tolist():
        a, b = int(at[i]), int(at[i + 1])
        while b - a > size:
            from_ = a + size
            while from_ < b:
                look = data[from_ - 1 : min(b, from_ + 65536)]
                good = np.nonzero(((look[1:] == 32) | (look[1:] == 10)) & (look[:-1] > 32) & (look[:-1] < 127))[0]
                if len(good):
                    break
                from_ += 65536
            else:
                break
            a = from_ + int(good[0])
            parts.append(np.array([a]))
            owner.append(i)
        parts.append(np.array([b]))
        owner.append(i)
    edges, owners = np.concatenate(parts), np.array(owner, np.int64)
    first = 0
    while first < len(owners):
        last = max(first + 1, int(np.searchsorted(edges, edges[first] + size, side="right")) - 1)
        yield int(edges[first]), int(edges[last]), edges[first : last + 1] - edges[first], owners[first:last]
        first = last


@cache
def _cutter(path: str, pid: int) -> PreTokens:
    return PreTokens(path)


KEPT.append(_cutter.cache_clear)


def cutter(path: str) -> PreTokens:
    """One for each Python worker."""
    return _cutter(path, os.getpid())


def summed(low: np.ndarray, high: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal keys once, with their sums."""
    order = np.lexsort((low, high))
    low, high, count = low[order], high[order], count[order]
    head = np.concatenate([[True], (low[1:] != low[:-1]) | (high[1:] != high[:-1])])[: len(low)]
    at = np.nonzero(head)[0]
    return low[at], high[at], np.add.reduceat(count, at) if len(at) else count


def frequent(texts: DataFrame, tokenizer: str, share: int = 16_384, tracked: int = 32_768, size: int = 1 << 20) -> Table:
    """The lengths of all pre-tokens of at most SHORT bytes that are at least one in `share` of the corpus's.

    Every task counts the pre-tokens of all its texts and keeps the `tracked` most frequent: what it
    drops it takes off the others too, so each count is short of the truth by at most one in `tracked`
    of the task's pre-tokens. Only these summaries meet; no more than `share` keys can reach
    the driver and the broadcast, whatever the corpus, and lengths don't depend on them.
    """
    def run(batches):
        let_go()
        cut, total = cutter(tokenizer), 0
        low, high, count = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        for batch in batches:
            for part in pieces(batch, "text", size):
                data, at = text_bytes(part.column("text"))
                for a, b, edges, _ in windows(data, at, size):
                    begin, end, _ = cut.split(data[a:b], edges)
                    total += len(begin)
                    short = end - begin <= SHORT
                    lo, hi = exact_keys(data[a:b], begin[short], end[short])
                    _, at_, n = np.unique(mix(lo ^ hi * np.uint64(0x9E3779B97F4A7C15)), return_index=True, return_counts=True)
                    low, high, count = summed(np.concatenate([low, lo[at_]]), np.concatenate([high, hi[at_]]), np.concatenate([count, n]))
                    if len(count) > tracked:
                        count = count - np.partition(count, len(count) - tracked - 1)[len(count) - tracked - 1]
                        low, high, count = low[count > 0], high[count > 0], count[count > 0]
        often = count * tracked >= total
        yield pa.RecordBatch.from_arrays([pa.array(np.append(x[often], y).astype(np.uint64).view(np.int64)) for x, y in ((low, 0), (high, 0), (count, total))], ["low", "high", "n"])

    counted = written(texts.mapInArrow(run, "low long, high long, n long").groupBy("low", "high").agg(F.sum("n").alias("n")), "frequent-pre-tokens")
    total = counted.filter("high = 0").agg(F.sum("n")).first()[0] or 0
    rows = counted.filter((F.col("high") != 0) & (F.col("n") * share >= total)).select("low", "high").collect()  # at most `share`
    keys = [(r.low % (1 << 64), r.high % (1 << 64)) for r in rows]
    cut = PreTokens(tokenizer)
    return Table(keys, [cut.length(key_bytes(*k)) for k in keys])


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 512, share: int = 16_384, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token counts of every whole text: doc_id, n_bytes, n_tokens and over_limit (more than `limit` tokens).

    Counts are those of the tokenizers library without added begin or end; a special token's string
    inside a text is that one token. Null and empty texts have no tokens; repeated rows are counted
    each; null ids stay; other columns are ignored, whatever their names; an empty table gives no
    rows. A very long text is counted in stretches that end where a pre-token does.

    The first pass over the texts finds the frequent pre-tokens, the second counts. Pre-tokens are
    never shuffled; the broadcast table has at most `share` entries, and a worker's memory is bounded.
    """
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    table = docs.sparkSession.sparkContext.broadcast(frequent(plain.select("text"), tokenizer, share))

    def run(batches):
        let_go()
        cut = cutter(tokenizer)
        for batch in batches:
            for part in pieces(batch, "text"):
                data, at = text_bytes(part.column("text"))
                n = np.zeros(part.num_rows, np.int64)
                for a, b, edges, owners in windows(data, at, 1 << 20):
                    begin, end, special = cut.split(data[a:b], edges)
                    sums = np.concatenate([[0], np.cumsum(cut.lengths(data[a:b], begin, end, table.value))])
                    np.add.at(n, owners, np.diff(sums[np.searchsorted(begin, edges)]) + np.diff(np.searchsorted(special, edges)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(at)), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return plain.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
