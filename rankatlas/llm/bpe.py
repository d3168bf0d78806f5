"""BPE encoding through the trie of distinct words, laid out depth-first.

Every node, a prefix of some word, holds the last token of that prefix's encoding. A token that ends a longer prefix is the one whose left neighbour, the last token of
what precedes it, stands beside it unmerged; so a prefix that many words share is worked out once,
and a word's encoding is read back from its end.
"""

from __future__ import annotations

import json
import os
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import KEPT, SPACE, pieces, spans, text_bytes, trim, words

END = "</w>"
#: The tokenizer file's own split pattern, with its white space spelt out.
_SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+")
_PLAIN = regex.compile(r"[!-~¡-įı-ɏ]+")


def byte_names() -> list[str]:
    """The visible character that stands for each byte: itself if printable in Latin-1, else the next one from U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    names, extra = {b: chr(b) for b in shown}, 256
    for b in range(256):
        if b not in names:
            names[b], extra = chr(extra), extra + 1
    return [names[b] for b in range(256)]


class WordEncoder:
    """Encodes distinct words; remembers up to `keep` of them between batches, in two generations: what half of them didn't ask for is forgotten."""

    _SLOTS, _ALONE = 1 << 21, (1 << 20) - 1

    def __init__(self, path: str, keep: int = 600_000):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        names = byte_names()
        raw = {c: b for b, c in enumerate(names)}
        vocab = spec["model"]["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.library, self.special = Tokenizer.from_file(path), {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.names = {i: t for t, i in [*vocab.items(), *self.special.items()]}
        self.raw = str.maketrans({c: chr(b) for c, b in raw.items()})
        self.parts = {vocab[a + b]: (vocab[a], vocab[b]) for a, b in merges}
        self.pair_rank = {(vocab[a], vocab[b]): i for i, (a, b) in enumerate(merges)}
        self.joined, self.ids_of = {p: t for t, p in self.parts.items()}, vocab
        self.made = [-1] * (max(vocab.values()) + 1)
        for i, (a, b) in enumerate(merges):
            self.made[vocab[a + b]] = i
        self.inner = self._by_length({bytes(raw[c] for c in t): i for t, i in vocab.items() if not t.endswith(END)})
        self.final = self._by_length({bytes(raw[c] for c in t.removesuffix(END)): i for t, i in vocab.items() if t.endswith(END)})
        self.pair_key, self.pair_fits = np.zeros(self._SLOTS, np.int64) - 1, np.zeros(self._SLOTS, bool)
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.keep = keep

    @staticmethod
    def _by_length(vocab: dict[bytes, int]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For each length from 1: the sorted keys of tokens so long, their ids and their bytes."""
        longest = max(map(len, vocab))
        out = []
        for n in range(1, longest + 1):
            of = [(t, i) for t, i in vocab.items() if len(t) == n]
            text = np.frombuffer(b"".join(t for t, _ in of), np.uint8).reshape(-1, n)
            keys, ids = WordEncoder._keys([text[:, n - 1 - j] for j in range(n)]), np.array([i for _, i in of], np.int64)
            order = np.argsort(keys)
            if len(np.unique(keys)) < len(keys):
                raise ValueError("two tokens have one key")
            out.append((keys[order], ids[order], text[order]))
        return out

    @staticmethod
    def _keys(columns: list[np.ndarray]) -> np.ndarray:
        """A key of the bytes in these columns, the last byte first: no two tokens of a length share one, but other texts may, so bytes are compared."""
        key = np.zeros(len(columns[0]), np.uint64)
        for c in columns:
            key = WordEncoder._longer(key, c)
        return key

    @staticmethod
    def _longer(key: np.ndarray, byte: np.ndarray) -> np.ndarray:
        return key * np.uint64(0x100000001B3) + byte.astype(np.uint64) + np.uint64(1)

    def pair(self, left: int, right: int) -> bool:
        """Whether the two tokens' joined text is encoded as just these two; without a left one, whether the right one is its text's encoding.

        It is not if, while both sides are being built, a pair that meets at the seam has a merge
        that comes before the later merge of either side. Undoing merges from the last one on gives
        each pair that ever meets there.
        """
        parts, made, rank = self.parts, self.made, self.pair_rank
        if left == self._ALONE:
            return self._merged_alone(right)
        before = 1 << 30
        while True:
            if rank.get((left, right), 1 << 30) < before:
                return False
            a, b = made[left], made[right]
            if a < 0 and b < 0:
                return True
            if a > b:  # the left side's last merge came later
                before, left = a, parts[left][1]
            else:  # among equal ranks the leftmost merge comes first, so one at the seam precedes the right side's
                before, right = b + 1, parts[right][0]

    def _merged_alone(self, token: int) -> bool:
        """Plain BPE of a token's own text ends in that token."""
        name = self.names[token].removesuffix(END)
        symbols = [*name]
        if self.names[token].endswith(END):
            symbols[-1] += END
        symbols = [self.ids_of[x] for x in symbols]
        while len(symbols) > 1:
            best, at = min((self.pair_rank.get(p, 1 << 30), i) for i, p in enumerate(zip(symbols, symbols[1:], strict=False)))
            if best == 1 << 30:
                return False
            symbols[at : at + 2] = [self.joined[symbols[at], symbols[at + 1]]]
        return symbols == [token]

    def pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 20 | right
        slot = (key * 0x9E3779B1 >> 13) & (self._SLOTS - 1)
        fits, miss = self.pair_fits[slot], self.pair_key[slot] != key
        if miss.any():
            new, where = np.unique(key[miss], return_inverse=True)
            found = np.array([self.pair(k >> 20, k & self._ALONE) for k in new.tolist()], bool)
            fits[miss] = found[where]
            self.pair_key[slot[miss]], self.pair_fits[slot[miss]] = key[miss], fits[miss]
        return fits

    def _last(self, text: np.ndarray, row: np.ndarray, end: np.ndarray, vocab: list, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Last token of the encoding of each row's first `end` bytes, and where that token begins."""
        token, begin = np.full(len(row), -1), np.zeros(len(row), np.int64)
        left, key = np.arange(len(row)), np.zeros(len(row), np.uint64)
        for n, (keys, ids, bytes_) in enumerate(vocab, 1):
            more = end[left] >= n
            left, key = left[more], key[more]
            if not len(left):
                break
            at = end[left] - n
            key = self._longer(key, text[row[left], at])
            if not len(keys):
                continue
            spot = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            is_token = np.nonzero(keys[spot] == key)[0]
            if not len(is_token):
                continue
            found = ids[spot[is_token]]
            good = self.pairs(last[row[left[is_token]], at[is_token]].astype(np.int64), found)
            hit = is_token[good]
            hit = hit[(text[row[left[hit], None], at[hit, None] + np.arange(n)] == bytes_[spot[hit]]).all(1)]
            token[left[hit]], begin[left[hit]] = ids[spot[hit]], at[hit]
            rest = np.ones(len(left), bool)
            rest[hit] = False
            left, key = left[rest], key[rest]
        if (token < 0).any():
            raise ValueError("the vocabulary lacks a single byte")
        return token, begin

    def encode_pieces(self, distinct: list[bytes]) -> dict[bytes, bytes]:
        """Packed token ids of pieces.

        Sorted, the pieces are the trie in depth-first order: those with the same first bytes lie
        together, and the first of them stands for their common node. Each node's state comes from
        the states of the nodes above it, all nodes of a depth at once.
        """
        out: dict[bytes, bytes] = {}
        distinct = sorted(distinct, key=len)
        first = 0
        while first < len(distinct):
            # groups of similar length, so that one long piece doesn't widen all rows
            wide = max(16, 2 * len(distinct[first]))
            last = first
            while last < len(distinct) and len(distinct[last]) <= wide and (last - first) * wide < 1 << 22:
                last += 1
            out |= self._encode_group(sorted(distinct[first:last]))
            first = last
        return out

    def _encode_group(self, words_: list[bytes]) -> dict[bytes, bytes]:
        n, size = len(words_), np.array([len(w) for w in words_])
        width = int(size.max())
        text = np.zeros((n, width), np.uint8)
        text[np.repeat(np.arange(n), size), spans(size)] = np.frombuffer(b"".join(words_), np.uint8)
        same = np.zeros(n, np.int64)  # leading bytes shared with the row before
        if n > 1:
            alike = text[1:] == text[:-1]
            same[1:] = np.minimum(np.where(alike.all(1), width, alike.argmin(1)), np.minimum(size[1:], size[:-1]))
        last, begin = np.full((n, width), self._ALONE, np.int32), np.zeros((n, width), np.int32)
        for depth in range(1, width):
            rows = np.nonzero(size > depth)[0]
            node = np.cumsum(same < depth)[rows]
            head = np.concatenate([[True], node[1:] != node[:-1]])
            token, at = self._last(text, rows[head], np.full(int(head.sum()), depth), self.inner, last)
            of = np.cumsum(head) - 1
            last[rows, depth], begin[rows, depth] = token[of], at[of]
        token, at = self._last(text, np.arange(n), size, self.final, last)
        back, live = [token], at
        while live.any():
            back.append(np.where(live > 0, last[np.arange(n), live], -1))
            live = np.where(live > 0, begin[np.arange(n), live], 0)
        ids = np.stack(back[::-1], 1)
        there = ids >= 0
        raw, ends = ids[there].astype("<u4").tobytes(), np.cumsum(there.sum(1)) * 4
        return {w: raw[a:b] for w, a, b in zip(words_, [0, *ends[:-1].tolist()], ends.tolist(), strict=True)}

    def split(self, word: str) -> list[bytes | int]:
        """A word's pieces; a special token's id stands for itself."""
        if _PLAIN.fullmatch(word) and "<|" not in word:
            low = word.lower()
            if low[-1] in ".,!" and low[:-1].isalpha():
                return [low[:-1].encode(), low[-1].encode()]
            return [low.encode()] if low.isalpha() else [x.encode() for x in _SPLIT.findall(low)]
        out: list[bytes | int] = []
        for part in self.special_split.split(word) if self.special_split else [word]:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                named = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(part))
                out += [x.translate(self.raw).encode("latin-1") for x, _ in named if x]
        return out

    def encode_words(self, distinct: list[bytes]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each word."""
        known = self.known
        out = list(map(known.get, distinct))
        missing = []
        for i, x in enumerate(out):
            if x is None:
                if (x := self.older.get(distinct[i])) is None:
                    missing.append(i)
                else:
                    out[i] = known[distinct[i]] = x
        if len(known) + len(missing) > self.keep // 2:
            self.older, self.known = known, {}
            known = self.known
        parts, wanted = [], set()
        for i in missing:
            w = distinct[i]
            p = w.lower() if w.isalpha() else self.split(w.decode("utf-8", "replace"))  # of bytes: letters of ASCII only
            parts.append(p)
            if isinstance(p, bytes):
                wanted.add(p)
            else:
                wanted.update(x for x in p if isinstance(x, bytes))
        ids = self.encode_pieces(list(wanted))
        for i, p in zip(missing, parts, strict=True):
            out[i] = known[distinct[i]] = ids[p] if isinstance(p, bytes) else b"".join([ids[x] if isinstance(x, bytes) else int(x).to_bytes(4, "little") for x in p])
        return out

    def encode(self, column: pa.Array) -> tuple[np.ndarray, list[bytes], np.ndarray]:
        """A text column as codes into its distinct words, those words' packed ids, and n + 1 offsets into the codes."""
        data, at = text_bytes(column)
        if not len(data):
            return np.zeros(0, np.int64), [], np.zeros(len(at), np.int64)
        start, end, first = words(data, at)
        ends = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int64)
        ink = np.ascontiguousarray(data[~SPACE[data]])
        coded = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(ends), pa.py_buffer(ink)]).dictionary_encode()
        return np.asarray(coded.indices), self.encode_words(coded.dictionary.to_pylist()), first

    def gathered(self, codes: np.ndarray, packed: list[bytes], first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """encode()'s result as all ids and n + 1 offsets."""
        if not len(codes):
            return np.zeros(0, "<u4"), np.zeros(len(first), np.int64)
        pool, size = np.frombuffer(b"".join(packed), "<u4"), np.array([len(p) // 4 for p in packed], np.int64)
        begin, count = (np.cumsum(size) - size)[codes], size[codes]
        return pool[np.repeat(begin, count) + spans(count)], np.concatenate([[0], np.cumsum(count)])[first]

    def ids(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a text column and n + 1 offsets."""
        return self.gathered(*self.encode(column))


@cache
def encoder(path: str, pid: int) -> WordEncoder:
    """One for each Python worker."""
    return WordEncoder(path)


KEPT.append(encoder.cache_clear)


def get_encoder(path: str) -> WordEncoder:
    return encoder(path, os.getpid())


def encode_decode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes every text: doc_id, ids array<int>, decoded string.

    Null or empty texts have no ids and decode to an empty string; null ids stay; repeated rows are
    encoded each; other columns are ignored, whatever their names; an empty table gives no rows; a
    text of any length is encoded whole, in a piece of its own. There is no shuffle: each batch
    encodes its distinct words once, and workers keep a bounded memory of words.
    """
    def run(batches):
        trim()
        words_of = get_encoder(tokenizer)
        for batch in batches:
            for part in pieces(batch, "text", 2 << 20):
                codes, packed, first = words_of.encode(part.column("text"))
                ids, at = words_of.gathered(codes, packed, first)
                named = [" ".join([words_of.names[i] for i in np.frombuffer(p, "<u4").tolist()]) for p in packed]
                decoded = [" ".join([x for x in map(named.__getitem__, codes[a:b].tolist()) if x]) for a, b in zip(first, first[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32))), pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"])

    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return plain.mapInArrow(run, "doc_id long, ids array<int>, decoded string")


def digests(encoded: DataFrame) -> DataFrame:
    """The contract's columns from encode_decode()'s."""
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
