"""Exact byte-substring dedup: a suffix array over the places that can repeat.

Every window of `width` bytes belongs to one anchor, the least-hashed gram in it, so equal windows
share their anchor's hash and the place of the anchor in them. Windows that lie next to each other
under one anchor form a segment. Equal segments are collapsed to one copy and their count. Where an
anchor has differing segments, one copy of each goes to the anchor's task, and their suffixes,
bucketed by the anchor's place, are sorted deep-shallow: ternary multikey quicksort to a shallow
depth, then a blind trie for each group that still agrees.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import BYTE_VALUES, Rolling, covered, let_go, pieces, runs, sliding_min, spans, text_bytes
from .frames import IDENTITY, checkpoint, keyed

_POSITION = np.uint64((1 << 32) - 1)


def segments(data: np.ndarray, at: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, ...]:
    """Segments of texts that lie end to end: text, start and end of the bytes its windows cover, place and hash of the anchor, content hash."""
    rolling = Rolling(BYTE_VALUES[data])
    grams = rolling.grams(gram)
    if len(data) < width:
        return (np.zeros(0, np.int64),) * 4 + (np.zeros(0, np.uint64),) * 2
    least = sliding_min((grams & ~_POSITION) | np.arange(len(grams), dtype=np.uint64), width - gram + 1)
    owner = (least & _POSITION).astype(np.int64)  # the leftmost of equal upper halves: the same in every copy of a window
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))[: len(owner)]
    ok = np.arange(len(owner)) + width <= at[1:][text]
    start = np.nonzero(ok)[0]
    a, b = runs(owner[start] * 1 + text[start] * (len(data) + 1))
    first, end = start[a], start[b - 1] + width if len(b) else start[:0]
    # a run of one owner in one text has no gap: windows that end in the text lie next to each other
    return text[first], first, end, owner[first] - first, grams[owner[first]], rolling.ranges(first, end)


_IDENTITY_FIELDS = "id_key long, row_key long"


def _anchor_rows(width: int, gram: int):
    def run(batches):
        let_go()
        for batch in batches:
            for part in pieces(batch, "text"):
                data, at = text_bytes(part.column("text"))
                text, first, end, place, anchor, content = segments(data, at, width, gram)
                keys = [part.column(c).take(pa.array(text)) for c in IDENTITY]
                begin, size = (first - at[text]).astype(np.int32), (end - first).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*keys, *map(pa.array, (begin, size, place.astype(np.int32), anchor.view(np.int64), content.view(np.int64)))], [*IDENTITY, "begin", "size", "place", "anchor", "content"])

    return run


def _segment_text(batches):
    for batch in batches:
        for part in pieces(batch, "text"):
            data, at = text_bytes(part.column("text"))
            wanted = part.column("wanted")
            inner, row = wanted.flatten(), np.repeat(np.arange(part.num_rows), np.asarray(pa.compute.list_value_length(wanted)))
            begin, size = np.asarray(inner.field("begin")), np.asarray(inner.field("size")).astype(np.int64)
            joined = data[np.repeat(at[row] + begin, size) + spans(size)]
            ends = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
            binary = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(joined))])
            of, told = pa.array(row), ["anchor", "begin", "place", "n"]
            yield pa.RecordBatch.from_arrays([*(part.column(c).take(of) for c in IDENTITY), *(inner.field(c) for c in told), binary], [*IDENTITY, *told, "bytes"])


def blind_trie(strings: list[bytes]) -> list[list[int]]:
    """Indices of equal strings, in the strings' order. All strings have the same length.

    A node is [depth, children by the byte there, any index below]; only branching bytes are kept.
    A string walks down blindly, is compared once with the leaf that it reaches, and is hung in
    where the two first differ.
    """
    length, same = len(strings[0]), [[0]]
    root: list | int = 0  # an int is a leaf: an index into same
    for i in range(1, len(strings)):
        s, node = strings[i], root
        while not isinstance(node, int):
            node = node[1].get(s[node[0]], node[2])
        other = strings[same[node][0]]
        if s == other:
            same[node].append(i)
            continue
        differ = int.from_bytes(s, "big") ^ int.from_bytes(other, "big")
        depth = length - (differ.bit_length() + 7) // 8
        same.append([i])
        leaf, above, node = len(same) - 1, None, root
        while not isinstance(node, int) and node[0] < depth:
            above, node = node, node[1][s[node[0]]]
        if not isinstance(node, int) and node[0] == depth:
            node[1][s[depth]] = leaf
        else:
            made = [depth, {other[depth]: node, s[depth]: leaf}, leaf]
            if above is None:
                root = made
            else:
                above[1][s[above[0]]] = made
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if isinstance(node, int):
            out.append(same[node])
        else:
            stack += [node[1][k] for k in sorted(node[1], reverse=True)]
    return out


def multikey_quicksort(word: np.ndarray, start: np.ndarray, group: np.ndarray, depth_limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes that agree with another of their group to the depth, and their new groups, end to end.

    word[i] holds the eight bytes from i on. All groups are partitioned at once: each takes the
    median of three suffixes' words as pivot and falls into less, equal and greater; the equal part
    moves on by eight bytes, single suffixes are done.
    """
    order = np.argsort(group, kind="stable")
    depth, done, done_groups, made = np.zeros(len(order), np.int64), [], [], 0
    group = group[order]
    while True:
        a, b = runs(group)
        n = b - a
        many = np.repeat(n > 1, n)
        order, depth, n = order[many], depth[many], n[n > 1]
        first = np.cumsum(n) - n
        over = depth[first] >= depth_limit if len(n) else np.zeros(0, bool)
        if over.any():
            ends = np.repeat(over, n)
            done.append(order[ends])
            done_groups.append(made + np.repeat(np.arange(over.sum()), n[over]))
            made += int(over.sum())
            order, depth, n = order[~ends], depth[~ends], n[~over]
            first = np.cumsum(n) - n
        if not len(order):
            break
        key = word[start[order] + depth]
        three = np.sort(np.stack([key[first], key[first + n // 2], key[first + n - 1]]), axis=0)
        pivot = np.repeat(three[1], n)
        side = (key >= pivot).astype(np.int8) + (key > pivot)
        depth = depth + 8 * (side == 1)
        # a stable partition of every group by counting
        at, base = np.empty(len(order), np.int64), np.repeat(first, n)
        for k in range(3):
            mine = side == k
            rank = np.cumsum(mine)
            count = np.add.reduceat(mine.astype(np.int64), first)
            before = rank[first] - mine[first]
            at[mine] = (base + rank - 1 - np.repeat(before, n))[mine]
            base = base + np.repeat(count, n)
        group = np.empty(len(order), np.int64)
        group[at] = np.repeat(np.arange(len(n)), n) * 3 + side
        order, depth = _placed(order, at), _placed(depth, at)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *done]), np.concatenate([none, *done_groups])


def _placed(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    out = np.empty_like(values)
    out[at] = values
    return out


def repeated_suffixes(data: bytes, group: np.ndarray, start: np.ndarray, width: int, shallow: int = 32) -> np.ndarray:
    """Which suffixes, sorted within their groups, share their first `width` bytes with another."""
    raw = np.frombuffer(data + bytes(8), np.uint8)
    word = np.zeros(len(raw) - 7, np.uint64)
    for i in range(8):
        word = word << np.uint64(8) | raw[i : len(raw) - 7 + i]
    out = np.zeros(len(start), bool)
    left, ids = multikey_quicksort(word, start, group, min(shallow, width) // 8 * 8)
    depth = min(shallow, width) // 8 * 8
    a, b = runs(ids)
    # two suffixes make a trie of one branch: they are compared word by word, all pairs at once
    x, y = left[a[b - a == 2]], left[a[b - a == 2] + 1]
    for d in [*range(depth, width - 7, 8), width - 8]:
        same = word[start[x] + d] == word[start[y] + d]
        x, y = x[same], y[same]
    out[x] = out[y] = True
    more = b - a > 2
    where = start[left].tolist()
    for i, j in zip(a[more].tolist(), b[more].tolist(), strict=True):
        for equal in blind_trie([data[p : p + width] for p in where[i:j]]):
            if len(equal) > 1:
                out[left[[i + k for k in equal]]] = True
    return out


_WINDOW = ["anchor", "at", "content"]


def _windows(width: int):
    """All windows of segments, one by one, with the place of the anchor in each and a hash of its bytes."""

    def run(batches):
        for batch in _segment_text(batches):
            for rows in pieces(batch, "bytes", 1 << 16):
                data, at = text_bytes(rows.column("bytes"))
                count = np.diff(at) - width + 1
                row, offset = np.repeat(np.arange(rows.num_rows), count), spans(count)
                start = at[row] + offset
                content = Rolling(BYTE_VALUES[data]).ranges(start, start + width)
                column = lambda c: np.asarray(rows.column(c))[row].astype(np.int64)  # noqa: E731, B023
                begin = column("begin") + offset
                columns = [*map(column, IDENTITY), begin, begin + width, column("n"), column("anchor"), column("place") - offset, content.view(np.int64)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], [*IDENTITY, "begin", "end", "n", *_WINDOW])

    return run


def _sorted_repeats(width: int, chunk: int):
    """Of segments in the order of their anchors: ranges of repeated windows."""

    def work(rows: pa.Table) -> pa.RecordBatch:
        data, at = text_bytes(rows.column("bytes"))
        count = np.diff(at) - width + 1
        row, offset = np.repeat(np.arange(rows.num_rows), count), spans(count)
        a, b = runs(np.asarray(rows.column("anchor")))
        group = np.repeat(np.arange(len(a)), b - a)[row] * (2 * width) + np.asarray(rows.column("place"))[row] - offset + width
        single = (np.asarray(rows.column("n")) == 1)[row]
        keep = repeated_suffixes(data.tobytes(), group, at[row] + offset, width) & single
        a, b = runs(np.where(keep, row, -1))
        good = keep[a] if len(a) else np.zeros(0, bool)
        a, b = a[good], b[good]
        begin = np.asarray(rows.column("begin"))[row[a]].astype(np.int64)
        keys = [pa.array(np.asarray(rows.column(c))[row[a]]) for c in IDENTITY]
        return pa.RecordBatch.from_arrays([*keys, pa.array(begin + offset[a]), pa.array(begin + offset[b - 1] + width)], [*IDENTITY, "begin", "end"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.nbytes
            if size > chunk:
                rows = pa.Table.from_batches(held)
                anchors = np.asarray(rows.column("anchor"))
                whole = int(np.nonzero(anchors != anchors[-1])[0][-1]) + 1 if (anchors != anchors[-1]).any() else 0
                if whole:
                    yield work(rows.slice(0, whole))
                held = rows.slice(whole).to_batches()
                size = sum(b.nbytes for b in held) if whole else size
        if held and sum(b.num_rows for b in held):
            yield work(pa.Table.from_batches(held))

    return run


def _cut(batches):
    for batch in batches:
        for part in pieces(batch, "text"):
            data, at = text_bytes(part.column("text"))
            lists = part.column("found")
            inner, row = lists.flatten(), np.repeat(np.arange(part.num_rows), np.asarray(pa.compute.fill_null(pa.compute.list_value_length(lists), 0)))
            gone = covered(len(data), at[row] + np.asarray(inner.field("begin")), at[row] + np.asarray(inner.field("end")))
            total = np.concatenate([[0], np.cumsum(gone)])
            opens = gone.copy()
            opens[1:] &= ~gone[:-1]
            head = at[:-1][np.diff(at) > 0]
            opens[head] = gone[head]
            opened = np.concatenate([[0], np.cumsum(opens)])
            kept, left = data[~gone].tobytes(), at - total[at]
            rest = [kept[a:b] for a, b in zip(left[:-1].tolist(), left[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(np.diff(at)), pa.array(np.diff(total[at]).astype(np.int64)), pa.array(np.diff(opened[at]).astype(np.int64)), pa.array(rest, pa.binary()), pa.array([hashlib.sha256(x).hexdigest() for x in rest], pa.string())],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"],
            )


def remove_repeats(docs: DataFrame, width: int = 200, gram: int = 64, id_col: str = "doc_id", text_col: str = "text", chunk: int = 2 << 20, hot: int = 16_384) -> DataFrame:
    """Removes every byte covered by a `width`-byte string that also starts anywhere else.

    Texts are UTF-8 bytes; strings never cross texts and are judged on the input. Returns a row a
    row of docs: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept (binary: what is
    left may cut characters) and kept_sha256. Null texts count as empty and, like any text under
    `width` bytes, keep what they have; a text of any length is one row; rows that repeat lose all
    of a long enough text, each; null ids are results like any other; other columns are ignored; an
    empty table gives none.

    Anchors are found where the texts lie; texts are shuffled once, to be read for the bytes of the
    segments to compare and for the cut. Besides, only hashes and the segments that differ under a
    repeated anchor move; rows under repeated anchors are checkpointed, as three joins read them.
    Segments are the same if the hashes of their anchor and of their bytes agree, 128 bits.
    Counts are summed before a shuffle, and the joins that bring them back can be split by Spark
    where one anchor is very frequent. An anchor with more than `hot` different segments is not
    sorted in one task: its windows, each with the anchor's place, are rows that Spark counts.
    """
    if width < 8 or gram > width:
        raise ValueError("width must be 8 or more, and no less than gram")
    texts = keyed(docs, id_col, text_col)
    found = keyed(docs, id_col, text_col, deal=False).mapInArrow(_anchor_rows(width, gram), f"{_IDENTITY_FIELDS}, begin int, size int, place int, anchor long, content long")
    twice = found.groupBy("anchor").agg(F.count("*").alias("copies")).filter("copies > 1").select("anchor")
    near = checkpoint(found.join(twice, "anchor")).withColumn("own", F.xxhash64(*IDENTITY, "begin"))
    kinds = near.groupBy("anchor", "content").agg(F.count("*").alias("n"), F.min("own").alias("copy"))
    mixed = checkpoint(kinds.groupBy("anchor").agg(F.count("*").alias("kinds")).filter("kinds > 1"))
    counted = near.join(kinds, ["anchor", "content"])
    whole = counted.filter("n > 1").select(*IDENTITY, F.col("begin").cast("long").alias("begin"), (F.col("begin") + F.col("size")).cast("long").alias("end"))

    def chosen(anchors: DataFrame) -> DataFrame:
        """The texts that hold one copy of each kind of segment of these anchors, with those."""
        one = counted.filter("own = copy").join(anchors.select("anchor"), "anchor")
        return texts.join(one.groupBy(*IDENTITY).agg(F.collect_list(F.struct("anchor", "begin", "size", "place", "n")).alias("wanted")), IDENTITY)

    segments_ = chosen(mixed.filter(F.col("kinds") <= hot)).mapInArrow(_segment_text, f"{_IDENTITY_FIELDS}, anchor long, begin int, place int, n long, bytes binary")
    ranges = whole.unionByName(segments_.repartition("anchor").sortWithinPartitions("anchor").mapInArrow(_sorted_repeats(width, chunk), f"{_IDENTITY_FIELDS}, begin long, end long"))
    if mixed.filter(F.col("kinds") > hot).limit(1).count():
        # in the same plan, so that the exchange of the texts is used again
        windows = chosen(mixed.filter(F.col("kinds") > hot)).mapInArrow(_windows(width), f"{_IDENTITY_FIELDS}, begin long, end long, n long, anchor long, at long, content long")
        again = windows.groupBy(*_WINDOW).agg(F.count("*").alias("copies")).filter("copies > 1").select(*_WINDOW)
        ranges = ranges.unionByName(windows.filter("n = 1").join(again, _WINDOW).select(*IDENTITY, "begin", "end"))
    lists = ranges.groupBy(*IDENTITY).agg(F.collect_list(F.struct("begin", "end")).alias("found"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string"
    return texts.join(lists, IDENTITY, "left").mapInArrow(_cut, schema)


def digests(cut: DataFrame) -> DataFrame:
    """The contract's columns from remove_repeats()'s."""
    return cut.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
