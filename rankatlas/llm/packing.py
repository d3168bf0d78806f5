"""Packing by power-of-two decomposition: no sequence crosses documents and none has padding."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import pieces, spans, trim
from .bpe import get_encoder


def decompose(n: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of documents of n tokens: document, start and length; as many of the longest as fit, then falling powers of two."""
    bits = longest.bit_length() - 1
    full, rest = n >> bits, n & (longest - 1)
    rows = [np.repeat(np.arange(len(n)), full)]
    starts, lengths = [spans(full) << bits], [np.full(len(rows[0]), longest)]
    for b in range(bits - 1, -1, -1):
        has = np.nonzero(rest >> b & 1)[0]
        rows.append(has)
        starts.append((full[has] << bits) + (rest[has] >> (b + 1) << (b + 1)))
        lengths.append(np.full(len(has), 1 << b))
    return np.concatenate(rows), np.concatenate(starts), np.concatenate(lengths)


def pack(docs: DataFrame, tokenizer: str, longest: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Sequences of equal power-of-two lengths, one piece of a document each.

    Returns a row a piece: doc_id, start, length, ids (binary, little-endian unsigned 32-bit),
    doc_tokens, bucket (log2 of length; the column to write or batch by), sequence_id and offset
    (0: a piece fills its sequence). Sequences come bucket by bucket from each stretch of documents;
    write_buckets() lays out a folder for each. A null or empty text is the end id alone; repeated rows are
    packed each; null ids stay; other columns are ignored; an empty table gives no rows. A text of any length is cut in its own task's batch.
    There is no shuffle. sequence_id is unique in the result and its low four bits are the bucket;
    longest must be a power of two below 2**16.
    """
    if longest < 1 or longest & (longest - 1) or longest >= 1 << 16:
        raise ValueError("longest must be a power of two below 2**16")

    def run(batches):
        trim()
        words_of = get_encoder(tokenizer)
        for batch in batches:
            trim()
            for part in pieces(batch, "text", 2 << 20):
                ids, at = words_of.ids(part.column("text"))
                n = np.diff(at) + 1
                ids = np.insert(ids, at[1:], np.uint32(end_id)).astype("<u4")
                first = at[:-1] + np.arange(len(n))
                row, start, length = decompose(n, longest)
                order = np.lexsort((start, row))
                row, start, length = row[order], start[order], length[order]
                # the pieces lie end to end in ids, so their ends are the offsets of one binary array
                ends = np.concatenate([[0], np.cumsum(length)]) * 4
                binary = pa.Array.from_buffers(pa.binary(), len(row), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(ids)])
                assert not len(row) or (first[row] + start == ends[:-1] // 4).all()
                bucket = np.log2(length).astype(np.int32)
                cols = [part.column("doc_id").take(pa.array(row)), pa.array(start), pa.array(length.astype(np.int64)), binary, pa.array(n[row]), pa.array(bucket)]
                found = pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "length", "ids", "doc_tokens", "bucket"])
                yield found.take(pa.array(np.argsort(bucket, kind="stable")))  # bucket by bucket

    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    cut = plain.mapInArrow(run, "doc_id long, start long, length long, ids binary, doc_tokens long, bucket int")
    number = F.monotonically_increasing_id() * 16 + F.col("bucket")
    return cut.withColumn("sequence_id", number).withColumn("offset", F.lit(0).cast("long"))


def write_buckets(packed: DataFrame, path: str, size: int = 128 << 20) -> None:
    """Writes a folder for each bucket, bucket=0 and up, so that a batch of equal lengths is read from one.

    Each bucket is dealt to as many files as keep one to about `size` bytes of ids, by the sequence;
    the largest bucket of a long corpus goes to as many tasks.
    """
    sums = {r.bucket: r.n for r in packed.groupBy("bucket").agg(F.sum("length").alias("n")).collect()}  # twelve rows at most
    files = F.create_map(*(F.lit(x) for b, n in sums.items() for x in (b, max(1, n * 4 // size)))) if sums else F.create_map(F.lit(0), F.lit(1))
    dealt = packed.withColumn("file", F.pmod(F.xxhash64("sequence_id"), files[F.col("bucket")]))
    dealt.repartition("bucket", "file").drop("file").write.partitionBy("bucket").parquet(path)


def digests(packed: DataFrame) -> DataFrame:
    """The contract's columns from pack()'s."""
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket")
