"""Operator 9: packing by power-of-two decomposition.

A document of T ids is cut into T // W pieces of the window W (a power of two) and one piece per set
bit of the rest, longest first. Each piece is a sequence of its own: its length is a power of two, so
it needs no padding, sequences of one length form a bucket (``length``) that is batched
together, and no sequence holds ids of two documents. A map over the scan, no shuffle.

``write_buckets`` groups the sequences: a folder per length, cut into parts of about ``part_bytes`` of ids, so that the
bucket that holds most rows is many files; ``read_buckets`` opens one length without reading the others.

Defined cases: null and empty texts give the end id alone (one piece of length 1); repeated rows
give repeated pieces under their own sequence ids; an empty table gives no piece.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchspark.llm.common import batch_slices, narrow, stored, texts_of

WINDOW = 2048
END_ID = 1
CACHED = 300_000  # words in each half of a worker's cache
PART_BYTES = 256 << 20
SCHEMA = "doc_id long, start long, length long, doc_tokens long, ids binary"


def piece_lengths(n: int, window: int = WINDOW) -> list[int]:
    """Lengths of the pieces of a document of n ids, in order."""
    whole, rest = divmod(n, window)
    return [window] * whole + [1 << b for b in range(window.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(docs: DataFrame, path: str, window: int = WINDOW, end_id: int | None = END_ID, id_col: str = "doc_id",
         text_col: str = "text", cached: int = CACHED) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, ids (little-endian unsigned 32-bit),
    sequence_id, offset (0)."""
    if window < 1 or window & (window - 1):
        raise ValueError("window must be a power of two")
    tail = b"" if end_id is None else int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from matchspark.llm.library import library_encoder
        enc = library_encoder(path, cached)
        for whole in batches:
            for batch in batch_slices(whole, 1):
                ids = [i + tail for i in enc.encode(texts_of(batch.column(1)))]
                pieces = [piece_lengths(len(i) // 4, window) for i in ids]
                counts = np.fromiter(map(len, pieces), np.int64, len(ids))
                lengths = np.fromiter((n for p in pieces for n in p), np.int64, int(counts.sum()))
                total = np.fromiter((len(i) // 4 for i in ids), np.int64, len(ids))
                ends = np.cumsum(lengths)
                first = np.repeat(np.cumsum(total) - total, counts)
                offsets = np.concatenate([[0], 4 * ends]).astype(np.int32)
                data = pa.Array.from_buffers(pa.binary(), len(lengths),
                                             [None, pa.py_buffer(offsets), pa.py_buffer(b"".join(ids))])
                which = pa.array(np.repeat(np.arange(len(ids)), counts))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(which), pa.array(ends - lengths - first), pa.array(lengths),
                     pa.array(np.repeat(total, counts)), data],
                    names=["doc_id", "start", "length", "doc_tokens", "ids"])

    return (narrow(docs, id_col, text_col).mapInArrow(run, SCHEMA)
            .withColumn("sequence_id", F.monotonically_increasing_id())
            .withColumn("offset", F.lit(0).cast("long")))


def write_buckets(pieces: DataFrame, folder: str, part_bytes: int = PART_BYTES) -> DataFrame:
    """Write the sequences of ``pack`` as ``folder``/length=<n>/part=<i> (Parquet); a table of length, sequences, parts.

    The sequences are stored once before, so that texts are encoded once and sequence ids stay the same for all
    parts; the parts of a length are chosen by a hash of the sequence id."""
    pieces = stored(pieces, "packed")
    counts = pieces.groupBy("length").count()  # a row per power of two
    buckets = counts.select("length", F.col("count").alias("sequences"), F.ceil(
        F.col("count") * F.col("length") * 4 / part_bytes).cast("int").alias("parts"))
    buckets = stored(buckets, "packed-buckets")
    part = F.pmod(F.xxhash64("sequence_id"), F.col("parts")).cast("int")
    rows = pieces.join(F.broadcast(buckets.select("length", "parts")), "length").withColumn("part", part).drop("parts")
    rows.repartition("length", "part").write.partitionBy("length", "part").parquet(folder)
    return buckets


def read_buckets(spark: SparkSession, folder: str, length: int | None = None) -> DataFrame:
    """The written sequences, all or those of one length (a filter on folders)."""
    schema = SCHEMA + ", sequence_id long, offset long, part int"
    rows = spark.read.schema(schema).parquet(folder)
    return rows if length is None else rows.where(F.col("length") == length)
