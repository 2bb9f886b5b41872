"""Helpers shared by the training-data operators.

Conventions of every operator in this subpackage:

* a null text counts as the empty text, a null id is an ordinary id value (one group);
* the caller names the id and text columns; all other columns are left alone or, where a
  narrow result is returned, not read at all (column pruning reaches the scan), so extra
  columns with any name are harmless;
* intermediate tables go to the folder of ``spark.checkpoint.dir`` (``shared_folder``), never to
  a machine-local one, and are read again from there after the loss of an executor.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchspark.session import ensure_checkpoint_dir, table_path

#: ids of dropped documents are broadcast up to this many rows (8 bytes each), else shuffled
BROADCAST_IDS = 1_000_000
#: workers keep what they know of words up to this length only, so that the number of entries bounds a cache in bytes
CACHED_WORD = 64


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name on the storage that the driver and all executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table on shared storage and read it back: cuts the lineage at a
    table that survives the loss of executors."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def collected(df: DataFrame):
    """A bounded table as a pandas frame on the driver, through Arrow whatever the session's settings."""
    return df.toArrow().to_pandas()


def narrow(df: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """``doc_id`` (long), ``text`` (null as empty) and the columns ``more``, nothing else."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"),
                     F.coalesce(F.col(text_col), F.lit("")).alias("text"), *[F.col(c) for c in more])


def texts_of(column: pa.Array) -> list[str]:
    """Texts of a string column, null as empty."""
    return [t or "" for t in column.to_pylist()]


def _cuts(column: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = done = 0
    while start < len(ends):
        stop = max(start + 1, int(np.searchsorted(ends, done + most, "right")))
        yield start, stop - start
        start, done = stop, int(ends[stop - 1])


def batch_slices(batch: pa.RecordBatch, text_column: int, most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about ``most`` bytes of text together (one row at least): what is held as Python objects at
    a time is bounded by this, whatever the size of Spark's batches."""
    return (batch.slice(start, n) for start, n in _cuts(batch.column(text_column), most))


def text_bytes(column: pa.Array, most: int = 4 << 20) -> Iterator[bytes]:
    """``bytes_of`` as a stream: about ``most`` bytes are held as Python objects at a time."""
    return (t for start, n in _cuts(column, most) for t in bytes_of(column.slice(start, n)))


def bytes_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column, null as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [t or b"" for t in column.cast(kind).to_pylist()]


def lists_of_int32(parts: list[bytes]) -> pa.ListArray:
    """One list<int32> per little-endian byte string, built on one buffer."""
    sizes = np.fromiter((len(p) // 4 for p in parts), np.int64, len(parts))
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(parts), "<i4")))


def int32_lists(column: pa.Array | pa.ChunkedArray) -> Iterator[memoryview]:
    """The values of each list<int32> as a memory view of little-endian bytes (null as empty)."""
    chunks = column.chunks if isinstance(column, pa.ChunkedArray) else [column]
    for chunk in chunks:
        offsets = chunk.offsets.to_numpy()
        values = memoryview(np.ascontiguousarray(chunk.values.to_numpy(zero_copy_only=False), "<i4")).cast("B")
        valid = chunk.is_valid().to_numpy(zero_copy_only=False)
        for i in range(len(chunk)):
            yield values[4 * offsets[i]:4 * offsets[i + 1]] if valid[i] else values[:0]


def without_ids(docs: DataFrame, dropped: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` whose id is not among ``dropped`` (one column ``__drop``, null-safe).

    The ids are broadcast only if counted and at most ``BROADCAST_IDS``; beyond that both sides
    are shuffled. The rows keep all their columns either way."""
    few = dropped.count() <= BROADCAST_IDS
    side = F.broadcast(dropped) if few else dropped
    return docs.join(side, docs[id_col].eqNullSafe(dropped["__drop"]), "left_anti")
