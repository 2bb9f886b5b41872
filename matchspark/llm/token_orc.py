"""Operator 2: token ids as ORC files, in ascending order of the document id.

One row per document: ``part``, ``doc_id``, ``start`` (ids of the documents before it in its part),
``n_tokens`` and ``ids`` (array of int, which ORC stores with its integer run-length encoding). Parts
are ranges of the document id, sorted inside, so the min/max of stripes and row groups and the Bloom
filters on ``doc_id`` let a reader skip all but the wanted stripes, and stripes are read in
parallel. A ``parts`` table beside the files (one row per part: ids, first and last document) gives the
ids before each part.

Defined cases: a null text counts as empty and gives the end id alone; null ids come first, as in Spark's
ascending order; rows with the same id stand next to each other, ordered by text inside a part; an id that holds the rows of
several parts spans several (ids beyond 2^53 that are equal as floating-point numbers stay in one); an empty table
gives files without rows; a text of any length is encoded as a whole; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchspark.llm.common import batch_slices, int32_lists, lists_of_int32, narrow, stored, texts_of

END_ID = 2
NULL_ID = -1e300  # stands for a null id where ids are compared as numbers
CACHED = 500_000  # words in each half of a worker's cache
STRIPE_BYTES = 64 << 20
ROW_INDEX_STRIDE = 10_000
SCHEMA = "part int, doc_id long, start long, n_tokens long, ids array<int>"


def encode_rows(docs: DataFrame, path: str, end_id: int | None = END_ID, id_col: str = "doc_id",
                text_col: str = "text", parts: int | None = None) -> DataFrame:
    """Ids of whole texts by the tokenizers library with ``end_id`` behind each, range-partitioned and
    sorted by id; ``start`` counts inside the partition."""
    from pyspark import TaskContext

    tail = b"" if end_id is None else int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from matchspark.llm.library import library_encoder
        enc, part, before = library_encoder(path, CACHED), TaskContext.get().partitionId(), 0
        for whole in batches:
            for batch in batch_slices(whole, 1):
                ids = [i + tail for i in enc.encode(texts_of(batch.column(1)))]
                n = np.fromiter((len(i) // 4 for i in ids), np.int64, len(ids))
                ends = before + np.cumsum(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(ids), part, np.int32)), batch.column(0), pa.array(ends - n), pa.array(n),
                     lists_of_int32(ids)], names=["part", "doc_id", "start", "n_tokens", "ids"])
                before += int(n.sum())

    n = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = by_id_range(narrow(docs, id_col, text_col), n)
    return rows.sortWithinPartitions("doc_id", "text").mapInArrow(run, SCHEMA)


def by_id_range(rows: DataFrame, n: int) -> DataFrame:
    """``rows`` in about n ranges of doc_id, null first. The cuts come from a scan of the ids alone, where Spark's own range
    partitioning would read the texts once more to sample them.

    An id that is a cut m > 1 times holds more than m - 1 ranges' worth of rows: it gets m ranges of its own, its rows dealt
    over them by row number."""
    keyed = rows.withColumn("__id", F.coalesce(F.col("doc_id").cast("double"), F.lit(NULL_ID)))
    cuts = Counter(keyed.approxQuantile("__id", [i / n for i in range(1, n)], 0.1 / n))  # n numbers at most
    if not cuts:
        return rows.repartitionById(n, F.lit(0))
    ranges = Bucketizer(splits=[-float("inf"), *sorted(cuts), float("inf")], inputCol="__id", outputCol="__range", handleInvalid="keep")
    hot = _single_ids(keyed, [c for c, m in cuts.items() if m > 1])
    if not hot:
        return ranges.transform(keyed).repartitionById(n, F.col("__range").cast("int")).select(*rows.columns)
    # the hot ids' rows are stored with their numbers, so that a task that runs again deals them alike
    is_hot = F.col("__id").isin(hot)
    dealt = stored(keyed.where(is_hot).withColumn("__row", F.monotonically_increasing_id()), "token-orc-hot-ids")
    spread = ranges.transform(keyed.where(~is_hot).withColumn("__row", F.lit(None).cast("long")).unionByName(dealt))
    before, own, base = [], [], 0  # of each range: the part its first id's own ranges begin at, their number
    for c in [None, *sorted(cuts)]:
        own.append(cuts[c] if c in hot else 0)
        before.append(base)
        base += own[-1] + 1
    at = F.col("__range").cast("int")
    own_ranges = F.get(F.lit(own), at)
    part = F.get(F.lit(before), at) + F.coalesce(F.pmod(F.col("__row"), own_ranges).cast("int"), own_ranges)
    return spread.repartitionById(base, part).select(*rows.columns)


def _single_ids(keyed: DataFrame, values: list[float]) -> list[float]:
    """Those of ``values`` (at most as many as there are ranges) that stand for one id only: beyond 2^53 neighbours share a number."""
    if not values:
        return []
    ids = keyed.where(F.col("__id").isin(values)).groupBy("__id").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"))
    return [r["__id"] for r in ids.where(F.col("a").eqNullSafe(F.col("b"))).collect()]


def write_token_orc(docs: DataFrame, folder: str, path: str, **options) -> None:
    """Write ``folder``/ids (ORC) and ``folder``/parts (Parquet, one row per part)."""
    spark = docs.sparkSession
    (encode_rows(docs, path, **options).write
     .option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01")
     .option("orc.create.index", "true").option("orc.row.index.stride", str(ROW_INDEX_STRIDE))
     .option("orc.stripe.size", str(STRIPE_BYTES)).option("compression", "lz4")
     .orc(f"{folder}/ids"))
    (spark.read.schema(SCHEMA).orc(f"{folder}/ids").groupBy("part")
     .agg(F.sum("n_tokens").alias("n_tokens"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))
     .coalesce(1).write.parquet(f"{folder}/parts"))


def read_token_orc(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids; a filter on doc_id reaches the
    row indexes and Bloom filters."""
    parts = spark.read.schema("part int, n_tokens long, first_id long, last_id long").parquet(f"{folder}/parts")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.select("part", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"))
    rows = spark.read.schema(SCHEMA).orc(f"{folder}/ids")
    # one row per written part: as many as the range partitioning had
    return rows.join(F.broadcast(base), "part").select(
        "doc_id", (F.col("base") + F.col("start")).alias("start"), "n_tokens", "ids")


def ids_crc32(rows: DataFrame) -> DataFrame:
    """Replace ``ids`` by ``ids_crc32``: crc32 over the ids as little-endian unsigned 32-bit integers."""
    keep = [c for c in rows.columns if c != "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crc = [zlib.crc32(v) for v in int32_lists(batch.column(len(keep)))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:len(keep)], pa.array(crc, pa.int64())],
                                             names=[*keep, "ids_crc32"])

    kinds = dict(rows.dtypes)
    return rows.select(*keep, "ids").mapInArrow(
        run, ", ".join([f"`{c}` {kinds[c]}" for c in keep] + ["ids_crc32 long"]))
