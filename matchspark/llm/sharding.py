"""Operator 5: sharding by extendible hashing, with DataFrame operations only.

A document's key bits are the 128 bits of md5(id), followed by bits of its row number, so that even
copies of one id can be told apart. The directory starts with one bucket, split as often as the total size asks for; only a bucket whose
bytes exceed the limit is split on its next bit, until every bucket fits. Bits are taken in rounds
of ``STRIDE``: one aggregate per round gives the bytes of the deepest prefixes, a roll-up over their
ancestors gives for each the shallowest bucket that fits (sizes only shrink with depth), and only
the rows of buckets that still do not fit go into the next round. Rounds: about log2(total/limit)/STRIDE + 1.

To assign shards only (row number, id, key bits, bytes) is shuffled, never a text; directory entries stay a table. The hot bucket of a
repeated id is split by the row bits like any other. A single document larger than the limit cannot be
split: it gets a shard of its own (``shard`` ends in ``!`` and its digest), and does not count
against the others.

Defined cases: null ids are keyed as the string ``null`` and told apart by their rows; null texts have
0 bytes; an empty table has no shards; identical rows may go to different shards, none is lost.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchspark.llm.common import stored

LIMIT = 256 << 20         # bytes of a shard
QUERY_LIMIT = 1 << 20     # the same for the registered query, whose tables are small
STRIDE = 8                # bits of a round
FIRST_SPARE = 3           # bits beyond log2(total / limit) in the first round


def hex_bits(digest: Column) -> Column:
    """128 bits of an md5 digest as a string of 0 and 1."""
    words = [F.lpad(F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 2), 32, "0") for i in range(4)]
    return F.concat(*words)


def key_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row: Column | None = None) -> DataFrame:
    """doc_id, key (md5 of the id), row (number of the row among all, taken here if not given), bytes: a narrow stored
    table, so that row numbers stay what they are when a task runs again."""
    return stored(docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).cast("binary")).alias("key"),
        (F.monotonically_increasing_id() if row is None else row).alias("row"),
        F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("bytes")), "shard-keys")


def assign_shards(docs: DataFrame, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, bytes, shard (bits of its bucket), shard_bytes: every bucket holds at most ``limit`` bytes."""
    return _assigned(key_table(docs, id_col, text_col), limit).drop("row")


def _assigned(keys: DataFrame, limit: int) -> DataFrame:
    """The same with the row number, one row for each of ``keys``."""
    fits = F.col("bytes") <= limit
    alone = keys.where(~fits).select(
        "row", "doc_id", "bytes", F.concat(F.lit("!"), F.md5(F.concat_ws(":", "key", "row").cast("binary"))).alias("shard"),
        F.col("bytes").alias("shard_bytes"))
    total = keys.where(fits).agg(F.sum("bytes")).first()[0] or 0
    rest = keys.where(fits).select("row", "doc_id", "bytes", F.concat(
        hex_bits(F.col("key")), hex_bits(F.md5(F.col("row").cast("string").cast("binary")))).alias("bits"))
    parts = [alone]
    low, high = 0, max(0, math.ceil(math.log2(max(1, total / limit)))) + FIRST_SPARE
    while True:
        cells = rest.groupBy(F.substring("bits", 1, high).alias("cell")).agg(F.sum("bytes").alias("cell_bytes"))
        # each cell with all its ancestors of this round; a bucket's bytes are the sum of its cells
        up = cells.select("cell", "cell_bytes", F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth")).select(
            "cell", "cell_bytes", F.expr("substring(cell, 1, depth)").alias("bucket"))
        sums = up.groupBy("bucket").agg(F.sum("cell_bytes").alias("shard_bytes"))
        fitting = sums.where(F.col("shard_bytes") <= limit)
        directory = (up.select("cell", "bucket").join(fitting, "bucket")
                     .groupBy("cell").agg(F.min(F.struct(F.length("bucket").alias("depth"), "shard_bytes")).alias("leaf")))
        directory = stored(directory.select("cell", "leaf.depth", "leaf.shard_bytes"), "shard-directory")
        keyed = rest.withColumn("cell", F.substring("bits", 1, high))
        parts.append(keyed.join(directory, "cell").select(
            "row", "doc_id", "bytes", F.expr("substring(cell, 1, depth)").alias("shard"), "shard_bytes"))
        left = cells.join(directory, "cell", "left_anti")
        if high >= 256 or left.isEmpty():
            break
        rest = stored(keyed.join(left, "cell", "left_semi").drop("cell"), "shard-oversized")
        low, high = high + 1, min(256, high + STRIDE)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def write_shards(docs: DataFrame, folder: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write every row once, as one folder per shard named ``s_`` and the shard, so that no name reads as a number or null.

    The documents are stored once with their row numbers, and a row finds its shard by that number: ids may repeat or be null."""
    rows = stored(docs.select(F.monotonically_increasing_id().alias("row"), F.struct("*").alias("doc")), "shard-documents")
    shards = _assigned(key_table(rows, f"doc.{id_col}", f"doc.{text_col}", F.col("row")), limit)
    named = rows.join(shards.select("row", F.concat(F.lit("s_"), "shard").alias("__shard")), "row").select("doc.*", "__shard")
    named.repartition("__shard").write.partitionBy("__shard").parquet(folder)
