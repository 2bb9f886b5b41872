"""Publishing result edges as keyed-replace tables on plain Parquet.

Keyed replace = every row of a replaced key is dropped from the old table (left anti join on
the key) and the new rows are appended; duplicates (src, dst) inside a batch resolve to the
last one (``max_by`` over a batch sequence).

A published table is cut into buckets by a hash of its key. A version is one small file that names the folder of
every bucket; a replace reads and writes the buckets of the replaced keys alone and names the others again. Version n + 1 is
made in one step that fails if another writer has made it (compare and set): the loser takes the winner's version
as its base, merges the buckets that both wrote once more and tries again, so no update is lost. Data is complete before its version
exists: a table is never overwritten while it is read, and a failed job leaves the previous version.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dedupe_last(batch: DataFrame, keys: list[str], seq: str, values: list[str]) -> DataFrame:
    """One row per key: the values of the row with the highest ``seq`` (last write wins)."""
    return batch.groupBy(*keys).agg(
        *[F.max_by(F.col(v), F.col(seq)).alias(v) for v in values])


def keyed_replace(old: DataFrame, new: DataFrame, key: str,
                  processed_keys: DataFrame | None = None, keep_stale: bool = False) -> DataFrame:
    """Rows of ``old`` whose key is replaced are removed; ``new`` is appended.

    Replaced keys = keys processed in this run (``processed_keys``) or, with
    ``keep_stale=True`` or no processed set, only keys that produced at least one new row.
    """
    if keep_stale or processed_keys is None:
        replaced = new.select(key).distinct()
    else:
        replaced = processed_keys.select(key).distinct()
    kept = old.join(replaced, key, "left_anti")
    return kept.unionByName(new.select(*old.columns))


def partial_update(base: DataFrame, updates: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """UPDATE base SET columns = updates.columns WHERE key matches (NULL in updates keeps old)."""
    u = updates.select(key, *[F.col(c).alias(f"_new_{c}") for c in columns])
    j = base.join(u, key, "left")
    for c in columns:
        j = j.withColumn(c, F.coalesce(F.col(f"_new_{c}"), F.col(c))).drop(f"_new_{c}")
    return j.select(*base.columns)


def fill_null_update(base: DataFrame, incoming: DataFrame, key: str, column: str) -> DataFrame:
    """Set ``column`` only where it is NULL in ``base`` (COALESCE(old, new))."""
    inc = incoming.select(key, F.col(column).alias("_inc"))
    return (base.join(inc, key, "left")
            .withColumn(column, F.coalesce(F.col(column), F.col("_inc"))).drop("_inc"))


# ---------------------------------------------------------------- versions
# <base>/data/<id>          one folder per write (its buckets below it as bucket=<b>)
# <base>/versions/<n>       one text file (JSON) per version; the highest n is the table
#   {"ids": [...]}                                                 a whole table: the rows of these folders
#   {"key": k, "buckets": n, "schema": ..., "of": {bucket: id}}    a table in buckets
# An aborted write leaves a folder that no version names (``vacuum`` removes it).
class VersionConflict(RuntimeError):
    """Another writer has made this version."""


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Make a file with this content in one step; False if it exists. Local folders link a finished file (fails
    if the name is taken), other file systems rename one (HDFS refuses a taken name)."""
    fs, target = _fs(spark, path)
    if fs.getScheme() == "file":
        local = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path).toUri().getPath()
        os.makedirs(os.path.dirname(local), exist_ok=True)
        draft = os.path.join(os.path.dirname(local), f".{uuid.uuid4().hex}")
        with open(draft, "w", encoding="utf-8") as f:
            f.write(text)
        try:
            os.link(draft, local)
            return True
        except FileExistsError:
            return False
        finally:
            os.unlink(draft)
    draft = _fs(spark, os.path.join(os.path.dirname(path), f".{uuid.uuid4().hex}"))[1]
    out = fs.create(draft, False)
    out.write(bytearray(text.encode()))
    out.close()
    made = not fs.exists(target) and fs.rename(draft, target)
    if not made:
        fs.delete(draft, False)
    return bool(made)


def current_version(spark: SparkSession, base: str) -> tuple[int, dict] | None:
    """(number, content) of the highest version; None only if there is none. Storage errors are raised."""
    fs, folder = _fs(spark, os.path.join(base, "versions"))
    if not fs.exists(folder):
        return None
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    last = max((n for n in names if n.isdigit()), key=int, default=None)
    return None if last is None else (int(last), _version(spark, base, last))


def _version(spark: SparkSession, base: str, name: str) -> dict:
    fs, path = _fs(spark, os.path.join(base, "versions", name))
    stream = fs.open(path)
    try:
        text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return json.loads(text)


def commit_version(spark: SparkSession, base: str, content: dict, after: int) -> int:
    """Make ``content`` the version behind ``after``, or raise ``VersionConflict``."""
    if not _put_if_absent(spark, os.path.join(base, "versions", f"{after + 1:08d}"), json.dumps(content)):
        raise VersionConflict(f"version {after + 1} of {base} exists")
    return after + 1


def current_snapshot(spark: SparkSession, base: str) -> tuple[int, str] | None:
    """(version, folder id) of a whole table that was written at once."""
    now = current_version(spark, base)
    return None if now is None else (now[0], now[1]["ids"][-1])


def snapshot_path(base: str, snapshot: tuple[int, str]) -> str:
    return os.path.join(base, "data", snapshot[1])


def commit_snapshot(spark: SparkSession, base: str, snapshot_id: str, after: tuple[int, str] | None) -> tuple[int, str]:
    """Make a completely written folder the next version of the whole table."""
    return commit_version(spark, base, {"ids": [snapshot_id]}, after[0] if after else 0), snapshot_id


def read_current(spark: SparkSession, base: str, schema: str | None = None) -> DataFrame | None:
    now = current_version(spark, base)
    if now is None:
        return spark.createDataFrame([], schema) if schema else None
    return read_version(spark, base, now[1])


def read_version(spark: SparkSession, base: str, content: dict, buckets: set[int] | None = None) -> DataFrame:
    """The rows of a version, of some buckets only if given."""
    if "of" not in content:
        return spark.read.parquet(*[os.path.join(base, "data", i) for i in content["ids"]])
    kind = T.StructType.fromJson(json.loads(content["schema"]))
    paths = [os.path.join(base, "data", i, f"bucket={b}") for b, i in content["of"].items() if buckets is None or int(b) in buckets]
    return spark.read.schema(kind).parquet(*paths) if paths else spark.createDataFrame([], kind)


def bucket_of(key: str | Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def read_key(spark: SparkSession, base: str, value) -> DataFrame:
    """The rows of one key: one bucket is read, with a filter that reaches its scan."""
    _, content = current_version(spark, base)
    key = content["key"]
    kind = T.StructType.fromJson(json.loads(content["schema"]))[key].dataType
    one = F.lit(value).cast(kind)
    bucket = spark.range(1).select(bucket_of(one, content["buckets"])).first()[0]
    return read_version(spark, base, content, {bucket}).where(F.col(key) == one)


# ---------------------------------------------------------------- whole tables
def write_snapshot(df: DataFrame, base: str, partition_by: list[str] | None = None,
                   sort_by: str | None = None) -> tuple[int, str]:
    """Write ``df`` as the whole table. ``sort_by``: files are ranges of this column, so
    row-group statistics let a read of one key skip the rest. Raises ``VersionConflict`` if the table changed meanwhile."""
    spark = df.sparkSession
    before, snapshot_id = current_version(spark, base), uuid.uuid4().hex
    if sort_by:
        df = df.repartitionByRange(sort_by).sortWithinPartitions(sort_by)
    w = df.write.mode("errorifexists")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(os.path.join(base, "data", snapshot_id))
    return commit_snapshot(spark, base, snapshot_id, before)


def append_rows(df: DataFrame, base: str) -> int:
    """Add rows to a whole table: one more folder; overlapping writers all keep theirs."""
    spark, own = df.sparkSession, uuid.uuid4().hex
    df.write.parquet(os.path.join(base, "data", own))
    while True:
        n, content = current_version(spark, base) or (0, {"ids": []})
        try:
            return commit_version(spark, base, {"ids": [*content["ids"], own]}, n)
        except VersionConflict:
            continue


# ---------------------------------------------------------------- tables in buckets
#: rows a bucket holds when a table is first written, and bounds of the number of buckets
BUCKET_ROWS, FEWEST_BUCKETS, MOST_BUCKETS = 250_000, 4, 4096
#: a table with a bucket of more bytes is cut into four times as many by the next replace that writes it
MOST_BUCKET_BYTES = 512 << 20
MOST_TRIES = 20


@dataclass
class Replace:
    """A keyed replace whose buckets are written but not yet in a version."""

    base: str
    key: str
    staged: str                       # the new rows and the replaced keys, evaluated once
    after: tuple[int, dict] | None    # the version it started from
    content: dict                     # the version it would make
    touched: set[int] = field(default_factory=set)


def prepare_replace(spark: SparkSession, base: str, new: DataFrame, key: str, processed_keys: DataFrame | None = None,
                    keep_stale: bool = False, buckets: int | None = None) -> Replace:
    """Evaluate the new rows once (a table under ``staged``) and write the buckets that they change."""
    staged = os.path.join(base, "staged", uuid.uuid4().hex)
    new.write.parquet(os.path.join(staged, "rows"))
    own = processed_keys.select(key) if processed_keys is not None and not keep_stale else _staged(spark, staged, "rows").select(key)
    own.distinct().write.parquet(os.path.join(staged, "keys"))
    return _write_buckets(spark, Replace(base, key, staged, None, {}), buckets)


def _staged(spark: SparkSession, staged: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(staged, name))


def _write_buckets(spark: SparkSession, r: Replace, buckets: int | None = None) -> Replace:
    r.after = current_version(spark, r.base)
    new, keys = _staged(spark, r.staged, "rows"), _staged(spark, r.staged, "keys")
    content = r.after[1] if r.after else None
    if content is None or "of" not in content:
        old = None if content is None else read_version(spark, r.base, content)
        n = buckets or min(MOST_BUCKETS, max(FEWEST_BUCKETS, 1 << (new.count() // BUCKET_ROWS).bit_length()))
        base = {"key": r.key, "buckets": n, "schema": (new if old is None else old).schema.json(), "of": {}}
        r.touched = set(range(n))
    else:
        base, n = dict(content), content["buckets"]
        found = keys.select(bucket_of(r.key, n).alias("b")).unionByName(new.select(bucket_of(r.key, n).alias("b"))).distinct().collect()
        r.touched = {x["b"] for x in found}                     # no more than there are buckets
        if n < MOST_BUCKETS and any(_bytes(spark, r.base, content, b) > MOST_BUCKET_BYTES for b in r.touched):
            n = min(MOST_BUCKETS, 4 * n)
            base, r.touched = base | {"buckets": n, "of": {}}, set(range(n))
            old = read_version(spark, r.base, content)
        else:
            old = read_version(spark, r.base, content, r.touched)
    columns = [f["name"] for f in json.loads(base["schema"])["fields"]]
    rows = new.select(*columns) if old is None else old.join(keys, r.key, "left_anti").select(*columns).unionByName(new.select(*columns))
    own, of = uuid.uuid4().hex, {b: i for b, i in base["of"].items() if int(b) not in r.touched}
    folder = os.path.join(r.base, "data", own)
    if r.touched:
        (rows.withColumn("bucket", bucket_of(r.key, n)).repartition("bucket").sortWithinPartitions("bucket", r.key)
         .write.partitionBy("bucket").parquet(folder))
        fs, path = _fs(spark, folder)
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        of |= {x.removeprefix("bucket="): own for x in names if x.startswith("bucket=")}
    r.content = base | {"of": of}
    return r


def _bytes(spark: SparkSession, base: str, content: dict, bucket: int) -> int:
    own = content["of"].get(str(bucket))
    if own is None:
        return 0
    fs, path = _fs(spark, os.path.join(base, "data", own, f"bucket={bucket}"))
    return fs.getContentSummary(path).getLength()


def commit_replace(spark: SparkSession, r: Replace) -> tuple[int, int]:
    """(version, buckets written). If other writers were first, their version is the new base; only
    if they wrote a bucket that this replace writes too are the buckets merged again."""
    for _ in range(MOST_TRIES):
        try:
            version = commit_version(spark, r.base, r.content, r.after[0] if r.after else 0)
            break
        except VersionConflict:
            now = current_version(spark, r.base)
            before = (r.after[1] if r.after else {}).get("of", {})
            theirs = now[1].get("of", {})
            same_cut = bool(r.after) and "of" in r.after[1] and now[1].get("buckets") == r.content["buckets"]
            changed = {int(b) for b in {*before, *theirs} if before.get(b) != theirs.get(b)}
            if same_cut and not changed & r.touched:
                mine = {b: i for b, i in r.content["of"].items() if int(b) in r.touched}
                r.after, r.content = now, now[1] | {"of": {b: i for b, i in theirs.items() if int(b) not in r.touched} | mine}
            else:
                r = _write_buckets(spark, r)
    else:
        raise VersionConflict(f"{r.base}: {MOST_TRIES} versions by other writers came first")
    remove_folder(spark, r.staged)
    return version, len(r.touched)


def remove_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder of intermediate tables that this run made."""
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def publish_edges(spark: SparkSession, base: str, new: DataFrame, key: str, processed_keys: DataFrame | None = None,
                  keep_stale: bool = False, buckets: int | None = None) -> tuple[int, int]:
    """Keyed replace of ``new`` into the table at ``base`` (first run: plain write); (version, buckets written). A failed read of the old
    table stops the run; it never counts as an empty one."""
    return commit_replace(spark, prepare_replace(spark, base, new, key, processed_keys, keep_stale, buckets))


def vacuum(spark: SparkSession, base: str, keep_versions: int = 2, older_than_s: float = 7 * 86400) -> list[str]:
    """Remove the folders that none of the last ``keep_versions`` versions names and that are older than ``older_than_s`` (a
    running writer's folder is younger); returns their ids."""
    fs, folder = _fs(spark, os.path.join(base, "versions"))
    if not fs.exists(folder):
        return []
    names = sorted((s.getPath().getName() for s in fs.listStatus(folder)), key=lambda n: int(n) if n.isdigit() else -1)
    numbers = [n for n in names if n.isdigit()]
    kept: set[str] = set()
    for n in numbers[-keep_versions:]:
        content = _version(spark, base, n)
        kept |= set(content["of"].values()) if "of" in content else set(content["ids"])
    gone, limit = [], (time.time() - older_than_s) * 1000
    for part in ("data", "staged"):
        _, path = _fs(spark, os.path.join(base, part))
        for s in fs.listStatus(path) if fs.exists(path) else ():
            name = s.getPath().getName()
            if name not in kept and s.getModificationTime() <= limit:
                fs.delete(s.getPath(), True)
                gone.append(name)
    for n in numbers[:-keep_versions]:
        fs.delete(_fs(spark, os.path.join(base, "versions", n))[1], False)
    return sorted(gone)
