"""Operator 8: exact deduplication by stateful streaming.

Two texts are equal if they are identical after deleting every character of ``[\\x20\\x09-\\x0D]``. A
narrow table of (id, run, row number, code points, SHA-256 of the normalised text, file, row of the file) is written
once and read as a stream. The stream's state, kept on disk by RocksDB and never expired, has one entry per
digest: the best row so far (most code points, then smallest id, then first run and row: the stable
identifier), its locator (a Parquet file and the row in it, which ``texts_at`` reads back) and the number of rows. Each
micro-batch is summed up per digest before the shuffle, so a text that a third of all rows share costs one entry per
task.

**Runs.** With a ``state`` folder, the digests of each run and the state stay there: a later run over new documents meets the
digests of all earlier ones, and a run that failed goes on if it is called again with its number (what it has written is not
written or counted twice). A run returns its own rows; a new row may take the place of an earlier run's, which
``state_groups`` then shows. Without a folder the state serves one run.

**Full bytes.** A digest seen more than once is a hit; the normalised texts of all hits are compared byte by byte
(grouping by digest and text, partial first), and with one text of the earlier runs, fetched by its locator. Texts that differ
under one digest form groups of their own, over all runs.

Defined cases: null text counts as empty, and empty texts are equal; a null id comes behind every
other id; repeated rows are copies (one stays); an empty table gives an empty result; a text of any
length is digested as a whole; other columns are not read. Documents that are not a Parquet scan have no locator; with a
``state`` folder their ids and texts are first written to it, so that later runs can fetch them.
"""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchspark.llm.common import BROADCAST_IDS, shared_folder, stored, without_ids

BLANKS = " \t\n\x0b\x0c\r"
FILES_PER_BATCH = 1000
#: state on disk, and no store kept open after its task: a store reserves some MB of local disk while it is open
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
}
DIGESTS = "doc_id long, run long, row long, code_points int, digest string, file string, file_row long"
BROADCAST_DIGESTS = 100_000  # digests are broadcast up to this many (64 bytes each), else shuffled


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), BLANKS, "")


def sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _located(docs: DataFrame) -> bool:
    """Whether the rows of ``docs`` have a place in a Parquet file."""
    try:
        docs.select("_metadata.file_path", "_metadata.row_index")
    except AnalysisException:
        return False
    return True


def _rows(docs: DataFrame, id_col: str, text_col: str, digest, run: int | None, *more: Column) -> DataFrame:
    here = _located(docs)
    return docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.lit(run or 0).cast("long").alias("run"),
        F.monotonically_increasing_id().alias("row"), F.length(F.coalesce(F.col(text_col), F.lit(""))).alias("code_points"),
        digest(normalised(F.col(text_col))).alias("digest"),
        (F.col("_metadata.file_path") if here else F.lit("")).alias("file"),
        (F.col("_metadata.row_index") if here else F.lit(None)).cast("long").alias("file_row"), *more)


def write_digests(docs: DataFrame, folder: str, id_col: str, text_col: str, digest=sha256, run: int | None = None) -> DataFrame:
    """Append the digests of ``docs`` to ``folder``; with a ``run`` they get a folder of their own in it, which is not written
    again once it is complete."""
    spark, rows = docs.sparkSession, _rows(docs, id_col, text_col, digest, run)
    path = folder if run is None else f"{folder}/run-{run}"
    if run is None:
        rows.write.mode("append").parquet(path)
    elif run not in _runs(spark, folder):
        rows.write.mode("overwrite").parquet(path)
    return spark.read.schema(DIGESTS).parquet(path)


def _runs(spark: SparkSession, folder: str) -> set[int]:
    """Runs that have written their table in ``folder`` to its end."""
    done = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder, "run-*/_SUCCESS")
    found = done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(done)
    return {int(f.getPath().getParent().getName()[4:]) for f in found or []}


def update_state(digests: DataFrame, folder: str, checkpoint: str, files_per_batch: int = FILES_PER_BATCH) -> DataFrame:
    """Run the stream over the files in ``folder`` that ``checkpoint`` has not seen; the whole state:
    digest, keep (code points, ~id, ~run, ~row, locator), group_size."""
    spark = digests.sparkSession
    stream = (spark.readStream.schema(digests.schema).option("maxFilesPerTrigger", files_per_batch)
              .option("recursiveFileLookup", "true").parquet(folder))
    state = stream.groupBy("digest").agg(F.max(_best()).alias("keep"), F.count("*").alias("group_size"))
    before = {k: spark.conf.get(k) for k in STATE_CONF}
    for k, v in STATE_CONF.items():
        spark.conf.set(k, v)
    try:
        run = (state.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
               .format("noop").trigger(availableNow=True).start())
        run.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    return _entries(spark, checkpoint)


def _best() -> Column:
    """The largest of these is the row that stays: ~x turns an order around (smallest id first, null last)."""
    return F.struct(F.col("code_points"), F.bitwise_not("doc_id").alias("not_id"), F.bitwise_not("run").alias("not_run"),
                    F.bitwise_not("row").alias("not_row"), F.col("file"), F.col("file_row"))


def _entries(spark: SparkSession, checkpoint: str) -> DataFrame:
    entries = spark.read.format("statestore").load(checkpoint)
    return entries.select(F.col("key")[entries.schema["key"].dataType.names[0]].alias("digest"),
                          F.col("value.max").alias("keep"), F.col("value.count").alias("group_size"))


def _pick(best: Column) -> list[Column]:
    return [F.bitwise_not(best["not_id"]).alias("keep_id"), F.bitwise_not(best["not_run"]).alias("keep_run"),
            F.bitwise_not(best["not_row"]).alias("keep_row"), best["file"].alias("keep_file"),
            best["file_row"].alias("keep_file_row")]


def state_groups(spark: SparkSession, state: str) -> DataFrame:
    """digest, group_size, keep_id, keep_run, keep_row, keep_file, keep_file_row over all runs of a ``state`` folder."""
    return _entries(spark, f"{state}/stream").select("digest", "group_size", *_pick(F.col("keep")))


def texts_at(spark: SparkSession, places: DataFrame, text_col: str = "text") -> DataFrame:
    """``places`` (file, file_row and more columns) with ``text``, read back from the files that they name. The
    names of those files pass through the driver, as for any scan; a file that is gone is an error."""
    files = [r["file"] for r in places.select("file").distinct().collect()]
    if not files:
        return places.withColumn("text", F.lit(""))
    there = spark.read.parquet(*map(unquote, files)).select(F.col("_metadata.file_path").alias("file"),
                                              F.col("_metadata.row_index").alias("file_row"), F.col(text_col).alias("text"))
    few = places.count() <= BROADCAST_DIGESTS
    return there.join(F.broadcast(places) if few else places, ["file", "file_row"])


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=sha256,
                     files_per_batch: int = FILES_PER_BATCH, state: str | None = None, run: int = 0) -> DataFrame:
    """doc_id, keep_id, group_size, kept, digest, keep_file, keep_file_row, keep_run, keep_row: one row per row of ``docs``.

    ``state``: folder on shared storage that outlives the run; ``run``: this run's number in it, above all earlier ones. The
    text column has the same name in all runs, and a run that failed is called again before the next."""
    spark = docs.sparkSession
    folder = state or shared_folder(spark, "dedup")
    if state is None:
        run, before = None, set()
    else:
        before = _runs(spark, f"{state}/digests") - {run}
        if max(before, default=-1) > run:
            raise ValueError(f"run {run} is not above the runs {sorted(before)} in {state}")
        if before - _runs(spark, f"{state}/clashes"):
            raise RuntimeError(f"earlier runs have not finished: {sorted(before - _runs(spark, f'{state}/clashes'))}")
        if not _located(docs):
            if run not in _runs(spark, f"{state}/content"):
                docs.select(id_col, text_col).write.mode("overwrite").parquet(f"{state}/content/run-{run}")
            docs = spark.read.parquet(f"{state}/content/run-{run}")
    digests = write_digests(docs, f"{folder}/digests", id_col, text_col, digest, run)
    if digests.isEmpty():
        if state is not None:
            digests.select("digest").write.mode("overwrite").parquet(f"{state}/clashes/run-{run}")
        return digests.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(0).cast("long").alias("group_size"),
                              F.lit(True).alias("kept"), "digest", F.col("file").alias("keep_file"),
                              F.col("file_row").alias("keep_file_row"), F.col("run").alias("keep_run"), F.col("row").alias("keep_row"))
    earlier = _earlier(digests, folder, run) if before else None  # read before this run touches the state
    groups = update_state(digests, f"{folder}/digests", f"{folder}/stream", files_per_batch)
    if earlier is not None:  # the state holds all runs; this one needs its own digests
        groups = groups.join(digests.select("digest").distinct(), "digest", "left_semi")
    groups = stored(groups.select("digest", "group_size", *_pick(F.col("keep"))), "dedup-groups")
    hits = groups.where("group_size > 1").select("digest")
    hits = F.broadcast(hits) if hits.count() <= BROADCAST_DIGESTS else hits
    # full bytes of all hits: one row per different text and task goes through the shuffle
    texts = docs.select(normalised(F.col(text_col)).alias("text")).withColumn("digest", digest(F.col("text")))
    texts = texts.join(hits, "digest", "left_semi")
    if earlier is not None:
        texts = texts.unionByName(texts_at(spark, earlier, text_col).select(normalised(F.col("text")).alias("text"), "digest"))
    clashes = (texts.groupBy("digest", "text").agg(F.lit(1).alias("one"))
               .groupBy("digest").count().where("count > 1").select("digest"))
    if before:  # digests that clashed in an earlier run clash for good
        clashes = clashes.unionAll(spark.read.schema("digest string").parquet(*[f"{state}/clashes/run-{n}" for n in before])).distinct()
    clashes = stored(clashes, "dedup-clashes")
    if state is not None:
        clashes.write.mode("overwrite").parquet(f"{state}/clashes/run-{run}")
    columns = ["doc_id", "keep_id", "group_size",
               F.coalesce((F.col("row") == F.col("keep_row")) & (F.col("run") == F.col("keep_run")), F.lit(False)).alias("kept"),
               "digest", "keep_file", "keep_file_row", "keep_run", "keep_row"]
    if clashes.isEmpty():
        return digests.join(groups, "digest").select(*columns)
    clashes = F.broadcast(clashes) if clashes.count() <= BROADCAST_DIGESTS else clashes
    if earlier is None:
        rows = _rows(docs, id_col, text_col, digest, run, normalised(F.col(text_col)).alias("norm"))
        rows = rows.join(clashes, "digest", "left_semi")
    else:  # all runs' rows of these digests
        every = spark.read.schema(DIGESTS).option("recursiveFileLookup", "true").parquet(f"{folder}/digests")
        every = stored(every.join(clashes, "digest", "left_semi"), "dedup-clash-places")
        rows = texts_at(spark, every, text_col).withColumn("norm", normalised(F.col("text"))).drop("text")
    by_text = _by_text(stored(rows, "dedup-clash-rows")).where(F.col("run") == (run or 0))
    return digests.join(clashes, "digest", "left_anti").join(groups, "digest").select(*columns).unionByName(
        by_text.select(*columns))


def _earlier(digests: DataFrame, folder: str, run: int) -> DataFrame:
    """digest, file, file_row: the earlier runs' best row of each digest that this run has too. It is stored before the run
    touches the state, for a run that is called again."""
    spark, schema = digests.sparkSession, "digest string, file string, file_row long"
    if run not in _runs(spark, f"{folder}/earlier"):
        if _has_state(spark, f"{folder}/stream"):
            keep = _entries(spark, f"{folder}/stream").join(digests.select("digest").distinct(), "digest", "left_semi")
            keep = keep.select("digest", "keep.file", "keep.file_row")
        else:  # all earlier runs were empty
            keep = spark.createDataFrame([], schema)
        keep.write.mode("overwrite").parquet(f"{folder}/earlier/run-{run}")
    return spark.read.schema(schema).parquet(f"{folder}/earlier/run-{run}")


def _has_state(spark: SparkSession, checkpoint: str) -> bool:
    commits = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(checkpoint, "commits/0")
    return commits.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(commits)


def _by_text(rows: DataFrame) -> DataFrame:
    """Groups by the texts themselves, for digests that different texts share."""
    groups = stored(rows.groupBy("digest", "norm").agg(F.max(_best()).alias("keep"), F.count("*").alias("group_size"))
                    .select("digest", "norm", "group_size", *_pick(F.col("keep"))), "dedup-clash-groups")
    return rows.join(groups, ["digest", "norm"])


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with their columns. Rows that share an id and are copies of each other: one stays."""
    found = stored(exact_duplicates(docs, id_col, text_col), "dedup-rows")
    by_id = found.groupBy("doc_id").agg(F.sum(F.col("kept").cast("long")).alias("stay"), F.count("*").alias("n"))
    away = stored(by_id.where("stay < n"), "dedup-away")
    out = without_ids(docs, away.select(F.col("doc_id").alias("__drop")), id_col)
    mixed = away.where("stay > 0").select(F.col("doc_id").alias("__id"))
    if mixed.isEmpty():
        return out
    # ids with rows of both kinds: one row for each text of which the id has the kept row
    few = mixed.count() <= BROADCAST_IDS
    text = F.col(text_col)
    rows = docs.join(F.broadcast(mixed) if few else mixed, docs[id_col].cast("long").eqNullSafe(mixed["__id"]), "left_semi")
    rows = rows.select(F.struct(*docs.columns).alias("__doc"), F.col(id_col).cast("long").alias("__id"),
                       sha256(normalised(text)).alias("__digest"), F.length(F.coalesce(text, F.lit(""))).alias("__n"))
    wanted = found.where("kept").select(F.col("doc_id").alias("__kid"), F.col("digest").alias("__kd")).distinct()
    one = rows.groupBy("__id", "__digest").agg(F.max_by("__doc", "__n").alias("__doc"))
    one = one.join(wanted, one["__id"].eqNullSafe(wanted["__kid"]) & (one["__digest"] == wanted["__kd"]), "left_semi")
    return out.unionByName(one.select("__doc.*"))
