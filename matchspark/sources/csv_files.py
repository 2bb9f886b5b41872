"""CSV sources of the ingest step (companies, jobs, candidate CVs).

Files are read as header-named string columns (no inference); fields may span lines, so a
file is one input split; callers repartition right after the scan. An empty field is "" (quoted or
not); a column missing from the header reads as NULL so the ingest rules can apply their
defaults. Every file is read by its own header. Every row has ``_row`` = (file, line): the record's ordinal in its file, which does not
depend on how files are packed into splits, ``_key`` (the same as a string, for ids) and ``_corrupt``
(the raw text of a record whose fields do not match the header, else NULL).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Column names of the three CSV files.
COMPANY_COLUMNS = ["Name Company", "Company Overview", "Company Size", "Company Address", "Industry"]
JOB_COLUMNS = COMPANY_COLUMNS + [
    "Salary", "Career Level", "Years of Experience", "Job Type", "Job Title", "Job Description",
    "Submission Deadline", "Job Address", "Job Requirements", "Benefits",
]
CV_COLUMNS = [
    "user_name", "userid", "gender", "desired_job_translated", "industry", "workplace_desired",
    "desired_salary", "work_experience", "Skills", "Experience",
]


def file_headers(spark: SparkSession, path: str) -> dict[tuple[str, ...], list[str]]:
    """The files at ``path`` by their header (column names in the order of the file). Only the first record of each file is read,
    by the driver, as the listing of the files is."""
    import csv
    import io

    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    codecs = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(conf)
    out: dict[tuple[str, ...], list[str]] = {}
    for name in sorted(spark.read.text(path).inputFiles()):
        p = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(name))
        codec = codecs.getCodec(p)
        stream = p.getFileSystem(conf).open(p)
        lines = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(codec.createInputStream(stream) if codec else stream, "UTF-8"))
        record = lines.readLine() or ""
        while record.count('"') % 2:                    # a quoted name may span lines
            more = lines.readLine()
            if more is None:
                break
            record += "\n" + more
        lines.close()
        header = tuple(next(csv.reader(io.StringIO(record.removeprefix("\ufeff"))), []))
        if header:
            out.setdefault(header, []).append(name)
    return out


def read_csv_strings(spark: SparkSession, path: str, columns: list[str], partitions: int | None = None) -> DataFrame:
    """The named columns of all files, each file by its own header: their order, and which there are, may differ from file to
    file. Files of one header are one scan, which fails if a file's header is another (``enforceSchema`` off)."""
    options = dict(header=True, multiLine=True, escape='"', nullValue="\u0000", emptyValue="", mode="PERMISSIVE", enforceSchema=False)
    rows = None
    for header, files in file_headers(spark, path).items():
        part = _scan(spark, options, header, files, columns)
        rows = part if rows is None else rows.unionByName(part)
    if rows is None:
        rows = spark.createDataFrame([], T.StructType([T.StructField(c, T.StringType()) for c in [*columns, "_corrupt", "_file"]]))
    rows = rows.withColumn("_at", F.monotonically_increasing_id())
    first = rows.groupBy("_file").agg(F.min("_at").alias("_first"))  # one row per file
    df = rows.join(first, "_file").withColumn("_row", F.struct(F.col("_file").alias("file"), (F.col("_at") - F.col("_first")).alias("line")))
    df = df.withColumn("_key", F.concat_ws("#", "_row.file", "_row.line")).drop("_at", "_first", "_file")
    return df.repartition(partitions) if partitions else df


def _scan(spark: SparkSession, options: dict, header: tuple[str, ...], files: list[str], columns: list[str]) -> DataFrame:
    # a name that occurs twice, or differs from another in case only, counts where it stands first
    seen: set[str] = set()
    names = [c if not (c.lower() in seen or seen.add(c.lower())) else f"{c}#{i}" for i, c in enumerate(header)]
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*names, "_corrupt"]])
    strict = options if names == list(header) else options | {"enforceSchema": True}
    raw = spark.read.options(**strict, columnNameOfCorruptRecord="_corrupt").schema(schema).csv(files)
    present = set(names)
    cols = [F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c) if c in present else F.lit(None).cast("string").alias(c)
            for c in columns]
    # the parser sees a broken record only if it reads all of its fields, so the mark refers to every column
    every = [F.substring(F.col(f"`{c}`"), 1, 0) for c in names]
    corrupt = F.when(F.length(F.concat_ws("", "_corrupt", *every)) > 0, F.col("_corrupt")).alias("_corrupt")
    return raw.select(*cols, corrupt, F.col("_metadata.file_path").alias("_file"))


def read_companies(spark, path, partitions=None):
    return read_csv_strings(spark, path, COMPANY_COLUMNS, partitions)


def read_jobs(spark, path, partitions=None):
    return read_csv_strings(spark, path, JOB_COLUMNS, partitions)


def read_cvs(spark, path, partitions=None):
    return read_csv_strings(spark, path, CV_COLUMNS, partitions)
