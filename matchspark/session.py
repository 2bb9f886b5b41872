"""Session helpers.

The library never creates machine-local scratch space on a cluster: lineage is cut with
``DataFrame.checkpoint()`` into the folder the cluster names in ``spark.checkpoint.dir``.
Only when that setting is absent and the master is local (unit tests) a directory is chosen here.
"""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession

PACKAGE_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

LOCAL_CONF = {
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.driver.memory": "16g",
    "spark.sql.ansi.enabled": "true",
}


def local_session(cpus: int | str = "*", app: str = "matchspark") -> SparkSession:
    """Session for tests and local benchmarks (the cluster supplies its own)."""
    if PACKAGE_ROOT not in os.environ.get("PYTHONPATH", "").split(os.pathsep):  # for the Python workers
        os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [PACKAGE_ROOT, os.environ.get("PYTHONPATH")]))
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for k, v in LOCAL_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder; set a local one only if none is configured."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return current
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    path = tempfile.mkdtemp(prefix="matchspark-ckpt-")
    sc.setCheckpointDir(path)
    return path


def checkpointed(df: DataFrame) -> DataFrame:
    """A reliable checkpoint (in the shared folder) of ``df``: cuts the lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")


def materialize(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` as a Parquet table on shared storage and read it back (lineage cut at a
    columnar table; survives executor loss like a reliable checkpoint)."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def cluster_conf(input_bytes: int, total_cores: int, target_partition_bytes: int = 256 << 20) -> dict[str, str]:
    """Sizing for a cluster run: shuffle partitions so one partition holds about
    ``target_partition_bytes`` of the largest shuffle (taken as the input size), at least two
    waves of tasks; scan splits of 256 MB; AQE on (coalescing, skew-join splitting of hot keys)."""
    parts = max(2 * total_cores, -(-input_bytes // target_partition_bytes))
    return {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(target_partition_bytes // 2),
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.files.maxPartitionBytes": str(256 << 20),
        "spark.sql.execution.arrow.maxRecordsPerBatch": "10000",
        "spark.sql.session.timeZone": "UTC",
    }


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors as a zip file, where it is not installed there."""
    with tempfile.TemporaryDirectory() as work:
        spark.sparkContext.addPyFile(shutil.make_archive(os.path.join(work, "matchspark"), "zip", PACKAGE_ROOT, "matchspark"))
