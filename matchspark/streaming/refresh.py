"""Periodic refresh as a Structured Streaming query.

The source system re-ran its whole batch on a timer; here the trigger is the arrival of
changed entity rows. Job changes (job rows with vectors) land as Parquet files in a folder;
every micro-batch merges them into the job table by keyed replace (last row per job wins),
then re-runs recommendations and job neighbours on the current tables with the shared index
(rebuilt only when the job corpus changed). ``foreachBatch`` + a checkpoint location give
exactly-once table versions: a failed batch is re-run from the same input offsets.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from matchspark.config import MatchConfig
from matchspark.operators.entities import active_jobs
from matchspark.operators.publish import dedupe_last, publish_edges, read_current
from matchspark.plans import runs


def merge_jobs(spark: SparkSession, warehouse: str, changes: DataFrame) -> DataFrame:
    """Keyed replace of changed job rows into ``<warehouse>/jobs``; returns the new table."""
    base = os.path.join(warehouse, "jobs")
    cols = [c for c in changes.columns if c != "_seq"]
    latest = dedupe_last(changes, ["job_id"], "_seq", [c for c in cols if c != "job_id"])
    publish_edges(spark, base, latest.select(*cols), "job_id")
    return read_current(spark, base)


def start_refresh(spark: SparkSession, changes_dir: str, job_schema: str, cvs: DataFrame,
                  cfg: MatchConfig, warehouse: str, checkpoint: str | None = None,
                  trigger: dict | None = None) -> StreamingQuery:
    """Start the refresh stream. ``trigger`` e.g. {"processingTime": "12 hours"} or
    {"availableNow": True} (process what is there, then stop)."""
    stream = spark.readStream.schema(job_schema).parquet(changes_dir)

    def refresh(batch: DataFrame, epoch_id: int) -> None:
        if batch.isEmpty():
            return
        # Later rows of the batch win over earlier rows of the same job.
        jobs = merge_jobs(spark, warehouse, batch.withColumn("_seq", F.monotonically_increasing_id()))
        runs.full_run(spark, cvs, active_jobs(jobs, cfg.as_of), cfg, warehouse)

    ckpt = checkpoint or os.path.join(warehouse, "_refresh_checkpoint")
    w = stream.writeStream.foreachBatch(refresh).option("checkpointLocation", ckpt)
    w = w.trigger(**(trigger or {"processingTime": "12 hours"}))
    return w.start()
