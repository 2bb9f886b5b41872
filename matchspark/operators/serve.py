"""Serving reads over the published tables (join + order + limit)."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchspark.operators.entities import is_active


def top_n_per_key(df: DataFrame, key: str, score: str, n: int, tie: str, rank_col: str = "rank") -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.col(score).desc(), F.col(tie))
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= n)


def recommendations_with_jobs(recs: DataFrame, jobs: DataFrame, limit: int = 20,
                              job_cols: list[str] | None = None) -> DataFrame:
    """Every CV's recommendations joined to job details, best first, at most ``limit``."""
    j = jobs.select("job_id", *(job_cols or []))
    return top_n_per_key(recs.join(j, "job_id"), "cv_id", "similarity", limit, "job_id")


def recommendations_for(recs: DataFrame, jobs: DataFrame, cv_id, limit: int = 20,
                        job_cols: list[str] | None = None) -> DataFrame:
    """Point read for one CV: ORDER BY similarity DESC LIMIT n."""
    j = jobs.select("job_id", *(job_cols or []))
    return (recs.where(F.col("cv_id") == F.lit(cv_id)).join(j, "job_id")
            .orderBy(F.col("similarity").desc(), "job_id").limit(limit))


def similar_active(edges: DataFrame, jobs: DataFrame, as_of: _dt.datetime, limit: int = 10,
                   job_cols: list[str] | None = None) -> DataFrame:
    """Neighbours shown for every job: only active, unexpired neighbours, numbered 1..n.

    Stored lists are cut before this filter, so a job may show fewer than ``limit``.
    """
    act = jobs.where(is_active(as_of)).select(F.col("job_id").alias("similar_job_id"), *(job_cols or []))
    return top_n_per_key(edges.join(act, "similar_job_id"), "job_id", "similarity", limit,
                         "similar_job_id", rank_col="position")


def similar_for(edges: DataFrame, jobs: DataFrame, job_id, as_of: _dt.datetime, limit: int = 10) -> DataFrame:
    act = jobs.where(is_active(as_of)).select(F.col("job_id").alias("similar_job_id"))
    return (edges.where(F.col("job_id") == F.lit(job_id)).join(act, "similar_job_id")
            .orderBy(F.col("similarity").desc(), "similar_job_id").limit(limit)
            .withColumn("position", F.row_number().over(
                Window.orderBy(F.col("similarity").desc(), "similar_job_id"))))


def similar_counts(edges: DataFrame, jobs: DataFrame, extra_cols: list[str] | None = None) -> DataFrame:
    """Active jobs with their number of stored neighbours, most neighbours first."""
    act = jobs.where(F.col("status") == "ACTIVE").select("job_id", *(extra_cols or []))
    return (act.join(edges, "job_id")
            .groupBy("job_id", *(extra_cols or []))
            .agg(F.count("similar_job_id").alias("similar_count"))
            .orderBy(F.col("similar_count").desc(), "job_id"))
