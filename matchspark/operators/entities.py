"""Entity scans and predicates (main CVs, active jobs)."""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_active(as_of: _dt.datetime, status: str = "status", expires_at: str = "expires_at") -> Column:
    """Active and unexpired: status = 'ACTIVE' AND (expires_at IS NULL OR expires_at > as_of)."""
    return (F.col(status) == F.lit("ACTIVE")) & (
        F.col(expires_at).isNull() | (F.col(expires_at) > F.lit(as_of))
    )


def active_jobs(jobs: DataFrame, as_of: _dt.datetime) -> DataFrame:
    return jobs.where(is_active(as_of))


def main_cvs(cvs: DataFrame) -> DataFrame:
    return cvs.where(F.col("is_main"))
