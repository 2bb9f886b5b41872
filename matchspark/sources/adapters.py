"""Entity views derived from the driver tables.

The reference's own data is not available, so CVs and jobs are derived from ``embeddings``
(``vec_id`` runs 0..n-1). Every embedding row is both a CV and a job; the other vector fields
and the attributes come from fixed rules so that absent vectors, inactive and expired jobs
and non-main CVs all occur. The same rules are written in SQL in ``plans/sqlparts.py``.

Fixed rules (shared with the oracle SQL):
  experience_vec / requirement_vec = embedding((7*id + 3) % n)
  skills_vec                       = embedding((3*id + 1) % n)
  cv:  experience NULL if id % 4 = 0; skills NULL if id % 15 = 0; is_main = id % 10 <> 5 OR id < 50
  job: requirement NULL if id % 13 = 0; skills NULL if id % 17 = 0;
       status 'INACTIVE' if id % 11 = 0 else 'ACTIVE';
       expires_at NULL if id % 3 = 0 else 2024-01-01 + (id % 365) days
  as_of = 2024-06-01; relevance of (cv, job) = equal label
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchspark.sources.tables import read_table

AS_OF = _dt.datetime(2024, 6, 1)


def edited_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings after an edit: about one in a hundred is reversed (fixed rule, shared with the oracle SQL)."""
    emb = read_table(spark, sf_dir, "embeddings", ["vec_id", "embedding", "label"])
    return emb.withColumn("embedding", F.when(F.col("vec_id") % 97 == 0, F.reverse("embedding")).otherwise(F.col("embedding")))


def _vectors(spark: SparkSession, sf_dir: str, emb: DataFrame | None = None) -> DataFrame:
    if emb is None:
        emb = read_table(spark, sf_dir, "embeddings", ["vec_id", "embedding", "label"])
    n = emb.count()  # one scalar; needed by the partner rules
    base = emb.select(
        F.col("vec_id").alias("id"),
        F.col("embedding").alias("title_vec"),
        "label",
        F.pmod(F.col("vec_id") * 7 + 3, F.lit(n)).alias("p_exp"),
        F.pmod(F.col("vec_id") * 3 + 1, F.lit(n)).alias("p_skl"),
    )
    pe = emb.select(F.col("vec_id").alias("p_exp"), F.col("embedding").alias("exp_vec"))
    ps = emb.select(F.col("vec_id").alias("p_skl"), F.col("embedding").alias("skl_vec"))
    return base.join(pe, "p_exp", "left").join(ps, "p_skl", "left").drop("p_exp", "p_skl")


def cv_view(spark: SparkSession, sf_dir: str, emb: DataFrame | None = None) -> DataFrame:
    v = _vectors(spark, sf_dir, emb)
    i = F.col("id")
    return v.select(
        i.alias("cv_id"),
        "title_vec",
        F.when(i % 4 == 0, F.lit(None)).otherwise(F.col("exp_vec")).alias("experience_vec"),
        F.when(i % 15 == 0, F.lit(None)).otherwise(F.col("skl_vec")).alias("skills_vec"),
        ((i % 10 != 5) | (i < 50)).alias("is_main"),
        "label",
    )


def job_view(spark: SparkSession, sf_dir: str, emb: DataFrame | None = None) -> DataFrame:
    v = _vectors(spark, sf_dir, emb)
    i = F.col("id")
    return v.select(
        i.alias("job_id"),
        "title_vec",
        F.when(i % 13 == 0, F.lit(None)).otherwise(F.col("exp_vec")).alias("requirement_vec"),
        F.when(i % 17 == 0, F.lit(None)).otherwise(F.col("skl_vec")).alias("skills_vec"),
        F.when(i % 11 == 0, F.lit("INACTIVE")).otherwise(F.lit("ACTIVE")).alias("status"),
        F.when(i % 3 == 0, F.lit(None).cast("timestamp"))
        .otherwise(F.timestamp_add("DAY", (i % 365).cast("int"), F.lit(_dt.datetime(2024, 1, 1))))
        .alias("expires_at"),
        "label",
    )
