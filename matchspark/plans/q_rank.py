"""Cascade rounds and IVF index searches."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchspark.operators import ivf as ivf_ops
from matchspark.operators.cascade import cascade, round1, round2_candidates
from matchspark.operators.topk import exact_top_k
from matchspark.plans.catalog import register
from matchspark.plans.q_search import TOPK_SQL, active_job_df, main_cv_df
from matchspark.plans.sqlparts import (cascade_ctes, cascade_sql, cos, dot, present,
                                       title_topk_cte, with_views)


def _r(c):
    return F.round(c, 6)


# ---------------------------------------------------------------- cascade
@register("cascade_round1", with_views(title_topk_cte("r1", 50)) + """
SELECT q_id AS cv_id, i_id AS job_id, round(sim, 6) AS similarity, rnk AS rank FROM r1""")
def q_cascade_round1(spark, sf):
    r = round1(main_cv_df(spark, sf), active_job_df(spark, sf), 50)
    return r.select("cv_id", "job_id", _r("title_sim").alias("similarity"), F.col("r1").alias("rank"))


@register("cascade_round2", with_views(*cascade_ctes(50, 20, 10)[:2]) + """
SELECT q_id AS cv_id, i_id AS job_id, round(s2, 6) AS similarity, r1 AS round1_rank, rnk2 AS rank FROM r2""")
def q_cascade_round2(spark, sf):
    r = round2_candidates(main_cv_df(spark, sf), active_job_df(spark, sf), k1=50, k2=20)
    return r.select("cv_id", "job_id", _r("exp_sim").alias("similarity"),
                    F.col("r1").alias("round1_rank"), F.col("r2").alias("rank"))


@register("cascade_full", cascade_sql(50, 20, 10))
def q_cascade_full(spark, sf):
    """Flagship: three-round cascade with K = 50 / 20 / 10."""
    r = cascade(main_cv_df(spark, sf), active_job_df(spark, sf), k1=50, k2=20, k3=10)
    return r.select("cv_id", "job_id", _r("similarity").alias("similarity"), "rank")


@register("cascade_other_k", cascade_sql(1000, 100, 10))
def q_cascade_other_k(spark, sf):
    """Reference defaults K = 1000 / 100 / 10."""
    r = cascade(main_cv_df(spark, sf), active_job_df(spark, sf), k1=1000, k2=100, k3=10)
    return r.select("cv_id", "job_id", _r("similarity").alias("similarity"), "rank")


# ---------------------------------------------------------------- IVF
def _unit_sql(v: str) -> str:
    return f"list_transform({v}, lambda x: x / sqrt({dot(v, v)}))"


IVF_GIVEN_SQL = with_views(
    f"""ju AS (SELECT job_id, title_vec, label, {_unit_sql('title_vec')} AS u
  FROM active_job WHERE {present('title_vec')})""",
    """cent AS (
  SELECT label AS cell, list(m ORDER BY pos) AS c FROM (
    SELECT label, pos, avg(x) AS m FROM (
      SELECT label, unnest(generate_series(1, len(u))) AS pos, unnest(u) AS x FROM ju)
    GROUP BY label, pos)
  GROUP BY label)""",
    f"""jcell AS (
  SELECT job_id, title_vec, cell FROM (
    SELECT j.job_id, j.title_vec, c.cell,
           row_number() OVER (PARTITION BY j.job_id ORDER BY {cos('j.u', 'c.c')} DESC, c.cell) AS rn
    FROM ju j CROSS JOIN cent c) WHERE rn = 1)""",
    f"""probe AS (
  SELECT cv_id, cell FROM (
    SELECT q.cv_id, c.cell,
           row_number() OVER (PARTITION BY q.cv_id ORDER BY {cos('q.title_vec', 'c.c')} DESC, c.cell) AS rn
    FROM main_cv q CROSS JOIN cent c WHERE {present('q.title_vec')}) WHERE rn <= 3)""",
    f"""cand AS (
  SELECT p.cv_id, j.job_id, {cos('q.title_vec', 'j.title_vec')} AS sim
  FROM probe p JOIN jcell j ON j.cell = p.cell JOIN main_cv q ON q.cv_id = p.cv_id)""",
) + """
SELECT cv_id, job_id, round(sim, 6) AS similarity, rank FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY cv_id ORDER BY sim DESC, job_id) AS INTEGER) AS rank
  FROM cand) WHERE rank <= 20"""


@register("ivf_given_cells", IVF_GIVEN_SQL)
def q_ivf_given_cells(spark, sf):
    """IVF search with one cell per label (centroid = mean unit vector), 3 of 10 cells probed."""
    jobs = active_job_df(spark, sf)
    cent, labels = ivf_ops.label_mean_centroids(jobs, "title_vec", "label")
    idx = ivf_ops.build_index(jobs, "job_id", "title_vec", centroids=cent, nprobe=3, cell_labels=labels)
    r = ivf_ops.search(idx, main_cv_df(spark, sf), 20, query_id="cv_id", query_vec="title_vec",
                       out_item="job_id")
    return r.select("cv_id", "job_id", _r("similarity").alias("similarity"), "rank")


@register("ivf_full_probe", TOPK_SQL)
def q_ivf_full_probe(spark, sf):
    """Trained IVF index (cosine k-means, nlist = min(100, n // 10)) probed in every cell."""
    jobs = active_job_df(spark, sf)
    idx = ivf_ops.build_index(jobs, "job_id", "title_vec", nlist=100, nprobe=100)
    r = ivf_ops.search(idx, main_cv_df(spark, sf), 20, query_id="cv_id", query_vec="title_vec",
                       out_item="job_id", nprobe=idx.nlist)
    return r.select("cv_id", "job_id", _r("similarity").alias("similarity"), "rank")


@register("ivf_recall", with_views() + f"""
SELECT (SELECT count(DISTINCT cv_id) FROM main_cv WHERE {present('title_vec')}) AS queries, 20 AS k, TRUE AS recall_ok""")
def q_ivf_recall(spark, sf):
    """Recall@20 of the default IVF search (measured number of probes) against exact search: at least 0.95."""
    jobs = active_job_df(spark, sf)
    cvs = main_cv_df(spark, sf)
    idx = ivf_ops.build_index(jobs, "job_id", "title_vec")
    approx = ivf_ops.search(idx, cvs, 20, query_id="cv_id", query_vec="title_vec", out_item="job_id")
    exact = exact_top_k(cvs, jobs, 20, query_id="cv_id", query_vec="title_vec", item_id="job_id",
                        item_vec="title_vec")
    hits = exact.alias("e").join(approx.alias("a"), ["cv_id", "job_id"], "left")
    return hits.agg(F.count_distinct("cv_id").alias("queries"), F.lit(20).alias("k"),
                    (F.count("a.rank") / F.count(F.lit(1)) >= 0.95).alias("recall_ok"))
