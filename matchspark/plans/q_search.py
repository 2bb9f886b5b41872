"""Entity scans, vector functions and exact top-k searches."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchspark.functions.vector import clamp01, cosine, l2_normalize, norm, present
from matchspark.operators.entities import active_jobs, main_cvs
from matchspark.operators.topk import exact_top_k, weighted_top_k
from matchspark.plans.catalog import register
from matchspark.plans.sqlparts import cos, dot as sql_dot, present as sql_present, title_topk_cte, with_views
from matchspark.sources.adapters import AS_OF, cv_view, job_view

R6 = 6


def _r(c):
    return F.round(c, R6)


def main_cv_df(spark, sf):
    return main_cvs(cv_view(spark, sf))


def active_job_df(spark, sf):
    return active_jobs(job_view(spark, sf), AS_OF)


# ---------------------------------------------------------------- scans / predicates
@register("main_cvs", with_views() + f"""
SELECT cv_id, label, {sql_present('experience_vec')} AS has_experience,
       {sql_present('skills_vec')} AS has_skills
FROM main_cv""")
def q_main_cvs(spark, sf):
    return main_cv_df(spark, sf).select(
        "cv_id", "label", present("experience_vec").alias("has_experience"),
        present("skills_vec").alias("has_skills"))


@register("active_jobs", with_views() + """
SELECT job_id, status, expires_at, label FROM active_job""")
def q_active_jobs(spark, sf):
    return active_job_df(spark, sf).select("job_id", "status", "expires_at", "label")


# ---------------------------------------------------------------- vector functions
@register("l2_normalize", with_views() + f"""
SELECT cv_id,
       CASE WHEN {sql_dot('experience_vec', 'experience_vec')} > 0
            THEN list_transform(experience_vec,
                   lambda x: round(x / sqrt({sql_dot('experience_vec', 'experience_vec')}), 6))
            ELSE list_transform(experience_vec, lambda x: round(x, 6)) END AS unit_vec,
       round(sqrt({sql_dot('experience_vec', 'experience_vec')}), 6) AS norm
FROM v_cv""")
def q_l2_normalize(spark, sf):
    cv = cv_view(spark, sf)
    return cv.select(
        "cv_id",
        F.transform(l2_normalize("experience_vec"), lambda x: F.round(x, R6)).alias("unit_vec"),
        _r(norm("experience_vec")).alias("norm"))


@register("cosine_pairs", with_views() + f"""
SELECT cv_id,
       round({cos('title_vec', 'experience_vec')}, 6) AS title_experience,
       round({cos('title_vec', 'skills_vec')}, 6) AS title_skills,
       round({cos('experience_vec', 'skills_vec')}, 6) AS experience_skills
FROM v_cv""")
def q_cosine_pairs(spark, sf):
    cv = cv_view(spark, sf)
    return cv.select(
        "cv_id",
        _r(cosine("title_vec", "experience_vec")).alias("title_experience"),
        _r(cosine("title_vec", "skills_vec")).alias("title_skills"),
        _r(cosine("experience_vec", "skills_vec")).alias("experience_skills"))


# ---------------------------------------------------------------- top-k searches
TOPK_SQL = with_views(title_topk_cte("t", 20)) + """
SELECT q_id AS cv_id, i_id AS job_id, round(sim, 6) AS similarity, rnk AS rank FROM t"""


def _topk_title(spark, sf, **kw):
    r = exact_top_k(main_cv_df(spark, sf), active_job_df(spark, sf), 20, query_id="cv_id",
                    query_vec="title_vec", item_id="job_id", item_vec="title_vec", **kw)
    return r.select("cv_id", "job_id", _r("similarity").alias("similarity"), "rank")


@register("topk_title", TOPK_SQL)
def q_topk_title(spark, sf):
    """Top 20 active jobs per main CV by title cosine (index path: unclamped)."""
    return _topk_title(spark, sf)


@register("topk_blocked", TOPK_SQL)
def q_topk_blocked(spark, sf):
    """Same answer through many small blocks and a shuffle join of block pairs."""
    return _topk_title(spark, sf, block_rows=64, broadcast_limit_bytes=0)


SIMILAR_SQL = with_views(title_topk_cte("t", 10, exclude_self=True, queries="active_job",
                                        qid="job_id")) + """
SELECT q_id AS job_id, i_id AS similar_job_id, round(sim, 6) AS similarity, rnk AS rank FROM t"""


@register("topk_similar_jobs", SIMILAR_SQL)
def q_topk_similar_jobs(spark, sf):
    """Top 10 neighbours of every active job among active jobs, self excluded."""
    jobs = active_job_df(spark, sf)
    r = exact_top_k(jobs, jobs, 10, query_id="job_id", query_vec="title_vec", item_id="job_id",
                    item_vec="title_vec", out_item="similar_job_id", exclude_self=True)
    return r.select("job_id", "similar_job_id", _r("similarity").alias("similarity"), "rank")


CLAMP = f"greatest(CAST(0 AS DOUBLE), least(CAST(1 AS DOUBLE), {cos('q.title_vec', 'c.title_vec')}))"


@register("similar_jobs_positive_only", with_views(f"""t AS (
  SELECT * FROM (
    SELECT q.job_id, c.job_id AS similar_job_id, {CLAMP} AS sim,
           CAST(row_number() OVER (PARTITION BY q.job_id ORDER BY {CLAMP} DESC, c.job_id) AS INTEGER) AS rnk
    FROM active_job q JOIN active_job c ON q.job_id <> c.job_id AND {sql_present('q.title_vec')}
    WHERE {CLAMP} > 0) WHERE rnk <= 10)""") + """
SELECT job_id, similar_job_id, round(sim, 6) AS similarity, rnk AS rank FROM t""")
def q_similar_positive(spark, sf):
    """Exact per-pair path: clamped score, self and scores <= 0 dropped, top 10."""
    jobs = active_job_df(spark, sf)
    r = exact_top_k(jobs, jobs, 10, query_id="job_id", query_vec="title_vec", item_id="job_id",
                    item_vec="title_vec", out_item="similar_job_id", exclude_self=True,
                    clamp=True, positive_only=True, absent_items_score_zero=True)
    return r.select("job_id", "similar_job_id", _r("similarity").alias("similarity"), "rank")


@register("clamp_similarity", with_views(f"""t AS (
  SELECT * FROM (
    SELECT q.cv_id, c.job_id, {CLAMP} AS sim,
           CAST(row_number() OVER (PARTITION BY q.cv_id ORDER BY {CLAMP} DESC, c.job_id) AS INTEGER) AS rnk
    FROM main_cv q JOIN active_job c ON {sql_present('q.title_vec')}) WHERE rnk <= 20)""") + """
SELECT cv_id, job_id, round(sim, 6) AS similarity, rnk AS rank FROM t""")
def q_clamp_similarity(spark, sf):
    """Exact per-pair CV->job path: every active job scored, clamped to [0, 1], top 20."""
    r = exact_top_k(main_cv_df(spark, sf), active_job_df(spark, sf), 20, query_id="cv_id",
                    query_vec="title_vec", item_id="job_id", item_vec="title_vec", clamp=True,
                    absent_items_score_zero=True)
    return r.select("cv_id", "job_id", _r("similarity").alias("similarity"), "rank")


WEIGHTS = (0.5, 0.3, 0.2)  # fixed values: title, skills, experience weights
WSCORE = (f"({WEIGHTS[0]} * {cos('q.title_vec', 'c.title_vec')} + "
          f"{WEIGHTS[1]} * {cos('q.skills_vec', 'c.skills_vec')} + "
          f"{WEIGHTS[2]} * {cos('q.experience_vec', 'c.requirement_vec')}) / {sum(WEIGHTS)}")


@register("weighted_similarity", with_views(f"""t AS (
  SELECT * FROM (
    SELECT q.cv_id, c.job_id, {WSCORE} AS sim,
           CAST(row_number() OVER (PARTITION BY q.cv_id ORDER BY {WSCORE} DESC, c.job_id) AS INTEGER) AS rnk
    FROM main_cv q JOIN active_job c ON TRUE) WHERE rnk <= 10)""") + """
SELECT cv_id, job_id, round(sim, 6) AS similarity, rnk AS rank FROM t""")
def q_weighted(spark, sf):
    """Top 10 jobs per main CV by 0.5*title + 0.3*skills + 0.2*experience cosine."""
    fields = [("title_vec", "title_vec", WEIGHTS[0]), ("skills_vec", "skills_vec", WEIGHTS[1]),
              ("experience_vec", "requirement_vec", WEIGHTS[2])]
    r = weighted_top_k(main_cv_df(spark, sf), active_job_df(spark, sf), 10, fields,
                       query_id="cv_id", item_id="job_id")
    return r.select("cv_id", "job_id", _r("similarity").alias("similarity"), "rank")



@register("all_jobs", with_views() + """
SELECT job_id, status, expires_at, label FROM v_job""")
def q_all_jobs(spark, sf):
    """Every job whatever its status (the unused all-jobs scan)."""
    return job_view(spark, sf).select("job_id", "status", "expires_at", "label")


@register("vector_json", with_views() + """
SELECT cv_id, list_transform(experience_vec, lambda x: round(x, 6)) AS vec FROM v_cv""")
def q_vector_json(spark, sf):
    """Vectors written as JSON text and read back (storage round trip), rounded for comparison."""
    from matchspark.functions.vector import vector_from_json, vector_to_json
    cv = cv_view(spark, sf).select("cv_id", vector_to_json("experience_vec").alias("j"))
    return cv.select("cv_id", F.transform(vector_from_json("j"), lambda x: F.round(x.cast("double"), 6)).alias("vec"))
