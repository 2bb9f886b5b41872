"""Whole runs over the adapter entities (fresh warehouse folder per call)."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from matchspark.config import MatchConfig
from matchspark.operators.entities import active_jobs, main_cvs
from matchspark.plans import runs
from matchspark.plans.catalog import register
from matchspark.plans.q_search import SIMILAR_SQL, active_job_df, main_cv_df
from matchspark.plans.sqlparts import cascade_ctes, cascade_sql, present, title_topk_cte, with_views
from matchspark.sources.adapters import AS_OF, cv_view, edited_vectors, job_view

# Reference defaults (cascade 1000 / 100 / 10, 10 neighbours) by blocks, as shipped (index, read by its bounds), and by a
# measured number of probes (whose recall is checked).
EXACT = MatchConfig(strategy="exact")
SHIPPED = MatchConfig()
PROBED = MatchConfig(bounded=False)


def _r(c):
    return F.round(c, 6)


@register("recommend_run", cascade_sql(1000, 100, 10))
def q_recommend_run(spark, sf):
    """Load, search, cascade, publish (keyed replace) and read back the published table."""
    res = runs.recommend(spark, main_cv_df(spark, sf), active_job_df(spark, sf), EXACT,
                         runs.fresh_warehouse(spark))
    return res.recommendations.select("cv_id", "job_id", _r("similarity").alias("similarity"), "rank")


@register("similar_run", SIMILAR_SQL)
def q_similar_run(spark, sf):
    res = runs.similar(spark, active_job_df(spark, sf), EXACT, runs.fresh_warehouse(spark))
    return res.similar.select("job_id", "similar_job_id", _r("similarity").alias("similarity"), "rank")


@register("run_stats", with_views(*cascade_ctes(1000, 100, 10),
                                  title_topk_cte("sim", 10, exclude_self=True, queries="active_job",
                                                 qid="job_id")) + f"""
SELECT 'recommendations' AS metric, CAST((SELECT count(*) FROM r3) AS BIGINT) AS value
UNION ALL SELECT 'similar_pairs', CAST((SELECT count(*) FROM sim) AS BIGINT)
UNION ALL SELECT 'cvs_processed', (SELECT count(*) FROM main_cv)
UNION ALL SELECT 'cvs_with_vector', (SELECT count(*) FROM main_cv WHERE {present('title_vec')})
UNION ALL SELECT 'jobs_processed', (SELECT count(*) FROM active_job)
UNION ALL SELECT 'jobs_with_vector', (SELECT count(*) FROM active_job WHERE {present('title_vec')})""")
def q_run_stats(spark, sf):
    """Counters of a full run (recommendations first, then similar jobs, shared index)."""
    res = runs.full_run(spark, main_cv_df(spark, sf), active_job_df(spark, sf), EXACT,
                        runs.fresh_warehouse(spark))
    return res.stats


@register("full_run_reverse", cascade_sql(1000, 100, 10))
def q_full_run_reverse(spark, sf):
    """Similar jobs first, then recommendations, sharing one index: same published tables."""
    res = runs.full_run(spark, main_cv_df(spark, sf), active_job_df(spark, sf), EXACT,
                        runs.fresh_warehouse(spark), reverse=True)
    return res.recommendations.select("cv_id", "job_id", _r("similarity").alias("similarity"), "rank")


@register("similar_run_ivf", with_views(title_topk_cte("sim", 10, exclude_self=True, queries="active_job", qid="job_id")) + """
SELECT (SELECT count(DISTINCT q_id) FROM sim) AS jobs, TRUE AS recall_ok""")
def q_similar_run_ivf(spark, sf):
    """The run with a measured number of probes: recall of its published lists is at least 0.95."""
    jobs, warehouse = active_job_df(spark, sf), runs.fresh_warehouse(spark)
    found = runs.similar(spark, jobs, PROBED, warehouse).similar.select("job_id", "similar_job_id", F.lit(1).alias("hit"))
    exact = runs.similar(spark, jobs, EXACT, runs.fresh_warehouse(spark)).similar
    both = exact.join(found, ["job_id", "similar_job_id"], "left")
    return both.agg(F.count_distinct("job_id").alias("jobs"),
                    (F.count("hit") / F.count(F.lit(1)) >= 0.95).alias("recall_ok"))


@register("recommend_run_ivf", with_views(title_topk_cte("t20", 20)) + """
SELECT (SELECT count(DISTINCT q_id) FROM t20) AS cvs, TRUE AS recall_ok""")
def q_recommend_run_ivf(spark, sf):
    """Plain top-20 run with a measured number of probes: recall of its published lists is at least 0.95."""
    cvs, jobs = main_cv_df(spark, sf), active_job_df(spark, sf)
    found, exact = (runs.recommend(spark, cvs, jobs, replace(c, use_cascade=False), runs.fresh_warehouse(spark)).recommendations
                    for c in (PROBED, EXACT))
    both = exact.join(found.select("cv_id", "job_id", F.lit(1).alias("hit")), ["cv_id", "job_id"], "left")
    return both.agg(F.count_distinct("cv_id").alias("cvs"),
                    (F.count("hit") / F.count(F.lit(1)) >= 0.95).alias("recall_ok"))


@register("recommend_run_default", cascade_sql(1000, 100, 10))
def q_recommend_run_default(spark, sf):
    """The run as ``MatchConfig()`` gives it (index read by its bounds, cascade): the published lists are the exact ones."""
    res = runs.recommend(spark, main_cv_df(spark, sf), active_job_df(spark, sf), SHIPPED, runs.fresh_warehouse(spark))
    return res.recommendations.select("cv_id", "job_id", _r("similarity").alias("similarity"), "rank")


@register("similar_run_default", SIMILAR_SQL)
def q_similar_run_default(spark, sf):
    res = runs.similar(spark, active_job_df(spark, sf), SHIPPED, runs.fresh_warehouse(spark))
    return res.similar.select("job_id", "similar_job_id", _r("similarity").alias("similarity"), "rank")


# ---------------------------------------------------------------- incremental runs
# The same entities after an edit: about 1 % of the vectors differ, 1 % of the jobs and of the CVs are gone.
EDITED = "FROM (SELECT vec_id, label, CASE WHEN vec_id % 97 = 0 THEN list_reverse(embedding) ELSE embedding END AS embedding FROM embeddings)"
GONE_JOB, GONE_CV = "job_id % 101 = 7", "cv_id % 103 = 9"


def edited_sql(sql: str) -> str:
    sql = sql.replace("label FROM embeddings)", f"label {EDITED})", 1)
    return sql.replace("WHERE status = 'ACTIVE'", f"WHERE NOT {GONE_JOB} AND status = 'ACTIVE'", 1).replace("WHERE is_main)", f"WHERE is_main AND NOT {GONE_CV})", 1)


def after_edit(spark, sf, cfg):
    """A full run, the edit, an incremental run in the same warehouse."""
    warehouse = runs.fresh_warehouse(spark)
    runs.incremental_run(spark, main_cv_df(spark, sf), active_job_df(spark, sf), cfg, warehouse)
    emb = edited_vectors(spark, sf)
    cvs = main_cvs(cv_view(spark, sf, emb)).where(f"NOT {GONE_CV}")
    jobs = active_jobs(job_view(spark, sf, emb), AS_OF).where(f"NOT {GONE_JOB}")
    return runs.incremental_run(spark, cvs, jobs, cfg, warehouse)


@register("incremental_lists", edited_sql(with_views(title_topk_cte("t20", 20), title_topk_cte("t", 10, exclude_self=True, queries="active_job", qid="job_id")) + """
SELECT 'cv' AS list, q_id AS id, i_id AS job_id, round(sim, 6) AS similarity, rnk AS rank FROM t20
UNION ALL SELECT 'job', q_id, i_id, round(sim, 6), rnk FROM t
UNION ALL SELECT 'cv lists, fewer than a fifth searched again, not all made again', count(*), NULL, NULL, NULL FROM main_cv WHERE title_vec IS NOT NULL"""))
def q_incremental_lists(spark, sf):
    """Top-20 and neighbour lists after 1 % of edits: only lists that the edits reach are made again, and few of them
    by a search of the whole corpus; all equal a full run."""
    res = after_edit(spark, sf, replace(SHIPPED, use_cascade=False))
    cv = res.recommendations.select(F.lit("cv").alias("list"), F.col("cv_id").alias("id"), "job_id", _r("similarity").alias("similarity"), "rank")
    job = res.similar.select(F.lit("job"), "job_id", "similar_job_id", _r("similarity"), "rank")
    value = lambda m: F.max(F.when(F.col("metric") == m, F.col("value")))
    said = F.concat(F.lit("cv lists, "), F.when(value("cv_lists_searched") < 0.2 * value("cv_lists"), "fewer than a fifth").otherwise("many"),
                    F.lit(" searched again, "), F.when(value("cv_lists_made") < value("cv_lists"), "not all").otherwise("all"), F.lit(" made again"))
    none = [F.lit(None).cast(k) for k in ("long", "double", "int")]
    return cv.unionAll(job).unionAll(res.stats.agg(said.alias("list"), value("cv_lists").alias("id")).select("list", "id", *none))


@register("incremental_cascade", edited_sql(cascade_sql(1000, 100, 10)))
def q_incremental_cascade(spark, sf):
    """Cascade lists after 1 % of edits, from title lists that were kept up to date."""
    res = after_edit(spark, sf, SHIPPED)
    return res.recommendations.select("cv_id", "job_id", _r("similarity").alias("similarity"), "rank")
