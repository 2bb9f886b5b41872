"""Keyed-replace publishing, serving reads, constraint reports and record counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchspark.functions.text import email_for_user
from matchspark.operators.cascade import cascade, round1
from matchspark.operators.ivf import corpus_fingerprint
from matchspark.operators.publish import commit_replace, dedupe_last, fill_null_update, keyed_replace, partial_update, prepare_replace, publish_edges, read_current, read_key
from matchspark.operators.quality import (ForeignKey, cascade_delete, cascade_graph, domain_violations, orphans, record_counts,
                                          unique_violations)
from matchspark.operators.serve import recommendations_with_jobs, similar_active, similar_counts
from matchspark.operators.topk import exact_top_k
from matchspark.plans import runs
from matchspark.plans.catalog import register
from matchspark.plans.q_search import active_job_df, main_cv_df
from matchspark.plans.sqlparts import cascade_ctes, title_topk_cte, with_views
from matchspark.schemas import ENUMS
from matchspark.session import checkpointed
from matchspark.sources.adapters import AS_OF, cv_view, job_view
from matchspark.sources.tables import read_table

# Interaction event types counted as view / click / apply.
INTERACTIONS = ("view", "click", "purchase")


def _r(c):
    return F.round(c, 6)


_PUBLISHED: dict[tuple, str] = {}


def published(spark, sf, name, key, make):
    """The table ``name`` as an earlier run published it: written once per session and content of the vectors it is made from, then
    read from its files, clustered by ``key`` (a filter on the key reaches the scan)."""
    made_from = corpus_fingerprint(read_table(spark, sf, "embeddings", ["vec_id", "embedding"]), "vec_id", "embedding")
    at = (spark.sparkContext.applicationId, sf, name, made_from)
    if at not in _PUBLISHED:
        base = f"{runs.fresh_warehouse(spark)}/{name}"
        publish_edges(spark, base, make(), key)
        _PUBLISHED[at] = base
    return read_current(spark, _PUBLISHED[at])


def old_recs(spark, sf):
    """Previous run: title-only top 20 for every CV (main or not)."""
    return published(spark, sf, "recommend_jobs_for_cv", "cv_id", lambda: exact_top_k(
        cv_view(spark, sf), active_job_df(spark, sf), 20, query_id="cv_id",
        query_vec="title_vec", item_id="job_id", item_vec="title_vec"))


def new_recs(spark, sf, candidates=None):
    """This run: cascade 50/20/10 for the main CVs."""
    return cascade(main_cv_df(spark, sf), active_job_df(spark, sf), k1=50, k2=20, k3=10, candidates=candidates)


def stored_similar(spark, sf):
    """Neighbour lists stored when every job was still listed (10 per job, self excluded)."""
    jobs = job_view(spark, sf)
    return published(spark, sf, "similar_jobs", "job_id", lambda: exact_top_k(
        jobs, jobs, 10, query_id="job_id", query_vec="title_vec", item_id="job_id",
        item_vec="title_vec", out_item="similar_job_id", exclude_self=True))


OLD_NEW = [title_topk_cte("old", 20, queries="v_cv")] + cascade_ctes(50, 20, 10)
SIMILAR_ALL = title_topk_cte("sim", 10, exclude_self=True, queries="v_job", qid="job_id", corpus="v_job")


@register("publish_replace", with_views(*OLD_NEW) + """
SELECT q_id AS cv_id, i_id AS job_id, round(sim, 6) AS similarity, rnk AS rank, 'old' AS source
FROM old WHERE q_id NOT IN (SELECT cv_id FROM main_cv)
UNION ALL
SELECT q_id, i_id, round(s3, 6), rnk3, 'new' FROM r3""")
def q_publish_replace(spark, sf):
    """Keyed replace: every processed (main) CV's rows are replaced, other CVs keep theirs."""
    old = old_recs(spark, sf).withColumn("source", F.lit("old"))
    new = new_recs(spark, sf).withColumn("source", F.lit("new"))
    out = keyed_replace(old, new, "cv_id", processed_keys=main_cv_df(spark, sf).select("cv_id"))
    return out.select("cv_id", "job_id", _r("similarity").alias("similarity"), "rank", "source")


@register("publish_two_writers", with_views(*OLD_NEW) + """
SELECT q_id AS cv_id, i_id AS job_id, round(sim, 6) AS similarity, rnk AS rank FROM old WHERE q_id NOT IN (SELECT cv_id FROM main_cv)
UNION ALL SELECT q_id, i_id, round(s3, 6), rnk3 FROM r3""")
def q_publish_two_writers(spark, sf):
    """Two writers start from the same version, each with half of the processed CVs: the second merges on top of the first and
    both survive."""
    base = f"{runs.fresh_warehouse(spark)}/recommend_jobs_for_cv"
    publish_edges(spark, base, old_recs(spark, sf).select("cv_id", "job_id", "similarity", "rank"), "cv_id")
    new, cvs = checkpointed(new_recs(spark, sf)), main_cv_df(spark, sf).select("cv_id")
    halves = [prepare_replace(spark, base, new.where(F.col("cv_id") % 2 == i), "cv_id", cvs.where(F.col("cv_id") % 2 == i)) for i in (0, 1)]
    for half in halves:
        commit_replace(spark, half)
    return read_current(spark, base).select("cv_id", "job_id", _r("similarity").alias("similarity"), "rank")


@register("publish_one_bucket", with_views(title_topk_cte("old", 20, queries="v_cv")) + """
SELECT i_id AS job_id, round(sim / 2, 6) AS similarity, rnk AS rank, 1 AS buckets_written
FROM old WHERE q_id = (SELECT min(cv_id) FROM main_cv)""")
def q_publish_one_bucket(spark, sf):
    """A replace of one CV of a table in 1,000 buckets writes one bucket; the list is read back from it."""
    base = f"{runs.fresh_warehouse(spark)}/recommend_jobs_for_cv"
    recs = old_recs(spark, sf).select("cv_id", "job_id", "similarity", "rank")
    publish_edges(spark, base, recs, "cv_id", buckets=1000)
    cv_id = main_cv_df(spark, sf).agg(F.min("cv_id")).first()[0]
    one = recs.where(F.col("cv_id") == cv_id).withColumn("similarity", F.col("similarity") / 2)
    _, written = publish_edges(spark, base, one, "cv_id")
    return read_key(spark, base, cv_id).select("job_id", _r("similarity").alias("similarity"), "rank", F.lit(written).alias("buckets_written"))


def _batch(spark, sf):
    found = checkpointed(round1(main_cv_df(spark, sf), active_job_df(spark, sf), 50))     # searched once for both parts
    c1 = found.select("cv_id", "job_id", F.col("title_sim").alias("similarity"), F.lit(1).alias("seq"))
    c3 = new_recs(spark, sf, found).select("cv_id", "job_id", "similarity", F.lit(2).alias("seq"))
    return c1.unionByName(c3)


BATCH_SQL = with_views(*cascade_ctes(50, 20, 10), """batch AS (
  SELECT q_id AS cv_id, i_id AS job_id, sim AS similarity, 1 AS seq FROM r1
  UNION ALL SELECT q_id, i_id, s3, 2 FROM r3)""")


@register("publish_dedupe", BATCH_SQL + """
SELECT cv_id, job_id, round(arg_max(similarity, seq), 6) AS similarity FROM batch GROUP BY cv_id, job_id""")
def q_publish_dedupe(spark, sf):
    """Duplicate (cv, job) rows in one write batch: the last written value wins."""
    d = dedupe_last(_batch(spark, sf), ["cv_id", "job_id"], "seq", ["similarity"])
    return d.select("cv_id", "job_id", _r("similarity").alias("similarity"))


@register("unique_violations", BATCH_SQL + """
SELECT cv_id, job_id, count(*) AS n FROM batch GROUP BY cv_id, job_id HAVING count(*) > 1""")
def q_unique_violations(spark, sf):
    """(cv, job) pairs written more than once in the batch (unique key report)."""
    return unique_violations(_batch(spark, sf), ["cv_id", "job_id"])


@register("serve_recommendations", with_views(title_topk_cte("old", 20, queries="v_cv")) + """
SELECT cv_id, job_id, similarity, rank, label, status FROM (
  SELECT o.q_id AS cv_id, o.i_id AS job_id, round(o.sim, 6) AS similarity, j.label, j.status,
         CAST(row_number() OVER (PARTITION BY o.q_id ORDER BY o.sim DESC, o.i_id) AS INTEGER) AS rank
  FROM old o JOIN v_job j ON j.job_id = o.i_id) WHERE rank <= 10""")
def q_serve_recommendations(spark, sf):
    """Stored recommendations joined to job details, ORDER BY similarity DESC LIMIT 10 per CV."""
    recs = old_recs(spark, sf).select("cv_id", "job_id", "similarity")
    r = recommendations_with_jobs(recs, job_view(spark, sf), limit=10, job_cols=["label", "status"])
    return r.select("cv_id", "job_id", _r("similarity").alias("similarity"), "rank", "label", "status")


@register("serve_similar_active", with_views(SIMILAR_ALL) + """
SELECT job_id, similar_job_id, similarity, position FROM (
  SELECT s.q_id AS job_id, s.i_id AS similar_job_id, round(s.sim, 6) AS similarity,
         CAST(row_number() OVER (PARTITION BY s.q_id ORDER BY s.sim DESC, s.i_id) AS INTEGER) AS position
  FROM sim s JOIN active_job a ON a.job_id = s.i_id) WHERE position <= 10""")
def q_serve_similar_active(spark, sf):
    """Stored neighbours filtered to active, unexpired jobs at read time, numbered 1..n."""
    edges = stored_similar(spark, sf).select("job_id", "similar_job_id", "similarity")
    r = similar_active(edges, job_view(spark, sf), AS_OF, limit=10)
    return r.select("job_id", "similar_job_id", _r("similarity").alias("similarity"), "position")


@register("similar_count_per_job", with_views(SIMILAR_ALL) + """
SELECT j.job_id, j.label, count(s.i_id) AS similar_count
FROM v_job j JOIN sim s ON s.q_id = j.job_id
WHERE j.status = 'ACTIVE' GROUP BY j.job_id, j.label""")
def q_similar_count(spark, sf):
    """Jobs with status ACTIVE and their stored neighbour count, most first."""
    edges = stored_similar(spark, sf).select("job_id", "similar_job_id")
    return similar_counts(edges, job_view(spark, sf), extra_cols=["label"])


@register("orphan_edges", with_views(SIMILAR_ALL) + """
SELECT q_id AS job_id, i_id AS similar_job_id FROM sim
WHERE i_id NOT IN (SELECT job_id FROM active_job)""")
def q_orphan_edges(spark, sf):
    """Stored edges whose neighbour is no longer an active job (cascade-delete candidates)."""
    edges = stored_similar(spark, sf).select("job_id", "similar_job_id")
    return orphans(edges, active_job_df(spark, sf), "similar_job_id", "job_id")


@register("cascade_delete", with_views(SIMILAR_ALL) + """
SELECT q_id AS job_id, i_id AS similar_job_id FROM sim
WHERE q_id IN (SELECT job_id FROM active_job) AND i_id IN (SELECT job_id FROM active_job)""")
def q_cascade_delete(spark, sf):
    """Stored edges left after deleting the jobs that are no longer active, on either end."""
    edges, jobs = stored_similar(spark, sf).select("job_id", "similar_job_id"), active_job_df(spark, sf)
    return cascade_delete(cascade_delete(edges, jobs, "job_id", "job_id"), jobs, "similar_job_id", "job_id").select(
        "job_id", "similar_job_id")


@register("cascade_graph", with_views(SIMILAR_ALL, title_topk_cte("old", 20, queries="v_cv"), """
gone AS (SELECT j.job_id FROM v_job j, (SELECT count(*) AS n FROM customer) c WHERE (j.job_id % c.n) % 7 = 0)""") + """
SELECT 'companies' AS table_name, count(*) AS n, sum(c_custkey)::BIGINT AS keys FROM customer WHERE c_custkey % 7 <> 0
UNION ALL SELECT 'jobs', count(*), sum(job_id)::BIGINT FROM v_job WHERE job_id NOT IN (FROM gone)
UNION ALL SELECT 'salaries', count(*), sum(job_id)::BIGINT FROM (SELECT o_orderkey AS job_id FROM orders) WHERE job_id NOT IN (FROM gone)
UNION ALL SELECT 'requirements', count(*), sum(conv_id)::BIGINT FROM conversations WHERE conv_id NOT IN (FROM gone)
UNION ALL SELECT 'similar_jobs', count(*), sum(q_id + i_id)::BIGINT FROM sim WHERE q_id NOT IN (FROM gone) AND i_id NOT IN (FROM gone)
UNION ALL SELECT 'recommend_jobs_for_cv', count(*), sum(q_id + i_id)::BIGINT FROM old WHERE i_id NOT IN (FROM gone)""")
def q_cascade_graph(spark, sf):
    """Deleting companies (every seventh) removes their jobs and with them salaries, requirements and the edges of both
    tables, over the graph of foreign keys. Job j belongs to company j % (number of companies)."""
    companies = read_table(spark, sf, "customer", ["c_custkey"])
    jobs = job_view(spark, sf).select("job_id", F.pmod("job_id", F.lit(companies.count())).alias("company_id"))
    tables = {"companies": companies, "jobs": jobs,
              "salaries": read_table(spark, sf, "orders", ["o_orderkey"]).withColumnRenamed("o_orderkey", "job_id"),
              "requirements": read_table(spark, sf, "conversations", ["conv_id", "turn"]),
              "similar_jobs": stored_similar(spark, sf).select("job_id", "similar_job_id"),
              "recommend_jobs_for_cv": old_recs(spark, sf).select("cv_id", "job_id")}
    keys = [ForeignKey("jobs", "company_id", "companies", "c_custkey"), ForeignKey("salaries", "job_id", "jobs", "job_id"),
            ForeignKey("requirements", "conv_id", "jobs", "job_id"), ForeignKey("similar_jobs", "job_id", "jobs", "job_id"),
            ForeignKey("similar_jobs", "similar_job_id", "jobs", "job_id"), ForeignKey("recommend_jobs_for_cv", "job_id", "jobs", "job_id")]
    left = cascade_graph(tables, keys, {"companies": companies.where("c_custkey % 7 = 0")})
    own = {"companies": ["c_custkey"], "jobs": ["job_id"], "salaries": ["job_id"], "requirements": ["conv_id"],
           "similar_jobs": ["job_id", "similar_job_id"], "recommend_jobs_for_cv": ["cv_id", "job_id"]}
    parts = [left[t].agg(F.count(F.lit(1)).alias("n"), F.sum(sum((F.col(c) for c in cols), F.lit(0))).alias("keys")).select(
        F.lit(t).alias("table_name"), "n", "keys") for t, cols in own.items()]
    return reduce(DataFrame.unionByName, parts)


@register("partial_update", with_views() + """
SELECT cv_id, CASE WHEN cv_id % 5 = 0 AND cv_id % 10 <> 0 THEN label + 100 ELSE label END AS label,
       CASE WHEN cv_id % 5 = 0 THEN 'h' || cv_id ELSE NULL END AS content_hash FROM v_cv""")
def q_partial_update(spark, sf):
    """Write-back of some columns by key: a new hash and label for every fifth CV, a null keeps the old value; then empty hashes
    filled from the same rows (which changes nothing)."""
    base = cv_view(spark, sf).select("cv_id", "label", F.lit(None).cast("string").alias("content_hash"))
    updates = base.where("cv_id % 5 = 0").select("cv_id", F.when(F.col("cv_id") % 10 != 0, F.col("label") + 100).alias("label"),
                                                 F.concat(F.lit("h"), "cv_id").alias("content_hash"))
    return fill_null_update(partial_update(base, updates, "cv_id", ["label", "content_hash"]), updates, "cv_id", "content_hash")


@register("unique_key_report", with_views(SIMILAR_ALL) + """
SELECT 'similar_jobs.job_id,similar_job_id' AS key, count(*) AS n FROM
  (SELECT 1 FROM (SELECT * FROM sim UNION ALL SELECT * FROM sim) GROUP BY q_id, i_id HAVING count(*) > 1)
UNION ALL SELECT 'users.email', count(*) FROM (SELECT 1 FROM events GROUP BY user_id HAVING count(*) > 1)
UNION ALL SELECT 'salaries.job_id', count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1)""")
def q_unique_key_report(spark, sf):
    """Violations of the other unique keys: the similar pair (a batch that writes the lists twice),
    the e-mail of users (one per event row) and the job of a salary (one per order line)."""
    sim = stored_similar(spark, sf).select("job_id", "similar_job_id")
    users = read_table(spark, sf, "events", ["user_id"]).select(email_for_user(F.col("user_id").cast("string")).alias("email"))
    salaries = read_table(spark, sf, "lineitem", ["l_orderkey"]).withColumnRenamed("l_orderkey", "job_id")
    return record_counts({
        "similar_jobs.job_id,similar_job_id": unique_violations(sim.unionByName(sim), ["job_id", "similar_job_id"]),
        "users.email": unique_violations(users, ["email"]),
        "salaries.job_id": unique_violations(salaries, ["job_id"])}).withColumnRenamed("table_name", "key")


@register("not_null_violations", with_views() + """
SELECT job_id AS key, 'title_vec' AS "column", CAST(NULL AS VARCHAR) AS value FROM v_job WHERE title_vec IS NULL
UNION ALL SELECT job_id, 'requirement_vec', NULL FROM v_job WHERE requirement_vec IS NULL
UNION ALL SELECT job_id, 'skills_vec', NULL FROM v_job WHERE skills_vec IS NULL""")
def q_not_null_violations(spark, sf):
    """Job vectors that are NULL where a value is required."""
    jobs = job_view(spark, sf).withColumnRenamed("job_id", "key")
    return domain_violations(jobs, "key", {}, not_null=("title_vec", "requirement_vec", "skills_vec"))


@register("record_counts", with_views() + """
SELECT 'cvs' AS table_name, count(*) AS n FROM v_cv
UNION ALL SELECT 'main_cvs', count(*) FROM main_cv
UNION ALL SELECT 'jobs', count(*) FROM v_job
UNION ALL SELECT 'active_jobs', count(*) FROM active_job
UNION ALL SELECT 'conversations', count(DISTINCT conv_id) FROM conversations
UNION ALL SELECT 'turns', count(*) FROM conversations
UNION ALL SELECT 'documents', count(*) FROM documents
UNION ALL SELECT 'events', count(*) FROM events""")
def q_record_counts(spark, sf):
    conv = read_table(spark, sf, "conversations", ["conv_id"])
    return record_counts({
        "cvs": cv_view(spark, sf), "main_cvs": main_cv_df(spark, sf), "jobs": job_view(spark, sf),
        "active_jobs": active_job_df(spark, sf), "conversations": conv.select("conv_id").distinct(),
        "turns": conv, "documents": read_table(spark, sf, "documents", ["doc_id"]),
        "events": read_table(spark, sf, "events", ["event_id"]),
    })


@register("enum_violations", with_views() + f"""
SELECT CAST(job_id AS BIGINT) AS key, 'status' AS "column", status AS value FROM v_job
WHERE status NOT IN ({", ".join(repr(s) for s in ENUMS['Status'])})
UNION ALL
SELECT event_id, 'event_type', event_type FROM events
WHERE event_type NOT IN ({", ".join(repr(s) for s in INTERACTIONS)})""")
def q_enum_violations(spark, sf):
    """Values outside their domain: job status vs Status, event type vs interaction types."""
    jobs = job_view(spark, sf).select(F.col("job_id").alias("key"), "status")
    ev = read_table(spark, sf, "events", ["event_id", "event_type"]).select(
        F.col("event_id").alias("key"), "event_type")
    return domain_violations(jobs, "key", {"status": ENUMS["Status"]}).unionByName(
        domain_violations(ev, "key", {"event_type": INTERACTIONS}))


@register("serve_one_cv", with_views(title_topk_cte("old", 20, queries="v_cv")) + """
SELECT o.i_id AS job_id, round(o.sim, 6) AS similarity, j.label, j.status
FROM old o JOIN v_job j ON j.job_id = o.i_id
WHERE o.q_id = (SELECT min(cv_id) FROM main_cv)
ORDER BY o.sim DESC, o.i_id LIMIT 20""")
def q_serve_one_cv(spark, sf):
    """Point read: the stored list of one CV (the main CV with the smallest id), best first."""
    from matchspark.operators.serve import recommendations_for
    cv_id = main_cv_df(spark, sf).agg(F.min("cv_id")).first()[0]
    recs = old_recs(spark, sf).select("cv_id", "job_id", "similarity")
    r = recommendations_for(recs, job_view(spark, sf), cv_id, limit=20, job_cols=["label", "status"])
    return r.select("job_id", _r("similarity").alias("similarity"), "label", "status")


@register("serve_one_job", with_views(SIMILAR_ALL) + """
SELECT t.job_id AS target_job_id, t.status AS target_status, t.label AS target_label,
       x.similar_job_id, x.similarity, x.position FROM (
  SELECT s.q_id AS job_id, s.i_id AS similar_job_id, round(s.sim, 6) AS similarity,
         CAST(row_number() OVER (ORDER BY s.sim DESC, s.i_id) AS INTEGER) AS position
  FROM sim s JOIN active_job a ON a.job_id = s.i_id
  WHERE s.q_id = (SELECT min(job_id) FROM active_job)
  ORDER BY s.sim DESC, s.i_id LIMIT 10) x
JOIN v_job t ON t.job_id = x.job_id""")
def q_serve_one_job(spark, sf):
    """Point read: header of one job (the active job with the smallest id) and its shown
    neighbours (active, unexpired only), numbered 1..n."""
    from matchspark.operators.serve import similar_for
    job_id = active_job_df(spark, sf).agg(F.min("job_id")).first()[0]
    edges = stored_similar(spark, sf).select("job_id", "similar_job_id", "similarity")
    jobs = job_view(spark, sf)
    lst = similar_for(edges, jobs, job_id, AS_OF, limit=10)
    head = jobs.select(F.col("job_id"), F.col("status").alias("target_status"), F.col("label").alias("target_label"))
    return lst.join(head, "job_id").select(
        F.col("job_id").alias("target_job_id"), "target_status", "target_label", "similar_job_id",
        _r("similarity").alias("similarity"), F.col("position").cast("int").alias("position"))
