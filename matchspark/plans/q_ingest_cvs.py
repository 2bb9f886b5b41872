"""The whole CV ingest (users, CVs, CV skills, work experiences) over CV rows derived from
the driver tables.

CV rows (one per customer, natural key = c_custkey): user name = c_name, user id = c_custkey,
gender / work experience texts = the rules of ``q_ingest``, desired job = market segment and
nation, summary parts = industry (empty for every 7th customer), nation, positive balance,
skills text = "segment, nation, region", experience text = the customer's order priorities
in order. Every row is imported (no sample cap).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from matchspark.functions import mappings as M
from matchspark.functions.text import email_for_user
from matchspark.operators.ingest import cvs_from_rows, write_tables
from matchspark.operators.publish import read_current
from matchspark.operators.quality import record_counts
from matchspark.plans import runs
from matchspark.plans.catalog import register
from matchspark.plans.q_ingest import EXP_IN, GEN_IN, _pick, _sql_list, _sql_split_items, _sql_strip
from matchspark.sources.tables import read_table


def cv_rows(spark, sf):
    c = read_table(spark, sf, "customer", ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"])
    n = read_table(spark, sf, "nation", ["n_nationkey", "n_name", "n_regionkey"])
    r = read_table(spark, sf, "region", ["r_regionkey", "r_name"])
    o = read_table(spark, sf, "orders", ["o_orderkey", "o_custkey", "o_orderpriority"])
    pri = (o.groupBy("o_custkey")
           .agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority"))).alias("ps"))
           .select("o_custkey", F.array_join(F.transform("ps", lambda x: x["o_orderpriority"]), "; ").alias("exp")))
    j = (c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
         .join(pri, c.c_custkey == pri.o_custkey, "left"))
    return j.select(
        F.col("c_name").alias("user_name"), F.col("c_custkey").cast("string").alias("userid"),
        _pick(GEN_IN, F.col("c_custkey")).alias("gender"),
        F.concat_ws(" ", "c_mktsegment", "n_name").alias("desired_job_translated"),
        F.when(F.col("c_custkey") % 7 == 0, F.lit("")).otherwise(F.col("c_mktsegment")).alias("industry"),
        F.col("n_name").alias("workplace_desired"),
        F.when(F.col("c_acctbal") > 0, F.col("c_acctbal").cast("string")).otherwise(F.lit("")).alias("desired_salary"),
        _pick(EXP_IN, F.col("c_custkey")).alias("work_experience"),
        F.concat_ws(", ", "c_mktsegment", "n_name", "r_name").alias("Skills"),
        F.col("exp").alias("Experience"),
        F.col("c_custkey").alias("_row"))


def ingest(spark, sf):
    return cvs_from_rows(cv_rows(spark, sf), limit=None)


ROWS_SQL = f"""pri AS (
  SELECT o_custkey, string_agg(o_orderpriority, '; ' ORDER BY o_orderkey, o_orderpriority) AS exp
  FROM orders GROUP BY o_custkey),
raw AS (
  SELECT c.c_custkey AS rn, c.c_name AS user_name, CAST(c.c_custkey AS VARCHAR) AS userid,
         {_sql_list(GEN_IN)}[c.c_custkey % {len(GEN_IN)} + 1] AS gender,
         c.c_mktsegment || ' ' || n.n_name AS desired_job,
         CASE WHEN c.c_custkey % 7 = 0 THEN '' ELSE c.c_mktsegment END AS industry,
         n.n_name AS workplace,
         CASE WHEN c.c_acctbal > 0 THEN CAST(c.c_acctbal AS VARCHAR) ELSE '' END AS salary,
         {_sql_list(EXP_IN)}[c.c_custkey % {len(EXP_IN)} + 1] AS work_exp,
         c.c_mktsegment || ', ' || n.n_name || ', ' || r.r_name AS skills,
         pri.exp AS experience,
         md5('cv:' || CAST(c.c_custkey AS VARCHAR)) AS cv_id
  FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
  LEFT JOIN pri ON pri.o_custkey = c.c_custkey)"""


@register("ingest_cvs", f"WITH {ROWS_SQL}\n" + f"""
SELECT cv_id, md5('user:' || 'user_' || userid || '@imported.local') AS user_id,
       coalesce(desired_job, '{M.CV_TITLE_PREFIX}' || user_name) AS title, TRUE AS is_main,
       user_name AS full_name,
       coalesce(desired_job, '{M.CV_TITLE_PREFIX}' || user_name) AS current_position,
       nullif(concat_ws('. ',
         CASE WHEN coalesce(industry, '') <> '' THEN '{M.SUMMARY_LABELS[0]}' || industry END,
         CASE WHEN coalesce(workplace, '') <> '' THEN '{M.SUMMARY_LABELS[1]}' || workplace END,
         CASE WHEN coalesce(salary, '') <> '' THEN '{M.SUMMARY_LABELS[2]}' || salary END), '') AS summary,
       TRUE AS is_open_for_job
FROM raw""")
def q_ingest_cvs(spark, sf):
    """CV table of the CV ingest (every customer row imported)."""
    return ingest(spark, sf)["cvs"]


@register("ingest_cv_children", f"WITH {ROWS_SQL}\n" + f"""
SELECT cv_id, 'skill' AS kind, CAST(pos - 1 AS INTEGER) AS ord, item AS text FROM (
  SELECT cv_id, unnest(items) AS item, unnest(generate_series(1, len(items))) AS pos
  FROM (SELECT cv_id, {_sql_split_items('skills')} AS items FROM raw))
UNION ALL
SELECT cv_id, 'experience', CAST(pos - 1 AS INTEGER), item FROM (
  SELECT cv_id, unnest(items) AS item, unnest(generate_series(1, len(items))) AS pos
  FROM (SELECT cv_id,
               CASE WHEN work_exp IS NOT NULL AND {_sql_strip('work_exp')} <> ''
                    THEN list_concat([work_exp], {_sql_split_items('experience')})
                    ELSE {_sql_split_items('experience')} END AS items FROM raw))""")
def q_ingest_cv_children(spark, sf):
    """Skill rows and experience rows (work experience first) of every CV."""
    out = ingest(spark, sf)
    s = out["cv_skills"].select("cv_id", F.lit("skill").alias("kind"), "ord", F.col("skill_name").alias("text"))
    e = out["work_experiences"].select("cv_id", F.lit("experience").alias("kind"), "ord", F.col("title").alias("text"))
    return s.unionByName(e)


@register("ingest_users_existing", f"WITH {ROWS_SQL}\n" + """,
existing AS (SELECT DISTINCT 'user_' || user_id || '@imported.local' AS email FROM events),
incoming AS (SELECT DISTINCT 'user_' || userid || '@imported.local' AS email FROM raw)
SELECT email, md5('known:' || email) AS id, TRUE AS known FROM existing
UNION ALL SELECT email, md5('user:' || email), FALSE FROM incoming WHERE email NOT IN (SELECT email FROM existing)""")
def q_ingest_users_existing(spark, sf):
    """Users after an import into a table that already has the users of the events: these keep their rows and ids."""
    known = read_table(spark, sf, "events", ["user_id"]).distinct().select(
        email_for_user(F.col("user_id").cast("string")).alias("email"))
    known = known.select(F.md5(F.concat(F.lit("known:"), "email").cast("binary")).alias("id"), "email",
                         F.lit("known").alias("full_name"), F.lit(None).cast("string").alias("gender"),
                         F.lit("CANDIDATE").alias("role"), F.lit("ACTIVE").alias("status"))
    users = cvs_from_rows(cv_rows(spark, sf), existing_users=known)["users"]
    return users.select("email", "id", (F.col("full_name") == "known").alias("known"))


@register("ingest_second_import", """
SELECT 'users' AS table_name, count(*) AS n FROM customer
UNION ALL SELECT 'cvs', count(*) FROM customer
UNION ALL SELECT 'cv_skills', 3 * count(*) FROM customer""")
def q_ingest_second_import(spark, sf):
    """Two imports, the second repeating a part of the first: tables grow by what is new and repeat nothing."""
    base, rows = runs.fresh_warehouse(spark) + "/import", cv_rows(spark, sf)
    first = cvs_from_rows(rows.where(F.col("_row") <= 1000))
    write_tables({k: first[k] for k in ("users", "cvs", "cv_skills")}, base)
    again = cvs_from_rows(rows, existing_users=read_current(spark, f"{base}/users"))
    write_tables({k: again[k] for k in ("users", "cvs", "cv_skills")}, base)
    return record_counts({k: read_current(spark, f"{base}/{k}") for k in ("users", "cvs", "cv_skills")})
