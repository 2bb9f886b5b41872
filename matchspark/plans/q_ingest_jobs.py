"""The whole job ingest (companies -> jobs, salaries, requirements, benefits, skills) over job
rows derived from the driver tables.

Job rows (one per order, natural key = o_orderkey):
  company = customer's nation, overview = region, size text / industry = customer rules,
  title = name of the part on the order's first line, description = part types of all lines,
  requirements = part names of all lines joined by "; ", benefits = order priority,
  salary / career level / job type / deadline texts = the rules of ``q_ingest``.
Existing companies = nations of region 0. Skill dictionary = ``q_ingest.skill_dictionary``.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from matchspark.functions import mappings as M
from matchspark.operators.ingest import SOURCE_CAPS, jobs_from_rows
from matchspark.plans.catalog import register
from matchspark.plans.q_ingest import (EXP_IN, JT_IN, SALARY_TEXT_SQL, SIZE_TEXT_SQL, _pick, _size_text, _sql_case,
                                       _sql_list, _sql_split_items, _sql_strip, existing_companies, salary_text,
                                       skill_dictionary)
from matchspark.sources.tables import read_table


def job_rows(spark, sf):
    o = read_table(spark, sf, "orders", ["o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority"])
    c = read_table(spark, sf, "customer", ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"])
    n = read_table(spark, sf, "nation", ["n_nationkey", "n_name", "n_regionkey"])
    r = read_table(spark, sf, "region", ["r_regionkey", "r_name"])
    li = read_table(spark, sf, "lineitem", ["l_orderkey", "l_partkey", "l_linenumber"])
    p = read_table(spark, sf, "part", ["p_partkey", "p_name", "p_type"])
    lines = (li.join(p, li.l_partkey == p.p_partkey)
             .groupBy("l_orderkey")
             .agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "p_name", "p_type"))).alias("lines"))
             .select("l_orderkey",
                     F.element_at("lines", 1)["p_name"].alias("first_name"),
                     F.array_join(F.transform("lines", lambda x: x["p_type"]), " ").alias("descr"),
                     F.array_join(F.transform("lines", lambda x: x["p_name"]), "; ").alias("reqs")))
    k = F.col("o_orderkey") % 4
    deadline = (F.when(k == 0, F.date_format("o_orderdate", "dd/MM/yyyy"))
                .when(k == 1, F.date_format("o_orderdate", "yyyy-MM-dd"))
                .when(k == 2, F.date_format("o_orderdate", "d/M/yyyy"))
                .otherwise(F.date_format("o_orderdate", "dd.MM.yyyy")))
    j = (o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
         .join(r, n.n_regionkey == r.r_regionkey).join(lines, o.o_orderkey == lines.l_orderkey, "left"))
    return j.select(
        F.col("n_name").alias("Name Company"), F.col("r_name").alias("Company Overview"),
        _size_text().alias("Company Size"), F.col("c_name").alias("Company Address"),
        F.when(F.col("c_acctbal") < 0, F.lit("")).otherwise(F.col("c_mktsegment")).alias("Industry"),
        F.col("first_name").alias("Job Title"), F.col("descr").alias("Job Description"),
        F.col("reqs").alias("Job Requirements"), F.col("o_orderpriority").alias("Benefits"),
        salary_text().alias("Salary"), _pick(EXP_IN, F.col("o_custkey")).alias("Career Level"),
        F.lit("").alias("Years of Experience"), _pick(JT_IN, F.col("o_orderkey")).alias("Job Type"),
        deadline.alias("Submission Deadline"), F.col("n_name").alias("Job Address"),
        F.col("o_orderkey").alias("_row"))


def ingest(spark, sf, caps=None, skills=False):
    dictionary = skill_dictionary(spark, sf) if skills else None
    return jobs_from_rows(job_rows(spark, sf), existing_companies(spark, sf), dictionary, caps)


DICT_SQL = """pw AS (
  SELECT w, min(p_partkey * 1000 + pos) AS o FROM (
    SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w,
           unnest(generate_series(1, len(string_split(p_name, ' ')))) AS pos FROM part)
  WHERE w <> '' GROUP BY w),
lw AS (SELECT lang AS w, min(doc_id) AS o FROM documents WHERE lang IS NOT NULL AND lang <> '' GROUP BY lang),
dict AS (
  SELECT w, row_number() OVER (ORDER BY grp, o) AS pos FROM (
    SELECT w, 0 AS grp, o FROM pw
    UNION ALL SELECT w, 1, o FROM lw WHERE w NOT IN (SELECT w FROM pw)))"""

ROWS_SQL = f"""li AS (
  SELECT l.l_orderkey,
         list(p.p_name ORDER BY l.l_linenumber, p.p_name, p.p_type)[1] AS first_name,
         string_agg(p.p_type, ' ' ORDER BY l.l_linenumber, p.p_name, p.p_type) AS descr,
         string_agg(p.p_name, '; ' ORDER BY l.l_linenumber, p.p_name, p.p_type) AS reqs
  FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey GROUP BY l.l_orderkey),
raw AS (
  SELECT o.o_orderkey AS rn, n.n_name AS company, n.n_name AS location,
         CASE WHEN c.c_acctbal < 0 THEN '' ELSE c.c_mktsegment END AS industry,
         li.first_name AS title_raw, li.descr, li.reqs, o.o_orderpriority AS benefits,
         {SALARY_TEXT_SQL.replace('o_orderkey', 'o.o_orderkey').replace('o_totalprice', 'o.o_totalprice')} AS salary_text,
         {_sql_list(EXP_IN)}[o.o_custkey % {len(EXP_IN)} + 1] AS career,
         {_sql_list(JT_IN)}[o.o_orderkey % {len(JT_IN)} + 1] AS jt,
         CASE o.o_orderkey % 4
             WHEN 0 THEN strftime(o.o_orderdate, '%d/%m/%Y')
             WHEN 1 THEN strftime(o.o_orderdate, '%Y-%m-%d')
             WHEN 2 THEN strftime(o.o_orderdate, '%-d/%-m/%Y')
             ELSE strftime(o.o_orderdate, '%d.%m.%Y') END AS dl
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
  LEFT JOIN li ON li.l_orderkey = o.o_orderkey),
p AS (
  SELECT *, (salary_text IS NULL OR lower(salary_text) IN ('thỏa thuận', 'negotiable', '')) AS neg_text,
         regexp_extract_all(regexp_replace(coalesce(salary_text, ''), '[, ]', '', 'g'), '(\\d+)', 1) AS nums
  FROM raw),
q AS (SELECT *, TRY_CAST(nums[1] AS DECIMAL(12,2)) AS a, TRY_CAST(nums[2] AS DECIMAL(12,2)) AS b FROM p),
s AS (
  SELECT *,
         CASE WHEN neg_text OR len(nums) = 0 THEN NULL ELSE a END AS min_amount,
         CASE WHEN neg_text OR len(nums) = 0 THEN NULL WHEN len(nums) = 1 THEN a ELSE b END AS max_amount,
         (neg_text OR len(nums) = 0) AS is_negotiable,
         (NOT neg_text AND ((len(nums) >= 1 AND a IS NULL) OR (len(nums) >= 2 AND b IS NULL))) AS overflow
  FROM q),
good AS (
  SELECT *, md5('job:' || CAST(rn AS VARCHAR)) AS job_id,
         coalesce(nullif({_sql_strip("coalesce(title_raw, '')")}, ''), '{M.UNTITLED}') AS title
  FROM s WHERE NOT overflow)"""


def _deadline_sql(x: str) -> str:
    return (f"coalesce(CASE WHEN regexp_full_match({x}, '\\d{{1,2}}/\\d{{1,2}}/\\d{{4}}') "
            f"THEN try_strptime({x}, '%d/%m/%Y') END, "
            f"CASE WHEN regexp_full_match({x}, '\\d{{4}}-\\d{{1,2}}-\\d{{1,2}}') "
            f"THEN try_strptime({x}, '%Y-%m-%d') END)")


@register("ingest_jobs", f"WITH {ROWS_SQL}\n" + f"""
SELECT job_id, md5('company:' || coalesce(company, '{M.UNKNOWN_COMPANY}')) AS company_id, title,
       coalesce(nullif({_sql_strip("coalesce(descr, '')")}, ''), '{M.DESCRIPTION_PREFIX}' || title) AS description,
       location, industry,
       {_sql_case("CASE WHEN coalesce(career, '') <> '' THEN career ELSE '' END", M.EXPERIENCE_LEVEL_MAP, None)} AS experience_level,
       {_sql_case('jt', M.JOB_TYPE_MAP, 'FULL_TIME')} AS type, 'ACTIVE' AS status, {_deadline_sql('dl')} AS expires_at
FROM good""")
def q_ingest_jobs(spark, sf):
    """Jobs table of the job ingest (rows with an overflowing salary are quarantined)."""
    return ingest(spark, sf)["jobs"]


@register("ingest_salaries", f"WITH {ROWS_SQL}\n" + """
SELECT md5('salary:' || job_id) AS id, job_id, min_amount, max_amount, is_negotiable FROM good
WHERE coalesce(min_amount, 0) <> 0 OR coalesce(max_amount, 0) <> 0 OR is_negotiable""")
def q_ingest_salaries(spark, sf):
    return ingest(spark, sf)["salaries"]


def _children_sql(kind: str, items: str, cap: tuple | None, source: str = "good") -> str:
    some, text = (f"[1:{cap[0]}]", f"substr(item, 1, {cap[1]})") if cap else ("", "item")
    return f"""SELECT job_id, '{kind}' AS kind, CAST(pos - 1 AS INTEGER) AS ord, {text} AS text FROM (
  SELECT job_id, unnest(items{some}) AS item, unnest(generate_series(1, len(items{some}))) AS pos
  FROM (SELECT job_id, {items} AS items FROM {source}))"""


SKILL_LIST = """(SELECT job_id, list(w ORDER BY dpos) AS items FROM (
    SELECT g.job_id, k.w, k.pos AS dpos FROM good g JOIN dict k ON
      CASE WHEN length(k.w) <= 2
           THEN regexp_matches(lower(coalesce(g.reqs, '') || ' ' || coalesce(g.descr, '')),
                               '(^|[^\\pL\\pN_])' || lower(k.w) || '($|[^\\pL\\pN_])')
           ELSE contains(lower(coalesce(g.reqs, '') || ' ' || coalesce(g.descr, '')), lower(k.w)) END)
  GROUP BY job_id)"""


def _all_children_sql(caps: dict) -> str:
    return f"WITH {DICT_SQL},\n{ROWS_SQL}\n" + "\nUNION ALL\n".join([
        _children_sql("requirement", _sql_split_items("reqs"), caps.get("job_requirements")),
        _children_sql("benefit", _sql_split_items("benefits"), caps.get("job_benefits")),
        _children_sql("skill", "items", caps.get("job_skills"), SKILL_LIST)])


def _all_children(spark, sf, caps):
    out = ingest(spark, sf, caps, skills=True)
    req = out["job_requirements"].select("job_id", F.lit("requirement").alias("kind"), "ord",
                                         F.col("title").alias("text"))
    ben = out["job_benefits"].select("job_id", F.lit("benefit").alias("kind"), "ord", F.col("title").alias("text"))
    skl = out["job_skills"].select("job_id", F.lit("skill").alias("kind"), "ord", F.col("skill_name").alias("text"))
    return req.unionByName(ben).unionByName(skl)


@register("ingest_job_children", _all_children_sql({}))
def q_ingest_job_children(spark, sf):
    """Every requirement, benefit and skill row of every ingested job."""
    return _all_children(spark, sf, None)


@register("ingest_job_children_capped", _all_children_sql(SOURCE_CAPS))
def q_ingest_job_children_capped(spark, sf):
    """The same with the caps of the source system (first 10 / 10 / 20 items, 500 / 500 / 100 characters)."""
    return _all_children(spark, sf, SOURCE_CAPS)


@register("ingest_quarantine", f"WITH {ROWS_SQL}\n" + """
SELECT rn AS _row, 'salary does not fit DECIMAL(12,2)' AS reason FROM s WHERE overflow""")
def q_ingest_quarantine(spark, sf):
    """Job rows set aside by the ingest (salary digits too long), with the reason."""
    return ingest(spark, sf)["quarantine"]
