"""Ingest rules over inputs derived from the driver tables.

Inputs (same rules in Spark and SQL):
* texts: ``documents.text`` (whole texts).
* skill dictionary: the distinct words of ``part.p_name`` (first appearance order), then the
  distinct ``documents.lang`` codes (2 characters: the whole-word rule applies).
* salary / deadline / enum strings: built from ``orders`` columns by fixed rules.
* companies: every order names its customer's nation as company; existing companies are the
  nations of region 0 (no industry yet).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from matchspark.functions import mappings as M
from matchspark.functions.text import (WS_CLASS, company_email, has_salary_row,
                                       labelled_summary, map_contains_first, map_enum, parse_deadline,
                                       parse_salary, split_items)
from matchspark.operators.dictionary import dictionary_matches
from matchspark.operators.ingest import COMPANY_COLS, children, companies_from_rows, entity_id, first_rows, sample_exact
from matchspark.plans.catalog import register
from matchspark.sources.tables import read_table

def _sql_strip(x: str) -> str:
    return f"regexp_replace(regexp_replace({x}, '^{WS_CLASS}+', ''), '{WS_CLASS}+$', '')"


def _sql_split_items(x: str) -> str:
    return (f"list_filter(list_transform(regexp_split_to_array(coalesce({x}, ''), '[\n;,•\\-●]'), "
            f"lambda s: {_sql_strip('s')}), lambda s: length(s) > 2)")


def _sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


# ---------------------------------------------------------------- split / truncate
@register("split_items", f"""
SELECT doc_id, CAST(pos - 1 AS INTEGER) AS pos, item FROM (
  SELECT doc_id, unnest(items) AS item, unnest(generate_series(1, len(items))) AS pos
  FROM (SELECT doc_id, {_sql_split_items('text')} AS items FROM documents))""")
def q_split_items(spark, sf):
    docs = read_table(spark, sf, "documents", ["doc_id", "text"])
    return docs.select("doc_id", F.posexplode(split_items(F.col("text"))).alias("pos", "item"))


@register("truncate_and_limit_children", f"""
SELECT doc_id, 'requirement' AS kind, CAST(pos - 1 AS INTEGER) AS ord, substr(item, 1, 500) AS text FROM (
  SELECT doc_id, unnest(items[1:10]) AS item, unnest(generate_series(1, len(items[1:10]))) AS pos
  FROM (SELECT doc_id, {_sql_split_items('text')} AS items FROM documents))
UNION ALL
SELECT doc_id, 'skill', CAST(pos - 1 AS INTEGER), substr(item, 1, 100) FROM (
  SELECT doc_id, unnest(items[1:20]) AS item, unnest(generate_series(1, len(items[1:20]))) AS pos
  FROM (SELECT doc_id, {_sql_split_items('text')} AS items FROM documents))""")
def q_truncate_children(spark, sf):
    """First 10 items cut to 500 characters (requirements), first 20 cut to 100 (skills)."""
    docs = read_table(spark, sf, "documents", ["doc_id", "text"])
    items = split_items(F.col("text"))
    req = children(docs, "doc_id", items, 10, 500, "text").withColumn("kind", F.lit("requirement"))
    skl = children(docs, "doc_id", items, 20, 100, "text").withColumn("kind", F.lit("skill"))
    return req.unionByName(skl).select("doc_id", "kind", "ord", "text")


# ---------------------------------------------------------------- skills
def skill_dictionary(spark, sf):
    """Distinct words of part names (first appearance), then language codes (first doc): (skill, pos)."""
    part = read_table(spark, sf, "part", ["p_partkey", "p_name"])
    words = part.select("p_partkey", F.posexplode(F.split("p_name", " ")).alias("i", "skill")).where("skill <> ''")
    docs = read_table(spark, sf, "documents", ["doc_id", "lang"]).where("lang IS NOT NULL AND lang <> ''")
    return words.select("skill", F.struct(F.lit(0).alias("g"), F.col("p_partkey").alias("a"), F.col("i").alias("b")).alias("pos")).unionByName(
        docs.select(F.col("lang").alias("skill"), F.struct(F.lit(1).alias("g"), F.col("doc_id").alias("a"), F.lit(0).alias("b")).alias("pos")))


SKILLS_SQL = f"""
WITH pw AS (
  SELECT w, min(p_partkey * 1000 + pos) AS o FROM (
    SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w,
           unnest(generate_series(1, len(string_split(p_name, ' ')))) AS pos FROM part)
  WHERE w <> '' GROUP BY w),
lw AS (SELECT lang AS w, min(doc_id) AS o FROM documents WHERE lang IS NOT NULL AND lang <> '' GROUP BY lang),
dict AS (
  SELECT w, row_number() OVER (ORDER BY grp, o) AS pos FROM (
    SELECT w, 0 AS grp, o FROM pw
    UNION ALL SELECT w, 1, o FROM lw WHERE w NOT IN (SELECT w FROM pw))),
hits AS (
  SELECT d.doc_id, k.w, k.pos FROM documents d JOIN dict k ON
    CASE WHEN length(k.w) <= 2
         THEN regexp_matches(lower(coalesce(d.text, '')), '(^|[^\\pL\\pN_])' || lower(k.w) || '($|[^\\pL\\pN_])')
         ELSE contains(lower(coalesce(d.text, '')), lower(k.w)) END)
SELECT doc_id, list(w ORDER BY pos) AS skills FROM hits GROUP BY doc_id"""


@register("extract_skills", SKILLS_SQL)
def q_extract_skills(spark, sf):
    """Dictionary skills found in each whole document, in dictionary order."""
    docs = read_table(spark, sf, "documents", ["doc_id", "text"])
    found = dictionary_matches(docs, "doc_id", F.col("text"), skill_dictionary(spark, sf))
    listed = found.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", "skill"))).alias("s"))
    return listed.select("doc_id", F.col("s.skill").alias("skills"))


@register("extract_skills_large", r"""
WITH dict AS (SELECT DISTINCT w FROM (SELECT unnest(string_split(text, ' ')) AS w FROM benchmark) WHERE length(w) >= 9),
hits AS (
  SELECT d.doc_id, k.w FROM documents d JOIN dict k ON contains(lower(coalesce(d.text, '')), lower(k.w)))
SELECT doc_id, count(*) AS n_skills, md5(string_agg(w, ' ' ORDER BY encode(w))) AS skills FROM hits GROUP BY doc_id""")
def q_extract_skills_large(spark, sf):
    """The same matcher with a dictionary of thousands of entries: every word of the benchmark texts of nine characters or more."""
    words = read_table(spark, sf, "benchmark", ["text"]).select(F.explode(F.split("text", " ")).alias("skill")).where(F.length("skill") >= 9)
    docs = read_table(spark, sf, "documents", ["doc_id", "text"])
    found = dictionary_matches(docs, "doc_id", F.col("text"), words.withColumn("pos", F.col("skill")))
    out = found.groupBy("doc_id").agg(F.array_sort(F.collect_list("skill")).alias("s"))
    return out.select("doc_id", F.size("s").cast("long").alias("n_skills"),
                      F.md5(F.array_join("s", " ").cast("binary")).alias("skills"))


# ---------------------------------------------------------------- enum maps
JT_IN = list(M.JOB_TYPE_MAP) + ["", "Remote", "  Part-Time "]
EXP_IN = list(M.EXPERIENCE_LEVEL_MAP) + ["", "xyz", " SENIOR "]
GEN_IN = list(M.GENDER_MAP) + ["", "N/A"]


def _pick(values, idx):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (idx % len(values) + 1).cast("int"))


def _sql_case(raw: str, mapping: dict, default: str | None) -> str:
    d = "NULL" if default is None else f"'{default}'"
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items())
    return (f"CASE WHEN {raw} IS NULL OR {raw} = '' THEN {d} "
            f"ELSE (CASE lower({_sql_strip(raw)}) {whens} ELSE {d} END) END")


@register("map_enum", f"""
SELECT o_orderkey, jt AS job_type_text, {_sql_case('jt', M.JOB_TYPE_MAP, 'FULL_TIME')} AS job_type,
       ex AS experience_text, {_sql_case('ex', M.EXPERIENCE_LEVEL_MAP, None)} AS experience_level,
       ge AS gender_text, {_sql_case('ge', M.GENDER_MAP, None)} AS gender
FROM (SELECT o_orderkey,
             {_sql_list(JT_IN)}[o_orderkey % {len(JT_IN)} + 1] AS jt,
             {_sql_list(EXP_IN)}[o_custkey % {len(EXP_IN)} + 1] AS ex,
             {_sql_list(GEN_IN)}[(o_orderkey + o_custkey) % {len(GEN_IN)} + 1] AS ge
      FROM orders)""")
def q_map_enum(spark, sf):
    o = read_table(spark, sf, "orders", ["o_orderkey", "o_custkey"])
    s = o.select("o_orderkey", _pick(JT_IN, F.col("o_orderkey")).alias("jt"),
                 _pick(EXP_IN, F.col("o_custkey")).alias("ex"),
                 _pick(GEN_IN, F.col("o_orderkey") + F.col("o_custkey")).alias("ge"))
    return s.select(
        "o_orderkey", F.col("jt").alias("job_type_text"),
        map_enum(F.col("jt"), M.JOB_TYPE_MAP, "FULL_TIME").alias("job_type"),
        F.col("ex").alias("experience_text"), map_enum(F.col("ex"), M.EXPERIENCE_LEVEL_MAP).alias("experience_level"),
        F.col("ge").alias("gender_text"), map_enum(F.col("ge"), M.GENDER_MAP).alias("gender"))


def _size_text():
    lo = F.floor(F.abs(F.col("c_acctbal")) / 10).cast("bigint")
    return F.concat(lo.cast("string"), F.lit("-"), (lo * 10 + 9).cast("string"),
                    F.when(F.col("c_custkey") % 2 == 1, F.lit(" nhân viên")).otherwise(F.lit("")))


SIZE_TEXT_SQL = ("CAST(CAST(floor(abs(c_acctbal) / 10) AS BIGINT) AS VARCHAR) || '-' || "
                 "CAST(CAST(floor(abs(c_acctbal) / 10) AS BIGINT) * 10 + 9 AS VARCHAR) || "
                 "CASE WHEN c_custkey % 2 = 1 THEN ' nhân viên' ELSE '' END")


def _sql_size(x: str) -> str:
    whens = " ".join(f"WHEN contains({x}, '{k}') THEN '{v}'" for k, v in M.COMPANY_SIZE_ORDER)
    return f"CASE WHEN {x} IS NULL OR {x} = '' THEN NULL {whens} ELSE NULL END"


@register("map_company_size", f"""
SELECT c_custkey, size_text, {_sql_size('size_text')} AS company_size
FROM (SELECT c_custkey, {SIZE_TEXT_SQL} AS size_text FROM customer)""")
def q_map_company_size(spark, sf):
    c = read_table(spark, sf, "customer", ["c_custkey", "c_acctbal"]).select("c_custkey", _size_text().alias("size_text"))
    return c.select("c_custkey", "size_text", map_contains_first(F.col("size_text"), M.COMPANY_SIZE_ORDER)
                    .alias("company_size"))


# ---------------------------------------------------------------- e-mail, salary, deadline, summary
def _sql_email(x: str) -> str:
    ascii_ = f"regexp_replace(strip_accents({x}), '[^a-zA-Z0-9{WS_CLASS[1:-1]}]', '', 'g')"
    dotted = f"regexp_replace(replace(lower({ascii_}), ' ', '.'), '\\.+', '.', 'g')"
    prefix = f"regexp_replace({dotted}, '^\\.+|\\.+$', '', 'g')"
    return f"CASE WHEN coalesce({prefix}, '') = '' THEN 'company@gmail.com' ELSE {prefix} || '@gmail.com' END"


@register("company_email", f"SELECT doc_id, {_sql_email('text')} AS email FROM documents")
def q_company_email(spark, sf):
    """Whole document text treated as a company name -> generated e-mail address."""
    docs = read_table(spark, sf, "documents", ["doc_id", "text"])
    return docs.select("doc_id", company_email(F.col("text")).alias("email"))


def salary_text():
    lo = F.floor(F.col("o_totalprice")).cast("bigint")
    k = F.col("o_orderkey") % 5
    return (F.when(k == 0, F.concat(F.format_number(lo, 0), F.lit(" - "), F.format_number(lo * 2, 0)))
            .when(k == 1, F.lit("Thỏa thuận"))
            .when(k == 2, F.concat(F.round(F.col("o_totalprice") / 100000, 1).cast("string"), F.lit(" triệu")))
            .when(k == 3, F.lit(""))
            .otherwise((lo * 100000000).cast("string")))


SALARY_TEXT_SQL = """CASE o_orderkey % 5
  WHEN 0 THEN format('{:,}', CAST(floor(o_totalprice) AS BIGINT)) || ' - ' || format('{:,}', CAST(floor(o_totalprice) AS BIGINT) * 2)
  WHEN 1 THEN 'Thỏa thuận'
  WHEN 2 THEN CAST(round(o_totalprice / 100000, 1) AS VARCHAR) || ' triệu'
  WHEN 3 THEN ''
  ELSE CAST(CAST(floor(o_totalprice) AS BIGINT) * 100000000 AS VARCHAR) END"""


@register("parse_salary", f"""
WITH s AS (SELECT o_orderkey, {SALARY_TEXT_SQL} AS salary_text FROM orders),
p AS (SELECT o_orderkey, salary_text,
             (salary_text IS NULL OR lower(salary_text) IN ('thỏa thuận', 'negotiable', '')) AS neg_text,
             regexp_extract_all(regexp_replace(coalesce(salary_text, ''), '[, ]', '', 'g'), '(\\d+)', 1) AS nums
      FROM s),
q AS (SELECT *, TRY_CAST(nums[1] AS DECIMAL(12,2)) AS a, TRY_CAST(nums[2] AS DECIMAL(12,2)) AS b FROM p)
SELECT o_orderkey, salary_text,
       CASE WHEN neg_text OR len(nums) = 0 THEN NULL ELSE a END AS min_amount,
       CASE WHEN neg_text OR len(nums) = 0 THEN NULL WHEN len(nums) = 1 THEN a ELSE b END AS max_amount,
       (neg_text OR len(nums) = 0) AS is_negotiable,
       (NOT neg_text AND ((len(nums) >= 1 AND a IS NULL) OR (len(nums) >= 2 AND b IS NULL))) AS overflow,
       (coalesce(CASE WHEN neg_text OR len(nums) = 0 THEN NULL ELSE a END, 0) <> 0
        OR coalesce(CASE WHEN neg_text OR len(nums) = 0 THEN NULL WHEN len(nums) = 1 THEN a ELSE b END, 0) <> 0
        OR neg_text OR len(nums) = 0) AS has_salary_row
FROM q""")
def q_parse_salary(spark, sf):
    o = read_table(spark, sf, "orders", ["o_orderkey", "o_totalprice"]).select(
        "o_orderkey", salary_text().alias("salary_text"))
    p = o.withColumn("p", parse_salary(F.col("salary_text")))
    return p.select("o_orderkey", "salary_text", "p.min_amount", "p.max_amount", "p.is_negotiable",
                    "p.overflow", has_salary_row(F.col("p")).alias("has_salary_row"))


@register("parse_deadline", """
WITH d AS (SELECT o_orderkey, CASE o_orderkey % 4
             WHEN 0 THEN strftime(o_orderdate, '%d/%m/%Y')
             WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d')
             WHEN 2 THEN strftime(o_orderdate, '%-d/%-m/%Y')
             ELSE strftime(o_orderdate, '%d.%m.%Y') END AS deadline_text FROM orders)
SELECT o_orderkey, deadline_text,
       coalesce(CASE WHEN regexp_full_match(deadline_text, '\\d{1,2}/\\d{1,2}/\\d{4}')
                     THEN try_strptime(deadline_text, '%d/%m/%Y') END,
                CASE WHEN regexp_full_match(deadline_text, '\\d{4}-\\d{1,2}-\\d{1,2}')
                     THEN try_strptime(deadline_text, '%Y-%m-%d') END) AS expires_at
FROM d""")
def q_parse_deadline(spark, sf):
    o = read_table(spark, sf, "orders", ["o_orderkey", "o_orderdate"])
    k = F.col("o_orderkey") % 4
    txt = (F.when(k == 0, F.date_format("o_orderdate", "dd/MM/yyyy"))
           .when(k == 1, F.date_format("o_orderdate", "yyyy-MM-dd"))
           .when(k == 2, F.date_format("o_orderdate", "d/M/yyyy"))
           .otherwise(F.date_format("o_orderdate", "dd.MM.yyyy")))
    d = o.select("o_orderkey", txt.alias("deadline_text"))
    return d.select("o_orderkey", "deadline_text", parse_deadline(F.col("deadline_text")).alias("expires_at"))


@register("cv_summary", f"""
SELECT c_custkey, CASE WHEN s = '' THEN NULL ELSE s END AS summary FROM (
  SELECT c_custkey, concat_ws('. ',
     CASE WHEN ind <> '' THEN '{M.SUMMARY_LABELS[0]}' || ind END,
     CASE WHEN wp <> '' THEN '{M.SUMMARY_LABELS[1]}' || wp END,
     CASE WHEN sal <> '' THEN '{M.SUMMARY_LABELS[2]}' || sal END) AS s
  FROM (SELECT c.c_custkey,
               CASE WHEN c.c_custkey % 7 = 0 THEN '' ELSE c.c_mktsegment END AS ind,
               n.n_name AS wp,
               CASE WHEN c.c_acctbal > 0 THEN CAST(c.c_acctbal AS VARCHAR) ELSE '' END AS sal
        FROM customer c LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey))""")
def q_cv_summary(spark, sf):
    """Labelled optional parts joined by '. ' (industry, workplace, desired salary)."""
    c = read_table(spark, sf, "customer", ["c_custkey", "c_nationkey", "c_mktsegment", "c_acctbal"])
    n = read_table(spark, sf, "nation", ["n_nationkey", "n_name"])
    j = c.join(n, c.c_nationkey == n.n_nationkey, "left").select(
        "c_custkey",
        F.when(F.col("c_custkey") % 7 == 0, F.lit("")).otherwise(F.col("c_mktsegment")).alias("ind"),
        F.col("n_name").alias("wp"),
        F.when(F.col("c_acctbal") > 0, F.col("c_acctbal").cast("string")).otherwise(F.lit("")).alias("sal"))
    return j.select("c_custkey", labelled_summary([(M.SUMMARY_LABELS[0], F.col("ind")),
                                                   (M.SUMMARY_LABELS[1], F.col("wp")),
                                                   (M.SUMMARY_LABELS[2], F.col("sal"))]).alias("summary"))


# ---------------------------------------------------------------- get-or-create company
def company_rows(spark, sf):
    o = read_table(spark, sf, "orders", ["o_orderkey", "o_custkey"])
    c = read_table(spark, sf, "customer", ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"])
    n = read_table(spark, sf, "nation", ["n_nationkey", "n_name", "n_regionkey"])
    r = read_table(spark, sf, "region", ["r_regionkey", "r_name"])
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey) \
        .join(r, n.n_regionkey == r.r_regionkey)
    return j.select(
        F.col("n_name").alias("Name Company"), F.col("r_name").alias("Company Overview"),
        _size_text().alias("Company Size"), F.col("c_name").alias("Company Address"),
        F.when(F.col("c_acctbal") < 0, F.lit("")).otherwise(F.col("c_mktsegment")).alias("Industry"),
        F.col("o_orderkey").alias("_row"))


def existing_companies(spark, sf):
    n = read_table(spark, sf, "nation", ["n_name", "n_regionkey"]).where("n_regionkey = 0")
    return n.select(entity_id("company", "n_name").alias("id"), F.col("n_name").alias("name"),
                    F.lit(None).cast("string").alias("description"), F.lit(None).cast("string").alias("company_size"),
                    F.lit(None).cast("string").alias("address"), F.lit(None).cast("string").alias("industry"),
                    company_email(F.col("n_name")).alias("email"), F.lit("ACTIVE").alias("status"))


COMPANY_SQL = f"""
WITH inc AS (
  SELECT n.n_name AS name, r.r_name AS description,
         CAST(CAST(floor(abs(c.c_acctbal) / 10) AS BIGINT) AS VARCHAR) || '-' ||
         CAST(CAST(floor(abs(c.c_acctbal) / 10) AS BIGINT) * 10 + 9 AS VARCHAR) ||
         CASE WHEN c.c_custkey % 2 = 1 THEN ' nhân viên' ELSE '' END AS size,
         c.c_name AS address, CASE WHEN c.c_acctbal < 0 THEN '' ELSE c.c_mktsegment END AS industry,
         o.o_orderkey AS rn
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey),
firsts AS (
  SELECT name, arg_min(description, rn) AS description, arg_min(size, rn) AS size,
         arg_min(address, rn) AS address,
         arg_min(industry, rn) FILTER (WHERE coalesce(industry, '') <> '') AS industry
  FROM inc WHERE name IS NOT NULL AND name <> '' GROUP BY name),
existing AS (SELECT n_name AS name FROM nation WHERE n_regionkey = 0),
final AS (
  SELECT md5('company:' || e.name) AS id, e.name, NULL AS description, NULL AS company_size, NULL AS address,
         f.industry AS industry, {_sql_email('e.name')} AS email, 'ACTIVE' AS status, FALSE AS created
  FROM existing e LEFT JOIN firsts f ON f.name = e.name
  UNION ALL
  SELECT md5('company:' || f.name), f.name, f.description, {_sql_size('f.size')}, f.address,
         nullif(f.industry, ''), {_sql_email('f.name')}, 'ACTIVE', TRUE
  FROM firsts f WHERE f.name NOT IN (SELECT name FROM existing))
"""


@register("get_or_create_company", COMPANY_SQL + "SELECT * FROM final")
def q_get_or_create_company(spark, sf):
    """Company dimension after one import batch: existing rows kept, new names created."""
    ex = existing_companies(spark, sf)
    out = companies_from_rows(company_rows(spark, sf), ex)
    flags = ex.select("name", F.lit(False).alias("created"))
    return out.join(flags, "name", "left").withColumn("created", F.coalesce("created", F.lit(True))) \
        .select(*COMPANY_COLS, "created")


@register("fill_industry", COMPANY_SQL + "SELECT name, industry FROM final WHERE NOT created")
def q_fill_industry(spark, sf):
    """Existing companies gain the first non-empty industry of the batch (only if empty)."""
    ex = existing_companies(spark, sf)
    out = companies_from_rows(company_rows(spark, sf), ex)
    return out.join(ex.select("name"), "name", "left_semi").select("name", "industry")


@register("sample_exact_n", """
SELECT c_custkey, c_name FROM customer ORDER BY md5('42:' || c_custkey), c_custkey LIMIT 1000""")
def q_sample_exact_n(spark, sf):
    """Exactly min(1000, n) customers, reproducible (seeded md5 order)."""
    c = read_table(spark, sf, "customer", ["c_custkey", "c_name"])
    return sample_exact(c, 1000, 42, "c_custkey")


@register("first_rows_n", """
SELECT c_custkey, c_name FROM customer ORDER BY c_custkey LIMIT 1000""")
def q_first_rows_n(spark, sf):
    """The first min(1000, n) customers in order."""
    return first_rows(read_table(spark, sf, "customer", ["c_custkey", "c_name"]), 1000, "c_custkey")
