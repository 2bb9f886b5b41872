"""Ingest: raw company / job / CV rows -> normalised entity tables.

Every rule is a column expression; child tables come from ``posexplode`` of the item arrays. Item counts and
widths (a CV's title included) are cut only if the caller passes ``caps`` (``SOURCE_CAPS`` are those of the source system). Dimension lookups
(get-or-create) are set operations: dedupe the incoming keys (first row wins, by the row
ordinal taken at the scan), ``left_anti`` against the existing table, union, then an equi-join
gives the fact rows their key. A row that breaks a rule goes to a quarantine table with a
reason; the other rows are unaffected.

Ids are derived from natural keys (``md5('<table>:<key>')``), so a re-run produces the same
ids and the same output.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchspark.functions import mappings as M
from matchspark.functions.text import (company_email, email_for_user, has_salary_row,
                                       labelled_summary, map_contains_first, map_enum, parse_deadline,
                                       parse_salary, py_strip, split_items, truncate)
from matchspark.operators.dictionary import dictionary_matches


def entity_id(table: str, *keys) -> Column:
    return F.md5(F.concat_ws(":", F.lit(table), *[F.col(k) if isinstance(k, str) else k for k in keys]))


def row_key(rows: DataFrame) -> str:
    """The column that names a row for ids: ``_key`` of a CSV scan, else ``_row``."""
    return "_key" if "_key" in rows.columns else "_row"


def split_corrupt(rows: DataFrame, reason: str = "fields do not match the header") -> tuple[DataFrame, DataFrame]:
    """(good rows, quarantine): rows whose record could not be read go to the quarantine (_row, reason)."""
    if "_corrupt" not in rows.columns:
        return rows, rows.where(F.lit(False)).select("_row", F.lit(reason).alias("reason"))
    bad = F.col("_corrupt").isNotNull()
    return rows.where(~bad).drop("_corrupt"), rows.where(bad).select("_row", F.lit(reason).alias("reason"))


def _col(name: str) -> Column:
    return F.col(f"`{name}`")


def _blank(c: Column) -> Column:
    return c.isNull() | (py_strip(c) == "")


# ---------------------------------------------------------------- dimensions
def dedupe_first(df: DataFrame, key: str, order: str, cols: list[str],
                 first_nonempty: list[str] = ()) -> DataFrame:
    """One row per key: values of the first row by ``order``; ``first_nonempty`` columns take
    the first non-empty value instead. Partial aggregation runs before the shuffle."""
    aggs = [F.min_by(F.struct(*[F.col(c) for c in cols]), F.col(order)).alias("_first"),
            F.min(order).alias(order)]
    for c in first_nonempty:
        aggs.append(F.min_by(F.col(c), F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(order)))
                    .alias(f"_ne_{c}"))
    out = df.groupBy(key).agg(*aggs).select(key, order, "_first.*", *[f"_ne_{c}" for c in first_nonempty])
    for c in first_nonempty:
        out = out.withColumn(c, F.col(f"_ne_{c}")).drop(f"_ne_{c}")
    return out


def get_or_create(existing: DataFrame, incoming: DataFrame, key: str, make: callable,
                  fill_if_empty: list[str] = ()) -> DataFrame:
    """Existing rows (with empty ``fill_if_empty`` columns filled from incoming) + new rows.

    ``incoming`` must already be one row per key; ``make`` turns it into full table rows.
    """
    new = make(incoming.join(existing.select(key), key, "left_anti"))
    if fill_if_empty:
        inc = incoming.select(key, *[F.col(c).alias(f"_in_{c}") for c in fill_if_empty])
        upd = existing.join(inc, key, "left")
        for c in fill_if_empty:
            upd = upd.withColumn(c, F.when(F.coalesce(F.col(c), F.lit("")) == "", F.col(f"_in_{c}"))
                                 .otherwise(F.col(c)))
        existing = upd.select(*existing.columns)
    return existing.unionByName(new.select(*existing.columns))


COMPANY_COLS = ["id", "name", "description", "company_size", "address", "industry", "email", "status"]


def _make_companies(inc: DataFrame) -> DataFrame:
    return inc.select(
        entity_id("company", "name").alias("id"), "name", F.col("description"),
        map_contains_first(F.col("size"), M.COMPANY_SIZE_ORDER).alias("company_size"),
        F.col("address"), F.nullif(F.col("industry"), F.lit("")).alias("industry"),
        company_email(F.col("name")).alias("email"), F.lit("ACTIVE").alias("status"))


def companies_from_rows(rows: DataFrame, existing: DataFrame | None = None, strip_name: bool = True) -> DataFrame:
    """Company dimension from raw rows: blank names dropped, first row wins per name, industry
    = first non-empty; existing companies keep their row and only gain a missing industry."""
    rows, _ = split_corrupt(rows)
    name = py_strip(_col("Name Company")) if strip_name else _col("Name Company")
    inc = rows.select(
        name.alias("name"), _col("Company Overview").alias("description"),
        _col("Company Size").alias("size"), _col("Company Address").alias("address"),
        _col("Industry").alias("industry"), F.col("_row"),
    ).where(F.col("name").isNotNull() & (F.col("name") != ""))
    inc = dedupe_first(inc, "name", "_row", ["description", "size", "address"], first_nonempty=["industry"])
    if existing is None:
        existing = rows.sparkSession.createDataFrame([], _make_companies(inc).schema)
    return get_or_create(existing.select(*COMPANY_COLS), inc, "name", _make_companies, ["industry"])


# Item count and text width of each child list in the source system, and the width of a CV's title (one value).
SOURCE_CAPS: dict[str, tuple[int, int]] = {
    "job_requirements": (10, 500), "job_benefits": (10, 500), "job_skills": (20, 100),
    "cv_skills": (20, 100), "work_experiences": (10, 255), "cv_title": (1, 255),
}
NO_CAP = (None, None)


# ---------------------------------------------------------------- jobs
def jobs_from_rows(rows: DataFrame, companies: DataFrame, skills_dictionary: list[str] | DataFrame | None,
                   caps: dict[str, tuple[int, int]] | None = None) -> dict[str, DataFrame]:
    """Job rows -> jobs, salaries, job_requirements, job_benefits, job_skills, companies, quarantine.
    A blank company name is the unknown company, however it was written. Without a dictionary there is no job_skills table."""
    rows, corrupt = split_corrupt(rows)
    company = F.when(_blank(_col("Name Company")), F.lit(M.UNKNOWN_COMPANY)).otherwise(_col("Name Company"))
    r = rows.withColumn("job_id", entity_id("job", row_key(rows))).withColumn("company_name", company) \
        .withColumn("_sal", parse_salary(_col("Salary")))
    bad = F.col("_sal.overflow")
    quarantine = r.where(bad).select("_row", F.lit("salary does not fit DECIMAL(12,2)").alias("reason")).unionByName(corrupt)
    good = r.where(~bad)

    comp_rows = good.select(F.col("company_name").alias("Name Company"), "Company Overview", "Company Size",
                            "Company Address", "Industry", "_row")
    companies = companies_from_rows(comp_rows, companies, strip_name=False)

    title = F.coalesce(F.nullif(py_strip(F.coalesce(_col("Job Title"), F.lit(""))), F.lit("")), F.lit(M.UNTITLED))
    career = F.when(F.coalesce(_col("Career Level"), F.lit("")) != "", _col("Career Level")) \
        .otherwise(_col("Years of Experience"))
    jobs0 = good.select(
        "job_id", "_row", "company_name", title.alias("title"),
        _col("Job Description").alias("raw_description"), _col("Job Requirements").alias("raw_requirements"),
        _col("Benefits").alias("raw_benefits"), _col("Job Address").alias("location"),
        _col("Industry").alias("industry"),
        map_enum(career, M.EXPERIENCE_LEVEL_MAP).alias("experience_level"),
        map_enum(_col("Job Type"), M.JOB_TYPE_MAP, "FULL_TIME").alias("type"),
        parse_deadline(_col("Submission Deadline")).alias("expires_at"), "_sal")
    desc = F.coalesce(F.nullif(py_strip(F.coalesce(F.col("raw_description"), F.lit(""))), F.lit("")),
                      F.concat(F.lit(M.DESCRIPTION_PREFIX), F.col("title")))
    jobs = jobs0.join(companies.select(F.col("name").alias("company_name"), F.col("id").alias("company_id")),
                      "company_name", "left")
    jobs_out = jobs.select("job_id", "company_id", "title", desc.alias("description"), "location", "industry",
                           "experience_level", "type", F.lit("ACTIVE").alias("status"), "expires_at")
    salaries = jobs0.where(has_salary_row(F.col("_sal"))).select(
        entity_id("salary", "job_id").alias("id"), "job_id", "_sal.min_amount", "_sal.max_amount",
        "_sal.is_negotiable")
    caps = caps or {}
    reqs = children(jobs0, "job_id", split_items(F.col("raw_requirements")), *caps.get("job_requirements", NO_CAP), "title")
    bens = children(jobs0, "job_id", split_items(F.col("raw_benefits")), *caps.get("job_benefits", NO_CAP), "title")
    combined = F.concat(F.coalesce(F.col("raw_requirements"), F.lit("")), F.lit(" "),
                        F.coalesce(F.col("raw_description"), F.lit("")))
    out = {"jobs": jobs_out, "salaries": salaries, "job_requirements": reqs, "job_benefits": bens,
           "companies": companies, "quarantine": quarantine}
    if skills_dictionary is not None:
        out["job_skills"] = job_skills(jobs0, combined, skills_dictionary, *caps.get("job_skills", NO_CAP))
    return out


def job_skills(jobs: DataFrame, text: Column, dictionary: list[str] | DataFrame, limit: int | None = None,
               width: int | None = None) -> DataFrame:
    """job_id, ord, skill_name, level: the entries found in each text, in dictionary order."""
    if not isinstance(dictionary, DataFrame):
        listed = [(s, i) for i, s in enumerate(dictionary)]
        dictionary = jobs.sparkSession.createDataFrame(listed, "skill string, pos int")
    found = dictionary_matches(jobs, "job_id", text, dictionary)
    place = F.row_number().over(Window.partitionBy("job_id").orderBy("pos", "skill")) - 1
    rows = found.select("job_id", place.alias("ord"), "skill")
    rows = rows if limit is None else rows.where(F.col("ord") < limit)
    name = F.col("skill") if width is None else truncate(F.col("skill"), width)
    return rows.select("job_id", "ord", name.alias("skill_name"), F.lit("INTERMEDIATE").alias("level"))


def children(parents: DataFrame, key: str, items: Column, limit: int | None, width: int | None, name: str) -> DataFrame:
    """The items of an array as child rows (ord, text); the first ``limit`` only and cut to ``width`` characters if given."""
    rows = parents.select(key, F.posexplode(items if limit is None else F.slice(items, 1, limit)).alias("ord", "_v"))
    return rows.select(key, "ord", (F.col("_v") if width is None else truncate(F.col("_v"), width)).alias(name))


# ---------------------------------------------------------------- CVs
def sample_exact(df: DataFrame, n: int, seed: int, key: str) -> DataFrame:
    """Exactly ``min(n, count)`` rows, reproducible: the n smallest ``md5('<seed>:<key>')``.

    Planned as a top-n (``TakeOrderedAndProject``): each partition keeps n candidates.
    """
    return df.orderBy(F.md5(F.concat_ws(":", F.lit(seed), F.col(key)).cast("binary")), F.col(key)).limit(n)


def first_rows(df: DataFrame, n: int, order: str = "_row") -> DataFrame:
    return df.orderBy(order).limit(n)


def cvs_from_rows(rows: DataFrame, limit: int | None = None, random_sample: bool = True,
                  seed: int = 42, caps: dict[str, tuple[int, int]] | None = None,
                  existing_users: DataFrame | None = None) -> dict[str, DataFrame]:
    """CV rows -> users, cvs, cv_skills, work_experiences, quarantine (a sample of ``limit`` rows only if asked for).

    ``existing_users`` (id, email, ...): a user that is there already keeps its row and id; ``users`` holds the
    existing and the new ones, one per e-mail."""
    caps = caps or {}
    rows, corrupt = split_corrupt(rows)
    key = row_key(rows)
    if limit:
        rows = sample_exact(rows, limit, seed, key) if random_sample else first_rows(rows, limit)
    r = rows.withColumn("cv_id", entity_id("cv", key)).withColumn(
        "userid", F.coalesce(F.col("userid"), entity_id("user-row", key))).withColumn(
        "user_name", F.coalesce(F.col("user_name"), F.lit("Unknown")))
    r = r.withColumn("email", email_for_user(F.col("userid")))
    users = dedupe_first(r.select("email", "user_name", "gender", "_row"), "email", "_row",
                         ["user_name", "gender"]).select(
        entity_id("user", "email").alias("id"), "email", F.col("user_name").alias("full_name"),
        map_enum(F.col("gender"), M.GENDER_MAP).alias("gender"),
        F.lit("CANDIDATE").alias("role"), F.lit("ACTIVE").alias("status"))
    user_id = entity_id("user", "email")
    if existing_users is not None:
        known = existing_users.select(*users.columns)
        users = known.unionByName(users.join(known.select("email"), "email", "left_anti"))
        r = r.join(known.select("email", F.col("id").alias("_known_id")), "email", "left")
        user_id = F.coalesce(F.col("_known_id"), user_id)
    cv_title = F.coalesce(F.col("desired_job_translated"), F.concat(F.lit(M.CV_TITLE_PREFIX), F.col("user_name")))
    summary = labelled_summary([(M.SUMMARY_LABELS[0], F.col("industry")),
                                (M.SUMMARY_LABELS[1], F.col("workplace_desired")),
                                (M.SUMMARY_LABELS[2], F.col("desired_salary"))])
    width = caps.get("cv_title", NO_CAP)[1]
    if width is not None:
        cv_title = truncate(cv_title, width)
    cvs = r.select("cv_id", user_id.alias("user_id"), cv_title.alias("title"),
                   F.lit(True).alias("is_main"), F.col("user_name").alias("full_name"),
                   cv_title.alias("current_position"), summary.alias("summary"),
                   F.lit(True).alias("is_open_for_job"))
    skills = children(r, "cv_id", split_items(F.col("Skills")), *caps.get("cv_skills", NO_CAP), "skill_name") \
        .withColumn("level", F.lit("INTERMEDIATE"))
    exp_items = F.when(~_blank(F.col("work_experience")),
                       F.concat(F.array(F.col("work_experience")), split_items(F.col("Experience")))) \
        .otherwise(split_items(F.col("Experience")))
    exps = children(r, "cv_id", exp_items, *caps.get("work_experiences", NO_CAP), "title").withColumn("company", F.lit(""))
    return {"users": users, "cvs": cvs, "cv_skills": skills, "work_experiences": exps, "quarantine": corrupt}


def ingest_all(spark, companies_csv: str | None, jobs_csv: str | None, cvs_csv: str | None,
               skills_dictionary: list[str] | DataFrame, cv_limit: int | None = None, seed: int = 42,
               partitions: int | None = None, caps: dict[str, tuple[int, int]] | None = None,
               existing_users: DataFrame | None = None) -> dict[str, DataFrame]:
    """Companies, then jobs (which may add companies), then CVs; returns every output table."""
    from matchspark.sources.csv_files import read_companies, read_cvs, read_jobs

    out: dict[str, DataFrame] = {}
    companies, quarantine = None, []
    if companies_csv:
        rows = read_companies(spark, companies_csv, partitions)
        companies = companies_from_rows(rows)
        quarantine.append(split_corrupt(rows)[1])
    if jobs_csv:
        if companies is None:
            companies = spark.createDataFrame([], "id string, name string, description string, company_size string, "
                                                  "address string, industry string, email string, status string")
        out.update(jobs_from_rows(read_jobs(spark, jobs_csv, partitions), companies, skills_dictionary, caps))
        companies = out["companies"]
        quarantine.append(out["quarantine"])
    if cvs_csv:
        out.update(cvs_from_rows(read_cvs(spark, cvs_csv, partitions), limit=cv_limit, seed=seed, caps=caps,
                                 existing_users=existing_users))
        quarantine.append(out["quarantine"])
    if companies is not None:
        out["companies"] = companies
    if quarantine:
        out["quarantine"] = reduce(DataFrame.unionByName, quarantine)
    return out


#: what names a row of each output table
TABLE_KEYS = {"companies": "id", "jobs": "job_id", "salaries": "job_id", "job_requirements": "job_id", "job_benefits": "job_id",
              "job_skills": "job_id", "users": "id", "cvs": "cv_id", "cv_skills": "cv_id", "work_experiences": "cv_id"}


def write_tables(tables: dict[str, DataFrame], base: str) -> None:
    """Bring an import into the tables under ``base``: rows of a key that was imported before are replaced, all others
    stay. Each table gets a new version in one step (see ``publish``); the quarantine is appended."""
    import os

    from matchspark.operators.publish import append_rows, publish_edges
    for name, df in tables.items():
        path = os.path.join(base, name)
        if name in TABLE_KEYS:
            publish_edges(df.sparkSession, path, df, TABLE_KEYS[name])
        else:
            append_rows(df, path)
