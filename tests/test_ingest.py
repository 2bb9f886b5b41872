"""CSV sources and the ingest step on a small hand-made file set."""

import csv

from pyspark.sql import functions as F

from matchspark.operators.ingest import NO_CAP, companies_from_rows, cvs_from_rows, jobs_from_rows, sample_exact
from matchspark.sources.csv_files import read_companies, read_cvs, read_jobs
from matchspark.sources.tables import jdbc_options_from_url


def _write(path, header, rows):
    with open(path, "w", newline="", encoding="utf-8") as f:
        w = csv.writer(f)
        w.writerow(header)
        w.writerows(rows)


def test_companies_and_jobs(spark, tmp_path):
    cp = tmp_path / "companies.csv"
    _write(cp, ["Name Company", "Company Overview", "Company Size", "Company Address", "Industry"], [
        ["Công ty Điện Lạnh", "multi\nline", "25-99 nhân viên", "HN", ""],
        ["  ACME  ", "x", "1000+", "HCM", "IT"],
        ["Công ty Điện Lạnh", "dup", "1-9", "HN", "Điện"],
        ["   ", "blank", "", "", ""],
    ])
    comps = companies_from_rows(read_companies(spark, str(cp)))
    rows = {r["name"]: r for r in comps.collect()}
    assert set(rows) == {"Công ty Điện Lạnh", "ACME"}
    assert rows["Công ty Điện Lạnh"]["description"] == "multi\nline"      # first row wins
    assert rows["Công ty Điện Lạnh"]["industry"] == "Điện"                # first non-empty industry
    assert rows["Công ty Điện Lạnh"]["company_size"] == "SMALL"
    assert rows["ACME"]["email"] == "acme@gmail.com"

    jp = tmp_path / "jobs.csv"
    _write(jp, ["Name Company", "Job Title", "Job Description", "Job Requirements", "Benefits", "Salary",
                "Career Level", "Years of Experience", "Job Type", "Submission Deadline"], [
        ["ACME", "Senior Python Developer", "Build APIs", "Python; SQL\n- 3 năm • Git", "Thưởng, Bảo hiểm",
         "10,000,000 - 15,000,000", "", "3-5 năm", "Toàn thời gian", "31/12/2025"],
        ["New Co", "", "", "", "", "99999999999999", "Senior", "", "freelance", "soon"],
        ["New Co", "", "", "", "", "0", "xyz", "", "", "2025-12-31"],
    ])
    out = jobs_from_rows(read_jobs(spark, str(jp)), comps, ["Python", "SQL", "Git", "API", "Go"])
    jobs = out["jobs"].orderBy("title").collect()
    assert len(jobs) == 2 and out["quarantine"].count() == 1      # digit run too long -> quarantined
    j = [r for r in jobs if r["title"] == "Senior Python Developer"][0]
    assert (j["experience_level"], j["type"]) == ("MIDDLE", "FULL_TIME")
    u = [r for r in jobs if r["title"] == "Untitled"][0]
    assert u["description"] == "Mô tả công việc: Untitled" and u["experience_level"] is None
    reqs = [r["title"] for r in out["job_requirements"].orderBy("ord").collect()]
    assert reqs == ["Python", "SQL", "3 năm", "Git"]
    skills = [r["skill_name"] for r in out["job_skills"].orderBy("ord").collect()]
    assert skills == ["Python", "SQL", "Git", "API"]
    assert out["salaries"].count() == 1                           # "0" gives no salary row
    names = {r["name"] for r in out["companies"].collect()}
    assert names == {"Công ty Điện Lạnh", "ACME", "New Co"}       # created on the fly


def test_cvs(spark, tmp_path):
    p = tmp_path / "cvs.csv"
    _write(p, ["user_name", "userid", "gender", "desired_job_translated", "industry", "workplace_desired",
               "desired_salary", "work_experience", "Skills", "Experience"], [
        ["An", "17", "Nữ", "Data Engineer", "IT", "", "20tr", "1-3 năm", "Python, SQL, R", "A; B long; C item"],
        ["Binh", "17", "Nam", "x" * 300, "", "", "", "  ", "", ""],
    ])
    out = cvs_from_rows(read_cvs(spark, str(p)), limit=None)
    assert out["users"].count() == 1                              # same e-mail -> one user
    cvs = {r["full_name"]: r for r in out["cvs"].collect()}
    assert cvs["An"]["summary"] == "Ngành: IT. Mức lương mong muốn: 20tr"
    assert cvs["Binh"]["summary"] is None and len(cvs["Binh"]["title"]) == 300
    skills = [r["skill_name"] for r in out["cv_skills"].orderBy("ord").collect()]
    assert skills == ["Python", "SQL"]                            # "R" dropped (2 characters or fewer)
    exps = [r["title"] for r in out["work_experiences"].orderBy("ord").collect()]
    assert exps == ["1-3 năm", "B long", "C item"]                # work_experience first


def test_cv_title_uncut(spark, tmp_path):
    p = tmp_path / "cvs.csv"
    _write(p, ["user_name", "userid", "gender", "desired_job_translated", "industry", "workplace_desired",
               "desired_salary", "work_experience", "Skills", "Experience"],
           [["Binh", "17", "Nam", "x" * 300, "", "", "", "", "", ""]])
    for caps, n in (({"cv_title": NO_CAP}, 300), ({"cv_title": (1, 20)}, 20)):
        cv = cvs_from_rows(read_cvs(spark, str(p)), caps=caps)["cvs"].first()
        assert cv["title"] == cv["current_position"] == "x" * n


def test_sample_exact_n(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    a = sample_exact(df, 37, 7, "k")
    assert a.count() == 37
    assert sorted(r["k"] for r in a.collect()) == sorted(r["k"] for r in sample_exact(df.repartition(5), 37, 7, "k").collect())
    assert sample_exact(df, 5000, 7, "k").count() == 1000


def test_jdbc_url_translation():
    o = jdbc_options_from_url("postgresql://u:p@db:5432/jobs?schema=public")
    assert o["url"] == "jdbc:postgresql://db:5432/jobs" and o["user"] == "u" and o["currentSchema"] == "public"


def test_missing_column_reads_as_null(spark, tmp_path):
    p = tmp_path / "c.csv"
    _write(p, ["Name Company"], [["X"]])
    df = read_companies(spark, str(p))
    assert df.select(F.col("Industry").isNull().alias("n")).first()["n"]


def test_csv_rows_keys_and_corrupt_records(spark, tmp_path):
    """Ordinals count within each file, empty fields are alike however written, broken records are quarantined."""
    header = "Name Company,Job Title,Salary\n"
    (tmp_path / "a.csv").write_text(header + "ACME,One,0\n,Two,0\n\"\",Three,0\n", encoding="utf-8")
    (tmp_path / "b.csv").write_text(header + "ACME,One,0\nACME,too,many,fields\n", encoding="utf-8")
    rows = read_jobs(spark, str(tmp_path / "*.csv"))
    assert sorted(r["_row"]["line"] for r in rows.collect()) == [0, 0, 1, 1, 2]
    none = companies_from_rows(read_companies(spark, str(tmp_path / "a.csv")).limit(0))
    out = jobs_from_rows(rows, none, [])
    jobs = out["jobs"].collect()
    assert len(jobs) == 4 and len({j["job_id"] for j in jobs}) == 4 and all(j["company_id"] for j in jobs)
    assert {c["name"] for c in out["companies"].collect()} == {"ACME", "Unknown Company"}
    bad = out["quarantine"].collect()
    assert [(r["_row"]["line"], r["reason"]) for r in bad] == [(1, "fields do not match the header")]


def test_ingest_all_and_second_import(spark, tmp_path):
    from matchspark.operators.ingest import ingest_all, write_tables
    from matchspark.operators.publish import read_current
    cv = "user_name,userid,gender,Skills,Experience,work_experience\n"
    (tmp_path / "cv1.csv").write_text(cv + "An,1,,Python,A long one,\nBinh,2,,Java,,\n", encoding="utf-8")
    (tmp_path / "co.csv").write_text("Name Company,Industry\nACME,IT\nbroken,too,many\n", encoding="utf-8")
    base = str(tmp_path / "tables")
    first = ingest_all(spark, str(tmp_path / "co.csv"), None, str(tmp_path / "cv1.csv"), [])
    write_tables(first, base)
    assert read_current(spark, base + "/users").count() == 2 and read_current(spark, base + "/quarantine").count() == 1
    (tmp_path / "cv2.csv").write_text(cv + "An again,1,,SQL,,\nChi,3,,Go lang,,\n", encoding="utf-8")
    more = ingest_all(spark, None, None, str(tmp_path / "cv2.csv"), [], existing_users=read_current(spark, base + "/users"))
    write_tables(more, base)
    users = {r["email"]: r["full_name"] for r in read_current(spark, base + "/users").collect()}
    assert sorted(users.values()) == ["An", "Binh", "Chi"]          # the user keeps its first row
    assert read_current(spark, base + "/cvs").count() == 4
    cvs = read_current(spark, base + "/cvs").collect()
    assert len({c["user_id"] for c in cvs}) == 3
    write_tables(more, base)                                        # the same import once more changes nothing
    assert read_current(spark, base + "/cvs").count() == 4


def test_every_csv_file_is_read_by_its_own_header(spark, tmp_path):
    """Other order, a missing and an additional column, a quoted name over two lines: values stay with their names."""
    from matchspark.sources.csv_files import read_companies
    folder = tmp_path / "companies"
    folder.mkdir()
    (folder / "a.csv").write_text("Name Company,Company Overview,Company Size,Company Address,Industry\nA,about,10-24,addr,IT\n")
    (folder / "b.csv").write_text("Industry,Name Company,Company Address,Company Size,Company Overview\nHR,B,addr2,25-99,\"two\nlines\"\n")
    (folder / "c.csv").write_text('Name Company,"more\n, lines",Industry\nC,x,Law\nD,y\n')
    (folder / "d.csv").write_text("")
    rows = {r["Name Company"]: r for r in read_companies(spark, str(folder)).collect()}
    assert set(rows) == {"A", "B", "C", "D"}
    assert (rows["B"]["Industry"], rows["B"]["Company Overview"], rows["B"]["Company Size"], rows["B"]["Company Address"]) == ("HR", "two\nlines", "25-99", "addr2")
    assert rows["C"]["Industry"] == "Law" and rows["C"]["Company Size"] is None and rows["A"]["Industry"] == "IT"
    assert rows["D"]["_corrupt"] is not None and all(rows[k]["_corrupt"] is None for k in "ABC")
    assert rows["D"]["_row"]["line"] == 1 and rows["B"]["_key"].endswith("b.csv#0")


def test_no_csv_file_with_a_header(spark, tmp_path):
    from matchspark.sources.csv_files import read_cvs
    (tmp_path / "e.csv").write_text("")
    df = read_cvs(spark, str(tmp_path / "e.csv"))
    assert df.count() == 0 and "_key" in df.columns and "Skills" in df.columns
