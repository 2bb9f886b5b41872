"""Ingest text rules on hand-made rows (expected values worked out from the rules by hand)."""

import datetime as dt
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from matchspark.functions import mappings as M
from matchspark.functions.text import (company_email, extract_skills, has_salary_row, is_blank,
                                       labelled_summary, map_contains_first, map_enum, parse_deadline,
                                       parse_salary, py_strip, split_items)


def _col(spark, values, expr, typ="string"):
    df = spark.createDataFrame([(v,) for v in values], f"v {typ}")
    return [r["x"] for r in df.select(expr(F.col("v")).alias("x")).collect()]


def test_split_items(spark):
    got = _col(spark, ["Python; SQL\n- 3 năm • Git", "", None, "  ", "ab, abc ,x-y-zzz"], split_items)
    assert got[0] == ["Python", "SQL", "3 năm", "Git"]
    assert got[1] == [] and got[2] == [] and got[3] == []
    assert got[4] == ["abc", "zzz"]


def test_split_items_keeps_three_char_items_only_above_two(spark):
    assert _col(spark, ["R, Go, SQL, C++"], split_items)[0] == ["SQL", "C++"]


def test_py_strip_unicode_whitespace(spark):
    assert _col(spark, ["  x \t\n", " y　"], py_strip) == ["x", "y"]
    assert _col(spark, [" ", None, "a"], is_blank) == [True, True, False]


def test_extract_skills_rules(spark):
    d = ["Java", "JavaScript", "R", "C#", "Go", "API", "SQL", "Java"]
    got = _col(spark, ["I write JavaScript and R code", "C# dev; go-lang; capital", "c#x"],
               lambda c: extract_skills(c, d))
    assert got[0] == ["Java", "JavaScript", "R"]   # substring rule: Java inside JavaScript
    assert got[1] == ["Go", "API"]                  # "c#" needs a word char after '#'; "api" in "capital"
    assert got[2] == ["C#"]


def test_extract_skills_word_boundary_unicode(spark):
    assert _col(spark, ["ágo", "go!", "(go)"], lambda c: extract_skills(c, ["Go"])) == [[], ["Go"], ["Go"]]


def test_extract_skills_limit(spark):
    d = [f"sk{i:02d}" for i in range(30)]
    text = " ".join(d)
    assert _col(spark, [text], lambda c: extract_skills(c, d, limit=20))[0] == d[:20]


def test_map_enum(spark):
    got = _col(spark, ["  Full Time ", "FREELANCE", "", None, "remote"],
               lambda c: map_enum(c, M.JOB_TYPE_MAP, "FULL_TIME"))
    assert got == ["FULL_TIME", "FREELANCE", "FULL_TIME", "FULL_TIME", "FULL_TIME"]
    assert _col(spark, ["Nữ", "xyz", "3-5 năm"], lambda c: map_enum(c, {**M.GENDER_MAP, **M.EXPERIENCE_LEVEL_MAP})) \
        == ["FEMALE", None, "MIDDLE"]


def test_company_size_first_contained_key(spark):
    got = _col(spark, ["25-99 nhân viên", "1000+", "101-999", "", None, "xyz"],
               lambda c: map_contains_first(c, M.COMPANY_SIZE_ORDER))
    assert got == ["SMALL", "ENTERPRISE", "STARTUP", None, None, None]


def test_company_email(spark):
    got = _col(spark, ["Công ty Điện Lạnh", "", "  ACME  ", "Ça va...", "a\tb"], company_email)
    assert got[0] == "cong.ty.ien.lanh@gmail.com"     # Đ has no decomposition: dropped
    assert got[1] == "company@gmail.com"
    assert got[2] == "acme@gmail.com"
    assert got[3] == "ca.va@gmail.com"
    assert got[4] == "a\tb@gmail.com"                   # only spaces become dots


def test_parse_salary(spark):
    rows = _col(spark, ["10,000,000 - 15,000,000", "Thỏa thuận", "12.5 triệu", "0", "", None,
                        "abc", "99999999999999"], parse_salary)
    assert (rows[0]["min_amount"], rows[0]["max_amount"], rows[0]["is_negotiable"]) == \
        (Decimal("10000000.00"), Decimal("15000000.00"), False)
    assert rows[1]["is_negotiable"] and rows[1]["min_amount"] is None
    assert (rows[2]["min_amount"], rows[2]["max_amount"]) == (Decimal("12.00"), Decimal("5.00"))
    assert (rows[3]["min_amount"], rows[3]["max_amount"], rows[3]["is_negotiable"]) == (Decimal("0.00"), Decimal("0.00"), False)
    assert rows[4]["is_negotiable"] and rows[5]["is_negotiable"] and rows[6]["is_negotiable"]
    assert rows[7]["overflow"] and not rows[0]["overflow"]


def test_salary_row_exists(spark):
    got = _col(spark, ["0", "5", "", "Thỏa thuận"], lambda c: has_salary_row(parse_salary(c)))
    assert got == [False, True, True, True]


def test_parse_deadline(spark):
    got = _col(spark, ["31/12/2025", "2025-12-31", "31/02/2025", "soon", " 5/3/2024 ", "2025-1-5", None],
               parse_deadline)
    assert got[0] == dt.datetime(2025, 12, 31) and got[1] == dt.datetime(2025, 12, 31)
    assert got[2] is None and got[3] is None and got[6] is None
    assert got[4] == dt.datetime(2024, 3, 5) and got[5] == dt.datetime(2025, 1, 5)


def test_labelled_summary(spark):
    df = spark.createDataFrame([("IT", "", "1000"), ("", None, ""), (" ", "HN", None)], "a string, b string, c string")
    got = [r["s"] for r in df.select(labelled_summary([("A: ", F.col("a")), ("B: ", F.col("b")),
                                                       ("C: ", F.col("c"))]).alias("s")).collect()]
    assert got == ["A: IT. C: 1000", None, "A:  . B: HN"]


def test_extract_skills_large_dictionary_same_rule(spark):
    from matchspark.functions import text as T
    d = ["Java", "JavaScript", "R", "C#", "Go", "API", "SQL"] + [f"zz{i:04d}" for i in range(600)]
    texts = ["I write JavaScript and R code", "C# dev; go-lang; capital", "c#x", "ágo zz0007 zz0599", None]
    big = _col(spark, texts, lambda c: T.extract_skills(c, d))
    small = _col(spark, texts, lambda c: T.extract_skills(c, d[:7] + ["zz0007", "zz0599"]))
    assert big == small


def _matches(spark, texts, entries):
    from matchspark.operators.dictionary import dictionary_matches
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    table = spark.createDataFrame([(s, i) for i, s in enumerate(entries)], "skill string, pos int")
    got = {i: [] for i in range(len(texts))}
    for r in dictionary_matches(rows, "id", F.col("text"), table).orderBy("id", "pos").collect():
        got[r["id"]].append(r["skill"])
    return [got[i] for i in range(len(texts))]


def test_dictionary_table_equals_column_form(spark):
    d = ["Java", "JavaScript", "R", "C#", "Go", "API", "SQL", "Java", "machine learning", "x y", " ", "a ", "  ", "é", "ﬁre", "😀x😀",
         "data\nbase", "", "İs", "(", "long" * 300] + [f"zz{i:04d}" for i in range(600)]
    texts = ["I write JavaScript and R code", "C# dev; go-lang; capital", "c#x", "ágo zz0007 zz0599", None, "", "Machine learning",
             "machine\nlearning", "machine  learning", "xx yy", "data\nbase a b", "go", "(go)", "É", "é!", "a😀x😀b", "İs it",
             "w" * 2500 + "long" * 300 + "w" * 700, "b a c", "tab\tsql", "w" * 998 + "java", "w" * 997 + "java" + "w" * 5]
    assert _matches(spark, texts, d) == _col(spark, texts, lambda c: extract_skills(c, d))


def test_dictionary_table_random(spark):
    import random
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abC# \n_é") for _ in range(rng.randint(0, n)))
    d, texts = [word(5) for _ in range(150)], [word(40) for _ in range(120)] + [None, ""]
    assert _matches(spark, texts, d) == _col(spark, texts, lambda c: extract_skills(c, d))


def test_dictionary_table_empty(spark):
    assert _matches(spark, ["a b", None], []) == [[], []]
    assert _matches(spark, [None, ""], ["a"]) == [[], []]
