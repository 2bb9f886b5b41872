"""Rule labels, key-graph deletes and as-of attribution."""

import datetime as dt
import itertools
import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchspark.operators import evaluate as ev
from matchspark.operators.quality import ForeignKey, cascade_graph
from matchspark.operators.relevance import contained_skills, matching_titles, synonym_classes, title_matches


def _lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("threshold", [0.6, 0.85])
def test_title_matches_equal_brute_force(spark, threshold):
    rng = np.random.default_rng(4)
    vocabulary = ["data", "senior", "engineer", "java", "sales", "lead", "developer", "kế", "toán", "x1"]
    titles = [" ".join(rng.choice(vocabulary, size=rng.integers(1, 5), p=[.3, .2, .1, .1, .05, .05, .05, .05, .05, .05])) for _ in range(70)] + ["", "  ", None, "Data  Engineer!"]
    vecs = rng.normal(size=(len(titles), 4)) + 0.8
    rows = [(i, t, [float(x) for x in v]) for i, (t, v) in enumerate(zip(titles, vecs))]
    cvs, jobs = rows[::2] + [(900, "data engineer", None)], rows[1::2] + rows[:4]
    got = {(r[0], r[1]): round(r[2], 6) for r in title_matches(
        spark.createDataFrame(cvs, "cv_id long, title string, title_vec array<float>"),
        spark.createDataFrame(jobs, "job_id long, title string, title_vec array<float>"), threshold).collect()}
    every = [t for _, t, _ in cvs + jobs if t is not None]
    words = {t: set(re.findall(r"\w+", t.lower())) for t in every}
    idf = {w: math.log((len(every) + 1) / (sum(w in words[t] for t in every) + 1)) + 1 for w in set().union(*words.values())}
    norm = {t: math.sqrt(sum(idf[w] ** 2 for w in words[t])) for t in every}
    want = {}
    for (i, a, u), (j, b, v) in itertools.product(cvs, jobs):
        if a is None or b is None or not words[a] or not words[b]:
            continue
        x, y = words[a], words[b]
        cos = 0.0
        if u and v:
            p, q = np.float32(u).astype(float), np.float32(v).astype(float)
            cos = p @ q / np.linalg.norm(p) / np.linalg.norm(q)
        parts = [len(x & y) / len(x | y), 1 - _lev(a.lower(), b.lower()) / max(len(a), len(b)), sum(idf[w] ** 2 for w in x & y) / norm[a] / norm[b], cos]
        if sum(parts) / 4 > threshold:
            want[i, j] = round(sum(parts) / 4, 6)
    assert got == want and len(want) >= 4


def test_title_threshold_without_a_common_word_is_refused(spark):
    with pytest.raises(ValueError):
        matching_titles(spark.createDataFrame([("a", True, True)], "title string, cv boolean, job boolean"), 0.5)


def test_synonyms_are_closed_over_chains(spark):
    chain = [(f"s{i:02d}", f"s{i + 1:02d}") for i in range(0, 20)] + [("x", "y"), ("y", "x"), ("z", "z")]
    got = {r["skill"]: r["cls"] for r in synonym_classes(spark.createDataFrame(chain, "a string, b string")).collect()}
    assert {got[f"s{i:02d}"] for i in range(21)} == {"s00"} and got["x"] == got["y"] == "x" and got["z"] == "z"


def test_contained_skills_equal_brute_force(spark):
    skills = ["r", "react", "react native", "native", "reactive", "c++", "c", "kế toán", "toán", "kế toán trưởng", "act"]
    got = sorted(tuple(r) for r in contained_skills(spark.createDataFrame([(s,) for s in skills], "skill string")).collect())
    want = []
    for a, b in itertools.permutations(skills, 2):
        outer, inner = (a, b) if b in a else (b, a)
        if inner in outer:
            want.append((a, b, 3 if re.search(r"(^|\W)" + re.escape(inner) + r"($|\W)", outer) else 2))
    assert got == sorted(want)


def test_cascade_over_the_key_graph(spark):
    tables = {"edge": spark.createDataFrame([(1, 2), (2, 3), (4, 5), (None, 5)], "a long, b long"),
              "job": spark.createDataFrame([(1, 10), (2, 10), (3, 11), (4, 12), (5, None), (6, 99)], "id long, company long"),
              "company": spark.createDataFrame([(10,), (11,), (12,)], "id long")}
    keys = [ForeignKey("edge", "a", "job", "id"), ForeignKey("edge", "b", "job", "id"), ForeignKey("job", "company", "company", "id")]
    left = cascade_graph(tables, keys, {"company": spark.createDataFrame([(11,)], "id long"), "job": spark.createDataFrame([(4,)], "id long")})
    assert {t: sorted((tuple(r) for r in df.collect()), key=str) for t, df in left.items()} == {
        "company": [(10,), (12,)], "job": [(1, 10), (2, 10), (5, None), (6, 99)], "edge": [(1, 2), (None, 5)]}


def test_cascade_over_a_cycle(spark):
    people = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3), (5, 5), (6, None)], "id long, boss long")
    left = cascade_graph({"p": people}, [ForeignKey("p", "boss", "p", "id")], {"p": spark.createDataFrame([(1,)], "id long")})
    assert sorted(r["id"] for r in left["p"].collect()) == [5, 6]


def test_rates_by_version(spark):
    day = lambda d: dt.datetime(2024, 1, d)
    lists = spark.createDataFrame([(1, 7, 70), (1, 7, 71), (2, 7, 70)], "version int, cv long, job long")
    versions = spark.createDataFrame([(1, day(1)), (2, day(10))], "version int, valid_from timestamp")
    events = spark.createDataFrame([
        (7, 70, day(2), "click"), (7, 70, day(2), "click"), (7, 71, day(9), "click"),       # within version 1; the second is too late
        (7, 70, day(10), "purchase"), (7, 71, day(11), "click"), (7, 70, day(31), "click")], "cv long, job long, ts timestamp, kind string")
    got = {r["version"]: tuple(r)[1:] for r in ev.rates_by_version(lists, versions, events, ["cv", "job"], "ts", "kind", 5).collect()}
    assert got == {1: (2, 1, 0, 0.5, 0.0), 2: (1, 0, 1, 0.0, 1.0)}


def test_all_five_grades(spark):
    pairs = spark.createDataFrame([(1, 10)], "cv_id long, job_id long")
    cv = spark.createDataFrame([(1, s) for s in ("Python", "kế toán", "React Native", "javascript", "vue")], "cv_id long, skill string")
    for skill, level in (("python ", 5), ("Accountancy", 4), ("react", 3), ("java", 2), ("angular", 1), ("cobol", 0)):
        job = spark.createDataFrame([(10, skill), (10, skill.upper())], "job_id long, skill string")
        r = ev.skill_match(pairs, cv, job, synonyms=[("Kế toán", "accounting"), ("accounting", "accountancy")],
                           categories={"vue": "frontend", "angular": "frontend"}).first()
        assert (r["best_level"], r["n_job_skills"], r["n_matched"], r["skills_match"]) == (level, 1, int(level >= 3), level >= 3), skill
    empty = ev.skill_match(pairs, cv.where(F.lit(False)), spark.createDataFrame([], "job_id long, skill string")).first()
    assert tuple(empty) == (1, 10, 0, 0, 0, False)


def test_pairs_are_graded_without_a_shuffle_and_as_by_skill_match(spark, capsys):
    """the pairs of matching titles grow with the copies of a title; no exchange is keyed by the pair."""
    from matchspark.operators.relevance import graded_pairs, skill_match, title_matches

    titles = ["red ring LARGE", "red ring SMALL", "old bolt LARGE"]
    cvs = spark.createDataFrame([(i, titles[i % 3], [1.0, float(i % 2)]) for i in range(12)], "cv_id long, title string, title_vec array<float>")
    jobs = spark.createDataFrame([(i, titles[i % 3], [1.0, 0.5]) for i in range(9)], "job_id long, title string, title_vec array<float>")
    cs = spark.createDataFrame([(i, s) for i in range(11) for s in ("red ring", "bolt", "nut")[: i % 4]], "cv_id long, skill string")
    js = spark.createDataFrame([(i, s) for i in range(8) for s in ("Red ring ", "ring", "old bolt", "gear")[: i % 5]], "job_id long, skill string")
    more = {"synonyms": [("nut", "gear")], "categories": {"red ring": "x", "old bolt": "x"}}
    got = graded_pairs(cvs, jobs, cs, js, threshold=0.6, **more)
    matched = title_matches(cvs, jobs, 0.6)
    want = matched.join(skill_match(matched, cs, js, **more), ["cv_id", "job_id"])
    rows = lambda d: sorted(map(tuple, d.select("cv_id", "job_id", "title_score", "n_job_skills", "best_level", "n_matched", "skills_match").collect()))
    assert rows(got) == rows(want) and any(r[-1] for r in rows(got))
    got.explain()
    assert not [x for x in capsys.readouterr().out.splitlines() if "hashpartitioning(cv_id" in x and "job_id" in x.split("hashpartitioning(")[1]]
    twice = graded_pairs(cvs.union(cvs), jobs, cs, js, threshold=0.6, **more)
    assert twice.count() == 4 * got.count()


def test_pairs_of_titles_meet_in_tiles_whatever_their_vectors(spark, monkeypatch, capsys):
    """F2: pairs that may match are looked at by a product in tiles of bounded size; absent, zero, other and broken vectors score as ``cosine`` does."""
    from matchspark.functions.vector import cosine
    from matchspark.operators import relevance

    monkeypatch.setattr(relevance, "TILE_JOBS", 3)
    monkeypatch.setattr(relevance, "TILE_PAIRS", 10)
    monkeypatch.setattr(relevance, "TASK_PAIRS", 20)
    vecs = [[1.0, 0.5], [0.5, 1.0], [-1.0, 0.1], [0.0, 0.0], [1.0], [], None, [1.0, None], [float("nan"), 1.0], [1.0, 0.5]]
    rows = [(i if i != 13 else None, ("red ring large", "red ring small", "old bolt", None)[i % 4], vecs[i % 10]) for i in range(40)]
    cvs = spark.createDataFrame([(*r, f"c{r[0]}") for r in rows + rows[:3]], "cv_id long, title string, title_vec array<float>, what string")
    jobs = spark.createDataFrame(rows[5:], "job_id long, title string, title_vec array<double>")
    got = title_matches(cvs, jobs, 0.6)
    titles = cvs.select("title", F.lit(True).alias("cv"), F.lit(False).alias("job")).unionAll(jobs.select("title", F.lit(False), F.lit(True))).where("title is not null")
    want = (matching_titles(titles, 0.6).join(cvs.withColumnsRenamed({"title": "cv_title", "title_vec": "a"}), "cv_title")
            .join(jobs.withColumnsRenamed({"title": "job_title", "title_vec": "b"}), "job_title")
            .withColumn("s", (F.col("part") + cosine("a", "b")) / 4).where("s > 0.6").select("cv_id", "what", "job_id", "s"))
    listed = lambda d: sorted((str(tuple(r)[:3]), round(r[3], 9) if r[3] == r[3] else "nan") for r in d.collect())
    assert [(a, str(b)) for a, b in listed(got)] == [(a, str(b)) for a, b in listed(want)] and len(listed(want)) > 100
    got.explain()
    assert "_no" in capsys.readouterr().out.split("hashpartitioning(")[1]


def test_ndcg_rule_labels_makes_the_relevant_pairs_once(spark, monkeypatch):
    """the labels are counted and joined; the search for them runs once."""
    from matchspark.plans import q_eval

    made = spark.sparkContext.accumulator(0)

    @F.udf("boolean")
    def seen(x):
        made.add(1)
        return True

    vec = lambda n: [float(n % 3 + 1), float(n % 5), 1.0]
    cvs = spark.createDataFrame([(i, *[vec(i)] * 3) for i in range(6)], "cv_id long, title_vec array<float>, experience_vec array<float>, skills_vec array<float>")
    jobs = spark.createDataFrame([(i, *[vec(i + 1)] * 3) for i in range(8)], "job_id long, title_vec array<float>, requirement_vec array<float>, skills_vec array<float>")
    pairs = spark.createDataFrame([(i, j) for i in range(5) for j in range(i, 8, 2)], "cv_id long, job_id long").repartition(1)
    monkeypatch.setattr(q_eval, "main_cv_df", lambda *_: cvs)
    monkeypatch.setattr(q_eval, "active_job_df", lambda *_: jobs)
    monkeypatch.setattr(q_eval, "rule_relevant", lambda *_: pairs.withColumn("relevant", seen.asNondeterministic()("job_id")))
    got = {r["k"]: (r["ndcg"], r["hit_rate"]) for r in q_eval.q_ndcg_rule(spark, None).collect()}
    assert made.value == pairs.count() and got[10][1] == round(5 / 6, 6) and 0 < got[5][0] <= got[10][0] <= 1
