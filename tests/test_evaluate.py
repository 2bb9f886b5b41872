"""Ranking metrics against hand values and pyspark.mllib RankingMetrics."""

import math

import pytest
from pyspark.sql import functions as F

from matchspark.operators import evaluate as ev


def _recs(spark):
    # query 1: relevant at ranks 2 and 3 (3 relevant overall); query 2: nothing relevant (2 overall)
    rows = [(1, 10, 1, False), (1, 11, 2, True), (1, 12, 3, True),
            (2, 20, 1, False), (2, 21, 2, False)]
    recs = spark.createDataFrame(rows, "q long, item long, rank int, rel boolean")
    nrel = spark.createDataFrame([(1, 3), (2, 2)], "q long, n_relevant long")
    return rows, recs, nrel


def test_metrics_by_hand(spark):
    rows, recs, nrel = _recs(spark)
    pq = ev.per_query(recs, "q", "rank", "rel", nrel, [3])
    m = ev.mrr(pq).first()
    assert m["mrr"] == pytest.approx((0.5 + 0.0) / 2)
    r = {x["q"]: x for x in pq.collect()}
    dcg = 1 / math.log2(3) + 1 / math.log2(4)
    idcg = 1 + 1 / math.log2(3) + 1 / math.log2(4)
    assert r[1]["ndcg_3"] == pytest.approx(dcg / idcg)
    assert r[2]["ndcg_3"] == 0.0
    assert r[1]["prec_3"] == pytest.approx(2 / 3) and r[1]["rec_3"] == pytest.approx(2 / 3)
    assert r[1]["wsum_3"] == pytest.approx(1 / 2 + 1 / 3)


def test_against_ranking_metrics(spark):
    from pyspark.mllib.evaluation import RankingMetrics
    _, recs, nrel = _recs(spark)
    relevant = {1: [11, 12, 99], 2: [98, 97]}
    pred = spark.sparkContext.parallelize([([10, 11, 12], relevant[1]), ([20, 21], relevant[2])])
    rm = RankingMetrics(pred)
    pq = ev.per_query(recs, "q", "rank", "rel", nrel, [3])
    row = pq.agg(F.avg("ndcg_3").alias("n"), F.avg("prec_3").alias("p"), F.avg("rec_3").alias("r")).first()
    assert row["n"] == pytest.approx(rm.ndcgAt(3))
    assert row["p"] == pytest.approx(rm.precisionAt(3))
    assert row["r"] == pytest.approx(rm.recallAt(3))


def test_diversity_identity(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0])],
                               "q long, u array<double>")
    d = ev.diversity(df, "q", "u").first()
    # pairs of list 1: (a,b)=1, (a,c)=0, (b,c)=1 -> mean 2/3; list 2 has one item and is skipped
    assert d["lists"] == 1 and d["diversity"] == pytest.approx(2 / 3)


def test_coverage_and_rates(spark):
    recs = spark.createDataFrame([(1, 10), (2, 10), (2, 11)], "cv_id long, job_id long")
    jobs = spark.createDataFrame([(10,), (11,), (12,), (13,)], "job_id long")
    c = ev.coverage_ratio(recs, "job_id", jobs, "job_id").first()
    assert (c["recommended_items"], c["corpus_items"], c["coverage"]) == (2, 4, 0.5)
    events = spark.createDataFrame([(2, 11, "click"), (2, 11, "purchase"), (1, 12, "click")],
                                   "cv_id long, job_id long, kind string")
    r = ev.interaction_rates(recs, events, ["cv_id", "job_id"], "kind").first()
    assert (r["impressions"], r["clicks"], r["applies"]) == (3, 1, 1)


def test_jaccard_and_string_similarity(spark):
    df = spark.createDataFrame([("Data Engineer", "data engineer senior")], "a string, b string")
    row = df.select(ev.jaccard(ev.word_set(F.col("a")), ev.word_set(F.col("b"))).alias("j"),
                    ev.string_similarity(F.lower("a"), F.lower("b")).alias("s")).first()
    assert row["j"] == pytest.approx(2 / 3)
    assert row["s"] == pytest.approx(1 - 7 / 20)


def test_random_baseline_is_reproducible(spark):
    q = spark.range(20).withColumnRenamed("id", "cv_id")
    c = spark.range(100, 160).withColumnRenamed("id", "job_id")
    a = sorted(tuple(r) for r in ev.random_top_k(q, "cv_id", c, "job_id", 5).collect())
    b = sorted(tuple(r) for r in ev.random_top_k(q, "cv_id", c.repartition(3), "job_id", 5).collect())
    assert a == b and len(a) <= 100


def test_skill_match_levels(spark):
    pairs = spark.createDataFrame([(1, 10), (1, 11), (2, 10)], "cv_id long, job_id long")
    cv = spark.createDataFrame([(1, "Python"), (1, "Kế toán"), (2, "React Native")], "cv_id long, skill string")
    job = spark.createDataFrame([(10, "python "), (10, "React"), (11, "Accounting"), (11, "SQL Server")],
                                "job_id long, skill string")
    got = {(r["cv_id"], r["job_id"]): r for r in ev.skill_match(
        pairs, cv, job, synonyms=[("kế toán", "accounting")], categories={"python": "backend", "sql server": "backend"}
    ).collect()}
    assert got[(1, 10)]["best_level"] == 5 and got[(1, 10)]["n_matched"] == 1      # exact (case / space folded)
    assert got[(1, 11)]["best_level"] == 4 and got[(1, 11)]["n_matched"] == 1      # synonym; SQL Server only category
    assert got[(2, 10)]["best_level"] == 3 and got[(2, 10)]["skills_match"]        # "react" a whole word of "react native"


def test_at_k_reads_the_lists_once(spark):
    from pyspark.sql import functions as F
    pq = spark.createDataFrame([(1, 0.5, 1.0), (2, 1.0, 0.0)], "q long, m_5 double, m_10 double")
    out = ev.at_k(pq, [5, 10], {"m": lambda k: F.avg(f"m_{k}")})
    assert sorted(tuple(r) for r in out.collect()) == [(5, 0.75), (10, 0.5)]
    assert "Union" not in out._jdf.queryExecution().optimizedPlan().toString()
