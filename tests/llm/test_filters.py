"""Operators 3, 7 and 10."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm import brute
from tests.llm.conftest import EDGE, SF
from tests.oracle_compare import compare, duck

from matchspark.llm import quality_rules as qr
from matchspark.llm import toxicity, weak_quality
from matchspark.llm.queries import QUERIES
from matchspark.llm.sql import ORACLE

SF01 = "/root/testdata/sf0.01"
LABELS = "doc_id long, quality int, toxic int"


def test_op3_oracle(spark):
    r = compare(spark, "op3_quality_rules", QUERIES["op3_quality_rules"], ORACLE["op3_quality_rules"], SF01, duck(SF01))
    assert r["match"], r


def test_measures_by_brute_force(table):
    for _, text in table("documents", "doc_id, text"):
        assert qr.measures((text or "").encode())[:5] == brute.measures(text)


def test_repeated_words_random():
    rng = random.Random(4)
    for _ in range(300):
        text = " ".join(rng.choice("ab") for _ in range(rng.randint(0, 40)))
        assert qr.measures(text.encode())[4] == brute.measures(text)[4]


@pytest.mark.parametrize("n, p", [(10, 0.3), (400, 0.01), (5000, 0.01)])
def test_binomial_tail(n, p):
    for k in range(0, min(n, 60)):
        exact = math.fsum(math.comb(n, i) * p ** i * (1 - p) ** (n - i) for i in range(k + 1))
        got = qr.binomial_tail(k, n, p)
        assert got == (1.0 if k >= n * p else pytest.approx(exact, rel=1e-9))


def test_false_rejection_is_controlled():
    """Good documents with a known spread: the true false rejection exceeds alpha in at most delta of the trials."""
    rng, broken = np.random.default_rng(0), 0
    for _ in range(200):
        good = np.bincount(np.minimum(20, rng.geometric(0.35, 1500) - 1), minlength=21)
        cut = qr.select_cutoff(good.tolist(), [0] + [3000] * 20, int(good.sum()), 0.05, 0.05)
        broken += cut is not None and 0.65 ** cut > 0.05
    assert broken <= 20


def test_cutoffs_certified_only_with_enough_labels():
    bad = [0] * 10 + [50]
    assert qr.select_cutoff([5000] + [0] * 10, bad, 5000, 0.01, 0.001) == 10
    assert qr.select_cutoff([200] + [0] * 10, bad, 200, 0.01, 0.001) is None
    assert qr.select_cutoff([5000] + [0] * 9 + [400], bad, 5400, 0.01, 0.001) is None


def test_op3_planted(spark):
    """Enough labels: symbol junk goes, clean documents stay, in the stratum that has labels."""
    rng = random.Random(1)

    def clean():
        return " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(40)) + "."

    docs = [(i, clean() if i % 5 else " ".join(w + "###" for w in clean().split()), "en" if i < 9000 else "fr") for i in range(10_000)]
    labels = [(i, int(i % 5 > 0), 0) for i in range(9000)]
    got = {r["doc_id"]: r["kept"] for r in qr.quality_verdicts(
        spark.createDataFrame(docs, "doc_id long, text string, lang string"), spark.createDataFrame(labels, LABELS)).collect()}
    assert all(got[i] for i in range(9000) if i % 5)
    assert not any(got[i] for i in range(0, 9000, 5))
    assert all(got[i] for i in range(9000, 10_000))


def test_op3_copies_are_one_draw(spark):
    """A good text labelled 2,000 times is one good document: it certifies no cutoff that rejects the other good ones."""
    def text(n, blank=" "):
        return blank.join(f"{w}{n}" for w in "ab cd ef gh ij kl mn op qr st uv wx yz ba dc fe hg ji lk nm po rq".split())

    good_copies = [(i, text(0, " " if i % 2 else "\n"), "en") for i in range(2000)]
    good = [(2000 + i, text(i + 1) + " " + " ".join(["same"] * 7), "en") for i in range(8)]
    bad = [(3000 + i, text(i + 100) + " " + " ".join(["same"] * 7), "en") for i in range(300)]
    docs = spark.createDataFrame(good_copies + good + bad, "doc_id long, text string, lang string")
    labels = docs.select("doc_id", F.when(F.col("doc_id") < 3000, 1).otherwise(0).alias("quality"))
    kept = {r["doc_id"]: r["kept"] for r in qr.quality_verdicts(docs, labels).collect()}
    assert all(kept[i] for i, _, _ in good_copies + good)


def test_op3_edges(spark, edge, nothing):
    none = spark.createDataFrame([], LABELS)
    some = spark.createDataFrame([(1, None, 0), (None, 1, 1), (6, 1, 0), (6, 0, 0)], LABELS)
    for labels in (none, some):
        rows = qr.quality_verdicts(edge, labels).collect()
        assert len(rows) == len(EDGE)
        for r in rows:
            if r["doc_id"] in (1, 2, 3):
                assert r["n_words"] == 0 and r["base_failed"] and not r["kept"]
        stay = qr.keep_quality(edge, labels)
        assert stay.columns == edge.columns
        assert sorted(r["doc_id"] for r in stay.collect()) == sorted(r["doc_id"] for r in rows if r["kept"])
        assert qr.quality_verdicts(nothing, labels).count() == 0


def test_label_model_finds_accuracies():
    """Votes drawn from a known model with one doubled voter: posteriors beat every voter, the pair is seen as correlated."""
    rng = np.random.default_rng(2)
    truth = rng.random(6000) < 0.3
    accuracy = [0.9, 0.8, 0.7, 0.6]
    votes = np.stack([np.where(rng.random(6000) < a, truth, ~truth) * 2 - 1 for a in accuracy] , 1)
    votes = np.concatenate([votes, votes[:, 1:2]], 1)
    post, rates, corr = toxicity.label_model(votes.astype(np.int8), np.where(rng.random(6000) < 0.9, truth, ~truth))
    assert ((post > 0.5) == truth).mean() > 0.905  # the best voter has 0.9
    assert corr[1, 4] > 0.9 and abs(corr[0, 2]) < 0.2
    assert list(np.argsort(-rates[1, 2, :4])) == [0, 1, 2, 3]
    # wrong labels pull the rates together (they count half); with right ones the accuracies come out
    _, rates, corr = toxicity.label_model(votes.astype(np.int8), truth)
    assert np.allclose(rates[1, 2, :4], accuracy, atol=0.08) and np.allclose(rates[0, 0, :4], accuracy, atol=0.08)
    assert corr[1, 4] > 0.95 and abs(corr[0, 2]) < 0.1


def test_op10_held_out(spark, table):
    rows = QUERIES["op10_toxicity"](spark, SF01).collect()
    import zlib
    assert len(rows) == 1000
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
    toxic = dict(table("labels", "doc_id, toxic", SF01))
    out = [(r["score"], toxic[r["doc_id"]]) for r in rows if r["held_out"] and r["doc_id"] in toxic]
    pos, neg = [s for s, t in out if t], [s for s, t in out if not t]
    auc = np.mean([[(p > n) + 0.5 * (p == n) for n in neg] for p in pos])
    assert auc > 0.8  # 33 toxic training rows here; see the README for the larger tables


def test_op10_does_not_look_at_held_out_labels(spark):
    docs = spark.read.parquet(f"{SF01}/documents.parquet")
    labels = spark.read.parquet(f"{SF01}/labels.parquet")
    flipped = labels.withColumn("toxic", toxicity.F.expr("if(crc32(cast(doc_id as string)) % 3 = 1, 1 - toxic, toxic)"))
    a, b = (sorted((r["doc_id"], r["score"]) for r in toxicity.toxicity_scores(docs, x).collect()) for x in (labels, flipped))
    assert a == b


def test_op10_planted(spark):
    rng = random.Random(3)

    def text(toxic):
        w = ["".join(rng.choice(["on", "er", "th", "in"]) for _ in range(3)) for _ in range(80)]
        for _ in range(3 * toxic):
            w[rng.randrange(80)] = rng.choice(["idiot", "scum", "moron"])
        return " ".join(w)

    docs = [(i, text(i % 8 == 0), "x", "y") for i in range(2400)]
    labels = [(i, 1, int(i % 8 == 0)) for i in range(1200)]
    got = toxicity.toxicity_scores(spark.createDataFrame(docs, "doc_id long, text string, lang string, source string"),
                                   spark.createDataFrame(labels, LABELS)).collect()
    wrong = sum(r["predicted"] != int(r["doc_id"] % 8 == 0) for r in got)
    assert wrong <= 10


def _plain(rng, words=80):
    return ["".join(rng.choice(["on", "er", "th", "in"]) for _ in range(3)) for _ in range(words)]


def test_op10_rare_toxic_rows_all_count(spark):
    """1 % toxic and a sample of a tenth: the lexicon is counted on all labelled rows, and all toxic ones are in the sample."""
    rng = random.Random(6)

    def text(toxic):
        w = _plain(rng)
        for _ in range(4 * toxic):
            w[rng.randrange(80)] = rng.choice(["idiot", "scum", "moron", "vermin"])
        return " ".join(w)

    docs = spark.createDataFrame([(i, text(i % 100 == 0)) for i in range(4000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 100 == 0)) for i in range(4000)], LABELS)
    got = {r["doc_id"]: r["predicted"] for r in toxicity.toxicity_scores(docs, labels, fit_rows=400).collect()}
    assert sum(got[i] for i in range(0, 4000, 100)) >= 36
    assert sum(got[i] for i in range(4000) if i % 100) <= 10


def test_op10_patterns_without_lexicon(spark):
    """Toxic rows with the words of all others: no entry is found, shouting still counts."""
    rng = random.Random(7)
    docs = spark.createDataFrame([(i, " ".join(w + "!" * (i % 4 == 0) for w in _plain(rng))) for i in range(400)],
                                 "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(200)], LABELS)
    assert not toxicity.fit_toxicity(docs, labels).entries
    got = {r["doc_id"]: r["predicted"] for r in toxicity.toxicity_scores(docs, labels).collect()}
    assert all(got[i] == (i % 4 == 0) for i in range(400))


def test_op10_edges(spark, edge, nothing):
    for labels in ([], [(1, None, None), (None, 1, 1), (4, 1, 1), (4, 1, 0), (6, 1, 0)]):
        df = spark.createDataFrame(labels, LABELS)
        rows = toxicity.toxicity_scores(edge, df).collect()
        assert len(rows) == len(EDGE) and all(0 <= r["score"] <= 1 for r in rows)
        assert toxicity.toxicity_scores(nothing, df).count() == 0
        assert toxicity.drop_toxic(edge, df).columns == edge.columns
        assert toxicity.drop_toxic(edge, df).count() == sum(not r["predicted"] for r in rows)


def test_em_recovers_labellers():
    rng = np.random.default_rng(5)
    truth = rng.random(20_000) < 0.8
    accuracy = np.array([0.95, 0.9, 0.8, 0.75, 0.7])
    votes = np.stack([np.where(rng.random(20_000) < a, truth, ~truth) * 2 - 1 for a in accuracy], 1)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    post, rates, share = weak_quality.em(patterns, counts.astype(float))
    assert share == pytest.approx(0.8, abs=0.03)
    assert np.allclose(rates[1, 2], accuracy, atol=0.04)


def test_op7_keeps_clean(spark, table):
    kept = {r["doc_id"]: r["kept"] for r in QUERIES["op7_weak_quality"](spark, SF01).collect()}
    quality = dict(table("labels", "doc_id, quality", SF01))
    assert len(kept) == 1000
    assert np.mean([kept[i] for i, q in quality.items() if q == 1]) > 0.95
    assert np.mean([kept[i] for i, q in quality.items() if q == 0]) < 0.6


def test_op7_edges(spark, edge, nothing):
    rows = weak_quality.quality_scores(edge).collect()
    assert len(rows) == len(EDGE) and all(0 <= r["score"] <= 1 for r in rows)
    by_text = {}
    for r in rows:
        by_text.setdefault(r["doc_id"], set()).add(round(r["score"], 12))
    assert len(by_text[5]) == 1
    assert weak_quality.quality_scores(nothing).count() == 0
