"""Operator 3: quality rules with risk-controlled thresholds.

**Measures** of a whole text, with words ``[^\\x20\\x09-\\x0D]+``: n_words, word_chars (code points in
words), n_symbols (characters of ``[#*$%&|<>]``), n_lines (lines with a word), n_dup_lines (those equal to an
earlier line), n_repeat_words (words in 8-word windows found twice or more), n_distinct (different words).

**Base rules** (fixed): fewer than 20 words, or more than 30 % of the words in repeated windows.

**Risk-controlled rules.** Each rule is a share of two measures, counted in steps (``RULES``); a cutoff rejects
the documents at or above it. The holdout is every labelled document that passes the base rules; the binomial tail
needs independent draws, so texts that are equal but for ASCII blanks and the case of A-Z count once per label and stratum (the
row with the smallest id and measures stands for them). Near copies still count each. In each
stratum (language) and for each rule, the hypothesis "this cutoff rejects more than alpha / rules
of the good documents" is tested by its exact binomial tail P(X <= k), X ~ Bin(n, alpha / rules), with k of n
good documents rejected. Multiple testing: Bonferroni over strata and rules, and within a rule the
cutoffs are tested in a fixed order from the mildest on, up to the first that is not certified. So with
probability 1 - delta, in every stratum at most alpha of the good documents is falsely rejected by all certified cutoffs
together, whichever of them is used. Of these the one with the best balance of bad and good
rejections (a good one costs ``GOOD_COST`` bad ones) is taken, the mildest among equals; if none rejects more than it
costs, or the stratum has too few labels, the rule stays off there.

Defined cases: null text has no words (base_failed); null language is the stratum ""; a document labelled
twice counts as good if any label says so; null labels count as none; repeated rows are measured
each; empty tables of documents or labels give an empty result or base rules only.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchspark.llm.common import stored, text_bytes

ALPHA = 0.05       # falsely rejected share of good documents, all rules of a stratum together
DELTA = 0.05       # probability that any stratum breaks this
GOOD_COST = 5      # rejected bad documents that weigh as much as one rejected good one
WINDOW = 8
MIN_WORDS = 20
REPEAT_PERCENT = 30
BROADCAST_STRATA = 10_000

SYMBOLS = b"#*$%&|<>"
BLANKS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BLANKS = BLANKS.encode()
_NOT_A_CHAR = _BLANKS + bytes(range(0x80, 0xC0))

#: rule: (numerator, denominator, steps per unit, number of cutoffs); step = floor(steps * num / den)
RULES = {
    "symbols": ("n_symbols", "word_chars", 50, 50),
    "dup_lines": ("n_dup_lines", "n_lines", 20, 20),
    "repeats": ("n_repeat_words", "n_words", 20, 20),
    "same_words": ("n_words - n_distinct", "n_words", 20, 20),
    "word_length": ("word_chars", "n_words", 2, 40),
}
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct"]
_COEF = np.array([pow(0x9E3779B97F4A7C15, k + 1, 1 << 64) for k in range(WINDOW)], np.uint64)


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of WINDOW words which occurs at least twice."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    w = np.zeros(n, np.uint64)
    for k in range(WINDOW):
        w += h[k:k + n] * _COEF[k]
    order = np.sort(w)
    twice = order[1:][order[1:] == order[:-1]]
    if not len(twice):
        return 0
    places = np.flatnonzero(np.isin(w, twice)).tolist()  # equal hashes: now compare the words
    windows = [tuple(words[i:i + WINDOW]) for i in places]
    count = Counter(windows)
    cover = np.zeros(len(words) + 1, np.int64)
    for i, x in zip(places, windows):
        if count[x] > 1:
            cover[i] += 1
            cover[i + WINDOW] -= 1
    return int(np.count_nonzero(np.cumsum(cover)[:-1]))


def measures(text: bytes) -> tuple[int, ...]:
    """In the order of MEASURES."""
    words = text.split()  # bytes: splits at ASCII blanks only
    lines = [line for line in text.split(b"\n") if line.strip()]
    return (len(words), len(text.translate(None, _NOT_A_CHAR)), len(text) - len(text.translate(None, SYMBOLS)),
            len(lines) - len(set(lines)), repeated_words(words), len(lines), len(set(words)))


def measures_of(text: Column) -> Column:
    """struct of MEASURES; not deterministic to Spark, so that a filter does not run it a second time."""
    def run(column: pa.Array) -> pa.Array:
        rows = np.array([measures(t) for t in text_bytes(column)], np.int64).reshape(-1, len(MEASURES))
        return pa.StructArray.from_arrays([pa.array(rows[:, i]) for i in range(len(MEASURES))], names=MEASURES)

    return F.arrow_udf(run, "struct<" + ",".join(f"{m}:bigint" for m in MEASURES) + ">").asNondeterministic()(text)


def base_failed(prefix: str = "") -> Column:
    n, rep = F.col(prefix + "n_words"), F.col(prefix + "n_repeat_words")
    return (n < MIN_WORDS) | (100 * rep > REPEAT_PERCENT * n)


def step(rule: str, prefix: str = "") -> Column:
    """The rule's value in whole steps (no denominator: 0), at most its last cutoff."""
    num, den, steps, cutoffs = RULES[rule]
    names = {m: f"{prefix}{m}" for m in MEASURES}
    num = " - ".join(names[x] for x in num.split(" - "))
    return F.expr(f"cast(least({cutoffs}, case when {names[den]} > 0 then ({steps} * ({num})) div {names[den]} else 0 end) as int)")


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X ~ Bin(n, p), exact up to rounding; 1 if k is not below the mean (never certified)."""
    if n == 0 or k >= n * p:
        return 1.0
    term = math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
                    + k * math.log(p) + (n - k) * math.log1p(-p))
    total, i = 0.0, k
    while i >= 0 and term > total * 1e-17:
        total += term
        term *= i / (n - i + 1) * (1 - p) / p
        i -= 1
    return min(1.0, total)


def select_cutoff(good: list[int], bad: list[int], n_good: int, alpha: float, level: float) -> int | None:
    """``good[j]`` and ``bad[j]``: labelled documents at step j (j = 0, ..., cutoffs). The best certified cutoff."""
    best, value = None, 0
    g = b = 0
    for j in range(len(good) - 1, 0, -1):
        g, b = g + good[j], b + bad[j]
        if binomial_tail(g, n_good, alpha) > level:
            break
        if b - GOOD_COST * g > value:
            best, value = j, b - GOOD_COST * g
    return best


def fit_cutoffs(measured: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """stratum and one cutoff (or null) per rule. ``measured``: doc_id, stratum, copy, measures; ``labels``: doc_id, quality."""
    truth = (labels.where("doc_id is not null and quality is not null")
             .groupBy("doc_id").agg(F.max("quality").alias("quality")))
    passing = measured.where(~base_failed()).join(truth, "doc_id")
    passing = (passing.groupBy("stratum", "copy", "quality").agg(F.min(F.struct("doc_id", *MEASURES)).alias("one"))
               .select("stratum", "quality", "one.*"))
    steps = F.array(*[F.struct(F.lit(r).alias("rule"), step(r).alias("step")) for r in RULES])
    counts = (passing.select("stratum", "quality", F.inline(steps)).groupBy("stratum", "rule", "step")
              .agg(F.sum((F.col("quality") == 1).cast("long")).alias("good"),
                   F.sum((F.col("quality") == 0).cast("long")).alias("bad")))
    counts = stored(counts, "rule-counts")  # strata x rules x steps
    tests = len(RULES) * max(1, counts.select("stratum").distinct().count())

    def select(pdf: pd.DataFrame) -> pd.DataFrame:
        row = {"stratum": pdf["stratum"].iloc[0]}
        for rule, (*_, cutoffs) in RULES.items():
            own = pdf[pdf["rule"] == rule]
            good, bad = [0] * (cutoffs + 1), [0] * (cutoffs + 1)
            for s, g, b in zip(own["step"], own["good"], own["bad"]):
                good[s], bad[s] = int(g), int(b)
            row[rule] = select_cutoff(good, bad, sum(good), alpha / len(RULES), delta / tests)
        return pd.DataFrame([row]).astype({r: "Int32" for r in RULES})

    return stored(counts.groupBy("stratum").applyInPandas(
        select, "stratum string, " + ", ".join(f"{r} int" for r in RULES)), "rule-cutoffs")


def with_cutoffs(rows: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Join the cutoffs by stratum: broadcast if counted small, else by a shuffle."""
    named = cutoffs.select(F.col("stratum").alias("__stratum"), *[F.col(r).alias(f"__cut_{r}") for r in RULES])
    small = named.count() <= BROADCAST_STRATA
    return rows.join(F.broadcast(named) if small else named, rows["stratum"] == named["__stratum"], "left")


def kept(prefix: str = "") -> Column:
    out = ~base_failed(prefix)
    for r in RULES:
        out &= F.coalesce(step(r, prefix) < F.col(f"__cut_{r}"), F.lit(True))
    return out


def copy_key(text: Column) -> Column:
    """Equal for texts that are equal but for ASCII blanks and the case of A-Z."""
    return F.sha2(F.translate(F.coalesce(text, F.lit("")), UPPER + BLANKS, UPPER.lower()), 256)


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """doc_id, stratum, copy (key of equal texts) and the measures, stored (a few numbers a row)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(stratum_col).cast("string"), F.lit("")).alias("stratum"),
                       copy_key(F.col(text_col)).alias("copy"), measures_of(F.col(text_col)).alias("m"))
    return stored(rows.select("doc_id", "stratum", "copy", "m.*"), "quality-measures")


def quality_verdicts(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA,
                     id_col: str = "doc_id", text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """doc_id, measures, base_failed, kept for every row."""
    measured = measure(docs, id_col, text_col, stratum_col)
    cutoffs = fit_cutoffs(measured, labels, alpha, delta)
    return with_cutoffs(measured, cutoffs).select(
        "doc_id", *MEASURES[:5], base_failed().alias("base_failed"), kept().alias("kept"), *MEASURES[5:])


def keep_quality(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA, id_col: str = "doc_id",
                 text_col: str = "text", stratum_col: str = "lang") -> DataFrame:
    """The rows of ``docs`` that the rules keep. Texts are measured once for the cutoffs and once in place, which costs
    less than a shuffle of the texts."""
    cutoffs = fit_cutoffs(measure(docs, id_col, text_col, stratum_col), labels, alpha, delta)
    names = {c: f"__{i}" for i, c in enumerate(docs.columns)}  # no name clashes with the measures
    rows = docs.select(*[F.col(c).alias(a) for c, a in names.items()],
                       F.coalesce(F.col(stratum_col).cast("string"), F.lit("")).alias("stratum"),
                       measures_of(F.col(text_col)).alias("m"))
    return with_cutoffs(rows, cutoffs).where(kept("m.")).select(*[F.col(a).alias(c) for c, a in names.items()])
