"""Operator 7: quality classifier from weak labels.

1. **Labellers.** Eight heuristics (``VOTES``) look at the measures of a whole text and vote good (1), bad (-1) or not
   at all (0); five only detect one kind of junk. They overlap and none needs a label.
2. **Weak-label model.** Expectation-maximisation over a naive Bayes model of the votes estimates each
   labeller's accuracy and the share of good documents. The votes of all documents are counted per
   pattern in one aggregate, and the model is fitted on these counts: at most 3^8 rows, exact for any corpus.
3. **Hashed linear scorer.** Words, word shapes and marks of the whole text are hashed into ``BUCKETS`` features; a logistic
   regression trained on the posteriors of a sample of ``FIT_ROWS`` documents (chosen by a hash of the id) scores
   every document as bias + the mean weight of its tokens + the weights of its marks.

Defined cases: null and empty texts have the marks of an empty text (bad); null ids are never in the
sample; repeated rows get equal scores; an empty table gives an empty result; if the model cannot tell two
classes apart (all votes alike), the score is the share of good documents it finds.
"""

from __future__ import annotations

import functools
import itertools
import pickle
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchspark.llm.common import CACHED_WORD, collected, stored, text_bytes
from matchspark.llm.quality_rules import measures
from matchspark.llm.toxicity import logistic

BUCKETS = 1 << 16
FIT_ROWS = 6_000       # documents whose features train the scorer, about
THRESHOLD = 0.5
CACHED = 100_000       # words in a worker's cache

VOTES = ("symbols", "dup_lines", "repeats", "same_words", "stutter", "word_length", "words", "ends")
#: first guess of a labeller: the probability of its vote being right
FIRST_ACCURACY = 0.8


def looked_at(text: bytes) -> dict[str, float]:
    n, chars, symbols, dup, repeated, lines, distinct = measures(text)
    words = text.split()
    stutter = sum(map(bytes.__eq__, words, words[1:]))
    ends = sum(w[-1] in b".!?" for w in words)
    return {"n": n, "symbols": symbols / max(1, chars), "dup_lines": dup / max(1, lines), "repeats": repeated / max(1, n),
            "same_words": 1 - distinct / max(1, n), "stutter": stutter / max(1, n), "word_length": chars / max(1, n),
            "ends": ends / max(1, n)}


def votes(m: dict[str, float]) -> tuple[int, ...]:
    """In the order of VOTES."""
    n = m["n"]
    return (-1 if m["symbols"] >= 0.05 else 0, -1 if m["dup_lines"] >= 0.35 else 0, -1 if m["repeats"] > 0.3 else 0,
            -1 if m["same_words"] >= 0.6 else 0, -1 if m["stutter"] >= 0.2 else 0,
            -1 if n and not 3 <= m["word_length"] <= 7 else 1 if 4 <= m["word_length"] <= 6 else 0,
            -1 if n < 3 else 1 if n >= 40 else 0,
            -1 if n >= 60 and not m["ends"] else 1 if 0.02 <= m["ends"] <= 0.5 else 0)


def marks(m: dict[str, float]) -> list[str]:
    """Tokens of the text as a whole."""
    out = [f"\x00{k}:{min(10, int(20 * m[k]))}" for k in ("symbols", "dup_lines", "repeats", "same_words", "stutter")]
    return [*out, f"\x00length:{min(12, int(m['word_length']))}", f"\x00words:{min(12, int(m['n']).bit_length())}"]


def bucket(token: bytes) -> int:
    return zlib.crc32(token) % BUCKETS


def shape(word: bytes) -> bytes:
    """The kinds of characters in a word, runs collapsed: a word of letters with a stop is ``a.``."""
    out = bytearray()
    for c in word:
        k = 97 if c >= 0x80 or 65 <= c <= 90 or 97 <= c <= 122 else 48 if 48 <= c <= 57 else c
        if not out or out[-1] != k:
            out.append(k)
    return b"\x01" + bytes(out[:8])


def em(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[np.ndarray, np.ndarray, float]:
    """Posterior of good per pattern, vote rates (class, vote + 1, labeller), share of good; from pattern counts."""
    onehot = np.stack([patterns == v for v in (-1, 0, 1)]).astype(float)
    odds = np.log(FIRST_ACCURACY / (1 - FIRST_ACCURACY))
    post = 1 / (1 + np.exp(-np.clip(odds * patterns.sum(1), -20, 20)))
    rates, share = None, 0.5
    for _ in range(rounds):
        w = np.stack([(1 - post) * counts, post * counts])
        share = float(np.clip(w[1].sum() / counts.sum(), 1e-4, 1 - 1e-4))
        rates = np.einsum("cp,vpj->cvj", w, onehot) + 1.0
        rates /= rates.sum(axis=1, keepdims=True)
        z = np.log(share / (1 - share)) + np.einsum("vpj,vj->p", onehot, np.log(rates[1] / rates[0]))
        new = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        if np.abs(new - post).max() < 1e-6:
            post = new
            break
        post = new
    return post, rates, share


@dataclass
class QualityModel:
    weights: np.ndarray = field(default_factory=lambda: np.zeros(BUCKETS))
    bias: float = 0.0
    posteriors: dict[tuple[int, ...], float] = field(default_factory=dict)
    accuracies: np.ndarray | None = None
    share: float = 0.5
    words: dict[bytes, float] = field(default_factory=dict)  # cache, never pickled

    def __getstate__(self):
        return {**self.__dict__, "words": {}}

    def score(self, text: bytes) -> tuple[float, float]:
        """Score, and posterior of the votes."""
        m = looked_at(text)
        words, known, weights = text.split(), self.words, self.weights
        total = 0.0
        for w, times in Counter(words).items():
            try:
                total += times * known[w]
            except KeyError:
                weight = float(weights[bucket(w)] + weights[bucket(shape(w))])
                if len(w) <= CACHED_WORD:
                    if len(known) >= CACHED:
                        known.clear()
                    known[w] = weight
                total += times * weight
        z = self.bias + total / max(1, len(words)) + sum(float(weights[bucket(t.encode())]) for t in marks(m))
        return float(1 / (1 + np.exp(-np.clip(z, -50, 50)))), self.posteriors.get(votes(m), self.share)


def hashed_row(text: bytes) -> tuple[list[int], list[float]]:
    """Buckets and values of a text, as ``QualityModel.score`` weighs them."""
    words, out = text.split(), Counter()
    for w, times in Counter(words).items():
        out[bucket(w)] += times / len(words)
        out[bucket(shape(w))] += times / len(words)
    for t in marks(looked_at(text)):
        out[bucket(t.encode())] += 1.0
    return list(out), list(out.values())


def vote_pattern(text: Column) -> Column:
    """The votes of a text, joined by commas."""
    def run(column: pa.Array) -> pa.Array:
        return pa.array([",".join(map(str, votes(looked_at(t)))) for t in text_bytes(column)], pa.string())

    return F.arrow_udf(run, "string").asNondeterministic()(text)


def fit_quality(docs: DataFrame, fit_rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text") -> QualityModel:
    voted = stored(docs.select(F.col(id_col).cast("long").alias("doc_id"), vote_pattern(F.col(text_col)).alias("votes")),
                   "quality-votes")
    counted = voted.groupBy("votes").count().collect()  # at most 3^8 patterns
    if not counted:
        return QualityModel()
    patterns = np.array([[int(v) for v in r["votes"].split(",")] for r in counted])
    counts = np.array([r["count"] for r in counted], float)
    post, rates, share = em(patterns, counts)
    model = QualityModel(accuracies=rates, share=share, posteriors={tuple(p): float(q) for p, q in zip(patterns.tolist(), post)})
    # the sample holds each pattern by its share, a rare class at least as a sixth
    n = counts.sum()
    bad = float((counts * (1 - post)).sum())
    lift = {1: 1.0, 0: max(1.0, n / (6 * max(1.0, bad)))}
    by_pattern = {tuple(p): (q, min(1.0, fit_rows / n * lift[int(q >= 0.5)])) for p, q in zip(patterns.tolist(), post)}
    rate = F.create_map(*itertools.chain.from_iterable(
        (F.lit(",".join(map(str, p))), F.lit(r)) for p, (_, r) in by_pattern.items()))
    chosen = voted.where("doc_id is not null").where(
        F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < rate[F.col("votes")] * (1 << 30)).select(
        F.col("doc_id").alias("__id"), "votes").orderBy(F.xxhash64("__id"), "__id", "votes").limit(3 * fit_rows)  # bounded: broadcast
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [hashed_row(t) for t in text_bytes(batch.column(0))]
            yield pa.RecordBatch.from_arrays([
                batch.column(1), pa.array([a for a, _ in rows], pa.list_(pa.int32())),
                pa.array([v for _, v in rows], pa.list_(pa.float32()))], names=["votes", "at", "values"])

    # one row per id, so that the chosen ids bound the sample; it stays spread over the tasks
    got = collected(texts.join(F.broadcast(chosen), texts["doc_id"] == chosen["__id"]).groupBy("doc_id", "votes")
                    .agg(F.min("text").alias("text")).select("text", "votes").mapInArrow(run, "votes string, at array<int>, values array<float>"))
    if not len(got):
        model.bias = float(np.log(share / (1 - share)))
        return model
    target = np.array([by_pattern[tuple(map(int, v.split(",")))][0] for v in got["votes"]])
    target = np.clip(target, 1e-3, 1 - 1e-3)
    model.weights, model.bias = logistic(got["at"].tolist(), got["values"].tolist(), target, BUCKETS, l2=1e-5, steps=150)
    return model


@functools.lru_cache(maxsize=1)
def _loaded(packed: bytes) -> QualityModel:
    return pickle.loads(packed)


def quality_score(model: QualityModel, text: Column) -> Column:
    """struct(score, posterior); the model (BUCKETS weights) travels with the function."""
    packed = pickle.dumps(model)

    def score(column: pa.Array) -> pa.Array:
        own = _loaded(packed)
        both = [own.score(t) for t in text_bytes(column)]
        return pa.StructArray.from_arrays([pa.array([b[i] for b in both], pa.float64()) for i in (0, 1)],
                                          names=["score", "posterior"])

    return F.arrow_udf(score, "struct<score:double,posterior:double>").asNondeterministic()(text)


def quality_scores(docs: DataFrame, threshold: float = THRESHOLD, fit_rows: int = FIT_ROWS, id_col: str = "doc_id",
                   text_col: str = "text") -> DataFrame:
    """doc_id, score, posterior (of the votes alone), kept (score at or above the threshold)."""
    model = fit_quality(docs, fit_rows, id_col, text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), quality_score(model, F.col(text_col)).alias("q"))
    return rows.select("doc_id", "q.score", "q.posterior", (F.col("q.score") >= threshold).alias("kept"))
