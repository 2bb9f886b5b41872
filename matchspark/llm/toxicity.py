"""Operator 10: toxicity by weak supervision.

1. **Voters.** From all labelled training rows (near copies counted once), words and word beginnings that stand in toxic documents far more often than
   elsewhere (log-likelihood ratio) are mined in one aggregate; by kind and rank they are dealt to
   ``LEXICON_VOTERS`` lexicon voters. A lexicon voter votes toxic if the text has an entry of it, else abstains. Pattern
   voters look at the density and number of different entries, exclamation marks, capitals and address, and may vote either way.
2. **Label model.** A generative model of the votes given a hidden label: class-wise vote rates (the
   accuracies) and correlations of each pair of voters within a class, by expectation-maximisation over a
   sample, anchored by its labels; the share of toxic rows is that of all training rows. Correlated voters share their weight: a voter's log-odds are divided by one plus the
   sum of its positive correlations.
3. **Classifier.** A logistic regression over entry counts and pattern values, trained on the posterior labels,
   the rows of a class weighed so that it counts as it does among all training rows. Its score is the result.

Labels are learned only from rows whose crc32(id as text) mod 3 is not 1. language, source, id and labels are
never inputs of a score. The sample of steps 2 and 3 holds about ``FIT_ROWS`` labelled rows at most, chosen by a hash of the id within
each class: all toxic rows up to half of it. Scoring covers all rows and whole texts in a map over the scan.

Defined cases: null and empty texts get the classifier's score for a text without entries; null ids are not used for
training and are not held out; labels that contradict each other count as toxic; without labels of both classes every score
is 0, without a lexicon entry the patterns alone decide; repeated rows get equal scores (of rows that share an id the smallest text is trained on).
"""

from __future__ import annotations

import functools
import pickle
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchspark.llm import simhash
from matchspark.llm.common import BROADCAST_IDS, CACHED_WORD, batch_slices, collected, stored, text_bytes, texts_of

FIT_ROWS = 20_000       # labelled rows of the training sample, about
COUNTED = 200_000       # entries a task counts before it hands them on
LEXICON = 4_000         # entries at most
LEXICON_VOTERS = 32
PREFIXES = (3, 4, 5)    # word beginnings looked at
MIN_ROWS = 3            # toxic training rows an entry needs
CHANCE_ENTRIES = 5      # entries expected to pass by chance
MIN_ODDS = 3.0          # log-odds an entry needs: words that are merely common in long texts don't count
STRONG_ODDS = 5.0
CACHED = 100_000        # words in a worker's cache
THRESHOLD = 0.7
EDGES = ".,;:!?\"'()[]{}<>#*$%&|"
ADDRESS = frozenset(("you", "your", "du", "dich", "ihr", "tu", "toi", "vous", "usted", "eres"))
PATTERNS = ("density", "entries", "strong", "exclaim", "capitals", "address")


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def entries_of(word: str) -> list[str]:
    """What a lexicon may hold of a word: itself, and its beginnings marked by ``^``."""
    word = word.strip(EDGES)
    return [word, *("^" + word[:k] for k in PREFIXES if len(word) > k)] if word else []


def mine_lexicon(labelled: DataFrame, n1: int, n0: int, most: int = LEXICON) -> list[tuple[str, float]]:
    """(entry, log-odds of toxic), strongest first. ``labelled``: text, toxic; n1 rows are toxic, n0 not. Rows are counted
    per task before the shuffle, a bounded number of entries at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = {0: Counter(), 1: Counter()}

        def counted() -> pa.RecordBatch:
            names = list(count[0] | count[1])
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(
                pa.array([count[k][e] for e in names], pa.int64()) for k in (1, 0))], names=["entry", "toxic", "clean"])

        for whole in batches:
            for batch in batch_slices(whole, 0):
                for text, toxic in zip(texts_of(batch.column(0)), batch.column(1).to_pylist()):
                    count[toxic].update({e for w in set(text.lower().split()) for e in entries_of(w)})
                    if len(count[0]) + len(count[1]) >= COUNTED:
                        yield counted()
                        count = {0: Counter(), 1: Counter()}
        yield counted()

    rows = (labelled.select("text", "toxic").mapInArrow(run, "entry string, toxic long, clean long").groupBy("entry")
            .agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c")).where(f"t >= {MIN_ROWS} and t * {n0} > 2 * c * {n1}"))
    share = (F.col("t") + F.col("c")) / (n1 + n0)

    def part(seen: Column, expected: Column) -> Column:
        return F.when(seen > 0, seen * F.log(seen / expected)).otherwise(0.0)

    llr = 2 * (part(F.col("t"), n1 * share) + part(F.col("c"), n0 * share)
               + part(n1 - F.col("t"), n1 * (1 - share)) + part(n0 - F.col("c"), n0 * (1 - share)))
    odds = F.log((F.col("t") + 0.5) / (n1 + 1)) - F.log((F.col("c") + 0.5) / (n0 + 1))
    rows = stored(rows.select("entry", llr.alias("llr"), odds.alias("odds")), "toxic-entries")
    # a ratio of x arises by chance with probability of about exp(-x / 2): a few chance entries among all
    enough = max(8.0, 2 * np.log(max(1, rows.count()) / CHANCE_ENTRIES))
    top = rows.where((F.col("llr") > float(enough)) & (F.col("odds") > MIN_ODDS)).orderBy(F.desc("llr"), "entry").limit(most)
    return [(r["entry"], r["odds"]) for r in top.collect()]


@dataclass
class ToxicityModel:
    entries: dict[str, int] = field(default_factory=dict)
    odds: np.ndarray = field(default_factory=lambda: np.zeros(0))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = -50.0
    accuracies: np.ndarray | None = None
    correlations: np.ndarray | None = None
    words: dict[str, tuple | None] = field(default_factory=dict)  # cache, never pickled

    def __getstate__(self):
        return {**self.__dict__, "words": {}}

    def _look(self, word: str) -> tuple | None:
        """(entries, strong, capitals, address) of a word as written; None if there is nothing to it."""
        lower = word.lower()
        found = tuple(self.entries[e] for e in entries_of(lower) if e in self.entries)
        strong = bool(found) and max(self.odds[e] for e in found) > STRONG_ODDS
        capitals, address = len(word) > 2 and word.isupper(), lower in ADDRESS
        return (found, strong, capitals, address) if found or capitals or address else None

    def row(self, text: str) -> tuple[dict[int, int], list[float]]:
        """Counts of lexicon entries, and the values of PATTERNS."""
        words, known = text.split(), self.words
        hits: Counter = Counter()
        strong = capitals = address = 0
        for w, times in Counter(words).items():
            try:
                found = known[w]
            except KeyError:
                found = self._look(w)
                if len(w) <= CACHED_WORD:
                    if len(known) >= CACHED:
                        known.clear()
                    known[w] = found
            if found is not None:
                for e in found[0]:
                    hits[e] += times
                strong += times * found[1]
                capitals += times * found[2]
                address += times * found[3]
        n = max(1, len(words))
        return hits, [100 * strong / n, float(len(hits)), float(strong), 100 * text.count("!") / n, capitals / n,
                      100 * address / n]

    def features(self, hits: dict[int, int], patterns: list[float]) -> tuple[list[int], list[float]]:
        m = len(self.entries)
        return ([*hits, *range(m, m + len(PATTERNS))],
                [*(np.log1p(c) for c in hits.values()), *np.log1p(patterns).tolist()])

    def score(self, text: str) -> float:
        at, values = self.features(*self.row(text))
        z = self.bias if not len(self.weights) else self.bias + float(np.dot(self.weights[at], values))
        return float(1 / (1 + np.exp(-np.clip(z, -50, 50))))


def votes_of(model: ToxicityModel, rows: list[tuple[dict[int, int], list[float]]]) -> np.ndarray:
    """Rows x voters: 1 toxic, -1 clean, 0 no vote."""
    kind = np.array([0 if not e.startswith("^") else len(e) - 1 for e in model.entries], np.int64)
    kinds = sorted(set(kind.tolist()))
    voter = np.zeros(len(kind), np.int64)
    per = max(1, LEXICON_VOTERS // max(1, len(kinds)))
    for i, k in enumerate(kinds):
        own = np.flatnonzero(kind == k)  # by rank: neighbours in strength go to different voters
        voter[own] = i * per + np.arange(len(own)) % per
    votes = np.zeros((len(rows), LEXICON_VOTERS + len(PATTERNS)), np.int8)
    for r, (hits, p) in enumerate(rows):
        for e in hits:
            votes[r, voter[e]] = 1
        votes[r, LEXICON_VOTERS:] = [
            1 if p[0] >= 0.8 else -1 if p[0] < 0.2 else 0, 1 if p[1] >= 4 else -1 if p[1] < 2 else 0,
            1 if p[2] >= 2 else -1 if p[2] < 1 else 0, 1 if p[3] >= 5 else 0, 1 if p[4] >= 0.3 else 0, 1 if p[5] >= 2 else 0]
    return votes


def label_model(votes: np.ndarray, labels: np.ndarray, rounds: int = 25, share_toxic: float | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of each row given its votes, vote rates (class, vote + 1, voter) and within-class correlations, by EM.

    ``share_toxic`` is the share of toxic rows where the sample was drawn, if not that of ``labels``. The E-step sees votes only. The M-step weighs rows by the mean of label and posterior: the labels keep the classes
    from drifting into what correlated voters agree on, the posteriors overrule single wrong labels."""
    labels = labels.astype(float)
    prior = float(np.clip(labels.mean() if share_toxic is None else share_toxic, 1e-4, 1 - 1e-4))
    onehot = np.stack([votes == v for v in (-1, 0, 1)]).astype(float)
    varied = (votes != votes[:1]).any(axis=0)  # a voter without entries says the same of every row, that is nothing
    post, rates, corr = labels, None, None
    for _ in range(rounds):
        own = (labels + post) / 2
        weight = np.stack([1 - own, own])
        rates = np.einsum("cr,vrj->cvj", weight, onehot) + 1.0
        rates /= rates.sum(axis=1, keepdims=True)
        corr = np.zeros((votes.shape[1], votes.shape[1]))
        for w in weight:
            if w.sum() < 1:
                continue
            d = votes - (w[:, None] * votes).sum(0) / w.sum()
            cov = (d * w[:, None]).T @ d / w.sum()
            sd = np.sqrt(np.maximum(np.diag(cov), 0))
            both = np.outer(sd, sd)
            corr += np.where(both > 1e-4, cov / np.maximum(both, 1e-4), 0) / 2
        np.fill_diagonal(corr, 0)
        share = varied / (1 + np.maximum(corr, 0).sum(0))
        z = np.log(prior / (1 - prior)) + np.einsum("vrj,vj,j->r", onehot, np.log(rates[1] / rates[0]), share)
        new = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        done = np.abs(new - post).max() < 1e-4
        post = new
        if done:
            break
    return post, rates, corr


def logistic(at: list[list[int]], values: list[list[float]], target: np.ndarray, size: int, l2: float = 1e-4,
             steps: int = 400, rate: float = 0.1, weight: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Weights and bias for soft targets of rows of some weight: full-batch gradient steps with momentum and scaling (Adam)."""
    row = np.repeat(np.arange(len(at)), [len(a) for a in at])
    col = np.fromiter((i for a in at for i in a), np.int64, len(row))
    val = np.fromiter((v for a in values for v in a), float, len(row))
    weight = np.ones(len(at)) if weight is None else weight * len(at) / weight.sum()
    mean = float(np.clip(np.average(target, weights=weight), 1e-4, 1 - 1e-4))
    w, b = np.zeros(size), float(np.log(mean / (1 - mean)))
    m, v = np.zeros(size + 1), np.zeros(size + 1)
    for t in range(1, steps + 1):
        z = np.bincount(row, val * w[col], len(at)) + b
        err = weight * (1 / (1 + np.exp(-np.clip(z, -50, 50))) - target) / len(at)
        g = np.append(np.bincount(col, val * err[row], size) + l2 * w, err.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = rate * (m / (1 - 0.9 ** t)) / (np.sqrt(v / (1 - 0.999 ** t)) + 1e-10)
        w, b = w - move[:-1], b - move[-1]
    return w, b


def labelled_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text, toxic of all labelled rows that are not held out: one row per id, and one of each group of near copies
    (by SimHash), so that the words of a text with many copies don't pass for a lexicon; of a group with both labels
    one row of each."""
    truth = (labels.where("doc_id is not null and toxic is not null").where(~held_out())
             .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")))
    truth = stored(truth.where("toxic in (0, 1)").select(F.col("doc_id").alias("__id"), "toxic"), "toxic-truth")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.join(_side(truth), rows["doc_id"] == truth["__id"])
    rows = stored(rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
                  .select("doc_id", "text", "toxic", F.monotonically_increasing_id().alias("row")), "toxic-labelled")
    near = simhash.near_duplicates(rows, id_col="row").select(F.col("doc_id").alias("row"), "component_id")
    first = near.join(rows.select("row", "toxic"), "row").groupBy("component_id", "toxic").agg(F.min("row").alias("row"))
    return rows.join(_side(stored(first.select("row"), "toxic-first")), "row").select("doc_id", "text", "toxic")


def _side(ids: DataFrame) -> DataFrame:
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def training_sample(labelled: DataFrame, n1: int, n0: int, fit_rows: int) -> DataFrame:
    """text, toxic of about ``fit_rows`` of the n1 toxic and n0 other rows: all toxic ones up to half of ``fit_rows``, and
    more if the others leave room."""
    toxic = min(n1, max(fit_rows // 2, fit_rows - n0))
    clean = min(n0, fit_rows - toxic)
    share = F.when(F.col("toxic") == 1, toxic / n1).otherwise(clean / n0)
    return labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share * (1 << 30)).select("text", "toxic")


def fit_toxicity(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, id_col: str = "doc_id",
                 text_col: str = "text") -> ToxicityModel:
    labelled = labelled_rows(docs, labels, id_col, text_col)
    n = {r["toxic"]: r["count"] for r in labelled.groupBy("toxic").count().collect()}
    if len(n) < 2:
        return ToxicityModel()
    lexicon = mine_lexicon(labelled, n[1], n[0])
    model = ToxicityModel({e: i for i, (e, _) in enumerate(lexicon)}, np.array([o for _, o in lexicon]))
    packed = pickle.dumps(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pickle.loads(packed)
        for batch in batches:
            rows = [own.row(t.decode()) for t in text_bytes(batch.column(0))]
            yield pa.RecordBatch.from_arrays([
                batch.column(1), pa.array([list(h) for h, _ in rows], pa.list_(pa.int32())),
                pa.array([list(h.values()) for h, _ in rows], pa.list_(pa.int32())),
                pa.array([p for _, p in rows], pa.list_(pa.float64()))], names=["toxic", "entries", "counts", "patterns"])

    got = collected(training_sample(labelled, n[1], n[0], fit_rows).mapInArrow(  # bounded by fit_rows
        run, "toxic int, entries array<int>, counts array<int>, patterns array<double>"))
    rows = [(dict(zip(e.tolist(), c.tolist())), p.tolist()) for e, c, p in zip(got["entries"], got["counts"], got["patterns"])]
    start = got["toxic"].to_numpy(float)
    post, model.accuracies, model.correlations = label_model(votes_of(model, rows), start, share_toxic=n[1] / (n[0] + n[1]))
    weight = np.where(start == 1, n[1] / max(1, start.sum()), n[0] / max(1, (1 - start).sum()))  # rows that one stands for
    pairs = [model.features(h, p) for h, p in rows]
    model.weights, model.bias = logistic([a for a, _ in pairs], [v for _, v in pairs], post, len(lexicon) + len(PATTERNS),
                                          weight=weight)
    return model


@functools.lru_cache(maxsize=1)
def _loaded(packed: bytes) -> ToxicityModel:
    return pickle.loads(packed)


def toxicity_score(model: ToxicityModel, text: Column) -> Column:
    """Score column; the model (bounded by LEXICON entries) travels with the function."""
    packed = pickle.dumps(model)

    def score(column: pa.Array) -> pa.Array:
        own = _loaded(packed)
        return pa.array([own.score(t.decode()) for t in text_bytes(column)], pa.float64())

    return F.arrow_udf(score, "double").asNondeterministic()(text)


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, fit_rows: int = FIT_ROWS,
                    id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted for every row."""
    model = fit_toxicity(docs, labels, fit_rows, id_col, text_col)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"),
                       toxicity_score(model, F.col(text_col)).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, fit_rows: int = FIT_ROWS,
               id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score is below the threshold."""
    model = fit_toxicity(docs, labels, fit_rows, id_col, text_col)
    scored = docs.withColumn("__toxicity", toxicity_score(model, F.col(text_col)))
    return scored.where(F.col("__toxicity") < threshold).drop("__toxicity")
