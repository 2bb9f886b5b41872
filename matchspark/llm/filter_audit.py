r"""Operator 13: filter interaction audit by contraction of contingency tensors.

Five filters look at every whole text once; a document is then one cell of a 2x2x2x2x2 table (pass or fail along each
axis). The cells are counted per part in Spark; what any order of the filters keeps, removes or finds already gone is a
contraction of that tensor: along each axis the step selects pass ``[1, 0]``, fail ``[0, 1]`` or all ``[1, 1]``, and one
``einsum`` gives all 600 steps of the 120 orders.

Words are the maximal runs of ``[^\x20\x09-\x0D]``. A document fails
A with fewer than 100 words, B if 100 * distinct words < 80 * words, C if 100 * letters A-Z > 10 * code points, D if it holds
one of ``#$%&*|``, E if its text equals that of a smaller id anywhere in the table, kept or not.

Texts are compared by SHA-256; of each digest only counts and smallest ids per (part, outcome, labels) are shuffled, after partial
aggregation, so a text that a third of all documents share is a few rows.

Defined cases: a null text counts as empty (equal to every empty text), a null part as the empty string; a row without an
id neither fails E nor makes another fail; rows that repeat an id and a text are equal to each other but not to a smaller id,
so E spares them together; of repeated labels an id is good or toxic if any row says so; texts of any length are read whole,
a few megabytes of words at a time; an empty table gives no rows; further columns with any name are not read.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchspark.llm.common import batch_slices, bytes_of

FILTERS = "ABCDE"
MIN_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT, SYMBOLS = 100, 80, 10, b"#$%&*|"
CAPITALS = bytes(range(ord("A"), ord("Z") + 1))
INSIDE = bytes(range(0x80, 0xC0))      # continuation bytes of UTF-8: all others start a code point
WORD = re.compile(rb"[^\x20\x09-\x0D]+")
LONG = 1 << 22                         # longer texts are not split into a list of all words
ORDERS = ["".join(p) for p in itertools.permutations(FILTERS)]
PASS, FAIL, ALL = (1, 0), (0, 1), (1, 1)
MEASURES = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
SCHEMA = "part string, filter_order string, step int, " + ", ".join(f"{m} long" for m in MEASURES)


def text_flags(raw: bytes) -> int:
    """Bits 0 to 3: the text fails A, B, C, D."""
    if len(raw) <= LONG:
        words = raw.split()            # bytes split at \x20 and \x09-\x0D
        n, distinct = len(words), len(set(words))
    else:
        n, seen = 0, set()
        for m in WORD.finditer(raw):
            n += 1
            seen.add(m.group())
        distinct = len(seen)
    capitals = len(raw) - len(raw.translate(None, CAPITALS))
    points = len(raw) if raw.isascii() else len(raw.translate(None, INSIDE))
    return ((n < MIN_WORDS) | (100 * distinct < DISTINCT_PERCENT * n) << 1 | (100 * capitals > CAPITAL_PERCENT * points) << 2
            | (len(raw.translate(None, SYMBOLS)) < len(raw)) << 3)


def text_outcomes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """doc_id, part, flags (A to D), digest of every document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in batch_slices(whole, 2):
                texts = bytes_of(batch.column(2))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array(map(text_flags, texts), pa.int32()),
                     pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())],
                    names=["doc_id", "part", "flags", "digest"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"),
                       F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, part string, flags int, digest binary")


def contingency(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """part, flags (A to D), good, toxic, and the documents that pass E (``e_pass``) and fail it (``e_fail``)."""
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    cell = ["part", "flags", "good", "toxic"]
    rows = text_outcomes(docs, id_col, text_col, part_col).join(marks, "doc_id", "left").na.fill(False, ["good", "toxic"])
    by_id = rows.groupBy("digest", "doc_id", *cell).agg(F.count("*").alias("n"))
    by_text = by_id.groupBy("digest", *cell).agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("no_id"),
        F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "n"))).alias("least"))
    first = F.min("least.doc_id").over(Window.partitionBy("digest"))   # a few rows per text: its cells
    spared = F.col("no_id") + F.when(F.col("least.doc_id") == F.col("first"), F.col("least.n")).otherwise(0)
    return (by_text.withColumn("first", first).withColumn("e_pass", spared)
            .groupBy(*cell).agg(F.sum("e_pass").alias("e_pass"), F.sum(F.col("n") - F.col("e_pass")).alias("e_fail")))


def selectors() -> dict[str, np.ndarray]:
    """For each selection an array (600 steps, 5 axes, 2): what the step takes along each axis."""
    out = {k: [] for k in ("kept", "removed", "failing", "unique")}
    for order in ORDERS:
        for step, f in enumerate(order):
            before, axis = order[:step], FILTERS.index(f)
            rows = {"kept": [PASS if g in before else ALL for g in FILTERS], "removed": [PASS if g in before else ALL for g in FILTERS],
                    "failing": [ALL] * 5, "unique": [PASS] * 5}
            for k, v in rows.items():
                v[axis] = PASS if k == "kept" else FAIL
                out[k].append(v)
    return {k: np.array(v, np.int64) for k, v in out.items()}


def contract(tensors: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """(w, 2, 2, 2, 2, 2) counts and (n, 5, 2) selections: (w, n) sums."""
    return np.einsum("wabcde,na,nb,nc,nd,ne->wn", tensors, *(chosen[:, i] for i in range(5)))


def steps_of(tensors: np.ndarray) -> dict[str, np.ndarray]:
    """The measures of all 600 steps from the tensors of all, the good and the toxic documents (3, 2, 2, 2, 2, 2)."""
    take = selectors()
    removed = contract(tensors, take["removed"])
    first = tensors[:1]
    which = np.array([FILTERS.index(f) for order in ORDERS for f in order])
    total = np.zeros(5, np.int64)
    np.add.at(total, which, removed[0])
    return {"kept": contract(first, take["kept"])[0], "removed": removed[0], "redundant": contract(first, take["failing"])[0] - removed[0],
            "unique_fails": contract(first, take["unique"])[0], "good_lost": removed[1], "toxic_lost": removed[2], "shapley": total[which]}


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """One row per part, order of the five filters and step, with the measures of that step."""
    names = [o for o in ORDERS for _ in FILTERS]

    def audit(table: pa.Table) -> pa.Table:
        tensors = np.zeros((3, 2, 2, 2, 2, 2), np.int64)
        for row in table.to_pylist():
            at = tuple(row["flags"] >> i & 1 for i in range(4))
            counts = (row["e_pass"], row["e_fail"])
            for w, takes in enumerate((True, row["good"], row["toxic"])):
                if takes:
                    tensors[(w, *at)] += counts
        found = steps_of(tensors)
        return pa.table({"part": pa.array([table["part"][0].as_py()] * len(names), pa.string()), "filter_order": pa.array(names, pa.string()),
                         "step": pa.array(list(range(1, 6)) * len(ORDERS), pa.int32()), **{m: pa.array(found[m], pa.int64()) for m in MEASURES}})

    return contingency(docs, labels, id_col, text_col, part_col).groupBy("part").applyInArrow(audit, SCHEMA)
