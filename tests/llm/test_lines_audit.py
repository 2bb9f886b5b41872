"""Operators 12 and 13."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tests.llm import brute
from tests.llm.conftest import EDGE, SF
from tests.oracle_compare import compare, duck

from matchspark.llm import filter_audit, line_dedup
from matchspark.llm.queries import QUERIES
from matchspark.llm.sql import ORACLE

PASSAGE = "A line that many documents share, long enough to count as one"


@pytest.mark.parametrize("name", ["op12_line_dedup", "op13_filter_audit"])
def test_oracle(spark, name):
    sf = "/root/testdata/sf0.01"
    r = compare(spark, name, QUERIES[name], ORACLE[name], sf, duck(sf))
    assert r["match"], r


@settings(max_examples=50, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**64 - 1), max_size=30), max_size=6), st.sampled_from([1 << 6, 1 << 12]))
def test_merged_filters_lose_no_hash_seen_twice(tasks, bits):
    pairs = []
    for task in tasks:
        once, twice = line_dedup.Bloom(bits), line_dedup.Bloom(bits)
        for i in range(0, len(task), 7):
            line_dedup.add_once_twice(once, twice, np.array(task[i:i + 7], np.uint64))
        pairs.append((once.data, twice.data))
    a, b = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
    for x, y in pairs:
        b |= y | (a & x)
        a |= x
    every = [h for t in tasks for h in t]
    again = np.array([h for h in every if every.count(h) > 1], np.uint64)
    assert not len(again) or line_dedup.Bloom(bits, b).has(again).all()


def lines_of(out):
    return sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_lines"], r["n_dropped"], r["text"]) for r in out.collect())


@pytest.mark.parametrize("bits, keys", [(1 << 29, 200_000), (1 << 12, 200_000), (1 << 12, 0), (1 << 20, 0)])
def test_op12_brute_force(spark, table, bits, keys):
    """Full filters and both ways of dropping give the same lines."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(7)
    got = lines_of(line_dedup.line_dedup(docs, max_bits=bits, broadcast_keys=keys))
    want = brute.line_dedup(table("documents", "doc_id, text"))
    assert got == sorted((i, *v) for i, v in want.items())
    assert sum(x[2] for x in got) > 0


@pytest.mark.parametrize("keys", [200_000, 0])
def test_op12_edges(spark, edge, nothing, keys):
    own = [(i, f"  {PASSAGE}\t\nown {i}\n{PASSAGE.upper()}\r" + "\nshort" * 3) for i in range(20, 26)]
    own += [(30 + i, "é" * 39 + "\n" + "É" * 40 + "\n\n") for i in range(5)] + [(40, PASSAGE), (41, "x\r\ny")]
    df = edge.select("doc_id", "text").unionByName(spark.createDataFrame(own, "doc_id long, text string"))
    rows = [(i, t) for i, t, _ in EDGE] + own
    got = lines_of(line_dedup.line_dedup(df.selectExpr("*", "1 as h", "'x' as digest", "2 as n_lines", "'y' as text_key"), broadcast_keys=keys))
    held = brute.line_dedup([r for r in rows])
    by_text = {}
    for i, t in rows:      # the brute force keeps one row per id: null ids occur twice in EDGE
        by_text.setdefault(-1 if i is None else i, []).append(t)
    assert len(got) == len(rows)
    assert {x for x in got if x[0] != -1} == {(i, *v) for i, v in held.items() if i is not None}
    assert sorted(x for x in got if x[0] == -1) == [(-1, 1, 0, ""), (-1, 1, 0, "no id")]
    assert (25, 6, 2, "own 25\nshort\nshort\nshort") in got and (40, 1, 0, PASSAGE) in got and (34, 4, 0, own[10][1]) in got
    assert line_dedup.line_dedup(nothing, broadcast_keys=keys).count() == 0


def test_op12_one_line_in_a_third_of_all_documents(spark):
    df = spark.range(3000).selectExpr("id as doc_id", f"if(id % 3 = 0, concat('{PASSAGE}\\n', id), concat('only here {'y' * 40} ', id)) as text").repartition(12)
    for keys in (200_000, 0):
        got = {r["doc_id"]: r for r in line_dedup.line_dedup(df, broadcast_keys=keys).collect()}
        assert sum(r["n_dropped"] for r in got.values()) == 999 and got[2997]["n_dropped"] == 0 and got[3]["text"] == "3"


def audit_rows(out):
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[m] for m in filter_audit.MEASURES) for r in out.collect()}


def test_op13_brute_force(spark, table):
    docs, labels = table("documents", "doc_id, text, lang"), table("labels", "doc_id, quality, toxic")
    assert audit_rows(QUERIES["op13_filter_audit"](spark, SF)) == brute.filter_audit(docs, labels)


def test_op13_edges(spark, edge, nothing):
    words100 = " ".join(f"w{i}" for i in range(100))
    own = [(50, words100, "en"), (51, words100, "de"), (52, words100, None), (53, words100 + " a" * 30, "en"), (53, words100 + " a" * 30, "en"),
           (54, "A" * 10 + "b" * 90, "en"), (55, "A" * 11 + "b" * 89, "en"), (56, "é# x", "xx"), (None, words100, "en"), (None, words100, "en")]
    labels = [(50, 1, 0), (50, 0, None), (51, None, 1), (53, 1, 1), (None, 1, 1), (99, 1, 1)]
    df = edge.select("doc_id", "text", "lang").unionByName(spark.createDataFrame(own, "doc_id long, text string, lang string"))
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "'x' as digest", "1 as n")
    got = audit_rows(filter_audit.filter_audit(df.selectExpr("*", "'x' as flags", "0 as good", "1 as part", "2 as step"), marks))
    assert got == brute.filter_audit(EDGE + own, labels)
    assert {k[0] for k in got} == {"en", "de", "fr", "", "xx"} and len(got) == 5 * 600
    assert filter_audit.filter_audit(nothing, marks).count() == 0


def test_long_texts_count_like_short_ones(monkeypatch):
    text = ("Word word  x#y\n" * 400).encode()
    want = filter_audit.text_flags(text)
    monkeypatch.setattr(filter_audit, "LONG", 100)
    assert filter_audit.text_flags(text) == want == 0b1010
