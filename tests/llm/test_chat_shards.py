"""Operators 4 and 5."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tests.llm import brute
from tests.llm.conftest import EDGE, SF
from tests.oracle_compare import compare, duck

from matchspark.llm import chat, sharding
from matchspark.llm.common import shared_folder
from matchspark.llm.queries import QUERIES
from matchspark.llm.sql import ORACLE

PIECES = st.lists(st.sampled_from(["\\", "<s>", "</s>", "[INST] ", " [/INST]", " [/INST]</s>\n", "\n", "a", "é", "<", "[", ""]),
                  max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(PIECES, PIECES), min_size=1, max_size=6))
def test_round_trip(turns):
    roles, texts = [r.encode() for r, _ in turns], [t.encode() for _, t in turns]
    out, offsets, start, stop = chat.assemble(roles, texts)
    data = out.tobytes()
    assert list(chat.read_turns(data)) == list(zip(roles, texts))
    for i, (a, b) in enumerate(zip(start, stop)):
        assert chat.unescape(data[a:b]) == texts[i]
        assert list(chat.read_turns(data[offsets[i]:offsets[i + 1]])) == [(roles[i], texts[i])]


def test_control_strings_only_from_the_template():
    out, *_ = chat.assemble([b"user"], [b"</s>[INST] ok [/INST]"])
    assert out.tobytes() == b"<s>[INST] user\n\\</s>\\[INST] ok \\[/INST] [/INST]</s>\n"


def test_op4_oracle(spark):
    for sf in (SF, "/root/testdata/sf0.01"):
        r = compare(spark, "op4_chat", QUERIES["op4_chat"], ORACLE["op4_chat"], sf, duck(sf))
        assert r["match"], r


def test_op4_edges(spark, nothing):
    rows = [(1, 2, "assistant", "b"), (1, 1, "user", None), (1, 1, None, "x"), (None, 0, "user", "n"), (2, None, "assistant", ""),
            (3, 1, "assistant", "é" * 50_000), (3, 1, "assistant", "é" * 50_000), (4, 1, "as\nsistant", "\\")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'c' as piece", "1 as loss")
    got = {r["conv_id"]: tuple(r)[1:5] for r in chat.conversation_digests(chat.format_conversations(df)).collect()}
    fixed = [(c if c is not None else -9, t if t is not None else -1, r or "", t2 or "") for c, t, r, t2 in rows]
    want = {(c if c != -9 else None): v for c, v in brute.chat_digests(sorted(fixed)).items()}
    assert got == want
    empty = nothing.selectExpr("doc_id as conv_id", "doc_id as turn", "lang as role", "text")
    assert chat.conversation_digests(chat.format_conversations(empty)).count() == 0


def test_op4_conversation_over_many_batches(spark):
    n = 3000
    df = spark.range(n).selectExpr("7L as conv_id", "id as turn", "if(id % 2 = 0, 'user', 'assistant') as role",
                                   "concat('t', id, '<s>') as text")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        formatted = chat.format_conversations(df)
        assert formatted.count() == 30
        got = [tuple(r)[1:5] for r in chat.conversation_digests(chat.format_conversations(df)).collect()]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)
    rows = [(7, i, "assistant" if i % 2 else "user", f"t{i}<s>") for i in range(n)]
    assert got == [brute.chat_digests(rows)[7]]


def test_op5_oracle(spark):
    sf = "/root/testdata/sf0.01"
    r = compare(spark, "op5_extendible_sharding", QUERIES["op5_extendible_sharding"], ORACLE["op5_extendible_sharding"], sf, duck(sf))
    assert r["match"], r


@pytest.mark.parametrize("limit", [1 << 12, 1 << 15, 1 << 18])
def test_op5_brute_force(spark, table, limit):
    docs = table("documents", "doc_id, text")
    rows = sharding.assign_shards(spark.read.parquet(f"{SF}/documents.parquet"), limit).collect()
    want = brute.shards(docs, limit)
    assert {r["doc_id"]: r["shard"] for r in rows if not r["shard"].startswith("!")} == want
    assert len(rows) == len(docs)
    sizes = {}
    for r in rows:
        sizes[r["shard"]] = sizes.get(r["shard"], 0) + r["bytes"]
    for r in rows:
        assert r["shard_bytes"] == sizes[r["shard"]]
        assert r["shard_bytes"] <= limit or r["shard"].startswith("!")


def test_op5_copies_of_one_id(spark):
    """A third of all rows share an id, and many have none: their rows are split like any others."""
    df = spark.range(3000).selectExpr("if(id % 3 = 0, 5L, if(id % 3 = 1, id, null)) as doc_id", "repeat('x', 100) as text")
    rows = sharding.assign_shards(df, 2000).collect()
    assert len(rows) == 3000 and sum(r["bytes"] for r in rows) == 300_000
    assert all(r["shard_bytes"] <= 2000 for r in rows)
    assert sum(r["doc_id"] == 5 for r in rows) == 1000 and sum(r["doc_id"] is None for r in rows) == 1000


def test_op5_edges(spark, edge, nothing):
    rows = sharding.assign_shards(edge, 5000).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r[0]) for r in EDGE)
    for r in rows:
        assert r["shard_bytes"] <= 5000 or r["shard"].startswith("!")
    assert {r["doc_id"] for r in rows if r["shard"].startswith("!")} == {6, 7, 10}
    assert sharding.assign_shards(nothing).count() == 0


def _read_back(spark, docs, limit):
    folder = shared_folder(spark, "test-shards")
    sharding.write_shards(docs, folder, limit)
    return spark.read.parquet(folder)


def test_op5_written_copies_of_one_id(spark):
    """Every row is written once, whatever ids repeat or are missing, and no shard exceeds the limit."""
    df = spark.range(300).selectExpr("if(id % 3 = 0, 5L, if(id % 3 = 1, id, null)) as doc_id", "repeat('x', 100) as text", "id as n")
    got = _read_back(spark, df, 2000).collect()
    assert sorted(r["n"] for r in got) == list(range(300))
    assert {(r["n"], r["doc_id"]) for r in got} == {(r["n"], r["doc_id"]) for r in df.collect()}
    sizes = {}
    for r in got:
        sizes[r["__shard"]] = sizes.get(r["__shard"], 0) + 100
    assert max(sizes.values()) <= 2000 and len(sizes) >= 15


def test_op5_written_names(spark):
    """A single bucket and names of digits only are read back as the strings that were written."""
    df = spark.range(40).selectExpr("id as doc_id", "repeat('x', 100) as text")
    assert {r["__shard"] for r in _read_back(spark, df, 1 << 20).collect()} == {"s_"}
    want = {(r["doc_id"], "s_" + r["shard"]) for r in sharding.assign_shards(df, 1000).collect()}
    assert {(r["doc_id"], r["__shard"]) for r in _read_back(spark, df, 1000).collect()} == want


def test_op5_written_edges(spark, edge, nothing):
    back = _read_back(spark, edge, 5000)
    assert back.columns == [*edge.columns, "__shard"]
    got = back.collect()
    assert sorted(map(str, (tuple(r)[:-1] for r in got))) == sorted(map(str, map(tuple, edge.collect())))
    assert {r["doc_id"] for r in got if r["__shard"].startswith("s_!")} == {6, 7, 10}
    folder = shared_folder(spark, "test-shards")
    sharding.write_shards(nothing, folder)
    assert spark.read.schema(nothing.schema).parquet(folder).count() == 0


def test_op5_is_native(spark):
    plan = sharding.assign_shards(spark.read.parquet(f"{SF}/documents.parquet"), 1 << 15)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_hex_bits(spark):
    row = spark.range(1).select(sharding.hex_bits(sharding.F.md5(sharding.F.lit("7").cast("binary"))).alias("b")).first()
    assert row["b"] == bin(int(hashlib.md5(b"7").hexdigest(), 16))[2:].zfill(128)
    assert np.array(list(row["b"])).size == 128
