"""Operator 11: conversation structure repair."""

import sys
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tests.llm import brute
from tests.llm.conftest import SF
from tests.oracle_compare import compare, duck

from matchspark.llm import structure
from matchspark.llm.queries import QUERIES
from matchspark.llm.sql import ORACLE

SCHEMA = "conv_id long, turn long, role string, text string"
TURNS = st.lists(st.tuples(st.sampled_from(["system", "user", "assistant", "tool", ""]), st.sampled_from(["a.", "b", " ", "c!", "d?", "e"])), max_size=9)


def local_rules(strings):
    """Re-Pair of a few strings in one process."""
    rules = []
    while len(rules) < 40:
        code = structure.compress("\n".join(strings), rules)
        pairs = [code[i:i + 2] for i in range(len(code) - 1) if "\n" not in code[i:i + 2]]
        if not pairs or pairs.count(best := max(sorted(set(pairs)), key=pairs.count)) < 2:
            break
        rules.append(best)
    return rules


def symbols(rows):
    seen, out = set(), []
    for role, text in rows:
        last = text.rstrip(brute.BLANK)[-1:]
        fault = "blank" if not last else "duplicate" if (role, text) in seen else "none" if last in ".!?" else "truncated"
        seen.add((role, text))
        initial = role[:1] if role[:1] in ("s", "u", "a") else "o"
        out.append(structure.SYMBOLS[4 * structure.INITIALS.index(initial) + structure.FAULTS.index(fault)])
    return "".join(out)


@settings(max_examples=300, deadline=None)
@given(st.lists(TURNS, min_size=1, max_size=5), st.integers(1, 5))
def test_program_equals_brute_force(conversations, size):
    strings = [symbols(rows) for rows in conversations]
    rules = local_rules(strings)
    program, plain = structure.Program(rules), structure.Program([])
    for rows, s in zip(conversations, strings):
        want = brute.repaired(rows)[4:6]
        assert program.audit([structure.compress(s, rules)]) == want
        assert plain.audit([structure.compress(s, [])]) == want
        assert program.audit([structure.compress(s[i:i + size], rules) for i in range(0, len(s), size)] or [""]) == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from("DIKR"), max_size=9), st.lists(st.sampled_from("DIKR"), max_size=9), st.integers(0, 9), st.integers(0, 9))
def test_rope_order_is_string_order(p, q, i, j):
    ropes = structure.Ropes()
    shared = ropes.of("KD")

    def rope(letters, cut):
        a, b = (ropes.of(x) for x in ("".join(letters[:cut]), "".join(letters[cut:])))
        return ropes.cat(ropes.cat(a, shared), b)

    x, y = rope(p, i), rope(q, j)
    assert ropes.less((x,), (y,)) == (ropes.text(x) < ropes.text(y))


def test_a_rule_is_shared_and_long_runs_shrink():
    rules = local_rules(["EI" * 64] * 2)
    assert len(structure.compress("EI" * 64, rules)) <= 2
    program = structure.Program(rules)
    assert program.audit([structure.compress("EI" * 64, rules)]) == (0, "K" * 128)
    assert len(program.ropes.leaf) < 40 * (len(rules) + 10)


@pytest.mark.parametrize("sf", [SF, "/root/testdata/sf0.01"])
def test_op11_oracle(spark, sf):
    r = compare(spark, "op11_structure_repair", QUERIES["op11_structure_repair"], ORACLE["op11_structure_repair"], sf, duck(sf))
    assert r["match"], r


def test_op11_brute_force(spark, table):
    rows = []
    for conv, turn, role, text in table("conversations", "conv_id, turn, role, text"):
        kind = zlib.crc32(f"{conv}:{turn}".encode()) % 20
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        rows += [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    want = brute.structure_reports(rows)
    got = {r[0]: tuple(r)[1:] for r in QUERIES["op11_structure_repair"](spark, SF).collect()}
    for conv, v in got.items():
        assert v == want.get(conv, (0, 0, 0, 0, 0, 0, "", brute.sha("")))


EDGE_TURNS = [
    (1, 0, "user", None), (1, None, "user", "first."), (1, 2, None, "who?"), (None, 1, "user", "n."), (None, 0, "system", "s."), (2, 5, "assistant", ""),
    (3, 1, "assistant", "é" * 50_000), (3, 1, "assistant", "é" * 50_000), (3, 1, "user", "tie."), (4, 0, "", "x."), (4, 1, "useless", "y."), (4, 2, "a", "z."),
    (5, None, "user", "q."), (5, None, "assistant", "r!"),
]


@pytest.mark.parametrize("chunk", [2, 1024])
def test_op11_edges(spark, chunk):
    df = spark.createDataFrame(EDGE_TURNS, SCHEMA).selectExpr("*", "'x' as d", "1 as part", "'y' as symbols", "'z' as audit", "true as real")
    more = spark.createDataFrame([(9,), (1,), (None,)], "conv_id long")
    out = structure.conversation_reports(structure.repair(df, more, chunk=chunk))
    got = {r[0]: tuple(r)[1:] for r in out.collect()}
    fixed = [(c, t, r if r is not None else " ", x if x is not None else " ") for c, t, r, x in EDGE_TURNS]
    assert got == brute.structure_reports(fixed) | {9: (0, 0, 0, 0, 0, 0, "", brute.sha(""))}


def test_op11_long_conversation_over_tasks_and_batches(spark):
    """One conversation holds most rows: it spans range partitions, chunks and Arrow batches; its repaired rows come back whole."""
    rows = [(7, i, ("user", "assistant", "user", "tool")[i * i % 4], f"t{i % 50}{'.' if i % 3 else ''}") for i in range(600)]
    rows += [(c, t, "user", "hi.") for c in range(100, 140) for t in range(2)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 50)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    sys.setrecursionlimit(10_000)      # of the brute force
    try:
        marked = structure.chunks_of(structure.stored(structure.marks(structure._turns(df, "conv_id", "turn", "role", "text")), "t"), 16)
        spread = {(r["part"], r["chunk"]) for r in marked.where("conv_id = 7").collect()}
        repaired = structure.repair(df, chunk=16)
        got = {r[0]: tuple(r)[1:] for r in structure.conversation_reports(repaired).collect()}
        texts = repaired.where("conv_id = 7 and at > 0").orderBy("at").select("role", "text").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10_000)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len({p for p, _ in spread}) > 1 and len(spread) > 30
    assert got == brute.structure_reports(rows)
    assert [tuple(r) for r in texts] == brute.repaired([r[2:] for r in rows if r[0] == 7])[-1]


def test_op11_empty_and_parameters(spark):
    nothing = spark.createDataFrame([], SCHEMA)
    assert structure.conversation_reports(structure.repair(nothing)).count() == 0
    turns = spark.read.parquet(f"{SF}/conversations.parquet")
    plain = structure.conversation_reports(structure.repair(structure.damaged(turns), most_rules=0)).collect()
    few = structure.conversation_reports(structure.repair(structure.damaged(turns), most_rules=7, rounds=2, chunk=3)).collect()
    assert sorted(plain) == sorted(few)
