"""Operators 1, 2 and 9 against the tokenizers library."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tests.llm import brute
from tests.llm.conftest import EDGE, SF

from matchspark.llm import bpe, library, packing, token_orc
from matchspark.llm.common import shared_folder
from matchspark.llm.queries import QUERIES, tokenizer_path

BYTE, WORD = "byte_bpe_50k.json", "word_bpe_49k.json"
PARTS = ["a", "b", "the", " ", "  ", "\n", "'", "'ll", "ll", ".", ",", "é", "日", "1", " ", "<|endoftext|>", "<|end", "\t",
         "🎉", "Zz", "ing", "\x1d", "İ", "́", "ΑΣ", "…", "\x02", "_", "Is", "2", " a", " b"]
TEXT = st.lists(st.sampled_from(PARTS), max_size=30).map("".join)


@pytest.fixture(scope="module")
def merges():
    return bpe.encoder(tokenizer_path(BYTE)).merges


def ids_of(data: bytes) -> list[int]:
    return np.frombuffer(data, "<u4").tolist()


@settings(max_examples=300, deadline=None)
@given(TEXT)
def test_transducer_equals_library(merges, text):
    want = _library(BYTE, text)
    enc = bpe.Encoder(merges)
    assert ids_of(enc.encode(text)) == want
    dec = bpe.Decoder(merges)
    assert "".join([*(dec.feed([i]) for i in want), dec.finish()]) == text


_known = {}


def _library(name, text):
    if name not in _known:
        from tokenizers import Tokenizer
        _known[name] = Tokenizer.from_file(tokenizer_path(name))
    return _known[name].encode(text, add_special_tokens=False).ids


def test_small_chunks_and_windows(merges, monkeypatch):
    """Chunks of a few characters and words far beyond the window give the same ids."""
    rng = random.Random(3)
    monkeypatch.setattr(bpe, "CHUNK", 17)
    monkeypatch.setattr(bpe, "LONG", 9)
    enc = bpe.Encoder(merges)
    for _ in range(400):
        text = "".join(rng.choice(PARTS) * rng.choice([1, 1, 7, 30]) for _ in range(rng.randint(0, 20)))
        assert ids_of(enc.encode(text)) == _library(BYTE, text)
    monkeypatch.setattr(bpe, "CHUNK", 1000)
    enc = bpe.Encoder(merges, window=merges.lookahead + 50)
    for make in (lambda: "".join(rng.choice(["on", "in", "the", "re", "a", "e", "tion", "é"]) for _ in range(9000)),
                 lambda: "a" * rng.randint(9000, 20000), lambda: "=" * 15000, lambda: " " * 12000 + "x"):
        text = make()
        assert ids_of(enc.encode(text)) == _library(BYTE, text)


def test_many_control_strings_in_one_chunk(merges):
    """Their number within a chunk is not bounded."""
    end = "<|endoftext|>"
    enc = bpe.Encoder(merges)
    for text in (end * 5000, f"a b{end}" * 4000, f"x \n {end} '{end}<|end" * 2000, f" {end}" * 5000 + "a" * 9000 + end):
        assert ids_of(enc.encode(text)) == _library(BYTE, text)


def test_lookahead_of_small_lists():
    """Brute force: past the lookahead no continuation moves a boundary."""
    letters = {b: b for b in range(256)}
    rng = random.Random(7)
    for _ in range(60):
        spelled = {b: bytes([b]) for b in range(256)}
        pairs, tokens = [], [97, 98, 99]
        for new in range(256, 256 + rng.randint(1, 7)):
            a, b = rng.choice(tokens), rng.choice(tokens)
            if any(p[:2] == (a, b) for p in pairs) or any(spelled[t] == spelled[a] + spelled[b] for t in tokens):
                continue
            spelled[new] = spelled[a] + spelled[b]
            pairs.append((a, b, new))
            tokens.append(new)
        m = bpe.Merges(letters, pairs, spelled)

        def cuts(data):
            return set(np.cumsum([len(spelled[t]) for t in m.tokens(data)]).tolist())

        for _ in range(40):
            word = bytes(rng.choice(b"abc") for _ in range(m.lookahead + 12))
            more = word + bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 12)))
            upto = len(word) - m.lookahead
            assert {c for c in cuts(word) if c <= upto} == {c for c in cuts(more) if c <= upto}


def test_short_and_long_merging_agree(merges):
    rng = random.Random(1)
    for _ in range(200):
        data = bytes(rng.choice(b"theinganrsto ") for _ in range(rng.randint(1, 60)))
        ids = [merges.byte_id[b] for b in data]
        assert merges._short(list(ids)) == merges._long(list(ids))


@pytest.mark.parametrize("name, cut", [(BYTE, "spaces"), (WORD, "blanks")])
def test_library_encoder(name, cut):
    rng = random.Random(2)
    enc = library.LibraryEncoder(tokenizer_path(name), cached=50)  # the cache turns over all the time
    assert enc.cut == cut
    texts = ["", "a", *("".join(rng.choice(PARTS) for _ in range(rng.randint(0, 30))) for _ in range(3000))]
    got = [i for k in range(0, len(texts), 100) for i in enc.encode(texts[k:k + 100])]
    assert [ids_of(i) for i in got] == [_library(name, t) for t in texts]


def test_op1_whole_table(spark, table, tokenizer):
    got = {r[0]: tuple(r[1:]) for r in QUERIES["op1_bpe"](spark, SF).collect()}
    assert got == brute.bpe_digests(table("documents", "doc_id, text"), tokenizer(BYTE))


def test_op1_edges(spark, edge, nothing):
    path = tokenizer_path(BYTE)
    encoded = bpe.bpe_encode(edge, path)
    got = sorted((r["doc_id"] or -1, list(r["ids"])) for r in encoded.collect())
    assert got == sorted((i or -1, _library(BYTE, t or "")) for i, t, _ in EDGE)
    texts = sorted((r["doc_id"] or -1, r["text"]) for r in bpe.bpe_decode(encoded, path).collect())
    assert texts == sorted((i or -1, t or "") for i, t, _ in EDGE)
    assert bpe.bpe_encode(nothing, path).count() == 0


def test_op2_whole_table(spark, table, tokenizer):
    got = {r[0]: tuple(r[1:]) for r in QUERIES["op2_token_orc"](spark, SF).collect()}
    assert got == brute.token_rows(table("documents", "doc_id, text"), tokenizer(BYTE))


def test_op2_files(spark, edge, nothing):
    folder = shared_folder(spark, "test-orc")
    token_orc.write_token_orc(edge, folder, tokenizer_path(BYTE), parts=3)
    rows = token_orc.read_token_orc(spark, folder)
    got = sorted(([r["start"], r["doc_id"], list(r["ids"])] for r in rows.collect()), key=lambda r: r[0])
    order = sorted(EDGE, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    assert [g[1] for g in got] == [r[0] for r in order]
    assert [g[2] for g in got] == [[*_library(BYTE, t or ""), 2] for _, t, _ in order]
    assert got[0][0] == 0 and all(b[0] == a[0] + len(a[2]) for a, b in zip(got, got[1:]))
    wanted = rows.where("doc_id = 6")
    assert wanted.count() == 1
    plan = wanted._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,6)]" in plan or "EqualTo(doc_id,6)" in plan
    empty = shared_folder(spark, "test-orc")
    token_orc.write_token_orc(nothing, empty, tokenizer_path(BYTE), parts=2)
    assert token_orc.read_token_orc(spark, empty).count() == 0


@pytest.mark.parametrize("hot", [7, None])
def test_op2_hot_id_spans_parts(spark, tokenizer, hot):
    """A third of the rows have one id (or none): no part holds them all, and the order and offsets stay right."""
    rows = [(hot if i % 3 == 0 else i, f"text {i % 5} of {i % 11}") for i in range(3000)]
    folder = shared_folder(spark, "test-orc")
    token_orc.write_token_orc(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), folder,
                              tokenizer_path(BYTE), parts=12)
    sizes = [r["count"] for r in spark.read.orc(folder + "/ids").groupBy("part").count().collect()]
    assert max(sizes) < 600
    got = sorted(token_orc.read_token_orc(spark, folder).collect(), key=lambda r: r["start"])
    assert [g["doc_id"] for g in got] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i or 0))
    assert got[0]["start"] == 0 and all(b["start"] == a["start"] + a["n_tokens"] for a, b in zip(got, got[1:]))
    want = Counter((i, (*_library(BYTE, t), 2)) for i, t in rows)
    assert Counter((g["doc_id"], tuple(g["ids"])) for g in got) == want


def test_caches_keep_short_words_only(merges):
    """Long words are encoded but never kept, so the number of entries bounds the caches' bytes."""
    text = " ".join(["short", "x" * 3000, "word " + "ab" * 400, "y" * 65 + "."])
    enc = bpe.Encoder(merges)
    assert ids_of(enc.encode(text)) == _library(BYTE, text)
    for cache in (enc.word, enc.piece, enc.spaced):
        assert max(map(len, cache), default=0) <= 64
    lib = library.LibraryEncoder(tokenizer_path(BYTE))
    assert ids_of(lib.encode([text])[0]) == _library(BYTE, text)
    assert lib.known and max(map(len, lib.known)) <= 64


@pytest.mark.parametrize("n", [1, 2, 3, 2047, 2048, 2049, 5000])
def test_piece_lengths(n):
    p = packing.piece_lengths(n)
    assert sum(p) == n and all(x & (x - 1) == 0 and x <= 2048 for x in p) and p == sorted(p, reverse=True)


def check_pieces(rows, docs, tok):
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
    for i, t in docs:
        ids, at = np.array(brute.packed_ids(t, tok), "<u4"), 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"], r["offset"]) == (at, len(ids), 0)
            assert r["ids_crc32"] == zlib.crc32(ids[at:at + r["length"]].tobytes())
            assert r["length"] <= 2048 and r["length"] & (r["length"] - 1) == 0
            at += r["length"]
        assert at == len(ids)
    assert len({r["sequence_id"] for r in rows}) == len(rows)


def test_op9_whole_table(spark, table, tokenizer):
    check_pieces(QUERIES["op9_packing"](spark, SF).collect(), table("documents", "doc_id, text"), tokenizer(WORD))


def test_op9_edges(spark, edge, edge_unique, nothing, tokenizer):
    from pyspark.sql import functions as F
    path = tokenizer_path(WORD)
    rows = packing.pack(edge_unique, path).withColumn("ids_crc32", F.crc32("ids")).collect()
    check_pieces(rows, list({i: t for i, t, _ in EDGE if i}.items()), tokenizer(WORD))
    every = packing.pack(edge, path).agg(F.sum("length")).first()[0]
    assert every == sum(len(brute.packed_ids(t, tokenizer(WORD))) for _, t, _ in EDGE)
    assert packing.pack(nothing, path).count() == 0
    with pytest.raises(ValueError):
        packing.pack(edge, path, window=1000)


def test_op9_buckets(spark, edge, nothing, tmp_path):
    """One folder per length, parts of bounded size, the same sequences read back."""
    path, folder = tokenizer_path(WORD), str(tmp_path / "buckets")
    made = {r["length"]: r for r in packing.write_buckets(packing.pack(edge, path), folder, 1 << 16).collect()}
    back = packing.read_buckets(spark, folder).collect()
    assert {n: r["sequences"] for n, r in made.items()} == dict(Counter(r["length"] for r in back))
    assert made[2048]["parts"] > 1 and {r["part"] for r in back if r["length"] == 2048} == set(range(made[2048]["parts"]))
    assert all(len(r["ids"]) == 4 * r["length"] for r in back)
    assert len({r["sequence_id"] for r in back}) == len(back)

    def content(rows):
        return Counter((r["doc_id"], r["start"], r["length"], bytes(r["ids"])) for r in rows)
    assert content(back) == content(packing.pack(edge, path).collect())
    assert {r["length"] for r in packing.read_buckets(spark, folder, 2048).collect()} == {2048}
    assert packing.write_buckets(packing.pack(nothing, path), str(tmp_path / "none")).count() == 0
