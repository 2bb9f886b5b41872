"""Operators 6 and 8, connected components and the pipeline."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.llm import brute
from tests.llm.conftest import EDGE, SF
from tests.oracle_compare import compare, duck

import corpus_pipeline
from matchspark.llm import exact_dedup, simhash
from matchspark.llm.components import components
from matchspark.llm.queries import QUERIES
from matchspark.llm.sql import ORACLE


def roots(nodes, pairs):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = root(a), root(b)
        parent[max(x, y)] = min(x, y)
    return {n: root(n) for n in nodes}


def clustered(seed):
    """Fingerprints in chains and clusters, some at exactly the radius."""
    rng, out = random.Random(seed), {0, 1, (1 << 64) - 1}
    for _ in range(8):
        x = rng.getrandbits(64)
        for _ in range(12):
            out.add(x)
            for _ in range(rng.randint(1, 6)):
                x ^= 1 << rng.randint(0, 63)
    return sorted(out | {rng.getrandbits(64) for _ in range(30)})


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("radius, block", [(4, 1 << 21), (4, 3000), (2, 1 << 21), (6, 1 << 20)])
def test_links_connect_what_distances_connect(spark, monkeypatch, radius, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    fps = clustered(radius + block)
    near = [(a, b) for a, b in itertools.combinations(fps, 2) if (a ^ b).bit_count() <= radius]
    prefix = 9
    masks, used = simhash.flips(prefix, radius // 2)
    rows = sorted((int((f >> (64 - prefix)) ^ int(m)), f, radius // 2 - int(k)) for f in fps for m, k in zip(masks, used))
    got = simhash.links_of_block(np.array([r[1] for r in rows], np.uint64), np.array([r[0] for r in rows], np.int64),
                                 np.array([r[2] for r in rows]), prefix, radius)
    assert roots(fps, got.tolist()) == roots(fps, near)
    assert len(got) < len(fps)


def test_odd_radius_is_refused(spark):
    with pytest.raises(ValueError):
        simhash.fingerprint_links(spark.createDataFrame([(1,)], "fp long"), radius=3)


def test_links_through_spark(spark):
    fps = clustered(11)
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    got = [(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in simhash.fingerprint_links(df).collect()]
    near = [(a, b) for a, b in itertools.combinations(fps, 2) if (a ^ b).bit_count() <= 4]
    assert roots(fps, got) == roots(fps, near)


@pytest.mark.parametrize("shared", [24, 40, 58])
def test_hot_prefix_is_cut(spark, monkeypatch, shared):
    """Fingerprints that share their leading bits: no key keeps more rows than the bound, and no link is lost."""
    rng = random.Random(shared)
    top = rng.getrandbits(shared) << (64 - shared)
    fps = sorted({top | rng.getrandbits(64 - shared) for _ in range(120)} | set(clustered(3)))
    seen, plain = [], simhash.link_rows
    monkeypatch.setattr(simhash, "HOT_KEY", 40)

    def watched(rows, prefix, radius):
        seen.append((prefix, rows.groupBy("key").count().agg(F.max("count")).first()[0]))
        return plain(rows, prefix, radius)

    monkeypatch.setattr(simhash, "link_rows", watched)
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    got = [(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in simhash.fingerprint_links(df).collect()]
    near = [(a, b) for a, b in itertools.combinations(fps, 2) if (a ^ b).bit_count() <= 4]
    assert roots(fps, got) == roots(fps, near)
    assert len(seen) > 2 and all((most or 0) <= 40 for prefix, most in seen if prefix < 64)


def test_components(spark):
    rng = random.Random(9)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)]
    pairs += [(400 + i, 401 + i) for i in range(60)] + [(600, 600 + i) for i in range(1, 200)] + [(5, 5)]
    df = spark.createDataFrame(pairs, "a long, b long")
    got = {r["node"]: r["root"] for r in components(df).collect()}
    want = roots({x for p in pairs for x in p}, pairs)
    assert got == {n: r for n, r in want.items() if n != r}
    assert components(df.limit(0)).count() == 0


def test_op6_whole_table(spark, table):
    got = {r[0]: (r[1], r[2]) for r in QUERIES["op6_simhash"](spark, SF).collect()}
    assert got == brute.near_components(table("documents", "doc_id, text"))


def test_op6_edges(spark, edge, nothing):
    rows = simhash.near_duplicates(edge).collect()
    assert len(rows) == len(EDGE)
    want = brute.near_components([(i, t) for i, t, _ in EDGE if i])
    for r in rows:
        if r["doc_id"] is not None:
            assert (f"{r['fp'] % (1 << 64):016x}", r["component_id"]) == want[r["doc_id"]]
    stay = simhash.drop_near_duplicates(edge)
    assert stay.columns == edge.columns
    ids = sorted(r["doc_id"] for r in stay.where("doc_id is not null").collect())
    assert sorted(set(ids)) == sorted({c for _, c in want.values()})
    assert simhash.near_duplicates(nothing).count() == 0 and simhash.drop_near_duplicates(nothing).count() == 0


def test_op6_group_of_copies(spark):
    """A third of the rows are one text, others near copies of it; nothing is lost and nothing else is linked."""
    base = " ".join(f"w{i % 83}x{i}" for i in range(400))
    rng = random.Random(2)
    docs = [(i, base if i % 3 == 0 else base.replace(f"w{i % 83}x{i % 400}", "changed") if i % 3 == 1
             else " ".join(str(rng.random()) for _ in range(50))) for i in range(300)]
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {i: c for i, (_, c) in brute.near_components(docs).items()}


def test_op8_oracle(spark):
    sf = "/root/testdata/sf0.01"
    r = compare(spark, "op8_exact_dedup", QUERIES["op8_exact_dedup"], ORACLE["op8_exact_dedup"], sf, duck(sf))
    assert r["match"], r


def test_op8_edges(spark, edge, nothing):
    rows = exact_dedup.exact_duplicates(edge).collect()
    assert len(rows) == len(EDGE) and sum(r["kept"] for r in rows) == len({"".join(c for c in t or "" if c not in brute.BLANK) for _, t, _ in EDGE})
    groups = {}
    for r in rows:
        groups.setdefault(r["digest"], []).append(r)
    for g in groups.values():
        assert {r["group_size"] for r in g} == {len(g)} and sum(r["kept"] for r in g) == 1
        assert {r["keep_id"] for r in g} == {next(r["doc_id"] for r in g if r["kept"])}
    stay = exact_dedup.drop_exact_duplicates(edge)
    assert stay.columns == edge.columns
    assert sorted(str(r["doc_id"]) for r in stay.collect()) == sorted(str(r["doc_id"]) for r in rows if r["kept"])
    assert exact_dedup.exact_duplicates(nothing).count() == 0 and exact_dedup.drop_exact_duplicates(nothing).count() == 0


def test_op8_compares_full_bytes(spark, table):
    """With a digest of two hex digits many texts collide; the groups are still those of the texts."""
    docs = table("documents", "doc_id, text")
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = exact_dedup.exact_duplicates(df, digest=lambda t: F.substring(exact_dedup.sha256(t), 1, 2)).collect()
    want = brute.exact_groups(docs)
    assert {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in rows} == {i: w[:3] for i, w in want.items()}


def test_op8_state_goes_on(spark, tmp_path):
    """New files in several micro-batches meet the digests of earlier runs."""
    folder, checkpoint = str(tmp_path / "digests"), str(tmp_path / "state")
    first = spark.createDataFrame([(4, "a b"), (2, "ab"), (9, "c")], "doc_id long, text string").repartition(3)
    digests = exact_dedup.write_digests(first, folder, "doc_id", "text")
    assert exact_dedup.update_state(digests, folder, checkpoint, files_per_batch=1).count() == 2
    more = spark.createDataFrame([(1, "a b "), (7, "c"), (8, "d")], "doc_id long, text string")
    exact_dedup.write_digests(more, folder, "doc_id", "text")
    state = exact_dedup.update_state(digests, folder, checkpoint, files_per_batch=1)
    got = sorted((~r["keep"]["not_id"], r["keep"]["code_points"], r["group_size"]) for r in state.collect())
    assert got == [(1, 4, 3), (7, 1, 2), (8, 1, 1)]
    assert all(r["keep"]["file"] == "" for r in state.collect())


@pytest.mark.parametrize("digits, scans", [(64, True), (64, False), (1, True), (1, False)])
def test_op8_runs_share_a_state(spark, tmp_path, digits, scans):
    """Three runs over one state folder: rows meet those of earlier runs, texts are compared over all runs, and each
    group has one row that stays."""
    state, docs = str(tmp_path / "state"), []
    digest = lambda t: F.substring(exact_dedup.sha256(t), 1, digits)
    runs = [[(4, "a b"), (2, "ab"), (9, "c"), (3, None)], [], [(5, "a  b"), (7, "c"), (8, "d"), (7, "c"), (6, " ")],
            [(1, "ab"), (None, "d"), (10, "e")]]
    for n, rows in enumerate(runs):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        if scans:
            df.repartition(2).write.parquet(str(tmp_path / f"docs {n}"))
            df = spark.read.parquet(str(tmp_path / f"docs {n}"))
        got = exact_dedup.exact_duplicates(df, digest=digest, state=state, run=n).collect()
        docs += rows
        assert sorted(str(r["doc_id"]) for r in got) == sorted(str(i) for i, _ in rows)
        again = exact_dedup.exact_duplicates(df, digest=digest, state=state, run=n).collect()
        assert sorted(map(str, again)) == sorted(map(str, got))  # a run called again counts nothing twice
        norm = {}
        for i, t in docs:
            norm.setdefault("".join((t or "").split()), []).append((i, t or ""))
        best = {k: min(g, key=lambda r: (-len(r[1]), r[0] is None, r[0] or 0)) for k, g in norm.items()}
        want = {i: (best[k][0], len(g)) for k, g in norm.items() for i, _ in g}
        assert {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in got} == {i: want[i] for i, _ in rows}
        assert sum(r["kept"] for r in got) == sum(k in rows or (k[0], None) in rows for k in best.values())
    if digits == 64:
        groups = exact_dedup.state_groups(spark, state)
        assert {r["keep_id"]: r["group_size"] for r in groups.collect()} == {b[0]: len(norm[k]) for k, b in best.items()}
        places = groups.selectExpr("keep_file as file", "keep_file_row as file_row", "keep_id")
        texts = exact_dedup.texts_at(spark, places).collect()
        assert {r["keep_id"]: r["text"] or "" for r in texts} == {b[0]: b[1] for b in best.values()}  # locators read back
    with pytest.raises(ValueError):
        exact_dedup.exact_duplicates(df, digest=digest, state=state, run=0)


def test_pipeline(spark, table):
    """Every stage's decisions take effect on what its predecessor kept."""
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality rules", "exact dedup", "simhash near-dedup", "packing"]
    sf = "/root/testdata/sf0.01"
    docs = corpus_pipeline.read_table(spark, sf, "documents")
    columns, before = docs.columns, 1000
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, sf), "test-stage")
        assert docs.columns == columns and docs.count() < before
        before = docs.count()
    left = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert all(k for _, _, k, _ in brute.exact_groups(left).values())
    assert all(i == c for i, (_, c) in brute.near_components(left).items())
    got = corpus_pipeline.run(spark, sf).groupBy("doc_id").count().count()
    assert got == before


def test_pipeline_edges(spark, edge, nothing, tmp_path):
    labels = str(tmp_path / "labels.parquet")
    spark.createDataFrame([(4, 1, 0), (6, 0, 1), (None, None, None)], "doc_id long, quality int, toxic int").write.parquet(labels)
    for start in (edge, nothing):
        docs = start
        for name, stage in corpus_pipeline.STAGES:
            docs = corpus_pipeline.stored(stage(spark, docs, str(tmp_path)), "test-stage")
            if name != "packing":
                assert docs.columns == start.columns
