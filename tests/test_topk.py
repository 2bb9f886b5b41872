"""Exact blocked top-k against brute force on small fixtures."""

import numpy as np
import pyarrow as pa
import pytest

from matchspark.operators import topk
from matchspark.operators.topk import exact_top_k, weighted_top_k


def _frame(spark, ids, mat, id_name="id", vec_name="vec"):
    rows = [(int(i), [float(x) for x in v]) for i, v in zip(ids, mat)]
    return spark.createDataFrame(rows, f"{id_name} long, {vec_name} array<float>")


def _brute(q, c, qids, cids, k, exclude_self=False, clamp=False, positive=False):
    qn = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
    cn = c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-300)
    s = qn @ cn.T
    if clamp:
        s = np.clip(s, 0, 1)
    out = {}
    for i, qi in enumerate(qids):
        cand = [(-s[i, j], cj) for j, cj in enumerate(cids)
                if not (exclude_self and cj == qi) and not (positive and s[i, j] <= 0)]
        cand.sort()
        out[qi] = [(cj, -ns) for ns, cj in cand[:k]]
    return out


def _collect(df, qcol, icol):
    out = {}
    for r in df.orderBy(qcol, "rank").collect():
        out.setdefault(r[qcol], []).append((r[icol], r["similarity"]))
    return out


@pytest.mark.parametrize("block_rows,bcast", [(4096, 1 << 30), (7, 0), (3, 1 << 30)])
def test_exact_matches_brute_force(spark, block_rows, bcast):
    rng = np.random.default_rng(1)
    q = rng.normal(size=(23, 5)).astype(np.float32)
    c = rng.normal(size=(41, 5)).astype(np.float32)
    qids, cids = np.arange(23), np.arange(100, 141)
    got = exact_top_k(_frame(spark, qids, q, "qid", "qv"), _frame(spark, cids, c, "cid", "cv"), 6,
                      query_id="qid", query_vec="qv", item_id="cid", item_vec="cv",
                      block_rows=block_rows, broadcast_limit_bytes=bcast)
    g = _collect(got, "qid", "cid")
    b = _brute(q.astype(float), c.astype(float), qids, cids, 6)
    assert set(g) == set(b)
    for k in b:
        assert [x for x, _ in g[k]] == [x for x, _ in b[k]]
        assert [s for _, s in g[k]] == pytest.approx([s for _, s in b[k]], abs=1e-9)


def test_ties_broken_by_id_and_k_larger_than_corpus(spark):
    c = np.array([[1, 0], [1, 0], [1, 0], [0, 1]], dtype=np.float32)
    got = exact_top_k(_frame(spark, [1], np.array([[1, 0]], dtype=np.float32)), _frame(spark, [9, 3, 5, 1], c),
                      10, query_id="id", query_vec="vec", item_id="id", item_vec="vec", out_item="item",
                      block_rows=2)
    rows = got.orderBy("rank").collect()
    assert [r["item"] for r in rows] == [3, 5, 9, 1]   # ties by id; k clamped to corpus size
    assert [r["rank"] for r in rows] == [1, 2, 3, 4]


def test_exclude_self_duplicates_list_each_other(spark):
    c = np.array([[1, 0], [1, 0], [0, 1]], dtype=np.float32)
    df = _frame(spark, [1, 2, 3], c)
    got = exact_top_k(df, df, 1, query_id="id", query_vec="vec", item_id="id", item_vec="vec",
                      out_item="other", exclude_self=True)
    m = {r["id"]: (r["other"], r["similarity"]) for r in got.collect()}
    assert m[1] == (2, pytest.approx(1.0)) and m[2] == (1, pytest.approx(1.0))
    assert all(k != v[0] for k, v in m.items())


def test_prefix_property(spark):
    rng = np.random.default_rng(3)
    c = rng.normal(size=(30, 4)).astype(np.float32)
    df = _frame(spark, np.arange(30), c)
    a = _collect(exact_top_k(df, df, 4, query_id="id", query_vec="vec", item_id="id", item_vec="vec",
                             out_item="o", block_rows=8), "id", "o")
    b = _collect(exact_top_k(df, df, 5, query_id="id", query_vec="vec", item_id="id", item_vec="vec",
                             out_item="o", block_rows=8), "id", "o")
    for k in a:
        assert [x for x, _ in a[k]] == [x for x, _ in b[k]][:4]


def test_clamp_positive_only(spark):
    q = np.array([[1, 0]], dtype=np.float32)
    c = np.array([[1, 0], [-1, 0], [0, 1], [0.5, 0.5]], dtype=np.float32)
    got = exact_top_k(_frame(spark, [0], q), _frame(spark, [1, 2, 3, 4], c), 10, query_id="id",
                      query_vec="vec", item_id="id", item_vec="vec", out_item="o", clamp=True,
                      positive_only=True)
    assert [r["o"] for r in got.orderBy("rank").collect()] == [1, 4]


def test_absent_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, None), (3, [])], "id long, vec array<float>")
    got = exact_top_k(df, df, 5, query_id="id", query_vec="vec", item_id="id", item_vec="vec", out_item="o")
    assert sorted((r["id"], r["o"]) for r in got.collect()) == [(1, 1)]
    z = exact_top_k(df, df, 5, query_id="id", query_vec="vec", item_id="id", item_vec="vec", out_item="o",
                    absent_items_score_zero=True, clamp=True)
    assert sorted((r["o"], r["similarity"]) for r in z.collect()) == [(1, 1.0), (2, 0.0), (3, 0.0)]


def test_weighted_equals_formula(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(12):
        b = None if i % 4 == 0 else [float(x) for x in rng.normal(size=2)]
        rows.append((i, [float(x) for x in rng.normal(size=3)], b))
    df = spark.createDataFrame(rows, "id long, a array<float>, b array<float>")
    got = weighted_top_k(df, df, 3, [("a", "a", 0.5), ("b", "b", 0.3)], query_id="id", item_id="id",
                         out_item="o")

    def cos(x, y):
        if x is None or y is None:
            return 0.0
        x, y = np.array(x, dtype=np.float32).astype(float), np.array(y, dtype=np.float32).astype(float)
        return float(x @ y / (np.linalg.norm(x) * np.linalg.norm(y)))

    best = {}
    for q in rows:
        scores = sorted((-(0.5 * cos(q[1], c[1]) + 0.3 * cos(q[2], c[2])) / 0.8, c[0]) for c in rows)
        best[q[0]] = [c for _, c in scores[:3]]
    g = {}
    for r in got.orderBy("id", "rank").collect():
        g.setdefault(r["id"], []).append(r["o"])
    assert g == best


def test_all_tied_scores_give_exactly_k(spark):
    """Every score is clamped to 0: each block emits k rows per query, the smallest ids win."""
    q = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(20)], "q long, v array<float>")
    c = spark.createDataFrame([(i, [-1.0, 0.0]) for i in range(300)], "c long, v array<float>")
    r = exact_top_k(q, c, 2, query_id="q", query_vec="v", item_id="c", item_vec="v", clamp=True, block_rows=64)
    got = {}
    for row in r.collect():
        got.setdefault(row["q"], []).append((row["rank"], row["c"], row["similarity"]))
    assert all(sorted(x) == [(1, 0, 0.0), (2, 1, 0.0)] for x in got.values()) and len(got) == 20
    from matchspark.operators.topk import _best
    s = np.array([[0.5, 0.9, 0.5, 0.5], [0.1, 0.1, 0.1, 0.1]])
    assert _best(s, 2).tolist() == [[True, True, False, False], [True, True, False, False]]


def test_mixed_dimensions(spark):
    """Vectors of different dimensions have no cosine: left out, or 0 where absent items count as 0."""
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0, 0.0, 0.0])], "q long, v array<float>")
    c = spark.createDataFrame([(10, [1.0, 1.0, 0.0, 0.0]), (11, [0.0, 1.0]), (12, [2.0, 0.0])], "c long, v array<float>")
    kw = dict(query_id="q", query_vec="v", item_id="c", item_vec="v")
    got = sorted((r["q"], r["c"], round(r["similarity"], 6)) for r in exact_top_k(q, c, 5, **kw).collect())
    assert got == [(1, 11, 0.0), (1, 12, 1.0), (2, 10, 0.707107)]
    got = sorted((r["q"], r["c"], round(r["similarity"], 6)) for r in exact_top_k(q, c, 5, absent_items_score_zero=True, **kw).collect())
    assert got == [(1, 10, 0.0), (1, 11, 0.0), (1, 12, 1.0), (2, 10, 0.707107), (2, 11, 0.0), (2, 12, 0.0)]


def test_lists_leave_a_tile_whole_and_short(spark):
    """k rows a query leave the kernel, however many blocks the corpus is cut into, and ties among them go to the smallest ids."""
    from pyspark.sql import functions as F
    from matchspark.operators.topk import tile_top_k
    rng = np.random.default_rng(5)
    v = np.repeat(rng.normal(size=(40, 3)), 5, axis=0).astype(np.float32)      # every vector five times
    df = _frame(spark, rng.permutation(200), v)
    q = df.select(F.lit(0).alias("_t"), F.col("id").alias("_q"), F.col("vec").alias("_v"))
    c = df.select(F.lit(0).alias("_t"), F.col("id").alias("_c"), F.col("vec").alias("_v"))
    assert tile_top_k(q, c, 4, 1, block_rows=8).count() == 200 * 4
    got = _collect(exact_top_k(df, df, 4, query_id="id", query_vec="vec", item_id="id", item_vec="vec", out_item="o", block_rows=8), "id", "o")
    ids, mat = zip(*[(r["id"], r["vec"]) for r in df.orderBy("id").collect()])
    same = {}
    for i, m in zip(ids, mat):
        same.setdefault(tuple(m), []).append(i)
    assert all([o for o, _ in got[i]] == same[tuple(m)][:4] for i, m in zip(ids, mat))


def test_group_takes_its_batches_out_and_a_tile_runs_in_small_blocks():
    """F8, F11: a task holds its corpus vectors once as they came and once as unit vectors at most, and lists of a million entries."""
    import pyarrow as pa

    from matchspark.operators import topk

    rng = np.random.default_rng(3)
    m, ids = rng.normal(size=(50, 3)), rng.permutation(50)
    batches = [pa.RecordBatch.from_arrays([pa.array(ids[a:a + 20]), pa.array(m[a:a + 20].tolist())], names=["_c", "_v"]) for a in (0, 20, 40)]
    group = topk.Group(batches, True)
    assert not batches and topk.LIST_ENTRIES <= 1_000_000
    places, units, _, _ = group.blocks[3]
    want = (m / np.linalg.norm(m, axis=1)[:, None])[np.argsort(ids)]
    assert places.tolist() == list(range(50)) and np.allclose(units, want, atol=1e-15)


def _tile_batches(q, c):
    def side(v, s):
        ids, none = pa.array(np.arange(len(v))), pa.nulls(len(v), pa.int64())
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(v) + 1, dtype=np.int32) * v.shape[1]), pa.array(v.ravel()))
        zero = np.zeros(len(v), dtype=np.int32)
        return pa.RecordBatch.from_arrays([pa.array(zero), pa.array(zero + s), none if s == 0 else ids, ids if s == 0 else none, lists],
                                          names=["_t", "_side", "_q", "_c", "_v"])
    return [side(c, 0), side(q, 1)]


def test_few_pairs_are_looked_at_closely(monkeypatch):
    """A block of queries does not gather every pair of its first product before its lists are cut."""
    offered = []
    add = topk.Lists.add
    monkeypatch.setattr(topk.Lists, "add", lambda self, row, place, score: (offered.append(len(row)), add(self, row, place, score))[1])
    rng = np.random.default_rng(5)
    q, c = rng.normal(size=(50, 16)), rng.normal(size=(6000, 16))
    c[3000:3100] = c[:100]
    out = list(topk._tile(10, False, False, False, True, False, 2048)(iter(_tile_batches(q, c))))
    got = {}
    for r in pa.Table.from_batches(out).to_pylist():
        got.setdefault(r["q"], []).append((-r["s"], r["c"]))
    want = _brute(q, c, range(50), range(6000), 10)
    for i in range(50):
        assert [x for _, x in sorted(got[i])] == [x for x, _ in want[i]]
    assert sum(offered) < 50 * 6000 / 20


@pytest.mark.parametrize("size", [1e-25, 1.0, 1e12, 1e30])
@pytest.mark.parametrize("clamp,exclude,positive", [(False, False, False), (True, False, False), (False, True, False), (True, True, True)])
def test_lengths_and_rules_of_the_first_look(size, clamp, exclude, positive):
    """Inner products of vectors of any length, with clamped scores, self and equal vectors."""
    rng = np.random.default_rng(6)
    q, c = rng.normal(size=(30, 8)), rng.normal(size=(700, 8))
    c[:30], c[350:380] = q, q
    q, c = q * size, c / (size if size > 1 else size * 3)
    s = np.round(q @ c.T, topk.DIGITS) + 0.0
    if clamp:
        s = np.clip(s, 0, 1)
    run = topk._tile(7, exclude, clamp, positive, False, False, 64)
    got = {}
    for r in pa.Table.from_batches(list(run(iter(_tile_batches(q, c))))).to_pylist():
        got.setdefault(r["q"], []).append((-r["s"], r["c"]))
    for i in range(30):
        ok = [j for j in np.lexsort((np.arange(700), -s[i])) if not (exclude and j == i) and not (positive and s[i, j] <= 0)][:7]
        assert [x for _, x in sorted(got[i])] == pytest.approx(ok)


def test_lists_of_groups_and_repeated_ids_are_merged(spark, monkeypatch):
    """lists leave the tiles and are merged as lists, whatever ids come twice or not at all."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F
    from matchspark.functions.vector import cosine

    monkeypatch.setattr(topk, "GROUP_BYTES", 200)
    monkeypatch.setattr(topk, "LEAST_GROUP_BYTES", 200)
    monkeypatch.setattr(topk, "PIECE", 3)
    rng = np.random.default_rng(12)
    vec = lambda n: [[float(x) for x in v] for v in rng.normal(size=(n, 3))]
    q = spark.createDataFrame([*zip([1, 1, 2, 3, None, None, 4, 5], vec(8))], "q long, v array<float>")
    c = spark.createDataFrame([*zip([None, *map(str, range(80))], vec(81))], "c string, v array<float>")
    lists = topk.top_k_lists(q, c, 7, query_id="q", query_vec="v", item_id="c", item_vec="v")
    assert lists.groups > 2
    got = exact_top_k(q, c, 7, query_id="q", query_vec="v", item_id="c", item_vec="v")
    w = Window.partitionBy("q").orderBy(F.col("s").desc(), "c")
    want = (q.withColumnRenamed("v", "a").crossJoin(c).select("q", "c", F.round(cosine("a", "v"), 9).alias("s")).withColumn("rank", F.row_number().over(w))
            .where("rank <= 7"))
    rows = lambda d: sorted((str(r["q"]), r["rank"], str(r["c"])) for r in d.collect())
    assert rows(got) == rows(want) and len(rows(got)) == 6 * 7
    for r in lists.rows.collect():
        at = spark.createDataFrame([(x,) for x in r["c"]], "c string").select(F.pmod(F.xxhash64("c"), F.lit(lists.groups)).alias("g")).distinct().collect()
        assert [x["g"] for x in at] == [r["g"]] and r["r"] == sorted(r["r"])
        break


def test_lists_of_one_group_are_not_sorted_again(spark, capsys):
    """a list leaves its tile in rows of many entries, ranked; no window sorts the entries."""
    df = _frame(spark, np.arange(40), np.random.default_rng(2).normal(size=(40, 3)))
    kw = dict(query_id="id", query_vec="vec", item_id="id", item_vec="vec")
    assert topk.top_k_lists(df, df, 30, **kw).rows.count() == 40
    got = exact_top_k(df, df, 30, out_item="o", **kw)
    got.explain()
    assert "Window" not in capsys.readouterr().out
    assert got.count() == 1200 and {r["id"]: r["count"] for r in got.groupBy("id").count().collect()} == {i: 30 for i in range(40)}


def test_rows_of_floats_are_held_once_and_score_as_in_double():
    """a group of floats is held as it came, so it holds three times as many rows; vectors out of the range of products, zero and NaN score as before."""
    rng = np.random.default_rng(4)
    c = rng.normal(size=(400, 8)).astype(np.float32) * 10.0 ** rng.integers(-6, 7, size=(400, 1)).astype(np.float32)
    c[5], c[9:12] = 0, c[8]
    q = np.concatenate([c[:20], rng.normal(size=(10, 8)).astype(np.float32)])
    for odd in (None, 1e30, 1e-30, np.nan):
        if odd is not None:
            c[33] = odd
        batches = _tile_batches(q, c)
        group = topk.Group([b.rename_columns(["_t", "_side", "_q", "_c", "_v"]) for b in batches[:1]], True)
        assert isinstance(group.blocks[8][1], topk.UnitRows) == (odd is None) and (odd is not None or group.short[8][0].dtype == np.float32)
        got = {}
        for r in pa.Table.from_batches(list(topk._tile(9, True, False, False, True, False, 64)(iter(batches)))).to_pylist():
            got.setdefault(r["q"], []).append((-r["s"], r["c"]))
        unit = lambda m: m.astype(float) / np.where((n := np.linalg.norm(m.astype(float), axis=1)) == 0, 1, n)[:, None]
        s = np.round(unit(q) @ unit(c).T, topk.DIGITS) + 0.0
        for i in range(30):
            ok = [j for j in np.lexsort((np.arange(400), -s[i])) if j != i and np.isfinite(s[i, j])][:9]
            assert [x for _, x in sorted(got[i])] == ok
