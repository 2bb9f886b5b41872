"""Cascade rules and IVF index behaviour."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchspark.operators import cascade as cascade_ops
from matchspark.operators import ivf as ivf_ops
from matchspark.operators.cascade import cascade
from matchspark.operators.topk import exact_top_k

SCHEMA_CV = "cv_id long, title_vec array<float>, experience_vec array<float>, skills_vec array<float>"
SCHEMA_JOB = "job_id long, title_vec array<float>, requirement_vec array<float>, skills_vec array<float>"


def _v(rng, d=4):
    return [float(x) for x in rng.normal(size=d)]


def _entities(spark, n_cv=6, n_job=25, seed=0, cv_exp=True, cv_skills=True, job_req=True):
    rng = np.random.default_rng(seed)
    cvs = [(i, _v(rng), _v(rng) if cv_exp else None, _v(rng) if cv_skills else None) for i in range(n_cv)]
    jobs = [(100 + j, _v(rng), _v(rng) if (job_req or j % 2) else None, _v(rng)) for j in range(n_job)]
    return spark.createDataFrame(cvs, SCHEMA_CV), spark.createDataFrame(jobs, SCHEMA_JOB)


def _lists(df):
    out = {}
    for r in df.orderBy("cv_id", "rank").collect():
        out.setdefault(r["cv_id"], []).append((r["job_id"], r["similarity"]))
    return out


def test_cv_without_experience_keeps_round1_order(spark):
    cvs, jobs = _entities(spark, cv_exp=False)
    got = _lists(cascade(cvs, jobs, k1=8, k2=8, k3=8, rounds=2))
    r1 = _lists(exact_top_k(cvs, jobs, 8, query_id="cv_id", query_vec="title_vec", item_id="job_id",
                            item_vec="title_vec"))
    for cv in got:
        assert [j for j, _ in got[cv]] == [j for j, _ in r1[cv]]
        assert all(s == pytest.approx(0.3) for _, s in got[cv])


def test_cv_without_skills_final_order_is_round2_order(spark):
    cvs, jobs = _entities(spark, cv_skills=False)
    final = _lists(cascade(cvs, jobs, k1=10, k2=5, k3=5))
    r2 = _lists(cascade(cvs, jobs, k1=10, k2=5, k3=5, rounds=2))
    for cv in final:
        assert [j for j, _ in final[cv]] == [j for j, _ in r2[cv]]
        assert all(s == pytest.approx(0.3) for _, s in final[cv])


def test_job_without_requirements_scores_half(spark):
    cvs, jobs = _entities(spark, job_req=False)
    got = cascade(cvs, jobs, k1=25, k2=25, k3=25, rounds=2)
    no_req = {r["job_id"] for r in jobs.where(F.col("requirement_vec").isNull()).collect()}
    for r in got.collect():
        if r["job_id"] in no_req:
            assert r["similarity"] == pytest.approx(0.5)


def test_full_candidate_sets_equal_sort_by_skills(spark):
    cvs, jobs = _entities(spark)
    got = _lists(cascade(cvs, jobs, k1=25, k2=25, k3=5))
    cv_rows = {r["cv_id"]: r for r in cvs.collect()}
    job_rows = jobs.collect()
    for cv, lst in got.items():
        q = np.array(cv_rows[cv]["skills_vec"], dtype=np.float32).astype(float)
        scores = []
        for j in job_rows:
            v = np.array(j["skills_vec"], dtype=np.float32).astype(float)
            scores.append((-(q @ v) / (np.linalg.norm(q) * np.linalg.norm(v)), j["job_id"]))
        expect = [j for _, j in sorted(scores)[:5]]
        assert [j for j, _ in lst] == expect


def _corpus(spark, n=300, d=8, seed=1):
    rng = np.random.default_rng(seed)
    rows = [(i, [float(x) for x in rng.normal(size=d)]) for i in range(n)]
    return spark.createDataFrame(rows, "job_id long, title_vec array<float>")


def test_ivf_full_probe_equals_exact(spark):
    jobs = _corpus(spark)
    q = jobs.select(F.col("job_id").alias("cv_id"), "title_vec").limit(40)
    idx = ivf_ops.build_index(jobs, "job_id", "title_vec", nlist=10, nprobe=10, split_rows=16)
    assert idx.nlist == 10 and max(idx.splits.values()) > 1       # big cells are split
    a = ivf_ops.search(idx, q, 7, query_id="cv_id", query_vec="title_vec", out_item="job_id", block_rows=9)
    b = exact_top_k(q, jobs, 7, query_id="cv_id", query_vec="title_vec", item_id="job_id", item_vec="title_vec")
    ra = sorted((r["cv_id"], r["job_id"], r["rank"], round(r["similarity"], 9)) for r in a.collect())
    rb = sorted((r["cv_id"], r["job_id"], r["rank"], round(r["similarity"], 9)) for r in b.collect())
    assert ra == rb
    c = ivf_ops.search_pairs(idx, q, 7, query_id="cv_id", query_vec="title_vec", out_item="job_id")
    assert sorted((r["cv_id"], r["job_id"], r["rank"]) for r in c.collect()) == [x[:3] for x in rb]


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_ivf_recall_at_defaults(spark, sf):
    from matchspark.sources.adapters import AS_OF, cv_view, job_view
    from matchspark.operators.entities import active_jobs, main_cvs
    jobs, cvs = active_jobs(job_view(spark, sf), AS_OF), main_cvs(cv_view(spark, sf))
    idx = ivf_ops.build_index(jobs, "job_id", "title_vec")
    a = ivf_ops.search(idx, cvs, 20, query_id="cv_id", query_vec="title_vec", out_item="job_id")
    b = exact_top_k(cvs, jobs, 20, query_id="cv_id", query_vec="title_vec", item_id="job_id", item_vec="title_vec")
    hit = b.join(a, ["cv_id", "job_id"]).count()
    assert hit / b.count() >= 0.95


@pytest.mark.parametrize("n", [0, 1, 2, 15, 25])
def test_ivf_small_corpora(spark, n):
    jobs = _corpus(spark, n=25).where(F.col("job_id") < n)
    idx = ivf_ops.build_index(jobs, "job_id", "title_vec")
    q = _corpus(spark, n=25).select(F.col("job_id").alias("cv_id"), "title_vec")
    got = ivf_ops.search(idx, q, 5, query_id="cv_id", query_vec="title_vec", out_item="job_id")
    assert got.columns == ["cv_id", "job_id", "similarity", "rank"]
    counts = {r["cv_id"]: r["count"] for r in got.groupBy("cv_id").count().collect()}
    assert counts == ({i: min(5, n) for i in range(25)} if n else {}) or n == 25


def test_ivf_other_dimensions_are_searched_among_themselves(spark, tmp_path):
    rows = [(i, [1.0, float(i), 0.5]) for i in range(40)] + [(100 + i, [1.0, float(i)]) for i in range(5)]
    jobs = spark.createDataFrame(rows, "job_id long, title_vec array<float>")
    q = jobs.withColumnRenamed("job_id", "cv_id")
    want = _found(exact_top_k(q, jobs, 3, query_id="cv_id", query_vec="title_vec", item_id="job_id", item_vec="title_vec"))
    kw = dict(query_id="cv_id", query_vec="title_vec", out_item="job_id")
    for idx in (ivf_ops.build_index(jobs, "job_id", "title_vec"), ivf_ops.load_or_build(jobs, "job_id", "title_vec", str(tmp_path / "i"))[0]):
        assert _found(ivf_ops.search(idx, q, 3, nprobe=100, **kw)) == want
        assert _found(ivf_ops.search_bounded(idx, q, 3, **kw).result) == want


def _found(df):
    return sorted((r["cv_id"], r["job_id"], r["rank"], round(r["similarity"], 9)) for r in df.collect())


def _clustered(spark, n=1500, d=16, groups=30, seed=5, noise=0.05):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, d))
    rows = [(i, [float(x) for x in centres[i % groups] + noise * rng.normal(size=d)]) for i in range(n)]
    return spark.createDataFrame(rows + [(n, [0.0] * d), (n + 1, None)], "job_id long, title_vec array<float>")


@pytest.mark.parametrize("k", [5, 60, 3000])
def test_bounded_search_equals_exact_and_reads_few_cells(spark, k):
    jobs = _clustered(spark)
    q = jobs.where("job_id % 10 = 0").withColumnRenamed("job_id", "cv_id")       # one query is the zero vector
    idx = ivf_ops.build_index(jobs, "job_id", "title_vec", nlist=30, calibrate=False, split_rows=64)
    got = ivf_ops.search_bounded(idx, q, k, query_id="cv_id", query_vec="title_vec", out_item="job_id")
    want = exact_top_k(q, jobs, k, query_id="cv_id", query_vec="title_vec", item_id="job_id", item_vec="title_vec")
    assert _found(got.result) == _found(want)
    read = got.read.where("cv_id <> 1500").agg(F.avg("rows")).first()[0]
    assert read <= (400 if k == 5 else 1501)


def test_bounded_search_of_a_corpus_without_structure(spark):
    jobs = _corpus(spark, n=400)
    q = jobs.withColumnRenamed("job_id", "cv_id")
    idx = ivf_ops.build_index(jobs, "job_id", "title_vec", nlist=40, calibrate=False)
    got = ivf_ops.search_bounded(idx, q, 3, query_id="cv_id", query_vec="title_vec", out_item="job_id", growth=2, exclude_self=True)
    want = exact_top_k(q, jobs, 3, query_id="cv_id", query_vec="title_vec", item_id="job_id", item_vec="title_vec", exclude_self=True)
    assert _found(got.result) == _found(want)
    empty = ivf_ops.build_index(jobs.where("false"), "job_id", "title_vec")
    assert ivf_ops.search_bounded(empty, q, 3, query_id="cv_id", query_vec="title_vec", out_item="job_id").result.count() == 0


def test_tree_of_cells(spark, monkeypatch):
    monkeypatch.setattr(ivf_ops, "TREE_CELLS", 20)
    jobs = _clustered(spark, groups=60)
    idx = ivf_ops.build_index(jobs, "job_id", "title_vec", nlist=60, nprobe=4)
    assert 50 <= idx.nlist <= 70 and int(idx.bounds[:, 0].sum()) == 1501
    q = jobs.where("job_id % 10 = 0 and job_id < 1500").withColumnRenamed("job_id", "cv_id")
    kw = dict(query_id="cv_id", query_vec="title_vec")
    want = set(x[:2] for x in _found(exact_top_k(q, jobs, 10, item_id="job_id", item_vec="title_vec", **kw)))
    got = set(x[:2] for x in _found(ivf_ops.search(idx, q, 10, out_item="job_id", **kw)))
    assert len(want & got) / len(want) >= 0.95                      # while 4 of about 60 cells are read
    assert set(x[:2] for x in _found(ivf_ops.search_bounded(idx, q, 10, out_item="job_id", **kw).result)) == want


def test_cells_grow_with_the_corpus():
    assert [ivf_ops.effective_nlist(n, None) for n in (5, 1000, 10_000, 10**8)] == [1, 100, 400, 40_000]


def test_index_deltas_equal_a_rebuilt_index(spark, tmp_path):
    jobs, path = _clustered(spark, n=600), str(tmp_path / "idx")
    kw = dict(nlist=20, calibrate=False)
    ivf_ops.load_or_build(jobs, "job_id", "title_vec", path, **kw)
    steps = [jobs.where("job_id % 50 <> 3"),                                            # deleted
             jobs.where("job_id % 50 <> 3").withColumn("title_vec", F.when(F.col("job_id") % 40 == 1, F.reverse("title_vec")).otherwise(F.col("title_vec"))),
             jobs.where("job_id % 50 <> 3").unionByName(spark.createDataFrame([(9000 + i, [float(i % 3)] * 16) for i in range(9)] + [(9100, [1.0, 2.0])], jobs.schema))]
    for n, now in enumerate(steps, 2):
        idx, reused = ivf_ops.load_or_build(now, "job_id", "title_vec", path, **kw)
        assert not reused and len(ivf_ops.current_version(spark, path)[1]["ids"]) == n  # one more delta, no rebuild
        q = now.withColumnRenamed("job_id", "cv_id")
        ask = dict(query_id="cv_id", query_vec="title_vec")
        want = _found(exact_top_k(q, now, 4, item_id="job_id", item_vec="title_vec", **ask))
        assert _found(ivf_ops.search_bounded(idx, q, 4, out_item="job_id", **ask).result) == want
        assert ivf_ops.load_or_build(now, "job_id", "title_vec", path, **kw)[1]
    idx, reused = ivf_ops.load_or_build(now.where("job_id < 300"), "job_id", "title_vec", path, **kw)
    assert not reused and len(ivf_ops.current_version(spark, path)[1]["ids"]) == 1      # too much has changed: built anew


def test_other_settings_are_another_index(spark, tmp_path):
    jobs, path = _corpus(spark, n=200), str(tmp_path / "idx")
    ivf_ops.load_or_build(jobs, "job_id", "title_vec", path, nlist=10, nprobe=1)
    idx, reused = ivf_ops.load_or_build(jobs, "job_id", "title_vec", path, nlist=15, nprobe=15)
    assert not reused and (idx.nlist, idx.nprobe) == (15, 15)


def test_fingerprint_sees_repeated_rows(spark):
    one = _corpus(spark, n=20)
    more = one.unionByName(one.where("job_id = 3")).unionByName(one.where("job_id = 3"))
    other = one.unionByName(one.where("job_id = 4")).unionByName(one.where("job_id = 4"))
    fp = [ivf_ops.corpus_fingerprint(x, "job_id", "title_vec") for x in (one, more, other)]
    assert len(set(fp)) == 3


def test_effective_nlist():
    assert ivf_ops.effective_nlist(5, 100) == 1
    assert ivf_ops.effective_nlist(279, 100) == 27
    assert ivf_ops.effective_nlist(5000, 100) == 100


def test_index_save_load_and_reuse(spark, tmp_path):
    jobs = _corpus(spark, n=120)
    path = str(tmp_path / "idx")
    idx, reused = ivf_ops.load_or_build(jobs, "job_id", "title_vec", path, nlist=5, nprobe=2)
    assert not reused
    idx2, reused2 = ivf_ops.load_or_build(jobs, "job_id", "title_vec", path, nlist=5, nprobe=2)
    assert reused2 and idx2.nlist == idx.nlist and np.allclose(idx2.centroids, idx.centroids)
    changed = jobs.where("job_id <> 3")
    _, reused3 = ivf_ops.load_or_build(changed, "job_id", "title_vec", path, nlist=5, nprobe=2)
    assert not reused3                                          # corpus changed -> rebuilt


def test_ivf_may_return_fewer_than_k(spark):
    jobs = _corpus(spark, n=60)
    idx = ivf_ops.build_index(jobs, "job_id", "title_vec", nlist=6, nprobe=1)
    q = jobs.select(F.col("job_id").alias("cv_id"), "title_vec").limit(5)
    got = ivf_ops.search(idx, q, 50, query_id="cv_id", query_vec="title_vec", out_item="job_id")
    counts = [r["count"] for r in got.groupBy("cv_id").count().collect()]
    assert all(c < 50 for c in counts)


def test_hot_cell_is_split_and_search_stays_exact(spark):
    # A third of the corpus sits on (almost) one direction: with given centroids it all lands in
    # one cell, which must be cut into splits of at most split_rows.
    rng = np.random.default_rng(11)
    hot = [(i, [float(x) for x in (np.array([5.0, 0, 0, 0]) + 0.01 * rng.normal(size=4))]) for i in range(100)]
    rest = [(100 + i, [float(x) for x in rng.normal(size=4)]) for i in range(200)]
    jobs = spark.createDataFrame(hot + rest, "job_id long, title_vec array<float>")
    cent = np.array([[1.0, 0, 0, 0], [0, 1.0, 0, 0], [0, 0, 1.0, 0], [0, 0, 0, 1.0], [-1.0, 0, 0, 0]])
    idx = ivf_ops.build_index(jobs, "job_id", "title_vec", centroids=cent, nprobe=5, split_rows=20)
    sizes = {r["cell"]: r["count"] for r in idx.cells.groupBy("cell").count().collect()}
    hot_cell = max(sizes, key=sizes.get)
    assert sizes[hot_cell] >= 100 and idx.splits[hot_cell] >= 5
    per_key = idx.cells.groupBy("cell", "split").count().agg(F.max("count")).first()[0]
    assert per_key <= 45                      # hash splits: about split_rows rows per join key
    q = jobs.select(F.col("job_id").alias("cv_id"), "title_vec")
    a = ivf_ops.search(idx, q, 5, query_id="cv_id", query_vec="title_vec", out_item="job_id", block_rows=16)
    b = exact_top_k(q, jobs, 5, query_id="cv_id", query_vec="title_vec", item_id="job_id", item_vec="title_vec")
    assert sorted((r["cv_id"], r["job_id"]) for r in a.collect()) == sorted((r["cv_id"], r["job_id"]) for r in b.collect())


def test_aborted_index_write_leaves_the_old_one(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "idx")
    jobs = _corpus(spark, n=60)
    idx, _ = ivf_ops.load_or_build(jobs, "job_id", "title_vec", path, nlist=4)

    def fail(*a):
        raise RuntimeError("stopped before the new index is current")

    with monkeypatch.context() as m:
        m.setattr(ivf_ops, "commit_version", fail)
        with pytest.raises(RuntimeError):
            ivf_ops.load_or_build(jobs.where("job_id > 5"), "job_id", "title_vec", path, nlist=4)
    assert ivf_ops.load_index(spark, path).fingerprint == tuple(idx.fingerprint)
    _, reused = ivf_ops.load_or_build(jobs.where("job_id > 5"), "job_id", "title_vec", path, nlist=4)
    assert not reused and ivf_ops.load_index(spark, path).cells.where("job_id <= 5").count() == 0


def test_edges_are_scored_without_vectors_in_a_join(spark):
    """A round scores narrow edges in tiles (no join carries vectors); repeated and unknown ids behave as in an inner join."""
    from matchspark.functions.vector import defaulted_similarity
    from matchspark.operators.cascade import _scored
    cvs = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 2.0]), (2, None), (3, [1.0, 1.0, 1.0]), (4, [0.0, 0.0]), (None, [1.0, 0.0])], "cv_id long, a array<float>")
    jobs = spark.createDataFrame([(10, [1.0, 1.0]), (11, []), (11, [3.0, 4.0]), (12, [2.0, 0.0])], "job_id long, b array<double>")
    edges = spark.createDataFrame([(c, j, "x") for c in (1, 2, 3, 4, 5, None) for j in (10, 11, 12, 13)], "cv_id long, job_id long, tag string")
    got = _scored(edges, cvs, jobs, "a", "b", "s")
    want = edges.join(cvs, "cv_id").join(jobs, "job_id").select("cv_id", "job_id", "tag", defaulted_similarity("a", "b").alias("s"))
    rows = lambda df: sorted((r["cv_id"], r["job_id"], r["tag"], round(r["s"], 9)) for r in df.collect())
    assert rows(got) == rows(want)
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()


def test_probed_cells_are_one_row_a_query_and_group(spark):
    """A query goes to a group of cells once, not once per cell that it reads."""
    rng = np.random.default_rng(8)
    jobs = spark.createDataFrame([(i, _v(rng, 8)) for i in range(600)], "job_id long, title_vec array<float>")
    idx = ivf_ops.build_index(jobs, "job_id", "title_vec", nlist=30, nprobe=30)
    probes = jobs.select(F.col("job_id").alias("_q"), F.col("title_vec").alias("_v"),
                         ivf_ops.probe_bits_udf(idx.centroids, 30)(F.col("title_vec"))["reads"].alias("_reads"))
    _, membership = ivf_ops._cell_groups(idx)
    sent = probes.select(F.explode(ivf_ops.groups_read_udf(membership)(F.col("_reads"))))
    assert membership.shape == (30, 1) and sent.count() == 600
    assert ivf_ops._score_cells(idx, probes, 5, False, 64).count() == 600 * 5


def test_tiles_pass_on_lists_only(spark, monkeypatch):
    """F8, F11, F25: what leaves the tiles of a round is at most k edges per CV and group of jobs, and no edge is a row of its own on the way there."""
    cvs, jobs = _entities(spark, n_cv=7, n_job=300, seed=5)
    edges = exact_top_k(cvs, jobs, 300, query_id="cv_id", query_vec="title_vec", item_id="job_id", item_vec="title_vec").select(
        "cv_id", "job_id", F.col("rank").alias("r1"))
    monkeypatch.setattr(cascade_ops, "EDGES_HELD", 100)
    got = cascade_ops._scored(edges, cvs, jobs, "experience_vec", "requirement_vec", "s", 9, "r1").collect()
    assert len(got) == 7 * 9
    scores = {}
    all_ = cascade_ops._scored(edges, cvs, jobs, "experience_vec", "requirement_vec", "s", 300, "r1").collect()
    assert len(all_) == 7 * 300
    for r in all_:
        scores.setdefault(r["cv_id"], []).append((-r["s"], r["r1"], r["job_id"]))
    for cv, rows in scores.items():
        assert {r["job_id"] for r in got if r["cv_id"] == cv} == {j for *_, j in sorted(rows)[:9]}


def test_ties_and_missing_scores_leave_a_tile_as_a_window_ranks_them():
    import pyarrow as pa

    best = cascade_ops.Best(2, "s", "r")
    for cv, r, s in (([0, 0, 0, 1], [3, 2, 1, 1], [0.5, 0.5, 0.5, None]), ([1, 1], [2, 3], [float("nan"), 0.1])):
        best.add(np.array(cv), pa.RecordBatch.from_arrays([pa.array(cv), pa.array(r, pa.int32()), pa.array(s, pa.float64())], names=["cv", "r", "s"]))
    kept = [(x["cv"], x["r"]) for b in best.lists() for x in b.to_pylist()]
    assert sorted(kept) == [(0, 1), (0, 2), (1, 2), (1, 3)]


def test_bounded_search_reads_the_rest_at_once_where_bounds_rule_out_little(spark, tmp_path):
    """vectors without structure take two rounds, and so two tables of lists, however many cells there are."""
    rng = np.random.default_rng(9)
    jobs = spark.createDataFrame([(i, _v(rng, 32)) for i in range(600)], "job_id long, title_vec array<float>")
    cvs = spark.createDataFrame([(i, _v(rng, 32)) for i in range(20)], "cv_id long, title_vec array<float>")
    index = ivf_ops.build_index(jobs, "job_id", "title_vec", nlist=40, nprobe=1)
    found = ivf_ops.search_bounded(index, cvs, 5, query_id="cv_id", query_vec="title_vec", out_item="job_id", folder=str(tmp_path / "s"))
    exact = exact_top_k(cvs, jobs, 5, query_id="cv_id", query_vec="title_vec", item_id="job_id", item_vec="title_vec")
    rows = lambda d: sorted(map(tuple, d.select("cv_id", "job_id", "rank").collect()))
    assert rows(found.result) == rows(exact)
    assert sorted(p.name for p in (tmp_path / "s").iterdir() if p.name.startswith("lists")) == ["lists-0", "lists-1"]


def test_many_queries_read_all_at_once_where_a_few_tell_that_bounds_rule_out_little(spark, tmp_path, monkeypatch):
    """without structure there are no rounds and no tables of lists; with structure the bounds are used. The lists are exact either way."""
    monkeypatch.setattr(ivf_ops, "PILOT", 3)
    rng = np.random.default_rng(10)
    plain = spark.createDataFrame([(i, _v(rng, 24)) for i in range(500)] + [(900, [1.0, 2.0])], "job_id long, title_vec array<float>")
    rows = lambda d: sorted(map(tuple, d.select("cv_id", "job_id", "rank").collect()))
    for name, jobs, at_once in (("plain", plain, True), ("clustered", _clustered(spark, n=600), False)):
        cvs = jobs.where("job_id % 3 = 0").withColumnRenamed("job_id", "cv_id")
        index = ivf_ops.build_index(jobs, "job_id", "title_vec", nlist=30, calibrate=False)
        kw = dict(query_id="cv_id", query_vec="title_vec", out_item="job_id")
        want = rows(exact_top_k(cvs, jobs, 4, query_id="cv_id", query_vec="title_vec", item_id="job_id", item_vec="title_vec"))
        for corpus in (None, (jobs, "title_vec")):
            folder = tmp_path / f"{name}-{corpus is None}"
            found = ivf_ops.search_bounded(index, cvs, 4, folder=str(folder), corpus=corpus, **kw)
            assert rows(found.result) == want
            assert folder.exists() != at_once
            assert (found.lists is not None) == (at_once and corpus is not None)
            assert (found.read.agg(F.min("cells")).first()[0] == 30) == at_once
