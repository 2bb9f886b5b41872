"""Content hash, change detection, incremental embedding, keyed-replace publishing."""

import pytest
from pyspark.sql import functions as F

from matchspark.operators.content import collect_children, content_hash, diff_against_stored, joined_text
from matchspark.operators.embed import hashing_encode, incremental_embed
from matchspark.operators.publish import (dedupe_last, fill_null_update, keyed_replace, partial_update,
                                          publish_edges, read_current)


def _entity(spark, children):
    parents = spark.createDataFrame([(1, "Dev")], "id long, title string")
    ch = spark.createDataFrame(children, "id long, ord int, t string, d string")
    ent = collect_children(parents, ch, key="id", order=["ord"], values=["t", "d"], out="items")
    items = F.transform("items", lambda x: F.struct(x["t"].alias("title"), x["d"].alias("description")))
    return ent.select("id", "title", "items", content_hash(F.col("title"), F.array(), items).alias("h"))


def test_hash_separates_fields(spark):
    a = _entity(spark, [(1, 0, "ab", "c")]).first()["h"]
    b = _entity(spark, [(1, 0, "a", "bc")]).first()["h"]
    assert a != b            # title/description kept apart: no concatenation collision


def test_hash_stable_and_sensitive(spark):
    a = _entity(spark, [(1, 0, "x", "y"), (1, 1, "z", None)]).first()["h"]
    b = _entity(spark, [(1, 1, "z", ""), (1, 0, "x", "y")]).first()["h"]
    c = _entity(spark, [(1, 0, "x", "y"), (1, 1, "z", "edited")]).first()["h"]
    assert a == b            # NULL == "" and scan order does not matter
    assert a != c


def test_parent_without_children_gets_empty_list(spark):
    parents = spark.createDataFrame([(1,), (2,)], "id long")
    ch = spark.createDataFrame([(1, 0, "a")], "id long, ord int, v string")
    got = {r["id"]: r["c"] for r in collect_children(parents, ch, key="id", order=["ord"], values=["v"], out="c").collect()}
    assert len(got[1]) == 1 and got[2] == []


def test_joined_text(spark):
    df = spark.createDataFrame([([("a", "b"), (None, "c"), ("d", None)],)],
                               "items array<struct<t:string,d:string>>")
    assert df.select(joined_text("items", ["t", "d"]).alias("x")).first()["x"] == "a b  c d "


def test_diff_reasons(spark):
    cur = spark.createDataFrame([(1, "h1"), (2, "h2"), (3, "h3"), (4, "h4")], "id long, content_hash string")
    stored = spark.createDataFrame([(1, "h1", [1.0]), (2, "old", [1.0]), (3, "h3", [])],
                                   "id long, content_hash string, title_vec array<float>")
    got = {r["id"]: r["reason"] for r in diff_against_stored(cur, stored, key="id").collect()}
    assert got == {1: None, 2: "changed", 3: "no_vector", 4: "new"}


def test_incremental_embed_second_run_embeds_nothing(spark):
    cur = spark.createDataFrame([(1, "h1", "python dev", "sql"), (2, "h2", "  ", "")],
                                "id long, content_hash string, title string, skills string")
    fields = {"title": "title_vec", "skills": "skills_vec"}
    empty = spark.createDataFrame([], "id long, content_hash string, title_vec array<float>, skills_vec array<float>")
    first = incremental_embed(cur, empty, key="id", fields=fields, title_field="title", dim=32)
    rows = {r["id"]: r for r in first.collect()}
    assert rows[1]["embedded"] and len(rows[1]["title_vec"]) == 32
    assert rows[2]["title_vec"] == [] and rows[2]["skills_vec"] is None   # blank title -> [], blank other -> NULL
    second = incremental_embed(cur, first.drop("embedded"), key="id", fields=fields, title_field="title", dim=32)
    emb = {r["id"]: r["embedded"] for r in second.collect()}
    assert emb == {1: False, 2: True}     # an empty title vector is embedded again
    edited = cur.withColumn("content_hash", F.when(F.col("id") == 1, "h1b").otherwise(F.col("content_hash")))
    third = incremental_embed(edited, first.drop("embedded"), key="id", fields=fields, title_field="title", dim=32)
    assert {r["id"]: r["embedded"] for r in third.collect()}[1] is True


def test_hashing_encoder_deterministic(spark):
    df = spark.createDataFrame([("Python SQL",), ("python sql",)], "t string")
    v = [r["v"] for r in hashing_encode(df, "t", "v", 16).collect()]
    assert v[0] == v[1] and sum(x * x for x in v[0]) == pytest.approx(1.0, abs=1e-6)


def test_keyed_replace_and_keep_stale(spark):
    old = spark.createDataFrame([(1, 10, 0.1), (1, 11, 0.2), (2, 20, 0.3), (3, 30, 0.4)], "k long, d long, s double")
    new = spark.createDataFrame([(1, 12, 0.9)], "k long, d long, s double")
    processed = spark.createDataFrame([(1,), (2,)], "k long")
    a = sorted(tuple(r) for r in keyed_replace(old, new, "k", processed).collect())
    assert a == [(1, 12, 0.9), (3, 30, 0.4)]                     # key 2 processed with no result: cleared
    b = sorted(tuple(r) for r in keyed_replace(old, new, "k", processed, keep_stale=True).collect())
    assert b == [(1, 12, 0.9), (2, 20, 0.3), (3, 30, 0.4)]       # stale rows kept
    twice = keyed_replace(keyed_replace(old, new, "k", processed), new, "k", processed)
    assert sorted(tuple(r) for r in twice.collect()) == a       # idempotent


def test_dedupe_last_and_updates(spark):
    b = spark.createDataFrame([(1, 2, 0.1, 1), (1, 2, 0.7, 2), (1, 3, 0.5, 1)], "a long, b long, s double, seq int")
    got = sorted(tuple(r) for r in dedupe_last(b, ["a", "b"], "seq", ["s"]).collect())
    assert got == [(1, 2, 0.7), (1, 3, 0.5)]
    base = spark.createDataFrame([(1, "x", None), (2, "y", "IT")], "id long, v string, ind string")
    upd = spark.createDataFrame([(1, "x2"), (3, "z")], "id long, v string")
    assert sorted(tuple(r) for r in partial_update(base, upd, "id", ["v"]).collect()) == [(1, "x2", None), (2, "y", "IT")]
    inc = spark.createDataFrame([(1, "HR"), (2, "Sales")], "id long, ind string")
    assert sorted(tuple(r) for r in fill_null_update(base, inc, "id", "ind").collect()) == [(1, "x", "HR"), (2, "y", "IT")]


def test_publish_snapshots(spark, tmp_path):
    base = str(tmp_path / "edges")
    e1 = spark.createDataFrame([(1, 10, 0.5), (2, 20, 0.6)], "k long, d long, s double")
    publish_edges(spark, base, e1, "k")
    e2 = spark.createDataFrame([(1, 11, 0.9)], "k long, d long, s double")
    publish_edges(spark, base, e2, "k")
    assert sorted(tuple(r) for r in read_current(spark, base).collect()) == [(1, 11, 0.9), (2, 20, 0.6)]


def test_vector_json_roundtrip(spark):
    from matchspark.functions.vector import vector_from_json, vector_to_json
    df = spark.createDataFrame([([0.5, -1.25],), ([],), (None,)], "v array<float>")
    rows = df.select(vector_to_json("v").alias("j")).select("j", vector_from_json("j").alias("v")).collect()
    assert rows[0]["j"] == "[0.5,-1.25]" and rows[0]["v"] == [0.5, -1.25]
    assert rows[1]["v"] == [] and rows[2]["j"] is None and rows[2]["v"] is None


def test_point_reads(spark):
    import datetime as dt
    from matchspark.operators.serve import recommendations_for, similar_for
    recs = spark.createDataFrame([(1, 10, 0.2), (1, 11, 0.9), (2, 10, 0.5)], "cv_id long, job_id long, similarity double")
    jobs = spark.createDataFrame([(10, "ACTIVE", None), (11, "INACTIVE", None), (12, "ACTIVE", dt.datetime(2020, 1, 1))],
                                 "job_id long, status string, expires_at timestamp")
    assert [r["job_id"] for r in recommendations_for(recs, jobs, 1, limit=1).collect()] == [11]
    edges = spark.createDataFrame([(9, 10, 0.1), (9, 11, 0.9), (9, 12, 0.8)], "job_id long, similar_job_id long, similarity double")
    got = similar_for(edges, jobs, 9, dt.datetime(2024, 6, 1)).collect()
    assert [(r["similar_job_id"], r["position"]) for r in got] == [(10, 1)]   # inactive and expired dropped


def test_publish_after_an_aborted_write(spark, tmp_path, monkeypatch):
    from matchspark.operators import publish
    base = str(tmp_path / "edges")
    e1 = spark.createDataFrame([(1, 10, 0.5), (2, 20, 0.6)], "k long, d long, s double")
    publish_edges(spark, base, e1, "k")

    def fail(*a):
        raise RuntimeError("stopped after the data, before the version")

    with monkeypatch.context() as m:
        m.setattr(publish, "commit_version", fail)
        with pytest.raises(RuntimeError):
            publish_edges(spark, base, e1.where("k = 1"), "k")
    assert read_current(spark, base).count() == 2          # readers still see the last complete version
    publish_edges(spark, base, spark.createDataFrame([(1, 11, 0.9)], "k long, d long, s double"), "k")
    assert sorted(tuple(r) for r in read_current(spark, base).collect()) == [(1, 11, 0.9), (2, 20, 0.6)]


def test_publish_stops_on_a_read_error(spark, tmp_path, monkeypatch):
    """A table that cannot be read is not an empty table."""
    from matchspark.operators import publish
    base = str(tmp_path / "edges")
    e1 = spark.createDataFrame([(1, 10, 0.5), (2, 20, 0.6)], "k long, d long, s double")
    publish_edges(spark, base, e1, "k")

    def broken(*a):
        raise OSError("storage does not answer")

    with monkeypatch.context() as m:
        m.setattr(publish, "_fs", broken)
        with pytest.raises(OSError):
            publish_edges(spark, base, e1.where("k = 1"), "k")
    assert read_current(spark, base).count() == 2


def test_point_read_of_a_published_table_is_pruned(spark, tmp_path):
    base = str(tmp_path / "edges")
    publish_edges(spark, base, spark.range(1000).selectExpr("id as k", "id * 2 as d", "0.5 as s"), "k")
    one = read_current(spark, base).where("k = 77")
    assert [r["d"] for r in one.collect()] == [154]
    assert "EqualTo(k,77)" in one._jdf.queryExecution().executedPlan().toString()


def test_failing_text_keeps_its_old_hash(spark):
    """One text that the encoder refuses: the others of its call keep their vectors, it is tried again next time."""
    def factory():
        import numpy as np

        def encode(texts):
            if any("bad" in t for t in texts):
                raise ValueError("refused")
            return np.ones((len(texts), 4))
        return encode

    cur = spark.createDataFrame([(i, f"h{i}", "bad" if i == 3 else f"t{i}", "s") for i in range(8)],
                                "id long, content_hash string, title string, skills string").coalesce(1)
    stored = spark.createDataFrame([(3, "old", [0.5], [0.5])], "id long, content_hash string, title_vec array<float>, skills_vec array<float>")
    out = {r["id"]: r for r in incremental_embed(cur, stored, key="id", fields={"title": "title_vec", "skills": "skills_vec"},
                                                 title_field="title", encoder_factory=factory, batch_size=4).collect()}
    assert [i for i, r in out.items() if r["failed"]] == [3]
    assert out[3]["content_hash"] == "old" and out[3]["title_vec"] == [] and out[3]["skills_vec"] == [1.0] * 4
    assert all(out[i]["title_vec"] == [1.0] * 4 and out[i]["content_hash"] == f"h{i}" for i in range(8) if i != 3)


def _rows(spark, keys, value):
    return spark.createDataFrame([(k, k * 10 + value, float(value)) for k in keys], "k long, d long, s double")


def test_one_changed_key_rewrites_one_bucket(spark, tmp_path):
    from matchspark.operators import publish
    base = str(tmp_path / "edges")
    assert publish_edges(spark, base, _rows(spark, range(3000), 0), "k", buckets=1000)[1] == 1000
    before = publish.current_version(spark, base)[1]["of"]
    assert publish_edges(spark, base, _rows(spark, [77], 5), "k") == (2, 1)
    after = publish.current_version(spark, base)[1]["of"]
    assert sum(before.get(b) != after.get(b) for b in {*before, *after}) == 1
    assert [tuple(r) for r in publish.read_key(spark, base, 77).collect()] == [(77, 775, 5.0)]
    assert read_current(spark, base).count() == 3000


@pytest.mark.parametrize("one, two", [([1, 2], [2, 3]), ([1], [40]), ([5], [])])
def test_two_overlapping_writers_both_survive(spark, tmp_path, one, two):
    from matchspark.operators import publish
    base = str(tmp_path / "edges")
    publish_edges(spark, base, _rows(spark, range(50), 0), "k")
    a = publish.prepare_replace(spark, base, _rows(spark, one, 1), "k")
    b = publish.prepare_replace(spark, base, _rows(spark, two, 2), "k", processed_keys=spark.createDataFrame([(x,) for x in [*two, 9]], "k long"))
    assert publish.commit_replace(spark, a)[0] == 2 and publish.commit_replace(spark, b)[0] == 3
    want = {k: k * 10 for k in range(50)} | {k: k * 10 + 1 for k in one} | {k: k * 10 + 2 for k in two}
    want.pop(9)
    assert {r["k"]: r["d"] for r in read_current(spark, base).collect()} == want


def test_two_first_writers_both_survive(spark, tmp_path):
    from matchspark.operators import publish
    base = str(tmp_path / "edges")
    a, b = (publish.prepare_replace(spark, base, _rows(spark, k, 1), "k") for k in ([1], [2, 3]))
    publish.commit_replace(spark, a), publish.commit_replace(spark, b)
    assert sorted(r["k"] for r in read_current(spark, base).collect()) == [1, 2, 3]


def test_version_is_made_by_one_writer_only(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    from matchspark.operators import publish
    base = str(tmp_path / "t")

    def write(i):
        try:
            return publish.commit_version(spark, base, {"ids": [str(i)]}, 0)
        except publish.VersionConflict:
            return None

    with ThreadPoolExecutor(8) as pool:
        assert sorted(pool.map(write, range(24)), key=str).count(1) == 1


def test_appends_and_vacuum(spark, tmp_path):
    from matchspark.operators import publish
    base = str(tmp_path / "q")
    for i in range(3):
        publish.append_rows(_rows(spark, [i], 0), base)
    assert read_current(spark, base).count() == 3
    edges = str(tmp_path / "edges")
    for i in range(4):
        publish_edges(spark, edges, _rows(spark, range(40), i), "k")
    assert publish.vacuum(spark, edges) == []                                       # too young
    gone = publish.vacuum(spark, edges, keep_versions=1, older_than_s=-5)
    assert len(gone) == 3 and {r["s"] for r in read_current(spark, edges).collect()} == {3.0}
    publish_edges(spark, edges, _rows(spark, [1], 9), "k")
    assert read_current(spark, edges).count() == 40


def test_a_bucket_that_has_grown_is_cut(spark, tmp_path, monkeypatch):
    from matchspark.operators import publish
    base = str(tmp_path / "edges")
    publish_edges(spark, base, _rows(spark, range(500), 0), "k", buckets=4)
    monkeypatch.setattr(publish, "MOST_BUCKET_BYTES", 1000)
    assert publish_edges(spark, base, _rows(spark, [7], 5), "k") == (2, 16)
    assert publish.current_version(spark, base)[1]["buckets"] == 16 and read_current(spark, base).count() == 500
    assert [r["d"] for r in publish.read_key(spark, base, 7).collect()] == [75]
