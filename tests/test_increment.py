"""Incremental runs: after every kind of change the published tables equal those of a full run."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchspark.config import MatchConfig
from matchspark.plans import runs

CFG = MatchConfig(strategy="exact", top_k_jobs=6, cascade_k1=12, cascade_k2=6, cascade_k3=3, similar_top_k=4, reserve=3)


def _entities(spark, edit):
    rng = np.random.default_rng(3)
    cvs, jobs = ([[i, *[[float(x) for x in rng.normal(size=6)] for _ in range(3)]] for i in range(n)] for n in (25, 60))
    if edit:
        jobs[5][1] = jobs[5][1][::-1]                       # another title
        jobs[6][3] = jobs[6][3][::-1]                       # other skills only
        cvs[2][2] = None                                    # other experience only
        cvs[3][1] = cvs[3][1][::-1]
        cvs[4][1] = None                                    # lost its vector
        jobs[7][1] = None
        del jobs[20:29], cvs[9]
        jobs += [[100 + i, cvs[i][1] or [1.0] * 6, None, None] for i in range(4)]       # best match of some CVs
        cvs += [[200, *cvs[0][1:]]]
    kind = "long, title_vec array<float>, {} array<float>, skills_vec array<float>"
    return (spark.createDataFrame(cvs, "cv_id " + kind.format("experience_vec")),
            spark.createDataFrame(jobs, "job_id " + kind.format("requirement_vec")))


def _table(df, *keys):
    return sorted((*(r[k] for k in keys), r["rank"], round(r["similarity"], 6)) for r in df.collect())


@pytest.mark.parametrize("cascade", [True, False])
def test_incremental_equals_full(spark, tmp_path, cascade):
    cfg, warehouse = replace(CFG, use_cascade=cascade), str(tmp_path / "inc")
    cvs, jobs = _entities(spark, False)
    runs.incremental_run(spark, cvs, jobs, cfg, warehouse)
    cvs, jobs = _entities(spark, True)
    again = runs.incremental_run(spark, cvs, jobs, cfg, warehouse)
    full = runs.full_run(spark, cvs, jobs, cfg, str(tmp_path / "two"))
    assert _table(again.recommendations, "cv_id", "job_id") == _table(full.recommendations, "cv_id", "job_id")
    assert _table(again.similar, "job_id", "similar_job_id") == _table(full.similar, "job_id", "similar_job_id")
    n = {r["metric"]: r["value"] for r in again.stats.collect()}
    assert n["cv_lists"] == 24 and n["cv_lists_searched"] < n["cv_lists"]
    quiet = {r["metric"]: r["value"] for r in runs.incremental_run(spark, cvs, jobs, cfg, warehouse).stats.collect()}
    assert quiet["cv_lists_made"] == quiet["job_lists_made"] == quiet["cv_lists_searched"] == 0


def test_counters_are_observed_while_writing(spark, tmp_path):
    cvs, jobs = _entities(spark, True)
    stats = {r["metric"]: r["value"] for r in runs.full_run(spark, cvs, jobs, CFG, str(tmp_path / "w")).stats.collect()}
    assert stats == {"recommendations": 72, "similar_pairs": 54 * 4, "cvs_processed": 25, "cvs_with_vector": 24, "jobs_processed": 55, "jobs_with_vector": 54}
    kept = runs.recommend(spark, cvs, jobs, replace(CFG, keep_stale=True), str(tmp_path / "k"))
    assert kept.stats.where("metric = 'cvs_processed'").first()["value"] == 25 and kept.recommendations.where(F.col("cv_id") == 0).count() == 3


def test_stored_lists_are_rows_of_many_entries(spark, tmp_path):
    """an incremental run stores and merges lists as lists, with their floors, not a row per entry."""
    from matchspark.operators.publish import read_current

    state = str(tmp_path / "inc" / "_state" / "title-lists-cv")
    want = {}
    for edit in (False, True):
        cvs, jobs = _entities(spark, edit)
        runs.incremental_run(spark, cvs, jobs, CFG, str(tmp_path / "inc"))
        stored = read_current(spark, state)
        n = cvs.where("title_vec is not null").count()
        assert stored.count() == n and all(r["r"] == list(range(1, len(r["r"]) + 1)) and r["s"] == sorted(r["s"], reverse=True) for r in stored.collect())
        # the floor of a full list is its last entry; a list that lost some keeps the one it had
        for r in stored.collect():
            full = len(r["c"]) == CFG.cascade_k1 + CFG.reserve
            assert (r["floor"], r["floor_item"]) == ((r["s"][-1], r["c"][-1]) if full else want[r["q"]])
            want[r["q"]] = r["floor"], r["floor_item"]
