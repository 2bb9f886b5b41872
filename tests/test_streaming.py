"""The refresh stream processes new job files and republishes both tables."""

import datetime as dt

import numpy as np

from matchspark.config import MatchConfig
from matchspark.operators.publish import read_current
from matchspark.streaming.refresh import start_refresh

JOB_SCHEMA = ("job_id long, title_vec array<float>, requirement_vec array<float>, skills_vec array<float>, "
              "status string, expires_at timestamp")


def test_refresh_available_now(spark, tmp_path):
    rng = np.random.default_rng(0)

    def v():
        return [float(x) for x in rng.normal(size=4)]

    jobs = [(i, v(), v(), v(), "ACTIVE", None) for i in range(30)]
    changes = tmp_path / "changes"
    spark.createDataFrame(jobs, JOB_SCHEMA).write.parquet(str(changes / "batch1"))
    cvs = spark.createDataFrame([(i, v(), v(), v(), True) for i in range(5)],
                                "cv_id long, title_vec array<float>, experience_vec array<float>, "
                                "skills_vec array<float>, is_main boolean")
    cfg = MatchConfig(strategy="exact", cascade_k1=20, cascade_k2=10, cascade_k3=5, as_of=dt.datetime(2024, 6, 1))
    wh = str(tmp_path / "wh")
    q = start_refresh(spark, str(changes / "*"), JOB_SCHEMA, cvs, cfg, wh, trigger={"availableNow": True})
    q.awaitTermination(300)
    recs = read_current(spark, wh + "/recommend_jobs_for_cv")
    sims = read_current(spark, wh + "/similar_jobs")
    assert recs.count() == 25 and sims.count() == 300
