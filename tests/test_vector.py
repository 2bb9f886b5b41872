"""Vector functions: the fixed cases of the fixture list plus properties."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from matchspark.functions.vector import (clamp01, cosine, defaulted_similarity, l2_normalize, present,
                                         weighted_similarity)


def _one(spark, a, b, expr):
    df = spark.createDataFrame([(a, b)], "a array<float>, b array<float>")
    return df.select(expr(F.col("a"), F.col("b")).alias("x")).first()["x"]


@pytest.mark.parametrize("a,b,expected", [
    ([0.0, 0.0], [1.0, 0.0], 0.0),          # zero norm
    ([1.0, 0.0], [1.0, 0.0, 0.0], 0.0),     # shape mismatch
    (None, [1.0, 0.0], 0.0),                # absent (NULL)
    ([], [1.0, 0.0], 0.0),                  # absent (empty)
    ([1.0, 0.0], [-1.0, 0.0], -1.0),        # opposite, unclamped
    ([3.0, 4.0], [3.0, 4.0], 1.0),
])
def test_cosine_cases(spark, a, b, expected):
    assert _one(spark, a, b, cosine) == pytest.approx(expected)


def test_clamp_opposite(spark):
    assert _one(spark, [1.0, 0.0], [-1.0, 0.0], lambda a, b: clamp01(cosine(a, b))) == 0.0


@pytest.mark.parametrize("q,i,expected", [
    (None, [1.0, 0.0], 0.3),        # query side absent
    ([1.0, 0.0], None, 0.5),        # item side absent
    (None, None, 0.3),              # both absent: query side tested first
    ([1.0, 0.0], [0.0, 1.0], 0.0),
])
def test_defaulted(spark, q, i, expected):
    assert _one(spark, q, i, defaulted_similarity) == pytest.approx(expected)


def test_present_and_normalize(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), ([],), (None,)], "v array<float>")
    rows = df.select(present("v").alias("p"), l2_normalize("v").alias("u")).collect()
    assert [r["p"] for r in rows] == [True, True, False, False]
    assert rows[0]["u"] == pytest.approx([0.6, 0.8])
    assert rows[1]["u"] == [0.0, 0.0]          # zero vector left as is
    assert rows[3]["u"] is None


def test_weighted_zero_weights(spark):
    df = spark.range(1)
    assert df.select(weighted_similarity([(F.lit(0.7), 0.0)]).alias("x")).first()["x"] == 0.0
    v = df.select(weighted_similarity([(F.lit(1.0), 0.5), (F.lit(0.0), 0.5)]).alias("x")).first()["x"]
    assert v == pytest.approx(0.5)


vec = st.lists(st.floats(-10, 10, allow_nan=False, width=32), min_size=3, max_size=3)


@settings(max_examples=25, deadline=None)
@given(vec, vec)
def test_cosine_properties(spark, a, b):
    ab = _one(spark, a, b, cosine)
    ba = _one(spark, b, a, cosine)
    assert ab == pytest.approx(ba, abs=1e-12)
    assert -1.0 - 1e-9 <= ab <= 1.0 + 1e-9
    na, nb = np.linalg.norm(np.array(a, dtype=np.float32).astype(float)), np.linalg.norm(np.array(b, dtype=np.float32).astype(float))
    if na > 0 and nb > 0:
        expect = float(np.dot(np.array(a, dtype=np.float32).astype(float), np.array(b, dtype=np.float32).astype(float)) / (na * nb))
        assert ab == pytest.approx(expect, abs=1e-9)
    else:
        assert ab == 0.0
    assert not math.isnan(ab)
