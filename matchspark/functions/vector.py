"""Column expressions over ``ARRAY<FLOAT>`` / ``ARRAY<DOUBLE>`` vectors.

All JVM-side higher-order functions; no Python per row. Scores are doubles.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def present(v) -> Column:
    """A vector is absent when NULL or empty (both count as missing)."""
    v = _c(v)
    return F.coalesce(v.isNotNull() & (F.size(v) > 0), F.lit(False))


def dot(a, b) -> Column:
    """Sum of element products in double; NULL if either side is NULL."""
    prods = F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prods, F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def norm(v) -> Column:
    return F.sqrt(dot(v, v))


def l2_normalize(v) -> Column:
    """Unit-length copy as ARRAY<DOUBLE>; a zero vector is left as is (no division by zero)."""
    v = _c(v)

    # The norm is bound once per row (a lambda variable): referencing it inside the element
    # lambda directly would recompute it for every element.
    def scale(n):
        return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n)) \
            .otherwise(F.transform(v, lambda x: x.cast("double")))

    return F.when(v.isNull(), F.lit(None).cast("array<double>")) \
        .otherwise(F.element_at(F.transform(F.array(norm(v)), scale), 1))


def cosine(a, b) -> Column:
    """Cosine similarity; 0.0 when a side is absent, shapes differ or a norm is zero."""
    a, b = _c(a), _c(b)
    ok = present(a) & present(b) & (F.size(a) == F.size(b))
    # Bind the three reductions once per row (each is used twice below).
    parts = F.array(F.struct(dot(a, b).alias("d"), norm(a).alias("na"), norm(b).alias("nb")))
    value = F.element_at(F.transform(parts, lambda p: F.when((p["na"] == 0) | (p["nb"] == 0), F.lit(0.0))
                                     .otherwise(p["d"] / (p["na"] * p["nb"]))), 1)
    return F.when(~ok, F.lit(0.0)).otherwise(value)


def clamp01(s) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), _c(s)))


def defaulted_similarity(query_vec, item_vec, query_absent: float = 0.3,
                         item_absent: float = 0.5) -> Column:
    """Cascade field score: query side absent first, then item side absent, else cosine."""
    return (
        F.when(~present(query_vec), F.lit(float(query_absent)))
        .when(~present(item_vec), F.lit(float(item_absent)))
        .otherwise(cosine(query_vec, item_vec))
    )


def defaulted_normed_similarity(query_vec, query_norm, item_vec, item_norm, query_absent: float = 0.3,
                                item_absent: float = 0.5) -> Column:
    """``defaulted_similarity`` with the norms computed once per entity: one dot product per pair instead of
    a dot and two norms, on the vectors in their stored (float) form."""
    q, i, scale = _c(query_vec), _c(item_vec), _c(query_norm) * _c(item_norm)
    return (
        F.when(~present(q), F.lit(float(query_absent)))
        .when(~present(i), F.lit(float(item_absent)))
        .when((F.size(q) != F.size(i)) | (scale == 0), F.lit(0.0))
        .otherwise(dot(q, i) / scale)
    )


def weighted_similarity(pairs: list[tuple[Column, float]]) -> Column:
    """Sum(w_i * s_i) / Sum(w_i); 0.0 when the weights sum to zero."""
    total = float(sum(w for _, w in pairs))
    if total == 0:
        return F.lit(0.0)
    expr = None
    for s, w in pairs:
        term = _c(s) * F.lit(float(w))
        expr = term if expr is None else expr + term
    return expr / F.lit(total)


def vector_to_json(v) -> Column:
    """Vector as JSON array text (storage format of the source tables)."""
    return F.when(_c(v).isNotNull(), F.to_json(_c(v)))


def vector_from_json(text) -> Column:
    """JSON array text -> ARRAY<FLOAT>; NULL stays NULL, "[]" is an empty (absent) vector."""
    return F.from_json(_c(text), "array<float>")
