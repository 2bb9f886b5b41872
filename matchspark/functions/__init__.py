from matchspark.functions.vector import (  # noqa: F401
    clamp01,
    cosine,
    defaulted_similarity,
    dot,
    l2_normalize,
    norm,
    present,
    weighted_similarity,
)
