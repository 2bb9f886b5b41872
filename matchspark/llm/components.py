"""Connected components of a link table by alternating large-star and small-star rounds.

Each round is two groupings of the links by node; the number of rounds grows with the logarithm of the
longest way. A node that a third of all links share is met through aggregates only (minimum of the neighbours
before the shuffle); these are stored, so the join shuffles two plain scans and Spark can split a hot node. Links are stored between rounds (shared folder),
so a lost executor costs one round; the loop ends when a round changes nothing. Nothing but two
counts reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchspark.llm.common import stored

MOST_ROUNDS = 100


def _digest(links: DataFrame) -> tuple:
    r = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return r[0], r[1]


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Link each larger (large star) or each not larger (small star) neighbour of a node with the least of its neighbourhood."""
    if large:
        both = links.select(F.col("a").alias("n"), F.col("b").alias("o")).unionAll(links.select("b", "a").toDF("n", "o"))
        least = stored(both.groupBy("n").agg(F.least(F.col("n"), F.min("o")).alias("m")), "least")
        out = both.where(F.col("o") > F.col("n")).join(least, "n").select("m", "o")
    else:
        down = links.select(F.greatest("a", "b").alias("n"), F.least("a", "b").alias("o"))
        least = stored(down.groupBy("n").agg(F.min("o").alias("m")), "least")
        out = down.join(least, "n").select("m", "o").unionAll(least.select("m", F.col("n").alias("o")))
    return out.where(F.col("m") != F.col("o")).select(F.least("m", "o").alias("a"), F.greatest("m", "o").alias("b")).distinct()


def components(links: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) for all nodes of ``links`` (a, b)."""
    now = stored(links.where(F.col("a") != F.col("b")).select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    before = _digest(now)
    for _ in range(MOST_ROUNDS):
        if not before[0]:
            break
        now = stored(_star(_star(now, True), False), "links")
        after = _digest(now)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
    return now.select(F.col("b").alias("node"), F.col("a").alias("root"))
