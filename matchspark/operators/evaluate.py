"""Offline ranking evaluation and baselines.

Inputs are ranked lists ``(query, item, rank)`` with a boolean relevance column and, per
query, the number of relevant items in the whole corpus (``n_relevant``; for label relevance a
per-label count joined by label, never a query x corpus product). All metrics are group
aggregates per query followed by a global average; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchspark.functions.vector import dot
from matchspark.operators.relevance import jaccard, skill_match, string_similarity, title_rule_label, word_set  # noqa: F401


def _dcg_term(rank: Column) -> Column:
    return F.lit(1.0) / F.log2(rank.cast("double") + 1)


def ideal_dcg(n_relevant: Column, k: int) -> Column:
    """sum_{i=1..min(R, k)} 1 / log2(i + 1); 0 when nothing is relevant."""
    m = F.least(n_relevant, F.lit(k))
    return F.when(m >= 1, F.aggregate(F.sequence(F.lit(1), m.cast("int")), F.lit(0.0),
                                      lambda acc, i: acc + _dcg_term(i))).otherwise(F.lit(0.0))


def per_query(recs: DataFrame, q: str, rank: str, rel: str, n_rel: DataFrame, ks: list[int]) -> DataFrame:
    """One row per query with first relevant rank and, per k, DCG / hits / weighted hits."""
    aggs = [F.min(F.when(F.col(rel), F.col(rank))).alias("first_rel"), F.count(F.lit(1)).alias("list_len")]
    for k in ks:
        in_k = F.col(rel) & (F.col(rank) <= k)
        aggs += [
            F.sum(F.when(in_k, _dcg_term(F.col(rank))).otherwise(F.lit(0.0))).alias(f"dcg_{k}"),
            F.sum(F.when(in_k, 1).otherwise(0)).alias(f"hits_{k}"),
            F.sum(F.when(in_k, F.lit(1.0) / F.col(rank)).otherwise(F.lit(0.0))).alias(f"wsum_{k}"),
        ]
    pq = recs.groupBy(q).agg(*aggs).join(n_rel, q, "left").fillna(0, ["n_relevant"])
    for k in ks:
        idcg = ideal_dcg(F.col("n_relevant"), k)
        p = F.col(f"hits_{k}") / F.lit(float(k))
        r = F.when(F.col("n_relevant") > 0, F.col(f"hits_{k}") / F.col("n_relevant")).otherwise(F.lit(0.0))
        pq = (pq.withColumn(f"ndcg_{k}", F.when(idcg > 0, F.col(f"dcg_{k}") / idcg).otherwise(F.lit(0.0)))
              .withColumn(f"prec_{k}", p).withColumn(f"rec_{k}", r)
              .withColumn(f"f1_{k}", F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0))))
    return pq


def mrr(pq: DataFrame) -> DataFrame:
    return pq.agg(F.count(F.lit(1)).alias("queries"),
                  F.avg(F.coalesce(F.lit(1.0) / F.col("first_rel"), F.lit(0.0))).alias("mrr"))


def at_k(pq: DataFrame, ks: list[int], metrics: dict[str, callable]) -> DataFrame:
    """Rows (k, metric...) averaged over queries: one aggregate of all k, so the lists are made and read once."""
    whole = pq.agg(*[fn(k).alias(f"{name}_{k}") for k in ks for name, fn in metrics.items()])
    rows = [F.struct(F.lit(k).alias("k"), *[F.col(f"{name}_{k}").alias(name) for name in metrics]) for k in ks]
    return whole.select(F.explode(F.array(*rows)).alias("_r")).select("_r.k", *[f"_r.{name}" for name in metrics])


def coverage_ratio(recs: DataFrame, item: str, corpus: DataFrame, corpus_item: str) -> DataFrame:
    """Share of corpus items recommended at least once: one aggregate over the tagged union."""
    tagged = recs.select(F.col(item).alias("_i"), F.lit(True).alias("_rec")).unionByName(
        corpus.select(F.col(corpus_item).alias("_i"), F.lit(False).alias("_rec")))
    agg = tagged.agg(F.count_distinct(F.when(F.col("_rec"), F.col("_i"))).alias("recommended_items"),
                     F.count_distinct(F.when(~F.col("_rec"), F.col("_i"))).alias("corpus_items"))
    return agg.withColumn("coverage", F.col("recommended_items") / F.col("corpus_items"))


def diversity(recs_with_vec: DataFrame, q: str, unit_vec: str) -> DataFrame:
    """Mean intra-list diversity: average over pairs (i<j) of 1 - cos(u_i, u_j) per list.

    Uses sum_{i!=j} u_i.u_j = |sum u|^2 - sum |u|^2, so no pairs are formed: one vector sum per
    query (``Summarizer``, partial sums before the shuffle, one row per list and task).
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    unit = F.col(unit_vec)
    lists = recs_with_vec.where(unit.isNotNull()).groupBy(q).agg(
        Summarizer.sum(array_to_vector(unit)).alias("s"), F.sum(dot(unit, unit)).alias("sq"), F.count(F.lit(1)).alias("m"))
    total = vector_to_array("s")
    d = lists.where(F.col("m") >= 2).select((F.lit(1.0) - (dot(total, total) - F.col("sq"))
                                             / (F.col("m") * (F.col("m") - 1))).alias("div"))
    return d.agg(F.count(F.lit(1)).alias("lists"), F.avg("div").alias("diversity"))


def interaction_rates(recs: DataFrame, events: DataFrame, keys: list[str], kind: str,
                      click: str = "click", apply: str = "purchase") -> DataFrame:
    """Impressions = recommended pairs; clicks / applies = pairs with such an interaction."""
    ev = events.groupBy(*keys).agg(
        F.max(F.when(F.col(kind) == click, 1).otherwise(0)).alias("clicked"),
        F.max(F.when(F.col(kind) == apply, 1).otherwise(0)).alias("applied"))
    j = recs.select(*keys).distinct().join(ev, keys, "left").fillna(0, ["clicked", "applied"])
    return j.agg(F.count(F.lit(1)).alias("impressions"), F.sum("clicked").alias("clicks"),
                 F.sum("applied").alias("applies")).select(
        "impressions", "clicks", "applies",
        (F.col("clicks") / F.col("impressions")).alias("ctr"),
        (F.col("applies") / F.col("impressions")).alias("apply_rate"))


def rates_by_version(lists: DataFrame, versions: DataFrame, events: DataFrame, keys: list[str], at: str, kind: str, window_days: int,
                     click: str = "click", apply: str = "purchase") -> DataFrame:
    """Click and apply rates of each published version of the lists, by as-of attribution: an interaction counts for the version
    that was current at its time, if that version listed the pair and was at most ``window_days`` old.

    ``lists``: version and the pair's ``keys``; ``versions``: version, valid_from (a handful of rows, one per publish); a version
    ends where the next begins. The pair is an equality key, so the range condition only looks at the events of one pair."""
    spans = versions.select("version", "valid_from", F.lead("valid_from").over(Window.orderBy("valid_from")).alias("_next"))
    spans = spans.withColumn("valid_to", F.least(F.col("valid_from") + F.make_dt_interval(F.lit(window_days)), "_next")).drop("_next")
    shown = lists.select("version", *keys).distinct().join(F.broadcast(spans), "version")
    seen = events.select(*keys, F.col(at).alias("_at"), F.col(kind).alias("_kind")).where(F.col(kind).isin(click, apply))
    hits = (shown.join(seen, keys).where((F.col("_at") >= F.col("valid_from")) & (F.col("_at") < F.col("valid_to")))
            .groupBy("version", *keys).agg(F.max((F.col("_kind") == click).cast("int")).alias("clicked"),
                                           F.max((F.col("_kind") == apply).cast("int")).alias("applied")))
    both = shown.select("version", *keys).join(hits, ["version", *keys], "left").fillna(0, ["clicked", "applied"])
    return both.groupBy("version").agg(
        F.count(F.lit(1)).alias("impressions"), F.sum("clicked").alias("clicks"), F.sum("applied").alias("applies"),
        F.avg("clicked").alias("ctr"), F.avg("applied").alias("apply_rate"))


def hash_number(*parts: Column) -> Column:
    """The first 60 bits of md5 over the parts joined by ``:``, as a long."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]).cast("binary")), 1, 15), 16, 10).cast("long")


def dense_positions(items: DataFrame, item: str, out: str = "_pos") -> DataFrame:
    """Items numbered 0..n-1 in the order (first two hex digits of md5(item), item), without a global sort: a
    window per md5 bucket plus the sizes of the buckets before it (256 rows)."""
    rows = items.select(item).distinct().withColumn("_b", F.substring(F.md5(F.col(item).cast("string").cast("binary")), 1, 2))
    base = rows.groupBy("_b").count().withColumn(
        "_base", F.coalesce(F.sum("count").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    within = F.row_number().over(Window.partitionBy("_b").orderBy(item)) - 1
    return rows.withColumn("_i", within).join(F.broadcast(base.select("_b", "_base")), "_b").select(
        item, (F.col("_base") + F.col("_i")).alias(out))


def random_top_k(queries: DataFrame, q: str, corpus: DataFrame, item: str, k: int, seed: int = 7) -> DataFrame:
    """Random baseline: each query draws 2k corpus positions by a seeded md5, then the k positions behind the first draw, and
    keeps the first k distinct ones (all items if there are fewer). No query x corpus pairs."""
    n = corpus.select(item).distinct().count()
    draws = queries.select(q, F.explode(F.sequence(F.lit(0), F.lit(3 * k - 1))).alias("_d"))
    drawn = F.when(F.col("_d") < 2 * k, hash_number(F.lit(seed), F.col(q), F.col("_d"))).otherwise(
        hash_number(F.lit(seed), F.col(q), F.lit(0)) + F.col("_d"))
    draws = draws.withColumn("_pos", F.pmod(drawn, F.lit(max(1, n))))
    first = draws.groupBy(q, "_pos").agg(F.min("_d").alias("_d"))
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy(q).orderBy("_d"))).where(F.col("rank") <= k)
    return ranked.join(dense_positions(corpus, item), "_pos").select(q, item, "rank")
