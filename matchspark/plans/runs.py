"""Job runs: CV->job recommendation, job->job similarity, and both in either order.

A run takes the entity tables (main CVs, active jobs with vectors), reuses or builds the
shared IVF index (stored under the warehouse folder, kept up to date when the job corpus changes),
computes the lists (exactly, whether by blocks or by the bounds of the index's cells), publishes them with a keyed replace into snapshot tables and returns the
statistics as a one-row DataFrame. The warehouse folder must be shared storage on a cluster;
by default it is ``<spark.checkpoint.dir>/warehouse``.
"""

from __future__ import annotations

import os
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from matchspark.config import MatchConfig
from matchspark.functions.vector import present
from matchspark.operators import ivf as ivf_ops
from matchspark.operators.cascade import cascade
from matchspark.operators.embed import incremental_embed
from matchspark.operators.increment import Updated, as_lists, changed_ids, entity_hashes, entries, first_of, update_lists, with_floor
from matchspark.operators.publish import BUCKET_ROWS, FEWEST_BUCKETS, MOST_BUCKETS, publish_edges, read_current, remove_folder
from matchspark.operators.topk import TopLists, top_k_lists
from matchspark.session import ensure_checkpoint_dir, materialize


@dataclass
class RunResult:
    recommendations: DataFrame | None = None
    similar: DataFrame | None = None
    stats: DataFrame | None = None


def warehouse_dir(spark: SparkSession, name: str | None = None) -> str:
    base = spark.conf.get("matchspark.warehouse", None) or os.path.join(ensure_checkpoint_dir(spark), "warehouse")
    return os.path.join(base, name) if name else base


def shared_index(spark: SparkSession, jobs: DataFrame, cfg: MatchConfig, warehouse: str):
    """Index over active jobs with a title vector (I5/I6): reused while corpus and settings are the same, brought up to date by
    a delta after few changes."""
    corpus = jobs.where(present("title_vec")).select("job_id", "title_vec")
    idx, _ = ivf_ops.load_or_build(corpus, "job_id", "title_vec", os.path.join(warehouse, "job_index"),
                                   nlist=cfg.nlist, nprobe=cfg.nprobe, seed=cfg.seed, split_rows=cfg.cell_split_rows,
                                   target_recall=cfg.target_recall, recall_k=cfg.cascade_k1 if cfg.use_cascade else cfg.top_k_jobs,
                                   calibrate=not cfg.bounded)
    return idx


def title_lists(queries: DataFrame, query_id: str, jobs: DataFrame, k: int, cfg: MatchConfig, index, out_item: str, folder: str,
                exclude_self: bool = False) -> TopLists | DataFrame:
    """The k best jobs by title, by the strategy of the run: as lists where the search makes them, else (query_id, out_item, similarity, rank).
    ``folder``: the rounds' tables."""
    kw = dict(query_id=query_id, query_vec="title_vec", exclude_self=exclude_self)
    if cfg.strategy == "ivf" and cfg.bounded:
        found = ivf_ops.search_bounded(index, queries, k, folder=folder, out_item=out_item, corpus=(jobs, "title_vec"), **kw)
        return found.result if found.lists is None else found.lists
    if cfg.strategy == "ivf":
        return ivf_ops.search(index, queries, k, out_item=out_item, **kw)
    return top_k_lists(queries, jobs, k, item_id="job_id", item_vec="title_vec", block_rows=cfg.block_rows,
                       broadcast_limit_bytes=cfg.broadcast_limit_bytes, **kw)


def title_search(queries: DataFrame, query_id: str, jobs: DataFrame, k: int, cfg: MatchConfig, index, out_item: str, folder: str,
                 exclude_self: bool = False) -> DataFrame:
    """(query_id, out_item, similarity, rank) of ``title_lists``."""
    found = title_lists(queries, query_id, jobs, k, cfg, index, out_item, folder, exclude_self)
    return found.edges(query_id, out_item, "similarity", "rank") if isinstance(found, TopLists) else found


def work_folder(warehouse: str) -> str:
    """Intermediate tables of one run; removed when its results are published."""
    return os.path.join(warehouse, f"_work/{uuid.uuid4().hex}")


def counted(df: DataFrame, **counts) -> tuple[DataFrame, Observation]:
    """The frame with counters that are filled while it is written (once)."""
    seen = Observation()
    return df.observe(seen, *[c.alias(n) for n, c in counts.items()]), seen


def observed_rows(spark: SparkSession, *seen: Observation) -> DataFrame:
    """(metric, value) rows of the counters."""
    return spark.createDataFrame([(n, int(v)) for s in seen for n, v in s.get.items()], "metric string, value bigint")


def recommend(spark: SparkSession, cvs: DataFrame, jobs: DataFrame, cfg: MatchConfig,
              warehouse: str, index=None) -> RunResult:
    """CV -> job lists (cascade by default, else plain top-k), published by keyed replace. The counters are observed while the
    lists and the processed keys are written."""
    queries, work = cvs.where(present("title_vec")), work_folder(warehouse)
    if cfg.strategy == "ivf" and index is None:
        index = shared_index(spark, jobs, cfg, warehouse)
    if cfg.use_cascade:
        corpus = jobs.where(present("title_vec"))
        cand = title_lists(queries, "cv_id", corpus, cfg.cascade_k1, cfg, index, "job_id", work)
        if not isinstance(cand, TopLists):
            cand = cand.select("cv_id", "job_id", F.col("similarity").alias("title_sim"), F.col("rank").alias("r1"))
        if cfg.checkpoint_candidates:
            # The most expensive stage: keep its output as a table in the shared warehouse folder
            # so a lost executor in rounds 2-3 or the publish does not recompute the search.
            keep = lambda df: materialize(df, os.path.join(work, "round1"))
            cand = TopLists(keep(cand.rows.drop("s")), cand.groups) if isinstance(cand, TopLists) else keep(cand)     # the scores have done their work
        recs = cascade(queries, corpus, k1=cfg.cascade_k1, k2=cfg.cascade_k2, k3=cfg.cascade_k3,
                       candidates=cand)
    else:
        recs = title_search(queries, "cv_id", jobs, cfg.top_k_jobs, cfg, index, "job_id", work)
    edges = recs.select("cv_id", "job_id", "similarity", "rank", F.lit(cfg.as_of).alias("updated_at"))
    edges, made = counted(edges, recommendations=F.count(F.lit(1)))
    keys, done = counted(cvs.select("cv_id", present("title_vec").alias("_v")), cvs_processed=F.count(F.lit(1)), cvs_with_vector=F.count_if("_v"))
    base = os.path.join(warehouse, "recommend_jobs_for_cv")
    publish_edges(spark, base, edges, "cv_id", processed_keys=keys, keep_stale=cfg.keep_stale)
    if cfg.keep_stale:      # the processed keys are not written then
        keys.write.format("noop").mode("overwrite").save()
    remove_folder(spark, work)
    return RunResult(recommendations=read_current(spark, base), stats=observed_rows(spark, made, done))


def similar(spark: SparkSession, jobs: DataFrame, cfg: MatchConfig, warehouse: str, index=None) -> RunResult:
    """Job -> job neighbours (self excluded), published by keyed replace."""
    corpus, work = jobs.where(present("title_vec")), work_folder(warehouse)
    if cfg.strategy == "ivf":
        index = index or shared_index(spark, jobs, cfg, warehouse)
    sims = title_search(corpus, "job_id", corpus, cfg.similar_top_k, cfg, index, "similar_job_id", work, exclude_self=True)
    edges = sims.select("job_id", "similar_job_id", "similarity", "rank", F.lit(cfg.as_of).alias("updated_at"))
    edges, made = counted(edges, similar_pairs=F.count(F.lit(1)))
    keys, done = counted(jobs.select("job_id", present("title_vec").alias("_v")), jobs_processed=F.count(F.lit(1)), jobs_with_vector=F.count_if("_v"))
    base = os.path.join(warehouse, "similar_jobs")
    publish_edges(spark, base, edges, "job_id", processed_keys=keys, keep_stale=cfg.keep_stale)
    if cfg.keep_stale:
        keys.write.format("noop").mode("overwrite").save()
    remove_folder(spark, work)
    return RunResult(similar=read_current(spark, base), stats=observed_rows(spark, made, done))


def full_run(spark: SparkSession, cvs: DataFrame, jobs: DataFrame, cfg: MatchConfig,
             warehouse: str, reverse: bool = False) -> RunResult:
    """Both runs sharing one index; ``reverse`` runs job similarity first (same tables)."""
    index = shared_index(spark, jobs, cfg, warehouse) if cfg.strategy == "ivf" else None
    steps = [lambda: similar(spark, jobs, cfg, warehouse, index), lambda: recommend(spark, cvs, jobs, cfg, warehouse, index)]
    if not reverse:
        steps.reverse()
    results = [s() for s in steps]
    rec = next(r for r in results if r.recommendations is not None)
    sim = next(r for r in results if r.similar is not None)
    return RunResult(recommendations=rec.recommendations, similar=sim.similar,
                     stats=rec.stats.unionByName(sim.stats))


# ---------------------------------------------------------------- incremental runs
def _entity_changes(spark: SparkSession, entities: DataFrame, key: str, base: str, work: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(ids whose title changed, ids with any change, hashes now) since the hashes (id, title, h) stored at ``base``; new and gone ids
    are among both."""
    now = materialize(entity_hashes(entities, key), os.path.join(work, f"hashes-{key}"))
    before = read_current(spark, base, f"id {dict(now.dtypes)['id']}, title bigint, h bigint")
    any_ = materialize(changed_ids(now, before, "h"), os.path.join(work, f"changed-{key}"))
    return materialize(changed_ids(now, before, "title"), os.path.join(work, f"titles-{key}")), any_, now


def incremental_run(spark: SparkSession, cvs: DataFrame, jobs: DataFrame, cfg: MatchConfig, warehouse: str) -> RunResult:
    """Both runs after some entities have changed: only lists that a change can reach are made and published again; the tables
    equal those of a full run over the same entities. The first run makes every list.

    ``stats``: lists in all, made again, and searched in the whole corpus, of each side. State: hashes of the entities and lists by title (with
    ``cfg.reserve`` rows behind each) under ``_state``, the hashes written last, so what a failed run has left is made again by the next."""
    work, state = work_folder(warehouse), os.path.join(warehouse, "_state")
    queries, corpus = cvs.where(present("title_vec")), jobs.where(present("title_vec"))
    index = shared_index(spark, jobs, cfg, warehouse) if cfg.strategy == "ivf" else None
    cv_titles, cv_any, cv_hashes = _entity_changes(spark, queries, "cv_id", os.path.join(state, "cvs"), work)
    job_titles, job_any, job_hashes = _entity_changes(spark, corpus, "job_id", os.path.join(state, "jobs"), work)
    k_cv = cfg.cascade_k1 if cfg.use_cascade else cfg.top_k_jobs
    out, counters = {}, []
    for name, own, key, changed, k, self_out in (("cv", queries, "cv_id", cv_titles, k_cv, False),
                                                 ("job", corpus, "job_id", job_titles, cfg.similar_top_k, True)):
        old = read_current(spark, os.path.join(state, f"title-lists-{name}"))

        def search(asked, n, key=key, self_out=self_out, name=name):
            found = title_lists(asked, key, corpus, n, cfg, index, "_item", os.path.join(work, f"search-{name}"), exclude_self=self_out)
            return as_lists(found if isinstance(found, TopLists) else found.select(F.col(key).alias("q"), F.col("_item").alias("item"), "similarity", "rank"))

        def keep(df, what, name=name):
            return materialize(df, os.path.join(work, f"{name}-{what}"))

        ids = own.select(F.col(key).alias("q"))
        if old is None:         # first run: every list
            upd = Updated(keep(with_floor(search(own, k + cfg.reserve), k + cfg.reserve), "lists"), ids, ids)
        else:
            upd = update_lists(old, own, corpus, changed, job_titles, k=k, reserve=cfg.reserve, query_id=key, query_vec="title_vec", item_id="job_id",
                               item_vec="title_vec", exclude_self=self_out, search=search, keep=keep)
        lists, touched = upd.lists, keep(upd.touched, "touched")       # the lists are read from tables
        counters += [touched.join(ids, "q", "left_semi").agg(F.count(F.lit(1)).alias(f"{name}_lists_made")),
                     upd.searched.agg(F.count(F.lit(1)).alias(f"{name}_lists_searched")), ids.agg(F.count(F.lit(1)).alias(f"{name}_lists"))]
        out[name] = (lists, touched, old)
    stats = counter_rows(counters)
    stats = spark.createDataFrame(stats.collect(), stats.schema)      # a handful of counters; their tables go with the run
    stamp = F.lit(cfg.as_of).alias("updated_at")
    rec_base, sim_base = os.path.join(warehouse, "recommend_jobs_for_cv"), os.path.join(warehouse, "similar_jobs")
    lists, touched, old = out["cv"]
    redo = touched
    if cfg.use_cascade and old is not None:
        # lists whose titles stay, but whose CV or one of whose candidates has other skills, experience or requirements
        rest = old.join(touched, "q", "left_anti").join(queries.select(F.col("cv_id").alias("q")), "q", "left_semi")
        other = rest.join(cv_any.withColumnRenamed("id", "q"), "q", "left_semi").select("q").unionByName(
            rest.select("q", F.explode("c").alias("item")).join(job_any.withColumnRenamed("id", "item"), "item", "left_semi").select("q")).distinct()
        other = materialize(other, os.path.join(work, "cv-other"))
        redo, lists_now = touched.unionByName(other), lists.unionByName(rest.join(other, "q", "left_semi").select(*lists.columns))
    else:
        lists_now = lists
    best = first_of(lists_now, k_cv)
    recs = cascade(queries, corpus, k1=cfg.cascade_k1, k2=cfg.cascade_k2, k3=cfg.cascade_k3,
                   candidates=TopLists(best.withColumn("g", F.lit(0)), 1)) if cfg.use_cascade else entries(best).withColumnsRenamed({"q": "cv_id", "item": "job_id"})
    publish_edges(spark, rec_base, recs.select("cv_id", "job_id", "similarity", "rank", stamp), "cv_id", processed_keys=redo.withColumnRenamed("q", "cv_id"))
    publish_lists(spark, os.path.join(state, "title-lists-cv"), lists, touched)
    lists, touched, _ = out["job"]
    sims = entries(first_of(lists, cfg.similar_top_k)).select(F.col("q").alias("job_id"), F.col("item").alias("similar_job_id"), "similarity", "rank", stamp)
    publish_edges(spark, sim_base, sims, "job_id", processed_keys=touched.withColumnRenamed("q", "job_id"))
    publish_lists(spark, os.path.join(state, "title-lists-job"), lists, touched)
    for name, hashes, changed in (("cvs", cv_hashes, cv_any), ("jobs", job_hashes, job_any)):
        publish_edges(spark, os.path.join(state, name), hashes.join(changed, "id", "left_semi"), "id", processed_keys=changed)
    remove_folder(spark, work)
    return RunResult(recommendations=read_current(spark, rec_base), similar=read_current(spark, sim_base), stats=stats)


def publish_lists(spark: SparkSession, base: str, lists: DataFrame, touched: DataFrame) -> None:
    """Keyed replace of stored lists; a table is cut into buckets by the entries that it holds."""
    n = lists.agg(F.sum(F.size("c"))).first()[0] or 0
    publish_edges(spark, base, lists, "q", processed_keys=touched, buckets=min(MOST_BUCKETS, max(FEWEST_BUCKETS, 1 << (n // BUCKET_ROWS).bit_length())))


def counter_rows(parts: list[DataFrame]) -> DataFrame:
    """(metric, value) rows of one-row aggregates."""
    out = None
    for p in parts:
        for c in p.columns:
            row = p.select(F.lit(c).alias("metric"), F.col(c).cast("bigint").alias("value"))
            out = row if out is None else out.unionByName(row)
    return out


CV_FIELDS = {"title": "title_vec", "skills_text": "skills_vec", "experience_text": "experience_vec"}
JOB_FIELDS = {"title": "title_vec", "skills_text": "skills_vec", "requirement_text": "requirement_vec"}


def embed_stage(spark: SparkSession, entities: DataFrame, key: str, fields: dict[str, str], base: str,
                dim: int = 256, encoder_factory=None, batch_size: int = 100) -> tuple[DataFrame, DataFrame]:
    """Load the stored vectors at ``base``, embed what is new, changed or without a vector, write the vectors
    and hashes back (keyed replace; entities that are not in this run keep theirs).

    ``entities``: key, content_hash and the text columns of ``fields``. Returns the entities with their
    vectors, and one row of counters (processed, embedded, failed)."""
    schema = (f"{key} {dict(entities.dtypes)[key]}, content_hash string, "
              + ", ".join(f"{v} array<float>" for v in fields.values()) + ", embedded boolean, failed boolean")
    stored = read_current(spark, base, schema)
    new = incremental_embed(entities, stored, key=key, fields=fields, title_field="title", dim=dim,
                            encoder_factory=encoder_factory, batch_size=batch_size)
    # rows of this run first, so that its flags can be told from those of entities it did not see
    publish_edges(spark, base, new.select(*stored.columns), key, processed_keys=entities.select(key))
    own = read_current(spark, base).join(entities.select(key), key, "left_semi")
    counters = own.agg(F.count(F.lit(1)).alias("processed"), F.count_if("embedded").alias("embedded"),
                       F.count_if("failed").alias("failed"))
    return own.drop("embedded", "failed"), counters


def entity_run(spark: SparkSession, cvs: DataFrame, jobs: DataFrame, cfg: MatchConfig, warehouse: str,
               reverse: bool = False, dim: int = 256, encoder_factory=None) -> RunResult:
    """The whole run from entity rows: embed both sides incrementally, search, publish, count.

    ``cvs``: cv_id, content_hash, title, skills_text, experience_text; ``jobs``: job_id, content_hash, title,
    skills_text, requirement_text."""
    cv_vecs, cv_count = embed_stage(spark, cvs, "cv_id", CV_FIELDS, os.path.join(warehouse, "cv_vectors"), dim,
                                    encoder_factory, cfg.encode_batch_size)
    job_vecs, job_count = embed_stage(spark, jobs, "job_id", JOB_FIELDS, os.path.join(warehouse, "job_vectors"), dim,
                                      encoder_factory, cfg.encode_batch_size)
    res = full_run(spark, cv_vecs, job_vecs, cfg, warehouse, reverse=reverse)
    parts = [c.select(*[F.col(x).alias(f"{side}_{x}") for x in ("embedded", "failed")])
             for side, c in (("cvs", cv_count), ("jobs", job_count))]
    res.stats = res.stats.unionByName(counter_rows(parts))
    return res


def fresh_warehouse(spark: SparkSession) -> str:
    return warehouse_dir(spark, f"run-{uuid.uuid4().hex[:12]}")
