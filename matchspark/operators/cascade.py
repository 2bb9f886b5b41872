"""Three-round candidate cascade: title -> experience vs requirements -> skills.

Round 1 keeps the K1 best jobs per CV by title cosine (exact kernel or IVF index). Rounds 2
and 3 only score those candidates and rank by a window per CV, each CV holding at most K1 rows, so no window partition grows with the data. The
skills vectors are fetched for the K2 survivors only.

The candidate edges never carry a vector. Each round has tiles of a bounded group of jobs and a bounded share of the CVs; a tile is one task that
gets the vectors of both first, each once, and then the edges between them as short lists that stream through it; of each CV only the edges
that the round may keep leave it. A job is in the tiles of all shares of the CVs, so one that every list names is no hot key. Scores are computed in double.

Field score with missing data: CV side absent -> 0.3 (tested first), else job side absent
-> 0.5, else cosine. Ties keep the previous round's order (rank columns ``r1``/``r2``); the
result's similarity is the last round's score only.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchspark.operators import ivf as ivf_ops
from matchspark.operators.topk import GROUP_BYTES, TopLists, _pair_stats, by_dimension, dealt, exact_top_k, id_order, rank_top_k, runs_of, top_k_lists


def round1(cvs: DataFrame, jobs: DataFrame, k1: int, *, strategy: str = "exact",
           index: ivf_ops.IvfIndex | None = None, bounded: bool = True, **kw) -> DataFrame:
    """(cv_id, job_id, title_sim, r1). An index is searched by its bounds (exact) unless ``bounded`` is false."""
    if strategy == "ivf":
        if index is None:
            index = ivf_ops.build_index(jobs, "job_id", "title_vec", **kw)
        find = (lambda *a, **b: ivf_ops.search_bounded(*a, **b).result) if bounded else ivf_ops.search
        r = find(index, cvs, k1, query_id="cv_id", query_vec="title_vec", out_item="job_id")
    else:
        r = exact_top_k(cvs, jobs, k1, query_id="cv_id", query_vec="title_vec", item_id="job_id",
                        item_vec="title_vec", **kw)
    return r.select("cv_id", "job_id", F.col("similarity").alias("title_sim"), F.col("rank").alias("r1"))


def round1_lists(cvs: DataFrame, jobs: DataFrame, k1: int, *, strategy: str = "exact", index: ivf_ops.IvfIndex | None = None,
                 bounded: bool = True, **kw) -> TopLists | DataFrame:
    """Round 1 as lists where the search makes them, else as rows."""
    if strategy == "ivf":
        return round1(cvs, jobs, k1, strategy=strategy, index=index, bounded=bounded, **kw)
    return top_k_lists(cvs, jobs, k1, query_id="cv_id", query_vec="title_vec", item_id="job_id", item_vec="title_vec", **kw)


def cascade(cvs: DataFrame, jobs: DataFrame, *, k1: int = 1000, k2: int = 100, k3: int = 10,
            rounds: int = 3, strategy: str = "exact", index: ivf_ops.IvfIndex | None = None,
            candidates: DataFrame | TopLists | None = None, **kw) -> DataFrame:
    """Final list per CV: (cv_id, job_id, similarity, rank).

    ``rounds`` = 1, 2 or 3 stops after that round and cuts its order to ``k3`` (ablation).
    ``candidates`` may carry a precomputed round 1 (cv_id, job_id, title_sim, r1), or its lists.
    """
    c1 = candidates if candidates is not None else round1_lists(cvs, jobs, k1, strategy=strategy, index=index, **kw)
    if rounds == 1:
        c1 = c1.edges("cv_id", "job_id", "title_sim", "r1") if isinstance(c1, TopLists) else c1
        return rank_top_k(c1, "cv_id", "job_id", "title_sim", k3, tie_cols=["r1"]) \
            .select("cv_id", "job_id", F.col("title_sim").alias("similarity"), "rank")
    keep = k2 if rounds == 3 else k3
    c1 = c1 if isinstance(c1, TopLists) else c1.select("cv_id", "job_id", "r1")
    c2 = rank_top_k(_scored(c1, cvs, jobs, "experience_vec", "requirement_vec", "exp_sim", keep, "r1"),
                    "cv_id", "job_id", "exp_sim", keep, rank_col="r2", tie_cols=["r1"])
    if rounds == 2:
        return c2.select("cv_id", "job_id", F.col("exp_sim").alias("similarity"), F.col("r2").alias("rank"))
    c3 = rank_top_k(_scored(c2.select("cv_id", "job_id", "r2"), cvs, jobs, "skills_vec", "skills_vec", "skill_sim", k3, "r2"),
                    "cv_id", "job_id", "skill_sim", k3, tie_cols=["r2"])
    return c3.select("cv_id", "job_id", F.col("skill_sim").alias("similarity"), "rank")


#: CVs of a share at least, the number of shares up to which they get no more, CVs of a share at most, and edges that a task scores at once
SHARE_CVS, SHARES, MOST_CVS, EDGES_AT_ONCE = 4096, 64, 16384, 2048
#: edges that a tile gathers before it cuts them to the lists, edges of a row that goes to a tile at most, and such rows scored at once
EDGES_HELD, LIST_EDGES, ROWS_AT_ONCE = 500_000, 128, 2048
#: places of a table of ids at most, by the number of the ids
TABLE_PLACES = 16
#: field score where the CV's side is absent, and where only the job's is
CV_ABSENT, JOB_ABSENT = 0.3, 0.5


class Vectors:
    """One side's vectors in a tile: rows by id (an id may come more than once), size (0: absent), norm and place in the matrix of its dimension."""

    def __init__(self, batches: list[pa.RecordBatch], key: str):
        rows = pa.Table.from_batches(batches)
        ids, vectors = rows.column(key).combine_chunks().dictionary_encode(), rows.column("_w").combine_chunks()
        self.names, codes = ids.dictionary, ids.indices.to_numpy()
        self.rows = np.argsort(codes, kind="stable")
        self.first = np.append(np.searchsorted(codes[self.rows], np.arange(len(self.names))), len(codes))
        self.sorted = None
        if pa.types.is_integer(self.names.type):
            names = self.names.to_numpy()
            self.order = np.argsort(names)
            self.sorted = names[self.order]
            # ids that lie close together are places of a table
            self.least, self.table = int(self.sorted[0]) if len(names) else 0, None
            if len(names) and int(self.sorted[-1]) - self.least < TABLE_PLACES * len(names):
                self.table = np.full(int(self.sorted[-1]) - self.least + 1, -1, dtype=np.int32)
                self.table[names - self.least] = np.arange(len(names))
        self.once = len(self.names) == len(codes)
        self.size, self.norm = np.zeros(len(codes), dtype=np.int64), np.zeros(len(codes))
        self.place, self.matrix = np.zeros(len(codes), dtype=np.int64), {}
        self.gaps = vectors.flatten().null_count > 0
        for d, at, m in by_dimension(vectors):
            self.size[at], self.place[at], self.matrix[d] = d, np.arange(len(at)), m
            for x in range(0, len(at), EDGES_AT_ONCE):
                some = m[x:x + EDGES_AT_ONCE].astype(np.float64)
                self.norm[at[x:x + EDGES_AT_ONCE]] = np.sqrt(np.einsum("ij,ij->i", some, some))

    def codes(self, ids: pa.Array) -> np.ndarray:
        """Number of each id; -1: unknown here."""
        if self.sorted is None or not pa.types.is_integer(ids.type):
            return pc.fill_null(pc.index_in(ids, value_set=self.names), -1).to_numpy(zero_copy_only=False)
        asked = pc.fill_null(ids, 0).to_numpy(zero_copy_only=False)
        if self.table is not None and not ids.null_count:
            inside = (asked >= self.least) & (asked <= self.sorted[-1])
            return np.where(inside, self.table[np.where(inside, asked, self.least) - self.least], -1)
        at = np.minimum(np.searchsorted(self.sorted, asked), len(self.sorted) - 1)
        return np.where((self.sorted[at] == asked) & ids.is_valid().to_numpy(zero_copy_only=False), self.order[at], -1)


def _similarity(cvs: Vectors, i: np.ndarray, jobs: Vectors, j: np.ndarray) -> np.ndarray:
    out = np.where(cvs.size[i] == 0, CV_ABSENT, np.where(jobs.size[j] == 0, JOB_ABSENT, 0.0))
    both = (cvs.size[i] > 0) & (cvs.size[i] == jobs.size[j])
    for d in (x for x in cvs.matrix if x):
        at = np.flatnonzero(both & (cvs.size[i] == d))
        for x in range(0, len(at), EDGES_AT_ONCE):
            some = at[x:x + EDGES_AT_ONCE]
            a, b = i[some], j[some]
            dot = np.einsum("ij,ij->i", cvs.matrix[d][cvs.place[a]].astype(np.float64), jobs.matrix[d][jobs.place[b]].astype(np.float64))
            scale = cvs.norm[a] * jobs.norm[b]
            out[some] = np.where(scale == 0, 0.0, dot / np.where(scale == 0, 1.0, scale))
    return out


class Best:
    """The ``k`` best edges of every CV of a tile: score descending, then the tie column, as a window would rank them. Edges come in any
    order; what is held is cut to the lists whenever it has grown by ``EDGES_HELD``."""

    def __init__(self, k: int, score: str, tie: str):
        self.k, self.score, self.tie = k, score, tie
        self.parts, self.cvs, self.rows, self.limit = [], [], 0, EDGES_HELD

    def add(self, cv: np.ndarray, edges: pa.RecordBatch) -> None:
        if edges.num_rows:
            self.parts.append(edges), self.cvs.append(cv)
            self.rows += len(cv)
            if self.rows > self.limit:
                self.cut()
                self.limit = self.rows + EDGES_HELD

    def cut(self) -> None:
        edges, cv = pa.Table.from_batches(self.parts).combine_chunks(), np.concatenate(self.cvs)
        scores = edges.column(self.score).combine_chunks()
        s = pc.fill_null(scores, 0.0).to_numpy(zero_copy_only=False)
        s = np.where(np.isnan(s), np.inf, s)                                                    # NaN ranks first, null last
        s[scores.is_null().to_numpy(zero_copy_only=False)] = -np.inf
        tie = id_order(edges.column(self.tie).combine_chunks())
        order = np.lexsort((tie, -s, cv))
        first = np.flatnonzero(np.append(True, cv[order][1:] != cv[order][:-1]))
        nth = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
        kept = order[nth < self.k]
        self.parts, self.cvs, self.rows = edges.take(pa.array(kept)).combine_chunks().to_batches(), [cv[kept]], len(kept)

    def lists(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            self.cut()
            yield from self.parts
        self.parts, self.cvs, self.rows, self.limit = [], [], 0, EDGES_HELD


def _score_edges(columns: list[str], score: str, k: int | None, tie: str | None) -> Callable:
    def scored(jobs: Vectors, cvs: Vectors, part: pa.RecordBatch) -> tuple[np.ndarray, pa.RecordBatch]:
        lists = part.column("_e")
        edges, row = lists.flatten(), pc.list_parent_indices(lists)
        named = {f.name: edges.field(f.name) for f in edges.type} | {"cv_id": part.column("cv_id").take(row)}
        c, d = cvs.codes(part.column("cv_id"))[row.to_numpy(zero_copy_only=False)], jobs.codes(named["job_id"])
        edge = np.flatnonzero((c >= 0) & (d >= 0))
        c, d = c[edge], d[edge]
        if cvs.once and jobs.once:
            s = _similarity(cvs, cvs.rows[cvs.first[c]], jobs, jobs.rows[jobs.first[d]])
            out = [named[x] if len(edge) == len(row) else named[x].take(pa.array(edge)) for x in columns]
            return c, pa.RecordBatch.from_arrays([*out, pa.array(s, mask=np.isnan(s) if cvs.gaps or jobs.gaps else None)], names=[*columns, score])
        # an inner join: every row of the CV's id with every row of the job's
        n_c, n_d = cvs.first[c + 1] - cvs.first[c], jobs.first[d + 1] - jobs.first[d]
        n = n_c * n_d
        at = np.repeat(np.arange(len(edge)), n)
        nth = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
        i, j = cvs.rows[cvs.first[c[at]] + nth // n_d[at]], jobs.rows[jobs.first[d[at]] + nth % n_d[at]]
        s = _similarity(cvs, i, jobs, j)
        out = [named[x].take(pa.array(edge[at])) for x in columns]
        return c[at], pa.RecordBatch.from_arrays([*out, pa.array(s, mask=np.isnan(s) if cvs.gaps or jobs.gaps else None)], names=[*columns, score])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, held, sides, best = None, {}, {}, Best(k or 0, score, tie)
        for batch in batches:
            for (t, side), part in runs_of(batch, ["_t", "_side"]):
                if t != tile:
                    yield from best.lists()
                    tile, held, sides = t, {0: [], 1: []}, {}
                if side < 2:
                    held[side].append(part)
                    continue
                if not sides and held[0] and held[1]:
                    sides, held = {0: Vectors(held[0], "job_id"), 1: Vectors(held[1], "cv_id")}, {0: [], 1: []}
                if not sides:
                    continue
                for x in range(0, part.num_rows, ROWS_AT_ONCE):
                    cv, edges = scored(sides[0], sides[1], part.slice(x, ROWS_AT_ONCE))
                    if k is None:
                        yield edges
                    else:
                        best.add(cv, edges)
        yield from best.lists()

    return run


def _scored(edges: DataFrame | TopLists, cvs: DataFrame, jobs: DataFrame, cv_field: str, job_field: str, score: str, k: int | None = None,
            tie: str | None = None) -> DataFrame:
    """``edges`` with the score of one field pair; edges to unknown jobs or CVs are dropped (inner join). Of each CV and group of jobs
    the ``k`` best leave the tile (ties by the column ``tie``; no ``k``: all), so the window that ranks them sorts lists, not all candidates."""
    n_cv, n_job, dim = _pair_stats(cvs, cv_field, jobs, job_field)
    groups = max(1, math.ceil(n_job * max(1, dim) * (4 if jobs.schema[job_field].dataType == cvs.schema[cv_field].dataType == T.ArrayType(T.FloatType()) else 8)
                              / GROUP_BYTES))
    lists = None
    if isinstance(edges, TopLists):
        # pieces of lists are of one group of the jobs each, in the number of groups of their search
        lists = edges if groups <= 2 * edges.groups else None
        edges = edges.rows.select(F.col("q").alias("cv_id"), F.inline(F.arrays_zip("c", "r")).alias("job_id", "r1"))
    groups = lists.groups if lists else groups
    shares = max(1, min(math.ceil(n_cv / SHARE_CVS), SHARES), math.ceil(n_cv / MOST_CVS), math.ceil(n_cv * max(1, dim) * 8 / GROUP_BYTES))
    group, share = (F.pmod(F.xxhash64(F.col(c)), F.lit(n)).cast("int") for c, n in (("job_id", groups), ("cv_id", shares)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    kinds = [cvs.schema[cv_field].dataType, jobs.schema[job_field].dataType]
    vector = lambda c: F.col(c) if kinds[0] == kinds[1] else F.col(c).cast("array<double>")
    tile = (F.col("_g") * shares + F.col("_s")).alias("_t")
    j = jobs.where("job_id is not null").select("job_id", vector(job_field).alias("_w"), group.alias("_g"), every(shares).alias("_s"))
    c = cvs.where("cv_id is not null").select("cv_id", vector(cv_field).alias("_w"), share.alias("_s"), every(groups).alias("_g"))
    # the edges of a CV lie in short lists: a row per edge would cost more than its score
    if lists:
        e = lists.rows.where("q is not null").select(F.col("q").alias("cv_id"), F.col("g").alias("_g"), F.arrays_zip(F.col("c").alias("job_id"), F.col("r").alias("r1")).alias("_e")) \
            .select("cv_id", "_g", share.alias("_s"), "_e")
    else:
        e = edges.where("job_id is not null and cv_id is not null").groupBy("cv_id", group.alias("_g")).agg(
            F.collect_list(F.struct(*[c for c in edges.columns if c != "cv_id"])).alias("_l")).select(
            "cv_id", "_g", share.alias("_s"), F.explode(F.transform(F.sequence(F.lit(0), F.floor((F.size("_l") - 1) / LIST_EDGES)),
                                                                    lambda i: F.slice("_l", (i * LIST_EDGES + 1).cast("int"), LIST_EDGES))).alias("_e"))
    rows = dealt([e.select(tile, F.lit(2).alias("_side"), "cv_id", "_e"), j.select(tile, F.lit(0).alias("_side"), "job_id", "_w"),
                  c.select(tile, F.lit(1).alias("_side"), "cv_id", "_w")], groups * shares, ["_side"])
    schema = T.StructType([*[T.StructField(f.name, f.dataType) for f in edges.schema], T.StructField(score, T.DoubleType())])
    return rows.mapInArrow(_score_edges(edges.columns, score, k, tie), schema)


def round2_candidates(cvs: DataFrame, jobs: DataFrame, *, k1: int, k2: int, **kw) -> DataFrame:
    """Round-2 survivors with their ranks: (cv_id, job_id, exp_sim, r1, r2)."""
    c1 = round1_lists(cvs, jobs, k1, **kw)
    c1 = c1 if isinstance(c1, TopLists) else c1.select("cv_id", "job_id", "r1")
    return rank_top_k(_scored(c1, cvs, jobs, "experience_vec", "requirement_vec", "exp_sim", k2, "r1"), "cv_id", "job_id", "exp_sim",
                      k2, rank_col="r2", tie_cols=["r1"]).select("cv_id", "job_id", "exp_sim", "r1", "r2")
