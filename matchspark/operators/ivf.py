"""Inverted-file (IVF) vector index as DataFrames plus a small centroid matrix.

* cells:     (cell INT, split INT, <id>, unit ARRAY<DOUBLE>) — every corpus vector, unit length,
             in its best cell; ``split`` cuts a cell into blocks of at most ``split_rows``.
* centroids: nlist x dim matrix on the driver (bounded by ``nlist``, never by the corpus).

Search = probe the ``nprobe`` best cells per query (Arrow-batched NumPy product against the
centroid matrix). Cells lie in groups of bounded size; a query goes once to every group in which it reads a cell, with one bit
per cell, and the tiles of exact search score it against those cells alone (local top-k); the final top-k per query is a
``row_number()`` window (partial + final ``WindowGroupLimit``). A query can get fewer than k rows when its probed cells hold fewer
vectors. With ``nprobe = nlist`` the answer equals exact search.

Exact by bounds (``search_bounded``): every cell knows the least and the largest angle between its members and its centroid, so
no member can score better against a query at angle t to the centroid than the cosine of max(0, t - largest, least - t). A query reads cells in
the order of that bound, in rounds, and stops when its k-th score is above every bound that is left; only unfinished queries go
to the next round. The result equals exact search whatever the data; on data without structure it reads everything.

Many cells: beyond ``TREE_CELLS`` the quantiser is a tree of two levels: k-means of about sqrt(cells) branches, then the
cells of each branch trained on a bounded sample of its own rows, all branches in one grouped stage.

Maintenance (``load_or_build`` on a changed corpus): bucketed fingerprints tell which hash buckets of ids changed, only
those are compared row by row; changed rows are appended as a delta (latest row per id counts, a deleted id is a row
without a vector), cell bounds grow with them, and beyond ``COMPACT_SHARE`` of changed rows the index is built anew.

Recall of ``search``: the number of cells to probe is measured, not guessed (``calibrate_nprobe``): for a bounded set of
corpus vectors the exact neighbours are searched among all rows, and the smallest number of probes
that reaches ``target_recall`` of them is kept in the index. Corpora too small to train on have one cell; an
empty corpus has an empty index that finds nothing.

Skew: a cell may hold a third of the corpus. It is then cut into ``ceil(size / split_rows)``
splits by ``pmod(xxhash64(id), splits)`` (split counts come from an nlist-row aggregate), which may lie in several groups; a query
probing it goes to all of them, so no task holds more than a group of the corpus.
"""

from __future__ import annotations

import json
import math
import os
import uuid
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchspark.functions.vector import dot, l2_normalize, present
from matchspark.operators.publish import VersionConflict, commit_version, current_version, snapshot_path
from matchspark.operators.topk import GROUP_BYTES, TopLists, exact_top_k, rank_top_k, tile_top_k, tiles_of, top_k_lists
from matchspark.session import ensure_checkpoint_dir, materialize

#: more cells than this are trained as a tree of two levels
TREE_CELLS = 256
#: rows a branch of the tree is trained on at most, and rows per cell looked for
BRANCH_ROWS, ROWS_PER_CELL = 65_536, 128
#: share of the rows that deltas may hold before the index is built anew
COMPACT_SHARE = 0.2
FINGERPRINT_BUCKETS = 256
#: room for rounding in the comparison of a bound with a score
SLACK = 1e-9


def effective_nlist(n: int, nlist: int | None) -> int:
    """Adaptive cell count: min(nlist, max(1, n // 10)); without ``nlist`` four times the square root of n, 100 at least."""
    return min(nlist or max(100, math.ceil(4 * math.sqrt(n))), max(1, n // 10))


def _unit(m: np.ndarray) -> np.ndarray:
    m = np.asarray(m, dtype=np.float64)
    n = np.sqrt((m * m).sum(axis=1))
    n[n == 0] = 1.0
    return m / n[:, None]


def _stack(series: pd.Series, dim: int) -> np.ndarray:
    if len(series) == 0:
        return np.zeros((0, dim))
    return np.stack([np.asarray(v, dtype=np.float64) for v in series.values])


#: vector x centroid scores that a Python worker holds at once
SCORES_AT_ONCE = 1 << 21


def _pieces(v: pd.Series, cells: int):
    """The vectors in pieces, so that a piece x all centroids is a matrix of bounded size."""
    step = max(1, SCORES_AT_ONCE // max(1, cells))
    for a in range(0, len(v), step):
        yield a, v.iloc[a:a + step]


def assign_cell_udf(centroids: np.ndarray):
    """Pandas UDF: best cell of each vector (max cosine; ties -> lower cell)."""
    cu = _unit(centroids)
    dim = cu.shape[1]

    @F.pandas_udf(T.IntegerType())
    def assign(v: pd.Series) -> pd.Series:
        out = np.zeros(len(v), dtype="int32")
        for a, part in _pieces(v, len(cu)):
            out[a:a + len(part)] = np.argmax(_unit(_stack(part, dim)) @ cu.T, axis=1)
        return pd.Series(out)

    return assign


def probe_cells_udf(centroids: np.ndarray, nprobe: int):
    """Pandas UDF: the nprobe best cells of each query, best first (ties -> lower cell)."""
    cu = _unit(centroids)
    dim = cu.shape[1]
    p = min(nprobe, cu.shape[0])

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def probe(v: pd.Series) -> pd.Series:
        out = []
        for _, part in _pieces(v, len(cu)):
            s = _unit(_stack(part, dim)) @ cu.T
            out += np.argsort(-s, axis=1, kind="stable")[:, :p].astype("int32").tolist()
        return pd.Series(out, dtype=object)

    return probe


def _bits(rows: list, nlist: int) -> list[bytes]:
    """One bit per cell, set for the cells that a query reads."""
    out = np.zeros((len(rows), nlist), dtype=bool)
    for i, cells in enumerate(rows):
        out[i, cells] = True
    return [x.tobytes() for x in np.packbits(out, axis=1)]


def probe_bits_udf(centroids: np.ndarray, nprobe: int):
    """Pandas UDF: the bits of the nprobe best cells of each query (ties -> lower cell)."""
    cu = _unit(centroids)
    p = min(nprobe, cu.shape[0])

    @F.pandas_udf("reads binary")
    def probe(v: pd.Series) -> pd.DataFrame:
        reads = []
        for _, part in _pieces(v, len(cu)):
            s = _unit(_stack(part, cu.shape[1])) @ cu.T
            reads += _bits(np.argsort(-s, axis=1, kind="stable")[:, :p], len(cu))
        return pd.DataFrame({"reads": pd.Series(reads, dtype=object)})

    return probe


def groups_read_udf(membership: np.ndarray):
    """Pandas UDF: the groups that hold a cell whose bit is set. ``membership``: nlist x groups."""
    nlist, groups = membership.shape

    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def read(bits: pd.Series) -> pd.Series:
        out = []
        for _, part in _pieces(bits, nlist):
            some = np.unpackbits(np.frombuffer(b"".join(part), dtype=np.uint8).reshape(len(part), -1), axis=1)[:, :nlist]
            out += [np.flatnonzero(r).tolist() for r in some.astype(np.float32) @ membership]
        return pd.Series(out, dtype=object)

    return read


def _kmeans(x: np.ndarray, k: int, max_iter: int) -> np.ndarray:
    """Cosine k-means of unit rows; starts from the first ``k`` (the caller orders them by a seeded draw)."""
    c = x[:k].copy()
    for _ in range(max_iter):
        best = (x @ c.T).argmax(axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, best, x)
        moved = np.where(np.bincount(best, minlength=len(c))[:, None] > 0, _unit(sums), c)
        if np.allclose(moved, c):
            break
        c = moved
    return c


def _drawn(corpus: DataFrame, id_col: str, vec: str, seed: int) -> DataFrame:
    """(_v, _draw): vectors with a direction and a number in [0, 1) from a seeded hash of the id. Zero vectors have no part
    in training; they later land in the cell they score best."""
    draw = F.pmod(F.xxhash64(F.lit("train"), F.lit(seed), F.col(id_col)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return corpus.where(present(vec) & (dot(vec, vec) > 0)).select(F.col(vec).alias("_v"), draw.alias("_draw"))


def train_centroids(corpus: DataFrame, id_col: str, vec: str, nlist: int, n: int, seed: int = 42, max_iter: int = 20) -> np.ndarray:
    """Cosine k-means of up to ``TREE_CELLS`` cells over a bounded sample (about ``BRANCH_ROWS`` rows at most) in one task."""
    rows = _drawn(corpus, id_col, vec, seed).where(F.col("_draw") < min(1.0, BRANCH_ROWS / max(1, n)))

    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        x = _unit(np.stack(pdf.sort_values("_draw")["_v"].to_numpy()))
        return pd.DataFrame({"c": _kmeans(x, nlist, max_iter).tolist()})

    found = rows.withColumn("_one", F.lit(1)).groupBy("_one").applyInPandas(train, "c array<double>").toPandas()
    return np.array(found["c"].tolist(), dtype=np.float64).reshape(len(found), -1)


def train_tree(corpus: DataFrame, id_col: str, vec: str, cells: int, n: int, seed: int = 42, max_iter: int = 10) -> np.ndarray:
    """Two-level quantiser of about ``cells`` centroids: branches by k-means over a bounded sample, then the cells of each branch (their number
    by the branch's share of the rows) by cosine k-means over at most ``BRANCH_ROWS`` of its rows, one task per branch.
    Only counts per branch and the centroids (a number that grows with the square root of the corpus) reach the driver."""
    top = train_centroids(corpus, id_col, vec, max(2, math.ceil(math.sqrt(cells))), n, seed)
    branched = _drawn(corpus, id_col, vec, seed).select("_v", "_draw", assign_cell_udf(top)(F.col("_v")).alias("branch"))
    sizes = {r["branch"]: r["count"] for r in branched.groupBy("branch").count().collect()}     # k1 rows
    total = sum(sizes.values())
    wanted = {b: max(1, round(cells * c / total)) for b, c in sizes.items()}
    share = _lookup({b: min(1.0, ROWS_PER_CELL * wanted[b] / c, BRANCH_ROWS / c) for b, c in sizes.items()}, 1.0)

    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        branch = int(pdf["branch"].iloc[0])
        x = _unit(np.stack(pdf.sort_values("_draw")["_v"].to_numpy()))
        c = _kmeans(x, wanted[branch], max_iter)
        return pd.DataFrame({"branch": branch, "pos": range(len(c)), "c": c.tolist()})

    found = (branched.where(F.col("_draw") < share(F.col("branch"))).groupBy("branch")
             .applyInPandas(train, "branch int, pos int, c array<double>").orderBy("branch", "pos").toPandas())
    return np.array(found["c"].tolist(), dtype=np.float64)


def _lookup(values: dict, default):
    """Column -> the value of its key in a small dictionary."""
    if not values:
        return lambda c: F.lit(default)
    m = F.create_map(*[F.lit(x) for kv in sorted(values.items()) for x in kv])
    return lambda c: F.coalesce(F.try_element_at(m, c), F.lit(default))


def assign_with_angle_udf(centroids: np.ndarray):
    """Pandas UDF: best cell of each vector and the angle to its centroid (null for a zero vector, which has none)."""
    cu = _unit(centroids)

    @F.pandas_udf("cell int, angle double")
    def assign(v: pd.Series) -> pd.DataFrame:
        cell, angle = np.zeros(len(v), dtype="int32"), np.zeros(len(v))
        for a, part in _pieces(v, len(cu)):
            m = _unit(_stack(part, cu.shape[1]))
            s = m @ cu.T
            best = np.argmax(s, axis=1)
            cell[a:a + len(part)] = best
            angle[a:a + len(part)] = np.where(m.any(axis=1), np.arccos(np.clip(s[np.arange(len(m)), best], -1.0, 1.0)), np.nan)
        return pd.DataFrame({"cell": cell, "angle": angle})

    return assign


#: corpus vectors (chosen by a hash of the id) whose exact neighbours set the number of probes
CALIBRATION_QUERIES = 256


def calibrate_nprobe(corpus: DataFrame, id_col: str, vec: str, centroids: np.ndarray, n: int, k: int,
                     target_recall: float, queries: int = CALIBRATION_QUERIES) -> int:
    """Smallest number of probed cells that finds ``target_recall`` of the exact k neighbours of a bounded set of
    corpus vectors. The search is exact over all rows; one number per probe count reaches the driver."""
    nlist = centroids.shape[0]
    if nlist <= 1:
        return nlist
    rows = corpus.where(present(vec) & (F.size(vec) == centroids.shape[1])).select(id_col, vec)
    share = min(1.0, queries / max(1, n))
    asked = rows.where(F.pmod(F.xxhash64(F.lit("calibration"), F.col(id_col)), F.lit(1 << 30)) < math.ceil(share * (1 << 30)))
    asked = asked.limit(4 * queries)
    found = exact_top_k(asked, rows.withColumnRenamed(id_col, "_item"), k, query_id=id_col, query_vec=vec, item_id="_item",
                        item_vec=vec, exclude_self=True).select(id_col, "_item")
    cells = rows.select(F.col(id_col).alias("_item"), assign_cell_udf(centroids)(F.col(vec)).alias("cell"))
    probes = asked.select(id_col, F.posexplode(probe_cells_udf(centroids, nlist)(F.col(vec))).alias("pos", "cell"))
    at = found.join(cells, "_item").join(probes, [id_col, "cell"]).groupBy("pos").count().collect()  # <= nlist rows
    counts = np.zeros(nlist)
    for r in at:
        counts[r["pos"]] = r["count"]
    if not counts.sum():
        return nlist
    return int(np.searchsorted(np.cumsum(counts) / counts.sum(), target_recall) + 1)


def label_mean_centroids(corpus: DataFrame, vec: str, label: str) -> tuple[np.ndarray, list]:
    """Supervised quantiser: one cell per label value, centroid = mean unit vector of the label.

    The aggregate runs on the executors; only (#labels x dim) numbers reach the driver.
    """
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    rows = (
        corpus.where(present(vec))
        .select(F.col(label).alias("cell"), array_to_vector(l2_normalize(vec)).alias("u"))
        .groupBy("cell").agg(vector_to_array(Summarizer.mean(F.col("u"))).alias("c"))
        .orderBy("cell").collect()
    )
    return np.array([r["c"] for r in rows], dtype=np.float64), [r["cell"] for r in rows]


@dataclass
class IvfIndex:
    centroids: np.ndarray          # nlist x dim
    cells: DataFrame               # (cell, split, id, unit)
    splits: dict                   # cell -> split count
    id_col: str
    nprobe: int
    fingerprint: tuple = ()
    cell_labels: list | None = None  # external cell names (row order of centroids)
    bounds: np.ndarray | None = None  # nlist x 4: rows, least angle, largest angle, rows without direction
    others: DataFrame | None = None  # (id, vec) of the vectors of other dimensions, searched exactly
    settings: dict = field(default_factory=dict)
    buckets: dict = field(default_factory=dict)  # fingerprints by bucket of ids
    delta_rows: int = 0

    @property
    def nlist(self) -> int:
        return int(self.centroids.shape[0])


def _row_hash(id_col: str, vec: str):
    return F.xxhash64(F.col(id_col), F.col(vec))


def bucket_fingerprints(corpus: DataFrame, id_col: str, vec: str) -> dict[str, list]:
    """Per bucket of ids: rows and sum of row hashes (a wide sum, so repeated rows do not cancel out)."""
    rows = corpus.where(present(vec)).groupBy(F.pmod(F.xxhash64(F.col(id_col)), F.lit(FINGERPRINT_BUCKETS)).alias("b")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(_row_hash(id_col, vec).cast("decimal(38,0)")).alias("h")).collect()  # at most 256 rows
    return {str(r["b"]): [int(r["n"]), int(r["h"])] for r in rows}


def _total(buckets: dict[str, list]) -> tuple[int, int]:
    return sum(n for n, _ in buckets.values()), sum(h for _, h in buckets.values())


def corpus_fingerprint(corpus: DataFrame, id_col: str, vec: str) -> tuple[int, int]:
    """(row count, sum of row hashes): changes when any vector or id changes."""
    return _total(bucket_fingerprints(corpus, id_col, vec))


def build_index(corpus: DataFrame, id_col: str, vec: str, *, nlist: int | None = 100, nprobe: int | None = None,
                seed: int = 42, centroids: np.ndarray | None = None, split_rows: int = 2048,
                cell_labels: list | None = None, buckets: dict | None = None,
                target_recall: float = 0.97, recall_k: int = 20, calibrate: bool = True) -> IvfIndex:
    """Train (unless centroids are given), assign every present vector, size the cell splits.

    ``nprobe=None`` measures the number of probes for ``target_recall`` of the first ``recall_k`` neighbours (a sixteenth of the
    cells if not ``calibrate``: a start for ``search_bounded``). ``nlist=None``: the number of cells grows with the square root of the corpus.
    Cells hold the dimension that most vectors have; the others are kept beside them and searched exactly."""
    settings = {"nlist": nlist, "nprobe": nprobe, "seed": seed, "split_rows": split_rows, "target_recall": target_recall,
                "recall_k": recall_k, "calibrate": calibrate, "given": centroids is not None}
    buckets = bucket_fingerprints(corpus, id_col, vec) if buckets is None else buckets
    fp = _total(buckets)
    rows = corpus.where(present(vec))
    if centroids is None:
        dims = rows.groupBy(F.size(vec).alias("d")).count().orderBy(F.desc("count"), "d").first()
        if dims is None:
            return IvfIndex(np.zeros((0, 0)), _no_cells(corpus, id_col), {}, id_col, 0, fp, cell_labels, np.zeros((0, 4)), None, settings, buckets)
        dim, n = int(dims["d"]), int(dims["count"])
        usable = rows.where(F.size(vec) == dim)
        n_eff = effective_nlist(n, nlist)
        if n_eff <= 1:
            centroids = np.zeros((1, dim))
        elif n_eff > TREE_CELLS:
            centroids = train_tree(usable, id_col, vec, n_eff, n, seed)
        else:
            centroids = train_centroids(usable, id_col, vec, n_eff, n, seed)
            centroids = np.zeros((1, dim)) if not len(centroids) else centroids     # zero vectors only
    else:
        dim, n = int(centroids.shape[1]), fp[0]
        usable = rows.where(F.size(vec) == dim)
    if nprobe is None:
        nprobe = (calibrate_nprobe(usable, id_col, vec, centroids, n, recall_k, target_recall) if calibrate
                  else math.ceil(centroids.shape[0] / 16))
    members = _members(usable, id_col, vec, centroids)
    bounds = _cell_bounds(members, centroids.shape[0])
    splits = {i: max(1, math.ceil(c / split_rows)) for i, c in enumerate(bounds[:, 0]) if c}
    cells = _with_split(members, id_col, splits)
    others = rows.where(F.size(vec) != dim).select(id_col, F.col(vec).alias("vec")) if n < fp[0] else None
    return IvfIndex(centroids, cells, splits, id_col, min(nprobe, centroids.shape[0]), fp, cell_labels, bounds, others, settings, buckets)


def _members(rows: DataFrame, id_col: str, vec: str, centroids: np.ndarray) -> DataFrame:
    placed = rows.select(F.col(id_col), l2_normalize(vec).alias("unit"), _row_hash(id_col, vec).alias("h"),
                         assign_with_angle_udf(centroids)(F.col(vec)).alias("_a"))
    return placed.select(id_col, "unit", "h", "_a.cell", F.when(~F.isnan("_a.angle"), F.col("_a.angle")).alias("angle"))


def _with_split(members: DataFrame, id_col: str, splits: dict) -> DataFrame:
    return members.withColumn("split", F.pmod(F.xxhash64(F.col(id_col)), _split_lookup(splits)(F.col("cell"))).cast("int"))


def _cell_bounds(members: DataFrame, nlist: int) -> np.ndarray:
    """Per cell: rows, least and largest angle to the centroid, rows without direction; ``nlist`` rows reach the driver."""
    out = np.zeros((nlist, 4))
    out[:, 1], out[:, 2] = np.pi, 0.0
    for r in members.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("angle").alias("lo"), F.max("angle").alias("hi"),
                                         F.count_if(F.col("angle").isNull()).alias("zeros")).collect():
        out[r["cell"]] = (r["n"], np.pi if r["lo"] is None else r["lo"], 0.0 if r["hi"] is None else r["hi"], r["zeros"])
    return out


def _no_cells(corpus: DataFrame, id_col: str) -> DataFrame:
    kind = corpus.schema[id_col].dataType.simpleString()
    return corpus.sparkSession.createDataFrame([], f"`{id_col}` {kind}, unit array<double>, h bigint, cell int, angle double, split int")


def _split_lookup(splits: dict):
    if not splits or max(splits.values()) == 1:
        return lambda c: F.lit(1)
    kv = []
    for c, s in sorted(splits.items()):
        kv += [F.lit(c), F.lit(s)]
    m = F.create_map(*kv)
    return lambda c: F.coalesce(F.try_element_at(m, c), F.lit(1))


def _no_result(index: IvfIndex, queries: DataFrame, query_id: str, out_query: str, out_item: str) -> DataFrame:
    return queries.sparkSession.createDataFrame([], (
        f"{out_query} {queries.schema[query_id].dataType.simpleString()}, "
        f"{out_item} {index.cells.schema[index.id_col].dataType.simpleString()}, similarity double, rank int"))


def _other_dimensions(index: IvfIndex, queries: DataFrame, k: int, query_id: str, query_vec: str, out_query: str, out_item: str,
                      exclude_self: bool, block_rows: int) -> DataFrame | None:
    """Queries of other dimensions meet the vectors of their dimension by the exact kernel."""
    if index.others is None:
        return None
    asked = queries.where(present(query_vec) & (F.size(query_vec) != index.centroids.shape[1])).select(query_id, query_vec)
    return exact_top_k(asked, index.others.withColumnRenamed(index.id_col, "_item"), k, query_id=query_id, query_vec=query_vec, item_id="_item",
                       item_vec="vec", out_query=out_query, out_item=out_item, exclude_self=exclude_self, block_rows=block_rows)


def _cell_groups(index: IvfIndex) -> tuple[DataFrame, np.ndarray]:
    """(cell, split, _g) and the cells x groups matrix: cells in the order of their numbers, cut into groups of bounded size. A few
    numbers per cell, as centroids and bounds have."""
    most = max(1, GROUP_BYTES // (8 * max(1, index.centroids.shape[1])))
    rows, filled, group = [], 0.0, 0
    for cell, n in sorted(index.splits.items()):
        size = index.bounds[cell, 0] / n
        for split in range(n):
            if filled and filled + size > most:
                filled, group = 0.0, group + 1
            filled += size
            rows.append((int(cell), split, group))
    membership = np.zeros((index.nlist, group + 1), dtype=np.float32)
    for cell, _, g in rows:
        membership[cell, g] = 1
    spark = index.cells.sparkSession
    return spark.createDataFrame(rows, "cell int, split int, _g int"), membership


def _score_cells(index: IvfIndex, probes: DataFrame, k: int, exclude_self: bool, block_rows: int) -> DataFrame | None:
    """(q, c, s): the local top k of every query (_q, _v, _reads: bits of its cells) in each group in which it reads a cell; None if there
    is nothing to read."""
    n_q = probes.count()
    if not n_q or not index.splits:
        return None
    where, membership = _cell_groups(index)
    groups = membership.shape[1]
    shares = tiles_of(n_q, int(index.bounds[:, 0].sum()), groups)
    tile = (F.col("_g") * shares + F.col("_s")).alias("_t")
    q = probes.select(F.pmod(F.xxhash64(F.col("_q")), F.lit(shares)).cast("int").alias("_s"), "_q", "_v", "_reads",
                      F.explode(groups_read_udf(membership)(F.col("_reads"))).alias("_g")).select(tile, "_q", "_v", "_reads")
    c = (index.cells.join(F.broadcast(where), ["cell", "split"])
         .select("_g", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("_s"), F.col(index.id_col).alias("_c"), F.col("unit").alias("_v"),
                 F.col("cell").alias("_cell")).select(tile, "_c", "_v", "_cell"))
    return tile_top_k(q, c, k, groups * shares, exclude_self=exclude_self, block_rows=block_rows)


def search(index: IvfIndex, queries: DataFrame, k: int, *, query_id: str, query_vec: str,
           out_query: str | None = None, out_item: str | None = None, nprobe: int | None = None,
           exclude_self: bool = False, block_rows: int = 2048) -> DataFrame:
    """Top-k per query over the ``nprobe`` best cells: (out_query, out_item, similarity, rank). Queries of another
    dimension than that of the cells are searched exactly among the vectors of their own."""
    out_query = out_query or query_id
    out_item = out_item or index.id_col
    p = min(nprobe or index.nprobe, index.nlist)
    if p == 0 or k <= 0:
        return _no_result(index, queries, query_id, out_query, out_item)
    q = (
        queries.where(present(query_vec) & (F.size(query_vec) == index.centroids.shape[1]))
        .select(F.col(query_id).alias("_q"), F.col(query_vec).alias("_v"),
                probe_bits_udf(index.centroids, p)(F.col(query_vec))["reads"].alias("_reads"))
    )
    local = _score_cells(index, q, k, exclude_self, block_rows)
    if local is None:
        found = _no_result(index, queries, query_id, out_query, out_item)
    else:
        scored = local.select(F.col("q").alias(out_query), F.col("c").alias(out_item), F.col("s").alias("similarity"))
        found = rank_top_k(scored, out_query, out_item, "similarity", k)
    more = _other_dimensions(index, queries, k, query_id, query_vec, out_query, out_item, exclude_self, block_rows)
    return found if more is None else found.unionByName(more)


def plan_cells_udf(centroids: np.ndarray, bounds: np.ndarray, take: int):
    """Pandas UDF of (vector, cells read, score to beat): the bits of the next ``take`` cells in the order of their best possible score that
    may hold a row at least as good, their number, and the number of corpus rows in them."""
    cu = _unit(centroids)

    @F.pandas_udf("reads binary, cells int, rows long")
    def plan(v: pd.Series, done: pd.Series, beat: pd.Series) -> pd.DataFrame:
        reads, cells, rows = [], [], []
        for a, vectors in _pieces(v, len(cu)):
            m = _unit(_stack(vectors, cu.shape[1]))
            angle = np.arccos(np.clip(m @ cu.T, -1.0, 1.0))
            best = np.cos(np.maximum(0.0, np.maximum(angle - bounds[:, 2], bounds[:, 1] - angle)))
            best = np.where(bounds[:, 3] > 0, np.maximum(best, 0.0), best)      # a zero vector scores 0
            best[:, bounds[:, 0] == 0] = -np.inf
            best[~m.any(axis=1)] = np.where(bounds[:, 0] > 0, 0.0, -np.inf)     # a zero query scores 0 everywhere
            order = np.argsort(-best, axis=1, kind="stable")
            some = []
            for o, b, d, t in zip(order, best, done.to_numpy()[a:], beat.to_numpy()[a:]):
                part = o[d:d + take]
                part = part[(b[part] >= t - SLACK) & np.isfinite(b[part])]
                some.append(part)
                cells.append(len(part))
                rows.append(int(bounds[part, 0].sum()))
            reads += _bits(some, len(cu))
        return pd.DataFrame({"reads": pd.Series(reads, dtype=object), "cells": pd.Series(cells, dtype="int32"), "rows": pd.Series(rows, dtype="int64")})

    return plan


#: share of the cells not read yet that the unfinished queries still need on average, from which they are read in one round
READ_REST = 0.5
#: queries (chosen by a hash of the id) that tell first whether the bounds rule out anything, where there are many times more
PILOT = 256


@dataclass
class BoundedSearch:
    result: DataFrame    # (out_query, out_item, similarity, rank), equal to exact search
    read: DataFrame      # (query, cells, rows): what each query has read
    folder: str          # the rounds' tables; may be removed once the result is written
    lists: TopLists | None = None   # the result as lists, where every query has read every cell in one search


def _bounds_rule_out_little(index: IvfIndex, asked: DataFrame, k: int, take: int, exclude_self: bool, block_rows: int) -> bool:
    """Whether a few of many queries (_q, _v) still need most of the cells after their first round. The result of a search does not depend on it."""
    n = asked.count()
    if n < 16 * PILOT or take >= index.nlist:
        return False
    few = asked.where(F.pmod(F.xxhash64(F.lit("pilot"), F.col("_q")), F.lit(1 << 30)) < math.ceil(PILOT / n * (1 << 30))).limit(4 * PILOT)
    plan = plan_cells_udf(index.centroids, index.bounds, take)
    few = few.select("_q", "_v", plan("_v", F.lit(0), F.lit(-2.0))["reads"].alias("_reads"))
    local = _score_cells(index, few, k, exclude_self, block_rows)
    if local is None:
        return False
    kth = rank_top_k(local, "q", "c", "s", k).groupBy(F.col("q").alias("_q")).agg(F.count(F.lit(1)).alias("n"), F.min("s").alias("s"))
    rest = plan_cells_udf(index.centroids, index.bounds, index.nlist)
    open_ = few.join(kth, "_q", "left").select(rest("_v", F.lit(take), F.when(F.col("n") >= k, F.col("s")).otherwise(F.lit(-2.0)))["cells"].alias("n"))
    return (open_.agg(F.avg("n")).first()[0] or 0) >= READ_REST * (index.nlist - take)


def search_bounded(index: IvfIndex, queries: DataFrame, k: int, *, query_id: str, query_vec: str, out_query: str | None = None,
                   out_item: str | None = None, exclude_self: bool = False, block_rows: int = 2048, growth: int = 4,
                   folder: str | None = None, corpus: tuple[DataFrame, str] | None = None) -> BoundedSearch:
    """Exact top-k per query that reads only the cells which may hold a better row, in rounds of ``growth`` times as many cells; the
    rest at once where the bounds rule out less than half of it, and everything in one exact search where ``PILOT`` of many queries tell so beforehand.

    ``corpus``: the indexed rows and the name of their vector, for that search; else it reads the cells.
    Each round is a join of the unfinished queries with their next cells; its lists (at most k rows a query) and what is left
    to read are tables in ``folder`` (shared storage), so a lost executor costs one round at most."""
    spark = queries.sparkSession
    out_query = out_query or query_id
    out_item = out_item or index.id_col
    folder = folder or os.path.join(ensure_checkpoint_dir(spark), f"ivf-search-{uuid.uuid4().hex}")
    kind = queries.schema[query_id].dataType.simpleString()
    none = _no_result(index, queries, query_id, out_query, out_item)
    read = [spark.createDataFrame([], f"`{query_id}` {kind}, cells int, rows long")]
    filled = int(index.bounds[:, 0].sum()) if index.nlist else 0
    found, whole = none, None
    if filled and k > 0:
        # the first round reads enough cells for k rows on average
        take = min(index.nlist, max(index.nprobe, math.ceil(2 * k * index.nlist / filled)))
        left = queries.where(present(query_vec) & (F.size(query_vec) == index.centroids.shape[1])).select(
            F.col(query_id).alias("_q"), F.col(query_vec).alias("_v"), F.lit(0).alias("_done"), F.lit(-2.0).alias("_beat"))
        if _bounds_rule_out_little(index, left.select("_q", "_v"), k, take, exclude_self, block_rows):
            asked, rows, vec = (left.withColumnsRenamed({"_q": query_id, "_v": query_vec}), index.cells, "unit") if corpus is None else (queries, *corpus)
            whole = top_k_lists(asked, rows, k, query_id=query_id, query_vec=query_vec, item_id=index.id_col, item_vec=vec, exclude_self=exclude_self,
                                block_rows=block_rows)
            cells = int((index.bounds[:, 0] > 0).sum())
            read = [left.select(F.col("_q").alias(query_id), F.lit(cells).alias("cells"), F.lit(filled).cast("long").alias("rows"))]
        lists, parts, done, rounds = None, [], 0 if whole is None else index.nlist, 0
        while done < index.nlist:
            if rounds and done + take < index.nlist:
                # where the bounds rule out little, further rounds would only shuffle and sort the lists again: the rest is read at once
                rest = plan_cells_udf(index.centroids, index.bounds, index.nlist)
                open_ = left.select(rest("_v", "_done", "_beat").alias("_p")).agg(F.avg("_p.cells").alias("n")).first()["n"]
                if (open_ or 0) >= READ_REST * (index.nlist - done):
                    take = index.nlist - done
            plan = plan_cells_udf(index.centroids, index.bounds, take)
            asked = left.select("_q", "_v", plan("_v", "_done", "_beat").alias("_p")).select("_q", "_v", F.col("_p.reads").alias("_reads"), "_p.cells", "_p.rows")
            asked = materialize(asked.where(F.col("cells") > 0), os.path.join(folder, f"asked-{rounds}"))
            if lists is not None:       # lists of finished queries are not touched again
                ids = asked.select(F.col("_q").alias("q"))
                parts.append(lists.join(ids, "q", "left_anti"))
                lists = lists.join(ids, "q", "left_semi")
            local = _score_cells(index, asked.select("_q", "_v", "_reads"), k, exclude_self, block_rows)
            if local is None:
                lists = None
                break
            read.append(asked.select(F.col("_q").alias(query_id), "cells", "rows"))
            lists = rank_top_k(local if lists is None else local.unionByName(lists), "q", "c", "s", k).drop("rank")
            lists = materialize(lists, os.path.join(folder, f"lists-{rounds}"))
            done, rounds = done + take, rounds + 1
            kth = lists.groupBy(F.col("q").alias("_q")).agg(F.count(F.lit(1)).alias("n"), F.min("s").alias("s"))
            left = (asked.select("_q", "_v").join(kth, "_q", "left")
                    .select("_q", "_v", F.lit(done).alias("_done"), F.when(F.col("n") >= k, F.col("s")).otherwise(F.lit(-2.0)).alias("_beat")))
            take *= growth
        parts += [lists] if lists is not None else []
        for part in parts:
            found = found.unionByName(rank_top_k(part.select(F.col("q").alias(out_query), F.col("c").alias(out_item), F.col("s").alias("similarity")),
                                                 out_query, out_item, "similarity", k))
    if whole is not None:
        found = whole.edges(out_query, out_item, "similarity", "rank")
    more = _other_dimensions(index, queries, k, query_id, query_vec, out_query, out_item, exclude_self, block_rows) if whole is None or corpus is None else None
    what = read[0]
    for r in read[1:]:
        what = what.unionByName(r)
    what = what.groupBy(query_id).agg(F.sum("cells").alias("cells"), F.sum("rows").alias("rows"))
    return BoundedSearch(found if more is None else found.unionByName(more), what, folder, whole if more is None else None)


def search_pairs(index: IvfIndex, queries: DataFrame, k: int, *, query_id: str, query_vec: str,
                 out_query: str | None = None, out_item: str | None = None, nprobe: int | None = None,
                 exclude_self: bool = False) -> DataFrame:
    """Same result as ``search`` with one JVM dot product per (query, candidate) row
    (no Python; slower for wide vectors, used as a cross-check)."""
    out_query = out_query or query_id
    out_item = out_item or index.id_col
    p = min(nprobe or index.nprobe, index.nlist)
    probe = probe_cells_udf(index.centroids, p)
    split_expr = _split_lookup(index.splits)
    q = (
        queries.where(present(query_vec) & (F.size(query_vec) == index.centroids.shape[1]))
        .select(F.col(query_id).alias("_q"), l2_normalize(query_vec).alias("_qu"),
                probe(F.col(query_vec)).alias("_cells"))
        .select("_q", "_qu", F.explode("_cells").alias("cell"))
        .withColumn("split", F.explode(F.sequence(F.lit(0), split_expr(F.col("cell")) - 1)))
    )
    c = index.cells.select("cell", "split", F.col(index.id_col).alias("_c"), "unit")
    pairs = q.join(c, ["cell", "split"])
    if exclude_self:
        pairs = pairs.where(F.col("_q") != F.col("_c"))
    scored = pairs.select(F.col("_q").alias(out_query), F.col("_c").alias(out_item),
                          dot("_qu", "unit").alias("similarity"))
    return rank_top_k(scored, out_query, out_item, "similarity", k)


# ---------------------------------------------------------------- persistence (S17, I6)
# A version names the folders of the index: the first is complete (centroids, cells, others, meta), further ones are
# deltas (cells, others, meta): their rows replace those of the same id before them, a row without a vector deletes.
def save_index(index: IvfIndex, path: str) -> str:
    """Write the complete index and make it current when all is there. If another writer was first, this index is the next version."""
    spark = index.cells.sparkSession
    own = uuid.uuid4().hex
    folder = snapshot_path(path, (0, own))
    cent = spark.createDataFrame(
        [(i, [float(x) for x in row]) for i, row in enumerate(index.centroids)],
        "cell int, vec array<double>")
    cent.coalesce(1).write.parquet(os.path.join(folder, "centroids"))
    # The rows of one (cell, split) are clustered in one file and sorted, so row-group statistics on
    # ``cell`` let a reader skip cells and a hot cell is written by as many tasks as it has splits.
    index.cells.repartition("cell", "split").sortWithinPartitions("cell", "split") \
        .write.parquet(os.path.join(folder, "cells"))
    if index.others is not None:
        index.others.write.parquet(os.path.join(folder, "others"))
    _write_meta(spark, index, folder)
    while True:
        before = current_version(spark, path)
        try:
            commit_version(spark, path, {"ids": [own]}, before[0] if before else 0)
            return folder
        except VersionConflict:
            continue


def _write_meta(spark: SparkSession, index: IvfIndex, folder: str) -> None:
    meta = {"id_col": index.id_col, "nprobe": index.nprobe, "dim": int(index.centroids.shape[1]), "settings": index.settings,
            "splits": {str(k): v for k, v in index.splits.items()}, "bounds": index.bounds.tolist(), "buckets": index.buckets,
            "others": index.others is not None, "delta_rows": index.delta_rows}
    spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.text(os.path.join(folder, "meta"))


def _meta(spark: SparkSession, folder: str) -> dict:
    return json.loads(spark.read.text(os.path.join(folder, "meta"), wholetext=True).first()["value"])


def load_index(spark: SparkSession, path: str) -> IvfIndex:
    base, *deltas = [snapshot_path(path, (0, i)) for i in current_version(spark, path)[1]["ids"]]
    first = _meta(spark, base)
    meta = _meta(spark, deltas[-1]) if deltas else first
    rows = spark.read.parquet(os.path.join(base, "centroids")).orderBy("cell").collect()
    cent = np.array([r["vec"] for r in rows], dtype=np.float64).reshape(len(rows), meta["dim"])
    id_col = meta["id_col"]
    cells = spark.read.parquet(os.path.join(base, "cells"))
    others = spark.read.parquet(os.path.join(base, "others")) if first["others"] else None
    if deltas:
        later = None
        for n, d in enumerate(deltas):
            part = spark.read.parquet(os.path.join(d, "cells")).withColumn("_n", F.lit(n))
            later = part if later is None else later.unionByName(part)
        newest = later.groupBy(id_col).agg(F.max("_n").alias("_n"))
        last = later.join(newest, [id_col, "_n"]).drop("_n")
        cells = cells.join(newest.select(id_col), id_col, "left_anti").unionByName(
            last.where("unit is not null and cell is not null").select(*cells.columns))
        if meta["others"]:
            side = last.where("unit is not null and cell is null").select(id_col, F.col("unit").alias("vec"))
            others = side if others is None else others.select(id_col, F.col("vec").cast("array<double>").alias("vec")).join(
                newest.select(id_col), id_col, "left_anti").unionByName(side)
    return IvfIndex(cent, cells, {int(k): v for k, v in meta["splits"].items()}, id_col, meta["nprobe"], _total(meta["buckets"]), None,
                    np.array(meta["bounds"]).reshape(-1, 4), others if meta["others"] else None, meta["settings"], meta["buckets"], meta["delta_rows"])


def update_index(corpus: DataFrame, id_col: str, vec: str, path: str, buckets: dict | None = None) -> IvfIndex | None:
    """Bring the saved index to the rows of ``corpus`` by a delta; None if too much has changed (or it is empty): build anew.

    Only the rows whose bucket fingerprint differs are compared, by id and row hash. Ids are taken to be unique, as they
    are in an entity table (repeated ids: None)."""
    spark = corpus.sparkSession
    n, content = current_version(spark, path)
    index = load_index(spark, path)
    buckets = bucket_fingerprints(corpus, id_col, vec) if buckets is None else buckets
    differ = sorted(int(b) for b in {*buckets, *index.buckets} if buckets.get(b) != index.buckets.get(b))
    if not index.nlist or not differ:
        return None
    in_bucket = F.pmod(F.xxhash64(F.col(id_col)), F.lit(FINGERPRINT_BUCKETS)).isin(differ)
    now = corpus.where(present(vec) & in_bucket).select(F.col(id_col), F.col(vec).alias("_v"), _row_hash(id_col, vec).alias("_h"))
    if now.groupBy(id_col).count().where("count > 1").limit(1).count():
        return None
    held = index.cells.where(in_bucket).select(F.col(id_col), F.col("h").alias("_old"))
    if index.others is not None:        # their row hash is not kept: rows of differing buckets count as changed
        held = held.unionByName(index.others.where(in_bucket).select(F.col(id_col), F.lit(None).cast("long").alias("_old")))
    own = uuid.uuid4().hex
    folder = snapshot_path(path, (0, own))
    diff = now.join(held.withColumn("_held", F.lit(True)), id_col, "full").where(~F.col("_h").eqNullSafe(F.col("_old"))).select(id_col, "_v")
    diff = materialize(diff, os.path.join(folder, "changes"))
    changed, dim = diff.count(), index.centroids.shape[1]
    if index.delta_rows + changed > COMPACT_SHARE * max(1, index.fingerprint[0]):
        return None
    fits = present("_v") & (F.size("_v") == dim)
    placed = _with_split(_members(diff.where(fits), id_col, "_v", index.centroids), id_col, index.splits)
    empty = [F.lit(None).cast(index.cells.schema[c].dataType).alias(c) for c in ("h", "cell", "angle", "split")]
    rest = diff.where(~F.coalesce(fits, F.lit(False))).select(id_col, F.col("_v").cast("array<double>").alias("unit"), *empty)
    delta = placed.select(id_col, "unit", "h", "cell", "angle", "split").unionByName(rest)
    delta.write.parquet(os.path.join(folder, "cells"))
    fresh = _cell_bounds(spark.read.parquet(os.path.join(folder, "cells")).where("cell is not null"), index.nlist)
    index.bounds = np.column_stack([index.bounds[:, 0] + fresh[:, 0], np.minimum(index.bounds[:, 1], fresh[:, 1]),
                                    np.maximum(index.bounds[:, 2], fresh[:, 2]), index.bounds[:, 3] + fresh[:, 3]])
    for cell in np.flatnonzero(fresh[:, 0]):
        index.splits.setdefault(int(cell), 1)
    index.buckets, index.delta_rows = buckets, index.delta_rows + changed
    index.others = index.others if rest.where("unit is not null").limit(1).count() == 0 else rest
    _write_meta(spark, index, folder)
    commit_version(spark, path, {"ids": [*content["ids"], own]}, n)
    return load_index(spark, path)


def load_or_build(corpus: DataFrame, id_col: str, vec: str, path: str | None, **kw) -> tuple[IvfIndex, bool]:
    """Reuse the saved index when its corpus fingerprint and settings match; bring it up to date by a delta if only rows have
    changed, few of them; else build and save it. Returns (index, reused)."""
    spark = corpus.sparkSession
    buckets = bucket_fingerprints(corpus, id_col, vec)
    if path and current_version(spark, path) is not None:
        idx = load_index(spark, path)
        asked = {f: kw.get(f, d) for f, d in DEFAULTS.items()} | {"given": kw.get("centroids") is not None}
        if idx.settings == asked and not asked["given"]:
            if idx.buckets == buckets:
                return idx, True
            try:
                idx = update_index(corpus, id_col, vec, path, buckets)
            except VersionConflict:     # another writer was first: look again
                return load_or_build(corpus, id_col, vec, path, **kw)
            if idx is not None:
                return idx, False
    idx = build_index(corpus, id_col, vec, buckets=buckets, **kw)
    if path:
        save_index(idx, path)
        idx = load_index(spark, path)
    return idx, False


#: settings of ``build_index`` that a saved index must share to be used
DEFAULTS = {"nlist": 100, "nprobe": None, "seed": 42, "split_rows": 2048, "target_recall": 0.97, "recall_k": 20, "calibrate": True}
