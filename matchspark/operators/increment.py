"""Top-k lists kept up to date: after a change of some queries or items only the lists that it can reach are made again.

A stored list holds the best ``k + reserve`` items of its query and its floor: the (score, item) of the last row it had when it was
searched. Every item that is not in the list is behind the floor. So after a change

* changed items leave all lists that held them and are scored against every list's query once more (a search of the few
  changed items, not of the corpus); those not behind the floor enter;
* a list that still has ``k`` rows is exact: what it does not hold is behind its floor;
* a list with fewer rows, and every new or changed query, is searched again in the whole corpus.

A list is touched if its query changed, if it held a changed item or if one entered. Lists without a floor hold the
whole corpus (it is smaller than ``k + reserve``); any changed item enters them.

Lists are stored and merged as lists (q, r, c, s: ranks, items and scores, in pieces of some entries); a list's floor stands with its last piece.
A row per entry is made only to find the entries that are changed items.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchspark.functions.vector import present
from matchspark.operators.topk import PIECE, TopLists, id_order, list_rows, lists_schema, top_k_lists, whole_keys

LIST = ["q", "r", "c", "s", "floor", "floor_item"]


def entity_hashes(entities: DataFrame, key: str, title: str = "title_vec") -> DataFrame:
    """(id, title, h): hashes of an entity's title vector and of all its columns, to tell what changed."""
    return entities.select(F.col(key).alias("id"), F.xxhash64(title).alias("title"), F.xxhash64(*[c for c in entities.columns if c != key]).alias("h"))


def changed_ids(now: DataFrame, before: DataFrame, h: str = "h") -> DataFrame:
    """Ids that are new, changed (in the hash ``h``) or gone between two tables of hashes."""
    return (now.select("id", F.col(h).alias("_now")).join(before.select("id", F.col(h).alias("_before")), "id", "full")
            .where(~F.col("_now").eqNullSafe(F.col("_before"))).select("id"))


def as_lists(found: TopLists | DataFrame) -> DataFrame:
    """(q, r, c, s) of search results, which may be rows (q, item, similarity, rank)."""
    if isinstance(found, TopLists):
        return found.rows.select("q", "r", "c", "s")
    piece = F.floor((F.col("rank") - 1) / PIECE)
    listed = found.groupBy("q", piece.alias("_p")).agg(F.sort_array(F.collect_list(F.struct("rank", "item", "similarity"))).alias("_l"))
    return listed.select("q", F.col("_l.rank").alias("r"), F.col("_l.item").alias("c"), F.col("_l.similarity").alias("s"))


def with_floor(lists: DataFrame, k: int) -> DataFrame:
    """Lists (q, r, c, s) as stored lists: the floor is the last entry of a full list."""
    full = F.element_at("r", -1) == k
    return lists.select("q", "r", "c", "s", F.when(full, F.element_at("s", -1)).alias("floor"), F.when(full, F.element_at("c", -1)).alias("floor_item"))


def first_of(lists: DataFrame, k: int) -> DataFrame:
    """(q, r, c, s): the first ``k`` entries of the lists."""
    n = F.size(F.filter("r", lambda x: x <= k))
    return lists.select("q", *[F.slice(c, F.lit(1), n).alias(c) for c in ("r", "c", "s")]).where(F.size("r") > 0)


def entries(lists: DataFrame) -> DataFrame:
    """(q, item, similarity, rank): a row per entry."""
    return lists.select("q", F.inline(F.arrays_zip("c", "s", "r")).alias("item", "similarity", "rank"))


def _merged(most: int) -> Callable:
    """Pieces of a list, entries that come in (``floor`` null) and items that leave it (``_gone``) as the list is now, by query."""

    def merged(rows: pa.Table) -> pa.RecordBatch:
        column = lambda n: rows.column(n).combine_chunks()
        q = column("q")
        code = q.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        n_q = int(code.max(initial=-1)) + 1
        flat = lambda lists: (lists.flatten(), code[pc.list_parent_indices(lists).to_numpy(zero_copy_only=False)])
        items, of = flat(column("c"))
        scores = column("s").flatten()
        gone, gone_of = flat(column("_gone"))
        # an entry that leaves: its query and item are among those that are gone
        named = pa.chunked_array([items, gone]).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False).astype(np.int64)
        pair = named * max(1, n_q) + np.concatenate([of, gone_of])
        stays = np.flatnonzero(~np.isin(pair[:len(items)], pair[len(items):]) | ~column("_old").to_numpy(zero_copy_only=False)[pc.list_parent_indices(column("c")).to_numpy(zero_copy_only=False)])
        items, of, scores = items.take(pa.array(stays)), of[stays], scores.take(pa.array(stays))
        order = np.lexsort((id_order(items), -scores.to_numpy(zero_copy_only=False), of))
        first = np.searchsorted(of[order], np.arange(n_q + 1))
        rank = np.arange(len(order)) - first[of[order]] + 1
        order, rank = order[rank <= most], rank[rank <= most]
        of = of[order]
        items, scores = items.take(pa.array(order)), scores.take(pa.array(order))
        at = np.zeros(n_q, dtype=np.int64)
        at[code] = np.arange(len(code))
        new = np.append(True, of[1:] != of[:-1])[:len(of)]
        out = list_rows([("q", q.take(pa.array(at[of[new]])))], np.cumsum(new) - 1, [("c", items), ("s", scores)], PIECE)
        # the last piece has the floor: of a list that was cut to its length again its last entry, else the one it had
        had = np.full(n_q, -1, dtype=np.int64)
        known = np.flatnonzero(column("floor").is_valid().to_numpy(zero_copy_only=False))
        had[code[known]] = known
        ends = np.cumsum(pc.list_value_length(out.column("r")).to_numpy(zero_copy_only=False)) - 1
        last = np.append(of[1:] != of[:-1], True)[:len(of)][ends] if len(of) else np.zeros(0, dtype=bool)
        cut = last & (rank[ends] == most) if len(of) else last
        kept = last & ~cut & (had[of[ends]] >= 0) if len(of) else last
        floors = []
        for name, now in (("floor", scores), ("floor_item", items)):
            old = column(name)
            both = pa.concat_arrays([now, old.cast(now.type)])
            pick = np.where(cut, ends, np.where(kept, len(now) + had[of[ends]], 0)) if len(of) else ends
            floors.append(both.take(pa.array(pick, mask=~(cut | kept))))
        return pa.RecordBatch.from_arrays([*out.columns, *floors], names=[*out.schema.names, "floor", "floor_item"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in whole_keys(batches, "q"):
            yield merged(rows).select(LIST)

    return run


@dataclass
class Updated:
    lists: DataFrame     # the touched lists as they are now (LIST)
    touched: DataFrame   # (q): queries whose list was made again, also those that have none any more
    searched: DataFrame  # (q): those among them that were searched in the whole corpus


def update_lists(old: DataFrame, queries: DataFrame, corpus: DataFrame, changed_queries: DataFrame, changed_items: DataFrame, *,
                 k: int, reserve: int, query_id: str, query_vec: str, item_id: str, item_vec: str, exclude_self: bool,
                 search: Callable[[DataFrame, int], DataFrame], keep: Callable[[DataFrame, str], DataFrame]) -> Updated:
    """``old``: stored lists; ``queries`` and ``corpus``: as they are now; ``changed_*``: ids (column id). ``search(queries, n)``
    gives lists (q, r, c, s) over the whole corpus; ``keep`` writes an intermediate result as a table and reads it back."""
    most = k + reserve
    asked = queries.where(present(query_vec)).select(F.col(query_id).alias("q"), F.col(query_vec).alias("_v"))
    gone_q = changed_queries.select(F.col("id").alias("q"))
    stays = old.join(gone_q, "q", "left_anti")                          # lists of unchanged queries
    moved = changed_items.select(F.col("id").alias("item"))
    held = keep(stays.select("q", F.explode("c").alias("item")).join(moved, "item", "left_semi").groupBy("q").agg(F.collect_set("item").alias("_gone")), "held")
    # the changed items that are still there, against all unchanged queries with a list
    floors = keep(stays.groupBy("q").agg(F.max("floor").alias("floor"), F.max("floor_item").alias("floor_item")), "floors")
    own = asked.join(floors.select("q"), "q", "left_semi")
    few = corpus.where(present(item_vec)).join(changed_items.select(F.col("id").alias(item_id)), item_id, "left_semi")
    hits = top_k_lists(own, few, most, query_id="q", query_vec="_v", item_id=item_id, item_vec=item_vec, exclude_self=exclude_self).rows
    before_floor = lambda x: (F.col("floor").isNull() | (x["s"] > F.col("floor"))
                              | ((x["s"] == F.col("floor")) & (x["c"] <= F.col("floor_item"))))
    # in the order of the scores: the first of a piece tells whether any enters
    hits = hits.join(floors, "q").where(F.col("floor").isNull() | (F.element_at("s", 1) >= F.col("floor")))
    enter = hits.select("q", F.filter(F.arrays_zip("c", "s"), before_floor).alias("_e")).where(F.size("_e") > 0)
    enter = keep(enter.select("q", F.col("_e.c").alias("c"), F.col("_e.s").alias("s")), "enter")
    reached = keep(held.select("q").unionByName(enter.select("q")).distinct(), "reached")
    parts = stays.join(reached, "q", "left_semi").select(F.lit(True).alias("_old"), "q", "c", "s", "floor", "floor_item") \
        .unionByName(enter.withColumn("_old", F.lit(False)), allowMissingColumns=True) \
        .unionByName(held.withColumn("_old", F.lit(False)), allowMissingColumns=True)
    kinds = {f.name: f.dataType for f in old.schema.fields}
    schema = T.StructType([f for f in lists_schema(kinds["q"], kinds["floor_item"], "g").fields if f.name != "g"]
                          + [T.StructField("floor", T.DoubleType()), T.StructField("floor_item", kinds["floor_item"])])
    merged = keep(parts.repartition("q").sortWithinPartitions("q").mapInArrow(_merged(most), schema), "merged")
    sizes = merged.groupBy("q").agg(F.sum(F.size("c")).alias("n"), F.max("floor").alias("floor"))
    whole = sizes.where((F.col("n") >= k) | F.col("floor").isNull()).select("q")
    # a list that lost all its rows has no size; without a floor it is simply empty now
    empty = floors.where(F.col("floor").isNull()).select("q")
    short = reached.join(whole.unionByName(empty), "q", "left_anti")
    known = old.select("q").distinct()
    fresh = asked.select("q").join(gone_q, "q", "left_semi").unionByName(asked.select("q").join(known, "q", "left_anti")).distinct()
    again = keep(short.unionByName(fresh).distinct().join(asked.select("q"), "q", "left_semi"), "again")
    found = keep(with_floor(search(queries.join(again.withColumnRenamed("q", query_id), query_id, "left_semi"), most), most), "found")
    lists = merged.join(again, "q", "left_anti").unionByName(found)
    touched = reached.unionByName(again).unionByName(gone_q).distinct()
    return Updated(lists, touched, again)
