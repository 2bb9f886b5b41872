"""Data-quality reports: constraint violations and record counts (all distributed)."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from graphlib import CycleError, TopologicalSorter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchspark.session import checkpointed


def unique_violations(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys occurring more than once, with their count (must be empty)."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def domain_violations(df: DataFrame, key: str, domains: dict[str, tuple], not_null: tuple = ()) -> DataFrame:
    """One row per (key, column, value) outside its enum domain or NULL where required."""
    parts = []
    for c, allowed in domains.items():
        bad = F.col(c).isNotNull() & ~F.col(c).isin(*allowed)
        parts.append(df.where(bad).select(key, F.lit(c).alias("column"), F.col(c).cast("string").alias("value")))
    for c in not_null:
        parts.append(df.where(F.col(c).isNull()).select(key, F.lit(c).alias("column"),
                                                      F.lit(None).cast("string").alias("value")))
    return reduce(DataFrame.unionByName, parts)


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child rows whose parent is missing (a cascade delete would remove them)."""
    p = parent.select(F.col(parent_key).alias(child_key)).distinct()
    return child.join(p, child_key, "left_anti")


def cascade_delete(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    p = parent.select(F.col(parent_key).alias(child_key)).distinct()
    return child.join(p, child_key, "left_semi")


def record_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, n) for every table; one aggregate job per table, unioned."""
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n")
             for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


@dataclass(frozen=True)
class ForeignKey:
    """``child.column`` names a row of ``parent`` by ``parent_key``; rows of a deleted parent go too."""

    child: str
    column: str
    parent: str
    parent_key: str


def cascade_graph(tables: dict[str, DataFrame], keys: list[ForeignKey], deleted: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables after deleting rows (``deleted``: a table's key column with the values to delete) and all that hangs on them.

    Tables are visited parents first. A row goes if it is deleted itself or if one of its parents goes; rows whose parent was
    never there stay (they are ``orphans``). Only the keys of deleted rows are shuffled, not those of the survivors. A table
    that refers to itself (directly or over others) is visited again until nothing more goes, each round a reliable checkpoint."""
    graph = {t: {k.parent for k in keys if k.child == t and k.parent != t} for t in tables}
    try:
        order, rounds = list(TopologicalSorter(graph).static_order()), False
    except CycleError:
        order, rounds = list(tables), True
    rounds = rounds or any(k.child == k.parent for k in keys)
    left, gone = dict(tables), {}                   # gone: (table, key column) -> values of the rows that went
    known = {(t, c): d.select(c).distinct() for t, d in deleted.items() for c in d.columns}

    def visit(t: str) -> None:
        before = left[t]
        stays = before
        for (table, column), values in known.items():
            if table == t:
                stays = stays.join(values, column, "left_anti")
        for k in keys:
            if k.child == t and (k.parent, k.parent_key) in gone:
                stays = stays.join(gone[k.parent, k.parent_key].withColumnRenamed(k.parent_key, k.column), k.column, "left_anti")
        left[t] = stays = stays.select(*before.columns)
        for column in {k.parent_key for k in keys if k.parent == t}:
            went = tables[t].select(column).join(stays.select(column), column, "left_anti").where(F.col(column).isNotNull()).distinct()
            gone[t, column] = checkpointed(went) if rounds else went

    for t in order:
        visit(t)
    while rounds:
        sizes = {k: v.count() for k, v in gone.items()}
        for t in order:
            visit(t)
        if sizes == {k: v.count() for k, v in gone.items()}:
            break
    return left
