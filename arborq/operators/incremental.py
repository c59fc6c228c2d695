"""Recomputing what an edit affects: deltas of contents to deltas of inventories to roots to the rows that hang on them.

What is derived from files is kept as tables with a key. After an edit, the keys that it affects are found by joins, only
their rows are computed anew, and the table is merged by key; all others stay as they are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborq.operators import graph


def differences(before: DataFrame, after: DataFrame, key: list[str], value: str) -> DataFrame:
    """(key, how): keys that were added, removed or updated: those whose value isn't the same in both. A null value is a value; a key of several rows in one table counts by its greatest."""
    old = before.groupBy(*key).agg(F.max(value).alias("__old")).withColumn("__was", F.lit(True))
    new = after.groupBy(*key).agg(F.max(value).alias("__new")).withColumn("__is", F.lit(True))
    both = old.join(new, key, "full")
    how = F.when(F.col("__was").isNull(), "added").when(F.col("__is").isNull(), "removed").when(~F.col("__old").eqNullSafe(F.col("__new")), "updated")
    return both.select(*key, how.alias("how")).where("how is not null")


def affected(contents: DataFrame, inventories: DataFrame, edges_before: DataFrame, edges_after: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files (node), roots (node)) to compute anew.

    contents and inventories: (node, how), the differences of files' content and of their inventories. A file whose content
    alone differs is computed anew by itself. Where an inventory or an edge (src, dst) differs, the roots above it are,
    before or after the edit, and every file below these. Files that are gone have nothing to compute.
    """
    roots, start, after = _above(inventories, edges_before, edges_after)
    gone = contents.where("how = 'removed'").select("node")
    files = graph.reachable(roots.unionByName(start).distinct(), after).unionByName(contents.select("node")).distinct()
    return files.join(gone, "node", "left_anti"), roots.join(gone, "node", "left_anti")


def affected_roots(contents: DataFrame, inventories: DataFrame, edges_before: DataFrame, edges_after: DataFrame) -> DataFrame:
    """The roots (node) of `affected` alone, for what is kept by root: without the walk down to their files."""
    return _above(inventories, edges_before, edges_after)[0].join(contents.where("how = 'removed'").select("node"), "node", "left_anti")


def _above(inventories: DataFrame, edges_before: DataFrame, edges_after: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(roots, start, edges after): the roots above what differs, both before and after.

    All edges are one table in buckets by dst, with the times that they belong to: the walk up and the search for files
    without an edge in move only what they have found. The same DataFrame as before and after is read once.
    """
    edge = lambda df, was, is_: df.select("src", "dst", F.lit(was).alias("was"), F.lit(is_).alias("is")).where("src is not null and dst is not null")
    if edges_before is edges_after:
        rows = edge(edges_before, True, True)
    else:
        rows = edge(edges_before, True, False).unionByName(edge(edges_after, False, True))
    both = graph.bucketed(rows.repartition("dst").groupBy("src", "dst").agg(F.max("was").alias("was"), F.max("is").alias("is")), "dst")
    start = inventories.select("node")
    if edges_before is not edges_after:
        start = start.unionByName(both.where("was <> is").select(F.col("src").alias("node")))
    start = start.distinct()
    above = graph.stored(graph.reachable_by(start, both.select(F.col("dst").alias("node"), F.col("src").alias("next"))))
    no_edge_in = lambda when: above.join(both.where(when).select(F.col("dst").alias("node")), "node", "left_anti")
    roots = no_edge_in("was") if edges_before is edges_after else no_edge_in("was").unionByName(no_edge_in("is")).distinct()
    return graph.stored(roots), start, both.where("is").select("src", "dst")


def merged(table: DataFrame, keys: DataFrame, compute: Callable[[DataFrame], DataFrame], gone: DataFrame | None = None) -> DataFrame:
    """The table with the rows of keys as compute(keys) gives them, stored; those of `gone` keys go, all others stay. compute is asked for these keys alone."""
    names = keys.columns
    stays = table.join(keys, names, "left_anti")
    stays = stays if gone is None else stays.join(gone.select(*names), names, "left_anti")
    return graph.stored(stays.select(*table.columns).unionByName(compute(keys).select(*table.columns)))
