"""Shapes that many operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborq.functions import paths


def deepest_match(files: DataFrame, folders: DataFrame, path: str, folder: str, own: bool = False) -> DataFrame:
    """files with `folder`, the deepest of folders' paths above each (or, with own, at it), null where none is.

    A longest-prefix join as an equi join: a path is exploded to its own few folders, never compared with all of them.
    """
    up = files.select(path).distinct().withColumn(folder, F.explode(paths.folders(F.col(path), own)))
    found = up.join(folders.select(folder).distinct(), folder).groupBy(path).agg(F.max_by(folder, F.char_length(folder)).alias(folder))
    return files.drop(folder).join(found, path, "left")


def chain(files: DataFrame, folders: DataFrame, path: str, folder: str, own: bool = False) -> DataFrame:
    """A row for each file and each of folders above it, with folders' columns."""
    up = files.withColumn(folder, F.explode(paths.folders(F.col(path), own)))
    return up.join(folders, folder)


def in_scope(files: DataFrame, folders: DataFrame, path: str, folder: str, admits: Column) -> DataFrame:
    """files with in_scope: whether every folder above that has a row admits them; files without any are in scope."""
    told = chain(files, folders, path, folder).groupBy(path).agg(F.bool_and(admits).alias("in_scope"))
    return files.join(told, path, "left").withColumn("in_scope", F.coalesce("in_scope", F.lit(True)))


def layered(layers: list[DataFrame], keys: list[str], value: str, order: list[str] | None = None) -> DataFrame:
    """Last layer wins: (keys, value) of all layers, for each key that of the latest layer which has one; within a layer the last by `order`."""
    rows = None
    for i, layer in enumerate(layers):
        own = layer.select(*keys, value, F.lit(i).alias("layer"), F.struct(*(order or [F.lit(0).alias("zero")])).alias("at"))
        rows = own if rows is None else rows.unionByName(own)
    return rows.groupBy(*keys).agg(F.max_by(value, F.struct("layer", "at")).alias(value))


def top(df: DataFrame, by: list[str], order: list[Column], n: int = 1) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__n") <= n).drop("__n")


def missing(wanted: DataFrame, there: DataFrame, keys: list[str]) -> DataFrame:
    return wanted.join(there.select(*keys), keys, "left_anti")


def reconcile(wanted: DataFrame, running: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(to start, to stop)."""
    return missing(wanted, running, keys), missing(running, wanted, keys)


def contained(points: DataFrame, intervals: DataFrame, by: list[str], at: str, start: str, stop: str) -> DataFrame:
    """points joined with the intervals of equal `by` that hold them: start <= at < stop; empty intervals hold nothing.

    An interval is one row, however long: it lies at the level k of the least power of two that is no shorter than it, in
    the bucket of width 2**k where it starts, and so reaches into the next bucket at most. A point looks into two buckets
    of each level that there is, of which there are 63 at most.
    """
    length = F.col(stop).cast("long") - F.col(start).cast("long")
    level = F.length(F.regexp_replace(F.bin(length - 1), "^0$", "")).cast("int")  # of 1: 0, of 2: 1, of 3 and 4: 2
    i = intervals.where(F.col(stop) > F.col(start)).withColumn("__level", level)
    i = i.withColumn("__b", F.expr(f"shiftright(cast(`{start}` as bigint), __level)"))
    levels = sorted(r[0] for r in i.select("__level").distinct().collect())
    if not levels:
        return points.join(i.drop("__level", "__b"), by).where(F.lit(False))
    p = points.withColumn("__level", F.explode(F.array(*map(F.lit, levels)))).withColumn("__at", F.expr(f"shiftright(cast(`{at}` as bigint), __level)"))
    p = p.withColumn("__b", F.explode(F.array(F.col("__at"), F.col("__at") - 1))).drop("__at")
    return p.join(i, [*by, "__level", "__b"]).where((F.col(at) >= F.col(start)) & (F.col(at) < F.col(stop))).drop("__b", "__level")


def innermost(points: DataFrame, intervals: DataFrame, by: list[str], at: str, start: str, stop: str, order: list[Column] | None = None) -> DataFrame:
    """The narrowest interval around each point. Of intervals with the same ends only the first by order is looked at."""
    one = top(intervals, [*by, start, stop], order) if order else intervals.dropDuplicates([*by, start, stop])
    found = contained(points, one, by, at, start, stop)
    return top(found, [*by, at], [(F.col(stop) - F.col(start)).asc(), F.col(start).desc(), *(order or [])])


def outward(points: DataFrame, intervals: DataFrame, by: list[str], at: str, start: str, stop: str, order: list[Column]) -> DataFrame:
    """points (different ones) with all intervals around them and their level from 1, the narrowest first, then the one that starts last, then by order.

    What is sorted for each point is the different ends of intervals, with how many have them; intervals are numbered once
    among those of the same ends, and joined to these in the end.
    """
    ends = [*by, start, stop]
    keyed = intervals.where(F.col(stop) > F.col(start))
    kinds = keyed.groupBy(*ends).agg(F.count("*").alias("__many"))
    found = contained(points, kinds, by, at, start, stop)
    own = Window.partitionBy(*points.columns).orderBy(F.col(stop) - F.col(start), F.col(start).desc())
    before = found.withColumn("__before", F.sum("__many").over(own.rowsBetween(Window.unboundedPreceding, 0)) - F.col("__many")).drop("__many")
    numbered = keyed.withColumn("__nth", F.row_number().over(Window.partitionBy(*ends).orderBy(*order)))
    return before.join(numbered, ends).withColumn("level", F.col("__before") + F.col("__nth")).drop("__before", "__nth")


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key by `order`, without a window: one pass with partial results."""
    rest = [c for c in df.columns if c not in keys]
    got = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("last"))
    return got.select(*keys, *[F.col(f"last.{c}").alias(c) for c in rest])
