"""Which package versions to index: filters, newest ones, shards, what is missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

VERSION = ("major", "minor", "patch")


def eligible(versions: DataFrame, skip_yanked: bool = True, skip_binaries: bool = True, include: list[str] | None = None, exclude: list[str] | None = None) -> DataFrame:
    """versions (name, yanked, ...) less those that the flags leave out; include and exclude are regular expressions of names."""
    out = versions
    if skip_yanked:
        out = out.where(~F.coalesce("yanked", F.lit(False)))
    if skip_binaries:
        out = out.where(~F.col("name").endswith("_jll"))
    for r in exclude or []:
        out = out.where(~F.col("name").rlike(r))
    if include:
        wanted = F.lit(False)
        for r in include:
            wanted = wanted | F.col("name").rlike(r)
        out = out.where(wanted)
    return out


def breaking_line(major: Column, minor: Column) -> Column:
    """Versions of one line don't break each other: the major number, or below 1.0 the minor."""
    return F.when(major > 0, F.concat(major.cast("string"), F.lit(""))).otherwise(F.concat(F.lit("0."), minor.cast("string")))


def newest(versions: DataFrame, n: int, per: list[str]) -> DataFrame:
    order = [F.col(c).desc() for c in VERSION]
    return versions.withColumn("__n", F.row_number().over(Window.partitionBy(*per).orderBy(*order))).where(F.col("__n") <= n).drop("__n")


def compatible(versions: DataFrame, ranges: str, version: tuple[int, int, int]) -> DataFrame:
    """versions whose ranges (array of (low, high) of version structs, inclusive) hold a version; null ranges hold all."""
    at = F.struct(*[F.lit(x).alias(n) for x, n in zip(version, VERSION, strict=True)])
    return versions.where(F.col(ranges).isNull() | F.exists(ranges, lambda r: (r["low"] <= at) & (at <= r["high"])))


def _fnv1a(text: str | None) -> int | None:
    if text is None:
        return None
    h = 0xCBF29CE484222325
    for b in text.encode():
        h = (h ^ b) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return h - (1 << 64) if h >> 63 else h


#: The 64-bit FNV-1a hash, as a signed number.
fnv1a = F.udf(_fnv1a, LongType(), useArrow=True)


def unsigned_mod(h: Column, n: int) -> Column:
    """h modulo n, h taken as unsigned."""
    return F.pmod(F.pmod(h, F.lit(n)) + F.when(h < 0, (1 << 64) % n).otherwise(0), F.lit(n))


def shard(versions: DataFrame, key: Column, n: int, k: int) -> DataFrame:
    return versions.where(unsigned_mod(fnv1a(key), n) == k)
