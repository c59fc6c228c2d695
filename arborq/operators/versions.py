"""Versions in order, and sets of versions as intervals of release numbers.

A version is a struct (major, minor, patch, released, pre) that Spark compares as the order of versions asks for: numbers
first, then what is before a release, by its parts: numbers below words, fewer parts below more. What a range holds goes
by the numbers alone, so that a release candidate of 1.6.0 is in whatever holds 1.6.0. An interval is a struct (low, high)
of number structs, low inclusive and high exclusive; a set is an array of intervals, sorted, apart from each other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NUMBERS = ("major", "minor", "patch")
#: No version has a number as large.
TOP = (1 << 62)
INTERVALS = "array<struct<low: struct<major: bigint, minor: bigint, patch: bigint>, high: struct<major: bigint, minor: bigint, patch: bigint>>>"
_VERSION = r"^v?(\d{1,15})(?:\.(\d{1,15}))?(?:\.(\d{1,15}))?(?:-([0-9A-Za-z.-]+))?(?:\+[0-9A-Za-z.-]*)?$"


def _number(text: Column) -> Column:
    return F.when(text != "", text.cast("bigint"))


def version(text: Column) -> Column:
    """A text as a version; null if it is none. Numbers that are left out are 0; what follows a plus doesn't count."""
    part = lambda i: F.regexp_extract(text, _VERSION, i)
    number = lambda i: F.coalesce(_number(part(i)), F.lit(0).cast("bigint"))
    words = F.filter(F.split(part(4), r"\."), lambda w: w != "")
    numeric = lambda w: w.rlike(r"^\d{1,18}$")
    pre = F.transform(words, lambda w: F.struct(F.when(numeric(w), 0).otherwise(1).alias("word"), F.when(numeric(w), w.try_cast("bigint")).otherwise(F.lit(0).cast("bigint")).alias("number"), F.when(numeric(w), F.lit("")).otherwise(w).alias("text")))
    out = F.struct(number(1).alias("major"), number(2).alias("minor"), number(3).alias("patch"), (part(4) == "").cast("int").alias("released"), pre.alias("pre"))
    return F.when(text.rlike(_VERSION), out)


def numbers(v: Column) -> Column:
    """What ranges go by."""
    return F.struct(*[v[c].cast("bigint").alias(c) for c in NUMBERS])


def _triple(a: Column, b: Column, c: Column) -> Column:
    return F.struct(a.cast("bigint").alias("major"), b.cast("bigint").alias("minor"), c.cast("bigint").alias("patch"))


_BOUND = r"(\d{1,15})(?:\.(\d{1,15}))?(?:\.(\d{1,15}))?"
_RANGE = rf"^\s*v?{_BOUND}\s*(?:-\s*v?{_BOUND})?\s*$"


def interval(text: Column) -> Column:
    """A range as an interval, null if it is none: `a-b` from a on and up to all that begin with b, `a` all that begin with a, `*` all."""
    part = lambda i: _number(F.regexp_extract(text, _RANGE, i))
    zero, one = F.lit(0).cast("bigint"), F.lit(1).cast("bigint")
    low = _triple(part(1), F.coalesce(part(2), zero), F.coalesce(part(3), zero))
    a, b, c = (F.when(part(4).isNotNull(), part(i + 3)).otherwise(part(i)) for i in (1, 2, 3))
    high = F.when(b.isNull(), _triple(a + one, zero, zero)).when(c.isNull(), _triple(a, b + one, zero)).otherwise(_triple(a, b, c + one))
    everything = F.struct(_triple(zero, zero, zero).alias("low"), _triple(F.lit(TOP), zero, zero).alias("high"))
    return F.when(F.trim(text) == "*", everything).when(text.rlike(_RANGE), F.struct(low.alias("low"), high.alias("high")))


def normal(intervals: Column) -> Column:
    """Intervals as a set: without empty and null ones, sorted, those that meet or overlap put together."""
    full = F.array_sort(F.filter(intervals, lambda i: i.isNotNull() & (i["low"] < i["high"])))
    last = lambda acc: F.element_at(acc, -1)

    def put(acc: Column, i: Column) -> Column:
        meets = (F.size(acc) > 0) & (i["low"] <= F.when(F.size(acc) > 0, last(acc)["high"]))
        longer = F.struct(last(acc)["low"].alias("low"), F.greatest(last(acc)["high"], i["high"]).alias("high"))
        return F.when(meets, F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.when(meets, longer)))).otherwise(F.concat(acc, F.array(i)))

    return F.aggregate(full, F.array().cast(INTERVALS), put)


def spec(texts: Column) -> Column:
    """A set from an array of ranges, any of which will do; what is no range is left out."""
    return normal(F.transform(texts, interval))


def intersect(a: Column, b: Column) -> Column:
    """The set of what is in both."""
    both = F.flatten(F.transform(a, lambda x: F.transform(b, lambda y: F.struct(F.greatest(x["low"], y["low"]).alias("low"), F.least(x["high"], y["high"]).alias("high")))))
    return normal(both)


def holds(intervals: Column, v: Column) -> Column:
    """Whether a set holds a version."""
    at = numbers(v)
    return F.exists(intervals, lambda i: (i["low"] <= at) & (at < i["high"]))


def shown(intervals: Column) -> Column:
    """A set as text: `1.2.0 to 2.0.0` for each interval, joined by semicolons; an open end is left out."""
    text = lambda n: F.concat_ws(".", *[n[c].cast("string") for c in NUMBERS])
    return F.array_join(F.transform(intervals, lambda i: F.concat(text(i["low"]), F.lit(" to"), F.when(i["high"]["major"] < TOP, F.concat(F.lit(" "), text(i["high"]))).otherwise(""))), "; ")


def compatibility(versions: DataFrame, compat: DataFrame, package: list[str], version_col: str = "version") -> DataFrame:
    """versions (package, version text, ...) with `allowed`: the set of what a version is declared to work with, null where nothing is declared.

    compat: (package, for_versions, works_with), texts of ranges: a row holds for versions that are in for_versions. Of
    several rows that hold, a version works with what is in all of them. Equal sets of rows are intersected once a
    version; a package's rows are no more than its own file has. A version that is none has null, as have rows whose
    for_versions is no range.
    """
    own = versions.withColumn("__v", version(F.col(version_col)))
    rows = compat.select(*package, F.array(interval(F.col("for_versions"))).alias("__for"), spec(F.col("works_with")).alias("__works"))
    # distinct versions of a package are looked up, so that repeated rows are joined once, by package and version
    keys = own.select(*package, version_col, "__v").distinct()
    found = keys.join(rows, package).where(holds(F.col("__for"), F.col("__v")))
    sets = found.groupBy(*package, version_col).agg(F.collect_set("__works").alias("__sets"))
    allowed = F.aggregate(F.slice("__sets", 2, F.size("__sets")), F.get("__sets", 0), intersect)
    return own.drop("__v").join(sets.select(*package, version_col, allowed.alias("allowed")), [*package, version_col], "left")


def newest_for(versions: DataFrame, allowed: str, running: Column, package: list[str], version_col: str = "version") -> DataFrame:
    """The greatest version of each package that works with `running`, a version; where nothing is declared anything works."""
    fits = versions.where(F.col(allowed).isNull() | holds(F.col(allowed), running))
    rest = [c for c in versions.columns if c not in package]
    best = fits.where(version(F.col(version_col)).isNotNull()).groupBy(*package).agg(F.max_by(F.struct(*rest), version(F.col(version_col))).alias("best"))
    return best.select(*package, *[F.col(f"best.{c}").alias(c) for c in rest])
