"""Symbol caches and registries on disk, and the indexer's results."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arborq.operators import relational
from arborq.operators.config import load_toml

KEY = ["name", "uuid", "version", "tree_sha"]


def write_symbols(symbols: DataFrame, path: str) -> None:
    """symbols (KEY, ...), replacing the packages that it has: a package's partition is written whole or not at all."""
    symbols.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("name", "uuid", "version", "tree_sha").parquet(path)


def read_symbols(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A damaged file counts as a miss."""
    return spark.read.option("ignoreCorruptFiles", "true").schema(schema).parquet(path)


def to_index(wanted: DataFrame, cached: DataFrame, tombstones: DataFrame, now: int) -> DataFrame:
    """wanted (KEY) that has neither a cache nor a tombstone that is still good (until > now)."""
    out = relational.missing(wanted, cached.select(*KEY).distinct(), KEY)
    return relational.missing(out, tombstones.where(F.col("until") > now), KEY)


def available(wanted: DataFrame, spark: SparkSession, index_path: str) -> DataFrame:
    """wanted that an index file names, a line `uuid/version_tree` for each."""
    lines = spark.read.text(index_path).select(F.trim("value").alias("stem"))
    return wanted.withColumn("stem", F.concat("uuid", F.lit("/"), "version", F.lit("_"), "tree_sha")).join(lines, "stem", "left_semi").drop("stem")


def write_index(cached: DataFrame, path: str) -> None:
    """The sorted lines of `available`."""
    stem = F.concat("uuid", F.lit("/"), "version", F.lit("_"), "tree_sha")
    cached.select(stem.alias("value")).distinct().orderBy("value").write.mode("overwrite").text(path)


def write_results(results: DataFrame, path: str) -> None:
    """One JSON object a line."""
    results.write.mode("overwrite").json(path)


VERSIONS = "array<struct<version: string, major: int, minor: int, patch: int, tree_sha: string, yanked: boolean>>"


#: Numbers beyond this aren't versions.
LARGEST = (1 << 31) - 1


def parse_versions(text: str | None) -> list[dict]:
    """A package's versions file: a table for each version. What isn't a version or a table is left out, as is a text that isn't TOML."""
    out = []
    for version, t in load_toml(text)[0].items():
        n = re.fullmatch(r"v?(\d+)(?:\.(\d+))?(?:\.(\d+))?(?:[-+].*)?", version, re.ASCII)
        numbers = [int(x or 0) for x in n.groups()] if n else [LARGEST + 1]
        if isinstance(t, dict) and max(numbers) <= LARGEST:
            sha = t.get("git-tree-sha1")
            out.append({"version": version, "major": numbers[0], "minor": numbers[1], "patch": numbers[2], "tree_sha": sha if isinstance(sha, str) else None, "yanked": t.get("yanked") is True})
    return out


def registry(packages: DataFrame, versions: Column) -> DataFrame:
    """packages (name, uuid, ...) exploded to a row for each version in the text of its versions file."""
    return packages.withColumn("v", F.explode(F.udf(parse_versions, VERSIONS, useArrow=False)(versions))).select("name", "uuid", "v.*")
