"""State over time: work items, retries, progress, and what has to be computed anew."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Steps that a worker's state may take; any state may end as Dead.
STEPS = (("Created", "Starting"), ("Starting", "Connected"), ("Connected", "Indexing"), ("Indexing", "Done"))


def invalid_steps(events: DataFrame, key: str, order: list[str], state: str, allowed: DataFrame) -> DataFrame:
    """Rows whose state can't follow the one before it; allowed: (before, state)."""
    own = Window.partitionBy(key).orderBy(*order)
    steps = events.withColumn("before", F.lag(state).over(own)).where("before is not null")
    return steps.join(F.broadcast(allowed), ["before", state], "left_anti")


def attempts(failures: DataFrame, identity: list[str], budget: int = 2) -> DataFrame:
    """(identity, attempts, exhausted): content hashes aren't part of an identity."""
    return failures.groupBy(*identity).agg(F.count("*").alias("attempts")).withColumn("exhausted", F.col("attempts") >= budget)


def progress(events: DataFrame, key: str, order: list[str], value: str, done: str) -> DataFrame:
    """events with shown: never falling, and under 100 until done."""
    upto = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    top = F.max(value).over(upto)
    finished = F.bool_or(F.col(done)).over(upto)
    return events.withColumn("shown", F.when(finished, F.lit(100)).otherwise(F.least(top, F.lit(99))))


def content_hash(*columns: str):
    return F.sha2(F.concat_ws("\x1f", *columns), 256)


def changed(new: DataFrame, old: DataFrame, key: str, hashed: str) -> DataFrame:
    """Rows of new whose key is new or whose hash differs: all that has to be computed anew."""
    return new.join(old.select(key, hashed), [key, hashed], "left_anti")


def refreshed(new: DataFrame, results: DataFrame, key: str, hashed: str, compute) -> DataFrame:
    """results (key, hashed, ...) brought up to new (key, hashed, ...): kept where the hash is the same, computed where not, gone where the key is."""
    kept = results.join(new.select(key, hashed), [key, hashed], "left_semi")
    return kept.unionByName(compute(changed(new, results, key, hashed)))


def launch_order(work: DataFrame) -> DataFrame:
    """work (path, kind_rank): shallow paths first, then by kind."""
    depth = F.size(F.filter(F.split("path", "/"), lambda x: x != ""))
    return work.withColumn("depth", depth).orderBy("depth", "kind_rank", "path")


def occurrence_ids(rows: DataFrame, key: list[str], order: list[str], label: str) -> DataFrame:
    """rows with id: the label, and for labels that a key has more than once #1, #2, ... on each of them."""
    own = Window.partitionBy(*key, label)
    n, k = F.count("*").over(own), F.row_number().over(own.orderBy(*order))
    return rows.withColumn("id", F.when(n > 1, F.concat(F.col(label), F.lit("#"), k.cast("string"))).otherwise(F.col(label)))
