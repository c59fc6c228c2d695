"""A workspace's files kept up to date from a stream of changes.

A change is (seq, op, uri, content): op is add, update or remove. A batch is applied as one merge: its last change of each
file wins. Adding a file there is, or updating or removing one there isn't, is an error, and listed as such.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

CHANGES = "seq long, op string, uri string, content string"


def errors(state: DataFrame, changes: DataFrame) -> DataFrame:
    """(seq, op, uri) of changes that don't fit what is there when their turn comes.

    Whatever was there before, a file is there after an `add` and isn't after a `remove`, be they errors or not; an `update`
    changes nothing about it. So the last of those two before a change tells, and no fold is needed.
    """
    own = Window.partitionBy("uri").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    there = state.select("uri", F.lit(True).alias("there")).dropDuplicates(["uri"])
    before = F.last(F.when(F.col("op") != "update", F.col("op") == "add"), ignorenulls=True).over(own)
    rows = changes.join(there, "uri", "left").withColumn("exists", F.coalesce(before, "there", F.lit(False)))
    return rows.where((F.col("op") == "add") == F.col("exists")).select("seq", "op", "uri")


def outcome(changes: DataFrame) -> DataFrame:
    """(uri, op, content, added, updates): what a batch of changes that fit makes of each file: the last change, whether the file was added anew, and updates since then."""
    begun = changes.groupBy("uri").agg(F.max(F.when(F.col("op") == "add", F.col("seq"))).alias("begun"))
    rows = changes.join(begun, "uri")
    since = F.col("begun").isNull() | (F.col("seq") > F.col("begun"))
    return rows.groupBy("uri").agg(
        F.max_by("op", "seq").alias("op"), F.max_by(F.struct("content"), "seq")["content"].alias("content"), F.first("begun").isNotNull().alias("added"), F.count(F.when(since & (F.col("op") == "update"), 1)).alias("updates")
    )


def applied(state: DataFrame, changes: DataFrame) -> DataFrame:
    """state (uri, content) after the changes."""
    last = outcome(changes)
    kept = state.select("uri", "content").join(last.select("uri"), "uri", "left_anti")
    return kept.unionByName(last.where("op <> 'remove'").select("uri", "content"))


def follow(stream: DataFrame, read: Callable[[], DataFrame], write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Applies a stream of changes: read gives the state, write(state, batch) puts the next one in its place, once a batch; a batch that comes again must be written as before."""

    def batch(changes: DataFrame, number: int) -> None:
        if not changes.isEmpty():
            write(applied(read(), changes), number)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).start()


def windowed_counts(events: DataFrame, time: str, by: str, size: str = "10 minutes", late: str = "5 minutes") -> DataFrame:
    """Events of each kind in windows of time; what comes later than `late` is left out."""
    return events.withWatermark(time, late).groupBy(F.window(time, size), by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), by, "n")
