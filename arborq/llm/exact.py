"""Exact dedup with a heavy-hitter split.

A Misra-Gries summary of each partition's digests is merged into one of at most K counters; every digest with more than
rows / (K + 1) copies is among them. Their exact group sizes and winners are counted, and this table of at most K rows is
broadcast: rows of frequent digests are settled where they lie, and only the other digests are shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborq.llm.common import slices, stored, table

#: Counters of the summary, and so the most rows that are broadcast.
COUNTERS = 1024


def _digests(id_col: str, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text_col).cast(pa.large_binary())
            out = [hashlib.sha256((x.as_py() or b"").lower()).digest() for x in texts]  # bytes: A-Z only
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(out, pa.binary())], names=["id", "digest"])

    return run


def reduced(counts: dict[bytes, int], counters: int) -> dict[bytes, int]:
    """Misra-Gries: takes the (counters + 1)th largest count off all and drops what is left without any."""
    if len(counts) <= counters:
        return counts
    least = sorted(counts.values(), reverse=True)[counters]
    return {k: v - least for k, v in counts.items() if v > least}


def _summaries(counters: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, int] = {}
        for batch in batches:
            for x in batch.column(0).value_counts():
                k = x["values"].as_py()
                counts[k] = counts.get(k, 0) + x["counts"].as_py()
            counts = reduced(counts, counters)
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["digest", "n"])

    return run


def frequent_digests(digests: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """At most `counters` digests, among them each with more than rows / (counters + 1) copies. The last of the summed counters is taken off, as in any merge of such summaries."""
    parts = digests.select("digest").mapInArrow(_summaries(counters), "digest binary, n long")
    top = parts.groupBy("digest").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "digest").limit(counters + 1).collect()
    least = top[counters]["n"] if len(top) > counters else 0
    return digests.sparkSession.createDataFrame([(bytes(r["digest"]),) for r in top[:counters] if r["n"] > least], "digest binary")


def exact_groups(docs: DataFrame, counters: int = COUNTERS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, keep_id, group_size, kept, text_sha256): one row for each row of docs, dropped ones too.

    Texts are equal when identical after lower-casing A-Z only; null counts as empty. The row with the largest id stays
    (null is the smallest id); of rows that share that id and text, one stays. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(_digests("id", "text"), f"id {docs.schema[id_col].dataType.simpleString()}, digest binary")
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "digests")
    groups = [F.count("*").alias("group_size"), F.max(F.struct("id", "row")).alias("keep")]
    frequent = frequent_digests(rows, counters)
    winners = rows.join(F.broadcast(frequent), "digest").groupBy("digest").agg(*groups)
    winners = stored(winners, "winners")  # as many rows as there are counters at most
    heavy = rows.join(F.broadcast(winners), "digest")
    light = rows.join(F.broadcast(frequent), "digest", "left_anti")
    light = light.join(light.groupBy("digest").agg(*groups), "digest")
    return heavy.unionByName(light).select(
        F.col("id").alias(id_col), F.col("keep.id").alias("keep_id"), "group_size", (F.col("keep.row") == F.col("row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


OP6_SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
"""
