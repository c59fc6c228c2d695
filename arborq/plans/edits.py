"""Queries over documents as files that are edited."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborq.operators import edits
from arborq.plans.registry import query, table


@query("""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
u AS (SELECT DISTINCT doc_id, start, stop, t FROM (SELECT doc_id, doc_id % 7 AS start, doc_id % 7 + 3 AS stop, 'A' AS t FROM d UNION ALL SELECT doc_id, doc_id % 5, doc_id % 5 + doc_id % 4, 'B' || doc_id FROM d UNION ALL SELECT doc_id, 4, 4, 'C' FROM d UNION ALL SELECT doc_id, 2 + doc_id % 9, 4 + doc_id % 9, '' FROM d UNION ALL SELECT doc_id, 20 + doc_id % 90, 25 + doc_id % 90, 'é' FROM d)),
e AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY start, stop, t) AS i, count(*) OVER (PARTITION BY doc_id) AS n FROM u),
r(doc_id, i, upto, pos, out, made, refused) AS (
  SELECT doc_id, 0::BIGINT, 0::BIGINT, 0::BIGINT, '', 0::BIGINT, 0::BIGINT FROM d
  UNION ALL SELECT r.doc_id, e.i, CASE WHEN e.start >= r.upto THEN e.stop ELSE r.upto END, CASE WHEN e.start >= r.upto AND e.stop <= length(d.text) THEN e.stop ELSE r.pos END,
    CASE WHEN e.start >= r.upto AND e.stop <= length(d.text) THEN r.out || substr(d.text, r.pos + 1, e.start - r.pos) || e.t ELSE r.out END, r.made + (e.start >= r.upto AND e.stop <= length(d.text))::BIGINT, r.refused + (e.start < r.upto)::BIGINT
  FROM r JOIN e ON e.doc_id = r.doc_id AND e.i = r.i + 1 JOIN d ON d.doc_id = r.doc_id)
SELECT r.doc_id, made AS n_edits, refused AS n_refused, md5(out || substr(d.text, pos + 1)) AS digest FROM r JOIN d ON d.doc_id = r.doc_id JOIN (SELECT DISTINCT doc_id, n FROM e) z ON z.doc_id = r.doc_id AND z.n = r.i""")
def edits_composed(spark: SparkSession, d: str) -> DataFrame:
    """Five edits of each document, some in each other's way: what can be made together is made, the rest counted."""
    k = F.col("doc_id")
    docs = table(spark, d, "documents").select("doc_id", k.cast("string").alias("uri"), F.col("text").alias("content"))
    edit = lambda start, stop, text: F.struct(start.cast("long").alias("start"), stop.cast("long").alias("stop"), text.alias("text"))
    all_ = F.array(edit(k % 7, k % 7 + 3, F.lit("A")), edit(k % 5, k % 5 + k % 4, F.concat(F.lit("B"), k.cast("string"))), edit(F.lit(4), F.lit(4), F.lit("C")), edit(2 + k % 9, 4 + k % 9, F.lit("")), edit(20 + k % 90, 25 + k % 90, F.lit("é")))
    plan = edits.composed(docs.select("uri", F.explode(all_).alias("e")).select("uri", "e.*"))
    done = edits.applied(docs, plan).join(plan.select("uri", F.size("refused").cast("long").alias("n_refused")), "uri")
    return done.select(F.col("uri").cast("long").alias("doc_id"), "n_edits", "n_refused", F.md5("content").alias("digest"))
