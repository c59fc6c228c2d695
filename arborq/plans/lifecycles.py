"""Queries over events, orders and documents as state over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborq.operators import lifecycle, relational
from arborq.plans.registry import query, table


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 25)")
def cache_missing(spark: SparkSession, d: str) -> DataFrame:
    """Orders without a cached (large) line."""
    there = table(spark, d, "lineitem").where("l_quantity > 25").select(F.col("l_orderkey").alias("o_orderkey"))
    return relational.missing(table(spark, d, "orders").select("o_orderkey"), there, ["o_orderkey"])


def _work(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    orders = table(spark, d, "orders").select("o_custkey", "o_orderstatus", "o_orderkey")
    return orders.where("o_orderkey % 2 = 0").select("o_custkey", "o_orderstatus").distinct(), orders.where("o_orderkey % 3 = 0").select("o_custkey", "o_orderstatus").distinct()


@query("SELECT DISTINCT o_custkey, o_orderstatus FROM orders WHERE o_orderkey % 2 = 0 EXCEPT SELECT o_custkey, o_orderstatus FROM orders WHERE o_orderkey % 3 = 0")
def reconcile_spawn(spark: SparkSession, d: str) -> DataFrame:
    return relational.reconcile(*_work(spark, d), ["o_custkey", "o_orderstatus"])[0]


@query("SELECT DISTINCT o_custkey, o_orderstatus FROM orders WHERE o_orderkey % 3 = 0 EXCEPT SELECT o_custkey, o_orderstatus FROM orders WHERE o_orderkey % 2 = 0")
def reconcile_cancel(spark: SparkSession, d: str) -> DataFrame:
    return relational.reconcile(*_work(spark, d), ["o_custkey", "o_orderstatus"])[1]


@query("SELECT sha256(text) AS digest, count(*)::BIGINT AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def content_dups(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("digest"))
    return docs.groupBy("digest").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


@query("SELECT doc_id FROM documents WHERE doc_id % 5 = 0 OR doc_id % 7 = 0")
def early_cutoff(spark: SparkSession, d: str) -> DataFrame:
    """Of a revision that adds to every fifth text, against one that lacked every seventh: whose hash is new."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    new = docs.select("doc_id", F.sha2(F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("\nend"))).otherwise(F.col("text")), 256).alias("hash"))
    old = docs.where("doc_id % 7 <> 0").select("doc_id", F.sha2("text", 256).alias("hash"))
    return lifecycle.changed(new, old, "doc_id", "hash").select("doc_id")


@query("SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1")
def latest_by_key(spark: SparkSession, d: str) -> DataFrame:
    return relational.latest(table(spark, d, "events").select("user_id", "event_id", "event_type", "value", "ts"), ["user_id"], ["ts", "event_id"]).drop("ts")


@query("SELECT user_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS k FROM events) WHERE k = 1 AND event_type <> 'error'")
def drain_batch(spark: SparkSession, d: str) -> DataFrame:
    """The change feed of events applied in one go: the last change of each key; errors remove it."""
    last = relational.latest(table(spark, d, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], ["event_id"])
    return last.where("event_type <> 'error'").select("user_id", "event_type", "value")


@query("""
WITH s AS (SELECT user_id, event_id, event_type AS state, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
SELECT user_id, event_id, before, state FROM s WHERE before IS NOT NULL AND state <> 'error' AND NOT ((before = 'view' AND state IN ('click', 'view')) OR (before = 'click' AND state IN ('purchase', 'view')) OR (before = 'signup' AND state = 'view'))""")
def fsm_invalid(spark: SparkSession, d: str) -> DataFrame:
    allowed = [("view", "click"), ("view", "view"), ("click", "purchase"), ("click", "view"), ("signup", "view"), *((s, "error") for s in ("view", "signup", "purchase", "error", "click"))]
    events = table(spark, d, "events").select("user_id", "event_id", "ts", F.col("event_type").alias("state"))
    return lifecycle.invalid_steps(events, "user_id", ["ts", "event_id"], "state", spark.createDataFrame(allowed, "before string, state string")).select("user_id", "event_id", "before", "state")


@query("SELECT user_id, count(*)::BIGINT AS attempts, count(*) >= 2 AS exhausted FROM events WHERE event_type = 'error' GROUP BY user_id")
def retry_budget(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.attempts(table(spark, d, "events").where("event_type = 'error'"), ["user_id"])


@query("""
SELECT event_id, CASE WHEN max((event_type = 'purchase')::INTEGER) OVER w = 1 THEN 100 ELSE least(max(floor(value)::INTEGER) OVER w, 99) END::INTEGER AS shown
FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def progress_monotone(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events").select("event_id", "user_id", "ts", F.floor("value").cast("int").alias("v"), (F.col("event_type") == "purchase").alias("done"))
    return lifecycle.progress(events, "user_id", ["ts", "event_id"], "v", "done").select("event_id", F.col("shown").cast("int").alias("shown"))


@query("""
SELECT conv_id, turn, CASE WHEN count(*) OVER (PARTITION BY conv_id, role) > 1 THEN role || '#' || row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) ELSE role END AS id FROM conversations""")
def test_ids(spark: SparkSession, d: str) -> DataFrame:
    return lifecycle.occurrence_ids(table(spark, d, "conversations").select("conv_id", "turn", "role"), ["conv_id"], ["turn"], "role").select("conv_id", "turn", "id")
