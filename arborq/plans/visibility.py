"""Queries over customers as modules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborq.operators import visibility
from arborq.plans.registry import query, table

_SQL = """
WITH RECURSIVE d AS (SELECT c_custkey AS module, 'x' || (c_custkey % 17) AS name FROM customer WHERE c_custkey % 3 = 0),
x AS (SELECT DISTINCT c_custkey AS module, 'x' || unnest([c_custkey % 17, (c_custkey + 1) % 17, c_custkey * 3 % 17]) AS name FROM customer),
u AS (SELECT c_custkey AS module, c_custkey // 2 AS target, c_custkey AS ord FROM customer UNION ALL SELECT c_custkey // 2, c_custkey, c_custkey FROM customer WHERE c_custkey % 5 = 0),
e AS (SELECT o_custkey AS module, CASE WHEN o_orderkey % 2 = 0 THEN 'y' || (o_orderkey % 23) ELSE 'x' || (o_orderkey % 17) END AS name, o_custkey - o_orderkey % 7 + 3 AS target, CASE WHEN o_orderkey % 6 = 0 THEN 'y' || (o_orderkey % 11) ELSE 'x' || (o_orderkey % 17) END AS target_name, o_orderkey AS ord FROM orders),
i AS (SELECT *, 2 AS tier FROM e UNION ALL SELECT u.module, x.name, u.target, x.name, u.ord, 1 FROM u JOIN x ON x.module = u.target),
s AS (SELECT * FROM i WHERE NOT (module = target AND name = target_name) AND (module, name) NOT IN (SELECT (module, name) FROM d)),
b(module, name, n) AS (SELECT module, name, 0 FROM d UNION SELECT s.module, s.name, b.n + 1 FROM b JOIN s ON s.target = b.module AND s.target_name = b.name WHERE b.n < 40),
r AS (SELECT module, name, min(n) AS n FROM b GROUP BY ALL),
p AS (SELECT s.module, s.name, arg_max(struct_pack(tier := s.tier, target := s.target, target_name := s.target_name), struct_pack(a := s.tier, b := -r.n, c := s.ord, d := s.target, e := s.target_name)) AS t FROM s JOIN r ON r.module = s.target AND r.name = s.target_name GROUP BY s.module, s.name),
w(module, name, item_module, item_name) AS (SELECT module, name, module, name FROM d UNION ALL SELECT p.module, p.name, w.item_module, w.item_name FROM w JOIN p ON p.t.target = w.module AND p.t.target_name = w.name)
SELECT r.module, r.name, CASE WHEN r.n = 0 THEN 3 ELSE p.t.tier END::INTEGER AS tier, w.item_module, w.item_name FROM r LEFT JOIN p ON p.module = r.module AND p.name = r.name LEFT JOIN w ON w.module = r.module AND w.name = r.name
"""


@query(_SQL)
def names_through_modules(spark: SparkSession, d: str) -> DataFrame:
    """Each customer uses the one of half its key, which uses every fifth of these back; orders are explicit imports, some under another name or of what was itself imported."""
    k = F.col("c_custkey")
    customer = table(spark, d, "customer").select("c_custkey")
    x = lambda c: F.concat(F.lit("x"), (c % 17).cast("string"))
    declared = customer.where(k % 3 == 0).select(k.alias("module"), x(k).alias("name"))
    exports = customer.select(k.alias("module"), F.explode(F.array(x(k), x(k + 1), x(k * 3))).alias("name"))
    half = F.floor(k / 2)
    uses = customer.select(k.alias("module"), half.alias("target"), k.alias("ord")).unionByName(customer.where(k % 5 == 0).select(half.alias("module"), k.alias("target"), k.alias("ord")))
    o, y = F.col("o_orderkey"), lambda c, n: F.concat(F.lit("y"), (c % n).cast("string"))
    listed = table(spark, d, "orders").select(F.col("o_custkey").alias("module"), F.when(o % 2 == 0, y(o, 23)).otherwise(x(o)).alias("name"), (F.col("o_custkey") - o % 7 + 3).alias("target"), F.when(o % 6 == 0, y(o, 11)).otherwise(x(o)).alias("target_name"), o.alias("ord"))
    return visibility.visible(declared, listed, uses, exports)
