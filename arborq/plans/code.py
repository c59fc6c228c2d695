"""Queries over source text: parts written out as Julia files, a file for each brand, and parsed again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborq.operators import analysis, lifecycle, resolve
from arborq.operators.graph import stored
from arborq.plans.registry import query, table

_KIND = "p_partkey % 6"


def sources(spark: SparkSession, d: str) -> DataFrame:
    """(uri, content): module B with a declaration for each part of brand B, in order of their keys, and some lint."""
    k = F.col("p_partkey").cast("string")
    line = (
        F.when(F.col("p_partkey") % 6 == 0, F.concat(F.lit("function f"), k, F.lit('(a, b=1; c)\n    @show a\n    return g(a, "x" * b)\nend')))
        .when(F.col("p_partkey") % 6 == 1, F.concat(F.lit("struct S"), k, F.lit("\n    x::Int\nend")))
        .when(F.col("p_partkey") % 6 == 2, F.concat(F.lit("h"), k, F.lit("(x, xs...) = x == NaN # f(")))
        .when(F.col("p_partkey") % 6 == 3, F.concat(F.lit("const K"), k, F.lit(" = [1, 2][end]")))
        .when(F.col("p_partkey") % 6 == 4, F.concat(F.lit("for i in 1:3\n    if true || i == 2\n        break\n    end\n    v = f"), k, F.lit("(i; c=2)\nend")))
        .otherwise(F.concat(F.lit('@testitem "t'), (F.col("p_partkey") % 5).cast("string"), F.lit('" begin\n    f'), k, F.lit("(1)\nend")))
    )
    parts = table(spark, d, "part").select(F.replace("p_brand", F.lit("#"), F.lit("")).alias("b"), F.struct("p_partkey", line.alias("line")).alias("x"))
    body = parts.groupBy("b").agg(F.array_join(F.array_sort(F.collect_list("x")).getField("line"), "\n").alias("body"))
    return body.select(F.concat(F.lit("/src/"), "b", F.lit(".jl")).alias("uri"), F.concat(F.lit("module "), "b", F.lit("\nusing Base.Test\nexport f\n"), "body", F.lit("\nend\n")).alias("content"))


def _facts(spark: SparkSession, d: str) -> DataFrame:
    return analysis.facts(sources(spark, d))


def _stored_facts(spark: SparkSession, d: str) -> DataFrame:
    """For what reads several of their tables: parsed once."""
    return stored(_facts(spark, d))


_URI = "'/src/' || replace(p_brand, '#', '') || '.jl'"


@query(f"""
SELECT {_URI} AS uri, CASE {_KIND} WHEN 0 THEN 'f' WHEN 1 THEN 'S' WHEN 2 THEN 'h' ELSE 'K' END || p_partkey AS name, CASE {_KIND} WHEN 0 THEN 'function' WHEN 1 THEN 'struct' WHEN 2 THEN 'function' ELSE 'const' END AS kind,
  CASE {_KIND} WHEN 0 THEN 1 WHEN 2 THEN 1 END::INTEGER AS min_args, CASE {_KIND} WHEN 0 THEN 2 WHEN 2 THEN 2147483647 END::INTEGER AS max_args, replace(p_brand, '#', '') AS module
FROM part WHERE {_KIND} < 4 UNION ALL SELECT DISTINCT {_URI}, replace(p_brand, '#', ''), 'module', NULL::INTEGER, NULL::INTEGER, '' FROM part""")
def file_inventory(spark: SparkSession, d: str) -> DataFrame:
    return analysis.child(_facts(spark, d), "items").select("uri", "name", "kind", "min_args", "max_args", F.array_join("module", ".").alias("module"))


@query(f"""
SELECT uri, rule_id, count(*)::BIGINT AS n FROM (
  SELECT {_URI} AS uri, unnest(['debug_statement', 'string_concat_style']) AS rule_id FROM part WHERE {_KIND} = 0 UNION ALL SELECT {_URI}, 'nan_comparison' FROM part WHERE {_KIND} = 2
  UNION ALL SELECT {_URI}, 'pointless_boolean' FROM part WHERE {_KIND} = 4 UNION ALL SELECT DISTINCT {_URI}, 'bare_using' FROM part) GROUP BY uri, rule_id""")
def syntax_findings(spark: SparkSession, d: str) -> DataFrame:
    return analysis.child(_facts(spark, d), "findings").groupBy("uri", "rule_id").agg(F.count("*").alias("n"))


@query(f"""
SELECT uri, callee, min_args, n_kws, count(*)::BIGINT AS n FROM (
  SELECT {_URI} AS uri, 'g' AS callee, 2 AS min_args, 0 AS n_kws FROM part WHERE {_KIND} = 0
  UNION ALL SELECT {_URI}, 'f' || p_partkey, 1, 1 FROM part WHERE {_KIND} = 4 UNION ALL SELECT {_URI}, 'f' || p_partkey, 1, 0 FROM part WHERE {_KIND} = 5) GROUP BY ALL""")
def file_calls(spark: SparkSession, d: str) -> DataFrame:
    calls = analysis.child(_facts(spark, d), "calls")
    return calls.groupBy("uri", "callee", "min_args", F.size("kws").alias("n_kws")).agg(F.count("*").alias("n"))


@query(f"""
SELECT uri, CASE WHEN count(*) OVER (PARTITION BY uri, label) > 1 THEN label || '#' || row_number() OVER (PARTITION BY uri, label ORDER BY p_partkey) ELSE label END AS id
FROM (SELECT {_URI} AS uri, 't' || (p_partkey % 5) AS label, p_partkey FROM part WHERE {_KIND} = 5)""")
def testitem_ids(spark: SparkSession, d: str) -> DataFrame:
    return analysis.test_ids(_facts(spark, d)).select("uri", "id")


@query(f"""
SELECT {_URI} AS uri, replace(p_brand, '#', '') AS parent, count(*)::BIGINT AS n FROM part WHERE {_KIND} IN (0, 1, 5) GROUP BY ALL UNION ALL SELECT DISTINCT {_URI}, NULL, 1 FROM part""")
def document_symbols(spark: SparkSession, d: str) -> DataFrame:
    found = _stored_facts(spark, d)
    rows = analysis.document_symbols(found)
    names = rows.select("uri", F.col("node_id").alias("parent"), F.col("name").alias("parent_name"))
    return rows.join(names, ["uri", "parent"], "left").groupBy("uri", F.col("parent_name").alias("parent")).agg(F.count("*").alias("n"))


@query(f"""SELECT DISTINCT {_URI} AS uri FROM part WHERE {_KIND} = 1 AND p_size > 40""")
def inventory_cutoff(spark: SparkSession, d: str) -> DataFrame:
    """Files that others must be analysed anew for: an edit adds a field's body everywhere but renames structs of large parts only."""
    old = sources(spark, d)
    large = table(spark, d, "part").where("p_partkey % 6 = 1 AND p_size > 40").select(F.concat(F.lit("/src/"), F.replace("p_brand", F.lit("#"), F.lit("")), F.lit(".jl")).alias("uri")).distinct().withColumn("hit", F.lit(True))
    body = F.replace("content", F.lit("@show a"), F.lit("@show a, a"))
    new = old.join(large, "uri", "left").select("uri", F.when(F.col("hit"), F.replace(body, F.lit("struct S"), F.lit("struct T"))).otherwise(body).alias("content"))
    return lifecycle.changed(analysis.inventory_hash(analysis.facts(new)), analysis.inventory_hash(analysis.facts(old)), "uri", "hash").select("uri")


@query(f"""
SELECT uri, rule_id, count(*)::BIGINT AS n FROM (
  SELECT {_URI} AS uri, CASE WHEN {_KIND} = 4 THEN 'unused_binding' ELSE 'unused_function_argument' END AS rule_id FROM part WHERE {_KIND} IN (0, 2, 4)) GROUP BY ALL""")
def unused_names(spark: SparkSession, d: str) -> DataFrame:
    """Arguments c and xs..., and the local v, that nothing uses."""
    return resolve.unused(_stored_facts(spark, d)).groupBy("uri", "rule_id").agg(F.count("*").alias("n"))


@query(f"""
SELECT uri, name, count(*)::BIGINT AS n FROM (
  SELECT {_URI} AS uri, unnest(['a', 'a', 'b']) AS name FROM part WHERE {_KIND} = 0 UNION ALL SELECT {_URI}, 'x' FROM part WHERE {_KIND} = 2 UNION ALL SELECT {_URI}, unnest(['i', 'i']) FROM part WHERE {_KIND} = 4) GROUP BY ALL""")
def bound_uses(spark: SparkSession, d: str) -> DataFrame:
    return resolve.bound_uses(_stored_facts(spark, d)).groupBy("uri", "name").agg(F.count("*").alias("n"))
