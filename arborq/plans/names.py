"""Queries over parts as declarations and lines as uses: ids, visibility, arities, references, search, registry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arborq.operators import registry as versions
from arborq.operators import projects, relational, symbols
from arborq.operators import versions as ranges
from arborq.plans.registry import query, table


@query("""SELECT p_partkey, p_brand, p_type, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) - 1 AS occurrence FROM part""")
def item_ids(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").select("p_partkey", "p_brand", "p_type")
    return symbols.item_ids(part, ["p_brand", "p_type"], ["p_partkey"]).select("p_partkey", "p_brand", "p_type", F.col("occurrence").cast("long").alias("occurrence"))


_KIND_SQL = "['function', 'struct', 'assignment', 'const', 'function', 'abstract', 'assignment', 'macro'][1 + p_partkey % 8]"


def _declarations(spark: SparkSession, d: str) -> DataFrame:
    kinds = F.array(*[F.lit(k) for k in ("function", "struct", "assignment", "const", "function", "abstract", "assignment", "macro")])
    return table(spark, d, "part").select(F.col("p_brand").alias("module"), F.concat(F.lit("n"), F.col("p_size").cast("string")).alias("name"), F.element_at(kinds, (F.col("p_partkey") % 8 + 1).cast("int")).alias("kind"), "p_partkey")


@query(f"""
WITH i AS (SELECT p_brand AS module, 'n' || p_size AS name, {_KIND_SQL} AS kind, p_partkey FROM part),
g AS (SELECT module, name, max(p_partkey) AS last, max(p_partkey) FILTER (kind NOT IN ('function', 'assignment')) AS strong FROM i GROUP BY ALL)
SELECT g.module, g.name, i.kind, i.p_partkey FROM g JOIN i s ON true AND s.p_partkey = coalesce(g.strong, g.last) JOIN i ON i.p_partkey = CASE WHEN g.strong IS NOT NULL AND s.kind IN ('struct', 'mutable_struct', 'abstract', 'primitive', 'enum') THEN g.strong ELSE g.last END""")
def declared_fold(spark: SparkSession, d: str) -> DataFrame:
    return symbols.declared(_declarations(spark, d), ["module", "name"], "p_partkey")


@query(f"""SELECT module, count(*)::BIGINT AS n_exports, min(name) AS first_export FROM (SELECT DISTINCT p_brand AS module, 'n' || p_size AS name, {_KIND_SQL} AS kind FROM part) WHERE kind IN ('struct', 'macro') GROUP BY module""")
def exports(spark: SparkSession, d: str) -> DataFrame:
    own = _declarations(spark, d).where("kind IN ('struct', 'macro')")
    return own.select("module", "name", "kind").distinct().groupBy("module").agg(F.count("*").alias("n_exports"), F.min("name").alias("first_export"))


@query("""
WITH r AS (
  SELECT l_suppkey % 7 AS module, 'n' || (l_partkey % 50) AS name, 'w' || l_orderkey || '-' || l_linenumber AS item, l_orderkey * 10 + l_linenumber AS ord, 1 AS tier FROM lineitem
  UNION ALL SELECT o_custkey % 7, 'n' || (o_orderkey % 60), 'e' || o_orderkey, o_orderkey * 10, 2 FROM orders
  UNION ALL SELECT p_partkey % 7, 'n' || p_size, 'd' || p_partkey, p_partkey * 10, 3 FROM part WHERE p_size % 2 = 0)
SELECT module::BIGINT AS module, name, arg_max(item, struct_pack(tier := tier, ord := ord)) AS item, max(tier)::INTEGER AS tier FROM r GROUP BY module, name""")
def visible_names(spark: SparkSession, d: str) -> DataFrame:
    """Lines are names of wildcard imports, orders of explicit ones, and parts are declared."""
    n = lambda c: F.concat(F.lit("n"), c.cast("string"))
    line, order, part = (table(spark, d, t) for t in ("lineitem", "orders", "part"))
    wild = line.select((F.col("l_suppkey") % 7).alias("module"), n(F.col("l_partkey") % 50).alias("name"), F.concat(F.lit("w"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("item"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"))
    explicit = order.select((F.col("o_custkey") % 7).alias("module"), n(F.col("o_orderkey") % 60).alias("name"), F.concat(F.lit("e"), F.col("o_orderkey").cast("string")).alias("item"), (F.col("o_orderkey") * 10).alias("ord"))
    own = part.where("p_size % 2 = 0").select((F.col("p_partkey") % 7).alias("module"), n(F.col("p_size")).alias("name"), F.concat(F.lit("d"), F.col("p_partkey").cast("string")).alias("item"), (F.col("p_partkey") * 10).alias("ord"))
    return symbols.visible([(wild, symbols.WILDCARD), (explicit, symbols.EXPLICIT), (own, symbols.DECLARED)], ["module", "name"], "item", "ord")


@query("""SELECT p_brand AS module, 'n' || p_size AS name, count(*)::BIGINT AS n, min(p_partkey % 4)::BIGINT AS least, max(p_partkey % 4 + p_partkey % 3)::BIGINT AS most, string_agg(p_partkey % 4, ',' ORDER BY p_partkey) AS arities FROM part GROUP BY ALL""")
def method_index(spark: SparkSession, d: str) -> DataFrame:
    items = _declarations(spark, d)
    k = F.col("p_partkey")
    got = symbols.method_index(items, ["module", "name"], "p_partkey", F.struct((k % 4).alias("min"), (k % 4 + k % 3).alias("max")))
    return got.select("module", "name", F.size("arities").cast("long").alias("n"), F.array_min("arities.min").alias("least"), F.array_max("arities.max").alias("most"), F.array_join(F.transform("arities", lambda a: a["min"].cast("string")), ",").alias("arities"))


_SHAPE = ["args", "kws", "splat"]


def _calls(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, Column]:
    line, part = table(spark, d, "lineitem"), table(spark, d, "part")
    calls = line.select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 200).alias("callee"), (F.col("l_suppkey") % 6).alias("args"), F.when(F.col("l_tax") > 0.06, F.array(F.lit("k1"))).otherwise(F.array().cast("array<string>")).alias("kws"), (F.col("l_quantity") == 1).alias("splat"))
    k = F.col("p_partkey")
    methods = part.select((k % 200).alias("callee"), (k % 4).alias("lo"), (k % 4 + k % 2).alias("hi"), F.when(k % 3 == 0, F.array(F.lit("k1"), F.lit("k2"))).otherwise(F.array().cast("array<string>")).alias("names"), (k % 11 == 0).alias("kwsplat"))
    fits = symbols.arity_fits(
        {"min": F.col("c.args"), "max": F.when(F.col("c.splat"), F.lit(symbols.UNBOUNDED)).otherwise(F.col("c.args")), "kws": F.col("c.kws"), "has_splat": F.col("c.splat")},
        {"min": F.col("m.lo"), "max": F.col("m.hi"), "kws": F.col("m.names"), "kwsplat": F.col("m.kwsplat")},
    )
    return calls, methods, fits


_FITS_SQL = """
WITH c AS (SELECT l_orderkey, l_linenumber, l_partkey % 200 AS callee, l_suppkey % 6 AS args, l_tax > 0.06 AS kw, l_quantity = 1 AS splat FROM lineitem),
m AS (SELECT p_partkey % 200 AS callee, p_partkey % 4 AS lo, p_partkey % 4 + p_partkey % 2 AS hi, p_partkey % 3 = 0 AS names, p_partkey % 11 = 0 AS kwsplat FROM part)
SELECT l_orderkey, l_linenumber FROM c WHERE {} EXISTS (SELECT 1 FROM m WHERE m.callee = c.callee AND (splat OR (lo <= args AND args <= hi)) AND (kwsplat OR NOT kw OR names))
"""


@query(_FITS_SQL.format("EXISTS (SELECT 1 FROM m WHERE m.callee = c.callee) AND NOT"))
def arity_anti(spark: SparkSession, d: str) -> DataFrame:
    """Calls that no method of their callee fits."""
    calls, methods, fits = _calls(spark, d)
    return symbols.unfit_calls(calls, methods, "callee", _SHAPE, fits).select("l_orderkey", "l_linenumber")


@query(_FITS_SQL.format(""))
def arity_semi(spark: SparkSession, d: str) -> DataFrame:
    calls, methods, fits = _calls(spark, d)
    return symbols.fit_calls(calls, methods, "callee", _SHAPE, fits).select("l_orderkey", "l_linenumber")


def _uses(spark: SparkSession, d: str) -> DataFrame:
    line = table(spark, d, "lineitem")
    return line.select(F.concat(F.lit("f"), (F.col("l_orderkey") % 500).cast("string")).alias("uri"), (F.floor(F.col("l_orderkey") / 500) * 10 + F.col("l_linenumber")).alias("offset"), (F.col("l_suppkey") % 9 + 1).alias("span"), F.col("l_partkey").alias("item"), (F.col("l_returnflag") == "R").alias("is_write"), F.when(F.col("l_linestatus") == "O", F.concat(F.lit("n"), F.col("l_partkey").cast("string"))).otherwise(F.lit("alias")).alias("bound_name"))


_USES_SQL = "(SELECT 'f' || (l_orderkey % 500) AS uri, (l_orderkey // 500) * 10 + l_linenumber AS offs, l_suppkey % 9 + 1 AS span, l_partkey AS item, l_returnflag = 'R' AS is_write, CASE WHEN l_linestatus = 'O' THEN 'n' || l_partkey ELSE 'alias' END AS bound_name FROM lineitem)"


def _items(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("item"))


@query(f"SELECT DISTINCT uri, offs AS offset_, span FROM {_USES_SQL} WHERE item IN (SELECT p_partkey FROM part)")
def references(spark: SparkSession, d: str) -> DataFrame:
    return symbols.references(_uses(spark, d), _items(spark, d), "item").select("uri", F.col("offset").alias("offset_"), "span").distinct()


@query(f"SELECT DISTINCT offs AS offset_, span, CASE WHEN is_write THEN 'write' ELSE 'read' END AS kind FROM {_USES_SQL} WHERE uri = 'f7' AND item IN (SELECT p_partkey FROM part)")
def highlights(spark: SparkSession, d: str) -> DataFrame:
    found = symbols.references(_uses(spark, d), _items(spark, d), "item")
    return symbols.highlights(found, "f7").select(F.col("offset").alias("offset_"), "span", "kind").distinct()


@query(f"SELECT DISTINCT uri, offs AS offset_, span FROM {_USES_SQL} WHERE bound_name = 'n' || item AND item IN (SELECT p_partkey FROM part)")
def rename_sites(spark: SparkSession, d: str) -> DataFrame:
    found = symbols.references(_uses(spark, d), _items(spark, d), "item")
    return symbols.rename_sites(found, F.concat(F.lit("n"), F.col("item").cast("string"))).select("uri", F.col("offset").alias("offset_"), "span").distinct()


_RANK_SQL = "CASE WHEN label = 'sma' THEN 0 WHEN starts_with(label, 'sma') THEN 1 WHEN starts_with(lower(label), 'sma') THEN 2 ELSE 3 END"


@query(f"""
WITH n AS (SELECT DISTINCT lower(p_name) AS label, CASE WHEN p_size % 3 = 0 THEN 'local' WHEN p_size % 3 = 1 THEN 'module' ELSE 'store' END AS source, (p_size % 4)::INTEGER AS depth FROM part),
m AS (SELECT *, {_RANK_SQL} AS rnk, CASE source WHEN 'local' THEN depth WHEN 'module' THEN 100 + depth ELSE 500 END AS priority FROM n WHERE starts_with(label, 'sma') OR 1 - levenshtein(label, 'sma') / greatest(length(label), 3) >= 0.6)
SELECT label, source, depth, lpad(row_number() OVER (ORDER BY rnk, priority, length(label), label, source, depth)::VARCHAR, greatest(6, length((count(*) OVER ())::VARCHAR))::INTEGER, '0') AS rank_text FROM m""")
def completion_rank(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_size") % 3
    names = table(spark, d, "part").select(F.lower("p_name").alias("label"), F.when(k == 0, "local").when(k == 1, "module").otherwise("store").alias("source"), (F.col("p_size") % 4).alias("depth")).distinct()
    return symbols.completions(names, "sma").select("label", "source", "depth", "rank_text")


@query("SELECT p_partkey, p_name FROM part WHERE starts_with(p_name, 'small b')")
def symbol_prefix(spark: SparkSession, d: str) -> DataFrame:
    return symbols.symbol_matches(table(spark, d, "part").select("p_partkey", "p_name"), "small b", "p_name")


@query("""
WITH w AS (SELECT DISTINCT lower(unnest(string_split(p_name, ' '))) AS name FROM part),
n AS (SELECT name FROM w UNION ALL SELECT name || 's' FROM w UNION ALL SELECT name || 'ify' FROM w UNION ALL SELECT substr(name, 2) FROM w UNION ALL SELECT upper(name) FROM w),
s AS (SELECT name, CASE WHEN name = 'bolt' THEN 0.0 WHEN starts_with(lower(name), 'bolt') THEN 0.5 * levenshtein(lower(name), 'bolt') ELSE levenshtein(lower(name), 'bolt') END::DOUBLE AS score FROM (SELECT DISTINCT name FROM n))
SELECT name, score FROM s WHERE score < 2 ORDER BY score, name LIMIT 25""")
def doc_search(spark: SparkSession, d: str) -> DataFrame:
    """Words of the parts' names, with endings, without their first letters and in capitals."""
    words = table(spark, d, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("w"))
    w = F.col("w")
    forms = F.array(w, F.concat(w, F.lit("s")), F.concat(w, F.lit("ify")), F.substring(w, 2, 1000), F.upper(w))
    return symbols.doc_search(words.select(F.explode(forms).alias("name")).distinct(), "bolt").select("name", "score")


def _versions(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, d, "part").select(F.col("p_brand").alias("name"), (F.col("p_size") % 3).alias("major"), (k % 7).alias("minor"), k.alias("patch"), (k % 10 == 0).alias("yanked"))


_VERSIONS_SQL = "(SELECT p_brand AS name, p_size % 3 AS major, p_partkey % 7 AS minor, p_partkey AS patch, p_partkey % 10 = 0 AS yanked FROM part)"


@query(f"SELECT name, major, minor, patch FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY major DESC, minor DESC, patch DESC) AS k FROM {_VERSIONS_SQL} WHERE NOT yanked) WHERE k <= 2")
def registry_topn(spark: SparkSession, d: str) -> DataFrame:
    return versions.newest(versions.eligible(_versions(spark, d)), 2, ["name"]).drop("yanked")


@query(f"SELECT name, line, major, minor, patch FROM (SELECT *, row_number() OVER (PARTITION BY name, line ORDER BY major DESC, minor DESC, patch DESC) AS k FROM (SELECT *, CASE WHEN major > 0 THEN major::VARCHAR ELSE '0.' || minor END AS line FROM {_VERSIONS_SQL} WHERE NOT yanked)) WHERE k <= 1")
def registry_topn_per_line(spark: SparkSession, d: str) -> DataFrame:
    own = versions.eligible(_versions(spark, d)).withColumn("line", versions.breaking_line(F.col("major"), F.col("minor")))
    return versions.newest(own, 1, ["name", "line"]).drop("yanked")


@query("""
WITH v AS (SELECT p_partkey, p_brand AS name, p_size % 3 AS a, p_partkey % 7 AS b, p_partkey % 5 AS c, p_partkey % 11 = 0 AS rc FROM part),
k AS (SELECT 'Brand#' || (1 + s_suppkey % 5) || (1 + s_suppkey // 5 % 5) AS name, s_suppkey % 2 AS fa, s_suppkey % 4 AS fb, s_suppkey % 3 AS ta, 3 + s_suppkey % 5 AS tb, s_suppkey % 4 AS l0, s_suppkey % 3 AS l1, 9 - s_suppkey % 4 AS h1 FROM supplier),
f AS (SELECT p_partkey, l0, l1, h1 FROM v JOIN k USING (name) WHERE (fa, fb, 0) <= (a, b, c) AND (a, b, c) < (ta, tb + 1, 0)),
s AS (SELECT p_partkey, max(l0) AS l0, max(l1) AS l1, min(h1) AS h1 FROM f GROUP BY p_partkey)
SELECT p_partkey, a || '.' || b || '.' || c || CASE WHEN rc THEN '-rc1' ELSE '' END AS version, CASE WHEN s.p_partkey IS NOT NULL THEN '0.' || l0 || '.0 to 0.10.0; 1.' || l1 || '.0 to 1.' || (h1 + 1) || '.0' END AS allowed,
  CASE WHEN s.p_partkey IS NULL THEN true ELSE l1 <= 2 AND 2 <= h1 END AS runs FROM v LEFT JOIN s USING (p_partkey)""")
def registry_compat(spark: SparkSession, d: str) -> DataFrame:
    """Parts as versions of their brands' packages, suppliers as what those declare: the versions of the language that each works with, and whether 1.2 is one."""
    k = F.col("p_partkey")
    dots = lambda *c: F.concat_ws(".", *[x.cast("string") for x in c])
    own = table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("name"), F.concat(dots(F.col("p_size") % 3, k % 7, k % 5), F.when(k % 11 == 0, "-rc1").otherwise("")).alias("version"))
    s = F.col("s_suppkey")
    brand = F.concat(F.lit("Brand#"), (1 + s % 5).cast("string"), (1 + F.floor(s / 5) % 5).cast("string"))
    compat = table(spark, d, "supplier").select(brand.alias("name"), F.concat(dots(s % 2, s % 4), F.lit("-"), dots(s % 3, 3 + s % 5)).alias("for_versions"), F.array(F.concat(F.lit("0."), (s % 4).cast("string"), F.lit("-0.9")), F.concat(F.lit("1."), (s % 3).cast("string"), F.lit("-1."), (9 - s % 4).cast("string"))).alias("works_with"))
    got = ranges.compatibility(own, compat, ["name"])
    runs = F.coalesce(ranges.holds(F.col("allowed"), ranges.version(F.lit("1.2.0"))), F.lit(True))
    return got.select("p_partkey", "version", ranges.shown(F.col("allowed")).alias("allowed"), runs.alias("runs"))


@query("SELECT p_partkey FROM part WHERE ('0x' || substr(md5(p_name || '@' || p_partkey), 1, 8))::BIGINT % 5 = 2")
def shard_select(spark: SparkSession, d: str) -> DataFrame:
    h = F.conv(F.substring(F.md5(F.concat("p_name", F.lit("@"), F.col("p_partkey").cast("string"))), 1, 8), 16, 10).cast("long")
    return table(spark, d, "part").where(h % 5 == 2).select("p_partkey")


@query()
def shard_fnv(spark: SparkSession, d: str) -> DataFrame:
    """Shards by FNV-1a, which SQL has no function for."""
    part = table(spark, d, "part").select("p_partkey", "p_name")
    return versions.shard(part, F.concat("p_name", F.lit("@"), F.col("p_partkey").cast("string")), 5, 2)


@query("""
SELECT c.c_custkey, CASE WHEN c.c_nationkey = o.c_nationkey THEN 'nation' || c.c_nationkey WHEN n.n_regionkey = m.n_regionkey THEN 'region' || n.n_regionkey ELSE 'any' END AS joined
FROM customer c JOIN customer o ON o.c_custkey = c.c_custkey + 1 JOIN nation n ON n.n_nationkey = c.c_nationkey JOIN nation m ON m.n_nationkey = o.c_nationkey""")
def type_join(spark: SparkSession, d: str) -> DataFrame:
    """Customers' chains of customer, nation, region as supertypes: the nearest that a customer and the next have in common."""
    nation = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey").join(nation, "c_nationkey")
    name = lambda p, k: F.concat(F.lit(p), F.col(k).cast("string"))
    chains = c.select("c_custkey", F.array(name("customer", "c_custkey"), name("nation", "c_nationkey"), name("region", "n_regionkey"), F.lit("any")).alias("up"))
    other = chains.select((F.col("c_custkey") - 1).alias("c_custkey"), F.col("up").alias("other"))
    return chains.join(other, "c_custkey").select("c_custkey", symbols.type_join(F.col("up"), F.col("other")).alias("joined"))


@query("""
WITH p AS (SELECT l_orderkey, l_linenumber, l_suppkey % 10 AS file, l_partkey % 4000 AS pos FROM lineitem),
i AS (SELECT p_partkey AS node, p_size % 10 AS file, p_partkey % 3000 AS start, p_partkey % 3000 + 1 + (p_partkey * 7) % 900 AS stop FROM part)
SELECT file, pos, node FROM (SELECT p.file, p.pos, i.node, row_number() OVER (PARTITION BY p.file, p.pos ORDER BY stop - start, start DESC, node) AS k FROM (SELECT DISTINCT file, pos FROM p) p JOIN i ON i.file = p.file AND start <= pos AND pos < stop) WHERE k = 1""")
def innermost_node(spark: SparkSession, d: str) -> DataFrame:
    """The narrowest interval around each place."""
    points = table(spark, d, "lineitem").select((F.col("l_suppkey") % 10).alias("file"), (F.col("l_partkey") % 4000).alias("pos")).distinct()
    k = F.col("p_partkey")
    nodes = table(spark, d, "part").select(k.alias("node"), (F.col("p_size") % 10).cast("long").alias("file"), (k % 3000).alias("start"), (k % 3000 + 1 + (k * 7) % 900).alias("stop"))
    return relational.innermost(points, nodes, ["file"], "pos", "start", "stop", [F.col("node").asc()]).select("file", "pos", "node")


@query("""
WITH p AS (SELECT DISTINCT l_suppkey % 10 AS file, l_partkey % 4000 AS pos FROM lineitem),
i AS (SELECT p_partkey AS node, p_size % 10 AS file, p_partkey % 3000 AS start, p_partkey % 3000 + 1 + (p_partkey * 7) % 900 AS stop FROM part)
SELECT p.file, p.pos, node, row_number() OVER (PARTITION BY p.file, p.pos ORDER BY stop - start, start DESC, node)::BIGINT AS level FROM p JOIN i ON i.file = p.file AND start <= pos AND pos < stop""")
def selection_ranges(spark: SparkSession, d: str) -> DataFrame:
    """All intervals around a place, from the narrowest out."""
    points = table(spark, d, "lineitem").select((F.col("l_suppkey") % 10).alias("file"), (F.col("l_partkey") % 4000).alias("pos")).distinct()
    k = F.col("p_partkey")
    nodes = table(spark, d, "part").select(k.alias("node"), (F.col("p_size") % 10).cast("long").alias("file"), (k % 3000).alias("start"), (k % 3000 + 1 + (k * 7) % 900).alias("stop"))
    return relational.outward(points, nodes, ["file"], "pos", "start", "stop", [F.col("node").asc()]).select("file", "pos", "node", "level")


@query("""
WITH f AS (SELECT DISTINCT p_brand AS module, 'n' || p_size AS name, CASE WHEN p_partkey % 3 = 0 THEN 'Brand#' || (1 + p_partkey % 5) || (1 + p_size % 5) ELSE p_brand END AS owner, CASE WHEN p_partkey % 3 = 0 THEN 'n' || (p_size % 9) ELSE 'n' || p_size END AS fname FROM part),
x AS (SELECT owner, fname, module FROM f WHERE module <> owner OR name <> fname), y AS (SELECT * FROM x UNION SELECT owner, fname, owner FROM x)
SELECT owner, fname AS name, count(*)::BIGINT AS n, string_agg(module, ',' ORDER BY module) AS modules FROM y GROUP BY owner, fname""")
def extended_methods(spark: SparkSession, d: str) -> DataFrame:
    """Brands as modules, every third part a method that is added to a function of another."""
    k, size, brand = F.col("p_partkey"), F.col("p_size"), F.col("p_brand")
    n = lambda c: F.concat(F.lit("n"), c.cast("string"))
    third = k % 3 == 0
    owner = F.when(third, F.concat(F.lit("Brand#"), (1 + k % 5).cast("string"), (1 + size % 5).cast("string"))).otherwise(brand)
    functions = table(spark, d, "part").select(brand.alias("module"), n(size).alias("name"), owner.alias("extends_module"), F.when(third, n(size % 9)).otherwise(n(size)).alias("extends_name"))
    got = symbols.extended_methods(functions)
    return got.select("owner", "name", F.size("modules").cast("long").alias("n"), F.array_join("modules", ",").alias("modules"))


@query("""
WITH d AS (SELECT '/w/p' || l_suppkey AS folder, min('/w/q' || (l_orderkey % 97)) AS project FROM lineitem WHERE l_quantity > 45 AND l_linenumber % 2 = 1 GROUP BY l_suppkey)
SELECT s_suppkey, d.project, CASE WHEN s_suppkey % 4 = 0 OR d.project IS NULL THEN '/w/p' || s_suppkey ELSE '/active' END AS test_env FROM supplier LEFT JOIN d ON d.folder = '/w/p' || s_suppkey""")
def dev_dependencies(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as packages, lines as entries of manifests: the project that develops each package, and where its tests run; every fourth package is a project itself."""
    key, line = F.col("l_suppkey").cast("string"), F.col("l_linenumber")
    path = F.when(line == 1, F.concat(F.lit("../p"), key)).when(line == 3, F.concat(F.lit("/w/x/../p"), key, F.lit("/"))).otherwise(F.concat(F.lit("./../y/..//p"), key))
    deps = table(spark, d, "lineitem").where("l_quantity > 45").select(F.concat(F.lit("/w/q"), (F.col("l_orderkey") % 97).cast("string")).alias("project"), F.when(line % 2 == 1, "dev").otherwise("registered").alias("kind"), path.alias("path"))
    folder = F.concat(F.lit("/w/p"), F.col("s_suppkey").cast("string"))
    packages = table(spark, d, "supplier").select("s_suppkey", folder.alias("folder"))
    found = projects.test_environments(projects.deving(packages, deps), packages.where("s_suppkey % 4 = 0").select("folder"), "/active")
    return found.select("s_suppkey", "project", "test_env")
