"""Queries over documents as files: sources, places, scope, configuration, diagnostics, projects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborq.functions import globs, paths, text
from arborq.operators import config, diagnostics, projects, relational, rules
from arborq.operators.graph import new_folder
from arborq.plans.registry import query, table
from arborq.sources import folders
from arborq.workspace import Workspace

URI = "'/' || lang || '/' || source || '/' || doc_id || '.jl'"


def files(spark: SparkSession, d: str) -> DataFrame:
    """documents as files of folders /lang/source."""
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.concat(F.lit("/"), "lang", F.lit("/"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".jl")).alias("uri"), "text")


@query("""
SELECT CASE WHEN doc_id % 3 = 0 THEN 'file:///' || doc_id || '.JL' WHEN doc_id % 3 = 1 THEN 'file:///' || doc_id || '.md' ELSE 'untitled:' || doc_id END AS uri,
  CASE WHEN doc_id % 3 = 0 THEN '.jl' WHEN doc_id % 3 = 1 THEN '.md' ELSE '' END AS ext,
  CASE WHEN doc_id % 3 = 0 THEN true WHEN doc_id % 3 = 1 THEN false ELSE lang = 'en' END AS is_julia, n_chars
FROM documents""")
def files_scan(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    k, i = F.col("doc_id") % 3, F.col("doc_id").cast("string")
    uri = F.when(k == 0, F.concat(F.lit("file:///"), i, F.lit(".JL"))).when(k == 1, F.concat(F.lit("file:///"), i, F.lit(".md"))).otherwise(F.concat(F.lit("untitled:"), i))
    out = docs.withColumns({"uri": uri, "language_id": F.when(F.col("lang") == "en", "julia")})
    return out.select("uri", paths.extension(F.col("uri")).alias("ext"), paths.is_julia(F.col("uri"), F.col("language_id")).alias("is_julia"), "n_chars")


@query("""
WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents)
SELECT doc_id, line_no::BIGINT AS line_no, (1 + coalesce(sum(strlen(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS start, strlen(line)::BIGINT AS n_bytes FROM l""")
def line_positions(spark: SparkSession, d: str) -> DataFrame:
    return text.line_table(table(spark, d, "documents"), "doc_id", "text")


@query("""
WITH o AS (SELECT doc_id, text, unnest([1, 1 + strlen(text) // 2, 1 + strlen(text)]) AS offs FROM documents),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM documents),
s AS (SELECT doc_id, k, 1 + coalesce(sum(strlen(line) + 1) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM l)
SELECT o.doc_id, offs::BIGINT AS offset_, max(k)::BIGINT AS line_no, (offs - max(start) + 1)::BIGINT AS col_no
FROM o JOIN s ON o.doc_id = s.doc_id AND s.start <= offs GROUP BY o.doc_id, offs""")
def offset_positions(spark: SparkSession, d: str) -> DataFrame:
    n = F.octet_length("text")
    docs = table(spark, d, "documents").select("doc_id", text.line_starts(F.col("text")).alias("starts"), F.array_distinct(F.array(F.lit(1), 1 + F.floor(n / 2).cast("int"), 1 + n)).alias("o"))
    out = docs.select("doc_id", "starts", F.explode("o").alias("o"))
    return out.select("doc_id", F.col("o").cast("long").alias("offset_"), text.line_at(F.col("starts"), F.col("o")).cast("long").alias("line_no"), text.column_at(F.col("starts"), F.col("o")).cast("long").alias("col_no"))


@query(f"""
WITH f AS (SELECT doc_id, lang, source, {URI} AS uri FROM documents)
SELECT uri, CASE WHEN source = 'src1' AND (doc_id % 10) = 7 THEN false WHEN source = 'src2' AND lang = 'en' THEN false WHEN lang = 'fr' AND NOT (source LIKE 'src1%') THEN false ELSE true END AS in_scope FROM f""")
def glob_scope(spark: SparkSession, d: str) -> DataFrame:
    """Three configurations: the topmost excludes src1/*7.jl below any folder and en/src2/, that of /fr takes src1* folders only."""
    regex = lambda *g: [globs.glob_to_regex(x) for x in g]
    found = spark.createDataFrame([("", [], regex("**/src1/*7.jl", "en/src2/")), ("/fr", regex("src1*/"), [])], "dir string, include array<string>, exclude array<string>")
    return config.scoped(files(spark, d).select("uri"), found)


#: Patterns, and what each means as SQL over p, a path below the folder: only a slash at the end takes what is below, [^..] is a negation, a backslash a slash, an open bracket itself, and an empty pattern has no file.
_RULES = [
    ("src2", "p = 'src2' OR p LIKE '%/src2'"), ("src2/", "starts_with(p, 'src2/') OR p LIKE '%/src2/%'"), ("en/src2", "p = 'en/src2'"), ("/en/src2/", "starts_with(p, 'en/src2/')"), ("en\\src1/*.jl", "regexp_full_match(p, 'en/src1/[0-9]+.jl')"),
    ("[^de]*/", "regexp_matches(p, '(^|/)[^de/][^/]*/')"), ("*[!0-5].jl", "substr(p, -4, 1) NOT IN ('0', '1', '2', '3', '4', '5') AND p LIKE '%.jl'"), ("**/src1/**", "p LIKE 'src1/%' OR p LIKE '%/src1/%'"), ("?r/src?/?.jl", "regexp_full_match(p, '[^/]r/src[^/]/[^/].jl')"), ("[src", "p LIKE '%[src'"), ("", "p = ''"),
]


@query(f"""
WITH f AS (SELECT ltrim({URI}, '/') AS p FROM documents)
SELECT rule, count(*)::BIGINT AS n, min(p) AS first_path, max(p) AS last_path FROM ({" UNION ALL ".join(f"SELECT {i} AS rule, p FROM f WHERE {sql}" for i, (_, sql) in enumerate(_RULES))}) GROUP BY rule""")
def glob_rules(spark: SparkSession, d: str) -> DataFrame:
    """What each of _RULES takes of the documents' paths."""
    own = files(spark, d).select(F.ltrim("uri", F.lit("/")).alias("p"))
    hits = F.array(*[F.when(globs.selected(F.col("p"), [g], []), F.lit(i)) for i, (g, _) in enumerate(_RULES)])
    rows = own.select("p", F.explode(F.array_compact(hits)).alias("rule"))
    return rows.groupBy("rule").agg(F.count("*").alias("n"), F.min("p").alias("first_path"), F.max("p").alias("last_path"))


@query(f"""
SELECT {URI} AS uri, CASE WHEN source IN ('src1', 'src2', 'src3') THEN '/' || lang || '/' || source WHEN lang IN ('en', 'de') THEN '/' || lang END AS config_dir FROM documents""")
def nearest_config(spark: SparkSession, d: str) -> DataFrame:
    own = files(spark, d).select("uri")
    lang = spark.createDataFrame([("/en",), ("/de",)], "config_dir string")
    deep = own.select(paths.dirname(F.col("uri")).alias("config_dir")).distinct().where(paths.basename(F.col("config_dir")).isin("src1", "src2", "src3"))
    return relational.deepest_match(own, lang.unionByName(deep), "uri", "config_dir")


def _configs(spark: SparkSession) -> DataFrame:
    """A strict configuration at /en, a minimal one at /en/src0 and one at /fr that lets debug statements pass below src3."""
    regex = lambda *g: [globs.glob_to_regex(x) for x in g]
    return spark.createDataFrame(
        [
            ("/en/Lint.toml", "/en", "strict", [], regex("src4/"), {"string_concat_style": "off", "async_task": "error"}, []),
            ("/en/src0/Lint.toml", "/en/src0", "minimal", [], [], {}, []),
            ("/fr/Lint.toml", "/fr", "default", [], [], {"debug_statement": "warning"}, [(regex("src3/"), {"debug_statement": "hint"}), (regex("src3/*1.jl"), {"debug_statement": "off"})]),
        ],
        "config string, dir string, preset string, include array<string>, exclude array<string>, rules map<string,string>, overrides array<struct<paths: array<string>, rules: map<string,string>>>",
    )


_PRESET_SQL = "(VALUES " + ", ".join(f"('{r}', '{a}', '{b}', '{c}')" for r, _, a, b, c, _ in rules.RULES) + ") r(rule_id, s_minimal, s_default, s_strict)"
_EFFECTIVE_SQL = f"""
f AS (SELECT doc_id, lang, source, text, {URI} AS uri, CASE WHEN lang = 'en' AND source = 'src0' THEN 'minimal' WHEN lang = 'en' THEN 'strict' ELSE 'default' END AS preset FROM documents),
e AS (SELECT f.*, rule_id, CASE
    WHEN preset = 'strict' AND rule_id = 'string_concat_style' THEN 'off' WHEN preset = 'strict' AND rule_id = 'async_task' THEN 'error'
    WHEN lang = 'fr' AND rule_id = 'debug_statement' THEN CASE WHEN source = 'src3' AND doc_id % 10 = 1 THEN 'off' WHEN source = 'src3' THEN 'hint' ELSE 'warning' END
    WHEN preset = 'strict' THEN s_strict WHEN preset = 'minimal' THEN s_minimal ELSE s_default END AS severity FROM f CROSS JOIN {_PRESET_SQL})
"""


@query(f"WITH {_EFFECTIVE_SQL} SELECT uri, rule_id, severity FROM e")
def config_merge(spark: SparkSession, d: str) -> DataFrame:
    return config.effective(files(spark, d), _configs(spark))


def _findings(spark: SparkSession, d: str) -> DataFrame:
    """Line-level rules over texts: a line with !! is a debug statement, one with *** an asynchronous task, one with | joins strings."""
    lines = files(spark, d).select("uri", F.posexplode(F.split("text", "\n", -1)).alias("i", "line"))
    hit = F.array(F.when(F.col("line").contains("!!"), "debug_statement"), F.when(F.col("line").contains("***"), "async_task"), F.when(F.col("line").contains("|"), "string_concat_style"))
    return lines.select("uri", (F.col("i") + 1).cast("long").alias("line_no"), F.explode(F.array_compact(hit)).alias("rule_id"))


_FOUND_SQL = f"""
WITH {_EFFECTIVE_SQL},
l AS (SELECT uri, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM f),
h AS (SELECT uri, line_no, 'debug_statement' AS rule_id FROM l WHERE contains(line, '!!') UNION ALL SELECT uri, line_no, 'async_task' FROM l WHERE contains(line, '***') UNION ALL SELECT uri, line_no, 'string_concat_style' FROM l WHERE contains(line, '|')),
dg AS (SELECT h.uri, h.rule_id, e.severity, h.line_no FROM h JOIN e ON h.uri = e.uri AND h.rule_id = e.rule_id WHERE severity <> 'off' AND NOT (lang = 'en' AND source = 'src4'))
"""


def _diagnostics(spark: SparkSession, d: str) -> DataFrame:
    found = _configs(spark)
    return diagnostics.diagnostics(_findings(spark, d), config.effective(files(spark, d), found), config.scoped(files(spark, d).select("uri"), found))


@query(f"{_FOUND_SQL} SELECT uri, rule_id, severity, count(*)::BIGINT AS n, min(line_no)::BIGINT AS first_line FROM dg GROUP BY ALL")
def diagnostics_rollup(spark: SparkSession, d: str) -> DataFrame:
    """The configured findings of each file."""
    return _diagnostics(spark, d).groupBy("uri", "rule_id", "severity").agg(F.count("*").alias("n"), F.min("line_no").alias("first_line"))


@query(f"{_FOUND_SQL} SELECT f.uri, count(dg.uri)::BIGINT AS n FROM f LEFT JOIN dg ON f.uri = dg.uri GROUP BY f.uri")
def diagnostics_empty(spark: SparkSession, d: str) -> DataFrame:
    return diagnostics.per_file(files(spark, d), _diagnostics(spark, d))


@query(f"""
SELECT uri, CASE WHEN lang = 'en' AND source IN ('src1', 'src2') THEN '/en/' || source WHEN lang IN ('en', 'fr') THEN '/' || lang ELSE '' END AS folder,
  CASE WHEN lang = 'en' AND source IN ('src1', 'src2') THEN 'environment' WHEN lang IN ('en', 'fr') THEN 'project' ELSE 'active' END AS via
FROM (SELECT lang, source, {URI} AS uri FROM documents)""")
def folder_cascade(spark: SparkSession, d: str) -> DataFrame:
    one = lambda *f: spark.createDataFrame([(x,) for x in f], "folder string")
    cascade = [(one("/en/src1", "/en/src2"), "environment"), (one("/en", "/fr"), "project"), (one(""), "active")]
    return projects.governing(files(spark, d).select("uri"), cascade)


@query("""
SELECT s_suppkey, s_nationkey % 2 = 0 AND s_acctbal > 0 AS is_package, EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity >= 50 AND l_linenumber = 7) AS is_project,
  NOT (s_nationkey % 2 = 0 AND s_acctbal > 0) AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity >= 50 AND l_linenumber = 7) AS is_env
FROM supplier""")
def project_classify(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as folders: the project file of a package where the nation's key is even and the balance above 0; a manifest where some line says so."""
    s = table(spark, d, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    manifest = table(spark, d, "lineitem").where("l_quantity >= 50 AND l_linenumber = 7").select(F.col("l_suppkey").alias("s_suppkey"), F.lit("Manifest.toml").alias("manifest")).distinct()
    own = (F.col("s_nationkey") % 2 == 0) & (F.col("s_acctbal") > 0)
    fields = F.struct(F.when(own, "P").alias("name"), F.lit("00000000-0000-0000-0000-000000000000").alias("uuid"), F.when(own, "1.0.0").alias("version"))
    return projects.classified(s.join(manifest, "s_suppkey", "left"), fields).select("s_suppkey", "is_package", "is_project", "is_env")


@query("""
WITH l AS (SELECT l_partkey AS k, max(struct_pack(a := l_orderkey, b := l_linenumber, c := l_suppkey)) AS m FROM lineitem GROUP BY 1)
SELECT p_partkey, CASE WHEN p_size = 1 THEN 'override' WHEN l.k IS NOT NULL THEN 'supplier-' || l.m.c ELSE p_brand END AS store FROM part LEFT JOIN l ON l.k = p_partkey""")
def deps_overlay(spark: SparkSession, d: str) -> DataFrame:
    """Layers of a part's store: its brand, under the supplier of its last line, under an override."""
    part = table(spark, d, "part")
    base = part.select("p_partkey", F.col("p_brand").alias("store"), F.lit(0).cast("long").alias("o"), F.lit(0).alias("n"))
    lines = table(spark, d, "lineitem").select(F.col("l_partkey").alias("p_partkey"), F.concat(F.lit("supplier-"), F.col("l_suppkey").cast("string")).alias("store"), F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"))
    over = part.where("p_size = 1").select("p_partkey", F.lit("override").alias("store"), F.lit(0).cast("long").alias("o"), F.lit(0).alias("n"))
    return relational.layered([base, lines.join(part.select("p_partkey"), "p_partkey", "left_semi"), over], ["p_partkey"], "store", ["o", "n"])


@query("""
SELECT page_id, href FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"#]+)', 1)) AS href FROM pages)""")
def links(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"#]+)'), F.lit(1))).alias("href"))


@query("""
WITH l AS (SELECT page_id, unnest(regexp_extract_all(html, 'href="([^"#]+)', 1)) AS href FROM pages)
SELECT page_id, href, count(*)::BIGINT AS n FROM l WHERE EXISTS (SELECT 1 FROM documents d WHERE '/' || string_split(d.text, ' ')[1] = l.href) GROUP BY ALL""")
def document_links(spark: SparkSession, d: str) -> DataFrame:
    """Links that lead to a file there is: documents by their first words."""
    there = table(spark, d, "documents").select(F.concat(F.lit("/"), F.substring_index("text", " ", 1)).alias("href"))
    return links(spark, d).join(there, "href", "left_semi").groupBy("page_id", "href").agg(F.count("*").alias("n"))


@query("""SELECT conv_id, count(*)::BIGINT AS n_cells, string_agg(role || ':' || length(text), ',' ORDER BY turn) AS cells FROM conversations GROUP BY conv_id""")
def cells(spark: SparkSession, d: str) -> DataFrame:
    """A notebook's cells in order."""
    rows = table(spark, d, "conversations").select("conv_id", F.struct("turn", F.concat("role", F.lit(":"), F.char_length("text").cast("string")).alias("cell")).alias("c"))
    got = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("c")).alias("c"))
    return got.select("conv_id", F.size("c").cast("long").alias("n_cells"), F.array_join("c.cell", ",").alias("cells"))


@query("""SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""")
def props_get(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("""
SELECT doc_id, coalesce(regexp_extract(text, '^[^' || chr(10) || ']*'), '') AS first_line, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z]+ing'))[1:1000]), ' ') IS NOT NULL AS has_words FROM documents""")
def outlines(spark: SparkSession, d: str) -> DataFrame:
    """The heading of each file."""
    return table(spark, d, "documents").select("doc_id", F.coalesce(F.regexp_extract("text", "^[^\n]*", 0), F.lit("")).alias("first_line"), F.col("text").isNotNull().alias("has_words"))


@query("""
SELECT '/' || coalesce(lang, 'x') || '/d' || doc_id || CASE WHEN doc_id % 6 < 3 THEN '.jl' ELSE '.md' END AS path, CASE WHEN doc_id % 6 < 3 THEN 'julia' ELSE 'markdown' END AS kind, strlen(coalesce(text, '')) AS size,
  CASE WHEN NOT contains(coalesce(text, ''), chr(0)) THEN length(coalesce(text, '')) END AS n_chars
FROM documents WHERE doc_id % 6 < 4 UNION ALL SELECT '/' || coalesce(lang, 'x') || '/JuliaLint.toml', 'lint_config', 0, 0 FROM documents GROUP BY lang""")
def folder_scan(spark: SparkSession, d: str) -> DataFrame:
    """Documents written out as a tree of files and listed: some are of no kind that is read, and some lie in folders that are never entered."""
    k, lang = F.col("doc_id") % 6, F.coalesce("lang", F.lit("x"))
    docs = table(spark, d, "documents")
    name = F.concat(F.when(k == 5, "/node_modules/d").otherwise("/d"), F.col("doc_id").cast("string"), F.when(k < 3, ".jl").when(k == 4, ".txt").when(k == 5, ".jl").otherwise(".md"))
    files = docs.select(F.concat(F.lit("/"), lang, name).alias("path"), F.col("text").alias("content"))
    files = files.unionByName(docs.select(F.concat(F.lit("/"), lang, F.lit("/JuliaLint.toml")).alias("path"), F.lit("").alias("content")).distinct())
    folder = new_folder(spark, "tree")
    folders.write_tree(files, folder)
    root = folders.filesystem(folder)[1]
    found = folders.tree(spark, folder, "kind IS NOT NULL")
    return found.select(F.substring("path", len(root) + 1, 1 << 20).alias("path"), "kind", "size", F.char_length("content").cast("long").alias("n_chars"))


@query()
def workspace_sweep(spark: SparkSession, d: str) -> DataFrame:
    """A whole workspace from a folder: written out, listed, read, parsed, and its configured findings of every rule by file."""
    from arborq.plans.code import sources  # which registers queries of its own

    config_ = spark.createDataFrame([("/JuliaLint.toml", 'preset = "strict"\n')], "path string, content string")
    folder = new_folder(spark, "sweep")
    folders.write_tree(sources(spark, d).select(F.col("uri").alias("path"), "content").unionByName(config_), folder)
    found = Workspace.from_folders(spark, folder).diagnostics()
    root = F.char_length(F.lit(paths.path_to_uri(folders.filesystem(folder)[1])))
    return found.groupBy(F.expr("uri").alias("uri"), "rule_id", "severity").agg(F.count("*").alias("n")).withColumn("uri", F.substring(F.col("uri"), root + 1, F.lit(1 << 20)))
