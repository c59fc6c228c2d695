"""What an editor asks for: ranges, signatures, hover texts, links, actions, formatting; each for many places at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from arborq.functions import paths
from arborq.operators import relational

#: Actions and the rules or conditions they answer.
ACTIONS = (
    ("DeleteUnusedFunctionArgumentName", "unused_function_argument"),
    ("ReplaceUnusedAssignmentName", "unused_binding"),
    ("CompareNothingWithTripleEqual", "nothing_comparison"),
    ("FixMissingRef", "missing_reference"),
    ("ExplicitPackageVarImport", "bare_using"),
)


def selection_ranges(nodes: DataFrame, points: DataFrame) -> DataFrame:
    """(uri, offset, start, stop, level): all blocks around each place, from the narrowest out."""
    found = relational.contained(points, nodes.where("stop > start"), ["uri"], "offset", "start", "stop")
    own = Window.partitionBy("uri", "offset").orderBy(F.col("stop") - F.col("start"), F.col("start").desc(), "node_id")
    return found.select("uri", "offset", "start", "stop", F.row_number().over(own).alias("level"))


def current_block(nodes: DataFrame, points: DataFrame) -> DataFrame:
    """(uri, offset, kind, name, start, stop): the outermost block around each place but the file and its modules."""
    own = nodes.where(~F.col("kind").isin("file", "module", "baremodule"))
    found = relational.contained(points, own, ["uri"], "offset", "start", "stop")
    return relational.top(found, ["uri", "offset"], [(F.col("stop") - F.col("start")).desc(), F.col("node_id").asc()]).select("uri", "offset", "kind", "name", "start", "stop")


def _signature() -> Column:
    name = F.col("name")
    most = F.when(F.col("max_args") == 2**31 - 1, F.lit("...")).otherwise(F.col("max_args").cast("string"))
    kws = F.when(F.size("kws") > 0, F.concat(F.lit("; "), F.array_join("kws", ", "))).otherwise("")
    return F.concat(name, F.lit("("), F.col("min_args").cast("string"), F.lit(".."), most, kws, F.when(F.col("kwsplat"), "; ...").otherwise(""), F.lit(")"))


def signature_help(calls: DataFrame, items: DataFrame, points: DataFrame) -> DataFrame:
    """(uri, offset, callee, signature): for the innermost call around each place the methods that take that many arguments or more."""
    at = relational.innermost(points, calls.drop("kws"), ["uri"], "offset", "start", "stop").select("uri", "offset", "callee", F.col("min_args").alias("given"))
    methods = items.where("min_args is not null").select(F.col("name").alias("callee"), "name", "min_args", "max_args", "kws", "kwsplat")
    return at.join(methods, "callee").where((F.col("max_args") >= F.col("given")) | (F.col("given") <= 1)).select("uri", "offset", "callee", _signature().alias("signature")).distinct()


def hover(calls: DataFrame, items: DataFrame, points: DataFrame) -> DataFrame:
    """(uri, offset, text): what is known of the function called at each place, methods in order; null for what isn't known."""
    at = relational.innermost(points, calls.drop("kws"), ["uri"], "offset", "start", "stop").select("uri", "offset", F.col("callee").alias("name"))
    known = items.withColumn("line", F.concat("kind", F.lit(" "), F.when(F.col("min_args").isNotNull(), _signature()).otherwise(F.col("name"))))
    texts = known.groupBy("name").agg(F.array_join(F.array_sort(F.collect_set("line")), "\n").alias("text"))
    return points.join(at.join(texts, "name"), ["uri", "offset"], "left").select("uri", "offset", "text")


def document_links(files: DataFrame, there: DataFrame) -> DataFrame:
    """(uri, link, target): strings in files that name a file there is, from the file's folder or from the top."""
    found = files.select("uri", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit('"([^"\\n$]+)"'), F.lit(1)))).alias("link"))
    full = F.when(F.col("link").startswith("/"), F.col("link")).otherwise(F.concat(paths.dirname(F.col("uri")), F.lit("/"), F.col("link")))
    found = found.where(F.col("link").rlike(r"[./]")).withColumn("target", paths.normalised(full))
    return found.join(there.select(F.col("uri").alias("target")), "target", "left_semi").select("uri", "link", "target")


def code_actions(findings: DataFrame) -> DataFrame:
    """findings with the action that answers each."""
    spark = findings.sparkSession
    return findings.join(F.broadcast(spark.createDataFrame(list(ACTIONS), "action string, rule_id string")), "rule_id")


def nothing_edits(findings: DataFrame) -> DataFrame:
    """(uri, start, stop, text): the edits of CompareNothingWithTripleEqual, from a file's content."""
    old = F.expr("substring(content, start + 1, stop - start)")
    return findings.where("rule_id = 'nothing_comparison'").select("uri", "start", "stop", F.when(old == "==", "===").otherwise("!==").alias("text"))


def format_edits(files: DataFrame, formatter: Callable[[str], str]) -> DataFrame:
    """(uri, text, error): a whole new text for files that the formatter changes; one that it fails on is left as it is, with the error."""

    def run(text: str | None) -> tuple[str | None, str | None]:
        try:
            return (None if text is None else formatter(text)), None
        except Exception as e:  # noqa: BLE001  whatever a formatter raises is the file's error
            return None, f"{type(e).__name__}: {e}"

    out = files.withColumn("new", F.udf(run, "struct<text: string, error: string>", useArrow=False)("content"))
    return out.where((F.col("new.text") != F.col("content")) | F.col("new.error").isNotNull()).select("uri", "new.text", "new.error")


def format_range(files: DataFrame, first: int, last: int, formatter: Callable[[str], str]) -> DataFrame:
    """(uri, text): lines first to last (1-based, bounds are clamped) formatted by themselves, the others as they are."""
    lines = F.split("content", "\n", -1)
    low, high = F.greatest(F.lit(first), F.lit(1)), F.least(F.lit(last), F.size(lines))
    part = lambda a, n: F.array_join(F.slice(lines, a, n), "\n")
    made = F.udf(formatter, StringType(), useArrow=False)(part(low, F.greatest(high - low + 1, F.lit(0))))
    joined = F.concat_ws("\n", F.when(low > 1, part(F.lit(1), low - 1)), made, F.when(high < F.size(lines), part(high + 1, F.size(lines) - high)))
    return files.select("uri", joined.alias("text"))
