"""Text edits: composed for many files at once, applied, and those that get in each other's way told.

An edit (uri, start, stop, text) puts a text in place of the characters from start to stop of a file; with start = stop it
inserts. All places are of the file as it is, so that edits from any number of sources can be put together.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EDIT = "struct<start: bigint, stop: bigint, text: string, rank: bigint>"
#: Characters of edited texts that a task of `applied` holds before it gives them on.
EDITED = 1 << 21


def composed(edits: DataFrame, rank: Column | None = None) -> DataFrame:
    """(uri, taken, refused): for each file the edits that can be made together, in order, and those that can't.

    In the order of start, stop, rank (a number, the smaller first; 0 if not given) and text an edit is taken unless it
    begins before the last one taken ends. So edits that touch go together, insertions at one place follow each other, and
    one that begins inside another is refused. Equal edits count once, whatever their rank; a null text is empty. Nulls
    elsewhere, and edits that end before they begin, are refused.
    """
    rows = edits.select("uri", F.col("start").cast("bigint").alias("start"), F.col("stop").cast("bigint").alias("stop"), F.coalesce("text", F.lit("")).alias("text"), (F.lit(0) if rank is None else rank).cast("bigint").alias("rank"))
    one = rows.groupBy("uri", "start", "stop", "text").agg(F.min("rank").alias("rank"))
    edit = F.struct("start", "stop", "text", "rank")
    good = F.coalesce((F.col("start") >= 0) & (F.col("stop") >= F.col("start")), F.lit(False)) & F.col("uri").isNotNull()
    files = one.groupBy("uri").agg(F.collect_list(F.when(good, F.struct("start", "stop", "rank", "text"))).alias("good"), F.collect_list(F.when(~good, edit)).alias("bad"))
    none = F.array().cast(f"array<{EDIT}>")
    empty = F.struct(F.lit(0).cast("bigint").alias("upto"), none.alias("taken"), none.alias("refused"))

    def step(acc: Column, e: Column) -> Column:
        own = F.array(F.struct(e["start"].alias("start"), e["stop"].alias("stop"), e["text"].alias("text"), e["rank"].alias("rank")))
        fits = e["start"] >= acc["upto"]
        return F.struct(F.when(fits, e["stop"]).otherwise(acc["upto"]).alias("upto"), F.when(fits, F.concat(acc["taken"], own)).otherwise(acc["taken"]).alias("taken"), F.when(fits, acc["refused"]).otherwise(F.concat(acc["refused"], own)).alias("refused"))

    done = files.withColumn("done", F.aggregate(F.array_sort("good"), empty, step))
    return done.select("uri", F.col("done.taken").alias("taken"), F.concat(F.col("done.refused"), F.col("bad").cast(f"array<{EDIT}>")).alias("refused"))


def conflicts(plan: DataFrame) -> DataFrame:
    """(uri, start, stop, text, rank) of the edits of `composed` that can't be made."""
    return plan.select("uri", F.explode("refused").alias("e")).select("uri", "e.*")


def _edited(text: str, edits: list[dict]) -> tuple[str, list[dict]]:
    out, at, beyond = [], 0, []
    for e in edits:
        if e["stop"] > len(text):
            beyond.append(e)
            continue
        out += [text[at : e["start"]], e["text"]]
        at = e["stop"]
    return "".join([*out, text[at:]]), beyond


def _edited_batch(out: list[tuple]) -> pa.RecordBatch:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("text", pa.string()), ("rank", pa.int64())]))
    columns = list(zip(*out, strict=True)) or [[]] * 4
    types = [pa.string(), pa.string(), pa.int64(), kind]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["uri", "content", "n_edits", "refused"])


def edited_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches (uri, content, taken) edited, in batches of EDITED characters, and one more text at most."""
    for batch in batches:
        out, size = [], 0
        for uri, content, taken in zip(batch.column("uri"), batch.column("content"), batch.column("taken"), strict=True):
            own = taken.as_py() or []
            text, beyond = _edited(content.as_py() or "", own)
            out.append((uri.as_py(), text, len(own) - len(beyond), beyond))
            size += len(text)
            if size >= EDITED:
                yield _edited_batch(out)
                out, size = [], 0
        yield _edited_batch(out)


def applied(files: DataFrame, plan: DataFrame) -> DataFrame:
    """(uri, content, n_edits, refused) of the files (uri, content) that a plan of `composed` has edits for: the new text, and how many edits were made; refused are those that reach beyond the file. Null content counts as empty; a plan for a file that isn't there does nothing."""
    rows = files.select("uri", "content").join(plan.select("uri", "taken"), "uri")
    schema = "uri string, content string, n_edits long, refused array<struct<start: bigint, stop: bigint, text: string, rank: bigint>>"
    return rows.mapInArrow(edited_batches, schema)


# --- edits that answer findings

#: Actions that a session has added: name -> (rule, function from findings of that rule and files to edits).
ACTIONS: dict = {}


def _there() -> Column:
    """What a finding is about."""
    return F.expr("substring(content, start + 1, stop - start)")


def of_findings(findings: DataFrame, files: DataFrame, available: DataFrame | None = None) -> DataFrame:
    """(uri, start, stop, text, action): the edits of the actions that answer findings (uri, rule_id, message, start, stop).

    ReplaceUnusedAssignmentName puts _ for a name that is never used, DeleteUnusedFunctionArgumentName takes an argument's
    name away where a type follows it and puts _ elsewhere, CompareNothingWithTripleEqual adds a =, and FixMissingRef puts
    `using Package: name` first in the file, if just one package of available (package, name) exports the name; a name is
    brought in once a file. Findings that don't spell what they are about any more have none.
    """
    rows = findings.select("uri", "rule_id", "start", "stop").join(files.select("uri", "content"), "uri")
    old = _there()
    word = old.rlike(r"^[\p{L}_][\p{L}\p{N}_!]*$")
    typed = F.expr("substring(content, stop + 1, 2)") == "::"
    text = (
        F.when((F.col("rule_id") == "unused_binding") & word, "_")
        .when((F.col("rule_id") == "unused_function_argument") & word, F.when(typed, "").otherwise("_"))
        .when((F.col("rule_id") == "nothing_comparison") & old.isin("==", "!="), F.when(old == "==", "===").otherwise("!=="))
    )
    action = F.when(F.col("rule_id") == "unused_binding", "ReplaceUnusedAssignmentName").when(F.col("rule_id") == "unused_function_argument", "DeleteUnusedFunctionArgumentName").otherwise("CompareNothingWithTripleEqual")
    out = rows.select("uri", "start", "stop", text.alias("text"), action.alias("action")).where("text is not null")
    for name, (rule_id, run) in ACTIONS.items():
        out = out.unionByName(run(findings.where(F.col("rule_id") == rule_id), files).select("uri", "start", "stop", "text", F.lit(name).alias("action")))
    if available is None:
        return out
    only = available.where("package is not null").groupBy("name").agg(F.min("package").alias("package"), F.count_distinct("package").alias("n")).where("n = 1")
    missing = rows.where("rule_id = 'missing_reference'").select("uri", old.alias("name")).distinct().join(only, "name")
    line = F.concat(F.lit("using "), "package", F.lit(": "), "name", F.lit("\n"))
    zero = F.lit(0)
    return out.unionByName(missing.select("uri", zero.alias("start"), zero.alias("stop"), line.alias("text"), F.lit("FixMissingRef").alias("action")))
