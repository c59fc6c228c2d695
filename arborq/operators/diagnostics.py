"""From findings to diagnostics: severities, scope, and a row for each file."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def diagnostics(findings: DataFrame, effective: DataFrame, scope: DataFrame, ready: DataFrame | None = None, rules: DataFrame | None = None) -> DataFrame:
    """findings (uri, rule_id, ...) with severity: those off, out of scope, or of rules that wait for the environment of a file that isn't ready are left out."""
    out = findings.join(effective.where("severity <> 'off'"), ["uri", "rule_id"])
    out = out.join(scope.where("in_scope").select("uri"), "uri", "left_semi")
    if ready is not None and rules is not None:
        waits = rules.where("env_dependent").select("rule_id", F.lit(True).alias("waits"))
        out = out.join(F.broadcast(waits), "rule_id", "left").join(ready.select("uri", "ready"), "uri", "left")
        out = out.where(F.col("waits").isNull() | F.coalesce("ready", F.lit(True))).drop("waits", "ready")
    return out


def per_file(files: DataFrame, found: DataFrame) -> DataFrame:
    """(uri, n): files without diagnostics keep a row, with 0."""
    counts = found.groupBy("uri").agg(F.count("*").alias("n"))
    return files.select("uri").join(counts, "uri", "left").select("uri", F.coalesce("n", F.lit(0)).alias("n"))
