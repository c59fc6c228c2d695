"""Layered configuration: the nearest file supplies preset, rules and overrides; every file above has a say in scope."""

from __future__ import annotations

import re
import tomllib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arborq.functions import paths
from arborq.functions.globs import glob_to_regex, selected_by
from arborq.operators import relational, rules

#: Keys that a configuration file may have.
KEYS = ("version", "preset", "include", "exclude", "rules", "overrides")

PARSED = "struct<preset: string, include: array<string>, exclude: array<string>, rules: map<string,string>, overrides: array<struct<paths: array<string>, rules: map<string,string>>>, errors: array<string>>"

FOUND = pa.schema([("uri", pa.string()), ("rule_id", pa.string()), ("message", pa.string()), ("start", pa.int64()), ("stop", pa.int64())])


def _table(value, what: str, errors: list[str]) -> dict:
    if isinstance(value, dict):
        return value
    errors.append(f"{what} isn't a table")
    return {}


def _list(value, what: str, errors: list[str]) -> list:
    if isinstance(value, list):
        return value
    errors.append(f"{what} isn't a list")
    return []


def _severities(table: dict, errors: list[str], known: frozenset[str]) -> dict[str, str]:
    out = {}
    for rule, value in table.items():
        severity = value.get("severity") if isinstance(value, dict) else value
        severity = "information" if severity == "info" else severity
        if rule not in known:
            errors.append(f"unknown rule {rule}")
        elif severity is not None and (not isinstance(severity, str) or severity not in rules.SEVERITIES):
            errors.append(f"unknown severity {severity} of {rule}")
        elif severity is not None:
            out[rule] = severity
    return out


def load_toml(text: str | None) -> tuple[dict, str | None]:
    """(table, what is wrong): texts that aren't TOML, or nested too deep, are empty tables. Null counts as empty."""
    try:
        return tomllib.loads(text or ""), None
    except (tomllib.TOMLDecodeError, ValueError, OverflowError) as e:
        return {}, f"not TOML: {e}"
    except RecursionError:
        return {}, "not TOML: nested too deep"


def known_rules() -> frozenset[str]:
    return frozenset(r[0] for r in rules.every())


def parse_config(text: str | None, known: frozenset[str] | None = None) -> dict:
    """A configuration file as PARSED; what is wrong with it is listed, not raised, and counts as left out. known: the rules that there are."""
    known = known_rules() if known is None else known
    table, problem = load_toml(text)
    errors = [problem] if problem else []
    errors += [f"unknown key {k}" for k in table if k not in KEYS]
    preset = table.get("preset", "default")
    if not isinstance(preset, str) or preset not in rules.PRESETS:
        errors.append(f"unknown preset {preset}")
        preset = "default"

    def regexes(table: dict, key: str) -> list[str]:
        out = []
        for p in _list(table.get(key, []), key, errors):
            try:
                out.append(glob_to_regex(p))
            except (ValueError, TypeError, AttributeError):
                errors.append(f"bad pattern {p!r}")
        return out

    def severities(table: dict) -> dict[str, str]:
        return _severities(_table(table.get("rules", {}), "rules", errors), errors, known)

    own = [_table(o, "an override", errors) for o in _list(table.get("overrides", []), "overrides", errors)]
    overrides = [{"paths": regexes(o, "paths"), "rules": severities(o)} for o in own]
    return {"preset": preset, "include": regexes(table, "include"), "exclude": regexes(table, "exclude"), "rules": severities(table), "overrides": overrides, "errors": errors}


def parsed(content: Column) -> Column:
    known = known_rules()  # told to the workers, which don't know what the session has added
    return F.udf(lambda text: parse_config(text, known), PARSED, useArrow=False)(content)


def configs(files: DataFrame, name: str) -> DataFrame:
    """(config, dir, parsed fields) of the files (uri, content) of a name, case aside."""
    own = files.where(F.lower(paths.basename(F.col("uri"))) == name.lower())
    return own.select(F.col("uri").alias("config"), paths.dirname(F.col("uri")).alias("dir"), parsed(F.col("content")).alias("c")).select("config", "dir", "c.*")


def toml_problem(text: str | None) -> tuple[str, int, int] | None:
    """(message, start, stop) of what keeps a text from being TOML; null counts as empty. Without a place it is about the whole text."""
    text = text or ""
    try:
        tomllib.loads(text)
    except tomllib.TOMLDecodeError as e:
        place = re.search(r" \(at line (\d+), column (\d+)\)$", str(e))
        if place is None:
            return re.sub(r" \(at end of document\)$", "", str(e)), len(text), len(text)
        lines = text.split("\n")
        line, column = int(place[1]), int(place[2])
        start = sum(len(x) + 1 for x in lines[: line - 1]) + column - 1
        return str(e)[: place.start()], start, min(start + 1, len(text))
    except RecursionError:
        return "nested too deep", 0, len(text)
    except (ValueError, OverflowError) as e:  # numbers and dates that Python can't hold
        return str(e), 0, len(text)
    return None


def toml_findings(files: DataFrame) -> DataFrame:
    """(uri, rule_id, message, start, stop): files (uri, content) that aren't TOML, an Arrow batch at a time. start is where the first problem is, in characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(u, "toml_syntax_errors", *p) for u, t in zip(batch.column("uri").to_pylist(), batch.column("content").to_pylist(), strict=True) if (p := toml_problem(t))]
            yield pa.RecordBatch.from_pylist([dict(zip(FOUND.names, x, strict=True)) for x in found], schema=FOUND)

    return files.select("uri", "content").mapInArrow(run, "uri string, rule_id string, message string, start long, stop long")


def below(path: str, folder: str):
    """A path relative to a folder above it."""
    return F.substring(F.col(path), F.char_length(folder) + 2, F.lit(1 << 20))


def scoped(files: DataFrame, found: DataFrame) -> DataFrame:
    """files (uri) with in_scope: all configs above admit the path below their folder."""
    rel = below("uri", "dir")
    admits = selected_by(rel, F.col("include"), F.col("exclude"))
    return relational.in_scope(files, found.select("dir", "include", "exclude"), "uri", "dir", admits)


def scoped_above(every: DataFrame, found: DataFrame) -> DataFrame:
    """every configuration file (config) with by_others: whether all of found in folders strictly above its own admit it."""
    up = every.select("config").distinct().withColumn("dir", F.explode(paths.folders(paths.dirname(F.col("config")))))
    admits = selected_by(below("config", "dir"), F.col("include"), F.col("exclude"))
    against = up.join(found.select("dir", "include", "exclude"), "dir").where(~admits).select("config").distinct().withColumn("by_others", F.lit(False))
    return every.select("config").distinct().join(against, "config", "left").select("config", F.coalesce("by_others", F.lit(True)).alias("by_others"))


def effective(files: DataFrame, found: DataFrame) -> DataFrame:
    """(uri, rule_id, severity) for every file and rule: preset of the nearest config (default, where there is none), its rules over that, and its matching overrides over those in file order."""
    spark = files.sparkSession
    near = relational.deepest_match(files.select("uri"), found, "uri", "dir").join(found, "dir", "left")
    presets = near.select("uri", F.coalesce("preset", F.lit("default")).alias("preset")).join(F.broadcast(rules.preset_rows(spark)), "preset").select("uri", "rule_id", "severity")
    own = near.select("uri", F.explode("rules").alias("rule_id", "severity"))
    rel = below("uri", "dir")
    over = near.withColumn("rel", rel).select("uri", "rel", F.posexplode("overrides").alias("at", "o")).where(F.exists("o.paths", lambda r: F.rlike("rel", r)))
    over = over.select("uri", "at", F.explode("o.rules").alias("rule_id", "severity"))
    none = F.lit(-1).alias("at")
    return relational.layered([presets.withColumn("at", none), own.withColumn("at", none), over], ["uri", "rule_id"], "severity", ["at"])


def shadowed(found: DataFrame) -> DataFrame:
    """(config, by): each config with the nearest one strictly above it."""
    up = found.select("config", "dir").withColumn("above", F.explode(paths.folders(F.col("dir"))))
    other = found.select(F.col("dir").alias("above"), F.col("config").alias("by"))
    return up.join(other, "above").groupBy("config").agg(F.max_by("by", F.char_length("above")).alias("by"))
