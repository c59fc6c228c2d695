"""Producers of findings, by name: what a workspace is checked for.

A producer is a function from a workspace to rows (uri, rule_id, message, start, stop) of the rules that it says it is
for, lazy like all else, so that a workspace's findings are one plan. Sessions add their own with `producer`, or with
`file_check` for what looks at one file at a time, and the rules' severities with `rules.add`; `action` adds the edits
that answer a rule.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import TYPE_CHECKING

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborq.operators import analysis, config, edits, graph, resolve, rules

if TYPE_CHECKING:
    from arborq.workspace import Workspace

FINDING = "uri string, rule_id string, message string, start int, stop int"


@dataclass(frozen=True)
class Producer:
    rules: tuple[str, ...]
    environment: bool  #: whether it is withheld until the workspace is told its environment
    run: Callable[[Workspace], DataFrame]


PRODUCERS: dict[str, Producer] = {}


def producer(name: str, *rule_ids: str, environment: bool = False):
    """Adds a function from a workspace to findings under a name. ValueError if the name is taken, or a rule isn't there."""

    def put(run: Callable[[Workspace], DataFrame]) -> Callable[[Workspace], DataFrame]:
        if name in PRODUCERS:
            raise ValueError(f"there is a producer {name} already")
        if unknown := set(rule_ids) - {r[0] for r in rules.every()}:
            raise ValueError(f"no rules: {', '.join(sorted(unknown))}")
        PRODUCERS[name] = Producer(rule_ids, environment, run)
        return run

    return put


def file_check(name: str, rule_id: str, kind: str = ".jl"):
    """Adds a function from a file's content to (message, start, stop), run on files with that ending, an Arrow batch at a time. A null content is empty; what it raises is a finding at the file's beginning."""

    def put(check: Callable[[str], Iterable[tuple[str, int, int]]]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = []
                for uri, content in zip(batch.column("uri").to_pylist(), batch.column("content").to_pylist(), strict=True):
                    try:
                        rows += [(uri, rule_id, m, a, b) for m, a, b in check(content or "")]
                    except Exception as e:  # noqa: BLE001  a check that fails on one file stops no other
                        rows.append((uri, rule_id, f"the check failed: {type(e).__name__}: {e}", 0, 0))
                columns = list(zip(*rows, strict=True)) or [[]] * 5
                types = [pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[x.split()[0] for x in FINDING.split(", ")])

        producer(name, rule_id)(lambda w: w.files.where(F.lower("uri").endswith(kind)).select("uri", "content").mapInArrow(run, FINDING))
        return check

    return put


def remove(name: str) -> None:
    del PRODUCERS[name]


def findings(w: Workspace, *names: str) -> DataFrame:
    """Findings of the producers named, or of all that the workspace can answer. Rows of rules that a producer isn't for are left out."""
    out = None
    for name, p in PRODUCERS.items():
        if names and name not in names or p.environment and w.environment is None:
            continue
        own = p.run(w).select("uri", "rule_id", "message", F.col("start").cast("int").alias("start"), F.col("stop").cast("int").alias("stop"))
        own = own.where(F.col("rule_id").isin(*p.rules)) if p.rules else own
        out = own if out is None else out.unionByName(own)
    return w.spark.createDataFrame([], FINDING) if out is None else out


def action(name: str, rule_id: str):
    """Adds a function from the findings of a rule and the files to edits (uri, start, stop, text)."""

    def put(run: Callable[[DataFrame, DataFrame], DataFrame]):
        if name in edits.ACTIONS:
            raise ValueError(f"there is an action {name} already")
        edits.ACTIONS[name] = (rule_id, run)
        return run

    return put


# --- what every workspace is checked for


def _at(df: DataFrame, rule_id: str, message, uri: str = "uri", start: str | None = None) -> DataFrame:
    place = F.lit(0) if start is None else F.col(start)
    return df.select(F.col(uri).alias("uri"), F.lit(rule_id).alias("rule_id"), message.alias("message"), place.alias("start"), place.alias("stop"))


@producer("structure")
def _structure(w: Workspace) -> DataFrame:
    return w.table("findings").select("uri", "rule_id", "message", "start", "stop")


@producer("labels", "testitem_errors")
def _labels(w: Workspace) -> DataFrame:
    return _at(analysis.test_ids(w.facts).where("duplicate"), "testitem_errors", F.concat(F.lit("the label is there twice: "), "label"), start="start")


@producer("includes", "include_errors")
def _includes(w: Workspace) -> DataFrame:
    wrong = graph.include_findings(w.include_records(), w.nodes(), w.roots()).join(w.table("includes").select(F.col("uri").alias("src"), "ordinal", "start"), ["src", "ordinal"])
    return _at(wrong, "include_errors", F.concat_ws(" ", "code", "target"), "src", "start")


@producer("configurations", "config_errors", "shadowed_config")
def _configurations(w: Workspace) -> DataFrame:
    found = w.lint_configs()
    errors = found.select("config", F.explode("errors").alias("message"))
    return _at(errors, "config_errors", F.col("message"), "config").unionByName(_at(config.shadowed(found), "shadowed_config", F.col("by"), "config"))


@producer("toml", "toml_syntax_errors")
def _toml(w: Workspace) -> DataFrame:
    return config.toml_findings(w.toml_files())


@producer("unused", "unused_binding", "unused_function_argument", "unused_type_parameter")
def _unused(w: Workspace) -> DataFrame:
    return resolve.unused(w.facts)


@producer("redeclared", "const_decl")
def _redeclared(w: Workspace) -> DataFrame:
    return resolve.redeclared(w.facts)


@producer("calls", "incorrect_call_args")
def _calls(w: Workspace) -> DataFrame:
    return resolve.unfit_calls(w.facts, w.known)


def _packages(w: Workspace) -> DataFrame:
    return w.environment.select(F.col("package").alias("name")).distinct().unionByName(w.workspace_packages()).distinct()


@producer("references", "missing_reference", environment=True)
def _references(w: Workspace) -> DataFrame:
    spliced = analysis.splices(w.facts)
    return resolve.missing_references(w.facts, spliced, analysis.declarations(w.facts, spliced), w.environment.select("name").distinct(), _packages(w))


@producer("imports", "unresolved_import", environment=True)
def _imports(w: Workspace) -> DataFrame:
    return resolve.unresolved_imports(w.facts, analysis.splices(w.facts), _packages(w))
