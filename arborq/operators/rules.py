"""The rules that findings are of, and the severities that presets give them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rule, tier, severity under the presets minimal, default and strict, and whether it depends on the environment.
RULES = [
    ("incorrect_call_args", "semantic", "off", "information", "warning", True),
    ("incorrect_iter_spec", "semantic", "off", "information", "warning", True),
    ("index_from_length", "semantic", "off", "information", "warning", False),
    ("nothing_comparison", "semantic", "off", "information", "warning", True),
    ("const_if_condition", "semantic", "off", "information", "warning", False),
    ("pointless_boolean", "semantic", "off", "information", "warning", False),
    ("invalid_type_declaration", "semantic", "off", "information", "warning", True),
    ("unused_type_parameter", "semantic", "off", "hint", "warning", False),
    ("module_name", "semantic", "off", "information", "warning", False),
    ("type_piracy", "semantic", "off", "information", "warning", True),
    ("unused_function_argument", "semantic", "off", "hint", "warning", False),
    ("duplicate_function_argument", "semantic", "off", "information", "warning", False),
    ("kw_default_mismatch", "semantic", "off", "information", "warning", True),
    ("literal_use", "semantic", "off", "information", "warning", False),
    ("break_continue", "semantic", "off", "information", "warning", False),
    ("global_const_decl", "semantic", "off", "information", "warning", False),
    ("unused_binding", "semantic", "off", "hint", "warning", False),
    ("const_decl", "semantic", "warning", "information", "warning", False),
    ("relative_import", "semantic", "off", "information", "warning", False),
    ("include_errors", "workspace", "warning", "warning", "warning", False),
    ("missing_reference", "semantic", "off", "warning", "warning", True),
    ("unresolved_import", "semantic", "off", "warning", "warning", True),
    ("nan_comparison", "syntax", "off", "off", "warning", False),
    ("duplicate_branch_condition", "syntax", "off", "off", "warning", False),
    ("string_concat_style", "syntax", "off", "off", "warning", False),
    ("bare_using", "syntax", "off", "off", "warning", False),
    ("debug_statement", "syntax", "off", "off", "warning", False),
    ("async_task", "syntax", "off", "off", "warning", False),
    ("syntax_errors", "syntax", "error", "error", "error", False),
    ("syntax_warnings", "syntax", "off", "off", "warning", False),
    ("testitem_errors", "syntax", "error", "error", "error", False),
    ("toml_syntax_errors", "project", "error", "error", "error", False),
    ("config_errors", "project", "error", "error", "error", False),
    ("shadowed_config", "workspace", "information", "information", "warning", False),
    ("environment_errors", "project", "off", "information", "warning", False),
]
#: Rules that a session has added, by id.
_ADDED: dict[str, tuple] = {}
PRESETS = ("minimal", "default", "strict")
SEVERITIES = ("off", "hint", "information", "warning", "error")


def add(rule_id: str, tier: str, minimal: str = "off", default: str = "off", strict: str = "warning", env_dependent: bool = False) -> None:
    """Adds a rule, which configurations may then name. ValueError if there is one of that id, or a severity is none."""
    if rule_id in _ADDED or rule_id in {r[0] for r in RULES}:
        raise ValueError(f"there is a rule {rule_id} already")
    if {minimal, default, strict} - set(SEVERITIES):
        raise ValueError(f"severities are {', '.join(SEVERITIES)}")
    _ADDED[rule_id] = (rule_id, tier, minimal, default, strict, env_dependent)


def remove(rule_id: str) -> None:
    """Takes back what `add` has added."""
    del _ADDED[rule_id]


def every() -> list[tuple]:
    return [*RULES, *_ADDED.values()]


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(every(), "rule_id string, tier string, severity_minimal string, severity_default string, severity_strict string, env_dependent boolean")


def preset_rows(spark: SparkSession) -> DataFrame:
    """(preset, rule_id, severity)."""
    return rules(spark).unpivot("rule_id", [f"severity_{p}" for p in PRESETS], "preset", "severity").withColumn("preset", F.replace("preset", F.lit("severity_"), F.lit("")))


def severity_of(name: Column) -> Column:
    """A severity as configured, null if it is none of them; `info` stands for information."""
    name = F.when(name == "info", "information").otherwise(name)
    return F.when(name.isin(*SEVERITIES), name)
