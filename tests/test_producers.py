import pytest
from pyspark.sql import functions as F

from arborq.operators import edits, producers, rules
from arborq.workspace import FILES, Workspace


def workspace(spark, files):
    return Workspace(spark, spark.createDataFrame([(u, c, "julia", 1, True) for u, c in files.items()], FILES))


@pytest.fixture()
def added():
    rules.add("no_todo", "style", strict="error", default="hint")
    rules.add("long_file", "style", default="information")

    @producers.file_check("todo", "no_todo")
    def todo(content):
        if "BOOM" in content:
            raise RuntimeError("boom")
        at = content.find("TODO")
        while at >= 0:
            yield "a TODO", at, at + 4
            at = content.find("TODO", at + 4)

    @producers.producer("long", "long_file")
    def long(w):
        rows = w.files.where("char_length(content) > 40 AND uri LIKE '%.jl'").select("uri", F.lit("long_file").alias("rule_id"), F.lit("long").alias("message"), F.lit(0).alias("start"), F.lit(0).alias("stop"))
        return rows.unionByName(rows.withColumn("rule_id", F.lit("const_decl")))  # a rule that it isn't for

    @producers.action("DropTodo", "no_todo")
    def drop(found, files):
        return found.where("message = 'a TODO'").select("uri", "start", "stop", F.lit("").alias("text"))

    yield
    del edits.ACTIONS["DropTodo"]
    for name in ("todo", "long"):
        producers.remove(name)
    for rule in ("no_todo", "long_file"):
        rules.remove(rule)


def test_added_rules_show_in_diagnostics(spark, added):
    files = {"/a.jl": "# TODO one TODO\n", "/b.jl": "# BOOM TODO\n" + "# x\n" * 20, "/strict/c.jl": "# TODO\n", "/off/d.jl": "# TODO\n", "/e.md": "TODO"}
    w = workspace(spark, files)
    w.add_files(spark.createDataFrame([("/strict/JuliaLint.toml", 'preset = "strict"'), ("/off/JuliaLint.toml", '[rules]\nno_todo = "off"\nlong_file = "error"')], "uri string, content string"))
    got = {(r["uri"], r["rule_id"], r["severity"], r["start"]) for r in w.diagnostics().where("rule_id IN ('no_todo', 'long_file', 'config_errors', 'const_decl')").collect()}
    assert got == {("/a.jl", "no_todo", "hint", 2), ("/a.jl", "no_todo", "hint", 11), ("/b.jl", "no_todo", "hint", 0), ("/b.jl", "long_file", "information", 0), ("/strict/c.jl", "no_todo", "error", 2)}
    assert w.apply_actions("DropTodo").count() == 0
    assert {r["content"] for r in w.files.where("uri IN ('/a.jl', '/strict/c.jl', '/off/d.jl')").collect()} == {"#  one \n", "# \n"}


def test_registration_is_checked(added):
    for bad in (lambda: rules.add("no_todo", "style"), lambda: rules.add("const_decl", "style"), lambda: rules.add("z", "style", strict="loud"), lambda: producers.producer("todo")(None), lambda: producers.producer("y", "nothing")(None), lambda: producers.action("DropTodo", "no_todo")(None)):
        with pytest.raises(ValueError):
            bad()
    assert "nothing" not in {r[0] for r in rules.every()}


def test_named_producers_and_none(spark):
    w = workspace(spark, {"/a.jl": "x == NaN\n"})
    assert producers.findings(w, "structure").count() == 1 and producers.findings(w, "unused").count() == 0
    assert producers.findings(w, "references").count() == 0  # withheld without an environment
