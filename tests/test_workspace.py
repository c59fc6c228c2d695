import json
import os

import pytest
from pyspark.sql import functions as F

from arborq.operators import analysis, config, diagnostics, projects, rules
from arborq.parser.parser import parse
from arborq.sources import caches, folders
from arborq.streaming import changes, state
from arborq.workspace import Workspace


def files(spark, content):
    return spark.createDataFrame(list(content.items()), "uri string, content string")


def test_config_layers(spark):
    ws = files(
        spark,
        {
            "/JULIALINT.toml": 'preset = "strict"\nexclude = ["gen/"]\n[rules]\nasync_task = "hint"\n',
            "/p/JuliaLint.toml": 'include = ["src/"]\n[rules]\nbare_using = { severity = "info" }\n[[overrides]]\npaths = ["src/x*"]\n[overrides.rules]\nbare_using = "off"\n[[overrides]]\npaths = ["src/xy.jl"]\n[overrides.rules]\nbare_using = "error"\n',
            "/a.jl": "", "/gen/b.jl": "", "/p/src/xa.jl": "", "/p/src/xy.jl": "", "/p/src/c.jl": "", "/p/test.jl": "",
        },
    )
    found = config.configs(ws, "JuliaLint.toml")
    assert {r["dir"]: r["preset"] for r in found.collect()} == {"": "strict", "/p": "default"}
    code = ws.where("uri like '%.jl'")
    scope = {r["uri"]: r["in_scope"] for r in config.scoped(code.select("uri"), found).collect()}
    assert scope == {"/a.jl": True, "/gen/b.jl": False, "/p/src/xa.jl": True, "/p/src/xy.jl": True, "/p/src/c.jl": True, "/p/test.jl": False}
    got = {(r["uri"], r["rule_id"]): r["severity"] for r in config.effective(code, found).collect()}
    assert len(got) == 6 * len(rules.RULES)
    assert got["/a.jl", "async_task"] == "hint" and got["/a.jl", "bare_using"] == "warning"
    assert [got[f"/p/src/{x}.jl", "bare_using"] for x in ("c", "xa", "xy")] == ["information", "off", "error"]
    assert got["/p/src/c.jl", "async_task"] == "off"  # nothing merges across files
    assert {r["config"]: r["by"] for r in config.shadowed(found).collect()} == {"/p/JuliaLint.toml": "/JULIALINT.toml"}


def test_config_errors():
    got = config.parse_config('presett = 1\npreset = "loud"\ninclude = [1]\n[rules]\nnosuch = "off"\nasync_task = "loud"\n')
    assert len(got["errors"]) == 5 and got["preset"] == "default"
    assert config.parse_config("= 1")["errors"][0].startswith("not TOML")
    assert config.parse_config(None)["errors"] == []


def test_presets_cover_every_rule(spark):
    assert rules.preset_rows(spark).count() == 3 * len(rules.RULES) == 105
    assert {r["severity"] for r in rules.preset_rows(spark).collect()} <= set(rules.SEVERITIES)
    got = spark.createDataFrame([("info",), ("error",), ("loud",)], "s string").select(rules.severity_of(F.col("s")).alias("s")).collect()
    assert [r["s"] for r in got] == ["information", "error", None]


def test_diagnostics_wait_for_the_environment(spark):
    found = spark.createDataFrame([("a", "missing_reference"), ("a", "bare_using"), ("b", "missing_reference")], "uri string, rule_id string")
    eff = spark.createDataFrame([(u, r, "warning") for u in "ab" for r in ("missing_reference", "bare_using")], "uri string, rule_id string, severity string")
    scope = spark.createDataFrame([("a", True), ("b", True)], "uri string, in_scope boolean")
    ready = spark.createDataFrame([("a", False), ("b", True)], "uri string, ready boolean")
    got = diagnostics.diagnostics(found, eff, scope, ready, rules.rules(spark))
    assert {(r["uri"], r["rule_id"]) for r in got.collect()} == {("a", "bare_using"), ("b", "missing_reference")}


def test_projects(spark):
    package = 'name = "P"\nuuid = "7876af07-990d-54b4-ab0e-23690620f79a"\nversion = "0.1.0"\n'
    ws = files(spark, {"/p/Project.toml": package, "/p/JuliaProject.toml": package, "/p/Manifest.toml": "", "/q/Project.toml": 'name = "Q"', "/r/Project.toml": "[deps]", "/r/Manifest-v1.11.toml": "", "/r/Manifest.toml": ""})
    found = projects.folders(ws, "1.11").join(ws.select(F.col("uri").alias("project"), "content"), "project")
    got = {r["folder"]: r for r in projects.classified(found, projects.project_fields(F.col("content"))).collect()}
    assert {f: (r["is_package"], r["is_project"], r["is_env"]) for f, r in got.items()} == {"/p": (True, True, False), "/q": (False, False, True), "/r": (False, True, False)}
    assert got["/p"]["project"] == "/p/JuliaProject.toml" and got["/r"]["manifest"] == "/r/Manifest-v1.11.toml"


def test_manifests():
    text = 'manifest_format = "2.0"\n[[deps.A]]\nuuid = "u1"\npath = "../A"\n[[deps.B]]\nuuid = "u2"\ngit-tree-sha1 = "s"\nversion = "1.2.3"\n[[deps.C]]\nuuid = "u3"\n[[deps.D]]\nuuid = "1"\n[[deps.D]]\nuuid = "2"\n'
    assert [(e["name"], e["kind"]) for e in projects.manifest_entries(text)] == [("A", "dev"), ("B", "registered"), ("C", "stdlib")]
    assert projects.manifest_entries('manifest_format = "3.0"') is None
    assert [e["kind"] for e in projects.manifest_entries('[[A]]\nuuid = "u"\n')] == ["stdlib"]
    assert projects.manifest_entries('[[A]]\npath = "x"\n[[B]]\nuuid = "u"\n') == projects.manifest_entries('[[B]]\nuuid = "u"\n')


def test_readiness(spark):
    cols = "uri string, override boolean, project_required boolean, project_settled boolean, env_pending boolean, needs_test_env boolean, test_env_pending boolean"
    rows = [("a", True, True, False, True, True, True), ("b", None, None, None, None, None, None), ("c", None, True, False, None, None, None), ("d", None, True, True, None, None, None), ("e", None, None, None, True, None, None), ("f", None, None, None, None, True, True), ("g", None, None, None, None, False, True)]
    got = {r["uri"]: r["ready"] for r in projects.env_ready(spark.createDataFrame(rows, cols)).collect()}
    assert got == {"a": True, "b": True, "c": False, "d": True, "e": False, "f": False, "g": True}


SOURCE = """
module A
using B, C.D
using E: x, y as z
import ..F
export f, @m
function f(a, b::Int=2; k=1, kw...) where T
    for i in 1:10
        if a == NaN || true
            break
        elseif b == nothing
            x = [e for e in y if e > 1]
        elseif b == nothing
        end
    end
    map(a) do q
        q[end] * "s$(g("x"))"
    end
    include("inner.jl")
end
g(x, xs...) = x + 1
Base.show(io::IO, s::S) = print(io, s)
const K = 3
mutable struct S{T} <: Q
    a::Int
end
include("a.jl")
if isfile("b.jl")
    include("b.jl")
end
include(joinpath(@__DIR__, "sub", "c.jl"))
include(p)
@testitem "one" tags=[:a] begin
    include("t.jl")
    @show f(1, 2; k=3)
end
break
end
"""


def test_parser():
    f = parse(SOURCE)
    assert [(x[1], x[2], x[3], x[5], x[6]) for x in f.items] == [("A", [], "module", None, None), ("f", [], "function", 1, 2), ("g", [], "function", 1, 2**31 - 1), ("show", ["Base"], "function", 2, 2), ("K", [], "const", None, None), ("S", [], "mutable_struct", None, None)]
    assert f.items[1][7:9] == (["k"], True)
    assert [(x[1], x[2], x[3], x[4]) for x in f.imports] == [("using", 0, ["B"], []), ("using", 0, ["C", "D"], []), ("using", 0, ["E"], ["x", "y"]), ("import", 2, ["F"], [])]
    assert [(x[1], x[2], x[3] is not None) for x in f.includes] == [(None, False, False), ("a.jl", False, False), ("b.jl", True, False), ("sub/c.jl", False, False), (None, False, False), ("t.jl", False, True)]
    assert [x[0] for x in f.findings] == ["bare_using", "nan_comparison", "nothing_comparison", "nothing_comparison", "duplicate_branch_condition", "string_concat_style", "debug_statement", "break_continue"]
    assert ("f", 2, 2, ["k"]) in [x[:4] for x in f.calls]


@pytest.mark.parametrize("text", ["function f(", "end", '"abc', "f(]", "#= x", "if true", "module A\nfunction f()\nend"])
def test_syntax_errors_are_findings(text):
    assert parse(text).findings[-1][0] == "syntax_errors"


@pytest.mark.parametrize("text", [None, "", "x = a'\ny = 'c'", 'r"\\\\"', "a = [1 2\n3 4][end]", "f() = begin 1 end", "x -> x + 1", "@. a + b", "quote\n x\nend", "1:end_", "let x = 1; x end", "é = √2 ∈ y"])
def test_no_false_errors(text):
    assert not [x for x in parse(text).findings if x[0] == "syntax_errors"]


def test_analysis(spark):
    ws = files(spark, {"/p/src/P.jl": 'module P\ninclude("a.jl")\nmodule Q\ninclude("b/c.jl")\nend\nend', "/p/src/a.jl": "f(x) = 1", "/p/src/b/c.jl": 'g() = 2\ninclude("../a.jl")', "/p/x.jl": None})
    found = analysis.facts(ws)
    records = analysis.include_records(found)
    assert {(r["src"], r["target"]) for r in records.collect()} == {("/p/src/P.jl", "/p/src/a.jl"), ("/p/src/P.jl", "/p/src/b/c.jl"), ("/p/src/b/c.jl", "/p/src/a.jl")}
    root = spark.createDataFrame([("/p/src/P.jl",)], "node string")
    spliced = analysis.module_files(records, ws, root)
    assert {r["file"]: r["path"] for r in spliced.collect()} == {"/p/src/P.jl": [], "/p/src/a.jl": ["P"], "/p/src/b/c.jl": ["P", "Q"]}
    got = {(".".join(r["path"]), r["name"]) for r in analysis.declarations(found, spliced).collect()}
    assert got == {("", "P"), ("P", "Q"), ("P", "f"), ("P.Q", "g")}
    at = spark.createDataFrame([("/p/src/P.jl", 40), ("/p/src/P.jl", 12), ("/p/src/a.jl", 1)], "uri string, offset int")
    assert {(r["uri"][-4:], r["offset"]): r["module"] for r in analysis.module_at(found, at).collect()} == {("P.jl", 40): "P.Q", ("P.jl", 12): "P", ("a.jl", 1): ""}
    assert {r["name"] for r in analysis.workspace_symbols(found, "f").collect()} == {"f"}


def test_body_edits_leave_the_inventory_as_it_is(spark):
    h = lambda t: analysis.inventory_hash(analysis.facts(files(spark, {"a": t}))).collect()[0]["hash"]
    assert h("f(x) = 1") == h("# note\n\nf(x) = 2 + g(3)") != h("f(x, y) = 1")


def test_folder_scan(spark, tmp_path):
    for name, data in {"a.jl": b"x = 1", "sub/b.md": b"# t", ".git/c.jl": b"no", "node_modules/d/e.jl": b"no", "f.bin": b"\0", "bad.jl": b"\xff\xfe", "Project.toml": b""}.items():
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)
    got = {r["path"].rpartition("/")[2]: (r["content"], r["language_id"]) for r in folders.scan(spark, str(tmp_path)).collect()}
    assert got == {"a.jl": ("x = 1", "julia"), "b.md": ("# t", "markdown"), "bad.jl": (None, "julia"), "Project.toml": ("", "toml")}
    with pytest.raises(folders.TooManyFiles):
        folders.scan(spark, str(tmp_path), max_julia_files=1)
    with pytest.raises(Exception, match="UTF-8"):
        folders.scan(spark, str(tmp_path), lenient=False).collect()
    assert folders.read_one(spark, str(tmp_path / "a.jl")).collect()[0]["content"] == "x = 1"


def test_indirect_files(spark):
    disc = {"/b": "/c", "/c": "/a"}
    start = spark.createDataFrame([("/a", "/b", True)], "path string, content string, is_regular boolean")
    load = lambda wanted: spark.createDataFrame([(p, disc[p]) for p in wanted if p in disc], "path string, content string")
    got = folders.with_indirect(start, lambda df: df.select(F.col("content").alias("path")), load)
    assert {r["path"]: r["is_regular"] for r in got.collect()} == {"/a": True, "/b": False, "/c": False}


def test_caches(spark, tmp_path):
    schema = "symbol string, name string, uuid string, version string, tree_sha string"
    caches.write_symbols(spark.createDataFrame([("f", "A", "u", "1", "s"), ("g", "B", "v", "1", "t")], schema), str(tmp_path / "c"))
    caches.write_symbols(spark.createDataFrame([("h", "A", "u", "1", "s")], schema), str(tmp_path / "c"))
    got = caches.read_symbols(spark, str(tmp_path / "c"), schema)
    assert {r["symbol"] for r in got.collect()} == {"h", "g"}
    wanted = spark.createDataFrame([("A", "u", "1", "s"), ("C", "w", "1", "x"), ("D", "y", "1", "z")], caches.KEY)
    dead = spark.createDataFrame([("C", "w", "1", "x", 10)], [*caches.KEY, "until"])
    assert [r["name"] for r in caches.to_index(wanted, got, dead, 5).collect()] == ["D"]
    assert {r["name"] for r in caches.to_index(wanted, got, dead, 20).collect()} == {"C", "D"}
    caches.write_index(got, str(tmp_path / "i"))
    assert [r["name"] for r in caches.available(wanted, spark, str(tmp_path / "i")).collect()] == ["A"]
    caches.write_results(wanted.limit(1), str(tmp_path / "r"))
    (line,) = [x for p in (tmp_path / "r").glob("part*") for x in p.read_text().splitlines()]
    assert json.loads(line)["uuid"]
    packages = spark.createDataFrame([("A", "u", '["1.2.0"]\ngit-tree-sha1 = "s"\n["1.3.0+1"]\ngit-tree-sha1 = "t"\nyanked = true\n')], "name string, uuid string, text string")
    assert [(r["major"], r["minor"], r["yanked"]) for r in caches.registry(packages, F.col("text")).orderBy("minor").collect()] == [(1, 2, False), (1, 3, True)]


def test_change_feed(spark, tmp_path):
    path = tmp_path / "in"
    path.mkdir()
    held = {"df": spark.createDataFrame([("a", "1"), ("b", "1")], "uri string, content string")}
    stream = spark.readStream.schema(changes.CHANGES).option("maxFilesPerTrigger", 1).json(str(path))
    for i, rows in enumerate([[(1, "update", "a", "2"), (2, "add", "c", "1"), (3, "update", "a", "3")], [(4, "remove", "b", None), (5, "remove", "c", None), (6, "add", "c", "9")]]):
        (path / f"{i}.json").write_text("\n".join(json.dumps(dict(zip(("seq", "op", "uri", "content"), r, strict=True))) for r in rows))

    def write(df, number):
        held["df"] = spark.createDataFrame(df.collect(), "uri string, content string")

    os.utime(path / "0.json", (1, 1))
    q = changes.follow(stream, lambda: held["df"], write, str(tmp_path / "cp"))
    q.processAllAvailable()
    q.stop()
    assert {r["uri"]: r["content"] for r in held["df"].collect()} == {"a": "3", "c": "9"}


def test_change_errors(spark):
    now = spark.createDataFrame([("a", "1")], "uri string, content string")
    rows = [(1, "add", "a", "x"), (2, "update", "b", "x"), (3, "add", "c", "x"), (4, "update", "c", "y"), (5, "remove", "c", None), (6, "remove", "c", None), (7, "add", "c", None)]
    assert {r["seq"] for r in changes.errors(now, spark.createDataFrame(rows, changes.CHANGES)).collect()} == {1, 2, 6}


def test_errors_of_a_feed_in_order(spark):
    """Against a fold over the changes, one after another."""
    import random

    r = random.Random(3)
    for _ in range(4):
        there = {u for u in "abcd" if r.random() < 0.5}
        rows = [(i, r.choice(["add", "update", "remove"]), r.choice("abcdef"), f"text {i}") for i in range(60)]
        files = {u: ("old", 5) for u in there}
        wrong = set()
        for seq, op, uri, content in rows:
            if (op == "add") == (uri in files):
                wrong.add(seq)
            elif op == "remove":
                del files[uri]
            else:
                files[uri] = (content, files[uri][1] + 1 if op == "update" else 1)
        w = Workspace(spark, spark.createDataFrame([(u, "old", "julia", 5, u != "a") for u in there], "uri string, content string, language_id string, revision long, is_regular boolean"))
        got = w.apply(spark.createDataFrame(rows, changes.CHANGES))
        assert {x["seq"] for x in got.collect()} == wrong
        assert {x["uri"]: (x["content"], x["revision"]) for x in w.files.collect()} == files


def test_a_feed_keeps_what_is_known_of_files(spark):
    w = Workspace(spark)
    w.add_file("untitled:1", "f()", "julia")
    w.add_file("/s/a.jl", "x = 1")
    w.set_indirect(spark.createDataFrame([("/o/z.jl", "1"), ("/o/y.jl", "1")], "uri string, content string"))
    rows = [(1, "update", "untitled:1", "g()"), (2, "update", "/s/b.jl", "not there"), (3, "add", "/s/b.jl", "y"), (4, "update", "untitled:1", "h()"), (5, "update", "/o/z.jl", "2"), (6, "remove", "/s/a.jl", None), (7, "add", "/s/a.jl", "z")]
    assert {r["seq"] for r in w.apply(spark.createDataFrame(rows, changes.CHANGES)).collect()} == {2}
    got = {r["uri"]: (r["content"], r["language_id"], r["revision"], r["is_regular"]) for r in w.files.collect()}
    assert got == {"untitled:1": ("h()", "julia", 3, True), "/s/a.jl": ("z", "julia", 1, True), "/s/b.jl": ("y", "julia", 1, True), "/o/z.jl": ("2", "julia", 2, False), "/o/y.jl": ("1", "julia", 1, False)}


def test_which_excluded_configs_report(spark):
    """One that leaves itself out does, one that another above leaves out doesn't."""
    bad = "nosuch = 1\n"
    w = Workspace(spark)
    w.add_files(files(spark, {"/p/JuliaLint.toml": bad + 'exclude = ["**"]', "/q/JuliaLint.toml": 'exclude = ["vendor/"]', "/q/vendor/x/JuliaLint.toml": bad, "/q/own/JuliaLint.toml": bad, "/q/vendor/a.jl": "x == NaN"}))
    got = {(r["uri"], r["rule_id"]) for r in w.diagnostics().select("uri", "rule_id").collect()}
    assert got >= {("/p/JuliaLint.toml", "config_errors"), ("/q/own/JuliaLint.toml", "config_errors")}
    assert not any(u.startswith("/q/vendor") for u, _ in got)


@pytest.mark.parametrize(
    "text, want",
    [
        ('isfile("a.jl") && include("a.jl")', [("a.jl", True)]), ('@isdefined(X) || include("a.jl")', [("a.jl", True)]), ('(isfile(x)) && (y; include("a.jl"))', [("a.jl", True)]), ('isfile(x) ? include("a.jl") : include("b.jl")', [("a.jl", True), ("b.jl", True)]),
        ('isfile(x) && y\ninclude("a.jl")', [("a.jl", False)]), ('f(isfile(x), y && include("a.jl"))', [("a.jl", False)]), ('x && include("a.jl")', [("a.jl", False)]),
        ('if isfile(x)\n include("a.jl")\nelse\n include("b.jl")\nend\ninclude("c.jl")', [("a.jl", True), ("b.jl", True), ("c.jl", False)]), ('if x\n include("a.jl")\nelseif ispath(y)\n include("b.jl")\nelse\n include("c.jl")\nend', [("a.jl", False), ("b.jl", True), ("c.jl", True)]),
        ('f() = include("a.jl")', [(None, False)]), ('function f()\n include("a.jl")\nend', [(None, False)]), ("include(p::T) = 1", []), ("include(p::T)::Int = 1\ninclude(f, x) = 2", []), ("function include(p)\n 1\nend", []), ('include(mapexpr, "a.jl")', []), ("include(x)", [(None, False)]),
    ],
)
def test_includes(text, want):
    assert [(x[1], x[2]) for x in parse(text).includes] == want


def test_which_test_bodies_are_modules():
    f = parse('@testset "s" begin\n include("a.jl")\nend\n@testitem "t" begin\n include("b.jl")\n @testitem "u" begin\n  include("c.jl")\n end\nend\ninclude("d.jl")')
    bodies = [x[3] for x in f.includes]
    assert bodies[0] is None and bodies[1] is not None and bodies[2] == bodies[1] and bodies[3] is None


def test_broken_code_is_a_finding_and_no_error():
    import random

    from arborq.parser import parser
    from arborq.parser.lexer import SyntaxProblem

    r = random.Random(1)
    words = 'try local const global function end macro module struct mutable abstract primitive type if elseif else for while let do begin quote catch finally import using export public return where in a b f include ( ) [ ] { } , ; . :: = == && || ? : -> ... @testitem @testset @show "s" "$(a)" \'c\' 1 @isdefined isfile'.split() + ["\n"]
    for _ in range(20_000):
        text = " ".join(r.choices(words, k=r.randint(1, 14)))
        try:
            parser.parsed(text, parser.Facts())
        except SyntaxProblem:
            pass
        except Exception as e:
            raise AssertionError(text) from e
    for text in ("(" * 3000 + ")" * 3000, "f(" * 5000, "begin " * 2000, "try local", "module M\nfunction f(x)\n g(", "if a else if b else " * 500):
        f = parse(text)
        assert f.findings[-1][0] == "syntax_errors" and all(n[5] >= 0 for n in f.nodes)


def test_states_over_a_stream(spark, tmp_path):
    path = tmp_path / "in"
    path.mkdir()
    rows = [("w", 1, "Created"), ("w", 2, "Starting"), ("w", 3, "Done"), ("w", 4, "Dead"), ("v", 1, "Created")]
    more = [("w", 5, "Created"), ("w", 6, "Dead"), ("v", 2, "Starting")]
    for i, part in enumerate((rows, more)):
        (path / f"{i}.json").write_text("\n".join(json.dumps(dict(zip(("key", "seq", "state"), r, strict=True))) for r in part))
    os.utime(path / "0.json", (1, 1))
    stream = spark.readStream.schema("key string, seq long, state string").option("maxFilesPerTrigger", 1).json(str(path))
    q = state.follow_states(stream).writeStream.format("memory").queryName("states").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = {(r["key"], r["seq"]): (r["valid"], r["failures"], r["exhausted"]) for r in spark.table("states").collect()}
    assert got["w", 3] == (False, 0, False) and got["w", 5] == (True, 1, False) and got["w", 6] == (True, 2, True) and got["v", 2] == (True, 0, False)


def test_facts_of_a_large_file_come_in_pieces(spark):
    """A file of 3,000 declarations has several rows, none with over a few facts more than ROOM, that together are what the parser finds."""
    text = "module M\n" + "\n".join(f"function f{i}(a, b=1; c)\n    @show a\n    return g(a, b)\nend" for i in range(3000)) + "\nend\n"
    found = analysis.facts(files(spark, {"a": text, "b": "x = 1", "c": ""})).collect()
    whole = parse(text)
    own = sorted((r for r in found if r["uri"].endswith("a")), key=lambda r: r["piece"])
    assert len(own) > 3 and [r["piece"] for r in own] == list(range(len(own)))
    assert max(sum(len(r[t]) for t in analysis.TABLES) for r in own) < analysis.ROOM + 100
    for t in analysis.TABLES:
        rows = [tuple(x) for r in own for x in r[t]]
        assert sorted(map(repr, rows)) == sorted(map(repr, getattr(whole, t))), t
    assert sum(r["piece"] == 0 for r in found) == 3


def test_inventory_hash_of_a_large_file(spark):
    """Edits inside bodies move the bounds between a file's pieces, and leave its hash; the order of declarations is part of it."""
    one = lambda body, names: "\n".join(f"function {n}(a)\n    {body}\nend" for n in names)
    names = [f"f{i}" for i in range(3000)]
    texts = {"a": one("a", names), "b": one("a + a + a", names), "c": one("a", names[::-1])}
    got = {r["uri"][-1]: r["hash"] for r in analysis.inventory_hash(analysis.facts(files(spark, texts))).collect()}
    assert len(got) == 3 and got["a"] == got["b"] != got["c"]


def test_tokens_hold_little():
    """All tokens of a file of two million were Token objects of over 150 bytes each."""
    import tracemalloc

    from arborq.parser.lexer import Tokens, tokens

    text = "f(a, b)\n" * 50_000
    tracemalloc.start()
    held = Tokens(text)
    size = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert len(held) == 350_000 and size < 12 * len(held)
    few = tokens(text[:80])
    assert held[:70] == few and held[-1].text == "\n" and held[349_993].start == 49_999 * 8 and held[0] == few[0]
