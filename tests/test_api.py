import pytest

from arborq.workspace import DuplicateFile, UnknownFile, Workspace

CONTENT = {
    "file:///w/Project.toml": 'name = "P"\nuuid = "7876af07-990d-54b4-ab0e-23690620f79a"\nversion = "0.1.0"\n',
    "file:///w/JuliaLint.toml": 'preset = "strict"\nexclude = ["gen/"]\n',
    "file:///w/src/P.jl": 'module P\nusing Q\ninclude("a.jl")\ninclude("a.jl")\ninclude("gone.jl")\nend\n',
    "file:///w/src/a.jl": 'f(x) = 1\nf(x, y; k=2) = g(x)\ng(z) = f(1, 2) == nothing\n',
    "file:///w/gen/x.jl": "@show 1\n",
    "untitled:1": "h() = 1\n",
}


@pytest.fixture
def workspace(spark):
    w = Workspace(spark)
    w.add_files(spark.createDataFrame([(u, c, "julia" if u == "untitled:1" else None) for u, c in CONTENT.items()], "uri string, content string, language_id string"))
    return w


def column(df, name):
    return {r[name] for r in df.collect()}


def test_files(workspace):
    w = workspace
    assert column(w.text_files(), "uri") == set(CONTENT)
    assert column(w.julia_files(), "uri") == {u for u in CONTENT if u.endswith(".jl") or u == "untitled:1"}
    assert w.text_file("untitled:1") == "h() = 1\n" and w.has_file("untitled:1") and not w.has_file("x")
    with pytest.raises(UnknownFile):
        w.text_file("x")
    with pytest.raises(DuplicateFile):
        w.add_file("untitled:1", "")
    with pytest.raises(UnknownFile):
        w.update_file("x", "")
    with pytest.raises(UnknownFile):
        w.remove_file("x")
    w.update_file("untitled:1", "k() = 2", "julia")
    assert w.text_file("untitled:1") == "k() = 2"
    w.remove_file("untitled:1")
    w.remove_all_children("file:///w/gen")
    assert len(column(w.text_files(), "uri")) == len(CONTENT) - 2


def test_diagnostics(workspace):
    got = {(r["uri"].rpartition("/")[2], r["rule_id"], r["severity"], r["message"]) for r in workspace.diagnostics().collect()}
    assert {(u, r, s) for u, r, s, _ in got} == {("P.jl", "include_errors", "warning"), ("P.jl", "bare_using", "warning"), ("a.jl", "nothing_comparison", "warning"), ("a.jl", "unused_function_argument", "warning")}
    assert {m.split()[0] for _, r, _, m in got if r == "include_errors"} == {"DuplicateInclude", "MissingFile"}
    counts = {r["uri"]: r["n"] for r in workspace.diagnostics_per_file().collect()}
    assert counts["file:///w/src/P.jl"] == 3 and counts["file:///w/gen/x.jl"] == 0 and len(counts) == len(CONTENT)


def test_graph_and_projects(workspace):
    w = workspace
    assert column(w.roots(), "node") == {"file:///w/src/P.jl", "file:///w/gen/x.jl", "untitled:1"}
    assert {(r["node"][-4:], r["root"][-4:]) for r in w.best_root("file:///w/src/a.jl").collect()} == {("a.jl", "P.jl")}
    assert {(".".join(r["path"]), r["name"]) for r in w.declarations().collect()} == {("", "P"), ("P", "f"), ("P", "g"), ("", "h")}
    assert column(w.packages(), "folder") == {"file:///w"}
    assert w.projects().isEmpty()
    assert {r["uri"]: r["via"] for r in w.governing_project().collect()}["file:///w/src/a.jl"] == "package"


def test_features(workspace):
    w, a = workspace, "file:///w/src/a.jl"
    at = CONTENT[a].index("f(1")
    assert column(w.signature_help(a, at), "signature") == {"f(2..2; k)"}
    assert column(w.hover(a, at, 0), "text") == {"function f(1..1)\nfunction f(2..2; k)", None}
    assert column(w.module_at("file:///w/src/P.jl", 12), "module") == {"P"}
    assert [r["label"] for r in w.completions("f").orderBy("place").collect()][0] == "f"
    assert column(w.workspace_symbols("g"), "name") == {"g"}
    assert column(w.document_links(), "link") == {"a.jl"}
    assert column(w.code_actions(), "action") == {"CompareNothingWithTripleEqual", "ExplicitPackageVarImport", "DeleteUnusedFunctionArgumentName"}
    edits = {r["uri"]: (r["text"], r["error"]) for r in w.format_edits(lambda t: t.replace("h()", "h( )") if "f(x)" not in t else 1 / 0).collect()}
    assert edits["untitled:1"] == ("h( ) = 1\n", None) and edits[a][1].startswith("ZeroDivisionError")


def test_an_edit_parses_only_what_changed(workspace):
    w = workspace
    w.refresh()
    w.update_file("untitled:1", "h2() = 1", "julia")
    assert "h2" in column(w.table("items"), "name") or "h2" in {r["name"] for r in w.refresh().selectExpr("explode(items) x").select("x.name").collect()}
    assert w.is_ready()


def test_feed_and_indirect(workspace, spark):
    w = workspace
    wrong = w.apply(spark.createDataFrame([(1, "add", "untitled:1", "x"), (2, "add", "untitled:2", "y"), (3, "remove", "file:///w/gen/x.jl", None)], "seq long, op string, uri string, content string"))
    assert column(wrong, "seq") == {1} and w.has_file("untitled:2") and not w.has_file("file:///w/gen/x.jl")
    w.set_indirect(spark.createDataFrame([("file:///o/z.jl", "1")], "uri string, content string"))
    assert column(w.indirect_files(), "uri") == {"file:///o/z.jl"} and not w.has_file("file:///o/z.jl")
    w.set_indirect(None, "file:///o/z.jl")
    assert w.indirect_files().isEmpty()
