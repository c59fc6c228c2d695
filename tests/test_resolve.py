import pytest
from pyspark.sql import functions as F

from arborq.operators import analysis, resolve
from arborq.parser.parser import parse
from arborq.workspace import Workspace

P = '''module P
using Known
using Other: thing
include("a.jl")
const K = 1
K = 2
struct S
    x::Int
end
S(y) = y
function f(a, unused, _; key=K) where {T, U<:T}
    local_used = a + key
    local_unused = 3
    for i in 1:a, j in i:3
        local_used += i + j
    end
    g = x -> x + local_used
    z, _w = g(1), "$a and $(h(a))"
    try
        g(2)
    catch e
        rethrow(e)
    end
    [q for q in z if q > missing_name]
end
f(1, 2, 3; key=4)
f(1)
f(args...)
module Inner
    using Nowhere
    anything_goes(1)
end
end
'''
A = "h(x) = let y = x; y + K end\nh2() = f(1, 2)\n"


@pytest.fixture(scope="module")
def found(spark):
    files = spark.createDataFrame([("/s/P.jl", P), ("/s/a.jl", A)], "uri string, content string")
    return analysis.facts(files).persist()


def messages(df):
    return {(r["uri"][-4:], r["rule_id"], r["message"].split()[0] if "never" in r["message"] or "constant" in r["message"] else r["message"].split()[-1]) for r in df.collect()}


def test_unused(found):
    assert messages(resolve.unused(found)) == {("P.jl", "unused_function_argument", "unused"), ("P.jl", "unused_type_parameter", "U"), ("P.jl", "unused_binding", "local_unused")}


def test_redeclared_and_calls(found):
    assert messages(resolve.redeclared(found)) == {("P.jl", "const_decl", "K")}
    got = {(r["uri"][-4:], r["start"]) for r in resolve.unfit_calls(found).collect()}
    assert got == {("P.jl", P.index("f(1)")), ("a.jl", A.index("f(1, 2)"))}


def spliced(found):
    records = analysis.include_records(found)
    roots = found.where("uri = '/s/P.jl'").select(F.col("uri").alias("node"))
    return analysis.module_files(records, found.select("uri"), roots)


def test_across_files(found, spark):
    s = spliced(found)
    declared = analysis.declarations(found, s)
    uses = {(r["uri"][-4:], r["name"]) for r in resolve.cross_file_uses(found, s, declared).collect()}
    assert {("P.jl", "h"), ("a.jl", "f"), ("a.jl", "K")} <= uses
    env = spark.createDataFrame([(x,) for x in ("Int", "+", "rethrow", "include", "args")], "name string")
    known = spark.createDataFrame([("Known",), ("Other",)], "name string")
    got = resolve.missing_references(found, s, declared, env, known)
    assert messages(got) == {("P.jl", "missing_reference", "missing_name")}
    assert messages(resolve.unresolved_imports(found, s, known)) == {("P.jl", "unresolved_import", "Nowhere")}


def test_definitions_and_references(found, spark):
    at = lambda text, what, k=0: text.index(what) + k
    points = spark.createDataFrame([("/s/P.jl", at(P, "local_used + ", 0) if "local_used + " in P else at(P, "+ local_used", 2)), ("/s/a.jl", at(A, "f(1"))], "uri string, offset int")
    got = {(r["uri"][-4:], r["name"], r["target_uri"][-4:], r["target_start"]) for r in resolve.definitions(found, points).collect()}
    assert ("P.jl", "local_used", "P.jl", P.index("local_used =")) in got
    assert ("a.jl", "f", "P.jl", P.index("function f")) in got
    refs = {(r["name"], r["ref_uri"][-4:], r["ref_start"]) for r in resolve.references(found, points).collect()}
    assert {x for x in refs if x[0] == "f"} == {("f", "P.jl", i) for i in (P.index("f(1, 2, 3"), P.index("f(1)"), P.index("f(args"))} | {("f", "a.jl", A.index("f(1"))}
    assert {x[2] for x in refs if x[0] == "local_used"} == {P.index("local_used += i"), P.index("+ local_used") + 2}


def test_scopes_end_with_their_blocks():
    f = parse("function f(x)\n  let y = x\n    y\n  end\n  y\nend\nfor i in 1:2; i; end\ni\n")
    names = {s[0]: s[1] for s in f.scopes}
    assert [(names[r[0]], r[1]) for r in f.refs] == [("let", "x"), ("let", "y"), ("function", "y"), ("for", "i"), ("file", "i")]


def test_rename_and_environment(spark):
    w = Workspace(spark)
    w.add_files(spark.createDataFrame([("/s/P.jl", P), ("/s/a.jl", A)], "uri string, content string"))
    edits = w.rename_edits("/s/P.jl", P.index("+ local_used") + 2, "n").orderBy("start").collect()
    text = P
    for e in reversed(edits):
        text = text[: e["start"]] + e["text"] + text[e["stop"] :]
    assert text == P.replace("local_used", "n")
    assert "missing_reference" not in {r["rule_id"] for r in w.findings().select("rule_id").distinct().collect()}
    w.environment = spark.createDataFrame([("Base", x) for x in ("Int", "rethrow", "include", "args")] + [("Known", "k"), ("Other", "thing")], "package string, name string")
    got = {(r["rule_id"], r["message"].split()[-1]) for r in w.findings().where("rule_id IN ('missing_reference', 'unresolved_import')").collect()}
    assert got == {("missing_reference", "missing_name"), ("unresolved_import", "Nowhere")}


FILES = {
    "/t/T.jl": "module T\ninclude(\"A.jl\")\ninclude(\"B.jl\")\nusing .A: foo as fa, both\nimport .B\nfa(1) + B.foo(2) + both() + T.A.foo(3)\nend\n",
    "/t/A.jl": "module A\nexport foo, both\nfoo(x) = x\nfoo(x, y) = foo(x) + y\nboth() = foo(1)\nfunction outer()\n    foo = 1\n    return foo\nend\nend\n",
    "/t/B.jl": "module B\nusing ..A\nfoo(x) = 2x\nbar() = foo(3) + both()\nend\n",
}


@pytest.fixture(scope="module")
def tree(spark):
    w = Workspace(spark)
    w.add_files(spark.createDataFrame(list(FILES.items()), "uri string, content string"))
    w.refresh()
    return w


def places(uri, *what):
    """Where `what` stands, each (text, offset in it)."""
    return {(uri, FILES[uri].index(t) + k) for t, k in what}


def test_references_go_by_item_and_not_by_name(tree):
    a = FILES["/t/A.jl"]
    got = {(r["ref_uri"], r["ref_start"]) for r in tree.references("/t/A.jl", a.index("foo(x) + y")).collect()}
    want = places("/t/A.jl", ("foo(x) + y", 0), ("foo(1)", 0)) | places("/t/T.jl", ("foo as", 0), ("fa(1)", 0), ("foo(3)", 0))
    assert got == want
    got = {(r["ref_uri"], r["ref_start"]) for r in tree.references("/t/T.jl", FILES["/t/T.jl"].index("foo(2)")).collect()}
    assert got == places("/t/B.jl", ("foo(3)", 0)) | places("/t/T.jl", ("foo(2)", 0))
    got = {(r["target_uri"], r["target_start"]) for r in tree.definitions("/t/B.jl", FILES["/t/B.jl"].index("both()")).collect()}
    assert got == places("/t/A.jl", ("both() =", 0))
    got = {(r["target_uri"], r["target_start"]) for r in tree.definitions("/t/T.jl", FILES["/t/T.jl"].index("fa(1)")).collect()}
    assert got == places("/t/A.jl", ("foo(x) = x", 0), ("foo(x, y)", 0))


def renamed(w, uri, offset, name):
    out = dict(FILES)
    for e in w.rename_edits(uri, offset, name).orderBy("uri", F.desc("start")).collect():
        out[e["uri"]] = out[e["uri"]][: e["start"]] + e["text"] + out[e["uri"]][e["stop"] :]
    return {u for u in out if out[u] != FILES[u]}, out


def test_rename_takes_declarations_exports_and_imports_of_one_item(tree):
    changed, out = renamed(tree, "/t/A.jl", FILES["/t/A.jl"].index("foo(1)"), "new")
    assert changed == {"/t/A.jl", "/t/T.jl"}
    assert out["/t/T.jl"] == FILES["/t/T.jl"].replace("foo as", "new as").replace("A.foo", "A.new")
    assert out["/t/A.jl"] == FILES["/t/A.jl"].replace("foo", "new").replace("new = 1", "foo = 1").replace("return new", "return foo")
    changed, out = renamed(tree, "/t/A.jl", FILES["/t/A.jl"].index("foo = 1"), "here")
    assert changed == {"/t/A.jl"} and out["/t/A.jl"] == FILES["/t/A.jl"].replace("foo = 1", "here = 1").replace("return foo", "return here")
    changed, out = renamed(tree, "/t/B.jl", FILES["/t/B.jl"].index("foo(x)"), "new")
    assert changed == {"/t/B.jl", "/t/T.jl"} and out["/t/B.jl"] == FILES["/t/B.jl"].replace("foo", "new") and out["/t/T.jl"] == FILES["/t/T.jl"].replace("B.foo", "B.new")


def test_files_are_spliced_depth_first(spark):
    """A file that is reached deep first, and at the top later, is where it was first."""
    text = {"/m.jl": 'module M\ninclude("a.jl")\ninclude("c.jl")\nend\ninclude("b.jl")', "/a.jl": 'module A\ninclude("b.jl")\nend', "/b.jl": 'x = 1\ninclude("c.jl")\ninclude("m.jl")', "/c.jl": "y = 1"}
    found = analysis.facts(spark.createDataFrame(list(text.items()), "uri string, content string")).persist()
    roots = spark.createDataFrame([("/m.jl",)], "node string")
    got = {r["file"]: (r["path"], r["at"]) for r in analysis.module_files(analysis.include_records(found), found.select("uri"), roots).collect()}
    assert {f: p for f, (p, _) in got.items()} == {"/m.jl": [], "/a.jl": ["M"], "/b.jl": ["M", "A"], "/c.jl": ["M", "A"]}
    assert sorted(got, key=lambda f: got[f][1]) == ["/m.jl", "/a.jl", "/b.jl", "/c.jl"]
    assert {r["file"]: r["path"] for r in analysis.splices(found).collect()}.keys() == text.keys()  # a cycle has no root


def test_calls_go_by_item(spark):
    """Methods of the same name in another module, and those that a qualified name adds, don't count for what they aren't of."""
    files = {"/m/A.jl": "module A\nf(x) = x\ng(x) = x\nf(1, 2)\ng(1, 2)\nend\n", "/m/B.jl": "module B\nf(x, y) = x\nf(1)\nf(1, 2)\nimport A\nA.g(x, y) = y\nend\n", "/m/C.jl": "module C\nusing A: f as h\nh(1, 2)\nh(1)\nk(1)\nend\n"}
    found = analysis.facts(spark.createDataFrame(list(files.items()), "uri string, content string")).persist()
    got = {(r["uri"], r["start"]) for r in resolve.unfit_calls(found).collect()}
    assert got == {("/m/A.jl", files["/m/A.jl"].index("f(1, 2)")), ("/m/B.jl", files["/m/B.jl"].index("f(1)")), ("/m/C.jl", files["/m/C.jl"].index("h(1, 2)"))}
