import re

import pytest
from pyspark.sql import functions as F

from arborq.functions import globs, paths, text


@pytest.mark.parametrize(
    "glob, path, hit",
    [
        ("*.jl", "a.jl", True), ("*.jl", "x/y/a.jl", True), ("/*.jl", "a.jl", True), ("/*.jl", "x/a.jl", False), ("src/*.jl", "src/a.jl", True), ("src/*.jl", "x/src/a.jl", False), ("src/*.jl", "src/x/a.jl", False),
        ("src/**/*.jl", "src/a.jl", True), ("src/**/*.jl", "src/x/y/a.jl", True), ("**/gen/", "a/gen/b.jl", True), ("gen/", "gen/b.jl", True), ("gen/", "gen", False), ("gen", "gen/b.jl", False), ("gen", "x/gen", True), ("src/gen", "src/gen/a.jl", False), ("src/gen/", "src/gen/a.jl", True), ("a?c", "abc", True), ("a?c", "a/c", False),
        ("[ab].jl", "a.jl", True), ("[!ab].jl", "a.jl", False), ("[!ab].jl", "c.jl", True), ("a.b", "axb", False), ("docs/**", "docs/x/y", True),
        ("[^ab].jl", "a.jl", False), ("[^ab].jl", "c.jl", True), ("[]x].jl", "].jl", True), ("[]x].jl", "y.jl", False), ("[a&&b].jl", "&.jl", True), ("src\\a.jl", "src/a.jl", True), ("[ab", "[ab", True), ("[ab", "a", False), ("", "", True), ("", "a", False), ("a{1}+(b)", "a{1}+(b)", True), ("x**/y", "x1/2/y", True),
    ],
)
def test_globs(glob, path, hit):
    assert bool(re.search(globs.glob_to_regex(glob), path)) == hit


def test_globs_in_java_are_as_in_python(spark):
    patterns = ["*.jl", "src/**/b[]x!].jl", "[^a-c]?", "[a&&b]", "[a[b]", "gen", "gen/", "a\\b", "[ab", "**/x", "x**"]
    names = ["a.jl", "x/a.jl", "src/b].jl", "src/q/bx.jl", "d1", "a1", "&", "[", "gen", "gen/a", "y/gen", "a/b", "[ab", "x", "y/x", "xyz/1"]
    df = spark.createDataFrame([(n,) for n in names], "n string").select("n", *[F.col("n").rlike(globs.glob_to_regex(g)).alias(f"g{i}") for i, g in enumerate(patterns)])
    for r in df.collect():
        assert [r[f"g{i}"] for i in range(len(patterns))] == [bool(re.search(globs.glob_to_regex(g), r["n"])) for g in patterns], r["n"]


def test_selection_by_lists_and_by_columns(spark):
    df = spark.createDataFrame([("src/a.jl",), ("src/gen/b.jl",), ("doc/c.md",)], "p string")
    include, exclude = ["src/", "*.md"], ["gen/", "src/gen/"]
    df = df.withColumns({"i": F.array(*[F.lit(globs.glob_to_regex(x)) for x in include]), "e": F.array(*[F.lit(globs.glob_to_regex(x)) for x in exclude])})
    got = df.select(globs.selected(F.col("p"), include, exclude).alias("a"), globs.selected_by(F.col("p"), F.col("i"), F.col("e")).alias("b")).collect()
    assert [(r["a"], r["b"]) for r in got] == [(True, True), (False, False), (True, True)]
    assert df.where(globs.selected(F.col("p"), [], [])).count() == 3


def test_paths(spark):
    row = spark.createDataFrame([("/a/b/C.JL",)], "p string").select(paths.basename(F.col("p")), paths.dirname(F.col("p")), paths.extension(F.col("p")), paths.depth(F.col("p")), paths.folders(F.col("p")), paths.folders(F.col("p"), True), paths.language_of(F.col("p"))).collect()[0]
    assert list(row) == ["C.JL", "/a/b", ".jl", 3, ["", "/a", "/a/b"], ["", "/a", "/a/b", "/a/b/C.JL"], "julia"]


@pytest.mark.parametrize("path, uri", [("/a b/c.jl", "file:///a%20b/c.jl"), ("C:\\x\\y.jl", "file:///c:/x/y.jl"), ("/é", "file:///%C3%A9")])
def test_uris(path, uri):
    assert paths.path_to_uri(path) == uri
    assert paths.uri_to_path(uri) == path.replace("\\", "/").replace("C:", "c:")


def test_uri_without_a_path():
    assert paths.uri_to_path("untitled:x") is None


def test_is_julia(spark):
    rows = [("file:///a.JL", None), ("file:///a.md", "julia"), ("untitled:1", "julia"), ("untitled:2", None)]
    got = spark.createDataFrame(rows, "u string, l string").select(paths.is_julia(F.col("u"), F.col("l")).alias("j")).collect()
    assert [r["j"] for r in got] == [True, False, True, False]


@pytest.mark.parametrize("t", ["", "asdf\nasdf\nasdf", "a\r\nb\rc\n", "\n", "\r\r\n\n", "é\nü", "x\r"])
def test_line_starts(spark, t):
    data, want, at = t.encode(), [1], 0
    for m in re.finditer(rb"\r\n|\r|\n", data):
        want.append(m.end() + 1)
        at = m.end()
    df = spark.createDataFrame([(1, t)], "id long, t string")
    assert df.select(text.line_starts(F.col("t")).alias("s")).collect()[0]["s"] == want
    assert [r["start"] for r in text.line_table(df, "id", "t").orderBy("line_no").collect()] == want
    for offset in range(1, len(data) + 2):
        r = df.select(text.line_at(text.line_starts(F.col("t")), F.lit(offset)).alias("l"), text.column_at(text.line_starts(F.col("t")), F.lit(offset)).alias("c")).collect()[0]
        line = max(i for i, s in enumerate(want, 1) if s <= offset)
        assert (r["l"], r["c"]) == (line, offset - want[line - 1] + 1)
        if offset > 6:
            break
