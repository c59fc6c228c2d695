import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from arborq.operators import lifecycle, projects, registry, relational, symbols


def test_deepest_match_and_chain(spark):
    files = spark.createDataFrame([("/a/b/c.jl",), ("/a/x.jl",), ("/z.jl",), ("/ab/q.jl",)], "uri string")
    folders = spark.createDataFrame([("/a",), ("/a/b",), ("/ab/q.jl",)], "dir string")
    got = {r["uri"]: r["dir"] for r in relational.deepest_match(files, folders, "uri", "dir").collect()}
    assert got == {"/a/b/c.jl": "/a/b", "/a/x.jl": "/a", "/z.jl": None, "/ab/q.jl": None}
    own = {r["uri"]: r["dir"] for r in relational.deepest_match(files, folders, "uri", "dir", own=True).collect()}
    assert own["/ab/q.jl"] == "/ab/q.jl"
    assert relational.chain(files, folders, "uri", "dir").count() == 3


def test_innermost_against_brute_force(spark):
    r = random.Random(1)
    spans = [(f"f{r.randrange(3)}", a, a + r.randint(0, 900), i) for i, a in enumerate(r.choices(range(2000), k=150))]
    points = [(f"f{r.randrange(4)}", r.randrange(3000)) for _ in range(200)]
    got = relational.innermost(spark.createDataFrame(points, "file string, at int").distinct(), spark.createDataFrame(spans, "file string, start int, stop int, id int"), ["file"], "at", "start", "stop", [F.col("id").asc()])
    want = {}
    for f, at in set(points):
        around = [(stop - start, -start, i) for g, start, stop, i in spans if g == f and start <= at < stop]
        if around:
            want[f, at] = min(around)[2]
    assert {(x["file"], x["at"]): x["id"] for x in got.collect()} == want


def test_layers(spark):
    a = spark.createDataFrame([("x", "1", 0), ("y", "1", 0)], "k string, v string, at int")
    b = spark.createDataFrame([("x", "2", 5), ("x", "3", 9)], "k string, v string, at int")
    assert {r["k"]: r["v"] for r in relational.layered([a, b], ["k"], "v", ["at"]).collect()} == {"x": "3", "y": "1"}


def fold(kinds):
    winner = 0
    for i, k in enumerate(kinds):
        if not (kinds[winner] in symbols.DATATYPES and k in symbols.WEAK):
            winner = i
    return winner


def test_declared_is_the_fold(spark):
    r = random.Random(2)
    kinds = ["function", "assignment", "struct", "const", "macro", "abstract", "global", "enum"]
    rows, want = [], {}
    for n in range(400):
        own = r.choices(kinds, k=r.randint(1, 6))
        rows += [(n, i, k) for i, k in enumerate(own)]
        want[n] = fold(own)
    df = spark.createDataFrame(rows, "name int, at int, kind string")
    assert {x["name"]: x["at"] for x in symbols.declared(df, ["name"], "at").collect()} == want


def test_arities(spark):
    row = lambda lo, hi, kws, splat: (lo, hi, kws, splat)
    calls = [row(2, 2, [], False), row(2, symbols.UNBOUNDED, [], True), row(1, 1, ["a"], False), row(5, 5, [], False)]
    methods = [row(1, 2, ["a", "b"], False), row(3, symbols.UNBOUNDED, [], True)]
    c = spark.createDataFrame([(i, *x) for i, x in enumerate(calls)], "c int, lo int, hi int, kws array<string>, splat boolean").alias("c")
    m = spark.createDataFrame([(i, *x) for i, x in enumerate(methods)], "m int, lo int, hi int, kws array<string>, splat boolean").alias("m")
    fits = symbols.arity_fits({"min": F.col("c.lo"), "max": F.col("c.hi"), "kws": F.col("c.kws"), "has_splat": F.col("c.splat")}, {"min": F.col("m.lo"), "max": F.col("m.hi"), "kws": F.col("m.kws"), "kwsplat": F.col("m.splat")})
    assert {(x["c"], x["m"]) for x in c.join(m, fits).collect()} == {(0, 0), (1, 0), (1, 1), (2, 0), (3, 1)}


def test_registry(spark):
    rows = [("A", 1, 2, 0, False), ("A", 1, 3, 0, True), ("A", 0, 9, 1, False), ("B_jll", 1, 0, 0, False), ("C", 0, 3, 1, None)]
    df = spark.createDataFrame(rows, "name string, major int, minor int, patch int, yanked boolean")
    ok = registry.eligible(df)
    assert {(r["name"], r["major"], r["minor"]) for r in ok.collect()} == {("A", 1, 2), ("A", 0, 9), ("C", 0, 3)}
    assert {(r["name"], r["major"]) for r in registry.newest(ok, 1, ["name"]).collect()} == {("A", 1), ("C", 0)}
    assert {r["name"] for r in registry.eligible(df, include=["^A"], exclude=["x"]).collect()} == {"A"}
    text = df.select("name").distinct()
    assert sum(registry.shard(text, F.col("name"), 3, k).count() for k in range(3)) == text.count()


def test_fnv1a():
    as_unsigned = lambda t: registry._fnv1a(t) & 0xFFFFFFFFFFFFFFFF
    assert as_unsigned("") == 0xCBF29CE484222325 and as_unsigned("a") == 0xAF63DC4C8601EC8C and as_unsigned("foobar") == 0x85944171F73967E8


def test_unsigned_mod(spark):
    values = [0, 5, -1, -(2**63), 2**63 - 1]
    for n in (3, 7, 1000):
        got = spark.createDataFrame([(v,) for v in values], "h long").select(registry.unsigned_mod(F.col("h"), n).alias("m")).collect()
        assert [r["m"] for r in got] == [(v % 2**64) % n for v in values]


def test_refresh_computes_what_changed_only(spark):
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "3")], "k string, h string")
    old = spark.createDataFrame([("a", "1", "old"), ("b", "x", "old"), ("z", "9", "old")], "k string, h string, v string")
    got = lifecycle.refreshed(new, old, "k", "h", lambda df: df.withColumn("v", F.lit("new")))
    assert {(r["k"], r["v"]) for r in got.collect()} == {("a", "old"), ("b", "new"), ("c", "new")}


def test_completions(spark):
    names = spark.createDataFrame([("foo", "store", 0), ("foobar", "local", 2), ("Foo", "module", 1), ("fooo", "local", 0), ("bar", "local", 0)], "label string, source string, depth int")
    got = [r["label"] for r in symbols.completions(names, "foo").orderBy("place").collect()]
    assert got == ["foo", "fooo", "foobar", "Foo"]
    assert [r["rank_text"] for r in symbols.completions(names, "foo").orderBy("place").collect()][0] == "000001"


def test_ranks_of_a_million_rows(spark):
    """Ranges are sampled; the places must still be those of row_number, whatever the sample."""
    n = 1_200_000
    rows = spark.range(n).select((F.xxhash64("id") % 50_000).alias("a"), F.col("id").alias("b"))
    got = symbols.relational_rank(rows.repartition(6), ["a", "b"], 6)
    each = got.agg(F.count("*").alias("n"), F.count_distinct("place").alias("places"), F.min("place").alias("low"), F.max("place").alias("high"), F.count_distinct("rank_text").alias("texts"), F.max(F.char_length("rank_text")).alias("wide")).first()
    assert tuple(each) == (n, n, 1, n, n, 7)
    at = Window.orderBy("place")
    wrong = got.select("a", "b", F.lag("a").over(at).alias("a0"), F.lag("b").over(at).alias("b0")).where("a0 > a OR (a0 = a AND b0 >= b)")
    assert wrong.count() == 0


def test_item_ids_beyond_16_bits(spark):
    items = spark.range(70_000).select(F.lit("f").alias("name"), F.col("id").alias("at")).unionByName(spark.range(3).select(F.lit("g").alias("name"), F.col("id").alias("at")))
    got = symbols.item_ids(items, ["name"], ["at"])
    assert got.select("id").distinct().count() == 70_003


def test_contained_against_all_pairs(spark):
    r = random.Random(5)
    points = [(r.choice("ab"), r.randrange(-50, 3000)) for _ in range(300)] + [("a", 0), ("a", 0), (None, 3), ("a", None)]
    intervals = [(i, r.choice("ab"), s := r.randrange(-60, 3000), s + r.choice([0, 1, 2, 3, 4, 5, 8, 9, 100, 4096, 100_000, -3])) for i in range(200)] + [(900, "a", 0, 1 << 30), (901, None, 0, 9), (902, "b", None, 3)]
    p, i = spark.createDataFrame(points, "f string, at int"), spark.createDataFrame(intervals, "i int, f string, low int, high int")
    got = sorted((x["f"], x["at"], x["i"]) for x in relational.contained(p, i, ["f"], "at", "low", "high").collect())
    want = sorted((f, a, k) for f, a in points for k, g, low, high in intervals if f and f == g and None not in (a, low, high) and low <= a < high)
    assert got == want
    assert relational.contained(p, i.where("high < low"), ["f"], "at", "low", "high").count() == 0


def test_extended_methods(spark):
    rows = [("A", "f", "A", "f"), ("B", "f", "A", "f"), ("C", "f", "A", "f"), ("C", "f", "A", "f"), ("A", "g", "A", "g"), ("B", "h", "A", "k"), ("A", "k2", "A", "k"), (None, "f", "A", "f"), ("D", "x", None, None)]
    got = symbols.extended_methods(spark.createDataFrame(rows, "module string, name string, extends_module string, extends_name string"))
    assert {(r["owner"], r["name"]): r["modules"] for r in got.collect()} == {("A", "f"): ["A", "B", "C"], ("A", "k"): ["A", "B"]}


def test_deving(spark):
    deps = spark.createDataFrame([("/w/b", "dev", "../p"), ("/w/a", "dev", "/w/p/"), ("/w/c", "registered", "../q"), ("/w/c", "dev", None), (None, "dev", "/w/q"), ("/w", "dev", "r")], "project string, kind string, path string")
    packages = spark.createDataFrame([("/w/p",), ("/w/q",), ("/w/r",), (None,)], "folder string")
    found = projects.deving(packages, deps)
    assert {r["folder"]: r["project"] for r in found.collect()} == {"/w/p": "/w/a", "/w/q": None, "/w/r": "/w", None: None}
    own = spark.createDataFrame([("/w/r",)], "folder string")
    for active in ("/active", None):
        got = {r["folder"]: r["test_env"] for r in projects.test_environments(found, own, active).collect()}
        assert got == {"/w/p": active, "/w/q": "/w/q", "/w/r": "/w/r", None: None}


def test_calls_are_fitted_by_shape_however_many_there_are(spark):
    """Copies of calls and methods aren't compared one by one: 4,000 calls of a name with 4,000 methods took 16 million comparisons."""
    calls = spark.range(4000).select("id", F.when(F.col("id") < 3000, "f").otherwise("nothing").alias("callee"), F.when(F.col("id") % 10 < 9, F.col("id") % 3).alias("n"), F.array().cast("array<string>").alias("kws"))
    methods = spark.range(4000).select(F.lit("f").alias("callee"), (F.col("id") % 2).alias("n"), F.lit(False).alias("any"))
    fits = (F.col("c.n") == F.col("m.n")) | F.col("m.any")
    good = symbols.fit_calls(calls, methods, "callee", ["n", "kws"], fits)
    bad = symbols.unfit_calls(calls, methods, "callee", ["n", "kws"], fits)
    want = [(i, i % 10 < 9 and i % 3 < 2) for i in range(3000)]
    assert sorted(r["id"] for r in good.collect()) == [i for i, fit in want if fit]
    assert sorted(r["id"] for r in bad.collect()) == [i for i, fit in want if not fit]
    kinds = symbols.fit_shapes(calls, methods, ["callee"], ["n", "kws"], fits)
    assert sorted((r["n"] is None, r["n"] or 0, r["fit"]) for r in kinds.collect()) == [(False, 0, True), (False, 1, True), (False, 2, False), (True, 0, False)]


def test_intervals_of_the_same_ends_are_compared_once(spark, monkeypatch):
    """1,000 intervals of 10 different ends around 20 points: 10 rows go into the join, where all 1,000 did."""
    from arborq.operators import relational

    joined, real = [], relational.contained
    monkeypatch.setattr(relational, "contained", lambda points, intervals, *rest: joined.append(intervals.count()) or real(points, intervals, *rest))
    nodes = spark.range(1000).select(F.col("id").alias("node"), F.lit("a").alias("file"), (F.col("id") % 5).alias("start"), (F.col("id") % 5 + 3 + F.col("id") % 2 * 9).alias("stop"))
    points = spark.range(20).select(F.lit("a").alias("file"), F.col("id").alias("pos"))
    own = [(r["stop"] - r["start"], -r["start"], r["node"], r["stop"]) for r in nodes.collect()]
    want = {p: [k for _, s, k, stop in sorted(own) if -s <= p < stop] for p in range(20)}
    args = (["file"], "pos", "start", "stop", [F.col("node").asc()])
    best = relational.innermost(points, nodes, *args).collect()
    every = relational.outward(points, nodes, *args).collect()
    assert {r["pos"]: r["node"] for r in best} == {p: k[0] for p, k in want.items() if k}
    assert {(r["pos"], r["node"]): r["level"] for r in every} == {(p, k): i + 1 for p, ks in want.items() for i, k in enumerate(ks)}
    assert joined == [10, 10]
