import random

import pytest

from arborq.operators import graph


def frames(spark, edges, nodes):
    return spark.createDataFrame([(n,) for n in nodes], "node string"), spark.createDataFrame(edges, "src string, dst string")


def test_closure_roots_and_cycles_against_brute_force(spark):
    r = random.Random(1)
    names = [f"n{i}" for i in range(25)]
    edges = sorted({(r.choice(names), r.choice(names)) for _ in range(32)})
    nodes, e = frames(spark, edges, names)
    out = {a: {b for x, b in edges if x == a} for a in names}

    def reach(a):
        seen, todo = {a}, [a]
        while todo:
            for b in out[todo.pop()]:
                if b not in seen:
                    seen.add(b)
                    todo.append(b)
        return seen

    assert {(x["src"], x["dst"]) for x in graph.closure(nodes.withColumnRenamed("node", "src"), e).collect()} == {(a, b) for a in names for b in reach(a)}
    roots = {a for a in names if not any(b == a for _, b in edges)}
    assert {x["node"] for x in graph.roots(nodes, e).collect()} == roots
    assert {(x["node"], x["root"]) for x in graph.roots_of(nodes, e).collect()} == {(b, a) for a in roots for b in reach(a)}
    assert {x["node"] for x in graph.on_cycle(nodes, e).collect()} == {a for a in names if any(a in reach(b) for b in out[a])}
    assert {x["node"] for x in graph.reachable(nodes.limit(1), e).collect()} == reach(names[0])


@pytest.mark.parametrize("seed", range(2))
def test_components_and_labels_against_brute_force(spark, seed):
    r = random.Random(seed)
    n = [8, 50][seed]
    edges = [(r.randrange(n), r.randrange(n)) for _ in range(int(1.4 * n))] + [(n + i, n + i + 1) for i in range(12)] + [(n + 12, n), (n + 20, n + 20), (None, 1), (2, None), (3, 4), (3, 4)]
    real = {(a, b) for a, b in edges if a is not None and b is not None}
    names = sorted({x for e in real for x in e})
    reach = {a: {a} for a in names}
    for _ in names:
        for a, b in real:
            for x in names:
                if a in reach[x]:
                    reach[x].add(b)
    e = spark.createDataFrame(edges, "src int, dst int")
    want = {a: max(b for b in names if b in reach[a] and a in reach[b]) for a in names if any(b != a and b in reach[a] and a in reach[b] for b in names)}
    assert {x["node"]: x["component"] for x in graph.components(e).collect()} == want
    nodes = spark.createDataFrame([(x,) for x in names], "node int")
    assert {x["node"] for x in graph.on_cycle(nodes, e).collect()} == set(want) | {a for a, b in real if a == b}
    roots = [a for a in names if not any(b == a for _, b in real)]
    best = {b: min((a % 3 == 0, a) for a in roots if b in reach[a])[1] for b in names if any(b in reach[a] for a in roots)}
    got = graph.best_root_of(nodes, e, graph.F.col("root") % 3 == 0).collect()
    assert {x["node"]: x["root"] for x in got} == best and len(got) == len(best)


def test_graphs_without_edges(spark):
    nodes, e = frames(spark, [], ["a"])
    assert graph.components(e).isEmpty() and graph.on_cycle(nodes, e).isEmpty()
    assert [tuple(x) for x in graph.best_root_of(nodes, e, graph.F.lit(False)).collect()] == [("a", "a")]


def test_rounds_are_put_together(spark):
    """A chain longer than the union of rounds that is kept."""
    nodes, e = frames(spark, [(f"n{i}", f"n{i + 1}") for i in range(20)], [f"n{i}" for i in range(21)])
    assert graph.reachable(nodes.limit(1), e).count() == 21 and graph.closure(nodes.limit(1).withColumnRenamed("node", "src"), e).count() == 21


def walk(root, records, files):
    """The rules in the order of the source, by recursion."""
    out, met = set(), {}
    by = {}
    for s, o, t, g, body in sorted(records, key=lambda x: (x[0], x[1])):
        by.setdefault(s, []).append((o, t, g, body))

    def visit(src, way, context):
        for o, t, g, body in by.get(src, []):
            own = context or ((src, body) if body is not None else None)
            seen = met.setdefault(own, {root: False} if own is None else {})
            if t is None or t not in files:
                if not g:
                    out.add((src, o, "ComputedInclude" if t is None else "MissingFile"))
            elif t in way:
                out.add((src, o, "IncludeLoop"))
            elif t in seen:
                if not g and not seen[t]:
                    out.add((src, o, "DuplicateInclude"))
                if not g:
                    seen[t] = False
            else:
                seen[t] = g
                visit(t, way | {t}, own)

    visit(root, {root}, None)
    return out


@pytest.mark.parametrize("seed", range(2))
def test_include_findings_against_a_walk(spark, seed):
    r = random.Random(seed)
    names = [f"f{i}" for i in range(14)]
    records = []
    for s in names:
        for o in range(r.randrange(4)):
            t = r.choice([*names[names.index(s) + 1 :], *names[-3:], "gone", None]) if seed % 2 else r.choice([*names, "gone", None])
            records.append((s, o, t, r.random() < 0.2, r.choice([None, None, None, 1, 2])))
    roots = ["f0", "f1", "f2"]
    want = {(s, o, c) for root in roots for s, o, c in walk(root, records, set(names))}
    df = spark.createDataFrame(records, "src string, ordinal int, target string, guarded boolean, testitem int")
    files = spark.createDataFrame([(x,) for x in names], "node string")
    got = [(x["src"], x["ordinal"], x["code"]) for x in graph.include_findings(df, files, spark.createDataFrame([(x,) for x in roots], "node string")).collect()]
    assert set(got) == want and len(got) == len(want)


SCENARIOS = {
    "duplicate": ([("main", 1, "a"), ("main", 2, "a")], {("main", 2, "DuplicateInclude")}),
    "circle": ([("main", 1, "a"), ("a", 1, "b"), ("b", 1, "a")], {("b", 1, "IncludeLoop")}),
    "self": ([("main", 1, "a"), ("a", 1, "a")], {("a", 1, "IncludeLoop")}),
    "none": ([("main", 1, "a"), ("main", 2, "b")], set()),
    "diamond": ([("main", 1, "a"), ("main", 2, "b"), ("b", 1, "a")], {("b", 1, "DuplicateInclude")}),
    "missing and computed": ([("main", 1, "gone"), ("main", 2, None)], {("main", 1, "MissingFile"), ("main", 2, "ComputedInclude")}),
    "guarded": ([("main", 1, "gone", True), ("main", 2, None, True), ("main", 3, "a", True), ("main", 4, "a"), ("main", 5, "a")], {("main", 5, "DuplicateInclude")}),
    "guarded loop": ([("main", 1, "a"), ("a", 1, "main", True)], set()),
    "guarded self": ([("main", 1, "a"), ("a", 1, "a", True)], {("a", 1, "IncludeLoop")}),
    "test bodies": ([("main", 1, "a", False, 1), ("main", 2, "a", False, 2), ("main", 3, "a", False, 2)], {("main", 3, "DuplicateInclude")}),
}


@pytest.mark.parametrize("name", SCENARIOS)
def test_include_findings(spark, name):
    records, want = SCENARIOS[name]
    rows = [(s, o, t, *([*more, False][:1] or [False]), (more[1] if len(more) > 1 else None)) for s, o, t, *more in records]
    r = spark.createDataFrame(rows, "src string, ordinal int, target string, guarded boolean, testitem int")
    files = spark.createDataFrame([(x,) for x in ("main", "a", "b")], "node string")
    roots = files.where("node = 'main'")
    got = {(x["src"], x["ordinal"], x["code"]) for x in graph.include_findings(r, files, roots).collect()}
    if name == "guarded loop":
        want = {("a", 1, "IncludeLoop")}  # loops are reported, guarded or not
    assert got == want


def test_files_on_a_cycle_alone_have_no_root(spark):
    nodes, e = frames(spark, [("a", "b"), ("b", "a")], ["a", "b"])
    assert graph.roots(nodes, e).isEmpty() and graph.roots_of(nodes, e).isEmpty()


def test_release_deletes_what_was_written(spark):
    import os

    nodes, e = frames(spark, [("a", "b")], ["a", "b"])
    assert graph.reachable(nodes, e).count() == 2
    paths = [p.removeprefix("file:") for p in graph._written]
    assert paths and all(os.path.isdir(p) for p in paths)
    graph.release(spark)
    assert not graph._written and not any(os.path.isdir(p) for p in paths)


def test_pairs_are_made_for_files_that_include(spark, monkeypatch):
    """A file that includes nothing ends the walk: no pair of a root and it is made."""
    f, asked, old = spark.createDataFrame, [], graph.closure
    monkeypatch.setattr(graph, "closure", lambda starts, edges: asked.extend(sorted(map(tuple, edges.collect()))) or old(starts, edges))
    records = f([("r", 1, "a", False, None), ("r", 2, "leaf", False, None), ("a", 1, "leaf", False, None), ("a", 2, "gone", False, None), ("a", 3, "a", False, None)], "src string, ordinal int, target string, guarded boolean, testitem int")
    got = graph.include_findings(records, f([("r",), ("a",), ("leaf",)], "node string"), f([("r",)], "node string"))
    assert {(x["src"], x["ordinal"], x["code"]) for x in got.collect()} == {("a", 1, "DuplicateInclude"), ("r", 2, "DuplicateInclude"), ("a", 2, "MissingFile"), ("a", 3, "IncludeLoop")} - {("a", 1, "DuplicateInclude")}
    assert asked == [("a", "a"), ("r", "a")]
