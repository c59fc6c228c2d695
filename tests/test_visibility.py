import random

import pytest

from arborq.operators import analysis, resolve, visibility

EXPLICIT = "module string, name string, target string, target_name string, ord int"


def by_hand(declared, explicit, wildcard, exports):
    """Rounds and pointers, a name at a time."""
    known = {x for x in declared if None not in x}
    said = {(m, n, t, k, 2, o) for m, n, t, k, o in explicit} | {(m, n, t, n, 1, o) for m, t, o in wildcard for x, n in exports if x == t}
    said = {s for s in said if None not in s[:4] and s[:2] != s[2:4] and s[:2] not in known}
    rounds, k = {p: 0 for p in known}, 0
    while True:
        k += 1
        new = {s[:2] for s in said if rounds.get(s[2:4], k) < k} - rounds.keys()
        if not new:
            break
        rounds |= dict.fromkeys(new, k)
    out = {p: (3, *p) for p in known}
    to = {}
    for p in rounds.keys() - known:
        best = max((tier, -rounds[t, n], o, t, n) for *q, t, n, tier, o in said if tuple(q) == p and (t, n) in rounds)
        to[p] = (best[0], best[3:])
    for p in to:
        at, met = p, set()
        while at in to and at not in met:
            met.add(at)
            at = to[at][1]
        out[p] = (to[p][0], *(at if at in known else (None, None)))
    return out


@pytest.mark.parametrize("seed", range(2))
def test_fixpoint_against_brute_force(spark, seed):
    r = random.Random(seed)
    modules, names = [f"M{i}" for i in range(12)], [f"n{i}" for i in range(6)]
    pick = lambda *of: tuple(r.choice(x) for x in of)
    declared = [pick(modules, names) for _ in range(9)] + [("M1", None), (None, "n1"), ("M1", "n1"), ("M1", "n1")]
    explicit = [(*pick(modules, names, modules, names), r.randrange(4)) for _ in range(25)] + [("M2", "a", "M3", "b", 1), ("M3", "b", "M2", "a", 1), ("M4", "n1", "M4", "n1", 1), ("M5", "gone", "nowhere", "n1", 1), ("M5", None, "M1", "n1", 0)]
    # a circle of explicit imports of a name that a wildcard brings to one of them
    explicit += [("C1", "x", "C2", "x", 1), ("C2", "x", "C1", "x", 1)]
    wildcard = [(*pick(modules, modules), r.randrange(4)) for _ in range(22)] + [("C1", "C0", 1), ("M6", "M6", 1), (None, "M1", 1)]
    exports = [pick(modules, names) for _ in range(40)] + [("C0", "x"), ("C0", "x"), ("M1", None)]
    declared += [("C0", "x")]
    f = spark.createDataFrame
    got = visibility.visible(f(declared, "module string, name string"), f(explicit, EXPLICIT), f(wildcard, "module string, target string, ord int"), f(exports, "module string, name string")).collect()
    want = by_hand(declared, explicit, wildcard, exports)
    assert {(x["module"], x["name"]): (x["tier"], x["item_module"], x["item_name"]) for x in got} == want and len(got) == len(want)
    assert want["C1", "x"] == (2, None, None)


def test_without_rows(spark):
    f = spark.createDataFrame
    assert visibility.visible(f([], "module string, name string"), f([], EXPLICIT), f([], "module string, target string, ord int"), f([], "module string, name string")).isEmpty()


FILES = {
    "/w/Base.jl": "module Base1\nexport deep, Thing\ndeep(x) = x\nstruct Thing end\nend\n",
    "/w/Mid.jl": "module Mid\nusing Base1\nusing Base1: deep as shallow\nexport deep, shallow\nend\n",
    "/w/Top.jl": "module Top\nusing Mid\nimport Mid: Thing as T\nf() = deep(1) + shallow(T)\nend\n",
    "/w/Loop.jl": "module Loop\nusing Mid\nusing LoopTwo\nexport deep, own\nown() = 1\nend\n",
    "/w/LoopTwo.jl": "module LoopTwo\nusing Loop\nexport own, deep\ng() = own() + deep(2)\nend\n",
}


def test_names_that_modules_pass_on(spark):
    files = spark.createDataFrame(list(FILES.items()), "uri string, content string")
    found = analysis.facts(files).persist()
    points = [("/w/Top.jl", FILES["/w/Top.jl"].index("deep(1)")), ("/w/Top.jl", FILES["/w/Top.jl"].index("shallow(T)")), ("/w/Top.jl", FILES["/w/Top.jl"].index("T)")), ("/w/LoopTwo.jl", FILES["/w/LoopTwo.jl"].index("own() +")), ("/w/LoopTwo.jl", FILES["/w/LoopTwo.jl"].index("deep(2)"))]
    got = {(x["name"], x["target_uri"]) for x in resolve.definitions(found, spark.createDataFrame(points, "uri string, offset int")).collect()}
    assert got == {("deep", "/w/Base.jl"), ("shallow", "/w/Base.jl"), ("T", "/w/Base.jl"), ("own", "/w/Loop.jl")}


def test_rounds_send_nothing_whole_to_the_driver(spark):
    """No join of a round is by broadcast, which goes through the driver, however small the tables are."""
    f = spark.createDataFrame
    declared, imports = f([("a", "x")], "module string, name string"), f([("b", "x", "a", "x"), ("c", "x", "b", "x")], "module string, name string, target string, target_name string")
    rounds = visibility.bound(declared, imports)
    assert {tuple(r) for r in rounds.collect()} == {("a", "x", 0), ("b", "x", 1), ("c", "x", 2)}
    explicit = imports.selectExpr("*", "1 AS ord")
    none = f([], "module string, target string, ord int")
    out = visibility.visible(declared, explicit, none, declared)
    assert {tuple(r) for r in out.collect()} == {("a", "x", 3, "a", "x"), ("b", "x", 2, "a", "x"), ("c", "x", 2, "a", "x")}
    store = spark._jsparkSession.sharedState().statusStore()
    got = store.executionsList()
    recent = [got.apply(i).physicalPlanDescription() for i in range(max(0, got.size() - 12), got.size())]
    assert recent and not any("BroadcastHashJoin" in plan for plan in recent)
