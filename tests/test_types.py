import random

from pyspark.sql import functions as F

import __spark_entry__ as entry
from arborq.operators import graph, types


def up_of(rows, t):
    """The way up of a type, by single steps, and whether it gets to Any."""
    by = {}
    for a, b in rows:
        by.setdefault(a, set()).add(b)
    by = {a: next(iter(b)) if len(b) == 1 else None for a, b in by.items() if a not in (None, "Any")}
    way, known = [t], t == "Any"
    while not known and len(way) <= 2**types.DOUBLINGS and by.get(way[-1]) is not None:
        if by[way[-1]] == "Any":
            known = True
        else:
            way.append(by[way[-1]])
    return way, known


def sub(rows, a, b):
    way, known = up_of(rows, a)
    return True if b == "Any" or b in way else False if known else None


def either(x, y):
    return True if x or y else None if x is None or y is None else False


def fits(rows, a, b):
    a, b = ("Any" if a is None else a).split("|"), ("Any" if b is None else b).split("|")
    if "Union" in a + b:
        return True
    out = False
    for x in a:
        for y in b:
            out = either(out, either(sub(rows, x, y), sub(rows, y, x)))
    return out


def hierarchy(r, n=40):
    rows = [(f"t{i}", r.choice(["Any", None, "gone", *[f"t{j}" for j in range(i)]])) for i in range(n)]
    rows += [("loop1", "loop2"), ("loop2", "loop1"), ("two", "t1"), ("two", "t2"), ("same", "t1"), ("same", "t1"), (None, "t1"), ("t3", None)]
    return rows + [(f"d{i}", f"d{i + 1}") for i in range(50)] + [("d50", "Any")]


def test_ways_up(spark):
    rows = hierarchy(random.Random(1))
    got = {x["type"]: (x["up"], x["known"]) for x in types.chains(spark.createDataFrame(rows, "type string, super string")).collect()}
    assert set(got) == {a for a, _ in rows if a} | {"Any"}
    for t, (way, known) in got.items():
        want, sure = up_of(rows, t)
        assert known == sure and (way == want or not known and len(way) >= len(want)), t
    assert got["d0"][1] is False and got["d40"][1] is True
    empty = types.chains(spark.createDataFrame([], "type string, super string")).collect()
    assert [x["type"] for x in empty] == ["Any"]


def test_three_answers(spark):
    r = random.Random(2)
    rows = hierarchy(r)
    names = [f"t{i}" for i in range(40)] + ["Any", "gone", "never", "loop1", "two", "Union", None, "t1|t5", "gone|t2", "d3", "d45"]
    pairs = [(r.choice(names), r.choice(names)) for _ in range(900)]
    ways = types.chains(spark.createDataFrame(rows, "type string, super string"))
    df = spark.createDataFrame([(i, list(p)) for i, p in enumerate(pairs)] + [(-1, None), (-2, [])], "i int, both array<string>")
    out = types.typed(df, "both", ways, "t").select("i", types.compatible(F.get("t", 0), F.get("t", 1)).alias("ok"), F.size("t").alias("n")).collect()
    got = {x["i"]: x["ok"] for x in out}
    assert {i: got[i] for i in range(len(pairs))} == {i: fits(rows, *p) for i, p in enumerate(pairs)}
    assert set(got.values()) == {True, False, None} and got[-1] is None and {x["n"] for x in out if x["i"] == -2} == {0}


CALLS = "i int, callee string, args array<string>, kws array<string>, splat boolean"
METHODS = "m int, callee string, sig array<string>, required int, tail string, tail_n int, kws array<string>, kwsplat boolean"


def may_take(rows, call, method):
    _, _, args, kws, splat = call
    _, _, sig, required, tail, tail_n, mkws, kwsplat = method
    n, k = len(args), len(sig)
    required = k if required is None else required
    most = k if tail is None else k + tail_n if tail_n is not None else None
    least = k + tail_n if tail_n is not None and tail is not None else required
    if splat:
        if most is not None and n > most:
            return False
    elif n < least or most is not None and n > most:
        return False
    if not kwsplat and set(kws or []) - set(mkws or []):
        return False
    places = sig + [tail] * max(0, n - k) if tail is not None else sig
    return all(fits(rows, a, p) is not False for a, p in zip(args, places))


def test_match_against_all_pairs(spark):
    r = random.Random(3)
    rows = hierarchy(r)
    names = [f"t{i}" for i in range(40)] + ["Any", "gone", None, "t1|t5", "Union"]
    some = lambda n: [r.choice(names) for _ in range(r.randrange(n))]
    calls = [(i, r.choice("fgh"), some(5), r.choice([None, [], ["a"], ["a", "b"]]), r.choice([False, False, False, True, None])) for i in range(250)] + [(999, "nobody", [], None, None)]
    methods = []
    for m in range(40):
        sig, tail = some(4), r.choice([None, None, "t1", "Any", "gone"])
        methods.append((m, r.choice("fgh"), sig, r.choice([None, max(0, len(sig) - 1)]), tail, r.choice([None, 0, 2]) if tail else None, r.choice([None, ["a"], ["a", "b", "c"]]), r.choice([None, True, False])))
    ways = types.chains(spark.createDataFrame(rows, "type string, super string"))
    c, m = types.prepared_calls(spark.createDataFrame(calls, CALLS), ways), types.prepared_methods(spark.createDataFrame(methods, METHODS), ways)
    want = {(x[0], y[0]) for x in calls for y in methods if x[1] == y[1] and may_take(rows, x, y)}
    found = types.matches(c, m, "m")
    assert {(x["i"], x["m"]) for x in found.collect()} == want
    known = {y[1] for y in methods}
    assert {x["i"] for x in types.unmatched(c, m).collect()} == {x[0] for x in calls if x[1] in known} - {i for i, _ in want}
    by = {y[0]: y for y in methods}

    def below(a, b):
        return len(a) == len(b) and all(all(any(sub(rows, s, t) for t in ("Any" if q is None else q).split("|")) for s in ("Any" if p is None else p).split("|")) for p, q in zip(a, b))

    best = {x["i"]: x["methods"] for x in types.most_special(found, ["i"], "m").collect()}
    for i in best:
        mine = [m for j, m in want if j == i]
        assert best[i] == sorted(m for m in mine if not any(below(by[o][2], by[m][2]) and not below(by[m][2], by[o][2]) for o in mine))
    assert set(best) == {i for i, _ in want}


def test_inference_against_a_worklist(spark):
    r = random.Random(4)
    names = [f"b{i}" for i in range(60)]
    literals = [(r.choice(names), f"T{r.randrange(6)}") for _ in range(25)] + [("b1", None), (None, "T1"), ("b2", "T0"), ("b2", "T0")]
    assigns = [(r.choice(names), r.choice(names)) for _ in range(55)] + [("b5", "b5"), ("b6", None), ("b7", "b8"), ("b8", "b7")]
    calls, returns = [("b9", "f"), ("b10", "g"), ("b11", None)], [("f", "T9"), ("f", "T8"), (None, "T1")]
    for width in (1, 3):
        want = {n: set() for n in names}
        base = [(b, t) for b, t in literals if b and t] + [(b, t) for b, f in calls for g, t in returns if f == g and f and t]
        changed = True
        for b, t in base:
            want[b].add(t)
        while changed:
            changed = False
            for b in names:
                new = set(want[b]).union(*[want[s] for x, s in assigns if x == b and s])
                new = {"Any"} if len(new) > width or "Any" in new else new
                changed |= new != want[b]
                want[b] = new
        f = lambda rows, schema: spark.createDataFrame(rows, schema)
        got = types.inferred(f([(n,) for n in names], "binding string"), f(literals, "binding string, type string"), f(assigns, "binding string, source string"), f(calls, "binding string, callee string"), f(returns, "callee string, type string"), width)
        assert {x["binding"]: set(x["types"]) for x in got.collect()} == want


FACTS = "scope bigint, binding string, type string, source string"


def test_inference_within_scopes(spark, monkeypatch):
    """The same types as by joins, in whatever portions scopes come; nulls, loops, repeated rows, TOP written down, a scope over the limit."""
    monkeypatch.setattr(types, "TOGETHER", 7)
    r = random.Random(8)
    some = lambda s: f"b{r.randrange(4 + s % 9)}"
    rows = [(s, some(s), r.choice([None, None, None, f"T{r.randrange(7)}"]), r.choice([None, some(s), some(s)])) for s in range(60) for _ in range(1 + s % 14)]
    rows += [(60, "a", "T1", "b"), (60, "b", "T2", "a"), (60, "a", "T1", "b"), (60, "b", None, "nowhere"), (61, "a", "Any", None), (61, "b", "T1", "a"), (62, None, "T1", "a"), (62, "a", None, None), (63, "é", "Tä", None), (63, "e", "T\U0001f600", "é"), (63, "e", "T\uffff", None)]
    rows += [(64, f"b{i}", "T1" if i == 0 else None, f"b{i - 1}" if i else None) for i in range(14)]
    facts = spark.createDataFrame(rows + [(None, "a", "T1", None), (None, "b", None, "a")], FACTS).repartition(3)
    flat = [(None if b is None else f"{s} {b}", t, x and f"{s} {x}") for s, b, t, x in rows]
    plain = spark.createDataFrame(flat, "binding string, type string, source string")
    none = spark.createDataFrame([], "binding string, callee string, type string")
    for width, limit in ((1, 1000), (3, 1000), (3, 12)):
        monkeypatch.setattr(types, "SCOPE", limit)
        want = sorted((x["binding"], x["types"]) for x in types.inferred(plain, plain, plain, none, none, width).where("binding is not null").collect())
        got = types.inferred_within(facts, width).collect()
        assert sorted((f"{x['scope']} {x['binding']}", x["types"]) for x in got if x["scope"] is not None) == want
        assert sorted((x["binding"], x["types"]) for x in got if x["scope"] is None) == [("a", []), ("b", [])]
    assert types.inferred_within(facts.where("false")).collect() == []


def test_inferred_types_of_long_orders(spark, tmp_path):
    """A line hands its type on to all lines after it, in any order's length without a table for each step."""
    lines = [(o, 1, 1, i, 40.0 if i == 1 else 20.0, float(i)) for o in (10, 11) for i in range(1, 41)] + [(11, 1, 2, 41, 1.0, 0.0), (20, 5, 3, 1, 50.0, 0.0), (12, 1, 2, None, 40.0, 0.0), (12, 1, 1, 1, 20.0, 0.0), (None, 1, 1, 1, 40.0, 0.0)]
    spark.createDataFrame(lines, "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    before = len(graph._written)
    got = {(x["l_orderkey"], x["line"]): x["types"] for x in entry.queries()["inferred_types"](spark, str(tmp_path)).collect()}
    assert got == {(o, i): "T1" for o in (10, 11) for i in range(1, 41)} | {(11, 41): "T1", (20, 1): "T3", (12, 1): "", (12, 2): "T2", (None, 1): ""}
    assert len(graph._written) == before
