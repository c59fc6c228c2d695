import random

from pyspark.sql import functions as F

from arborq.operators import incremental


def down(edges, starts):
    seen, todo = set(starts), list(starts)
    while todo:
        a = todo.pop()
        for x, b in edges:
            if x == a and b not in seen:
                seen.add(b)
                todo.append(b)
    return seen


def test_differences(spark):
    f = lambda rows: spark.createDataFrame(rows, "node string, h string")
    got = incremental.differences(f([("a", "1"), ("b", "1"), ("c", None), ("d", "1"), ("e", None)]), f([("a", "1"), ("b", "2"), ("c", None), ("e", "1"), ("n", None)]), ["node"], "h").collect()
    assert {x["node"]: x["how"] for x in got} == {"b": "updated", "d": "removed", "e": "updated", "n": "added"}


def test_affected_against_brute_force(spark):
    r = random.Random(4)
    names = [f"n{i}" for i in range(22)]
    before = {(a, b) for a, b in [(r.choice(names), r.choice(names)) for _ in range(20)] if names.index(a) < names.index(b)}
    after = (before - {min(before)}) | {("n0", "n21")}
    contents = [("n3", "updated"), ("n4", "updated"), ("n5", "removed"), ("n30", "added")]
    inventories = [("n4", "updated"), ("n5", "removed")]
    start = {"n4", "n5"} | {a for a, _ in before ^ after}
    above = down({(b, a) for a, b in before | after}, start)
    roots = {a for e in (before, after) for a in above if not any(b == a for _, b in e)}
    files = (down(after, roots | start) | {n for n, _ in contents}) - {"n5"}
    f = spark.createDataFrame
    got_files, got_roots = incremental.affected(f(contents, "node string, how string"), f(inventories, "node string, how string"), f(sorted(before), "src string, dst string"), f(sorted(after), "src string, dst string"))
    assert {x["node"] for x in got_files.collect()} == files and {x["node"] for x in got_roots.collect()} == roots - {"n5"}


def test_only_affected_keys_are_computed(spark):
    table = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3), ("c", 4)], "node string, v int")
    asked = []

    def compute(keys):
        asked.extend(sorted(x["node"] for x in keys.collect()))
        return keys.withColumn("v", F.lit(9))

    got = incremental.merged(table, spark.createDataFrame([("b",), ("n",)], "node string"), compute, spark.createDataFrame([("c",)], "node string"))
    assert asked == ["b", "n"] and sorted(map(tuple, got.collect())) == [("a", 1), ("b", 9), ("n", 9)]


def test_roots_without_the_walk_down(spark, monkeypatch):
    """Roots alone take one walk, up; edges that stay the same are read once."""
    f, walks, old = spark.createDataFrame, [], incremental.graph.stored
    monkeypatch.setattr(incremental.graph, "stored", lambda df: walks.append(df) or old(df))
    edges = f([("r", "a"), ("a", "b"), ("q", "b"), ("x", "y"), ("x", "y"), (None, "b")], "src string, dst string")
    got = incremental.affected_roots(f([("q", "removed")], "node string, how string"), f([("b", "updated")], "node string, how string"), edges, edges)
    assert [x["node"] for x in got.collect()] == ["r"]
    assert len(walks) <= 6
