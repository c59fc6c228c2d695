import itertools
import random

from pyspark.sql import functions as F

from arborq.operators import versions

ORDER = ["0.0.1", "0.1.0-alpha", "0.1", "1.0.0-1", "1.0.0-2", "1.0.0-11", "1.0.0-alpha", "1.0.0-alpha.1", "1.0.0-alpha.beta", "1.0.0-beta", "1.0.0-beta.2", "1.0.0-beta.11", "1.0.0-rc.1", "1.0.0", "1.0.1-rc1", "1.0.1", "1.2.10", "1.10", "2-a", "2", "10.0.0"]


def test_order_of_versions(spark):
    shuffled = ORDER[:]
    random.Random(1).shuffle(shuffled)
    df = spark.createDataFrame([(v,) for v in shuffled], "v string")
    assert [r["v"] for r in df.orderBy(versions.version(F.col("v"))).collect()] == ORDER
    odd = ["", "x", "1.", "1.2.3.4", None, "1.2.x", "-1", "1." + "9" * 30]
    assert {r[0] for r in spark.createDataFrame([(v,) for v in odd], "v string").select(versions.version(F.col("v"))).collect()} == {None}
    same = spark.createDataFrame([("1.0", "v1.0.0+build")], "a string, b string").select(versions.version(F.col("a")) == versions.version(F.col("b"))).head()[0]
    assert same


def bounds(text):
    """(low, high) by hand."""
    if text.strip() == "*":
        return (0, 0, 0), (versions.TOP, 0, 0)
    low, _, high = (x.strip().removeprefix("v") for x in text.partition("-"))
    n = lambda x: [int(y) for y in x.split(".")]
    top = n(high or low)
    top[-1] += 1
    return tuple((n(low) + [0, 0])[:3]), tuple((top + [0, 0])[:3])


RANGES = ["1", "1.2", "1.2.3", "0.5-0.8", "1.6-1", "0.3.2 - 0.3", "*", "1.2-1.5.9", "2-1", "0", "1.4.0-1.9", "v1.1-v1.3"]


def held(texts, v):
    return any(low <= v < high for low, high in map(bounds, texts))


def test_sets_against_points(spark):
    r = random.Random(2)
    points = [(a, b, c) for a in range(3) for b in (0, 1, 2, 3, 4, 5, 6, 8, 9, 10) for c in (0, 2, 3, 4, 9)]
    cases = [(r.sample(RANGES, r.randrange(4)), r.sample(RANGES, r.randrange(4))) for _ in range(60)]
    df = spark.createDataFrame([(i, a + ["rubbish", None, "1.2.3.4"][: i % 4], b) for i, (a, b) in enumerate(cases)], "i int, a array<string>, b array<string>")
    got = df.select("i", versions.spec(F.col("a")).alias("a"), versions.intersect(versions.spec(F.col("a")), versions.spec(F.col("b"))).alias("both")).collect()
    for x in got:
        a, b = cases[x["i"]]
        for name, want in (("a", lambda p: held(a, p)), ("both", lambda p: held(a, p) and held(b, p))):
            s = [(tuple(i["low"]), tuple(i["high"])) for i in x[name]]
            assert [p for p in points if any(low <= p < high for low, high in s)] == [p for p in points if want(p)], (a, b, name)
            assert all(low < high for low, high in s) and all(h < low for (_, h), (low, _) in itertools.pairwise(s))


def test_compatibility(spark):
    vs = [("A", "1.0.0"), ("A", "1.2.0"), ("A", "1.2.0"), ("A", "2.0.0-rc1"), ("A", "odd"), ("B", "0.1.0"), (None, "1.0")]
    compat = [("A", "1", ["1.6-1"]), ("A", "1.2-2", ["1.0-1.8", "2"]), ("A", "1-3", ["rubbish", "1"]), ("A", "nonsense", ["9"]), ("C", "1", ["1"]), (None, "1", ["1"])]
    df = spark.createDataFrame(vs, "name string, version string").withColumn("allowed_by", F.lit(1))
    got = versions.compatibility(df, spark.createDataFrame(compat, "name string, for_versions string, works_with array<string>"), ["name"])
    rows = [(r["name"], r["version"], r["text"]) for r in got.withColumn("text", versions.shown(F.col("allowed"))).collect()]
    assert sorted(rows, key=str) == sorted([("A", "1.0.0", "1.6.0 to 2.0.0"), ("A", "1.2.0", "1.6.0 to 1.9.0"), ("A", "1.2.0", "1.6.0 to 1.9.0"), ("A", "2.0.0-rc1", "1.0.0 to 1.9.0"), ("A", "odd", None), ("B", "0.1.0", None), (None, "1.0", None)], key=str)
    best = lambda v: {r["name"]: r["version"] for r in versions.newest_for(got.where("name IS NOT NULL"), "allowed", versions.version(F.lit(v)), ["name"]).collect()}
    assert best("1.7.2") == {"A": "2.0.0-rc1", "B": "0.1.0"} and best("1.9.5") == {"A": "1.0.0", "B": "0.1.0"} and best("3") == {"B": "0.1.0"}
    assert versions.compatibility(df.limit(0), spark.createDataFrame(compat, "name string, for_versions string, works_with array<string>"), ["name"]).count() == 0
