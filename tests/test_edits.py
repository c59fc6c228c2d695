import random

from pyspark.sql import functions as F

from arborq.operators import edits
from arborq.workspace import Workspace

EDITS = "uri string, start int, stop int, text string, rank int"


def by_hand(rows):
    files = {}
    for u, a, b, t, k in rows:
        key = (a, b, t or "")
        files.setdefault(u, {})
        files[u][key] = min(files[u].get(key, k), k)
    out = {}
    for u, own in files.items():
        taken, refused, upto = [], [], 0
        good = [(a, b, k, t) for (a, b, t), k in own.items() if u is not None and a is not None and b is not None and 0 <= a <= b]
        bad = [(a, b, t, k) for (a, b, t), k in own.items() if (a, b, k, t) not in good]
        for a, b, k, t in sorted(good):
            if a >= upto:
                taken.append((a, b, t, k))
                upto = b
            else:
                refused.append((a, b, t, k))
        out[u] = (taken, sorted(refused + bad, key=str))
    return out


def random_edits(r, n, size=30):
    rows = []
    for _ in range(n):
        a = r.randrange(size)
        rows.append((f"/f{r.randrange(6)}", a, r.choice([a, a, a + r.randrange(6)]), r.choice(["x", "new", "", None, "é"]), r.randrange(3)))
    return rows + [("/f1", None, 3, "x", 0), ("/f1", 5, 2, "x", 0), ("/f1", -1, 2, "x", 0), (None, 0, 1, "x", 0)]


def test_composition_against_a_scan(spark):
    r = random.Random(1)
    rows = random_edits(r, 90)
    plan = edits.composed(spark.createDataFrame(rows, EDITS), F.col("rank"))
    got = {x["uri"]: ([tuple(e) for e in x["taken"]], sorted([tuple(e) for e in x["refused"]], key=str)) for x in plan.collect()}
    assert got == by_hand(rows)
    assert edits.conflicts(plan).count() == sum(len(x) for _, x in by_hand(rows).values())
    assert edits.composed(spark.createDataFrame([], EDITS)).count() == 0


def test_application(spark):
    r = random.Random(2)
    texts = {f"/f{i}": "".join(r.choice("abcdé漢𝄞\n") for _ in range(20)) for i in range(5)} | {"/none": None, "/other": "x"}
    rows = random_edits(r, 60, 25) + [("/none", 0, 0, "in", 0), ("/gone", 0, 0, "x", 0)]
    plan = edits.composed(spark.createDataFrame(rows, EDITS), F.col("rank"))
    files = spark.createDataFrame(list(texts.items()), "uri string, content string")
    got = {x["uri"]: (x["content"], x["n_edits"]) for x in edits.applied(files, plan).collect()}
    want = {}
    for u, (taken, _) in by_hand(rows).items():
        if u in texts:
            text, n = texts[u] or "", 0
            for a, b, t, _ in reversed(taken):
                if b <= len(texts[u] or ""):
                    text, n = text[:a] + t + text[b:], n + 1
            want[u] = (text, n)
    assert got == want and got["/none"] == ("in", 1)


CODE = "module P\nfunction f(a, unused::Int, other)\n    never = 1\n    a == nothing && a != nothing\n    return known(a) + twice(a)\nend\nend\n"


def test_actions_are_applied_and_read_back(spark):
    w = Workspace(spark, spark.createDataFrame([("/p.jl", CODE, "julia", 1, True), ("/q.jl", "f(x, y::T) = x == nothing\n", "julia", 1, True)], "uri string, content string, language_id string, revision long, is_regular boolean"))
    w.environment = spark.createDataFrame([("Base", "nothing"), ("Base", "Int"), ("Base", "=="), ("Base", "!="), ("Base", "&&"), ("Base", "+")], "package string, name string")
    w.available = spark.createDataFrame([("Known", "known"), ("A", "twice"), ("B", "twice")], "package string, name string")
    refused = w.apply_actions()
    assert refused.count() == 0
    got = {x["uri"]: x["content"] for x in w.files.collect()}
    assert got["/p.jl"] == "using Known: known\n" + CODE.replace("unused::Int", "::Int").replace("other", "_").replace("never", "_").replace("a == nothing", "a === nothing").replace("a != nothing", "a !== nothing")
    assert got["/q.jl"] == "f(x, ::T) = x === nothing\n"
    w.refresh()
    again = w.findings().where("rule_id IN ('unused_binding', 'unused_function_argument', 'nothing_comparison')")
    assert again.count() == 0
    w.apply_actions("ReplaceUnusedAssignmentName")
    assert {x["uri"]: x["content"] for x in w.files.collect()} == got


def test_texts_are_edited_a_few_at_a_time():
    """12 texts of a million characters came out of a task as one batch; now a batch ends after two million."""
    import pyarrow as pa

    from arborq.operators import edits

    edit = {"start": 1, "stop": 2, "text": "é", "rank": 0}
    batch = pa.RecordBatch.from_pylist([{"uri": str(i), "content": None if i == 11 else "x" * 1_000_000, "taken": [edit]} for i in range(12)])
    got = list(edits.edited_batches([batch]))
    rows = [r for b in got for r in b.to_pylist()]
    assert max(b.num_rows for b in got) == 3 and [r["uri"] for r in rows] == [str(i) for i in range(12)]
    assert rows[0]["content"][:3] == "xéx" and rows[0]["n_edits"] == 1 and rows[11]["refused"] == [edit]
