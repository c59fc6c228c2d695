import hashlib
import random
import re

from pyspark.sql import functions as F

from arborq.llm import lines
from tests.llm.helpers import documents, odd_texts


def key(line):
    return re.sub(r"^[\x20\x09-\x0d]+|[\x20\x09-\x0d]+$", "", line).encode().lower()


def by_hand(texts, min_docs, min_chars=1):
    docs = {}
    for i, t in enumerate(texts):
        for k in {key(x) for x in (t or "").split("\n")}:
            docs.setdefault(k, set()).add(i)
    gone = {k for k, d in docs.items() if len(d) >= min_docs and len(k.decode()) >= min_chars}
    out = {}
    for i, t in enumerate(texts):
        own = (t or "").split("\n")
        left = [x for x in own if key(x) not in gone]
        out[i] = (len(own), len(own) - len(left), "\n".join(left))
    return out


def found(df):
    return {r["doc_id"]: (r["n_lines"], r["n_dropped"], r["text"]) for r in df.collect()}


def test_against_brute_force(spark):
    r = random.Random(4)
    pool = ["Hot line", " hot LINE\t", "warm", "é warm", "É warm", "", "  "] + [f"line {i}" for i in range(40)]
    texts = odd_texts() + ["\n".join(r.choices(pool, k=r.randint(0, 12))) for _ in range(120)] + ["twice\ntwice"] * 3
    for min_docs, batches in ((1, 2), (3, 1), (5, 4), (10, 7)):
        got = found(lines.drop_common_lines(documents(spark, texts, extra=True), min_docs, batches=batches))
        assert got == by_hand(texts, min_docs)


def test_extra_columns_stay(spark):
    df = documents(spark, ["a\nb", "a\nc"], extra=True)
    assert lines.drop_common_lines(df, 2).columns == [*df.columns, "n_lines", "n_dropped"]


def test_empty_and_repeated_rows(spark):
    assert lines.drop_common_lines(documents(spark, [])).count() == 0
    df = spark.createDataFrame([(1, "a\nb"), (1, "a\nb"), (1, "c\na"), (None, "a")], "doc_id long, text string")
    assert sorted(r["text"] for r in lines.drop_common_lines(df, 3).collect()) == ["", "b", "b", "c"]


def test_runs_are_levelled_and_find_what_is_new(spark):
    index = lines.LineRuns(spark, settled=10, fanout=2)
    seen = {}
    for b in range(5):
        rows = [(k, k, 1) for k in range(b * 3, b * 3 + 6)] + [(1000, 1000, 4)]
        batch = spark.createDataFrame(rows, "h1 long, h2 long, n_docs long")
        assert {r["h1"] for r in index.novel(batch).collect()} == {k for k, _, _ in rows} - seen.keys()
        index.add(batch)
        for k, _, n in rows:
            seen[k] = seen.get(k, 0) + n
        for least in (1, 2, 5, 9, 10):
            got = [r["h1"] for r in index.held(least).collect()]
            assert sorted(got) == sorted(k for k, n in seen.items() if n >= least)
    assert [len(x) for x in index.levels] == [1, 0, 1]  # five batches: 4 + 1
    index.close()


def test_runs_are_not_shuffled(spark):
    """Of a batch and two runs, only the batch is dealt anew; runs are merge joined by their buckets."""
    index = lines.LineRuns(spark, settled=10, fanout=3)
    batch = spark.range(1000).select("id", F.col("id").alias("h1"), F.col("id").alias("h2")).groupBy("h1", "h2").agg(F.count("*").alias("n_docs"))
    index.add(batch)
    index.add(batch)
    plan = index.novel(batch)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("SortMergeJoin") == 2 and plan.count("Exchange") == 1, plan
    index.close()


def test_columns_with_the_names_of_helpers(spark):
    df = documents(spark, ["a\nb", "a\nc"])
    names = ["row", "lines", "gone", "id_of", "mark_of", "mark", "__id", "__gone", "__mark", "__lines", "Row", "n_lines_"]
    df = df.withColumns({c: F.lit(f"extra {c}") for c in names if c != "Row"})
    out = lines.drop_common_lines(df, 2)
    assert out.columns == [*df.columns, "n_lines", "n_dropped"]
    assert [r["text"] for r in out.orderBy("doc_id").collect()] == ["b", "c"] and all(r["gone"] == "extra gone" for r in out.collect())


def test_copies_can_count_once(spark):
    texts = ["One\n\ntwo"] * 6 + ["one\n\nTWO"] * 6 + [f"two\nown {i}" for i in range(3)] + ["two"]
    df = documents(spark, texts)
    got = found(lines.drop_common_lines(df, 5, copies_once=True))
    assert all(got[i] == (3, 1, "One\n" if i < 6 else "one\n") for i in range(12)) and got[15] == (1, 1, "")  # five texts have "two"
    assert found(lines.drop_common_lines(df, 6, copies_once=True)) == {i: (t.count("\n") + 1, 0, t) for i, t in enumerate(texts)}


def test_query_digest(spark):
    df = lines.drop_common_lines(documents(spark, ["é\nx"]), 1)
    assert hashlib.sha256(df.collect()[0]["text"].encode()).hexdigest() == hashlib.sha256(b"").hexdigest()
