import hashlib
import random

from arborq.llm import exact
from tests.llm.helpers import documents, odd_texts


def by_hand(texts):
    groups = {}
    for i, t in enumerate(texts):
        groups.setdefault((t or "").encode().lower(), []).append(i)
    return {i: (max(g), len(g), i == max(g), hashlib.sha256(t).hexdigest()) for t, g in groups.items() for i in g}


def found(df):
    return {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) for r in df.collect()}


def test_odd_texts_and_hot_groups(spark):
    r = random.Random(1)
    texts = odd_texts() + [r.choice(["hot", "HOT", "Warm", f"one {i}", f"few {i % 9}"]) for i in range(600)]
    for counters in (1, 3, 1024):
        assert found(exact.exact_groups(documents(spark, texts, extra=True), counters)) == by_hand(texts)


def test_empty_table(spark):
    assert exact.exact_groups(documents(spark, [])).count() == 0


def test_rows_that_share_an_id(spark):
    df = spark.createDataFrame([(5, "a"), (5, "A"), (None, "a"), (None, None), (None, "")], "doc_id long, text string")
    got = exact.exact_groups(df).collect()
    assert sorted((r["keep_id"], r["group_size"], r["kept"]) for r in got if r["group_size"] == 3) == [(5, 3, False), (5, 3, False), (5, 3, True)]
    assert sorted((r["keep_id"], r["kept"]) for r in got if r["group_size"] == 2) == [(None, False), (None, True)]


def test_summary_keeps_every_frequent_digest(spark):
    r = random.Random(2)
    values = [b"x"] * 300 + [b"y"] * 260 + [r.randbytes(4) for _ in range(900)]
    r.shuffle(values)
    df = spark.createDataFrame([(bytearray(v),) for v in values], "digest binary").repartition(7)
    for k in (4, 5, 20):
        got = {bytes(x["digest"]) for x in exact.frequent_digests(df, k).collect()}
        assert {v for v in set(values) if values.count(v) > len(values) / (k + 1)} <= got and len(got) <= k
