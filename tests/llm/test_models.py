import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from arborq.llm import lang, lm, mixing
from tests.llm.helpers import documents, odd_texts, words

SYLLABLES = {"aa": "ba be bi bo bu", "bb": "zok zak zuk zek", "cc": "élé ère éau ois"}


def text_in(r, language, n=40):
    return " ".join("".join(r.choices(SYLLABLES[language].split(), k=r.randint(1, 3))) for _ in range(n)).capitalize() + "."


def labelled(spark, n=300):
    r = random.Random(1)
    rows = [(i, text_in(r, x, r.randint(3, 60)), x) for i, x in enumerate(r.choices(list(SYLLABLES), k=n))]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), rows


def test_language_of_held_out_texts(spark):
    df, rows = labelled(spark)
    filters = lang.train(df.where(~lang.held_out(F.col("doc_id"))), docs_per_lang=40)
    assert filters.langs == sorted(SYLLABLES) and (filters.false_rates < 0.01).all()
    got = {r["doc_id"]: r for r in lang.predict(df.withColumn("score", F.lit("extra")), filters).collect()}
    right = [got[i]["lang_pred"] == x for i, _, x in rows]
    assert np.mean(right) > 0.98
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_filters_hold_all_their_grams():
    codes = np.random.default_rng(1).integers(0, 2**32, 3000, dtype=np.uint32)
    for n in (2, 8, 9, 70):
        masks = [np.arange(3000) % n == i for i in range(n)]
        f = lang.Filters.build([f"l{i}" for i in range(n)], codes, masks)
        width = f.words.itemsize * 8
        found = [f.words[lang.slots_of(codes, k)] for k in range(lang.HASHES)]
        for i in range(n):
            has = np.ones(3000, bool)
            for w in found:
                has &= (w[:, i // width] >> f.words.dtype.type(i % width) & f.words.dtype.type(1)).astype(bool)
            assert has[masks[i]].all() and has[~masks[i]].mean() < 0.05


def test_texts_without_letters_and_no_labels(spark):
    df, _ = labelled(spark, 60)
    filters = lang.train(df.unionByName(spark.createDataFrame([(900, None, "aa"), (901, "x", None)], df.schema)))
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in lang.predict(documents(spark, odd_texts(), extra=True), filters).collect()}
    assert all(got[i] == ("und", 0.0) for i in range(7))
    assert all(got[i][0] in SYLLABLES for i in range(7, len(got)))
    none = lang.train(df.where("lang is null"))
    assert {r["lang_pred"] for r in lang.predict(df, none).collect()} == {"und"}
    assert lang.predict(documents(spark, []), filters).count() == 0


def test_held_out_is_the_contracts(spark):
    import zlib

    got = {r["i"]: r["h"] for r in spark.range(200).select(F.col("id").alias("i"), lang.held_out(F.col("id")).alias("h")).collect()}
    assert all(h == (zlib.crc32(str(i).encode()) % 4 == 2) for i, h in got.items())


def test_network_gradients_and_probabilities():
    n = lm.Network.new()
    r = np.random.default_rng(1)
    stream, at = lm.streamed([r.integers(0, 3000, 50).astype(np.uint16), np.zeros(0, np.uint16), r.integers(0, 3000, 7).astype(np.uint16)], np.arange(65536, dtype=np.int32))
    assert len(at) == 57
    h, _ = n.hidden(lm.ROWS[stream], at[:3])
    frequent = sum(np.exp(n._log_probs(h, np.full(3, i))) for i in range(lm.OUTPUTS - 1))
    rare = sum(np.exp(n._log_probs(h, np.full(3, lm.OUTPUTS - 1 + i))) for i in range(lm.RARE_CLASSES))
    assert np.allclose(frequent + rare, 1, atol=1e-3) and (rare > 0).all()
    before = n.log_probs(stream, at)
    squares = [np.full(x.shape, 1e-8, np.float32) for x in n.parts()]
    for _ in range(30):
        n.train(stream, at, squares)
    after, is_rare = n.log_probs(stream, at), stream[at] >= lm.OUTPUTS - 1
    assert is_rare.any() and after.mean() > before.mean() + 2 and after[is_rare].mean() > before[is_rare].mean() + 2
    assert (lm.Network.of(n.vector()).vector() == n.vector()).all()


def test_steps_follow_the_gradient():
    """The first step against differences of the loss, for some of each part's parameters."""
    r = np.random.default_rng(2)
    stream, at = lm.streamed([r.integers(0, 2600, 300).astype(np.uint16)], np.arange(65536, dtype=np.int32))
    n, stepped = lm.Network.new(), lm.Network.new()
    squares = [np.zeros(x.shape, np.float32) for x in n.parts()]
    stepped.train(stream, at, squares)
    loss = lambda: -n.log_probs(stream, at).astype(np.float64).mean()
    for part, squared in zip(n.parts(), squares, strict=True):
        flat, size = part.reshape(-1), np.sqrt(squared.reshape(-1))
        for i in np.argsort(-size)[:5]:
            old, step = flat[i], np.float32(0.02)
            flat[i] = old + step
            up = loss()
            flat[i] = old - step
            down = loss()
            flat[i] = old
            assert abs(abs(up - down) / (2 * step) - size[i]) < 0.1 * size[i] + 1e-4


def test_held_out_texts_against_counts(spark):
    """Of texts that it hasn't seen the network tells more than counts of ids do."""
    r = random.Random(6)
    follows = {i: r.sample(range(60), 3) for i in range(60)}

    def text():
        at, out = r.randrange(60), []
        for _ in range(80):
            at = r.choice(follows[at])
            out.append(f"{'bcdfghjklm'[at % 10]}{'aeiouy'[at // 10]}t")
        return " ".join(out)

    tokens = lm.token_table(documents(spark, [text() for _ in range(300)]).select("doc_id", "text").repartition(2))
    rank, share = lm.ranks(tokens)
    scorer = lm.Scorer(rank, share, lm.trained(tokens, rank, rounds=16, stride=1))
    held = lm.token_table(documents(spark, [text() for _ in range(40)]))
    counts = np.ones(65536)
    for x in tokens.collect():
        counts += np.bincount(np.frombuffer(x["ids"], np.uint16), minlength=65536)
    p = np.log(counts / counts.sum())
    alone = np.mean([p[np.frombuffer(x["ids"], np.uint16)].mean() for x in held.collect()])
    assert np.mean([x["mean_log_prob"] for x in lm.score(held, scorer).collect()]) > alone + 0.5


def test_learned_order_scores_above_shuffled(spark):
    r = random.Random(2)
    chain = [f"tok{i}" for i in range(30)]

    def sentence():
        at = r.randrange(30)
        return " ".join(chain[(at + k) % 30] for k in range(60))

    texts = [sentence() for _ in range(200)]
    odd = ["", None] + [" ".join(r.sample(t.split(), 60)) for t in texts[:20]]
    tokens = lm.token_table(documents(spark, texts + odd, extra=True).select("doc_id", "text").repartition(3))
    rank, share = lm.ranks(tokens)
    scorer = lm.Scorer(rank, share, lm.trained(tokens, rank, rounds=25, stride=1))
    got = {x["doc_id"]: x for x in lm.score(tokens, scorer).collect()}
    good, bad = np.mean([got[i]["mean_log_prob"] for i in range(200)]), np.mean([got[i]["mean_log_prob"] for i in range(202, 222)])
    assert good > bad + 0.3
    assert all((got[i]["n_tokens"], got[i]["log_prob"], got[i]["mean_log_prob"]) == (0, 0.0, None) for i in (200, 201))


def test_scores_of_no_and_of_odd_texts(spark):
    tokens = lm.token_table(documents(spark, []))
    assert lm.score(tokens, lm.fit(tokens)).count() == 0
    tokens = lm.token_table(documents(spark, odd_texts()))
    got = lm.score(tokens, lm.fit(tokens)).collect()
    assert len(got) == len(odd_texts()) and all(x["log_prob"] <= 0 for x in got)


def test_every_place_trains():
    sizes = [1, 0, 2, 3, 7, 50]
    documents_ = [np.zeros(n, np.uint16) for n in sizes]
    times = sum(lm.in_round(documents_, turn, lm.STRIDE).astype(int) for turn in range(lm.ROUNDS))
    assert len(times) == sum(sizes) and (times == lm.ROUNDS // lm.STRIDE).all() and times.min() > 0


def test_every_id_counts_once(spark):
    tokens = lm.token_table(documents(spark, ["a b", "b", None]))
    rank, share = lm.ranks(tokens)
    assert sorted(rank) == list(range(65536)) and (share[: lm.OUTPUTS - 1] == 0).all()
    in_class = lm.rare_class(np.arange(lm.OUTPUTS - 1, 65536))
    assert np.allclose(np.bincount(in_class, np.exp(share[lm.OUTPUTS - 1 :])), 1)


@pytest.fixture(scope="module")
def mixture(spark):
    r = random.Random(3)
    texts, labels = [], []
    for i in range(400):
        kind = r.choices(["good", "plain", "toxic"], [6, 3, 1])[0]
        own = words(r, r.randint(20, 80))
        own = own + ["idiot"] if kind == "toxic" else [w + "!!" for w in own] if kind == "plain" else own
        r.shuffle(own)
        texts.append(" ".join(own))
        labels.append((i, int(kind != "plain"), int(kind == "toxic")))
    return texts, labels


def test_rates_meet_their_targets(spark, mixture):
    texts, labels = mixture
    docs = documents(spark, [*texts, *odd_texts()])
    c = mixing.fit_classifier(mixing.labelled_domains(docs, spark.createDataFrame([*labels, (None, 1, 1), (5000, 1, 0), (401, None, None)], "doc_id long, quality int, toxic int")), sorted(mixing.TARGETS))
    members = mixing.posteriors(docs.withColumn("rate", F.lit("extra")).select("doc_id", "text", "rate"), c).select("doc_id", "n_tokens", "posterior", "rate")
    total = mixing.total_tokens(members, 3).sum()
    rows = mixing.fit_rates(members, np.array([0.5, 0.45, 0.05]) * total, steps=200).collect()
    p, n, rate = np.array([r["posterior"] for r in rows]), np.array([r["n_tokens"] for r in rows]), np.array([r["rate"] for r in rows])
    assert len(rows) == len(texts) + len(odd_texts()) and (rate >= 0).all() and np.allclose(p.sum(1), 1)
    assert np.allclose((rate * n) @ p / total, [0.5, 0.45, 0.05], atol=0.01)
    want = ["plain" if q == 0 else "toxic" if t else "good" for _, q, t in labels]
    by_id = {r["doc_id"]: r for r in rows}
    assert np.mean([c.domains[int(np.argmax(by_id[i]["posterior"]))] == w for i, w in enumerate(want)]) > 0.95


def test_rates_are_the_optimum():
    """Against plain projected gradient run to the end on the driver."""
    r = np.random.default_rng(1)
    p, n = r.dirichlet([0.3] * 3, 200), r.integers(1, 100, 200).astype(float)
    total, target = n.sum(), np.array([0.7, 0.2, 0.1]) * n.sum()
    rate = 1 / (np.linalg.eigvalsh((p * n[:, None]).T @ p / total)[-1] + mixing.RIDGE)
    history = np.zeros((0, 3))
    for _ in range(300):
        _, look = mixing.rates_of(p, history, rate, mixing.RIDGE)
        history = np.vstack([history, ((look * n) @ p - target) / total])
    x = np.ones(200)
    for _ in range(20_000):
        x = np.maximum(0, x - rate * (p @ (((x * n) @ p - target) / total) + mixing.RIDGE * (x - 1)))
    assert np.allclose(mixing.rates_of(p, history, rate, mixing.RIDGE)[0], x, atol=0.02)


def test_rates_of_the_query_are_the_optimum(spark):
    """The distributed fit, in its few passes, against plain projected gradient run to the end on the driver."""
    r = np.random.default_rng(4)
    sharp = r.dirichlet([0.05] * 3, 500)
    rows = [(i, int(r.integers(1, 500)), [float(x) for x in p]) for i, p in enumerate([*sharp, [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]])]
    members = spark.createDataFrame([*rows, *rows[:30]], "doc_id long, n_tokens long, posterior array<double>").withColumn("rate", F.lit("extra")).repartition(3)
    n, p = np.array([x[1] for x in [*rows, *rows[:30]]], float), np.array([x[2] for x in [*rows, *rows[:30]]])
    total = n.sum()
    for share in ([0.6, 0.3, 0.1], [0.9, 0.1, 0.0], [0.2, 0.2, 0.2]):
        targets = np.array(share) * total
        step = 1 / (np.linalg.eigvalsh((p * n[:, None]).T @ p / total)[-1] + mixing.RIDGE)
        want = np.ones(len(n))
        for _ in range(60_000):
            want = np.maximum(0, want - step * (p @ (((want * n) @ p - targets) / total) + mixing.RIDGE * (want - 1)))
        got = {x["doc_id"]: x["rate"] for x in mixing.fit_rates(members, targets).collect()}
        assert np.allclose([got[x[0]] for x in rows], want[: len(rows)], atol=0.02)


def test_repeated_ids_are_one_labelled_row(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(50)] + [(2, None), (None, "x"), (3, "y")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 0), (2, 0, 0), (2, 0, 0), (3, None, None), (None, 1, 1), (9, 1, 0)], "doc_id long, quality int, toxic int")
    rows = mixing.labelled_domains(docs, labels).collect()
    assert sorted(r["domain"] for r in rows) == ["good", "plain"] and {r["text"] for r in rows if r["domain"] == "plain"} == {""}
    assert mixing.labelled_domains(docs, labels, 1).count() <= 1
    nothing = mixing.fit_classifier(mixing.labelled_domains(docs, labels.limit(0)), ["good", "plain"])
    assert np.allclose(nothing.posteriors(["a", ""]), 0.5)


def test_mixing_drops_and_keeps(spark, mixture):
    texts, labels = mixture
    docs = documents(spark, texts, extra=True)
    out = mixing.mixed(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), {"good": 1.0, "plain": 1.0, "toxic": 0.0})
    assert out.columns == docs.columns
    kept = {r["doc_id"] for r in out.select("doc_id").collect()}
    clean = {i for i, _, t in labels if not t}
    assert len(clean - kept) <= 0.03 * len(clean) and len(kept - clean) <= 3
    none = mixing.mixed(documents(spark, []), spark.createDataFrame([], "doc_id long, quality int, toxic int"), {"good": 1.0, "toxic": 0.0})
    assert none.count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="needs the test tables")
def test_network_at_the_query_s_settings(spark):
    """Held-out documents of the tables: far better than counts of single ids, and the same however the table is laid out."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    held = lm.token_table(docs.where("doc_id % 5 = 0"))
    found = {}
    for n in (1, 4, 32):
        tokens = lm.token_table(docs.where("doc_id % 5 <> 0").repartition(n))
        scorer = lm.fit(tokens)
        r = lm.score(held, scorer).agg(F.sum("log_prob"), F.sum("n_tokens")).first()
        found[n] = r[0] / r[1]
    n = np.ones(65536)
    for r in tokens.select("ids").collect():
        n += np.bincount(np.frombuffer(r["ids"], np.uint16), minlength=65536)
    logs = np.log(n / n.sum())
    total = sum(logs[np.frombuffer(r["ids"], np.uint16)].sum() for r in held.select("ids").collect())
    alone = total / held.agg(F.sum(F.octet_length("ids")) / 2).first()[0]
    assert found[1] > alone + 1.5
    assert abs(found[4] - found[1]) < 1e-9 and abs(found[32] - found[1]) < 1e-9


def test_copies_of_the_network(spark):
    """Several copies, averaged: still better than an untrained network, and as many as there are ids for."""
    r = random.Random(9)
    tokens = lm.token_table(documents(spark, [" ".join(words(r, 60, 30)) for _ in range(200)]))
    rank, _ = lm.ranks(tokens)
    ids = tokens.agg(F.sum(F.octet_length("ids"))).first()[0] // 2
    assert lm.replicas(tokens, ids) == 1 and lm.replicas(tokens, ids - 1) == 2 and lm.replicas(tokens.limit(0)) == 1
    score = lambda net: lm.score(tokens, lm.Scorer(rank, np.zeros(65536), net)).agg(F.sum("log_prob")).first()[0]
    assert score(lm.trained(tokens, rank, n=20)) > score(lm.Network.new())


def test_softmax_of_large_logits():
    x = np.array([[0.0, -80, -500], [900, 899, 0], [-300, -301, -700], [70, 70, 70]], np.float32)
    exact = x.astype(float) - x.max(1, keepdims=True)
    exact = exact - np.log(np.exp(exact).sum(1, keepdims=True))
    for k in range(3):
        assert np.allclose(lm._Softmax(x.copy()).log_of(np.full(4, k)), exact[:, k], atol=1e-3)
        want = np.exp(exact)
        want[:, k] -= 1
        assert np.allclose(lm._Softmax(x.copy()).less(np.full(4, k)), want, atol=1e-5)
