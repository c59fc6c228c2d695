import random

import numpy as np
import pyarrow as pa

from arborq.llm import near
from arborq.llm.bytewords import word_hashes
from tests.llm.helpers import documents, odd_texts, words


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def changed(r, a, edits):
    b = list(a)
    for _ in range(edits):
        k = r.randrange(3)
        if b and k == 0:
            b[r.randrange(len(b))] = f"new{r.randrange(10**6)}"
        elif b and k == 1:
            del b[r.randrange(len(b))]
        else:
            b.insert(r.randint(0, len(b)), f"new{r.randrange(10**6)}")
    return b


def test_distances_against_brute_force():
    r = random.Random(1)
    pairs, limits = [], []
    for _ in range(300):
        a = [r.randint(1, 8) for _ in range(r.randint(0, 60))]
        b = [x if isinstance(x, int) else r.randint(1, 8) for x in changed(r, a, r.randint(0, 14))]
        pairs.append((np.array(a, np.uint64), np.array(b, np.uint64)))
        limits.append(r.randint(0, 25))
    want = [min(edit_distance(a.tolist(), b.tolist()), k + 1) for (a, b), k in zip(pairs, limits, strict=True)]
    assert near.distances(pairs, limits) == want


def test_words():
    h, n = word_hashes(["Ab cd, ab", "", None or "", "x" * 40 + " " + "x" * 33, "éa-éa"])
    assert n.tolist() == [3, 0, 0, 2, 2]
    assert h[0] == h[2] != h[1] and h[3] != h[4] and h[5] == h[6]


def test_sketches_agree_with_edit_similarity():
    r = random.Random(2)
    base = words(r, 400, 10**6)
    rates = []
    for edits in (0, 4, 40, 300):
        h, n = word_hashes([" ".join(base), " ".join(changed(r, base, edits))])
        s = near.sketches(h, n, count=256)
        rates.append((s[0] == s[1]).mean())
    assert rates[0] == 1 > rates[1] > rates[2] > rates[3]
    h, n = word_hashes([" ".join(base), " ".join(base[200:] + base[:200])])  # the same k-mers in another order
    s = near.sketches(h, n, count=256)
    assert (s[0] == s[1]).mean() < 0.75


def classes(rows):
    out = {}
    for r in rows:
        out.setdefault(r["class_id"], set()).add(r["doc_id"])
    return {frozenset(x) for x in out.values()}


def test_planted_groups(spark):
    r = random.Random(3)
    texts, groups = [], []
    for size in [1] * 40 + [2] * 10 + [3] * 5 + [60]:
        base = words(r, r.randint(60, 400), 10**6)
        groups.append(frozenset(range(len(texts), len(texts) + size)))
        texts += [" ".join(changed(r, base, max(1, len(base) // 60)) if k else base) for k in range(size)]
    passage = " ".join(words(r, 60, 10**6))  # which other texts share
    for _ in range(40):
        groups.append(frozenset([len(texts)]))
        texts.append(passage + " " + " ".join(words(r, 120, 10**6)))
    got = near.near_groups(documents(spark, texts, extra=True)).collect()
    assert classes(got) == set(groups)
    assert all(x["class_id"] == min(g for g in groups if x["doc_id"] in g for g in [min(g)]) for x in got)
    assert sum(x["stays"] for x in got) == len(groups)


def test_candidates_beyond_the_star_are_compared(spark):
    """Groups by all pairs that agree in a sketch, each compared: a text near a group's rim but not near its first is of the group."""
    r = random.Random(5)
    base = words(r, 300, 10**6)
    group = [changed(r, base, 24) for _ in range(40)]
    texts = [" ".join(x) for x in [base, *group, *(changed(r, r.choice(group), 46) for _ in range(15))]]
    passage = words(r, 80, 10**6)
    texts += [" ".join(passage + words(r, 100, 10**6)) for _ in range(60)]
    h, n = word_hashes(texts)
    s, own = near.sketches(h, n), np.split(h, np.cumsum(n)[:-1])
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if (s[i] == s[j]).any()]
    limits = [int(0.2 * max(n[i], n[j]) + 1e-9) for i, j in pairs]
    label = list(range(len(texts)))
    for (i, j), d, limit in zip(pairs, near.distances([(own[i], own[j]) for i, j in pairs], limits), limits, strict=True):
        if d <= limit:
            a, b = sorted((label[i], label[j]))
            label = [a if x == b else x for x in label]
    got = {x["doc_id"]: x["class_id"] for x in near.near_groups(documents(spark, texts)).collect()}
    assert got == dict(enumerate(label))


def test_odd_texts(spark):
    texts = odd_texts()
    got = {x["doc_id"]: x["class_id"] for x in near.near_groups(documents(spark, texts)).collect()}
    assert got[0] == got[1] == got[2] == 0  # null and empty
    assert got[7] == got[8] == 7 and got[9] == got[10] == 9
    assert got[3] == 3 and got[4] == 4 and len(got) == len(texts)
    assert near.near_groups(documents(spark, [])).count() == 0


def test_ids_that_are_null_or_shared(spark):
    df = spark.createDataFrame([(4, "a b c d e f"), (4, "a b c d e f"), (None, "a b c d e f"), (None, "other words here now then")], "doc_id long, text string")
    got = sorted(((x["class_id"] is None, x["class_id"], x["class_size"], x["stays"]) for x in near.near_groups(df).collect()), key=str)
    assert [x[2] for x in got].count(3) == 3 and sum(x[3] for x in got) == 2
    kept = near.drop_near_copies(df)
    assert kept.columns == df.columns and kept.count() == 2


def test_components(spark):
    links = spark.createDataFrame([(i + 1, i) for i in range(30)] + [(50, 40), (40, 50), (60, 61)], "a long, b long")
    got = {r["node"]: r["label"] for r in near.components(links).collect()}
    assert all(got[i] == 0 for i in range(31)) and got[50] == got[40] == 40 and got[61] == 60


def test_recall_against_all_pairs(spark):
    """Pairs a tenth to a fifth of whose words are edited, with texts of their own and with a passage that all share: groups against brute force over all pairs."""
    r = random.Random(9)
    passage = words(r, 60, 10**6)
    for shared in ([], passage):
        texts, rates = [], []
        for share in (0.1, 0.15, 0.19):
            for _ in range(120):
                own = words(r, 200 - len(shared), 10**6)
                at = r.sample(range(len(own)), int(share * 200))
                texts += [" ".join(shared + own), " ".join(shared + [f"new{r.randrange(10**9)}" if i in set(at) else w for i, w in enumerate(own)])]
                rates.append(share)
        h, n = word_hashes(texts)
        own = np.split(h, np.cumsum(n)[:-1])
        pairs = [(i, j) for i in range(len(texts)) for j in range(i) if near._unshared(own[i], own[j]) <= 0.2 * max(n[i], n[j])]
        limits = [int(0.2 * max(n[i], n[j]) + 1e-9) for i, j in pairs]
        want = {(i, j) for (i, j), d, k in zip(pairs, near.distances([(own[i], own[j]) for i, j in pairs], limits), limits, strict=True) if d <= k}
        assert want == {(2 * k + 1, 2 * k) for k in range(len(rates))}
        got = {x["doc_id"]: x["class_id"] for x in near.near_groups(documents(spark, texts)).collect()}
        found = np.array([got[2 * k] == got[2 * k + 1] for k in range(len(rates))])
        assert all(got[i] in (i, i - i % 2) for i in got)  # no links but those
        for share, least in ((0.1, 0.98), (0.15, 0.95), (0.19, 0.9)):
            assert found[np.array(rates) == share].mean() >= least, (share, len(shared))


def test_large_buckets_go_by_blocks(spark, monkeypatch):
    """The same links, whether one task compares a bucket or blocks of it do."""
    r = random.Random(12)
    passage = words(r, 120, 10**6)
    texts = [" ".join(passage + words(r, r.choice((30, 60, 100)), 10**6)) for _ in range(80)]
    texts += [" ".join(changed(r, passage + words(r, 20, 10**6), 10)) for _ in range(30)]
    df = documents(spark, texts)
    whole = {x["doc_id"]: x["class_id"] for x in near.near_groups(df).collect()}
    monkeypatch.setattr(near, "SMALL", 8)
    monkeypatch.setattr(near, "BLOCK", 4)
    monkeypatch.setattr(near, "STRIPE", 2)
    assert {x["doc_id"]: x["class_id"] for x in near.near_groups(df).collect()} == whole
    assert 1 < len(set(whole.values())) < len(texts)


def test_hot_buckets_are_passed_on(spark, monkeypatch):
    """Buckets with many texts of a batch, and stars that are full: the groups stay whole."""
    r = random.Random(10)
    monkeypatch.setattr(near, "HOT", 3)
    monkeypatch.setattr(near, "STAR", 4)
    groups = [frozenset(range(80)), frozenset(range(80, 90))]
    texts = [" ".join(changed(r, base, 3)) for base, n in ((words(r, 150, 10**6), 80), (words(r, 90, 10**6), 10)) for _ in range(n)]
    assert classes(near.near_groups(documents(spark, texts)).collect()) == set(groups)


def test_pairs_are_possible_in_their_first_bucket_alone():
    """Texts that share many buckets: over all of them, each pair of two groups that the bounds leave comes once, in the first bucket."""
    r = random.Random(4)
    base = words(r, 120, 10**6)
    texts = [" ".join(changed(r, base, k)) for k in (0, 2, 4, 8, 12, 16) for _ in range(4)]
    h, n = word_hashes(texts)
    s = near.sketches(h, n)
    keys = [np.unique(x).view(np.int64) for x in s]
    batch = pa.RecordBatch.from_pydict({"node": list(range(len(texts))), "text": texts, "sketch": [x.tobytes() for x in s], "keys": keys})
    profiles = pa.Table.from_batches(near._profiled(iter([batch])))
    own = near._unpacked(np.arange(len(texts)), np.arange(len(texts)) // 2, n, *(profiles.column(c).to_pylist() for c in ("profile", "shared")))
    found = []
    for place in range(s.shape[1]):
        for key in np.unique(s[:, place]):
            at = np.flatnonzero(s[:, place] == key)
            held = tuple(x[at] for x in own)
            for out in near._possible(int(key.view(np.int64)), held, held, 0.8, len(at)):
                found += [(a, b, place) for a, b in zip(out.column("a").to_pylist(), out.column("b").to_pylist(), strict=True)]
    agree = {(i, j): int(np.argmax(s[i] == s[j])) for i in range(len(texts)) for j in range(i) if (s[i] == s[j]).any() and i // 2 != j // 2}
    parts = np.split(h, np.cumsum(n)[:-1])
    want = [(i, j, k) for (i, j), k in agree.items() if near._unshared(parts[i], parts[j]) <= int(0.2 * max(n[i], n[j]) + 1e-9)]
    assert len(found) == len({x[:2] for x in found}) and set(want) <= set(found)
    assert all(agree[x[:2]] == x[2] for x in found) and want


def test_texts_meet_others_of_their_bucket_and_no_one_else(spark):
    """Of a bucket all pairs of different groups and of like lengths meet, once; no row is made for a text that meets its own group alone."""
    r = random.Random(6)
    rows = [(key, node, r.choice((1, 1, 1, 2, 3)) if key % 3 else 1, r.randint(0, 6)) for key in range(60) for node in r.sample(range(100), r.randint(2, 12))]
    rows += [(70, k, 1, 3) for k in range(50)] + [(70, 50, 1, 2), (70, 51, 2, 3), (70, 52, 3, 0)]
    own = spark.createDataFrame(rows, "key long, node long, label long, class int")
    got = near._meeting(own).collect()
    want, sizes = {}, {}
    for key, _, _, c in rows:
        sizes[key, c] = sizes.get((key, c), 0) + 1
    for key, a, la, ca in rows:
        for other, b, lb, cb in rows:
            if key == other and la != lb and cb in (ca, ca + 1):
                want.update({(key, a, la, ca, False): None, (key, b, lb, ca, cb > ca): None})
    assert len(got) == len(want) and {(x["key"], x["node"], x["label"], x["class"], x["visits"]) for x in got} == want.keys()
    assert all(x["n"] == sizes.get((x["key"], x["class"]), 0) + sizes.get((x["key"], x["class"] + 1), 0) for x in got)
    assert [x["node"] for x in got if x["key"] == 70 and x["visits"]] == [51]  # not the 50 that would meet only text 50, of their group


def test_groups_are_compared_with_those_that_they_meet_most(spark, monkeypatch):
    """A group meets one that is near in six buckets, in each with another text, and a single text that isn't near in two: it is compared with the first all the same."""
    from pyspark.sql import functions as F

    r = random.Random(7)
    base, far = words(r, 100, 10**6), words(r, 100, 10**6)
    texts = {1: base, 100: changed(r, base, 5), 200: far} | {k: changed(r, base, 3) for k in range(2, 8)}
    drawn = lambda node: F.xxhash64("key", F.lit(node).cast("long"), F.lit(0))
    keys = lambda node, hub, n: [x["key"] for x in spark.range(1000).select(F.col("id").alias("key")).where(drawn(hub) < drawn(node)).limit(n).collect()]
    rows = [(key, x) for node in range(2, 8) for key in keys(node, 100, 200)[20 * node : 20 * node + 1] for x in (node, 100)]
    rows += [(key, x) for key in [k for k in keys(1, 200, 400) if k not in {y for y, _ in rows}][:2] for x in (1, 200)]
    entries = spark.createDataFrame([(*x, 0) for x in rows], "key long, node long, hub long")
    labels = spark.createDataFrame([(k, k if k >= 100 else 1) for k in texts], "node long, label long")
    checked = spark.createDataFrame([], f"{near.PAIRS}, near boolean")
    own = spark.createDataFrame([(k, " ".join(t)) for k, t in texts.items()], "node long, text string")
    for partners in (1, near.PARTNERS):
        monkeypatch.setattr(near, "PARTNERS", partners)
        got, seen = near._starred(labels, entries, checked, own, near.SIMILARITY, 0)
        got = {x["node"]: x["label"] for x in got.collect()}
        assert got[100] == got[1] == 1 and got[200] == 200
        assert 1 <= seen.count() <= partners


def test_pairs_that_are_not_near_make_no_rows(spark, monkeypatch):
    """Texts of the same passages in other orders: the bounds rule out none of their pairs, the alignment all but one. After the buckets' ends no table has more rows than these have, however many pairs there are."""
    r = random.Random(8)
    passages = [words(r, 12, 10**6) for _ in range(10)]
    texts = [" ".join(w for p in r.sample(passages, len(passages)) for w in p) for _ in range(150)]
    texts.append(texts[40].replace("w", "W", 50) + " one two three")
    made = []

    def small(df, name, *rest, f=near.small, **more):
        made.append((name, (out := f(df, name, *rest, **more)).count()))
        return out

    monkeypatch.setattr(near, "small", small)
    h, n = word_hashes(texts)
    s, own = near.sketches(h, n, count=16), np.split(h, np.cumsum(n)[:-1])
    agree = [(i, j) for i in range(len(texts)) for j in range(i) if (s[i] == s[j]).any()]
    got = {x["doc_id"]: x["class_id"] for x in near.near_groups(documents(spark, texts), count=16).collect()}
    assert got == {k: 40 if k == 150 else k for k in range(151)} and all(near._unshared(own[i], own[j]) <= 3 for i, j in agree)
    names = [x for x, _ in made]
    most = made[names.index("ends")][1]
    assert len(agree) > 1.5 * most and max(k for x, k in made[names.index("ends") :] if x not in ("classes", "nodes")) <= most


def test_links_are_a_forest():
    """Of all near pairs of a block only those that join groups are links, and they join all that the others would."""
    r = random.Random(11)
    bases = [words(r, 60, 10**6) for _ in range(4)]
    texts = [" ".join(changed(r, base, r.randint(0, 7))) for base in bases for _ in range(25)]
    h, n = word_hashes(texts)
    own = dict(enumerate(np.split(h, np.cumsum(n)[:-1])))
    label = {k: k // 2 * 2 for k in own}
    pairs = [(i, j) for i in own for j in own if i > j and label[i] != label[j]]
    limits = [int(0.2 * max(n[i], n[j]) + 1e-9) for i, j in pairs]
    into = dict.fromkeys(label.values())
    for x in into:
        into[x] = x
    for (i, j), d, limit in zip(pairs, near.distances([(own[i], own[j]) for i, j in pairs], limits), limits, strict=True):
        if d <= limit:
            a, b = sorted((into[label[i]], into[label[j]]))
            into = {k: a if x == b else x for k, x in into.items()}
    columns = [*zip(*((i, j, label[i], label[j], 0) for i, j in pairs), strict=True)]
    cut = len(pairs) // 3
    batches = [pa.RecordBatch.from_arrays([pa.array(c[x], pa.int64()) for c in columns], names=["a", "b", "label_a", "label_b", "bound"]) for x in (slice(cut), slice(cut, None))]
    links = near._forest(iter(batches), own, near.SIMILARITY)
    found = {x: x for x in into}
    for x, y in links:
        a, b = sorted((found[x], found[y]))
        assert a != b  # a link that others don't give
        found = {k: a if z == b else z for k, z in found.items()}
    assert found == into and 1 < len(set(into.values())) < len(into)


def test_texts_are_aligned_between_blocks(spark, monkeypatch):
    """The same groups, whether the texts of a bucket are aligned in one block or in many."""
    r = random.Random(13)
    monkeypatch.setattr(near, "ROUNDS", 0)
    base = words(r, 120, 10**6)
    rim = [changed(r, base, 14) for _ in range(25)]
    texts = [" ".join(x) for x in [*rim, *(changed(r, r.choice(rim), 22) for _ in range(25))]]
    df = documents(spark, texts)
    whole = {x["doc_id"]: x["class_id"] for x in near.near_groups(df).collect()}
    monkeypatch.setattr(near, "BLOCK_WORDS", 700)
    assert {x["doc_id"]: x["class_id"] for x in near.near_groups(df).collect()} == whole
    assert 1 < len(set(whole.values())) < len(texts)
