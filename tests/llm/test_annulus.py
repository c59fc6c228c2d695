import hashlib
import math
import random

import numpy as np
import pytest

from arborq.llm import annulus


def by_hand(rows, k, rounds, dim, salt):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) and abs(256 * x) < annulus.LIMIT for x in v)]
    key = lambda r: (hashlib.sha256(f"{salt}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    centroids = [v for _, v in sorted(kept, key=key)[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    assign = lambda: [min((far(v, c), j) for j, c in enumerate(centroids)) for _, v in kept]
    for _ in range(rounds):
        own = assign()
        for j in range(len(centroids)):
            if mine := [v for (_, v), (_, c) in zip(kept, own, strict=True) if c == j]:
                centroids[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    own = assign()
    each = {j: sum(d for d, c in own if c == j) for j in range(len(centroids))}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, c, d, each[c], sum(each.values()), sha[c]) for (i, _), (d, c) in zip(kept, own, strict=True)), key=str)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


SCHEMA = "vec_id long, embedding array<float>, cluster string, distance string, id string, v string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", "x", "x", "x") for i, v in rows], SCHEMA)


def test_odd_rows_ties_and_hot_vectors(spark):
    r = random.Random(1)
    f32 = lambda: float(np.float32(r.choice([r.gauss(0, 1), r.choice([-0.5, 0, 0.25])])))
    rows = [(i, [f32() for _ in range(3)]) for i in range(400)] + [(400 + i, [0.5, -0.25, 0.0]) for i in range(300)]
    rows += [(900, None), (901, []), (902, [1.0, 2.0]), (903, [1.0, None, 2.0]), (904, [1.0, math.nan, 2.0]), (905, [1.0, math.inf, 2.0]), (906, [1e9, 0.0, 0.0]), (None, [0.5, 0.5, 0.5]), (7, [3.0, 3.0, 3.0]), (7, [3.0, 3.0, 3.0])]
    r.shuffle(rows)
    for k, rounds in ((1, 2), (7, 0), (12, 4), (900, 1)):
        assert found(annulus.cluster(frame(spark, rows).repartition(5), k, rounds, 3, "s")) == by_hand(rows, k, rounds, 3, "s")


def test_without_vectors(spark):
    got = annulus.cluster(frame(spark, [(1, [1.0]), (2, None)]), 4, 3, 2)
    assert got.count() == 0 and got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert annulus.cluster(frame(spark, []), 4, 3, 2).count() == 0


@pytest.mark.parametrize("spread", [1, 3, 60, 1 << 26])
def test_search_is_exact(spread):
    """Against all centroids, with equal norms, equal centroids, and vectors at the same distance from several."""
    r = np.random.default_rng(spread)
    centroids = np.vstack([r.integers(-spread, spread + 1, (60, 4)), np.zeros((2, 4), np.int64)])
    centroids = np.vstack([centroids, centroids[:9], -centroids[:20]])
    v = np.vstack([r.integers(-spread, spread + 1, (500, 4)), centroids])
    best, least = annulus.Annuli(centroids).nearest(v)
    d = ((v[:, None, :] - centroids[None]) ** 2).sum(2)
    assert (best == d.argmin(1)).all() and (least == d.min(1)).all()


def test_search_passes_over_centroids_of_other_norms():
    r = np.random.default_rng(3)
    centroids = r.integers(-9, 10, (200, 8)) + (np.arange(200) * 1000)[:, None]
    annuli = annulus.Annuli(centroids)
    annuli.nearest(centroids + r.integers(-3, 4, (200, 8)))
    assert annuli.compared < 3 * 200


def test_query(spark):
    got = annulus.op11_annulus_clusters(spark, "/root/testdata/sf0.001").collect()
    import duckdb

    con = duckdb.connect()
    con.sql("CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/sf0.001/embeddings.parquet'")
    assert sorted(map(tuple, got)) == sorted(con.sql(annulus.OP11_SQL).fetchall())
