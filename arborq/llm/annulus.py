"""Centroid clustering with annulus search.

Lloyd's rounds over integer vectors, so that sums, means and distances are exact whatever the order of rows. A centroid
within distance u of a vector has a norm within u of the vector's norm. So centroids are sorted by norm; a vector's
distance to the centroids of nearest norm is an upper bound u, two binary searches find the centroids in the annulus of
that width around the vector's norm (ties at its edge included), and only these are compared, exactly.

A round is one pass over the stored vectors: each task adds up its vectors by cluster, k rows a task are shuffled, and k
sums go to the driver. Nothing else depends on the number of vectors, and a cluster that holds most of them is like any.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborq.llm.common import stored, table

#: Scaled components must be smaller than this, so that squared distances of up to 64 components fit in 64 bits.
LIMIT = 1 << 27


def scaled(vectors: DataFrame, dim: int, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, v): vectors with exactly `dim` components, none null or non-finite, as integers floor(scale * x), x as double.

    Vectors with a scaled component of LIMIT or more in size are left out too. Null and empty vectors are left out, a null
    id is kept, repeated rows stay, and other columns are dropped.
    """
    x, at = F.col(vec_col), lambda c: c.cast("double") * scale
    whole = (F.size(x) == dim) & F.forall(x, lambda c: c.isNotNull() & (F.abs(at(c)) < LIMIT))
    return vectors.where(whole).select(F.col(id_col).alias("id"), F.transform(x, lambda c: F.floor(at(c)).cast("int")).alias("v"))


def first_centroids(kept: DataFrame, k: int, salt: str) -> np.ndarray:
    """k vectors by ascending lowercase-hex sha256 of `salt:id`; equal ids go by their components, a null id is empty text. Fewer vectors make fewer centroids."""
    key = F.sha2(F.concat(F.lit(f"{salt}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    rows = kept.select(key.alias("key"), "v").orderBy("key", "v").limit(k).collect()
    return np.array([r["v"] for r in rows], np.int64)


class Annuli:
    """Centroids sorted by norm, for exact nearest-centroid search."""

    def __init__(self, centroids: np.ndarray):
        squares = np.einsum("ij,ij->i", centroids, centroids)
        self.number = np.lexsort((np.arange(len(centroids)), squares))
        self.by_norm = centroids[self.number]
        self.norms = np.sqrt(squares[self.number].astype(float))
        self.compared = 0

    def nearest(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the nearest centroid, squared distance) of each row of v; of equally near ones the smallest number."""
        norms = np.sqrt(np.einsum("ij,ij->i", v, v).astype(float))
        above = np.searchsorted(self.norms, norms)
        best, least = None, None
        for guess in (np.minimum(above, len(self.norms) - 1), np.maximum(above - 1, 0)):  # the nearest norms on either side
            off = v - self.by_norm[guess]
            d, c = np.einsum("ij,ij->i", off, off), self.number[guess]
            if best is None:
                best, least = c, d
            else:
                nearer = (d < least) | ((d == least) & (c < best))
                best, least = np.where(nearer, c, best), np.where(nearer, d, least)
        bound = np.sqrt(least.astype(float))
        slack = 1e-9 * (norms + bound) + 1e-6  # more than rounding can make of these roots: the edge belongs to the annulus
        lo = np.searchsorted(self.norms, norms - bound - slack, "left")
        hi = np.searchsorted(self.norms, norms + bound + slack, "right")
        for j in range(int(lo.min(initial=len(self.norms))), int(hi.max(initial=0))):
            at = np.flatnonzero((lo <= j) & (j < hi))
            if not len(at):
                continue
            self.compared += len(at)
            off = v[at] - self.by_norm[j]
            d, c = np.einsum("ij,ij->i", off, off), self.number[j]
            nearer = (d < least[at]) | ((d == least[at]) & (c < best[at]))
            best[at[nearer]], least[at[nearer]] = c, d[nearer]
        return best, least


def _vectors(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    return batch.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


def _sums(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, dim = centroids.shape
        annuli, n, sums = Annuli(centroids), np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _vectors(batch, dim)
            best, _ = annuli.nearest(v)
            n += np.bincount(best, minlength=k)
            order = np.argsort(best, kind="stable")
            own, starts = np.unique(best[order], return_index=True)
            sums[own] += np.add.reduceat(v[order], starts, axis=0)
        own = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), pa.array(n[own]), pa.array(sums[own].tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

    return run


def moved(kept: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round: floor(sum / count) of each one's vectors; those of none stay. k rows come to the driver."""
    dim = centroids.shape[1]
    parts = kept.mapInArrow(_sums(centroids), "cluster int, n long, sums array<long>")
    total = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(dim)])
    out = centroids.copy()
    for r in total.collect():
        out[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(dim)]
    return out


def _assigned(centroids: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        annuli = Annuli(centroids)
        for batch in batches:
            if batch.num_rows:
                best, least = annuli.nearest(_vectors(batch, centroids.shape[1]))
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(best.astype(np.int32)), pa.array(least)], names=["id", "cluster", "distance"])

    return run


def cluster(vectors: DataFrame, k: int, rounds: int, dim: int, salt: str = "", scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id_col, cluster, distance, cluster_inertia, inertia, centroid_sha256): a row for each vector that `scaled` keeps.

    distance is squared; the inertias are its sums over the cluster and over all (null beyond 64 bits); centroid_sha256 is
    of the final centroid's components as decimal integers joined by commas. Fewer than k vectors make as many clusters;
    equal vectors that start as two centroids leave the larger number empty. No vectors, no rows.
    """
    spark = vectors.sparkSession
    kept = stored(scaled(vectors, dim, scale, id_col, vec_col), "vectors")
    centroids = first_centroids(kept, k, salt)
    kind = vectors.schema[id_col].dataType.simpleString()
    if not len(centroids):
        return spark.createDataFrame([], f"`{id_col}` {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    for _ in range(rounds):
        centroids = moved(kept, centroids)
    rows = stored(kept.mapInArrow(_assigned(centroids), f"id {kind}, cluster int, distance long"), "assigned")
    sums = {r["cluster"]: r["d"] for r in rows.groupBy("cluster").agg(F.try_sum("distance").alias("d")).collect()}
    total = None if None in sums.values() or sum(sums.values()) >= 1 << 63 else sum(sums.values())
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    told = spark.createDataFrame([(c, d, total, digests[c]) for c, d in sums.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(told), "cluster").select(F.col("id").alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # told: k rows


K, ROUNDS, DIM = 40, 5, 64


def op11_annulus_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster(table(spark, sf_dir, "embeddings"), K, ROUNDS, DIM, salt="2")


def _sql() -> str:
    """The rounds written out: each compares all vectors with all centroids."""
    assign = """a{0} AS MATERIALIZED (SELECT row, vec_id, v, min(struct_pack(d := d, c := c)) AS m FROM (
  SELECT k.row, k.vec_id, k.v, c.c, list_sum(list_transform(range(1, 65), lambda i: (k.v[i] - c.v[i]) * (k.v[i] - c.v[i])))::BIGINT AS d FROM kept k CROSS JOIN c{0} c) GROUP BY row, vec_id, v)"""
    move = """s{0} AS (SELECT c, list(s ORDER BY i) AS v FROM (SELECT m.c AS c, i, ((sum(v[i]) - ((sum(v[i]) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS s FROM a{0} CROSS JOIN range(1, 65) t(i) GROUP BY m.c, i) GROUP BY c),
c{1} AS MATERIALIZED (SELECT c{0}.c, coalesce(s{0}.v, c{0}.v) AS v FROM c{0} LEFT JOIN s{0} ON c{0}.c = s{0}.c)"""
    steps = [x for r in range(ROUNDS) for x in (assign.format(r), move.format(r, r + 1))] + [assign.format(ROUNDS)]
    return f"""
WITH kept AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x) AND abs(256 * x::DOUBLE) < {LIMIT})) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v FROM (SELECT sha256('2:' || coalesce(vec_id::VARCHAR, '')) AS h, v FROM kept) ORDER BY h, v LIMIT {K}),
{", ".join(steps)}
SELECT vec_id, m.c::INTEGER AS cluster, m.d AS distance, (sum(m.d) OVER (PARTITION BY m.c))::BIGINT AS cluster_inertia, (sum(m.d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c{ROUNDS}.v, ',')) AS centroid_sha256
FROM a{ROUNDS} JOIN c{ROUNDS} ON m.c = c{ROUNDS}.c
"""


OP11_SQL = _sql()
