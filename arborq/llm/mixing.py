"""Mixing to target weights with soft membership.

A classifier fitted on a labelled table gives each document a posterior over domains. Rates r >= 0 for all documents are
then fitted so that the expected tokens of each domain, sum of r * tokens * posterior, meet their targets, while the
rates stay as near to 1 as that allows: with N tokens in all and x(d) = (expected tokens of d - target of d) / N,

    minimise  sum over d of x(d)^2 / 2  +  RIDGE * (sum over documents of tokens * (r - 1)^2) / (2 * N)

by projected gradient with momentum. In the metric of the tokens a document's gradient is posterior . x + RIDGE * (r - 1):
it needs the documents' sums x only, a number for each domain, which a step adds up where the documents lie. A rate is a
function of the posterior and the x of all steps so far, so steps write nothing and can be run again anywhere.

At the optimum r = max(0, 1 - posterior . x / RIDGE). Steps start from there, with the x of a small problem that has the
same form: documents of about the same posterior (a cell of a grid over all posteriors, at most CELLS) taken together. It is
solved on the driver, so that STEPS passes over the documents are enough.

Tokens are ids of the tokenizer, with the one after each document: those that are packed in the end.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from arborq.llm import bytewords
from arborq.llm.common import fresh, slices, stored, table, texts_of
from arborq.llm.tokens import default_vocabulary, encoder

#: Labelled rows the classifier is fitted on, at most; words it looks at; buckets that words are hashed into.
TRAIN_ROWS, FEATURES, BUCKETS = 6000, 512, 1 << 18
RIDGE, STEPS = 1e-3, 6
#: Cells of the grid over posteriors, at most, and steps of the small problem.
CELLS, SMALL_STEPS = 20_000, 3000
#: The query's targets, in shares of all tokens.
TARGETS = {"good": 0.85, "plain": 0.1, "toxic": 0.05}

_CLASSES = np.array([0 if b <= 32 else 1 if b >= 128 or chr(b).isalnum() else 2 for b in range(256)], np.uint8)


def features_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of every run of letters and digits, or of signs; the text it is of)."""
    parts = [t.lower().encode() for t in texts]
    data = b"\n".join(parts) + b"\n" + bytewords.PAD
    classes = _CLASSES[np.frombuffer(data, np.uint8)[: len(data) - len(bytewords.PAD)]]
    starts, ends = bytewords.runs(classes)
    kind = classes[starts]
    starts, ends, kind = starts[kind > 0], ends[kind > 0], kind[kind > 0]
    buckets = (bytewords.hashes(data, starts, ends - starts) >> np.uint64(40)).astype(np.int64) % BUCKETS
    doc = np.searchsorted(np.cumsum([len(p) + 1 for p in parts]), starts, "right")
    return buckets, doc


@dataclass
class Classifier:
    domains: list[str]
    place: np.ndarray  #: bucket to feature, -1 for most
    weights: np.ndarray  #: (features + 1, domains)

    def posteriors(self, texts: list[str]) -> np.ndarray:
        """(texts, domains)."""
        buckets, doc = features_of(texts)
        has = presence(self.place, len(self.weights) - 1, buckets, doc, len(texts))
        return softmax(has @ self.weights[:-1] + self.weights[-1])


def presence(place: np.ndarray, count: int, buckets: np.ndarray, doc: np.ndarray, texts: int) -> np.ndarray:
    feature = place[buckets]
    seen = feature >= 0
    out = np.zeros((texts, count), np.float32)
    out[doc[seen], feature[seen]] = 1
    return out


def softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(1, keepdims=True))
    return x / x.sum(1, keepdims=True)


def _bucket_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[str, list[np.ndarray]] = {}
    for batch in slices(batches, "text"):
        buckets, doc = features_of(texts_of(batch))
        pairs = np.unique(doc * BUCKETS + buckets)
        domains = np.array(batch.column("domain").to_pylist())[pairs // BUCKETS] if len(pairs) else np.array([])
        for d in np.unique(domains):
            found.setdefault(str(d), []).append(pairs[domains == d] % BUCKETS)
    for d, parts in found.items():
        values, counts = np.unique(np.concatenate(parts), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array([d] * len(values), pa.string()), pa.array(values), pa.array(counts.astype(np.int64))], names=["domain", "bucket", "n"])


def fit_classifier(labelled: DataFrame, domains: list[str], features: int = FEATURES) -> Classifier:
    """labelled: (text, domain), few enough rows for their `features` bits each to be collected. Softmax regression on the presence of those words that tell domains apart best (largest mutual chi-square).

    Rows with a null or another domain are left out; a null text is empty. Words that tell as much go by their hash. Repeated
    rows count as often. No rows at all: all domains are as likely.
    """
    labelled = stored(labelled.where(F.col("domain").isin(domains)).select("text", "domain"), "labelled")
    sizes = {r["domain"]: r["count"] for r in labelled.groupBy("domain").count().collect()}
    total = sum(sizes.values())
    counts = labelled.mapInArrow(_bucket_counts, "domain string, bucket long, n long").groupBy("bucket").pivot("domain", domains).agg(F.sum("n")).fillna(0)
    seen = sum((F.col(f"`{d}`") for d in domains), F.lit(0))
    score = F.lit(0.0)
    for d in domains:
        share = max(sizes.get(d, 0), 1) / max(total, 1)
        score = score + F.pow(F.col(f"`{d}`") - seen * share, 2) / (seen * share + 1)
    top = [r["bucket"] for r in counts.orderBy(score.desc(), "bucket").limit(features).select("bucket").collect()]
    place = np.full(BUCKETS, -1, np.int32)
    place[top] = np.arange(len(top))
    if not top:
        return Classifier(domains, place, np.zeros((1, len(domains))))
    width = -(-len(top) // 8)

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            buckets, doc = features_of(texts_of(batch))
            has = np.packbits(presence(place, len(top), buckets, doc, batch.num_rows).astype(bool), axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("domain"), pa.array([x.tobytes() for x in has], pa.binary())], names=["domain", "bits"])

    rows = sorted((r["domain"], bytes(r["bits"])) for r in labelled.mapInArrow(bits, "domain string, bits binary").collect())
    x = np.unpackbits(np.frombuffer(b"".join(b for _, b in rows), np.uint8).reshape(len(rows), width), axis=1)[:, : len(top)].astype(np.float64)
    x = np.hstack([x, np.ones((len(rows), 1))])
    y = np.eye(len(domains))[[domains.index(d) for d, _ in rows]]
    return Classifier(domains, place, softmax_regression(x, y))


def softmax_regression(x: np.ndarray, y: np.ndarray, ridge: float = 1e-4, steps: int = 400) -> np.ndarray:
    """Weights by accelerated gradient descent with a step that the data's largest eigenvalue allows."""
    v = np.ones(x.shape[1])
    for _ in range(20):
        v = x.T @ (x @ v)
        v /= np.linalg.norm(v)
    rate = 1 / (0.5 * np.linalg.norm(x @ v) ** 2 / len(x) + ridge)
    w = look = np.zeros((x.shape[1], y.shape[1]))
    for k in range(steps):
        new = look - rate * (x.T @ (softmax(x @ look) - y) / len(x) + ridge * look)
        w, look = new, new + k / (k + 3) * (new - w)
    return w


def rates_of(p: np.ndarray, history: np.ndarray, rate: float, ridge: float, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(rates, where the next gradient is taken) of documents with posteriors p after steps of which history holds the x. start: the x whose optimum is the first guess; without it that is 1."""
    r = look = np.ones(len(p)) if start is None else np.maximum(0, 1 - p @ start / ridge)
    for k, x in enumerate(history):
        new = np.maximum(0, look - rate * (p @ x + ridge * (look - 1)))
        r, look = new, new + k / (k + 3) * (new - r)
    return r, look


def posteriors(docs: DataFrame, classifier: Classifier, vocabulary: str | None = None) -> DataFrame:
    """docs with n_tokens (ids of the text and one after it) and posterior (array of doubles in the order of the domains) added, in place of columns of those names. A null text is an empty one: a token, and the posterior of a text without any known word."""
    docs = docs.drop("n_tokens", "posterior")
    path = vocabulary or default_vocabulary()
    shared = docs.sparkSession.sparkContext.broadcast(classifier)  # its size is fixed by BUCKETS, FEATURES and the domains
    k = len(classifier.domains)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = texts_of(batch)
            p = shared.value.posteriors(texts)
            _, sizes = encoder(path).encode(texts)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, p.size + 1, k, dtype=np.int32)), pa.array(p.astype(np.float64).reshape(-1)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes.astype(np.int64)), lists], names=[*batch.schema.names, "n_tokens", "posterior"])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField("n_tokens", LongType()), StructField("posterior", ArrayType(DoubleType()))]))


def grid(k: int) -> int:
    """The finest grid of which posteriors over k domains have CELLS cells at most."""
    g = 1
    while math.comb(g + 1 + k, k) <= CELLS:
        g += 1
    return g


def _members(batch: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, posteriors)"""
    return batch.column("n_tokens").to_numpy().astype(np.float64), batch.column("posterior").flatten().to_numpy().reshape(-1, k)


def _cells(k: int):
    """(cell, tokens, tokens * posterior) of each cell that a task has."""
    g = grid(k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((0, 2 + k))
        for batch in batches:
            n, p = _members(batch, k)
            cell = np.minimum((p * g).astype(np.int64), g) @ ((g + 1) ** np.arange(k, dtype=np.int64))
            held = np.vstack([held, np.hstack([cell[:, None], n[:, None], p * n[:, None]])])
            which, at = np.unique(held[:, 0], return_inverse=True)
            held = np.hstack([which[:, None], *(np.bincount(at, held[:, j], len(which))[:, None] for j in range(1, 2 + k))])
        yield pa.RecordBatch.from_arrays([pa.array(held[:, 0].astype(np.int64)), *(pa.array(held[:, j]) for j in range(1, 2 + k))], names=["cell", *(f"s{j}" for j in range(1 + k))])

    return run


def fit_rates(members: DataFrame, targets: np.ndarray, steps: int = STEPS, ridge: float = RIDGE) -> DataFrame:
    """members: (n_tokens, posterior, ...), read once a step: best a stored table. Adds rate, in place of a column of that name; repeated rows have the same. targets: tokens wanted of each domain. No tokens at all: rates of 1."""
    k = len(targets)
    own = members.select("n_tokens", "posterior")
    names = [f"s{j}" for j in range(1 + k)]
    cells = own.mapInArrow(_cells(k), ", ".join(["cell long", *(f"{c} double" for c in names)])).groupBy("cell").agg(*[F.sum(c).alias(c) for c in names]).orderBy("cell").collect()  # CELLS rows at most
    sums = np.array([[r[c] for c in names] for r in cells if r["s0"] > 0]).reshape(-1, 1 + k)
    n, p = sums[:, 0], sums[:, 1:] / sums[:, :1]
    total = n.sum()
    rate, start, history = 1.0, None, np.zeros((0, k))
    if total:
        rate = 1 / (np.linalg.eigvalsh((p * n[:, None]).T @ p / total)[-1] + ridge)
        start = solved(p, n, targets, rate, ridge)
        for _ in range(steps):
            history = np.vstack([history, (_sums(own, k, history, rate, ridge, start) - targets) / total])
    members = members.drop("rate")

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            r, _ = rates_of(_members(batch, k)[1], history, rate, ridge, start)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(r)], names=[*batch.schema.names, "rate"])

    return members.mapInArrow(final, StructType([*members.schema.fields, StructField("rate", DoubleType())]))


def solved(p: np.ndarray, n: np.ndarray, targets: np.ndarray, rate: float, ridge: float, steps: int = SMALL_STEPS) -> np.ndarray:
    """x of the optimum for few documents: the same steps, all on the driver."""
    r = look = np.ones(len(n))
    x = np.zeros(len(targets))
    k = 0
    for _ in range(steps):
        x = ((look * n) @ p - targets) / n.sum()
        new = np.maximum(0, look - rate * (p @ x + ridge * (look - 1)))
        k = 0 if ((look - new) * n) @ (new - r) > 0 else k + 1  # momentum that leads astray is given up
        r, look = new, new + k / (k + 3) * (new - r)
    return ((r * n) @ p - targets) / n.sum()


def _sums(members: DataFrame, k: int, history: np.ndarray, rate: float, ridge: float, start: np.ndarray) -> np.ndarray:
    """Expected tokens of each domain where the next gradient is taken."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(k)
        for batch in batches:
            n, p = _members(batch, k)
            out += (rates_of(p, history, rate, ridge, start)[1] * n) @ p
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in out], names=[f"s{i}" for i in range(k)])

    got = members.mapInArrow(run, ", ".join(f"s{i} double" for i in range(k))).agg(*[F.sum(f"s{i}") for i in range(k)]).collect()[0]
    return np.array([x or 0.0 for x in got])


def labelled_domains(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """(text, domain) of at most `rows` labelled documents, those with the least hashes of their ids: toxic where labelled so, else good or plain by quality.

    Labels with a null id, or that tell nothing, are left out; of labels that share an id the first domain in the alphabet
    counts, and of documents that share one the text of the least hash. A label without a document gives no row.
    """
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "plain")
    told = labels.select("doc_id", domain.alias("domain")).where("domain is not null and doc_id is not null").groupBy("doc_id").agg(F.min("domain").alias("domain"))
    few = told.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    text = F.coalesce("text", F.lit(""))
    found = docs.select("doc_id", text.alias("text")).join(F.broadcast(few), "doc_id")  # `rows` ids at most
    return found.groupBy("doc_id", "domain").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("text", "domain")


def total_tokens(members: DataFrame, k: int) -> np.ndarray:
    """Expected tokens of each domain at rates of 1."""
    got = members.agg(*[F.sum(F.col("n_tokens") * F.col("posterior")[i]).alias(f"s{i}") for i in range(k)]).collect()[0]
    return np.array([x or 0.0 for x in got])


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    classifier = fit_classifier(labelled_domains(docs, table(spark, sf_dir, "labels")), sorted(TARGETS))
    members = stored(posteriors(docs.select("doc_id", "text"), classifier).select("doc_id", "n_tokens", "posterior"), "members")
    tokens = total_tokens(members, len(TARGETS)).sum()
    return fit_rates(members, np.array([TARGETS[d] * tokens for d in classifier.domains]))


def mixed(docs: DataFrame, labels: DataFrame, factors: dict[str, float]) -> DataFrame:
    """docs, in their own columns, as often as their rates say: factors[d] times the tokens of domain d that there are.

    A rate's whole part is a number of copies, and its fraction the chance of one more, told by a hash of id and text.
    Null texts are rated as empty ones. Repeated rows are taken as often as one another. An empty table gives an empty result.
    """
    names = docs.columns
    classifier = fit_classifier(labelled_domains(docs, labels), sorted(factors))
    members = stored(posteriors(docs.withColumnsRenamed({c: f"own_{c}" for c in names if c not in ("doc_id", "text")}), classifier), "members")
    there = total_tokens(members, len(factors))
    out = fit_rates(members, there * np.array([factors[d] for d in classifier.domains]))
    chance = F.pmod(F.xxhash64("doc_id", "text", F.lit("mix")), F.lit(1 << 30)) / float(1 << 30)
    copies = F.floor(F.col("rate") + chance).cast("int")
    times, each = fresh(docs, "times", "each")
    out = out.select(*[F.col(c if c in ("doc_id", "text") else f"own_{c}").alias(c) for c in names], copies.alias(times))
    return out.where(F.col(times) > 0).withColumn(each, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*names)
