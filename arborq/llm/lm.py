"""Scoring documents by masked pseudo-likelihood.

A network reads the SIDE token ids on either side of a place and predicts the one in between: a table for each of the
2 * SIDE places gives a vector for the id there, their sum goes through tanh, and a softmax in two levels (of a class,
then within the class) gives the id's probability. A document's score is the sum of log-probabilities of all its ids, each
given its neighbours on both sides.

Ids are those of the tokenizer, by rank of their counts. The OUTPUTS - 1 most frequent have outputs of their own. The last
output stands for all others: a further softmax over RARE_CLASSES, from the same context, tells its class, and an id has
the share of its class's counts that is its own. As context a rare id has one of RARE_ROWS rows.

Training is by stochastic gradients in copies of the network, one for each REPLICA_IDS ids: in each of ROUNDS rounds all
start from the same state, each goes through its documents (every STRIDE-th place of each, another phase each round), and
their states are averaged by their places, pairwise in a tree of tasks. ROUNDS is a multiple of STRIDE, so that training
covers every place of every document; what is sent grows with the number of copies. Which documents a copy sees, and in
what order, is told by a hash, so that scores don't depend on how a table is dealt out.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborq.llm.common import slices, stored, table, texts_of
from arborq.llm.tokens import default_vocabulary, encoder

SIDE, HIDDEN, CLASSES, PER_CLASS = 2, 16, 64, 32
OUTPUTS = CLASSES * PER_CLASS
RARE_CLASSES, RARE_ROWS = 256, 1024
#: Ids there may be. A place beyond the text has this rank.
EDGE = 65536
#: Row of the tables for each rank.
ROWS = np.append(np.where(np.arange(EDGE) < OUTPUTS - 1, np.arange(EDGE), OUTPUTS - 1 + np.arange(EDGE) % RARE_ROWS), OUTPUTS - 1 + RARE_ROWS).astype(np.int32)
ROUNDS, STRIDE, BATCH, RATE = 2, 2, 8192, 0.15
#: Ids that a copy of the network is trained on.
REPLICA_IDS = 4_000_000
#: Results of training that one task of the tree averages.
FAN_IN = 16


@dataclass
class Network:
    tables: np.ndarray  #: (2 * SIDE, rows, HIDDEN); the last row is for places beyond the text
    bias: np.ndarray
    to_class: np.ndarray  #: (HIDDEN + 1, CLASSES)
    to_token: np.ndarray  #: (CLASSES, HIDDEN + 1, PER_CLASS)
    to_rare: np.ndarray  #: (HIDDEN + 1, RARE_CLASSES)

    @classmethod
    def new(cls, seed: int = 1) -> Network:
        r = np.random.default_rng(seed)
        draw = lambda *shape: r.normal(0, 0.3, shape).astype(np.float32)
        return cls(draw(2 * SIDE, int(ROWS[-1]) + 1, HIDDEN), np.zeros(HIDDEN, np.float32), *(draw(*shape) * np.float32(0.3) for shape in ((HIDDEN + 1, CLASSES), (CLASSES, HIDDEN + 1, PER_CLASS), (HIDDEN + 1, RARE_CLASSES))))

    def parts(self) -> list[np.ndarray]:
        return [self.tables, self.bias, self.to_class, self.to_token, self.to_rare]

    def vector(self) -> np.ndarray:
        return np.concatenate([x.reshape(-1) for x in self.parts()])

    @classmethod
    def of(cls, vector: np.ndarray) -> Network:
        out, at = cls.new(), 0
        for name in ("tables", "bias", "to_class", "to_token", "to_rare"):
            x = getattr(out, name)
            setattr(out, name, vector[at : at + x.size].reshape(x.shape).astype(np.float32))
            at += x.size
        return out

    def hidden(self, rows: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """(activations with a 1 at the end, rows of the ids around each place). rows: of the stream."""
        around = [rows.take(at + o) for o in (*range(-SIDE, 0), *range(1, SIDE + 1))]
        h = np.empty((len(at), HIDDEN + 1), np.float32)
        h[:, HIDDEN] = 1
        total = self.tables[0].take(around[0], 0)
        for t, ids in zip(self.tables[1:], around[1:], strict=True):
            total += t.take(ids, 0)
        total += self.bias
        np.tanh(total, out=h[:, :HIDDEN])
        return h, around

    def log_probs(self, stream: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Of the ids at the places `at`; of a rare one without its share of its class."""
        out, rows = np.empty(len(at), np.float32), ROWS.take(stream)
        for a in range(0, len(at), BATCH):
            place = at[a : a + BATCH]
            out[a : a + BATCH] = self._log_probs(self.hidden(rows, place)[0], stream.take(place))
        return out

    def _log_probs(self, h: np.ndarray, ranks: np.ndarray) -> np.ndarray:
        ids = np.minimum(ranks, OUTPUTS - 1)
        order, classes, within, edges = _by_class(ids)
        h = h.take(order, 0)
        found = _Softmax(h @ self.to_class)
        inner = _Softmax(self._inner(h, edges))
        sorted_ = found.log_of(classes) + inner.log_of(within)
        rare = np.flatnonzero(ids[order] == OUTPUTS - 1)
        if len(rare):
            sorted_[rare] += _Softmax(h[rare] @ self.to_rare).log_of(rare_class(ranks[order[rare]]))
        out = np.empty(len(ids), np.float32)
        out[order] = sorted_
        return out

    def _inner(self, h: np.ndarray, edges: np.ndarray) -> np.ndarray:
        inner = np.empty((len(h), PER_CLASS), np.float32)
        for c in range(CLASSES):
            if edges[c] < edges[c + 1]:
                np.matmul(h[edges[c] : edges[c + 1]], self.to_token[c], out=inner[edges[c] : edges[c + 1]])
        return inner

    def train(self, stream: np.ndarray, at: np.ndarray, squares: list[np.ndarray]) -> None:
        """A step of Adagrad for each BATCH of places; squares: sums of squared gradients, as parts()."""
        table_rows = ROWS.take(stream)
        for a in range(0, len(at), BATCH):
            place = at[a : a + BATCH]
            n = np.float32(len(place))
            order, classes, within, edges = _by_class(np.minimum(stream.take(place), OUTPUTS - 1))
            place = place.take(order)
            h, around = self.hidden(table_rows, place)
            d = _Softmax(h @ self.to_class).less(classes)
            back = d @ self.to_class.T
            g_class = h.T @ d / n
            g_token, g_rare = np.zeros_like(self.to_token), np.zeros_like(self.to_rare)
            e = _Softmax(self._inner(h, edges)).less(within)
            for c in range(CLASSES):
                i, j = edges[c], edges[c + 1]
                if i < j:
                    back[i:j] += e[i:j] @ self.to_token[c].T
                    g_token[c] = h[i:j].T @ e[i:j] / n
            ranks = stream.take(place)
            rare = np.flatnonzero(ranks >= OUTPUTS - 1)
            if len(rare):
                e = _Softmax(h[rare] @ self.to_rare).less(rare_class(ranks[rare]))
                back[rare] += e @ self.to_rare.T
                g_rare = h[rare].T @ e / n
            d_in = back[:, :HIDDEN] * (1 - h[:, :HIDDEN] ** 2) / n
            for p, g, s in zip(self.parts()[1:], [d_in.sum(0), g_class, g_token, g_rare], squares[1:], strict=True):
                s += g * g
                p -= np.float32(RATE) * g / (np.sqrt(s) + np.float32(1e-6))
            for t, ids, s in zip(self.tables, around, squares[0], strict=True):  # only the rows that occur have a gradient
                by = np.argsort(ids.astype(np.uint16), kind="stable")
                ids = ids[by]
                first = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
                g, ids = np.add.reduceat(d_in.take(by, 0), first), ids[first]
                sums = s[ids] + g * g
                s[ids] = sums
                t[ids] -= np.float32(RATE) * g / (np.sqrt(sums) + np.float32(1e-6))


def _by_class(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(an order by class; in it the classes, places within them; where each class begins and the last ends)."""
    classes = ids % CLASSES
    order = np.argsort(classes.astype(np.uint8), kind="stable")
    classes = classes.take(order)
    return order, classes, ids.take(order) // CLASSES, np.searchsorted(classes, np.arange(CLASSES + 1))


def rare_class(ranks: np.ndarray) -> np.ndarray:
    return (ranks - (OUTPUTS - 1)) % RARE_CLASSES


class _Softmax:
    """Of logits, which it overwrites. Where any is far from 0 the greatest of its row is taken off, so that nothing overflows or vanishes."""

    def __init__(self, x: np.ndarray):
        if x.size and not (x.max() < 60 and x.min() > -60):
            x -= x.max(1, keepdims=True)
        self.x, self.at = x, np.arange(len(x)) * x.shape[1]

    def log_of(self, which: np.ndarray) -> np.ndarray:
        """The logarithm of one probability a row."""
        out = self.x.reshape(-1).take(self.at + which)
        np.exp(self.x, out=self.x)
        return out - np.log(self.x @ np.ones(self.x.shape[1], np.float32))

    def less(self, which: np.ndarray) -> np.ndarray:
        """The probabilities, of which one a row is lessened by 1."""
        np.exp(self.x, out=self.x)
        self.x /= (self.x @ np.ones(self.x.shape[1], np.float32))[:, None]
        self.x.reshape(-1)[self.at + which] -= 1
        return self.x


def streamed(documents: list[np.ndarray], rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ranks of all ids, with SIDE empty places before, between and after documents; the places of ids)."""
    sizes = np.array([len(x) for x in documents], np.int64)
    n = int(sizes.sum()) + SIDE * (len(documents) + 1)
    out = np.full(n, EDGE, np.int32)
    at = np.arange(int(sizes.sum())) + SIDE * (1 + np.repeat(np.arange(len(documents)), sizes))
    out[at] = rank[np.concatenate(documents)] if len(at) else 0
    return out, at


def in_round(documents: list[np.ndarray], turn: int, stride: int) -> np.ndarray:
    """Of all ids one after another, which train in a round: told by the place in the document, so that no order of documents matters."""
    sizes = np.array([len(x) for x in documents], np.int64)
    return (np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)) % stride == turn % stride


@dataclass
class Scorer:
    rank: np.ndarray  #: of each token id
    share: np.ndarray  #: logarithm of each rank's share of its class of rare ids; 0 for frequent ones
    network: Network

    def scores(self, documents: list[np.ndarray]) -> np.ndarray:
        """The sum of the log-probabilities of each document's ids."""
        stream, at = streamed(documents, self.rank)
        logs = self.network.log_probs(stream, at).astype(np.float64)
        logs += self.share.take(stream.take(at))
        ends = np.cumsum([len(x) for x in documents])
        upto = np.append(0, np.cumsum(logs))[np.append(0, ends)]
        return np.diff(upto)


def _ids_of(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(x.as_py(), np.uint16) for x in batch.column("ids")]


def token_table(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """docs' (doc_id, text) as (doc_id, ids): a document's ids, 16 bits each, as a stored table."""
    path = vocabulary or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            ids, sizes = encoder(path).encode(texts_of(batch))
            ends = np.cumsum(sizes)
            raw = ids.tobytes()
            own = [raw[2 * (b - n) : 2 * (b - 1)] for b, n in zip(ends.tolist(), sizes.tolist(), strict=True)]  # without the end's id
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(own, pa.binary())], names=["doc_id", "ids"])

    return stored(docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids binary"), "tokens")


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(65536, np.int64)
    for batch in slices(batches, "ids"):
        total += np.bincount(np.concatenate([np.zeros(0, np.uint16), *_ids_of(batch)]), minlength=65536)
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["id", "n"])


def ranks(tokens: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(rank of each id by its count in all documents, logarithm of each rank's share of its class of rare ids). An id that no document has counts as one."""
    counts = tokens.select("ids").mapInArrow(_counts, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()  # 65,536 rows at most
    n = np.zeros(EDGE, np.int64)
    for r in counts:
        n[r["id"]] = r["n"]
    order = np.argsort(-n, kind="stable")
    rank = np.empty(EDGE, np.int32)
    rank[order] = np.arange(EDGE)
    own = np.maximum(n[order], 1).astype(np.float64)
    share, rare = np.zeros(EDGE), np.arange(OUTPUTS - 1, EDGE)
    share[rare] = np.log(own[rare] / np.bincount(rare_class(rare), own[rare], RARE_CLASSES)[rare_class(rare)])
    return rank, share


def replicas(tokens: DataFrame, ids: int = REPLICA_IDS) -> int:
    """How many copies of the network train side by side: one for each REPLICA_IDS ids there are."""
    return max(1, -(-(tokens.agg(F.sum(F.octet_length("ids"))).head()[0] or 0) // (2 * ids)))


def trained(tokens: DataFrame, rank: np.ndarray, rounds: int = ROUNDS, stride: int = STRIDE, n: int | None = None) -> Network:
    """A network from all documents. No ids: an untrained one.

    Documents are dealt to n replicas, and ordered in them, by a hash of id and text, so that the network is the same
    however the table is laid out. A replica sends how far its parameters have moved, in half precision.
    """
    network, spark = Network.new(), tokens.sparkSession
    n = n or replicas(tokens)
    dealt = tokens.withColumn("mark", F.xxhash64("doc_id", "ids")).repartition(n, "mark").sortWithinPartitions("mark", "ids").select("ids")
    for turn in range(rounds):
        start = network.vector()
        shared = spark.sparkContext.broadcast((start, rank))  # its size is fixed by the network's

        def run(batches: Iterator[pa.RecordBatch], shared=shared, turn=turn) -> Iterator[pa.RecordBatch]:
            vector, rank = shared.value
            own, weight = Network.of(vector), 0
            squares = [np.full(x.shape, 1e-8, np.float32) for x in own.parts()]
            for batch in slices(batches, "ids"):
                documents = _ids_of(batch)
                stream, at = streamed(documents, rank)
                at = at[in_round(documents, turn, stride)]
                own.train(stream, at, squares)
                weight += len(at)
            if weight:
                yield _sent(weight, own.vector() - vector)

        found, k = dealt.mapInArrow(run, SENT), n
        while k > 1:
            k = -(-k // FAN_IN)
            found = found.repartition(k).mapInArrow(_averaged, SENT)
        got = found.collect()  # one row
        if not got:
            return network
        network = Network.of(start + np.frombuffer(bytes(got[0]["moved"]), "<f2").astype(np.float32))
    return network


SENT = "weight double, moved binary"


def _sent(weight: float, moved: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([float(weight)]), pa.array([moved.astype("<f2").tobytes()], pa.binary())], names=["weight", "moved"])


def _averaged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for all: the mean by weight."""
    weight, total = 0.0, None
    for batch in batches:
        for w, v in zip(batch.column("weight").to_pylist(), batch.column("moved"), strict=True):
            x = w * np.frombuffer(v.as_py(), "<f2").astype(np.float64)
            weight, total = weight + w, x if total is None else total + x
    if total is not None:
        yield _sent(weight, total / weight)


def fit(tokens: DataFrame) -> Scorer:
    rank, share = ranks(tokens)
    return Scorer(rank, share, trained(tokens, rank))


def score(tokens: DataFrame, scorer: Scorer) -> DataFrame:
    """(doc_id, n_tokens, log_prob, mean_log_prob): a row for each row of tokens. A document without ids (its text null, empty or blank) has a sum of 0 and a mean of null. Repeated rows have equal scores."""
    shared = tokens.sparkSession.sparkContext.broadcast(scorer)
    kind = tokens.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "ids"):
            documents = _ids_of(batch)
            sums = shared.value.scores(documents)
            sizes = [len(x) for x in documents]
            means = [s / n if n else None for s, n in zip(sums.tolist(), sizes, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(sums), pa.array(means, pa.float64())], names=["doc_id", "n_tokens", "log_prob", "mean_log_prob"])

    return tokens.mapInArrow(run, f"doc_id {kind}, n_tokens long, log_prob double, mean_log_prob double")


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = token_table(table(spark, sf_dir, "documents"))
    return score(tokens, fit(tokens))
