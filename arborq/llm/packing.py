"""Packing into fixed windows by order-preserving dynamic programming.

Documents in ascending id order are one stream of token ids. A window may end at the end of a document (free) or of a
sentence (SENTENCE_COST); only in a stretch of over a window without either, where no other cut could be made, at a grid
place (WORD_COST). The cuts minimise padding plus these costs. With p the places and f the least cost of a stream cut at j,

    f(j) = cost(j) + min over i with p(j) - p(i) <= window of  f(i) + window - (p(j) - p(i)),

so the transition is a sliding minimum of f(i) + p(i), which a monotone queue gives in constant time. A partition is
solved in blocks of about BLOCK ids; what is left at the end of a block is carried into the next.

Where two partitions meet, a window holds the end of one and the beginning of the next, as they follow each other in the
stream. So that neither has to know the other, a partition gives the window before it what comes up to its last sentence
or document end within half a window, and leaves no more than half a window at its own end. Every sequence is therefore a
stretch of the stream, and they follow each other in its order.
"""

from __future__ import annotations

import bisect
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborq.llm.common import slices, stored, table, texts_of
from arborq.llm.tokens import default_vocabulary, encoder

WINDOW = 4096
#: In ids of padding, for windows of WINDOW ids; for others in proportion, and so is the grid's STRIDE.
SENTENCE_COST, WORD_COST = 32, 512
STRIDE, BLOCK = 512, 1_000_000
#: Numbers of windows that a partition shares, with the one after it and the one before it.
AFTER, BEFORE = -1, -2
#: Sequence ids of partition p start at p << 32; the one that it shares with the next is the last of them.
LAST = (1 << 32) - 1


def cuts(places: np.ndarray, costs: np.ndarray, window: int = WINDOW, room: int | None = None) -> list[int]:
    """places: ascending, from 0 on, no more than a window from each to the next. Indexes into places where windows end, of least cost: when what follows the last is under a window and costs nothing, or with `room` given, when it has to fit into that, and what it leaves of it is padding."""
    p, c = places.tolist(), costs.tolist()
    g, back = [0] * len(p), [0] * len(p)
    queue: deque[int] = deque([0])
    push, pop, left = queue.append, queue.pop, queue.popleft
    for j in range(1, len(p)):
        pj = p[j]
        low = pj - window
        while p[queue[0]] < low:
            left()
        i = queue[0]
        back[j] = i
        gj = g[i] + window + c[j]  # f(j) + p(j)
        g[j] = gj
        while queue and g[queue[-1]] >= gj:
            pop()
        push(j)
    if room is None:
        first = bisect.bisect_right(p, p[-1] - window)
        at = min(range(first, len(p)), key=lambda i: g[i] - p[i]) if first < len(p) else len(p) - 1
    else:
        at = min(range(bisect.bisect_left(p, p[-1] - room), len(p)), key=lambda i: g[i])
    out = []
    while at:
        out.append(at)
        at = back[at]
    return out[::-1]


def candidates(doc_ends: np.ndarray, sentence_ends: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(places, costs) of all places where a window may end, and 0: ends of documents and sentences, and a grid where these are over a window apart."""
    sentence, word, stride = (max(1, x * window // WINDOW) for x in (SENTENCE_COST, WORD_COST, STRIDE))
    soft = sentence_ends[~np.isin(sentence_ends, doc_ends, assume_unique=True)]
    places, costs = np.concatenate([[0], doc_ends, soft]), np.concatenate([[0], np.zeros(len(doc_ends), np.int64), np.full(len(soft), sentence)])
    order = np.argsort(places, kind="stable")
    places, costs = places[order], costs[order]
    gaps = np.diff(places)
    wide = np.flatnonzero(gaps > window)
    if len(wide):
        grid = np.concatenate([np.arange(places[i] + stride, places[i + 1], stride) for i in wide])
        places, costs = np.append(places, grid), np.append(costs, np.full(len(grid), word))
        order = np.argsort(places, kind="stable")
        places, costs = places[order], costs[order]
    return places.astype(np.int64), costs.astype(np.int64)


def sentence_ids(tokenizer) -> np.ndarray:
    """Which ids end a sentence."""
    out = np.zeros(65536, bool)
    for token, i in tokenizer.get_vocab().items():
        out[i] = token.removesuffix("</w>")[-1:] in {".", "!", "?"}
    return out


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, window_no long, offset long"


class Packer:
    """Takes documents in order and gives pieces; ``flush`` gives the last ones. Those with window_no AFTER or BEFORE go into the windows shared with the partitions beside it; the first partition has none before it."""

    def __init__(self, part: int, ends: np.ndarray, window: int = WINDOW, block: int = BLOCK):
        self.part, self.ends, self.window, self.block = part, ends, window, block
        self.ids, self.docs = [], []  # of docs: (doc_id, ids before the buffer that belong to it, ids in the buffer, all ids)
        self.size = self.windows = 0
        self.begun = part == 0

    def add(self, doc_ids: list, ids: np.ndarray, lengths: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.ids.append(ids)
        self.docs += [(d, 0, n, n) for d, n in zip(doc_ids, lengths.tolist(), strict=True)]
        self.size += len(ids)
        if self.size >= self.block:
            yield self._solve(False)

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.size:
            yield self._solve(True)

    def _solve(self, last: bool) -> pa.RecordBatch:
        ids = np.concatenate(self.ids)
        lengths = np.array([x[2] for x in self.docs], np.int64)
        doc_ends = np.cumsum(lengths)
        sentence_ends = np.flatnonzero(self.ends[ids]) + 1
        head = 0
        if not self.begun:
            head = max((int(x[k]) for x in (doc_ends, sentence_ends) if (k := int(np.searchsorted(x, self.window // 2, "right")) - 1) >= 0), default=0)
            self.begun = True
        places, costs = candidates(doc_ends, sentence_ends, self.window)
        places, costs = places[places >= head] - head, costs[places >= head]
        ends = head + places[cuts(places, costs, self.window, self.window - self.window // 2 if last else None)]
        ends = np.append(head, ends) if head else ends
        cut = int(ends[-1]) if len(ends) else 0
        stop = np.unique(np.concatenate([ends, doc_ends[doc_ends <= cut], doc_ends[doc_ends > cut] if last else []]).astype(np.int64))
        start = np.append(0, stop)[:-1] if len(stop) else stop
        doc = np.searchsorted(doc_ends, start, "right")
        window = np.searchsorted(ends, start, "right")
        begins = np.append(0, ends)[window]
        raw = memoryview(ids.astype("<u4")).cast("B")
        crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(start.tolist(), stop.tolist(), strict=True)]
        before = np.array([x[1] for x in self.docs], np.int64) - (doc_ends - lengths)
        shared = int(head > 0)
        numbers = np.where(window < shared, BEFORE, np.where(window < len(ends), window - shared + self.windows, AFTER))
        columns = [
            pa.array([self.docs[i][0] for i in doc.tolist()], pa.int64()), pa.array(start + before[doc]), pa.array(stop - start), pa.array(crc, pa.int64()), pa.array([self.docs[i][3] for i in doc.tolist()], pa.int64()),
            pa.array(np.full(len(start), self.part, np.int32)), pa.array(numbers), pa.array(start - begins),
        ]
        self.windows += len(ends) - shared
        first = int(np.searchsorted(doc_ends, cut, "right"))
        begin = int((doc_ends - lengths)[first]) if first < len(self.docs) else cut
        self.docs = self.docs[first:]
        if self.docs and cut > begin:
            d, b, n, total = self.docs[0]
            self.docs[0] = (d, b + cut - begin, n - (cut - begin), total)
        self.ids, self.size = [ids[cut:]], len(ids) - cut
        return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in PIECES.split(", ")])


def _pack(vocabulary: str, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode = encoder(vocabulary)
        packer = Packer(TaskContext.get().partitionId(), sentence_ids(encode.tokenizer), window)
        for batch in slices(batches, "text"):
            yield from packer.add(batch.column("doc_id").to_pylist(), *encode.encode(texts_of(batch)))
        yield from packer.flush()

    return run


def shared_windows(parts: list[tuple[int, int, int]], window: int = WINDOW) -> list[tuple[int, int, int, int]]:
    """(part, window_no, sequence_id, offset) of what each partition shares with the one before and the one after it, from (part, ids at its beginning, ids at its end) of those that have any ids."""
    out, before = [], None
    for part, head, tail in sorted(parts):
        if head:
            sequence, used = before or (part - 1 << 32 | LAST, 0)
            if used + head > window:
                raise AssertionError(f"{used} and {head} ids share a window of {window}")
            out.append((part, BEFORE, sequence, used))
        if tail:
            out.append((part, AFTER, part << 32 | LAST, 0))
        before = part << 32 | LAST, tail
    return out


def pack(docs: DataFrame, window: int = WINDOW, vocabulary: str | None = None, partitions: int | None = None) -> DataFrame:
    """docs: (doc_id, text), other columns are left out. One row for each piece:

    doc_id, start (ids of the document before it), length, ids_crc32 (of its ids as little-endian unsigned 32-bit
    integers), doc_tokens (the document's ids), sequence_id, offset (the piece's place in its sequence of `window` ids).
    Ascending (sequence_id, offset) is the order of the stream. A document is its text's ids and END_ID, so that null and
    empty texts are one id. Rows that repeat or share an id are documents of their own; those with a null id come first. An
    empty table gives an empty result. Of each partition two lengths go to the driver.
    """
    spark = docs.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long"), "text").withColumn("mark", F.xxhash64("text"))
    rows = rows.repartitionByRange(n, "doc_id", "mark").sortWithinPartitions("doc_id", "mark").select("doc_id", "text")
    pieces = stored(rows.mapInArrow(_pack(vocabulary or default_vocabulary(), window), PIECES), "pieces")
    length = lambda k: F.coalesce(F.sum(F.when(F.col("window_no") == k, F.col("length"))), F.lit(0))
    parts = pieces.groupBy("part").agg(length(BEFORE).alias("head"), length(AFTER).alias("tail")).collect()
    at = spark.createDataFrame(shared_windows([tuple(r) for r in parts], window), "part int, window_no long, shared_id long, shared_offset long")
    own = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    placed = pieces.join(F.broadcast(at), ["part", "window_no"], "left")  # two rows a partition
    sequence = F.coalesce("shared_id", F.shiftleft(F.col("part").cast("long"), 32).bitwiseOR(F.col("window_no")))
    return placed.select(*own, sequence.alias("sequence_id"), (F.col("offset") + F.coalesce("shared_offset", F.lit(0))).alias("offset"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
