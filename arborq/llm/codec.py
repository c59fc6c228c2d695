"""Token-id files with an adaptive context-mixing range coder.

A file holds documents in order: a header, then blocks of BLOCK ids. Each block starts from a fresh model and has a crc32
of its ids, so it can be read, and found damaged, without any other. Ids are coded as ranks by how often the file has
them; the header has that list. For each id:

- order 2 and order 1: the slot of the last two ids, and that of the last one, each hold the id that came there last and
  how sure that is. The candidate is order 2's, or else order 1's. Adaptive chances for the states of orders 2, 1 and 0
  (how often candidates were right at all) are mixed in the logistic domain, with weights that learn from each outcome;
  one binary decision says whether the candidate is right.
- order 0: if it isn't, the rank's class (the power of two it lies in) is coded by the block's adaptive frequencies, and
  the place in its class evenly.

All blocks of a file go through the model side by side: a step of numpy codes one id of each. Arithmetic is in integers.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arborq.llm.common import slices, stored, table, texts_of
from arborq.llm.tokens import default_vocabulary, encoder

MAGIC = b"IDCM0001"
BLOCK, LANES = 2048, 2048  #: ids of a block; blocks that go side by side
FILE_IDS = BLOCK * LANES  #: a file is closed at the first document's end after so many
SLOTS1, SLOTS2, SURE, REFRESH = 512, 1024, 15, 32
TOP, WORD = np.uint64(1 << 40), np.uint64(16)
HEAD = struct.Struct("<8sIQIIQ")  # magic, block, ids, documents, ranks, words

_x = np.arange(4096)
STRETCH = np.clip(np.round(256 * np.log((_x + 0.5) / (4095.5 - _x))), -2047, 2047).astype(np.int32)
SQUASH = np.clip(np.round(4096 / (1 + np.exp(-(_x - 2048) / 256))), 24, 4072).astype(np.int32)
CLASSES = 17
CLASS = np.floor(np.log2(np.arange(1, 65537))).astype(np.int32)


#: What is added to a slot (its id over 4 bits of sureness) when it is wrong, then when it is right, by sureness.
STEP = np.array([-((k + 1) >> 1) for k in range(SURE + 1)] + [1] * SURE + [0], np.int32)


class Model:
    """Of n blocks side by side. In arrays with two rows the first is for order 2, the second for order 1; with three, the third is for order 0."""

    def __init__(self, n: int):
        lanes = np.arange(n)
        self.at = np.stack([lanes * SLOTS2, n * SLOTS2 + lanes * SLOTS1])
        self.at_s = np.stack([lanes * (SURE + 1), (n + lanes) * (SURE + 1)])
        self.at_c = lanes * CLASSES
        self.slots = np.zeros(n * (SLOTS1 + SLOTS2), np.int32)
        start = np.tile(np.minimum(400 + 220 * np.arange(SURE + 1), 3900), n)
        self.chances = np.concatenate([start, start // 2]).astype(np.int32)
        self.hits = np.full(n, 800, np.int32)
        self.weights = np.repeat(np.array([[32000], [16000], [12000]], np.int32), n, 1)
        self.prev1 = self.prev2 = np.zeros(n, np.int64)
        self.counts = np.full((n, CLASSES), 2, np.int32)
        self.steps = 0
        self._room()
        self.refresh()

    def _room(self) -> None:
        n = len(self.hits)
        self.k, self.x = np.empty((2, n), np.int64), np.empty((3, n), np.int32)

    def refresh(self) -> None:
        """The classes' cumulative frequencies, in all 4096; each has 1 at least."""
        np.clip(self.weights, -65000, 65000, out=self.weights)
        total = self.counts.sum(1, keepdims=True)
        freq = 1 + self.counts * (4096 - CLASSES) // total
        freq[:, 0] += 4096 - freq.sum(1)
        self.cum = np.full((len(freq), 32), 4096, np.int32)
        self.cum[:, 0] = 0
        np.cumsum(freq, 1, out=self.cum[:, 1 : CLASSES + 1])

    def shrink(self, keep: int) -> None:
        """Later steps are for the first `keep` blocks only."""
        for name in ("at", "at_s", "weights"):
            setattr(self, name, np.ascontiguousarray(getattr(self, name)[:, :keep]))
        for name in ("at_c", "hits", "prev1", "prev2", "counts", "cum"):
            setattr(self, name, getattr(self, name)[:keep])
        self._room()

    def predict(self) -> tuple[np.ndarray, np.ndarray]:
        """(candidate, chance of 4096 that it is right) for each block."""
        np.bitwise_and(self.prev1 * 40503 + self.prev2 * 10007 >> 5, SLOTS2 - 1, out=self.k[0])
        np.bitwise_and(self.prev1, SLOTS1 - 1, out=self.k[1])
        self.k += self.at
        self.s = self.slots.take(self.k)
        self.c, self.sure = self.s >> 4, self.s & SURE
        self.j = self.at_s + self.sure
        self.q = self.chances.take(self.j)
        STRETCH.take(self.q, out=self.x[:2], mode="clip")
        STRETCH.take(self.hits, out=self.x[2], mode="clip")
        dot = np.multiply(self.weights, self.x)
        sums = dot[0] + dot[1]
        sums += dot[2]
        sums >>= 16
        sums += 2048
        self.chance = SQUASH.take(sums, mode="clip")
        return np.where(self.sure[0] > 0, self.c[0], self.c[1]), self.chance

    def update(self, rank: np.ndarray, hit: np.ndarray, missed: np.ndarray, classes: np.ndarray) -> None:
        """rank: what came; hit: whether that is the candidate; missed: the blocks where not, classes: of the ranks there."""
        came = np.multiply(hit, 4096, dtype=np.int32)
        change = self.x * ((came - self.chance) * 6)
        change += 8192
        change >>= 14
        self.weights += change
        came -= self.hits
        came >>= 6
        self.hits += came
        right = self.c == rank
        to = np.multiply(right, 4096, dtype=np.int32)
        to -= self.q
        to >>= 5
        to += self.q
        self.chances[self.j] = to
        step = STEP.take(np.add(self.sure, np.multiply(right, SURE + 1, dtype=np.int32)))
        step += self.s
        right |= self.sure > 1
        self.slots[self.k] = np.where(right, step, (rank << 4) + 1)
        if len(missed):
            self.counts.reshape(-1)[self.at_c[missed] + classes] += 24
        self.steps += 1
        if self.steps % REFRESH == 0:
            big = self.counts.sum(1) > 6000
            if big.any():
                self.counts[big] = (self.counts[big] + 1) >> 1
            self.refresh()
        self.prev2, self.prev1 = self.prev1, rank.astype(np.int64)


def _lanes(n: int, block: int) -> tuple[int, np.ndarray]:
    """(blocks, ids of each); only the last may be short."""
    blocks = -(-n // block)
    sizes = np.full(blocks, block, np.int64)
    if blocks:
        sizes[-1] = n - (blocks - 1) * block
    return blocks, sizes


def _groups(blocks: int) -> list[tuple[int, int]]:
    """(first, after the last) of the blocks that go side by side: about LANES each, for a few alone would take as many steps."""
    n = max(1, round(blocks / LANES))
    edges = [blocks * i // n for i in range(n + 1)]
    return [(a, b) for a, b in zip(edges, edges[1:], strict=False) if a < b]


def _encode_lanes(ranks: np.ndarray, sizes: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """(words of all blocks one after another, words of each)."""
    n = len(sizes)
    padded = np.zeros(n * block, np.int32)
    padded[: len(ranks)] = ranks
    columns = np.ascontiguousarray(padded.reshape(n, block).T)
    model, short = Model(n), int(sizes[-1])
    width = block * 3 + 8  # a rank takes 36 bits at most
    out = np.zeros(n * width, np.uint32)
    at = np.arange(n, dtype=np.int64) * width
    low, span = np.zeros(n, np.uint64), np.full(n, (1 << 56) - 1, np.uint64)
    for step in range(int(sizes.max())):
        if step == short and n > 1 and len(model.hits) == n:
            model.shrink(n - 1)
        m = len(model.hits)
        rank = columns[step, :m]
        lo, sp = low[:m], span[:m]
        candidate, chance = model.predict()
        hit = rank == candidate
        bound = (sp >> np.uint64(12)) * chance.astype(np.uint64)
        missed = np.flatnonzero(~hit)
        rest = sp[missed] - bound[missed]
        np.copyto(sp, bound)
        wanted = rank[missed]
        classes = CLASS.take(wanted)
        c = classes + missed * 32
        cum = model.cum.reshape(-1)
        unit = rest >> np.uint64(12)
        first = cum.take(c).astype(np.uint64)
        wide = classes.astype(np.uint64)
        part = (unit * (cum.take(c + 1).astype(np.uint64) - first)) >> wide
        lo[missed] += bound[missed] + unit * first + part * (wanted + 1 - (1 << classes)).astype(np.uint64)
        sp[missed] = part
        model.update(rank, hit, missed, classes)
        carry = np.flatnonzero(lo >> np.uint64(56))
        if len(carry):
            out[at[carry] - 1] += 1
            lo[carry] &= np.uint64((1 << 56) - 1)
        small = np.flatnonzero(sp < TOP)
        while len(small):
            x = lo[small]
            out[at[small]] = x >> np.uint64(40)
            at[small] += 1
            lo[small] = (x & np.uint64((1 << 40) - 1)) << WORD
            sp[small] <<= WORD
            small = small[sp[small] < TOP]
    for shift in (40, 24, 8):
        out[at] = (low >> np.uint64(shift)) & np.uint64(0xFFFF)
        at += 1
    out[at] = (low & np.uint64(0xFF)) << np.uint64(8)
    at += 1
    used = at - np.arange(n) * width
    table2 = out.reshape(n, width)
    over = table2 >> 16
    while over.any():  # carries that reach further back
        table2 &= 0xFFFF
        table2[:, :-1] += over[:, 1:]
        over = table2 >> 16
    return np.concatenate([table2[i, : used[i]] for i in range(n)]).astype("<u2"), used


def _decode_lanes(words: np.ndarray, used: np.ndarray, sizes: np.ndarray, block: int) -> np.ndarray:
    """The ranks of all blocks."""
    n = len(sizes)
    words = np.append(words.astype(np.uint64), np.zeros(4, np.uint64))
    at = np.cumsum(used) - used
    code = (words[at] << np.uint64(40)) | (words[at + 1] << np.uint64(24)) | (words[at + 2] << np.uint64(8)) | (words[at + 3] >> np.uint64(8))
    at = at + 3  # 56 bits are three words and a half
    model, short = Model(n), int(sizes[-1])
    columns = np.zeros((block, n), np.int32)
    span = np.full(n, (1 << 56) - 1, np.uint64)
    for step in range(int(sizes.max())):
        if step == short and n > 1 and len(model.hits) == n:
            model.shrink(n - 1)
        m = len(model.hits)
        co, sp = code[:m], span[:m]
        candidate, chance = model.predict()
        bound = (sp >> np.uint64(12)) * chance.astype(np.uint64)
        hit = co < bound
        missed = np.flatnonzero(~hit)
        rank = candidate.copy()
        edge = bound[missed]
        rest, left = sp[missed] - edge, co[missed] - edge
        np.copyto(sp, bound)
        unit = np.maximum(rest >> np.uint64(12), np.uint64(1))
        target = np.minimum(left // unit, np.uint64(4095)).astype(np.int32)
        cum = model.cum.reshape(-1)
        row = missed * 32
        c = row.copy()
        for step_of in (16, 8, 4, 2, 1):  # the last place with no more than target
            c += step_of * (cum.take(c + step_of) <= target)
        classes = (c - row).astype(np.int32)
        first = cum.take(c).astype(np.uint64)
        wide = classes.astype(np.uint64)
        part = (unit * (cum.take(c + 1).astype(np.uint64) - first)) >> wide
        left -= unit * first
        place = left // np.maximum(part, np.uint64(1))
        rank[missed] = np.minimum(place, np.uint64(65535)).astype(np.int32) - 1 + (1 << classes)
        co[missed] = left - place * part
        sp[missed] = part
        columns[step, :m] = rank
        model.update(rank, hit, missed, classes)
        small = np.flatnonzero(sp < TOP)
        while len(small):
            a = np.minimum(at[small], len(words) - 2)  # damaged blocks may run on
            fresh = ((words[a] & np.uint64(0xFF)) << np.uint64(8)) | (words[a + 1] >> np.uint64(8))
            co[small] = (co[small] << WORD) | fresh
            at[small] = a + 1
            sp[small] <<= WORD
            small = small[sp[small] < TOP]
    flat = columns.T.reshape(-1)
    return flat[: int(sizes.sum())]


def encode_file(doc_ids: list[int | None], lengths: np.ndarray, ids: np.ndarray, block: int = BLOCK) -> bytes:
    """doc_ids and lengths (ids of each document) in order; ids: all of them, below 65536."""
    counts = np.bincount(ids, minlength=65536)
    order = np.argsort(-counts, kind="stable")[: np.count_nonzero(counts)]
    place = np.zeros(65536, np.int32)
    place[order] = np.arange(len(order), dtype=np.int32)
    ranks = place.take(ids)
    blocks, sizes = _lanes(len(ids), block)
    words, used = [], []
    for a, b in _groups(blocks):
        w, u = _encode_lanes(ranks[a * block : b * block], sizes[a:b], block)
        words.append(w)
        used.append(u)
    raw = memoryview(np.ascontiguousarray(ids, "<u2")).cast("B")
    crcs = [zlib.crc32(raw[2 * k * block : 2 * (k + 1) * block]) for k in range(blocks)]
    body = b"".join(
        [
            order.astype("<u2").tobytes(),
            np.array([d is None for d in doc_ids], np.uint8).tobytes(),
            np.array([d or 0 for d in doc_ids], "<i8").tobytes(),
            np.asarray(lengths, "<u4").tobytes(),
            np.concatenate(used or [np.zeros(0)]).astype("<u4").tobytes(),
            np.array(crcs, "<u4").tobytes(),
        ]
    )
    head = HEAD.pack(MAGIC, block, len(ids), len(doc_ids), len(order), sum(map(len, words))) + body
    return head + struct.pack("<I", zlib.crc32(head)) + b"".join(w.tobytes() for w in words)


def decode_file(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """What encode_file was given. Raises ValueError on a damaged header or block."""
    magic, block, n, docs, seen, n_words = HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a token-id file")
    blocks, sizes = _lanes(n, block)
    at = HEAD.size
    parts = []
    for kind, count in (("<u2", seen), (np.uint8, docs), ("<i8", docs), ("<u4", docs), ("<u4", blocks), ("<u4", blocks)):
        parts.append(np.frombuffer(data, kind, count, at))
        at += parts[-1].nbytes
    if zlib.crc32(data[:at]) != struct.unpack_from("<I", data, at)[0]:
        raise ValueError("the header is damaged")
    order, missing, doc_ids, lengths, used, crcs = parts
    words = np.frombuffer(data, "<u2", n_words, at + 4)
    ids = np.empty(n, np.uint16)
    upto = np.append(0, np.cumsum(used.astype(np.int64)))
    for a, b in _groups(blocks):
        ranks = _decode_lanes(words[upto[a] : upto[b]], used[a:b].astype(np.int64), sizes[a:b], block)
        ids[a * block : a * block + len(ranks)] = order[np.minimum(ranks, seen - 1)]
    raw = memoryview(ids).cast("B")
    for k in range(blocks):
        if zlib.crc32(raw[2 * k * block : 2 * (k + 1) * block]) != crcs[k]:
            raise ValueError(f"block {k} is damaged")
    return [None if m else d for m, d in zip(missing.tolist(), doc_ids.tolist(), strict=True)], lengths.astype(np.int64), ids


FILES = "part int, file_no int, n_ids long, data binary"
READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _write(vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, part, number = encoder(vocabulary), TaskContext.get().partitionId(), 0
        docs, ids, lengths, size = [], [], [], 0

        def close() -> pa.RecordBatch:
            data = encode_file(docs, np.concatenate(lengths), np.concatenate(ids))
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([size], pa.int64()), pa.array([data], pa.binary())], names=["part", "file_no", "n_ids", "data"])

        for batch in slices(batches, "text"):
            own, n = encode.encode(texts_of(batch))
            docs += batch.column("doc_id").to_pylist()
            ids.append(own)
            lengths.append(n)
            size += len(own)
            if size >= FILE_IDS:
                yield close()
                docs, ids, lengths, size, number = [], [], [], 0, number + 1
        if docs:
            yield close()

    return run


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for base, data in zip(batch.column("base").to_pylist(), batch.column("data"), strict=True):
            docs, lengths, ids = decode_file(data.as_py())
            ends = np.cumsum(lengths)
            raw = memoryview(ids.astype("<u4")).cast("B")
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip((ends - lengths).tolist(), ends.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(base + ends - lengths), pa.array(lengths), pa.array(crc, pa.int64())], names=[x.split()[0] for x in READ.split(", ")])


def write_ids(docs: DataFrame, vocabulary: str | None = None, partitions: int | None = None) -> DataFrame:
    """docs: (doc_id, text), other columns are left out. The token-id files (part, file_no, n_ids, data), in order of
    documents by (part, file_no), as a table in the shared folder: Spark's writers commit it whole or not at all.

    Each document is its text's ids and END_ID; null and empty texts are END_ID alone. Rows that repeat or share an id
    are documents of their own; those with a null id come first. An empty table gives no files.
    """
    n = partitions or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long"), "text").withColumn("mark", F.xxhash64("text"))
    rows = rows.repartitionByRange(n, "doc_id", "mark").sortWithinPartitions("doc_id", "mark").select("doc_id", "text")
    return stored(rows.mapInArrow(_write(vocabulary or default_vocabulary()), FILES), "ids", compression="uncompressed")


def read_ids(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, decoded from the files. The files' sizes are summed on the driver, a number for each."""
    sizes = sorted(tuple(r) for r in files.select("part", "file_no", "n_ids").collect())
    starts, base = [], 0
    for part, number, n in sizes:
        starts.append((part, number, base))
        base += n
    at = files.sparkSession.createDataFrame(starts, "part int, file_no int, base long")
    return files.join(F.broadcast(at), ["part", "file_no"]).select("base", "data").mapInArrow(_read, READ)


def op4_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_ids(write_ids(table(spark, sf_dir, "documents")))
