"""Near-duplicate groups by Order MinHash.

A text is its lower-cased words (runs of ASCII letters and digits and of characters beyond ASCII); its k-mers of SHINGLE words are labelled by occurrence. Each
of SKETCHES hash functions picks the two least labelled k-mers and keeps them in the order of the text, so that a sketch
agrees with a chance that falls with edit distance, not only with shared k-mers. Texts that agree in a sketch are
candidates; a banded alignment of their words decides: edit distance of at most (1 - SIMILARITY) of the longer text.
Pairs at that very limit agree in one of the SKETCHES with a chance of about 0.9, nearer ones more surely.

Texts with the same words are one from the start. Sketches are sent packed, to find the buckets of two texts or more; of a
bucket with many texts in one batch only two are sent and the others passed on, so that no task gathers a hot bucket.
Within a bucket a text is compared with the first of its star, not with all others; a group of n copies costs about n
comparisons. Texts lie in a table bucketed by row: a comparison moves the texts of its two ends, never all of them.

The stars only make large groups cheaper. After them every pair of a bucket that is still in two groups is looked at, in
the first of the buckets that its texts share, so that no candidates are lost: lengths, then a bound below the edit
distance (words that one text has more often than the other, in BINS hashed counts) rule out most without their texts,
block against block. Texts that the bounds leave a partner come to their bucket once more, with their words, and are
aligned there, in blocks. No row is made for a pair: a text is a row in a bucket where it may have a partner, a link is a
row only if it joins two groups that no other link of its two blocks joins. The looks stay quadratic: n texts of like
lengths that share a passage and aren't near one another take n * n / 2 bounds of BINS bytes each, and those of them that
the bounds leave an alignment each.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from arborq.llm.bytewords import mix, word_hashes
from arborq.llm.common import bucketed, slices, small, stored, table, texts_of

SHINGLE, SIMILARITY, SKETCHES = 5, 0.8, 64
#: Words that are sketched at a time.
PART_WORDS = 50_000
#: Texts of a star, at most; texts of an Arrow batch in one bucket from which on they aren't sent to where the bucket is.
STAR, HOT = 256, 64
#: Rounds of stars over groups, before all pairs that are left; other groups that a group is compared with in each, at most.
ROUNDS, PARTNERS = 2, 2
#: Hashed counts of a text's words, and for a first look.
BINS, FOLD = 2048, 256
#: Texts of a bucket that one task compares; of larger ones, texts of a block, about, and blocks that one task meets all others with.
SMALL, BLOCK, STRIPE = 4096, 512, 16
#: Words of a block of texts that are aligned, about; a text counts as TEXT_WORDS more, so that short ones don't make large blocks.
BLOCK_WORDS, TEXT_WORDS = 50_000, 100
#: Possible pairs that are handed on at a time, about.
PAIRS_AT_ONCE = 100_000
_U = np.uint64


def sketches(words: np.ndarray, sizes: np.ndarray, shingle: int = SHINGLE, count: int = SKETCHES) -> np.ndarray:
    """(texts, count): Order MinHash values. A text of fewer words than a shingle is one k-mer; one without words gets zeros."""
    out = np.zeros((len(sizes), count), np.uint64)
    ends = np.cumsum(sizes)
    start = 0
    while start < len(sizes):  # as many texts at a time as a processor's cache holds
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + PART_WORDS, "right")))
        out[start:stop] = _sketches(words[ends[start] - sizes[start] : ends[stop - 1]], sizes[start:stop], shingle, count)
        start = stop
    return out


def _sketches(words: np.ndarray, sizes: np.ndarray, shingle: int, count: int) -> np.ndarray:
    out = np.zeros((len(sizes), count), np.uint64)
    full = np.flatnonzero(sizes > 0)
    if not len(full):
        return out
    starts = (np.cumsum(sizes) - sizes)[full]
    n = sizes[full]
    kmers = np.maximum(n - shingle + 1, 1)
    doc = np.repeat(np.arange(len(full)), kmers)
    first = np.cumsum(kmers) - kmers
    place = np.arange(len(doc)) - first[doc]
    at = starts[doc] + place
    last = (starts + n - 1)[doc]
    code = np.zeros(len(doc), np.uint64)
    for k in range(shingle):
        w = words[np.minimum(at + k, last)]
        w[at + k > last] = 0
        code = mix(code + w + _U(k + 1))
    key = code + doc.astype(np.uint64) * _U(0xD6E8FEB86659FD93)
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    if same.any():  # occurrence labels
        run = np.append(0, np.cumsum(~same))
        begin = np.flatnonzero(np.append(True, ~same))
        code[order] = mix(code[order] + (np.arange(len(order)) - begin[run]).astype(np.uint64) * _U(0xA24BAED4963EE407))
    low = _U((1 << 24) - 1)  # places fit 24 bits, or wrap: then order is told for part of a text of over 16 million words only
    mask, where, v = ~low, place.astype(np.uint64) & low, np.empty(len(doc), np.uint64)
    single = kmers == 1
    for i, factor in enumerate(_factors(count)):
        np.multiply(code, factor, out=v)  # codes are mixed: the upper bits of an odd multiple are a hash of their own
        v &= mask
        v |= where
        least = np.minimum.reduceat(v, first)
        v[first + (least & low).astype(np.int64)] = _U(0xFFFFFFFFFFFFFFFF)
        second = np.minimum.reduceat(v, first)
        second[single] = least[single]
        swap = (second & low) < (least & low)
        a, b = np.where(swap, second, least) >> _U(24), np.where(swap, least, second) >> _U(24)
        out[full, i] = mix(a * _U(0xC2B2AE3D27D4EB4F) + b + _U(i))
    return out


def _factors(count: int) -> np.ndarray:
    """Odd numbers, a hash function each."""
    return mix(np.arange(1, count + 1, dtype=np.uint64) * _U(0x632BE59BD9B4E019)) | _U(1)


def distances(pairs: list[tuple[np.ndarray, np.ndarray]], limits: list[int]) -> list[int]:
    """Edit distance of each pair of word arrays, or its limit + 1 where it is more. Exact: an alignment in a band that is widened until it holds the best one."""
    out = [0] * len(pairs)
    todo: list[tuple[int, np.ndarray, np.ndarray]] = []
    for i, ((a, b), limit) in enumerate(zip(pairs, limits, strict=True)):
        if abs(len(a) - len(b)) > limit:
            out[i] = limit + 1
            continue
        n = min(len(a), len(b))
        head = int(np.argmin(np.append(a[:n] == b[:n], False)))
        a, b = a[head:], b[head:]
        n = min(len(a), len(b))
        tail = int(np.argmin(np.append((a[len(a) - n :] == b[len(b) - n :])[::-1], False)))
        a, b = a[: len(a) - tail], b[: len(b) - tail]
        if not len(a) or not len(b):
            out[i] = len(a) + len(b)
            continue
        if _unshared(a, b) > limit:
            out[i] = limit + 1
            continue
        todo.append((i, a, b))
    band = 8
    while todo:
        todo.sort(key=lambda x: len(x[1]))
        rest = []
        while todo:
            longest = len(todo[-1][1])  # of the last pairs, as many as keep the arrays small
            size = max(1, min(16_000 // (2 * band + 1), 1_000_000 // (longest + 2 * band)))
            todo, part = todo[:-size], todo[-size:]
            width = min(band, max(limits[i] for i, _, _ in part))
            for (i, a, b), d in zip(part, _banded([(a, b) for _, a, b in part], max(1, width)), strict=True):
                if d <= width:
                    out[i] = min(d, limits[i] + 1)
                elif width >= limits[i]:
                    out[i] = limits[i] + 1
                else:
                    rest.append((i, a, b))
        todo, band = rest, band * 4
    return out


def _unshared(a: np.ndarray, b: np.ndarray) -> int:
    """No more than the edit distance: words that one has more often than the other."""
    values, counts = np.unique(np.concatenate([a, b]), return_counts=True)
    more = np.zeros(len(values), np.int64)
    np.add.at(more, np.searchsorted(values, a), 1)
    diff = 2 * more - counts
    return int(max(diff[diff > 0].sum(), -diff[diff < 0].sum()))


def _banded(pairs: list[tuple[np.ndarray, np.ndarray]], band: int) -> list[int]:
    """Edit distances as far as an alignment within `band` of the diagonal gives them; over band where none does. All pairs go row by row together."""
    n, rows, wide = len(pairs), max(len(a) for a, _ in pairs), 2 * band + 1
    la, lb = np.array([len(a) for a, _ in pairs]), np.array([len(b) for _, b in pairs])
    a2, b2 = np.zeros((n, rows), np.uint64), np.full((n, rows + wide + 1), _U(0xFFFFFFFFFFFFFFFF))
    for i, (a, b) in enumerate(pairs):
        a2[i, : len(a)] = a
        b2[i, band : band + len(b)] = b[: b2.shape[1] - band]
    far, steps = np.int32(1 << 28), np.arange(wide, dtype=np.int32)
    # cell (i, o) is row i of a, column i + o - band of b
    row = np.broadcast_to(np.where(steps >= band, steps - band, far), (n, wide)).astype(np.int32)
    out = np.full(n, band + 1)
    for i in range(1, rows + 1):
        new = row + (a2[:, i - 1 : i] != b2[:, i - 1 : i - 1 + wide])
        np.minimum(new[:, :-1], row[:, 1:] + 1, out=new[:, :-1])
        if i <= band:
            new[:, : band - i] = far
            new[:, band - i] = i
        new -= steps
        np.minimum.accumulate(new, axis=1, out=new)
        new += steps
        row = new
        done = np.flatnonzero(la == i)
        if len(done):
            o = lb[done] - i + band
            ok = (o >= 0) & (o < wide)
            out[done[ok]] = row[done[ok], o[ok]]
    return np.minimum(out, band + 1).tolist()


def _sketched(count: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = texts_of(batch)
            words, sizes = word_hashes(texts)
            values = sketches(words, sizes, count=count)
            ends = np.cumsum(sizes)
            raw = memoryview(np.ascontiguousarray(words)).cast("B")
            # texts without words are equal only if they are identical
            digests = [hashlib.blake2b(raw[8 * a : 8 * b] if b > a else b"text" + t.encode(), digest_size=16).digest() for t, a, b in zip(texts, (ends - sizes).tolist(), ends.tolist(), strict=True)]
            own = [pa.array(digests, pa.binary()), pa.array(sizes), pa.array([x.tobytes() for x in values], pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *own], names=[*batch.schema.names, "digest", "n_words", "sketch"])

    return run


DEALT = "part int, passed boolean, keys binary, nodes binary, hubs binary"


def _dealt(parts: int):
    """Sketches of (row, sketch) as packed entries, a row for each part of the keys that a batch has. Of a bucket with many texts of the batch the first two go to the bucket's part; the others need not, and are passed on wherever there is room."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            values = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), np.uint64)
            nodes = np.repeat(batch.column("row").to_numpy(), len(values) // batch.num_rows)
            order = np.lexsort((nodes, values))
            values, nodes = values[order], nodes[order]
            begin = np.flatnonzero(np.append(True, values[1:] != values[:-1]))
            sizes = np.diff(np.append(begin, len(values)))
            nth = np.arange(len(values)) - np.repeat(begin, sizes)
            hot = (np.repeat(sizes, sizes) > HOT) & (nth > 1)
            hubs = np.repeat(nodes[begin], sizes)
            part = ((values >> _U(40)) % _U(parts)).astype(np.int64)
            rows = []
            for passed, which in ((False, np.flatnonzero(~hot)), (True, np.flatnonzero(hot))):
                own = part[which] if not passed else np.arange(len(which)) // 4096 * 7919 % parts
                which = which[np.argsort(own, kind="stable")]
                own = np.sort(own)
                for at in np.split(np.arange(len(which)), np.flatnonzero(own[1:] != own[:-1]) + 1):
                    if len(at):
                        w = which[at]
                        rows.append((int(own[at[0]]), passed, values[w].tobytes(), nodes[w].tobytes(), hubs[w].tobytes() if passed else None))
            types = (pa.int32(), pa.bool_(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["part", "passed", "keys", "nodes", "hubs"])

    return run


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries (key, node, hub) of the buckets with more texts than one. Rows come sorted by part. A star has STAR texts at most, whose hub is its first; the hub of stars' first texts is the bucket's first."""
    part, held = -1, []

    def entries(keys: np.ndarray, nodes: np.ndarray, hubs: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(keys), 200_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[i : i + 200_000].view(np.int64)) for x in (keys, nodes, hubs)], names=["key", "node", "hub"])

    def close() -> Iterator[pa.RecordBatch]:
        keys, nodes = (np.concatenate([np.frombuffer(x[k], t) for x in held]) for k, t in ((0, np.uint64), (1, np.int64)))
        order = np.lexsort((nodes, keys))
        keys, nodes = keys[order], nodes[order]
        begin = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
        sizes = np.diff(np.append(begin, len(keys)))
        nth, first = np.arange(len(keys)) - np.repeat(begin, sizes), np.repeat(begin, sizes)
        hubs = nodes[np.where(nth % STAR == 0, first, first + nth // STAR * STAR)]
        many = np.repeat(sizes, sizes) > 1
        yield from entries(keys[many], nodes[many], hubs[many])

    for batch in batches:
        for own, passed, keys, nodes, hubs in zip(*(batch.column(c).to_pylist() for c in ("part", "passed", "keys", "nodes", "hubs")), strict=True):
            if passed:
                yield from entries(np.frombuffer(keys, np.uint64), np.frombuffer(nodes, np.int64), np.frombuffer(hubs, np.int64))
                continue
            if own != part and held:
                yield from close()
                held = []
            part = own
            held.append((keys, nodes))
    if held:
        yield from close()


def _verified(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (s for b in slices(batches, "text_a") for s in slices([b], "text_b")):
            wa, na = word_hashes(texts_of(batch, "text_a"))
            wb, nb = word_hashes(texts_of(batch, "text_b"))
            a, b = np.split(wa, np.cumsum(na)[:-1]), np.split(wb, np.cumsum(nb)[:-1])
            limits = [int((1 - similarity) * max(len(x), len(y)) + 1e-9) for x, y in zip(a, b, strict=True)]
            near = [d <= limit for d, limit in zip(distances(list(zip(a, b, strict=True)), limits), limits, strict=True)]
            own = ["a", "b", "label_a", "label_b"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), pa.array(near, pa.bool_())], names=[*own, "near"])

    return run


def _profiled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words, each labelled by its occurrence in the text, in hashed bins: two bits each, cut off at 3, which only lowers the bound. And the sketch, with zeros where it isn't among the text's keys."""
    for batch in slices(batches, "text"):
        words, sizes = word_hashes(texts_of(batch))
        doc = np.repeat(np.arange(len(sizes)), sizes)
        order = np.lexsort((words, doc))
        begin = np.flatnonzero(np.append(True, (words[order][1:] != words[order][:-1]) | (doc[order][1:] != doc[order][:-1]))) if len(words) else np.zeros(0, np.int64)
        nth = np.arange(len(words)) - np.repeat(begin, np.diff(np.append(begin, len(words))))
        at = doc * BINS + (mix(words[order] + nth.astype(np.uint64) * _U(0xA24BAED4963EE407)) % _U(BINS)).astype(np.int64)
        counts = np.minimum(np.bincount(at, minlength=len(sizes) * BINS), 3).astype(np.uint8).reshape(-1, BINS // 4, 4)
        packed = counts[:, :, 0] | counts[:, :, 1] << 2 | counts[:, :, 2] << 4 | counts[:, :, 3] << 6
        keys = (x.values.to_numpy().view(np.uint64) for x in batch.column("keys"))
        sketch = (np.frombuffer(x, np.uint64) for x in batch.column("sketch").to_pylist())
        shared = [np.where((x[:, None] == k).any(1), x, _U(0)).tobytes() for x, k in zip(sketch, keys, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array([x.tobytes() for x in packed], pa.binary()), pa.array(shared, pa.binary())], names=["node", "profile", "shared"])


def _unpacked(nodes: np.ndarray, labels: np.ndarray, n_words: np.ndarray, profiles: list[bytes], shared: list[bytes]) -> tuple[np.ndarray, ...]:
    """(nodes, labels, words, hashed counts, the same in FOLD bins, sketches)"""
    raw = np.frombuffer(b"".join(profiles), np.uint8).reshape(len(nodes), BINS // 4)
    counts = np.empty((len(nodes), BINS), np.uint8)
    for k in range(4):
        counts[:, k::4] = raw >> 2 * k & 3
    return nodes, labels, n_words, counts, counts.reshape(len(nodes), BINS // FOLD, FOLD).sum(1, dtype=np.uint8), np.frombuffer(b"".join(shared), np.uint64).reshape(len(nodes), -1)


def _block(column: pa.ListArray, row: int) -> tuple[np.ndarray, ...]:
    of = column[row].values
    return _unpacked(*(of.field(k).to_numpy(zero_copy_only=False) for k in ("node", "label", "n_words")), of.field("profile").to_pylist(), of.field("shared").to_pylist())


def _possible(key: int, one: tuple[np.ndarray, ...], other: tuple[np.ndarray, ...], similarity: float, after: int | None = None) -> Iterator[pa.RecordBatch]:
    """Pairs of a text in `one` with one in `other`, in different groups, whose edit distance may be within the limit, and whose sketches agree in the bucket's key first: others have met in another bucket. after: both are the same, and only later texts are met, by the first `after` ones."""
    (a, la, na, pa_, fa, ka), (b, lb, nb, pb, fb, kb) = one, other
    sa, sb = pa_.sum(1, dtype=np.int64), pb.sum(1, dtype=np.int64)
    place = int(np.argmax(ka[0] == _U(key & 0xFFFFFFFFFFFFFFFF)))
    ka, kb = ka[:, :place], np.ascontiguousarray(kb[:, :place])
    out, held = [], 0

    def pieces() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in np.concatenate(out, 1)], names=["a", "b", "label_a", "label_b", "bound"])

    for i in range(len(a) if after is None else after):
        start = 0 if after is None else i + 1
        limit = ((1 - similarity) * np.maximum(na[i], nb[start:]) + 1e-9).astype(np.int64)
        near = np.flatnonzero((la[i] != lb[start:]) & (np.abs(na[i] - nb[start:]) <= limit))
        limit, at = limit[near], near + start
        new = ~((ka[i] == kb[at]) & (ka[i] != 0)).any(1)
        limit, at = limit[new], at[new]
        for own, others in ((fa, fb), (pa_, pb)):
            bound = np.maximum(sa[i], sb[at]) - np.minimum(own[i], others[at]).sum(1, dtype=np.int64)
            ok = bound <= limit
            at, limit, bound = at[ok], limit[ok], bound[ok]
        if len(at):
            first = a[i] > b[at]
            mine = lambda x, y: (np.where(first, x, y), np.where(first, y, x))  # noqa: B023, E731
            out.append(np.stack([*mine(a[i], b[at]), *mine(la[i], lb[at]), bound]))
            held += len(at)
            if held >= PAIRS_AT_ONCE:
                yield pieces()
                out, held = [], 0
    if out:
        yield pieces()


MEETS = "key long, class int, visits boolean, node long, label long, n_words long"


def _meets(key: int, class_: int, visits: np.ndarray, of: tuple[np.ndarray, ...], found: np.ndarray) -> pa.RecordBatch:
    """The texts of a block that are in found, in one bucket."""
    at = np.flatnonzero(np.isin(of[0], found))
    own = [pa.array(np.full(len(at), key, np.int64)), pa.array(np.full(len(at), class_, np.int32)), pa.array(visits[at])]
    return pa.RecordBatch.from_arrays([*own, *(pa.array(x[at]) for x in of[:3])], names=["key", "class", "visits", "node", "label", "n_words"])


def _ends(pairs: Iterator[pa.RecordBatch]) -> np.ndarray:
    """The texts of pairs, each once."""
    found = np.zeros(0, np.int64)
    for x in pairs:
        found = np.unique(np.concatenate([found, x.column("a").to_numpy(), x.column("b").to_numpy()]))
    return found


def _pairs(batch: pa.RecordBatch, row: int, similarity: float) -> tuple[tuple[np.ndarray, ...], tuple[np.ndarray, ...], Iterator[pa.RecordBatch]]:
    """The two blocks of a row, and their possible pairs."""
    one, other = _block(batch.column("one"), row), _block(batch.column("other"), row)
    after = len(one[0]) if batch.column("alone")[row].as_py() else None
    return one, other, _possible(batch.column("key")[row].as_py(), one, one if after else other, similarity, after)


def _bounds(similarity: float):
    """Texts with a possible pair in two blocks, two blocks at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                one, other, pairs = _pairs(batch, row, similarity)
                found, (key, class_, visits, alone) = _ends(pairs), (batch.column(c)[row].as_py() for c in ("key", "class", "visits", "alone"))
                for of, visiting in ((one, False), (other, visits))[: 1 if alone else 2]:
                    yield _meets(key, class_, np.full(len(of[0]), visiting), of, found)

    return run


def _aligned(similarity: float):
    """Links (a, b) of groups by near texts of two blocks, two blocks at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                texts = {}
                for c in ("one", "other")[: 1 if batch.column("alone")[row].as_py() else 2]:
                    of = batch.column(c)[row].values
                    hashes, sizes = word_hashes(of.field("text").to_pylist())
                    texts |= zip(of.field("node").to_pylist(), np.split(hashes, np.cumsum(sizes)[:-1]), strict=True)
                links = _forest((x for *_, pairs in [_pairs(batch, row, similarity)] for x in pairs), texts, similarity)
                if links:
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*links, strict=True)], names=["a", "b"])

    return run


def _forest(pairs: Iterator[pa.RecordBatch], texts: dict[int, np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links (label_a, label_b) that join all groups that near ones of the pairs join, one fewer than the groups that they join. Pairs of least bound are aligned first, and none whose groups are joined by then."""
    into: dict[int, int] = {}
    links = []

    def root(x: int) -> int:
        while (to := into.get(x, x)) != x:
            into[x] = x = into.get(to, to)
        return x

    def apart(rest: np.ndarray) -> np.ndarray:
        names, at = np.unique(rest[2:4], return_inverse=True)
        roots = np.array([root(x) for x in names.tolist()], np.int64)[at.reshape(2, -1)]
        return rest[:, roots[0] != roots[1]]

    for batch in pairs:
        rest = np.stack([x.to_numpy() for x in batch.columns])
        rest, size = apart(rest[:, np.argsort(rest[4], kind="stable")]), 16
        while rest.shape[1]:
            part, rest = rest[:4, :size].T.tolist(), rest[:, size:]
            both = [(texts[a], texts[b]) for a, b, *_ in part]
            limits = [int((1 - similarity) * max(len(x), len(y)) + 1e-9) for x, y in both]
            before = len(links)
            for (_, _, la, lb), d, limit in zip(part, distances(both, limits), limits, strict=True):
                if d <= limit and (one := root(la)) != (other := root(lb)):
                    into[max(one, other)] = min(one, other)
                    links.append((la, lb))
            if len(links) > before:
                rest = apart(rest)
            size = min(2 * size, 1024)
    return links


def _within(similarity: float):
    """Texts with a possible pair within each (key, class). Rows come sorted by these and visits; those of one are held at a time, SMALL at most."""

    def close(key: int, class_: int, held: list[tuple]) -> Iterator[pa.RecordBatch]:
        visits, *numbers, profiles, shared = zip(*held, strict=True)
        own = _unpacked(*(np.array(x, np.int64) for x in numbers), profiles, shared)
        found = _ends(_possible(key, own, own, similarity, len(held) - sum(visits)))
        if len(found):
            yield _meets(key, class_, np.array(visits), own, found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, held = None, []
        for batch in batches:
            for key, class_, *rest in zip(*(batch.column(c).to_pylist() for c in ("key", "class", "visits", "node", "label", "n_words", "profile", "shared")), strict=True):
                if (key, class_) != group:
                    if held:
                        yield from close(*group, held)
                    group, held = (key, class_), []
                held.append(tuple(rest))
        if held:
            yield from close(*group, held)

    return run


PAIRS = "a long, b long, label_a long, label_b long"


def _compared(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """pairs (a, b, label_a, label_b) with near, stored. texts: (node, text), bucketed by node: only the pairs and the texts of their ends are moved."""
    a = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    b = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    both = pairs.select("a", "b", "label_a", "label_b").join(a, "a").join(b, "b")
    return small(both.mapInArrow(_verified(similarity), f"{PAIRS}, near boolean"), "checked", spread=True)


def _joined(found: DataFrame) -> DataFrame | None:
    """(label, into) for the labels of groups that found (label_a, label_b, near) links; None where there are no links."""
    links = small(found.where("near").select(F.col("label_a").alias("a"), F.col("label_b").alias("b")).distinct(), "links")
    return None if links.isEmpty() else _into(links)


def _into(links: DataFrame) -> DataFrame:
    """(label, into) for the labels of groups that links (a, b) join."""
    return components(links).select(F.col("node").alias("label"), F.col("label").alias("into"))


def _renamed(rows: DataFrame, into: DataFrame | None, c: str = "label") -> DataFrame:
    """rows with the labels in column c replaced."""
    if into is None:
        return rows
    into = into.select(F.col("label").alias(c), "into")
    return rows.join(into, c, "left").withColumn(c, F.coalesce("into", c)).drop("into")


def _starred(labels: DataFrame, entries: DataFrame, checked: DataFrame, texts: DataFrame, similarity: float, turn: int) -> tuple[DataFrame, DataFrame]:
    """(labels, checked) after another round of stars: each group is compared with PARTNERS others, those that it shares most buckets with of those that are drawn as a bucket's hub, by the two texts that agree most and aren't in checked. Buckets are counted by group, for those of a large group are drawn for many of its texts. A group has one text in a bucket, and a round PARTNERS comparisons a group at most."""
    drawn = F.xxhash64("key", "node", F.lit(turn))
    own = entries.select("key", "node").join(labels, "node").groupBy("key", "label").agg(F.min_by("node", drawn).alias("node"))
    hubs = own.groupBy("key").agg(F.min_by(F.struct("node", "label"), drawn).alias("hub"), F.count("*").alias("n")).where("n > 1").select("key", "hub")
    met = own.join(hubs, "key").where("label != hub.label")
    agree = met.groupBy(F.greatest("node", "hub.node").alias("a"), F.least("node", "hub.node").alias("b"), F.col("label").alias("label_a"), F.col("hub.label").alias("label_b")).agg(F.count("*").alias("n"))
    agree = agree.join(checked.select("a", "b"), ["a", "b"], "left_anti")
    partners = agree.groupBy("label_a", "label_b").agg(F.sum("n").alias("n"), F.max_by(F.struct("a", "b"), F.struct("n", "a", "b")).alias("p"))
    share = F.pmod(F.xxhash64("label_b", F.lit(turn)), F.lit(PARTNERS)).alias("share")  # the best of each share: a sum in every task
    best = partners.groupBy("label_a", share).agg(F.max_by(F.struct("p.a", "p.b", "label_b"), F.struct("n", "p")).alias("p")).select("p.a", "p.b", "label_a", "p.label_b")
    best = small(best.dropDuplicates(["a", "b"]), "best")
    found = _compared(best, texts, similarity)
    return small(_renamed(labels, _joined(found)), "labels"), checked.unionByName(found)


def _meeting(own: DataFrame) -> DataFrame:
    """Of own (key, node, label, class, ...) a row with visits and n for each class of a bucket where the text meets one of another group: in its own class those of it and its visitors, who are of the next class; as a visitor in the class before, those who are of that class. n: texts there, at most. Every two texts of different groups, of one class or of neighbours, meet in each bucket that they share."""
    sides = own.groupBy("key", "class").agg(F.count("*").alias("n"), F.min("label").alias("least"), F.max("label").alias("most"))
    # as many sides as there are classes of lengths, which grow with the longest text's logarithm
    buckets = sides.groupBy("key").agg(F.collect_list(F.struct("class", "n", "least", "most")).alias("sides"), F.min("least").alias("least"), F.max("most").alias("most")).where("least != most").select("key", "sides")
    between = lambda s, first, last: s["class"].between(F.col("class") + first, F.col("class") + last)
    others = lambda first, last: F.exists("sides", lambda s: between(s, first, last) & ((s["least"] != F.col("label")) | (s["most"] != F.col("label"))))
    there = lambda visits, first: F.struct(F.lit(visits).alias("visits"), F.aggregate(F.filter("sides", lambda s: between(s, first, first + 1)), F.lit(0).cast("long"), lambda n, s: n + s["n"]).alias("n"))
    met = own.join(buckets, "key").withColumn("there", F.explode(F.array_compact(F.array(F.when(others(0, 1), there(False, 0)), F.when(others(-1, -1), there(True, -1))))))
    return met.select(*[c for c in own.columns if c != "class"], (F.col("class") - F.col("there.visits").cast("int")).alias("class"), "there.visits", "there.n")


def _closed(labels: DataFrame, entries: DataFrame, rows: DataFrame, similarity: float) -> DataFrame:
    """labels (node, label) with groups joined that candidates link: after it all texts that agree in a sketch have one label or are known not to be near.

    Two near texts are in one class of lengths or in two that are next to each other: a bucket's texts meet those of their
    own class and of the next.
    """
    step = math.log(1.001 / similarity)
    lengths = rows.select(F.col("row").alias("node"), "n_words", F.floor(F.log("n_words") / step).cast("int").alias("class"))
    ends = small(_meeting(entries.select("key", "node").join(labels.join(lengths, "node"), "node")), "ends")
    if ends.isEmpty():
        return labels
    texts = rows.select(F.col("row").alias("node"), "text")
    keys = ends.groupBy("node").agg(F.collect_set("key").alias("keys"))  # as many as a sketch has, at most
    profiles = rows.select(F.col("row").alias("node"), "text", "sketch").join(keys, "node").mapInArrow(_profiled, "node long, profile binary, shared binary")
    profiles = small(profiles, "profiles", spread=True)
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = ends.where(F.col("n") <= SMALL).drop("n").join(profiles, "node").repartition(n, "key", "class").sortWithinPartitions("key", "class", "visits", "node")
    meets = dealt.mapInArrow(_within(similarity), MEETS)
    large = ends.where(F.col("n") > SMALL)
    if not large.isEmpty():
        blocks = _between_blocks(large, profiles, F.lit(1), BLOCK, STRIPE)
        meets = meets.unionByName(blocks.mapInArrow(_bounds(similarity), MEETS).distinct())
    meets = small(meets, "meets", spread=True)
    if meets.isEmpty():
        return labels
    weight = F.col("n_words") + TEXT_WORDS
    sizes = meets.groupBy("key", "class").agg(F.sum(weight).alias("n"))
    held = stored(profiles.join(texts.join(meets.select("node").distinct(), "node", "left_semi"), "node"), "held")
    # an alignment is long beside the move of its texts: a block a stripe
    blocks = _between_blocks(meets.join(sizes, ["key", "class"]), held, weight, BLOCK_WORDS, 1)
    links = small(blocks.mapInArrow(_aligned(similarity), "a long, b long").distinct(), "links")
    return labels if links.isEmpty() else small(_renamed(labels, _into(links)), "labels")


def _between_blocks(ends: DataFrame, held: DataFrame, weight, size: int, stripe: int) -> DataFrame:
    """(key, class, visits, alone, one, other): the texts of buckets in blocks of about size by weight, and every two blocks of a bucket that are to meet; visits: the other one's texts are visitors; alone: both are the same block. ends: (key, class, visits, node, label, n_words, n), n being the bucket's weight; held: (node, ...), what a block holds of each text; stripe: blocks that one task meets all others with, about."""
    # groups of a block or more have blocks of their own, so that none is compared with itself
    parts = ends.groupBy("key", "class", "label").agg(F.sum(weight).alias("own"))
    large = F.col("own") >= size
    block = F.when(large, F.struct("visits", "label", F.pmod(F.xxhash64("node"), F.ceil(F.col("own") / size)).alias("part"))).otherwise(F.struct("visits", F.lit(-1).cast("long").alias("label"), F.pmod(F.xxhash64("label"), F.ceil(F.col("n") / size)).alias("part")))
    dealt = ends.join(parts, ["key", "class", "label"]).select("key", "class", "node", "label", "n_words", block.alias("block")).join(held, "node")
    of = F.struct("node", "label", "n_words", *[c for c in held.columns if c != "node"])
    blocks = stored(dealt.groupBy("key", "class", "block").agg(F.collect_list(of).alias("of")), "blocks")
    stripes = blocks.groupBy("key", "class").agg(F.ceil(F.count("*") / stripe).alias("stripes"))
    striped = blocks.join(stripes, ["key", "class"])
    one = striped.where("not block.visits").select("key", "class", F.pmod(F.xxhash64("block"), "stripes").alias("stripe"), F.col("block").alias("block_a"), F.col("of").alias("one"))
    other = striped.select("key", "class", F.explode(F.sequence(F.lit(0).cast("long"), F.col("stripes") - 1)).alias("stripe"), F.col("block").alias("block_b"), F.col("of").alias("other"))
    same = (F.col("block_a.label") == F.col("block_b.label")) & (F.col("block_a.label") >= 0)
    # the few bytes of two blocks are long work: in as many tasks as a shuffle has, not in as few as hold the bytes
    n, keys = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions")), ["key", "class", "stripe"]
    met = one.repartition(n, *keys).join(other.repartition(n, *keys), keys).where((F.col("block_a") <= F.col("block_b")) & ~same)
    return met.select("key", "class", F.col("block_b.visits").alias("visits"), (F.col("block_a") == F.col("block_b")).alias("alone"), "one", "other")


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every node of links (a, b): label is the least node of its component. Labels spread along links and jump to their labels' labels; each round is stored."""
    both = small(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "links")
    labels = small(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("label")), "labels")
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        step = labels.join(near, F.col("node") == F.col("a")).select("node", "label", F.least("label", "near").alias("new"))
        jump = step.select(F.col("node").alias("to"), F.col("new").alias("far"))
        new = step.join(jump, F.col("new") == F.col("to"), "left").select("node", F.col("label").alias("old"), F.least("new", F.coalesce("far", "new")).alias("label"))
        new = small(new, "labels")
        labels = new.select("node", "label")
        if new.where("old != label").isEmpty():
            return labels


def _sketch_table(rows: DataFrame, count: int) -> DataFrame:
    """rows (text, ...) with digest, n_words, sketch and row (a number of its own for each), stored in buckets by row."""
    own = [StructField("digest", BinaryType()), StructField("n_words", LongType()), StructField("sketch", BinaryType())]
    return bucketed(rows.mapInArrow(_sketched(count), StructType([*rows.schema.fields, *own])).withColumn("row", F.monotonically_increasing_id()), "sketches", ["row"])


def _entries(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(key, node, hub): of rows (row, sketch) that are nodes, a row for each bucket with others that each is in; hub is the one of them to compare it with first."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = rows.select("row", "sketch").join(nodes.select(F.col("node").alias("row")), "row", "left_semi")
    dealt = own.mapInArrow(_dealt(2 * n), DEALT).repartition(n, "part").sortWithinPartitions("part")
    return small(dealt.mapInArrow(_gathered, "key long, node long, hub long"), "entries", spread=True)


def _labels(rows: DataFrame, similarity: float, count: int) -> DataFrame:
    """(row, label) for each of rows (row, text, digest, n_words, sketch): rows near one another, directly or through others, have one label."""
    firsts = small(rows.where("n_words > 0").groupBy("digest").agg(F.min("row").alias("node")), "firsts")
    texts = rows.select(F.col("row").alias("node"), "text")
    entries = _entries(rows, firsts)
    labels = small(entries.select("node").distinct().withColumn("label", F.col("node")), "labels")
    stars = small(entries.where("node != hub").groupBy(F.col("node").alias("a"), F.col("hub").alias("b")).agg((-F.count("*")).alias("bound")), "stars")
    # only the hub that a text agrees with most: most copies are in their group then, and the rest comes with all other candidates
    best = stars.groupBy("a").agg(F.min_by("b", F.struct("bound", "b")).alias("b")).select("a", "b", F.col("a").alias("label_a"), F.col("b").alias("label_b"))
    checked = _compared(best, texts, similarity)
    labels = small(_renamed(labels, _joined(checked)), "labels")
    for turn in range(ROUNDS):
        labels, checked = _starred(labels, entries, checked, texts, similarity, turn)
    labels = _closed(labels, entries, rows, similarity)
    nodes = firsts.join(labels, "node", "left").select("digest", F.coalesce("label", "node").alias("label"))
    wordless = rows.where("n_words = 0").groupBy("digest").agg(F.min("row").alias("label"))
    # as a table of its own, so that Spark can deal the rows of a digest with many copies to many tasks
    nodes = small(nodes.unionByName(wordless), "nodes")
    return rows.select("row", "digest").join(nodes, "digest").select("row", "label")


def near_groups(docs: DataFrame, similarity: float = SIMILARITY, count: int = SKETCHES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, id_col, class_id, class_size, stays): one row for each row of docs.

    class_id is the least id among near duplicates of one another, directly or through others; stays is true for one row
    of each class, of the least id. Texts with the same words are near; so are texts without words if they are identical,
    and null counts as empty. Null ids are the least; a class of null ids only has a null class_id. Rows that repeat are
    copies. An empty table gives an empty result.
    """
    rows = _sketch_table(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), count)
    labels = _labels(rows, similarity, count)
    found = small(rows.select("row", "id").join(labels, "row"), "classes")
    classes = found.groupBy("label").agg(F.min("id").alias("class_id"), F.count("*").alias("class_size"), _least().alias("least"))
    classes = small(classes, "sizes")
    return found.join(classes, "label").select("row", F.col("id").alias(id_col), "class_id", "class_size", (F.col("least.row") == F.col("row")).alias("stays"))


def _least():
    """Of a class the row that stays: that of the least id, null first, and the first of rows that share it."""
    return F.min(F.struct(F.col("id").isNotNull(), "id", "row"))


def drop_near_copies(docs: DataFrame, similarity: float = SIMILARITY, count: int = SKETCHES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without all but one row of each class of near duplicates, that of the least id, in docs' own columns."""
    names = docs.columns
    rows = _sketch_table(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *[F.col(c).alias(f"own_{c}") for c in names if c not in (id_col, text_col)]), count)
    found = rows.select("row", "id").join(_labels(rows, similarity, count), "row")
    stay = small(found.groupBy("label").agg(_least().alias("least")).select("least.row"), "stay")
    kept = rows.join(stay, "row", "left_semi")
    return kept.select(*[F.col({id_col: "id", text_col: "text"}.get(c, f"own_{c}")).alias(c) for c in names])


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size")
