"""Media columns: ISO base media files (MP4 and its kin).

``walk`` goes through nested boxes; ``tracks`` decodes the sample tables (stts, stsc, stsz or stz2, stco or co64, stss) and
those of fragments (trex, tfhd, tfdt, trun), and gives each track's codec, duration and samples' byte ranges without
touching the payload in ``mdat``. ``media_columns`` stores these as typed columns of a table of files. ``media_table``
writes texts as files with one track of raw 8-bit samples, which the query stores, reads back and describes.

Times are decoding times: composition offsets (ctts) and edit lists (elst) change neither duration in the media nor ranges.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from arborq.llm.common import slices, stored, table, texts_of

#: Boxes that hold boxes.
PARENTS = (b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"mvex", b"moof", b"traf", b"mfra")
#: Of the files that ``container`` writes: bytes of a sample, samples of a chunk, samples from one keyframe to the next, samples a second.
SAMPLE, CHUNK, GROUP, RATE = 64, 64, 16, 1000
CODEC = b"raw8"
#: Boxes in boxes, at most.
DEPTH = 32


def walk(data: memoryview) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """(path of types, start and end of the content) of each box, parents first. Sizes of 1 (64 bits) and 0 (to the end) are read. Raises ValueError on a box that doesn't fit its parent, or lies deeper than DEPTH."""
    open_ = [((), 0, len(data))]
    while open_:
        path, start, end = open_.pop()
        if start >= end:
            continue
        if end - start < 8:
            raise ValueError(f"{end - start} bytes are left at {start}, too few for a box")
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1:
            if end - start < 16:
                raise ValueError(f"box {kind!r} at {start} is cut off")
            size, head = struct.unpack_from(">Q", data, start + 8)[0], 16
        elif size == 0:
            size = end - start
        if size < head or start + size > end:
            raise ValueError(f"box {kind!r} at {start} of {size} bytes doesn't fit")
        own = (*path, kind)
        yield own, start + head, start + size
        open_.append((path, start + size, end))
        if kind in PARENTS:
            if len(own) >= DEPTH:
                raise ValueError(f"boxes are nested {DEPTH} deep at {start}")
            open_.append((own, start + head, start + size))


@dataclass
class Track:
    number: int = 0
    codec: str = ""
    handler: str = ""
    timescale: int = 0
    duration: int = 0
    sizes: np.ndarray | None = None
    offsets: np.ndarray | None = None
    sync: np.ndarray | None = None  #: indexes of keyframes
    times: np.ndarray | None = None  #: decoding time of each sample

    def seconds(self) -> float:
        return self.duration / max(1, self.timescale)

    def keyframes(self) -> list[tuple[int, int]]:
        """The byte range from each keyframe to the next, or to the track's end."""
        ends = np.append(self.sync[1:], len(self.sizes)) - 1 if len(self.sync) else self.sync
        return list(zip(self.offsets[self.sync].tolist(), (self.offsets[ends] + self.sizes[ends]).tolist(), strict=True))


def _full(data: memoryview, at: int) -> tuple[int, int]:
    return data[at], at + 4  # version, place of the fields


def _u32(data: memoryview, at: int, n: int, width: int = 1) -> np.ndarray:
    out = np.frombuffer(data, ">u4", n * width, at).astype(np.int64)
    return out.reshape(n, width) if width > 1 else out


def tracks(data: bytes | memoryview) -> list[Track]:
    """Tracks in the order of the file, the samples of its fragments after those of its tables.

    Raises ValueError if it is damaged, and nothing else. What a box claims to hold is bounded by the box, or where it has
    no entry for each sample by the file, so that no more than some times the file's size is allocated.
    """
    try:
        return _tracks(memoryview(data))
    except (struct.error, IndexError, OverflowError, TypeError) as e:
        raise ValueError(f"a box is cut off: {e}") from e


def _tracks(data: memoryview) -> list[Track]:
    out: list[Track] = []
    raw: list[dict] = []
    defaults: dict[int, tuple[int, int, int]] = {}  # of a track's samples in fragments: duration, size, flags
    runs: dict[int, list[tuple[np.ndarray, ...]]] = {}
    moof = 0
    fragment: dict = {}
    for path, at, end in walk(data):
        kind = path[-1]
        if kind == b"trak":
            out.append(Track())
            raw.append({})
        elif kind == b"moof":
            moof, fragment = at - 8, {}
        elif kind == b"trex":
            number, _, *own = struct.unpack_from(">5I", data, at + 4)
            defaults[number] = tuple(own)
        elif kind == b"tfhd":
            fragment = _fragment(data, at, moof, fragment, defaults)
        elif kind == b"tfdt" and fragment:
            fragment["time"] = struct.unpack_from(">Q" if data[at] else ">I", data, at + 4)[0]
        elif kind == b"trun" and fragment:
            runs.setdefault(fragment["number"], []).append(_run(data, at, end, fragment))
        elif len(path) >= 3 and path[:2] == (b"moov", b"trak"):
            _told(data, at, end, kind, out[-1], raw[-1])
    for t, r in zip(out, raw, strict=True):
        t.sizes = r.get(b"stsz", np.zeros(0, np.int64))
        n, chunks, spread = len(t.sizes), r.get(b"stco", np.zeros(0, np.int64)), r.get(b"stsc", np.zeros((0, 3), np.int64))
        counts = np.diff(np.append(spread[:, 0], len(chunks) + 1))
        if len(spread) and (spread[0, 0] != 1 or (counts < 0).any()):
            raise ValueError("stsc doesn't go through the chunks in order")
        per_chunk = np.repeat(spread[:, 1], counts) if len(spread) else np.zeros(0, np.int64)
        if per_chunk.sum() != n or len(per_chunk) != len(chunks) and n:
            raise ValueError(f"stsc deals out {per_chunk.sum()} samples, stsz has {n}")
        ends = np.cumsum(t.sizes)
        first = np.cumsum(per_chunk) - per_chunk
        before = np.append(0, ends)[first] if n else first
        t.offsets = np.repeat(chunks[: len(per_chunk)] - before, per_chunk) + ends - t.sizes
        if (t.offsets < 0).any():
            raise ValueError("a sample lies before the file")
        t.sync = np.unique(r[b"stss"] - 1) if b"stss" in r else np.arange(n)
        if len(t.sync) and not (0 <= t.sync[0] and t.sync[-1] < n):
            raise ValueError(f"stss names a sample beyond the {n} there are")
        stts = r.get(b"stts", np.zeros((0, 2), np.int64))
        upto = np.minimum(np.cumsum(stts[:, 0]), n)  # entries beyond the samples count for nothing
        lasting = np.repeat(stts[:, 1], np.diff(upto, prepend=0))
        lasting = np.append(lasting, np.zeros(n - len(lasting), np.int64))
        done = np.cumsum(lasting)
        t.times, last = done - lasting, int(done[-1]) if n else 0
        if t.number in runs:
            offsets, sizes, lasting, sync, begins = (np.concatenate(x) for x in zip(*runs[t.number], strict=True))
            t.sync = np.append(t.sync, n + np.flatnonzero(sync)).astype(np.int64)
            t.offsets, t.sizes, t.times = np.append(t.offsets, offsets), np.append(t.sizes, sizes), np.append(t.times, begins)
            t.duration = max(t.duration, last, int((begins + lasting).max(initial=0)))  # what mdhd tells leaves fragments out
        t.duration = t.duration or last
    return out


def _entries(data: memoryview, at: int, end: int, n: int, width: int = 1) -> np.ndarray:
    """n rows of `width` 32-bit numbers, all within the box."""
    if at + 4 * n * width > end:
        raise ValueError(f"a box claims {n} entries, more than it holds")
    return _u32(data, at, n, width)


def _told(data: memoryview, at: int, end: int, kind: bytes, t: Track, r: dict) -> None:
    """What a box of a track tells."""
    if kind == b"tkhd":
        t.number = struct.unpack_from(">I", data, at + (20 if data[at] else 12))[0]
    elif kind == b"mdhd":
        version, at = _full(data, at)
        t.timescale, t.duration = struct.unpack_from(">IQ", data, at + 16) if version else struct.unpack_from(">II", data, at + 8)
        if t.duration == (0xFFFFFFFFFFFFFFFF if version else 0xFFFFFFFF):
            t.duration = 0  # not known
    elif kind == b"hdlr":
        t.handler = bytes(data[at + 8 : at + 12]).decode("latin-1")
    elif kind == b"stsd" and end - at >= 16:
        t.codec = bytes(data[at + 12 : at + 16]).decode("latin-1")
    elif kind in (b"stts", b"stsc", b"stco", b"stss"):
        n = struct.unpack_from(">I", data, at + 4)[0]
        r[kind] = _entries(data, at + 8, end, n, {b"stts": 2, b"stsc": 3}.get(kind, 1))
    elif kind == b"co64":
        n = struct.unpack_from(">I", data, at + 4)[0]
        high, low = _entries(data, at + 8, end, n, 2).reshape(n, 2).T
        if (high >> 31).any():
            raise ValueError("a chunk lies beyond 2 ** 63")
        r[b"stco"] = high << 32 | low
    elif kind == b"stsz":
        size, n = struct.unpack_from(">II", data, at + 4)
        if size and n * size > len(data):
            raise ValueError(f"{n} samples of {size} bytes don't fit the file")
        r[b"stsz"] = np.full(n, size, np.int64) if size else _entries(data, at + 12, end, n)
    elif kind == b"stz2":
        bits, n = data[at + 7], struct.unpack_from(">I", data, at + 8)[0]
        if bits not in (4, 8, 16) or at + 12 + (n * bits + 7) // 8 > end:
            raise ValueError(f"stz2 has {n} samples of {bits} bits")
        if bits == 4:
            b = np.frombuffer(data, np.uint8, (n + 1) // 2, at + 12)
            r[b"stsz"] = np.stack([b >> 4, b & 15], 1).ravel()[:n].astype(np.int64)
        else:
            r[b"stsz"] = np.frombuffer(data, ">u2" if bits == 16 else np.uint8, n, at + 12).astype(np.int64)


#: Flag of a sample that isn't a keyframe.
_NO_SYNC = 0x10000


def _fragment(data: memoryview, at: int, moof: int, before: dict, defaults: dict[int, tuple[int, int, int]]) -> dict:
    """A tfhd: the track, where its data begins, and what its samples have unless they say otherwise."""
    flags, number = struct.unpack_from(">2I", data, at)
    at += 8
    duration, size, sample_flags = defaults.get(number, (0, 0, 0))
    # without a place of its own a track's data is told from the moof, or goes on where the track before it ended
    base = moof if flags & 0x20000 or not before else before["next"]
    if flags & 1:
        base = struct.unpack_from(">Q", data, at)[0]
        at += 8
    at += 4 * bool(flags & 2)
    own = []
    for bit, value in ((8, duration), (16, size), (32, sample_flags)):
        if flags & bit:
            value = struct.unpack_from(">I", data, at)[0]
            at += 4
        own.append(value)
    return {"number": number, "base": base, "next": base, "time": 0, "default": own}


def _run(data: memoryview, at: int, end: int, fragment: dict) -> tuple[np.ndarray, ...]:
    """(offsets, sizes, durations, whether keyframes, times) of a trun's samples."""
    flags, n = struct.unpack_from(">2I", data, at)
    flags &= 0xFFFFFF
    at += 8
    start = fragment["next"]
    if flags & 1:
        start = fragment["base"] + struct.unpack_from(">i", data, at)[0]
        at += 4
    first = None
    if flags & 4:
        first = struct.unpack_from(">I", data, at)[0]
        at += 4
    bits = [b for b in (0x100, 0x200, 0x400, 0x800) if flags & b]
    if at + 4 * n * len(bits) > end:
        raise ValueError(f"trun has {n} samples, more than its box")
    if 0x200 not in bits and n * max(1, fragment["default"][1]) > len(data):
        raise ValueError(f"trun has {n} samples, more than the file")
    columns = dict(zip(bits, _u32(data, at, n * len(bits)).reshape(n, len(bits)).T, strict=True))
    lasting, sizes, sample_flags = (columns.get(b, np.full(n, d, np.int64)) for b, d in zip((0x100, 0x200, 0x400), fragment["default"], strict=True))
    if first is not None and n and 0x400 not in columns:
        sample_flags[0] = first
    ends, upto = np.cumsum(sizes), np.cumsum(lasting)
    begins = fragment["time"] + upto - lasting
    if start < 0:
        raise ValueError("a sample lies before the file")
    fragment["next"] = start + int(sizes.sum())
    fragment["time"] += int(lasting.sum())
    return start + ends - sizes, sizes, lasting, (sample_flags & _NO_SYNC) == 0, begins


def payload(data: bytes, track: Track) -> bytes:
    """All samples of a track in order; samples that lie side by side are taken in one piece."""
    if not len(track.sizes):
        return b""
    ends = track.offsets + track.sizes
    cuts = np.flatnonzero(track.offsets[1:] != ends[:-1])
    return b"".join(data[a:b] for a, b in zip(track.offsets[np.append(0, cuts + 1)].tolist(), ends[np.append(cuts, -1)].tolist(), strict=True))


def features(data: bytes, found: list[Track] | None = None) -> str:
    """Codec, duration in seconds, samples, and keyframes with the byte range from each to the next, of every track."""
    out = []
    for t in tracks(data) if found is None else found:
        ranges = ",".join(f"{a}-{b}" for a, b in t.keyframes())
        out.append(f"codec={t.codec};handler={t.handler};seconds={t.seconds():.3f};samples={len(t.sizes)};keyframes={ranges}")
    return "|".join(out)


def _box(kind: bytes, *content: bytes) -> bytes:
    body = b"".join(content)
    return struct.pack(">I4s", len(body) + 8, kind) + body


def _full_box(kind: bytes, *content: bytes, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", flags), *content)


def container(samples: bytes) -> bytes:
    """A file with one track of samples of SAMPLE bytes; their length is a multiple of that."""
    n = len(samples) // SAMPLE
    chunks = -(-n // CHUNK)
    ftyp = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2")
    matrix = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    rest = n - (chunks - 1) * CHUNK
    stsc = [(1, CHUNK, 1)] * (chunks > 1) + [(chunks, rest, 1)] * (chunks == 1 or rest != CHUNK)

    def moov(first: int) -> bytes:
        stbl = _box(
            b"stbl",
            _full_box(b"stsd", struct.pack(">I", 1), _box(CODEC, bytes(6), struct.pack(">H", 1))),
            _full_box(b"stts", struct.pack(">3I", 1, n, 1)),
            _full_box(b"stss", struct.pack(">I", -(-n // GROUP)), np.arange(1, n + 1, GROUP, dtype=">u4").tobytes()),
            _full_box(b"stsc", struct.pack(">I", len(stsc)), *(struct.pack(">3I", *x) for x in stsc)),
            _full_box(b"stsz", struct.pack(">2I", SAMPLE, n)),
            _full_box(b"stco", struct.pack(">I", chunks), (first + CHUNK * SAMPLE * np.arange(chunks)).astype(">u4").tobytes()),
        )
        minf = _box(b"minf", _full_box(b"nmhd"), _box(b"dinf", _full_box(b"dref", struct.pack(">I", 1), _full_box(b"url ", flags=1))), stbl)
        mdia = _box(b"mdia", _full_box(b"mdhd", struct.pack(">4I2H", 0, 0, RATE, n, 0x55C4, 0)), _full_box(b"hdlr", bytes(4), b"text", bytes(13)), minf)
        tkhd = _full_box(b"tkhd", struct.pack(">5I", 0, 0, 1, 0, n), bytes(16), matrix, bytes(8), flags=3)
        mvhd = _full_box(b"mvhd", struct.pack(">4IIH", 0, 0, RATE, n, 0x10000, 0x100), bytes(10), matrix, bytes(24), struct.pack(">I", 2))
        return _box(b"moov", mvhd, _box(b"trak", tkhd, mdia))

    head = ftyp + moov(len(ftyp) + len(moov(0)) + 8)
    return head + _box(b"mdat", samples)


def store_text(text: str | None) -> tuple[int, bytes]:
    """(bytes of the text in UTF-8, a media file whose samples hold them, zeros up to a positive multiple of 64 after them). Null is an empty text."""
    data = (text or "").encode()
    return len(data), container(data + bytes(-len(data) % 64 if data else 64))


def _written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (s for b in batches for s in slices([b], "text")):
        sizes, files = zip(*map(store_text, texts_of(batch)), strict=True)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(files, pa.binary())], names=["doc_id", "n_bytes", "media"])


def media_table(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each whole text of docs (doc_id, text; other columns are left out) as a media file; a row for each row, repeated ones and those with a null id too."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_written, "doc_id long, n_bytes long, media binary")


TRACKS = ArrayType(StructType([StructField("codec", StringType()), StructField("handler", StringType()), StructField("seconds", DoubleType()), StructField("samples", LongType()), StructField("keyframes", ArrayType(StructType([StructField("start", LongType()), StructField("stop", LongType())])))]))


def _described(media: bytes | None) -> tuple[list[dict] | None, str | None]:
    if media is None:
        return None, None
    try:
        found = tracks(media)
        return [{"codec": t.codec, "handler": t.handler, "seconds": t.seconds(), "samples": len(t.sizes), "keyframes": [{"start": a, "stop": b} for a, b in t.keyframes()]} for t in found], None
    except ValueError as e:
        return None, str(e)


def media_columns(files: DataFrame, media_col: str = "media") -> DataFrame:
    """files with `tracks` and `problem` added, in place of columns of those names.

    tracks has a struct for each track: codec, handler, seconds, samples, and the byte range from each keyframe to the next.
    A file that is damaged has null tracks, and what is wrong with it as `problem`; a null file has neither.
    """
    files = files.drop("tracks", "problem")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices([batch], media_col):
                found, problems = zip(*map(_described, part.column(media_col).to_pylist()), strict=True)
                kind = to_arrow_type(TRACKS)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, kind), pa.array(problems, pa.string())], names=[*part.schema.names, "tracks", "problem"])

    return files.mapInArrow(run, StructType([*files.schema.fields, StructField("tracks", TRACKS), StructField("problem", StringType())]))


DIGESTS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, codec string, seconds double, n_keyframes long"


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in (s for b in batches for s in slices([b], "media")):
        rows = []
        for media, told in zip(batch.column("media").to_pylist(), batch.column("tracks").to_pylist(), strict=True):
            back = payload(media, tracks(media)[0])
            ranges = lambda t: ",".join(f"{k['start']}-{k['stop']}" for k in t["keyframes"])
            feature = "|".join(f"codec={t['codec']};handler={t['handler']};seconds={t['seconds']:.3f};samples={t['samples']};keyframes={ranges(t)}" for t in told)
            rows.append((len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature, told[0]["codec"], told[0]["seconds"], len(told[0]["keyframes"])))
        types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.int64())
        columns = zip(*rows, strict=True) if rows else [()] * len(types)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=[x.split()[0] for x in DIGESTS.split(", ")])


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = stored(media_table(table(spark, sf_dir, "documents")), "media")
    return media_columns(files).mapInArrow(_digests, DIGESTS)
