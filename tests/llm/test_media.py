import hashlib
import random
import struct
import zlib

import pytest

from arborq.llm import media
from arborq.llm.common import stored
from tests.llm.helpers import documents, odd_texts


def test_round_trip_of_odd_texts(spark):
    texts = odd_texts()
    files = stored(media.media_table(documents(spark, texts, extra=True)), "media")
    got = {r["doc_id"]: r for r in media.media_columns(files).mapInArrow(media._digests, media.DIGESTS).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        data = (t or "").encode()
        padded = data + bytes(-len(data) % 64 or (0 if data else 64))
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        stored_ = media.store_text(t)[1]
        assert (r["media_bytes"], r["media_sha256"], r["feature"]) == (len(stored_), hashlib.sha256(stored_).hexdigest(), media.features(stored_))


def test_empty_table(spark):
    assert media.media_columns(media.media_table(documents(spark, []))).count() == 0


def test_sample_tables():
    data = media.container(bytes(range(64)) * 200)
    (t,) = media.tracks(data)
    assert (t.codec, t.handler, t.timescale, t.duration, len(t.sizes)) == ("raw8", "text", 1000, 200, 200)
    assert t.sync.tolist() == list(range(0, 200, 16))
    assert t.times.tolist() == list(range(200))
    at = bytes(data).index(b"mdat") + 4
    assert t.offsets.tolist() == [at + 64 * i for i in range(200)]
    assert media.features(data).startswith("codec=raw8;handler=text;seconds=0.200;samples=200;keyframes=")


def test_scattered_chunks_variable_sizes_and_64_bit_boxes():
    r = random.Random(3)
    samples = [r.randbytes(r.randint(0, 50)) for _ in range(23)]
    chunks = [samples[0:4], samples[4:8], samples[8:9], samples[9:23]]
    blob, offsets = b"", []
    for c in chunks:  # rubbish between chunks
        blob += r.randbytes(9)
        offsets.append(len(blob))
        blob += b"".join(c)
    box, full = media._box, media._full_box
    mdat = struct.pack(">I4sQ", 1, b"mdat", len(blob) + 16) + blob

    def moov(base):
        stbl = box(
            b"stbl",
            full(b"stsd", struct.pack(">I", 1), box(b"avc1", bytes(8))), full(b"stts", struct.pack(">5I", 2, 20, 3, 3, 7)),
            full(b"stsc", struct.pack(">10I", 3, 1, 4, 1, 3, 1, 1, 4, 14, 1)), full(b"stsz", struct.pack(">2I", 0, 23), struct.pack(">23I", *map(len, samples))),
            full(b"co64", struct.pack(">I", 4), struct.pack(">4Q", *(base + o for o in offsets))),
        )
        mdhd = box(b"mdhd", struct.pack(">IQQIQ", 1 << 24, 0, 0, 90_000, 81 * 1000))
        return box(b"moov", box(b"trak", box(b"mdia", mdhd, full(b"hdlr", bytes(4), b"vide", bytes(13)), box(b"minf", stbl))))

    head = media._box(b"ftyp", b"isom", bytes(4))
    base = len(head) + len(moov(0)) + 16
    data = head + moov(base) + mdat
    (t,) = media.tracks(data)
    assert media.payload(data, t) == b"".join(samples)
    assert (t.codec, t.duration, t.timescale) == ("avc1", 81_000, 90_000)
    assert t.sync.tolist() == list(range(23)) and t.times.tolist()[19:] == [57, 60, 67, 74]


@pytest.mark.parametrize("data", [b"abc", struct.pack(">I4s", 99, b"free"), struct.pack(">I4s", 3, b"free"), struct.pack(">I4s", 1, b"free")])
def test_damaged_boxes_are_errors(data):
    with pytest.raises(ValueError):
        media.tracks(data)


def test_columns_of_files_good_bad_and_null(spark):
    good = media.container(bytes(range(64)) * 40)
    df = spark.createDataFrame([(1, bytearray(good), "a"), (2, bytearray(good[:300]), "b"), (3, None, "c"), (4, bytearray(b""), "d"), (1, bytearray(good), "a")], "doc_id long, media binary, tracks string")
    got = media.media_columns(df).orderBy("doc_id").collect()
    assert got[0] == got[1] and len(got) == 5
    (t,) = got[0]["tracks"]
    assert (t["codec"], t["seconds"], t["samples"]) == ("raw8", 0.04, 40) and got[0]["problem"] is None
    at = good.index(b"mdat") + 4
    assert [(k["start"], k["stop"]) for k in t["keyframes"]] == [(at, at + 1024), (at + 1024, at + 2048), (at + 2048, at + 2560)]
    assert got[2]["tracks"] is None and "doesn't fit" in got[2]["problem"]
    assert got[3]["tracks"] is None and got[3]["problem"] is None and got[4]["tracks"] == []


def test_deep_boxes_are_an_error():
    data = b""
    for _ in range(3000):
        data = media._box(b"moov", data)
    with pytest.raises(ValueError):
        media.tracks(data)


def test_fragments():
    r = random.Random(8)
    box, full = media._box, media._full_box
    samples = [r.randbytes(r.randint(1, 60)) for _ in range(9)]
    stbl = box(b"stbl", full(b"stsd", struct.pack(">I", 1), box(b"avc1", bytes(8))), full(b"stts", bytes(4)), full(b"stsc", bytes(4)), full(b"stsz", bytes(8)), full(b"stco", bytes(4)))
    mdia = box(b"mdia", full(b"mdhd", struct.pack(">4I2H", 0, 0, 1000, 0, 0, 0)), full(b"hdlr", bytes(4), b"vide", bytes(13)), box(b"minf", stbl))
    trak = box(b"trak", full(b"tkhd", struct.pack(">5I", 0, 0, 7, 0, 0), bytes(60)), mdia)
    data = box(b"ftyp", b"isom", bytes(4)) + box(b"moov", trak, box(b"mvex", full(b"trex", struct.pack(">5I", 7, 1, 40, 0, 0x10000))))
    for k, own in enumerate((samples[:4], samples[4:])):  # the first with sizes and first flags, the second with all fields

        def moof(offset, k=k, own=own):
            if k == 0:
                run = full(b"trun", struct.pack(">IiI", len(own), offset, 0), *(struct.pack(">I", len(x)) for x in own), flags=0x205)
            else:
                run = full(b"trun", struct.pack(">Ii", len(own), offset), *(struct.pack(">4I", 50, len(x), 0 if i == 2 else 0x10000, 0) for i, x in enumerate(own)), flags=0xF01)
            return box(b"moof", full(b"mfhd", struct.pack(">I", k)), box(b"traf", full(b"tfhd", struct.pack(">I", 7), flags=0x20000), full(b"tfdt", struct.pack(">I", 160 * k)), run))

        data += moof(len(moof(0)) + 8) + box(b"mdat", b"".join(own))
    (t,) = media.tracks(data)
    assert media.payload(data, t) == b"".join(samples)
    assert (t.codec, t.duration, t.sync.tolist()) == ("avc1", 160 + 5 * 50, [0, 6])
    assert t.times.tolist() == [0, 40, 80, 120, 160, 210, 260, 310, 360]
    assert [data[a:b] for a, b in t.keyframes()][1] == b"".join(samples[6:])


def fragmented(table_samples=0, mdhd_duration=0, version=0, fragment_time=0, lasting=1000, n=3):
    """A file with samples in its tables, and a fragment after them."""
    box, full = media._box, media._full_box
    k = table_samples
    stbl = box(b"stbl", full(b"stsd", struct.pack(">I", 1), box(b"avc1", bytes(8))), full(b"stts", struct.pack(">3I", 1, k, 1) if k else bytes(4)), full(b"stsc", struct.pack(">4I", 1, 1, k, 1) if k else bytes(4)), full(b"stsz", struct.pack(">2I", 2 * bool(k), k)), full(b"stco", struct.pack(">2I", 1, 8) if k else bytes(4)))
    mdhd = box(b"mdhd", struct.pack(">IQQIQ", 1 << 24, 0, 0, 1000, mdhd_duration)) if version else full(b"mdhd", struct.pack(">4I2H", 0, 0, 1000, mdhd_duration, 0, 0))
    mdia = box(b"mdia", mdhd, full(b"hdlr", bytes(4), b"vide", bytes(13)), box(b"minf", stbl))
    trak = box(b"trak", full(b"tkhd", struct.pack(">5I", 0, 0, 7, 0, 0), bytes(60)), mdia)
    run = full(b"trun", struct.pack(">Ii", n, 8), *(struct.pack(">2I", lasting, 5) for _ in range(n)), flags=0x301)
    moof = box(b"moof", full(b"mfhd", bytes(4)), box(b"traf", full(b"tfhd", struct.pack(">I", 7), flags=0x20000), full(b"tfdt", struct.pack(">I", fragment_time)), run))
    return box(b"ftyp", b"isom", bytes(4)) + box(b"moov", trak, box(b"mvex", full(b"trex", struct.pack(">5I", 7, 1, 40, 0, 0)))) + moof + box(b"mdat", bytes(5 * n + 80))


def test_durations():
    assert media.tracks(fragmented(20, 20, 0, 20))[0].duration == 3020  # that of the fragments counts, whatever mdhd says
    assert media.tracks(fragmented(20, 0xFFFFFFFF, 0, 20, n=0))[0].duration == 20  # not known
    assert media.tracks(fragmented(0, 0xFFFFFFFFFFFFFFFF, 1))[0].duration == 3000
    assert media.tracks(fragmented(20, 9000, 1, 20))[0].duration == 9000
    assert media.tracks(fragmented(20, 50, n=0))[0].times.tolist() == list(range(20))


def claims():
    """Boxes that claim more than they hold, or point beyond the samples."""
    box, full = media._box, media._full_box
    many = 0xFFFFFFFF
    tables = {
        "stsz of one size": full(b"stsz", struct.pack(">2I", 1, many)), "stsz": full(b"stsz", struct.pack(">2I", 0, many)), "stts": full(b"stts", struct.pack(">3I", 1, many, 1)), "stts entries": full(b"stts", struct.pack(">I", many)),
        "stss": full(b"stsz", struct.pack(">3I", 0, 1, 1)) + full(b"stco", struct.pack(">2I", 1, 0)) + full(b"stsc", struct.pack(">4I", 1, 1, 1, 1)) + full(b"stss", struct.pack(">2I", 1, 9)),
        "stss of none": full(b"stss", struct.pack(">2I", 1, 0)), "stsc": full(b"stsc", struct.pack(">7I", 2, 1, many, 1, many, 1, 1)), "co64": full(b"co64", struct.pack(">2IQ", 1, 1 << 31, 0)), "stz2": full(b"stz2", struct.pack(">2I", 4, many)),
    }
    for name, t in tables.items():
        yield name, box(b"moov", box(b"trak", full(b"tkhd", bytes(80)), box(b"mdia", full(b"mdhd", bytes(20)), box(b"minf", box(b"stbl", t)))))
    yield "trun", box(b"moof", box(b"traf", full(b"tfhd", struct.pack(">I", 1)), full(b"trun", struct.pack(">I", many))))
    yield "trun of one size", box(b"moof", box(b"traf", full(b"tfhd", struct.pack(">2I", 1, 1), flags=16), full(b"trun", struct.pack(">I", many))))


def described_within(data, times=200, more=1 << 20):
    import tracemalloc

    tracemalloc.start()
    found, problem = media._described(data)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < times * len(data) + more, (peak, len(data))
    return found, problem


def test_claims_beyond_a_box_are_problems():
    for name, data in claims():
        found, problem = described_within(data)
        assert problem or name in ("stts",), name  # entries beyond the samples count for nothing


def test_damaged_files_raise_nothing_and_take_no_memory():
    r = random.Random(11)
    whole = [media.container(bytes(range(64)) * n) for n in (1, 70, 300)] + [fragmented(20, 20, 0, 20), fragmented(0, 0, 1)] + [d for _, d in claims()]
    bad = 0
    for _ in range(1500):
        data = bytearray(r.choice(whole))
        for _ in range(r.randrange(1, 6)):
            at = r.randrange(min(len(data), 700))
            data[at : at + 4] = r.choice([b"\xff\xff\xff\xff", b"\x00\x00\x00\x00", b"\x7f\xff\xff\xff", r.randbytes(4), bytes(data[at : at + 1]) + b"\x01\x00\x00"])
        if r.random() < 0.2:
            del data[r.randrange(len(data)) :]
        bad += described_within(bytes(data))[1] is not None
    assert bad > 300


def test_a_damaged_file_stops_no_other(spark):
    rows = [(i, bytearray(d)) for i, (_, d) in enumerate(claims())] + [(99, bytearray(media.container(bytes(64))))]
    got = media.media_columns(spark.createDataFrame(rows, "doc_id long, media binary")).collect()
    assert len(got) == len(rows) and [r["tracks"][0]["samples"] for r in got if r["doc_id"] == 99] == [1]
