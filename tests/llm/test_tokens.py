import random
import zlib

import numpy as np
import pytest

from arborq.llm import codec, packing, tokens
from tests.llm.helpers import documents, odd_texts, words


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_vocabulary())


def ids_of(plain, text):
    return [*plain.encode(text or "", add_special_tokens=False).ids, tokens.END_ID]


MORE = ["it's we'll 's ''s 'save don't's x' 12'3 'é ²³¼'m \"'s", "A\xa0b\x85c\tµ ªº ÿ ß", "<|ENDOFTEXT|> <|x", "ŐΣΣ σς á ́", "naïve…café", "a1b2-c3", "y" * 33 + " " + "z" * 32 + "! " + "é" * 40]


def test_same_ids_as_the_library(plain):
    r = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyzABCéÜß0123456789'''.,!?  \n\t-"
    texts = [t or "" for t in odd_texts()] + MORE + ["".join(r.choices(letters, k=r.randint(0, 80))) for _ in range(300)]
    encode = tokens.Encoder(tokens.default_vocabulary())
    for _ in range(2):
        ids, sizes = encode.encode(texts)
        assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == [ids_of(plain, t) for t in texts]
        encode._reset()


@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 65, 1000])
def test_codec_round_trip(n):
    r = np.random.default_rng(n)
    ids = np.minimum(r.zipf(1.4, n), 65535).astype(np.uint16)
    docs, sizes = [7, None, -3], np.array([n // 2, 0, n - n // 2])
    data = codec.encode_file(docs, sizes, ids, block=64)
    got = codec.decode_file(data)
    assert got[0] == docs and got[1].tolist() == sizes.tolist() and got[2].tolist() == ids.tolist()


def test_codec_extremes():
    for ids in (np.full(5000, 9, np.uint16), np.arange(65536, dtype=np.uint16), np.tile(np.arange(300, dtype=np.uint16), 40), np.random.default_rng(1).integers(0, 65536, 20_000).astype(np.uint16)):
        data = codec.encode_file([1], np.array([len(ids)]), ids)
        assert (codec.decode_file(data)[2] == ids).all()
    rep = np.tile(np.arange(30, dtype=np.uint16), 1000)
    assert len(codec.encode_file([1], np.array([len(rep)]), rep)) < len(rep) // 4


def test_blocks_are_independent_and_damage_is_found():
    ids = np.minimum(np.random.default_rng(2).zipf(1.3, 4000), 60000).astype(np.uint16)
    data = codec.encode_file([1], np.array([len(ids)]), ids, block=500)
    bad = bytearray(data)
    bad[-40] ^= 0x55
    with pytest.raises(ValueError, match="block"):
        codec.decode_file(bytes(bad))
    bad = bytearray(data)
    bad[60] ^= 1
    with pytest.raises(ValueError, match="header"):
        codec.decode_file(bytes(bad))
    with pytest.raises(ValueError):
        codec.decode_file(b"X" + data[1:])


def test_files_of_odd_texts(spark, plain):
    texts = odd_texts() + MORE
    got = {r["doc_id"]: r for r in codec.read_ids(codec.write_ids(documents(spark, texts, extra=True), partitions=3)).collect()}
    at = 0
    for i, t in enumerate(texts):
        ids = np.array(ids_of(plain, t), "<u4")
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert codec.read_ids(codec.write_ids(documents(spark, []))).count() == 0


def check_pieces(rows, ids, window):
    """Every id of every document in one piece; sequences without gaps and no longer than a window."""
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert pieces.keys() == ids.keys()
    for d, own in pieces.items():
        at = 0
        for r in sorted(own, key=lambda r: r["start"]):
            assert r["start"] == at and r["length"] > 0 and r["doc_tokens"] == len(ids[d])
            at += r["length"]
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[d][r["start"] : at], "<u4").tobytes())
        assert at == len(ids[d])
    for own in sequences.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= window
    return 1 - sum(map(len, ids.values())) / (window * len(sequences)) if sequences else 0


def test_packing(spark, plain):
    r = random.Random(6)
    texts = odd_texts() + MORE + [". ".join(" ".join(words(r, r.randint(1, 30))) for _ in range(r.randint(1, 60))) + "." for _ in range(150)]
    ids = {i: ids_of(plain, t) for i, t in enumerate(texts)}
    encode = tokens.Encoder(tokens.default_vocabulary())
    ends = packing.sentence_ids(encode.tokenizer)
    for window, parts in ((4096, 1), (4096, 5), (64, 3), (512, 40)):
        rows = packing.pack(documents(spark, texts, extra=True), window, partitions=parts).collect()
        assert check_pieces(rows, ids, window) < (0.2 if parts < 40 else 0.5)
        rows.sort(key=lambda r: (r["sequence_id"], r["offset"]))
        assert [(r["doc_id"], r["start"]) for r in rows] == sorted((r["doc_id"], r["start"]) for r in rows)  # stretches of the stream, in its order
        assert max(r["offset"] + r["length"] for r in rows) <= window
        stream = np.concatenate([ids[i] for i in sorted(ids)])
        before = np.cumsum([0] + [len(ids[i]) for i in sorted(ids)])
        admissible = np.unique(np.concatenate([before, np.flatnonzero(ends[stream]) + 1]))
        for a, b in zip(rows, rows[1:]):
            cut = before[b["doc_id"]] + b["start"]
            if a["sequence_id"] != b["sequence_id"] and cut not in admissible:  # only where nothing else fits
                k = np.searchsorted(admissible, cut)
                assert admissible[k] - admissible[k - 1] > window
    assert packing.pack(documents(spark, [])).count() == 0


def test_cuts_are_the_best_there_are():
    """Against all ways to cut, on small streams."""
    r = random.Random(7)
    for _ in range(200):
        window = 10
        places = [0]
        while places[-1] < r.randint(5, 60):
            places.append(places[-1] + r.randint(1, 9))
        costs = [0] + [r.choice([0, 2, 5]) for _ in places[1:]]

        def cost(cuts):
            at, total = 0, 0
            for i in cuts:
                n = places[i] - at
                if n > window:
                    return None
                total, at = total + window - n + costs[i], places[i]
            return total if places[-1] - at < window else None

        best = {0: 0}
        for j in range(1, len(places)):
            best[j] = min(best[i] + window - (places[j] - places[i]) + costs[j] for i in range(j) if i in best and places[j] - places[i] <= window)
        least = min(v for j, v in best.items() if places[-1] - places[j] < window)
        got = packing.cuts(np.array(places), np.array(costs), window)
        assert cost(got) == least


def test_room_at_the_end():
    """Against all ways to cut, where what is left has to fit into a part of a window."""
    r = random.Random(12)
    for _ in range(200):
        window, room = 10, r.choice([5, 5, 10, 1])
        places = [0]
        while places[-1] < r.randint(5, 40):
            places.append(places[-1] + r.randint(1, 9))
        costs = [0] + [r.choice([0, 2, 5]) for _ in places[1:]]
        best = {0: 0}
        for j in range(1, len(places)):
            best[j] = min(best[i] + window - (places[j] - places[i]) + costs[j] for i in range(j) if i in best and places[j] - places[i] <= window)
        least = min(v + room - (places[-1] - places[j]) for j, v in best.items() if places[-1] - places[j] <= room)
        total, at = 0, 0
        for i in packing.cuts(np.array(places), np.array(costs), window, room):
            assert places[i] - at <= window
            total, at = total + window - (places[i] - at) + costs[i], places[i]
        assert places[-1] - at <= room and total + room - (places[-1] - at) == least


def test_windows_that_partitions_share():
    got = packing.shared_windows([(0, 0, 7), (1, 5, 0), (2, 3, 2), (5, 4, 0), (6, 0, 1), (7, 0, 2)], 16)
    last = lambda p: p << 32 | packing.LAST
    assert got == [(0, -1, last(0), 0), (1, -2, last(0), 7), (2, -2, last(1), 0), (2, -1, last(2), 0), (5, -2, last(2), 2), (6, -1, last(6), 0), (7, -1, last(7), 0)]


def test_blocks_carry_over(plain):
    r = random.Random(8)
    texts = [" ".join(words(r, r.randint(0, 300))) + "." for _ in range(60)]
    encode = tokens.Encoder(tokens.default_vocabulary())
    packer = packing.Packer(0, packing.sentence_ids(encode.tokenizer), 128, block=1000)
    rows = []
    for i in range(0, 60, 4):
        for b in packer.add(list(range(i, i + 4)), *encode.encode(texts[i : i + 4])):
            rows += b.to_pylist()
    for b in packer.flush():
        rows += b.to_pylist()
    for x in rows:
        x["sequence_id"] = x["window_no"]
    assert check_pieces(rows, {i: ids_of(plain, t) for i, t in enumerate(texts)}, 128) < 0.2
