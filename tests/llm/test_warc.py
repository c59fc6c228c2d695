import gzip
import io
import os
import random

import pyarrow as pa
import pyarrow.fs as pafs
import pytest
from pyspark.sql import functions as F

from arborq.llm import warc
from tests.llm.helpers import odd_texts

PAGES = "page_id long, url string, html string, sha1 string, n int, again boolean, page string"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", 1, True, "x") for i, u, h in rows], PAGES)


def by_hand(rows, min_bytes=0):
    import base64
    import hashlib

    out, most = [], {}
    for i, _, h in rows:
        b = (h or "").encode()
        most[b] = max(most.get(b, -1), -1 if i is None else i)
    for i, _, h in rows:
        b = (h or "").encode()
        own = len(b) < min_bytes or most[b] == (-1 if i is None else i)
        out.append((i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if own else "revisit", None if own else most[b]))
    return sorted(out, key=str)


def odd_pages():
    r = random.Random(1)
    rows = [(i, f"http://e.org/{i}", t) for i, t in enumerate(odd_texts())]
    rows += [(100 + i, r.choice([None, "", " http://x/\r\nWARC-Type: forged ", "http://é.org/漢"]), r.choice(["hot", "hot", f"few {i % 7}", None, "", "\r\n\r\nWARC/1.1\r\n", "\x1f\x8b\x08"])) for i in range(300)]
    rows += [(None, "u", "hot"), (None, "u", "lone"), (None, "u", "lone"), (7, "u", "hot"), (7, "u", "hot"), (5000, "big", "é" * 700_000), (5001, "big", "é" * 700_000)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("min_bytes", [0, 4])
def test_pages_read_back(spark, tmp_path, min_bytes):
    rows, path = odd_pages(), str(tmp_path / "a")
    warc.archive(pages(spark, rows).repartition(5), path, min_bytes)
    assert sorted(map(tuple, warc.read_pages(spark, path).collect()), key=str) == by_hand(rows, min_bytes)
    got = spark.read.format("warc").load(path).where("record_type = 'response'").select("target_uri", "payload").collect()
    assert {bytes(r["payload"]) for r in got} == {(h or "").encode() for _, _, h in rows}
    assert {r["target_uri"] for r in got} <= {None if u is None else warc.clean(u) for _, u, _ in rows}
    assert spark.read.format("warc").load(path).where("record_type = 'revisit' AND octet_length(payload) > 0").count() == 0


def test_archives_are_plain_gzip(spark, tmp_path):
    path = str(tmp_path / "a")
    warc.archive(pages(spark, [(1, "u", "one"), (2, "u", "two")]).coalesce(1), path)
    files = [f for f in os.listdir(path) if f.endswith(".warc.gz")]
    whole = b"".join(gzip.open(f"{path}/{f}").read() for f in files)
    assert whole.count(b"WARC/1.1\r\n") == 2 and whole.endswith(b"\r\n\r\n") and b"\r\n\r\none\r\n\r\n" in whole


def test_empty_table(spark, tmp_path):
    warc.archive(pages(spark, []), str(tmp_path / "a"))
    assert warc.read_pages(spark, str(tmp_path / "a")).count() == 0


def test_only_files_of_the_manifest_are_read(spark, tmp_path):
    path = str(tmp_path / "a")
    warc.archive(pages(spark, [(i, "u", f"t{i}") for i in range(50)]), path)
    with open(f"{path}/part-lost.warc.gz", "wb") as f:
        f.write(warc.record([("WARC-Type", "response"), ("WARC-Page-ID", "9")], b"left by a lost task"))
    assert warc.read_pages(spark, path).count() == 50
    os.remove(f"{path}/{warc.MANIFEST}")
    assert warc.read_pages(spark, path).count() == 51


FIELDS = [("WARC-Type", "resource"), ("WARC-Target-URI", "http://a/b"), ("Content-Type", "text/plain")]


def plain(header, block):
    return b"WARC/1.0\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in header) + b"Content-Length: %d\r\n\r\n" % len(block) + block + b"\r\n\r\n"


def foreign(n):
    """Records of other writers: plain and compressed without skip lengths, folded headers, types of all kinds, blocks that look like records."""
    r = random.Random(n)
    return [([("WARC-Type", r.choice(["resource", "request", "metadata", "response"])), ("WARC-Target-URI", f"http://{r.choice('abc')}.org/{i}"), ("Content-Type", r.choice(["text/plain", "application/http; msgtype=response"])), ("X", "a\r\n  b")], r.choice([b"", b"x" * r.randrange(9000), b"H: 1\r\n\r\nWARC/1.1\r\n\x1f\x8b\x08" * 3])) for i in range(n)]


@pytest.mark.parametrize("packed", [False, True])
def test_foreign_archives_and_predicates(spark, tmp_path, packed):
    warc.register(spark)
    recs = foreign(200)
    data = b"".join(gzip.compress(plain(h, b)) if packed else plain(h, b) for h, b in recs)
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / ("x.warc.gz" if packed else "x.warc")).write_bytes(data)
    df = spark.read.format("warc").load(str(tmp_path))
    want = [(h[0][1], h[1][1], warc.payload_of(dict(h), b), len(b)) for h, b in recs]
    got = [(r["record_type"], r["target_uri"], bytes(r["payload"]), r["content_length"]) for r in df.orderBy("offset").collect()]
    assert got == want and {r["headers"]["X"] for r in df.collect()} == {"a b"}
    cases = {
        "record_type = 'request'": lambda w: w[0] == "request",
        "record_type IN ('request', 'metadata') AND target_uri LIKE 'http://a%'": lambda w: w[0] in ("request", "metadata") and w[1].startswith("http://a"),
        "NOT target_uri LIKE '%org/7%' AND content_length > 100": lambda w: "org/7" not in w[1] and w[3] > 100,
        "content_length <= 0 OR record_type = 'response'": lambda w: w[3] <= 0 or w[0] == "response",
        "refers_to IS NULL AND record_type <> 'resource' AND target_uri >= 'http://b'": lambda w: w[0] != "resource" and w[1] >= "http://b",
        "refers_to = 'x'": lambda w: False,
        "octet_length(payload) = 0": lambda w: not w[2],
    }
    for sql, holds in cases.items():
        assert warc.read(spark, str(tmp_path), sql).count() == sum(map(holds, want)), sql
    assert warc.read(spark, str(tmp_path), "record_type = 'request'", payload=False).count() == sum(w[0] == "request" for w in want)
    assert warc.read(spark, str(tmp_path), "payload IS NOT NULL", payload=False).count() == 0


def read_all(data, wanted=lambda h: True):
    return list(warc.records(warc.Source(pa.PythonFile(io.BytesIO(data), "r")), wanted))


def test_damaged_archives():
    """Whatever bytes are lost or changed, reading ends, and records that aren't touched are found."""
    r = random.Random(5)
    for make in (lambda h, b: plain(h, b), lambda h, b: gzip.compress(plain(h, b)), lambda h, b: warc.record(h, b)):
        parts = [make(FIELDS, b"text %d " % i + r.randbytes(40)) for i in range(12)]
        for _ in range(150):
            bad = r.randrange(12)
            piece = bytearray(parts[bad])
            for _ in range(r.randrange(1, 5)):
                piece[r.randrange(len(piece))] = r.randrange(256)
            if r.random() < 0.3:
                del piece[r.randrange(len(piece)) :]
            data = b"".join([*parts[:bad], bytes(piece), *parts[bad + 1 :]])
            blocks = [b for _, h, b, _ in read_all(data) if h]
            texts = {b[: b.index(b" ", 5)] for b in blocks if b.startswith(b"text ") and b" " in b[5:]}
            assert {b"text %d" % i for i in range(bad)} <= texts
    for _ in range(300):
        read_all(r.randbytes(200) + b"\nWARC/1.0\r\n" + r.randbytes(30))
    (only,) = [x for x in read_all(b"WARC/1.0\r\nContent-Length: 99999999999\r\n\r\nx")]
    assert only[1] is None and "ends within" in only[3]


def test_problems_are_rows(spark, tmp_path):
    warc.register(spark)
    (tmp_path / "x.warc").write_bytes(plain(FIELDS, b"one") + b"rubbish\r\n\r\n" + plain(FIELDS, b"two"))
    for sql, n in (("problem IS NULL", 2), ("problem IS NOT NULL", 1), ("record_type = 'resource'", 2)):
        assert warc.read(spark, str(tmp_path), sql).count() == n


class Counting(io.BytesIO):
    def read(self, n=-1):
        self.total = getattr(self, "total", 0) + n
        return super().read(n)


def test_unwanted_payloads_are_not_decoded():
    big = os.urandom(3_000_000)
    for data in (plain(FIELDS, big) * 3, warc.record(FIELDS, big) * 3):
        file = Counting(data)
        source = warc.Source(pa.PythonFile(file, "r"))
        assert len(list(warc.records(source, lambda h: False))) == 3
        assert file.total <= 4 * warc.CHUNK


def test_small_files_share_a_partition_and_large_ones_are_rolled(spark, tmp_path):
    path = str(tmp_path / "a")
    rows = spark.range(400).select(F.create_map(F.lit("WARC-Type"), F.lit("resource")).alias("headers"), F.sha2(F.col("id").cast("string"), 512).cast("binary").alias("block"))
    warc.register(spark)
    rows.coalesce(1).write.format("warc").option("file_bytes", "4000").mode("overwrite").save(path)
    assert len([f for f in os.listdir(path) if f.endswith(".gz")]) > 5
    assert len(warc.Reader({"path": path}).partitions()) == 1
    df = spark.read.format("warc").load(path)
    assert df.count() == 400 and df.select("payload").distinct().count() == 400
    with pytest.raises(Exception):
        rows.write.format("warc").mode("append").save(path)


def test_filesystems(tmp_path):
    assert isinstance(warc.filesystem(str(tmp_path))[0], pafs.LocalFileSystem) and warc.filesystem(f"file://{tmp_path}")[1] == str(tmp_path)
