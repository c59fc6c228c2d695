"""WARC archives: a PySpark data source that reads and writes them, and archives without repeated payloads.

``spark.read.format("warc")`` plans partitions of whole files, small ones together, from the archive's manifest or a
listing. A record's header is parsed first; predicates on the record's type and on header columns are pushed down to it,
and what they turn away is never decoded: plain records are stepped over by their length, compressed ones by the skip
length in their gzip member. Option ``payload=false`` steps over all payloads. Files and lists go through pyarrow's
filesystems, so that a path may be of any kind that these know. Load anew for each query, as `read` does: Spark 4.1 keeps
the predicates that one query of a loaded DataFrame has pushed for its later ones that push none.

``df.write.format("warc")`` writes one gzip member a record. A task's files carry a name of their own, and the manifest
that is written last lists those of the tasks that counted: a file of a lost or repeated attempt is never read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

from arborq.llm.common import _written, new_path, stored, table

#: Columns that are header fields, and the fields' names. Fixed values of the format.
FIELDS = {
    "record_id": "WARC-Record-ID",
    "record_type": "WARC-Type",
    "target_uri": "WARC-Target-URI",
    "date": "WARC-Date",
    "payload_digest": "WARC-Payload-Digest",
    "refers_to": "WARC-Refers-To",
    "content_type": "Content-Type",
    "page": "WARC-Page-ID",
}
SCHEMA = "".join(f"{c} string, " for c in FIELDS) + "content_length long, headers map<string,string>, payload binary, file string, offset long, problem string"
ARROW = pa.schema([(c, pa.string()) for c in FIELDS] + [("content_length", pa.int64()), ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary()), ("file", pa.string()), ("offset", pa.int64()), ("problem", pa.string())])
#: Profile of a record that repeats another's payload. A fixed value of the format.
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "_manifest.json"
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
#: A file is closed at this many bytes; files are put together to partitions of this many.
FILE_BYTES = 128 << 20
#: An Arrow batch ends at this many bytes of payload, or rows.
BATCH_BYTES, BATCH_ROWS = 8 << 20, 2000
CHUNK, WINDOW = 1 << 18, 1 << 11
#: No header is longer.
HEADER_BYTES = 1 << 20
GZIP, PLAIN = b"\x1f\x8b\x08", b"WARC/1."


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The filesystem of a path or URI, and the path in it."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


# --- reading


@dataclass
class Files(ds.InputPartition):
    paths: list[str]


class Source:
    """A file by windows: bytes at any place, read a chunk at a time."""

    def __init__(self, file: pa.NativeFile):
        self.file, self.size = file, file.size()
        self.start, self.held = 0, b""

    def at(self, place: int, n: int) -> bytes:
        """n bytes from `place` on, or as many as the file has."""
        n = min(n, self.size - place)
        if place < self.start or place + n > self.start + len(self.held):
            self.file.seek(place)
            self.start, self.held = place, self.file.read(max(n, CHUNK))
        return self.held[place - self.start : place - self.start + n]


class Damaged(ValueError):
    pass


def parse_header(raw: bytes) -> dict[str, str]:
    """Fields of a record's header, without the blank line at its end. A field's further lines are joined to it by a blank."""
    lines = raw.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise Damaged("no version line")
    out: dict[str, str] = {}
    last = None
    for line in lines[1:]:
        if line[:1] in (" ", "\t") and last:
            out[last] += " " + line.strip(" \t")
            continue
        last, colon, value = line.partition(":")
        if not colon:
            raise Damaged("a header line without a colon")
        last = last.strip(" \t")
        out[last] = value.strip(" \t")
    return out


def length_of(header: dict[str, str]) -> int:
    n = header.get("Content-Length", "")
    if not n.isascii() or not n.isdigit() or len(n) > 18:
        raise Damaged("no content length")
    return int(n)


def payload_of(header: dict[str, str], block: bytes) -> bytes:
    """What a record is about: of an HTTP message its body, else the block."""
    if header.get("Content-Type", "").replace(" ", "").lower().startswith("application/http"):
        return block.partition(b"\r\n\r\n")[2]
    return block


def skip_length(member: bytes) -> int | None:
    """The length of a whole gzip member as told by its `sl` field (that of the format's annex on compression), if it has one."""
    if len(member) < 12 or not member[3] & 4:
        return None
    field, end = 12, 12 + struct.unpack_from("<H", member, 10)[0]
    while field + 4 <= min(end, len(member)):
        n = struct.unpack_from("<H", member, field + 2)[0]
        if member[field : field + 2] == b"sl" and n == 8 and field + 12 <= len(member):
            return struct.unpack_from("<I", member, field + 4)[0] or None
        field += 4 + n
    return None


def _plain(source: Source, place: int, wanted) -> tuple[dict, bytes | None, int]:
    raw = source.at(place, WINDOW)
    while (cut := raw.find(b"\r\n\r\n")) < 0:
        if len(raw) >= min(HEADER_BYTES, source.size - place):
            raise Damaged("a header without an end")
        raw = source.at(place, 2 * len(raw))
    header = parse_header(raw[:cut])
    n, body = length_of(header), place + cut + 4
    if body + n > source.size:
        raise Damaged("the file ends within a record")
    return header, source.at(body, n) if wanted(header) else None, body + n


def _gzip(source: Source, place: int, wanted) -> tuple[dict, bytes | None, int]:
    """The header is inflated first. If the rest isn't wanted and the member tells its length, it is stepped over."""
    skip = skip_length(source.at(place, 64))
    if skip and place + skip > source.size:
        raise Damaged("the file ends within a record")
    inflate, out, read, header, keep, made = zlib.decompressobj(31), bytearray(), place, None, True, 0
    while not inflate.eof:
        piece = inflate.unconsumed_tail
        if not piece:
            left = place + skip - read if skip else CHUNK
            piece = source.at(read, min(left, WINDOW) if header is None else left)
            read += len(piece)
        if not piece:
            raise Damaged("the file ends within a record")
        try:
            more = inflate.decompress(piece, WINDOW if header is None else CHUNK)
        except zlib.error as e:
            raise Damaged(f"gzip: {e}") from None
        made += len(more)
        if keep:
            out += more
        if header is None:
            cut = out.find(b"\r\n\r\n")
            if cut < 0:
                if len(out) > HEADER_BYTES:
                    raise Damaged("a header without an end")
                continue
            header, body = parse_header(bytes(out[:cut])), cut + 4
            n, keep = length_of(header), wanted(header)
            if not keep:
                if skip:
                    return header, None, place + skip
                out = bytearray()
    if header is None:
        raise Damaged("a header without an end")
    if body + n > made:
        raise Damaged("a block shorter than its length")
    return header, bytes(out[body : body + n]) if keep else None, read - len(inflate.unused_data)


def records(source: Source, wanted) -> Iterator[tuple[int, dict | None, bytes | None, str | None]]:
    """(offset, header, block, problem) of each record of a file; the block is None unless wanted(header).

    What can't be read is one row with its problem, without a header, and reading goes on at the next start of a record.
    """
    place = 0
    while place < source.size:
        first = source.at(place, 8)
        if first[:1] in (b"\r", b"\n"):
            place += 1
            continue
        try:
            if first[:3] != GZIP and first[:7] != PLAIN:
                raise Damaged("no record starts here")
            header, block, after = (_gzip if first[:3] == GZIP else _plain)(source, place, wanted)
        except Damaged as e:
            yield place, None, None, str(e)
            place = _next_start(source, place + 1)
            continue
        yield place, header, block, None
        place = after


def _next_start(source: Source, place: int) -> int:
    while place < source.size:
        piece = source.at(place, CHUNK)
        found = [i for i in (piece.find(GZIP), piece.find(b"\n" + PLAIN)) if i >= 0]
        if found:
            return place + min(found)
        place += max(1, len(piece) - len(PLAIN))
    return source.size


def _holds(f: ds.Filter, value):
    """Whether a header column's value passes a filter; SQL's null passes none but its own."""
    if isinstance(f, ds.IsNull):
        return value is None
    if isinstance(f, ds.IsNotNull):
        return value is not None
    if isinstance(f, ds.EqualNullSafe):
        return value == f.value
    if value is None or (f.value is None):
        return False
    if isinstance(f, ds.EqualTo):
        return value == f.value
    if isinstance(f, ds.In):
        return value in f.value
    if isinstance(f, ds.StringStartsWith):
        return value.startswith(f.value)
    if isinstance(f, ds.StringEndsWith):
        return value.endswith(f.value)
    if isinstance(f, ds.StringContains):
        return f.value in value
    if isinstance(value, str):  # Spark compares strings by their bytes
        value, to = value.encode(), f.value.encode()
    else:
        to = f.value
    return value > to if isinstance(f, ds.GreaterThan) else value >= to if isinstance(f, ds.GreaterThanOrEqual) else value < to if isinstance(f, ds.LessThan) else value <= to


_PUSHED = (ds.IsNull, ds.IsNotNull, ds.EqualNullSafe, ds.EqualTo, ds.In, ds.StringStartsWith, ds.StringEndsWith, ds.StringContains, ds.GreaterThan, ds.GreaterThanOrEqual, ds.LessThan, ds.LessThanOrEqual)


def _values(header: dict[str, str]) -> dict:
    return {c: header.get(name) for c, name in FIELDS.items()} | {"content_length": length_of(header)}


class Reader(ds.DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.payload = options["path"], options.get("payload", "true").lower() != "false"
        self.filters: list[ds.Filter] = []

    def pushFilters(self, filters: list[ds.Filter]):
        """Takes predicates on header columns, all of a row of problems fail them; others are Spark's."""
        for f in filters:
            of = f.child if isinstance(f, ds.Not) else f
            if isinstance(of, _PUSHED) and len(of.attribute) == 1 and of.attribute[0] in (*FIELDS, "content_length") and not (isinstance(of, ds.In) and None in of.value):
                self.filters.append(f)
            else:
                yield f

    def passes(self, values: dict) -> bool:
        for f in self.filters:
            if isinstance(f, ds.Not):
                value = values[f.child.attribute[0]]
                known = isinstance(f.child, (ds.IsNull, ds.IsNotNull, ds.EqualNullSafe)) or value is not None and f.child.value is not None
                if not known or _holds(f.child, value):
                    return False
            elif not _holds(f, values[f.attribute[0]]):
                return False
        return True

    def partitions(self) -> list[Files]:
        """Whole files, those of a manifest if there is one, by size put together to FILE_BYTES."""
        system, path = filesystem(self.path)
        info = system.get_file_info(path)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        if info.type == pafs.FileType.File:
            return [Files([path])]
        if system.get_file_info(f"{path}/{MANIFEST}").type == pafs.FileType.File:
            with system.open_input_stream(f"{path}/{MANIFEST}") as f:
                listed = [(n, f"{path}/{name}") for name, n in json.loads(f.read())]
        else:
            found = system.get_file_info(pafs.FileSelector(path, recursive=True))
            listed = [(x.size, x.path) for x in found if x.type == pafs.FileType.File and x.path.endswith((".warc", ".warc.gz"))]
        out, size = [], FILE_BYTES
        for n, name in sorted(listed):
            if size + n > FILE_BYTES:
                out.append(Files([]))
                size = 0
            out[-1].paths.append(name)
            size += n
        return out or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, _ = filesystem(self.path)
        rows, size = [], 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(rows, ARROW)

        for path in partition.paths:
            with system.open_input_file(path) as file:
                for offset, header, block, problem in records(Source(file), lambda h: self.payload and self.passes(_values(h))):
                    if header is None:
                        if not self.filters:
                            rows.append({"file": path, "offset": offset, "problem": problem})
                        continue
                    values = _values(header)
                    if block is None and self.payload or not self.payload and not self.passes(values):
                        continue
                    payload = None if block is None else payload_of(header, block)
                    rows.append(values | {"headers": list(header.items()), "payload": payload, "file": path, "offset": offset})
                    size += len(payload or b"")
                    if size >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                        yield batch()
                        rows, size = [], 0
        yield batch()


# --- writing


def clean(value: str) -> str:
    """A header value on one line: control characters, and blanks at either end, are written as %XX."""
    inner = len(value) - len(value.lstrip(" ")), len(value.rstrip(" "))
    return "".join(f"%{ord(c):02X}" if c < " " or c == "\x7f" or c == " " and not inner[0] <= i < inner[1] else c for i, c in enumerate(value))


def record(header: list[tuple[str, str]], block: bytes, level: int = 1) -> bytes:
    """A record as a gzip member whose `sl` field tells its length, compressed and not."""
    lines = [b"WARC/1.1", *(f"{k}: {clean(v)}".encode("utf-8", "replace") for k, v in header), b"Content-Length: %d" % len(block)]
    whole = b"\r\n".join(lines) + b"\r\n\r\n" + block + b"\r\n\r\n"
    deflate = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = deflate.compress(whole) + deflate.flush()
    total = 24 + len(body) + 8
    skip = struct.pack("<HII", 8, total, len(whole)) if total < 1 << 32 and len(whole) < 1 << 32 else struct.pack("<HII", 8, 0, 0)
    head = GZIP + b"\x04" + bytes(4) + b"\x00\xff" + struct.pack("<H", 12) + b"sl" + skip
    return head + body + struct.pack("<II", zlib.crc32(whole), len(whole) & 0xFFFFFFFF)


@dataclass
class Wrote(ds.WriterCommitMessage):
    files: list[tuple[str, int]]


class Writer(ds.DataSourceArrowWriter):
    """Rows (type, headers map<string,string>, block binary): a record each. A null map or block is empty."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.file_bytes = options["path"], int(options.get("file_bytes", FILE_BYTES))
        system, path = filesystem(self.path)
        if not overwrite and system.get_file_info(f"{path}/{MANIFEST}").type != pafs.FileType.NotFound:
            raise FileExistsError(self.path)

    def write(self, batches: Iterator[pa.RecordBatch]) -> Wrote:
        system, path = filesystem(self.path)
        system.create_dir(path, recursive=True)
        wrote: list[tuple[str, int]] = []
        out = None
        try:
            for batch in batches:
                headers, blocks = (batch.column(batch.schema.get_field_index(c)) for c in ("headers", "block"))
                for header, block in zip(headers, blocks, strict=True):
                    if out is None:
                        name = f"part-{uuid.uuid4().hex}.warc.gz"
                        out, size = system.open_output_stream(f"{path}/{name}", compression=None), 0
                    data = record(header.as_py() or [], block.as_py() or b"")
                    out.write(data)
                    size += len(data)
                    if size >= self.file_bytes:
                        out.close()
                        wrote.append((name, size))
                        out = None
            if out is not None:
                out.close()
                wrote.append((name, size))
        finally:
            if out is not None and not out.closed:
                out.close()
        return Wrote(wrote)

    def commit(self, messages: list[Wrote | None]) -> None:
        system, path = filesystem(self.path)
        system.create_dir(path, recursive=True)
        with system.open_output_stream(f"{path}/{MANIFEST}") as f:
            f.write(json.dumps(sorted(x for m in messages if m for x in m.files)).encode())

    def abort(self, messages: list[Wrote | None]) -> None:
        system, path = filesystem(self.path)
        for m in messages:
            for name, _ in m.files if m else ():
                system.delete_file(f"{path}/{name}")


class Warc(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    """Makes format "warc" known to the session, and lets it take predicates."""
    spark.dataSource.register(Warc)
    spark.conf.set(PUSHDOWN, "true")


def read(spark: SparkSession, path: str, where: str | Column, payload: bool = True) -> DataFrame:
    """Records that meet a predicate, from a load of their own; without payloads if these aren't wanted."""
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path).where(where)


# --- archives of pages


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def base32_of_hex(c: Column) -> Column:
    """Upper-case base32 of the 40 hex digits of a SHA-1: 10 of them are 8 of its."""
    parts = [F.lpad(F.conv(F.substring(c, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def archive(pages: DataFrame, path: str, min_bytes: int = 0, date: str = "2025-01-01T00:00:00Z") -> None:
    """Writes pages (page_id, url, html; others are left out) to `path`, a record each, payloads once.

    The payload is html in UTF-8, null as empty. Of pages with equal payloads of at least min_bytes bytes, that of the
    largest page_id is a response (null is the smallest; rows that repeat that id are responses too), and the others are
    revisits that refer to it, without a payload of their own. A null url leaves out the field, control characters in it
    and blanks around it are written as %XX. The largest id of each repeated payload is found by an aggregate; only payloads that do repeat are
    in the table that pages are joined with, and a payload that most pages share is split like any large join key.
    """
    spark = pages.sparkSession
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page"), "url", html.alias("html"), F.sha1(html.cast("binary")).alias("sha1"), F.octet_length(html).alias("n"))
    groups = rows.where(F.col("n") >= min_bytes).groupBy("sha1").agg(F.max("page").alias("first"), F.count("*").alias("rows"))
    repeated = stored(groups.where("rows > 1").select("sha1", "first"), "repeated")
    out = rows.join(repeated, "sha1", "left").withColumn("again", F.col("first").isNotNull() & ~F.col("page").eqNullSafe(F.col("first")) & (F.col("n") >= min_bytes))
    said = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    key = lambda c: F.concat(F.lit("<urn:sha1:"), F.sha1(F.concat(said(c), F.lit(":"), F.col("sha1"))), F.lit(">"))
    again, hidden = F.col("again"), F.lit(None).cast("string")
    fields = {
        "WARC-Type": F.when(again, "revisit").otherwise("response"),
        "WARC-Record-ID": key(F.col("page")),
        "WARC-Date": F.lit(date),
        "WARC-Target-URI": F.col("url"),
        "WARC-Page-ID": F.col("page").cast("string"),
        "WARC-Payload-Digest": F.concat(F.lit("sha1:"), base32_of_hex(F.col("sha1"))),
        "WARC-Refers-To": F.when(again, key(F.col("first"))),
        "WARC-Profile": F.when(again, SAME_PAYLOAD).otherwise(hidden),
        "Content-Type": F.lit("application/http; msgtype=response"),
    }
    headers = F.map_filter(F.create_map(*[x for k, v in fields.items() for x in (F.lit(k), v)]), lambda k, v: v.isNotNull())
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("n").cast("string"), F.lit("\r\n\r\n"))
    block = F.concat(http.cast("binary"), F.when(again, F.lit("").cast("binary")).otherwise(F.col("html").cast("binary")))
    register(spark)
    out.select(headers.alias("headers"), block.alias("block")).write.format("warc").mode("overwrite").save(path)


def _read_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        payloads = [x.as_py() for x in batch.column("payload")]
        sums = [base32(hashlib.sha1(x).digest()) for x in payloads]
        yield pa.RecordBatch.from_arrays([batch.column("record_id"), batch.column("page"), pa.array([len(x) for x in payloads], pa.int64()), pa.array(sums, pa.string())], names=["record_id", "page", "payload_bytes", "payload_digest"])


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to): a row for each record of an archive of pages.

    Sizes and digests are those of payloads as read; a revisit has those of the response that it refers to, or the digest
    of its own header and no size where the archive has no such response. Revisits are read without their blocks.
    """
    responses = read(spark, path, "record_type = 'response'").select("record_id", "page", "payload")
    own = stored(responses.mapInArrow(_read_digests, "record_id string, page string, payload_bytes long, payload_digest string"), "responses", compression="uncompressed")
    revisits = read(spark, path, "record_type = 'revisit'", payload=False).select("page", "refers_to", F.regexp_replace("payload_digest", "^sha1:", "").alias("told"))
    there = own.select(F.col("record_id").alias("refers_to"), F.col("page").alias("first"), "payload_bytes", "payload_digest").dropDuplicates(["refers_to"])
    again = revisits.join(there, "refers_to", "left")
    page = F.col("page").cast("long").alias("page_id")
    return own.select(page, "payload_bytes", "payload_digest", F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to")).unionByName(
        again.select(page, "payload_bytes", F.coalesce("payload_digest", "told").alias("payload_digest"), F.lit("revisit").alias("record_type"), F.col("first").cast("long").alias("refers_to"))
    )


def op13_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "archive")
    _written.append(path)
    archive(table(spark, sf_dir, "pages"), path)
    return read_pages(spark, path)


OP13_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages),
d AS (SELECT page_id, strlen(html) AS n, sha1(html) AS h, page_id IS NOT DISTINCT FROM first AS own, first FROM p)
SELECT page_id, n::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(h, 1 + 10 * (i // 8), 10))::BIGINT >> (35 - 5 * (i % 8))) & 31)::INTEGER, 1)), '') AS payload_digest,
  CASE WHEN own THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN own THEN NULL ELSE first END AS refers_to
FROM d
"""
