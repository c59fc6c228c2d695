"""Folders of source files as tables (uri, path, content, language_id, is_regular).

``spark.read.format("source_tree")`` lists a folder in parallel: the driver goes down until there are PARTS folders to deal
out, and each task lists its own on. Skipped folders and links aren't entered, and a file is opened only if its kind is
known and what a query says of path, name, kind, language and size holds for it: such predicates are pushed to the
listing. With option ``content=false`` no file is opened. Load anew for each query, as `tree` does: Spark 4.1 keeps the
predicates that one query of a loaded DataFrame has pushed for its later ones that push none.
"""

from __future__ import annotations

import os
import posixpath
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F

from arborq.functions import paths

#: Folders that are never entered.
SKIPPED = (".git", ".svn", ".hg", "node_modules")
FILES = "uri string, path string, content string, language_id string, is_regular boolean"
TREE = "uri string, path string, name string, kind string, language_id string, size long, content string, problem string"
ARROW = pa.schema([(c.split()[0], pa.int64() if c.endswith("long") else pa.string()) for c in TREE.split(", ")])
#: Folders to deal out, at least, if there are that many; folders that the driver lists, at most; files to a partition of those it has found; bytes of a batch, and of such a partition.
PARTS, LISTED, FILES_EACH, BATCH_BYTES = 64, 2000, 500, 8 << 20
#: Schemes that the listing reaches; other stores go through Spark's own reader.
SCHEMES = ("file", "s3", "gs", "gcs", "hdfs")
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


class TooManyFiles(Exception):
    """A folder holds more Julia files than the cap allows."""


def filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """The filesystem of a path or URI, and the path in it."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def entries(system: pafs.FileSystem, folder: str) -> tuple[list[str], list[tuple[str, int]]]:
    """(folders to enter, (path, size) of files whose kind is known) of a folder, sorted. Links to folders aren't entered; what can't be listed is empty."""
    down, found = [], []
    try:
        if isinstance(system, pafs.LocalFileSystem):
            with os.scandir(folder) as listed:
                for x in listed:
                    if x.is_dir(follow_symlinks=False):
                        down.append((x.name, f"{folder.rstrip('/')}/{x.name}"))
                    elif paths.kind_of(x.name) and x.is_file():
                        found.append((f"{folder.rstrip('/')}/{x.name}", x.stat().st_size))
        else:
            for x in system.get_file_info(pafs.FileSelector(folder)):
                if x.type == pafs.FileType.Directory:
                    down.append((x.base_name, x.path))
                elif x.type == pafs.FileType.File and paths.kind_of(x.base_name):
                    found.append((x.path, x.size))
    except OSError:
        return [], []
    return sorted(p for name, p in down if name not in SKIPPED), sorted(found)


@dataclass
class Part(ds.InputPartition):
    folders: list[str] = field(default_factory=list)
    files: list[tuple[str, int]] = field(default_factory=list)


def _passes(f: ds.Filter, row: dict) -> bool:
    """Whether a row passes a pushed filter; null passes only where SQL says so."""
    if isinstance(f, ds.Not):
        inner = f.child
        known = isinstance(inner, (ds.IsNull, ds.IsNotNull, ds.EqualNullSafe)) or row[inner.attribute[0]] is not None and inner.value is not None
        return known and not _passes(inner, row)
    value = row[f.attribute[0]]
    if isinstance(f, (ds.IsNull, ds.IsNotNull)):
        return (value is None) == isinstance(f, ds.IsNull)
    if isinstance(f, ds.EqualNullSafe):
        return value == f.value
    if value is None or f.value is None:
        return False
    key = (lambda x: x.encode()) if isinstance(value, str) else (lambda x: x)  # Spark compares strings by their bytes
    tests = {
        ds.EqualTo: lambda: value == f.value, ds.In: lambda: value in f.value, ds.StringStartsWith: lambda: value.startswith(f.value), ds.StringEndsWith: lambda: value.endswith(f.value), ds.StringContains: lambda: f.value in value,
        ds.GreaterThan: lambda: key(value) > key(f.value), ds.GreaterThanOrEqual: lambda: key(value) >= key(f.value), ds.LessThan: lambda: key(value) < key(f.value), ds.LessThanOrEqual: lambda: key(value) <= key(f.value),
    }
    return tests[type(f)]()


_PUSHED = (ds.IsNull, ds.IsNotNull, ds.EqualNullSafe, ds.EqualTo, ds.In, ds.StringStartsWith, ds.StringEndsWith, ds.StringContains, ds.GreaterThan, ds.GreaterThanOrEqual, ds.LessThan, ds.LessThanOrEqual)


class TreeReader(ds.DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.content = options["path"], options.get("content", "true").lower() != "false"
        self.filters: list[ds.Filter] = []

    def pushFilters(self, filters: list[ds.Filter]):
        for f in filters:
            of = f.child if isinstance(f, ds.Not) else f
            if isinstance(of, _PUSHED) and len(of.attribute) == 1 and of.attribute[0] in ("uri", "path", "name", "kind", "language_id", "size") and not (isinstance(of, ds.In) and None in of.value):
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[Part]:
        system, root = filesystem(self.path)
        if system.get_file_info(root).type != pafs.FileType.Directory:
            raise FileNotFoundError(self.path)
        todo, found, n = deque([root]), [], 0
        while todo and len(todo) < PARTS and n < LISTED:
            down, files = entries(system, todo.popleft())
            todo.extend(down)
            found += files
            n += 1
        parts, size = [], 0
        for path, n in found:
            if not parts or len(parts[-1].files) >= FILES_EACH or size + n > BATCH_BYTES:
                parts.append(Part())
                size = 0
            parts[-1].files.append((path, n))
            size += n
        return parts + [Part(folders=[x]) for x in todo] or [Part()]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        system, _ = filesystem(self.path)
        rows, size = [], 0
        for path, n in self._files(system, part):
            row = {"uri": paths.path_to_uri(path), "path": path, "name": posixpath.basename(path), "kind": (kind := paths.kind_of(path)), "language_id": paths.LANGUAGES[kind], "size": n}
            if not all(_passes(f, row) for f in self.filters):
                continue
            if self.content:
                row["content"], row["problem"] = read_text(system, path)
            rows.append(row)
            size += n
            if size >= BATCH_BYTES or len(rows) >= 2000:
                yield pa.RecordBatch.from_pylist(rows, ARROW)
                rows, size = [], 0
        yield pa.RecordBatch.from_pylist(rows, ARROW)

    def _files(self, system: pafs.FileSystem, part: Part) -> Iterator[tuple[str, int]]:
        yield from part.files
        todo = deque(part.folders)
        while todo:
            down, found = entries(system, todo.popleft())
            todo.extend(down)
            yield from found


class Tree(ds.DataSource):
    @classmethod
    def name(cls) -> str:
        return "source_tree"

    def schema(self) -> str:
        return TREE

    def reader(self, schema) -> TreeReader:
        return TreeReader(dict(self.options))


def read_text(system: pafs.FileSystem, path: str) -> tuple[str | None, str | None]:
    """(content, what is wrong): text is UTF-8 without zero characters."""
    try:
        with system.open_input_stream(path, compression=None) as f:
            text = f.read().decode()
    except UnicodeDecodeError:
        return None, "not UTF-8"
    except OSError as e:
        return None, f"unreadable: {e}"
    return (None, "a zero character") if "\x00" in text else (text, None)


def tree(spark: SparkSession, folder: str, where: str | Column | None = None, content: bool = True) -> DataFrame:
    """The files (TREE) below a folder that meet a predicate, from a load of their own."""
    spark.dataSource.register(Tree)
    spark.conf.set(PUSHDOWN, "true")
    out = spark.read.format("source_tree").option("content", str(content).lower()).load(folder)
    return out if where is None else out.where(where)


def scan(spark: SparkSession, folder: str, max_julia_files: int | None = None, lenient: bool = True) -> DataFrame:
    """The files below a folder whose kind is known: Julia, Markdown, projects, manifests, and the tools' configurations.

    A file that can't be read, isn't UTF-8 or holds a zero character has a null content, or is an error where not lenient.
    With a cap, TooManyFiles is raised before any file is opened. A store that the listing doesn't reach is read by
    Spark's own reader.
    """
    scheme = folder.partition(":")[0] if ":" in folder else "file"
    known = scheme in SCHEMES
    if max_julia_files is not None:
        julia = tree(spark, folder, "kind = 'julia'", content=False) if known else _scan_by_spark(spark, folder).where("kind = 'julia'")
        if julia.select("path").limit(max_julia_files + 1).count() > max_julia_files:
            raise TooManyFiles(f"{folder} holds over {max_julia_files} Julia files")
    rows = tree(spark, folder) if known else _scan_by_spark(spark, folder)
    content = F.col("content")
    if not lenient:
        content = F.when(F.col("problem").isNull(), content).otherwise(F.raise_error(F.concat("path", F.lit(": "), "problem")).cast("string"))
    return rows.select("uri", "path", content.alias("content"), "language_id", F.lit(True).alias("is_regular"))


def _scan_by_spark(spark: SparkSession, folder: str) -> DataFrame:
    """(uri, path, kind, language_id, content, problem) by Spark's reader, which opens files before it drops those that aren't wanted, and passes over empty ones."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    skip = "/(" + "|".join(x.replace(".", "\\.") for x in SKIPPED) + ")/"
    rows = raw.select("path", paths.kind(F.col("path")).alias("kind"), F.col("content").cast("string").alias("text")).where(F.col("kind").isNotNull() & ~F.col("path").rlike(skip))
    problem = F.when(~F.is_valid_utf8("text"), "not UTF-8").when(F.contains("text", F.lit("\x00")), "a zero character")
    rows = rows.withColumn("problem", problem).withColumn("content", F.when(F.col("problem").isNull(), F.col("text")))
    return rows.select(F.col("path").alias("uri"), "path", "kind", paths.language(F.col("kind")).alias("language_id"), "content", "problem")


def read_one(spark: SparkSession, path: str) -> DataFrame:
    """One file, as a row. ValueError if its kind isn't known or its content isn't text; FileNotFoundError if it isn't there."""
    kind = paths.kind_of(path)
    if kind is None:
        raise ValueError(f"{path}: a file of unknown kind")
    system, own = filesystem(path)
    if system.get_file_info(own).type != pafs.FileType.File:
        raise FileNotFoundError(path)
    content, problem = read_text(system, own)
    if problem:
        raise ValueError(f"{path}: {problem}")
    return spark.createDataFrame([(paths.path_to_uri(own), own, content, paths.LANGUAGES[kind], True)], FILES)


def write_tree(files: DataFrame, folder: str) -> int:
    """Writes files (path below the folder, content) where they belong, each task its own, and gives their number. A null content is empty; a path that leads out of the folder is an error. Written again, a file is replaced."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = filesystem(folder)
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                below = posixpath.normpath("/" + (path or "").lstrip("/"))
                if ".." in (path or "").split("/") or below == "/":
                    raise ValueError(f"{path!r} isn't below the folder")
                system.create_dir(root + posixpath.dirname(below), recursive=True)
                with system.open_output_stream(root + below, compression=None) as f:
                    f.write((content.as_py() or "").encode())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    return files.select("path", "content").mapInArrow(run, "n long").agg(F.sum("n")).head()[0] or 0


def with_indirect(files: DataFrame, targets, load, rounds: int = 100) -> DataFrame:
    """files and what they lead to: targets(files) gives (path) wanted, load(paths) reads those that exist; repeated until nothing new is wanted. A path is asked for once."""
    asked: set[str] = set()
    out = fresh = files
    for _ in range(rounds):
        wanted = [r["path"] for r in targets(fresh).select("path").distinct().join(out.select("path"), "path", "left_anti").collect() if r["path"] not in asked]
        if not wanted:
            return out
        asked.update(wanted)
        fresh = load(wanted).withColumn("is_regular", F.lit(False))
        out = out.unionByName(fresh)
    raise RecursionError("files lead to more files without end")
