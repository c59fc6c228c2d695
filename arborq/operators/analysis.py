"""Facts of source files as tables: what the parser finds, a row of arrays for each file, and child tables of these."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import _parse_datatype_string

from arborq.functions import paths
from arborq.operators import graph, relational
from arborq.parser.parser import Facts, pieces

TABLES = {
    "nodes": "node_id int, parent_id int, kind string, name string, start int, stop int",
    "items": "ord int, name string, qualifier array<string>, kind string, module array<string>, min_args int, max_args int, kws array<string>, kwsplat boolean, start int, name_start int",
    "imports": "ord int, keyword string, dots int, path array<string>, names array<string>, module array<string>, start int, called array<string>, starts array<int>",
    "exports": "name string, kind string, module array<string>, start int",
    "includes": "ordinal int, target string, guarded boolean, testitem int, module array<string>, start int",
    "calls": "callee string, min_args int, max_args int, kws array<string>, start int, stop int",
    "tests": "kind string, label string, start int",
    "scopes": "scope_id int, kind string, module array<string>, outward array<int>",
    "bindings": "scope_id int, name string, kind string, start int",
    "refs": "scope_id int, name string, start int, in_macro boolean",
    "members": "qualifier array<string>, name string, module array<string>, start int",
    "findings": "rule_id string, message string, start int, stop int",
}
FACTS = "uri string, " + ", ".join(f"{t} array<struct<{', '.join(c.replace(' ', ': ', 1) for c in cols.split(', '))}>>" for t, cols in TABLES.items()) + ", piece int"
#: Facts of a row of FACTS, with those of one more statement at most.
ROOM = 10_000


def facts(files: DataFrame) -> DataFrame:
    """files (uri, content) as FACTS: Python runs here alone, a file at a time. A null content has no facts.

    A file has a row for each ROOM of its facts, numbered by `piece` from 0, so that neither Python nor a row of Spark's
    holds all facts of a large file; `uris` has each file once.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(_parse_datatype_string(FACTS))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, n = [], 0
        for batch in batches:
            for uri, content in zip(batch.column("uri"), batch.column("content"), strict=True):
                for k, piece in enumerate(pieces(content.as_py(), ROOM)):
                    rows.append((uri.as_py(), piece, k))
                    n += piece.size()
                    if n >= ROOM or len(rows) >= 1000:
                        yield _batch(rows, schema)
                        rows, n = [], 0
        yield _batch(rows, schema)

    return files.select("uri", "content").mapInArrow(run, FACTS)


def _batch(rows: list[tuple[str, Facts, int]], schema: pa.Schema) -> pa.RecordBatch:
    columns = [pa.array([uri for uri, _, _ in rows], pa.string())]
    for t in TABLES:
        kind = schema.field(t).type
        own = kind.value_type
        offsets, every = [0], []
        for _, found, _ in rows:
            every += getattr(found, t)
            offsets.append(len(every))
        values = [pa.array(c, own.field(i).type) for i, c in enumerate(zip(*every, strict=True) if every else [()] * own.num_fields)]
        structs = pa.StructArray.from_arrays(values, fields=list(own))
        columns.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), structs, type=kind))
    return pa.RecordBatch.from_arrays([*columns, pa.array([k for _, _, k in rows], pa.int32())], schema=schema)


def uris(found: DataFrame) -> DataFrame:
    """(uri) of each file with facts."""
    return found.where("piece = 0").select("uri")


def child(found: DataFrame, name: str) -> DataFrame:
    """One of TABLES, with uri."""
    return found.select("uri", F.explode(name).alias("x")).select("uri", "x.*")


def inventory_hash(found: DataFrame) -> DataFrame:
    """(uri, hash) of what other files can see: no places and no bodies, so that an edit inside a body leaves it as it is.

    What is seen is hashed one by one, and the hashes in their order: of a file they are gathered, not what they are of.
    """

    def seen(table: str, k: int, at: str, *columns: str) -> Column:
        return F.transform(table, lambda x: F.struct(F.lit(k).alias("k"), x[at].alias("at"), F.unhex(F.sha2(F.to_json(F.struct(*[x[c].alias(c) for c in columns])), 256)).alias("h")))

    every = F.concat(
        seen("items", 0, "ord", "name", "qualifier", "kind", "module", "min_args", "max_args", "kws", "kwsplat"),
        seen("imports", 1, "ord", "keyword", "dots", "path", "names", "called", "module"),
        seen("exports", 2, "start", "name", "kind", "module"),
        seen("includes", 3, "ordinal", "target", "guarded", "module"),
    )
    got = found.groupBy("uri").agg(F.flatten(F.collect_list(every)).alias("s"))
    return got.select("uri", F.sha2(F.array_join(F.transform(F.array_sort("s"), lambda x: F.concat(x["k"].cast("string"), F.hex(x["h"]))), ","), 256).alias("hash"))


def include_records(found: DataFrame) -> DataFrame:
    """(src, ordinal, target, guarded, testitem): targets resolved against the folder of the file."""
    rows = child(found, "includes")
    base = paths.dirname(F.col("uri"))
    full = F.when(F.col("target").startswith("/"), F.col("target")).otherwise(F.concat(base, F.lit("/"), F.col("target")))
    full = F.when(F.col("target").isNotNull(), paths.normalised(full))
    return rows.select(F.col("uri").alias("src"), "ordinal", full.alias("target"), "guarded", "testitem", "module")


SPLICED = "root string, file string, path array<string>, at array<int>"


def module_files(records: DataFrame, files: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, file, path, at): the module path that each file of a root's tree is first spliced at, outer modules first, and its place in the order of splicing.

    Includes are in-place, so the walk is depth-first in source order; a file that was met before isn't entered again.
    Includes in bodies of test items are left out. Only the part of the graph below a root goes to that root's task.
    """
    there = files.select(F.col("uri").alias("target"))
    edges = records.where("target is not null and testitem is null").select("src", "ordinal", "target", "module").join(there, "target", "left_semi")
    below = graph.closure(roots.select(F.col("node").alias("src")), edges.select("src", F.col("target").alias("dst"))).select(F.col("src").alias("root"), F.col("dst").alias("src"))
    rows = below.join(edges, "src").select("root", "src", "ordinal", "target", "module")
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    walked = rows.repartition(n, "root").sortWithinPartitions("root", "src", "ordinal", "target").mapInArrow(_splices, SPLICED)
    own = roots.select(F.col("node").alias("root"), F.col("node").alias("file"), F.array().cast("array<string>").alias("path"), F.array(F.lit(0)).alias("at"))
    return graph.stored(own.unionByName(walked))


def _splices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by root, and by ordinal in a file; those of one root are held at a time."""
    types = (pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.int32()))
    names = [x.split()[0] for x in SPLICED.split(", ")]

    def batch_of(out: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=names)

    root, by_file = None, {}
    for batch in batches:
        out: list[tuple] = []
        for r, src, ordinal, target, module in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if r != root and by_file:
                out += _spliced(root, by_file)
                by_file = {}
            root = r
            by_file.setdefault(src, []).append((ordinal, target, module))
        yield batch_of(out)
    yield batch_of(_spliced(root, by_file) if by_file else [])


def _spliced(root: str, by_file: dict[str, list[tuple]]) -> list[tuple]:
    out, met = [], {root}
    stack = [(iter(by_file.get(root, ())), [], [0])]
    while stack:
        left, path, at = stack[-1]
        for ordinal, target, module in left:
            if target not in met:
                met.add(target)
                own = (path + module, [*at, ordinal])
                out.append((root, target, *own))
                stack.append((iter(by_file.get(target, ())), *own))
                break
        else:
            stack.pop()
    return out


def splices(found: DataFrame) -> DataFrame:
    """`module_files` of all files with facts, from the roots among them; files of a cycle without a root are roots themselves."""
    records = include_records(found)
    nodes = uris(found).select(F.col("uri").alias("node"))
    edges = records.where("target is not null").select("src", F.col("target").alias("dst"))
    roots = graph.roots(nodes, edges)
    out = module_files(records, uris(found), roots)
    lost = nodes.join(out.select(F.col("file").alias("node")), "node", "left_anti")
    return out.unionByName(lost.select(F.col("node").alias("root"), F.col("node").alias("file"), F.array().cast("array<string>").alias("path"), F.array(F.lit(0)).alias("at")))


def declarations(found: DataFrame, spliced: DataFrame) -> DataFrame:
    """Items of all files with the module they are in under a root: (root, path, name, kind, uri, ord, at)."""
    rows = child(found, "items").join(spliced.withColumnRenamed("file", "uri").withColumnRenamed("path", "base"), "uri")
    return rows.select("root", F.concat("base", "module").alias("path"), "name", "qualifier", "kind", "min_args", "max_args", "kws", "kwsplat", "uri", "ord", "start", "name_start", F.concat("at", F.array("ord")).alias("at"))


def test_ids(found: DataFrame) -> DataFrame:
    """(uri, label, id): labels that a file has more than once are numbered, each of them."""
    own = Window.partitionBy("uri", "label")
    n, k = F.count("*").over(own), F.row_number().over(own.orderBy("start"))
    rows = child(found, "tests").where("kind = 'testitem' and label is not null")
    return rows.select("uri", "label", "start", F.when(n > 1, F.concat("label", F.lit("#"), k.cast("string"))).otherwise(F.col("label")).alias("id"), (n > 1).alias("duplicate"))


def document_symbols(found: DataFrame, kinds: tuple[str, ...] = ("module", "baremodule", "function", "macro", "mutable_struct", "struct", "abstract", "primitive", "testitem")) -> DataFrame:
    """(uri, node_id, parent, name, kind, start, stop): the outline as parent and child rows, with the nearest listed parent."""
    listed = child(found, "nodes").where(F.col("kind").isin(*kinds)).select("uri", "node_id", "name", "kind", "start", "stop")
    above = listed.select("uri", F.col("node_id").alias("above_id"), F.col("start").alias("above_start"), F.col("stop").alias("above_stop"))
    around = relational.contained(listed.select("uri", "node_id", "start", "stop"), above, ["uri"], "start", "above_start", "above_stop").where("above_start < start AND stop <= above_stop")
    nearest = around.groupBy("uri", "node_id").agg(F.max_by("above_id", "above_start").alias("parent"))
    return listed.join(nearest, ["uri", "node_id"], "left")


def module_at(found: DataFrame, points: DataFrame) -> DataFrame:
    """points (uri, offset) with the dotted name of the module around each."""
    nodes = child(found, "nodes").where(F.col("kind").isin("module", "baremodule"))
    around = relational.contained(points, nodes, ["uri"], "offset", "start", "stop")
    named = around.groupBy("uri", "offset").agg(F.array_sort(F.collect_list(F.struct("start", "name"))).alias("m"))
    return points.join(named, ["uri", "offset"], "left").select("uri", "offset", F.coalesce(F.array_join("m.name", "."), F.lit("")).alias("module"))


def workspace_symbols(found: DataFrame, query: str) -> DataFrame:
    c: Column = F.col("name")
    items = child(found, "items").where(c.isNotNull())
    match = c.startswith(query) | F.regexp_replace(c, "^@", "").startswith(query) if query else F.lit(True)
    return items.where(match).select("uri", "name", "kind", "start")
