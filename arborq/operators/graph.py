"""Reachability in include graphs: edges (src, dst)."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Tables written so far and not yet released, in this Python process.
_written: list[str] = []
#: Names of those in buckets.
_named: list[str] = []


def release(spark: SparkSession) -> None:
    """Deletes the tables that `stored` has written: for when all results that read them have been written themselves."""
    jvm = spark.sparkContext._jvm
    while _named:
        spark.sql(f"DROP TABLE IF EXISTS {_named.pop()}")
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own in the one that driver and executors share, for `release` to delete."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    _written.append(path)
    return path


def stored(df: DataFrame) -> DataFrame:
    """Cuts lineage by a table in the folder that driver and executors share."""
    spark = df.sparkSession
    path = new_folder(spark, "graph")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, *keys: str) -> DataFrame:
    """`stored` as a table in buckets by keys, as many as a shuffle has partitions: sums by the keys, and joins by all of them, move only what they are joined with. df is to be dealt by the keys already, as a sum by them is, or each task writes to all buckets."""
    spark = df.sparkSession
    path = new_folder(spark, "graph")
    name = path.rpartition("/")[2].replace("-", "_")
    _named.append(name)
    df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).option("path", path).saveAsTable(name)
    return spark.table(name)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Unset it is one of our own, on a local master only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (base or "/tmp/checkpoints/arborq").rstrip("/")


class Seen:
    """Rows gathered round by round: a union of stored tables, merged, put together into one whenever there are MOST."""

    MOST = 8

    def __init__(self, first: DataFrame, merge=lambda df: df):
        self.tables, self.merge = [first], merge

    def add(self, more: DataFrame) -> None:
        self.tables.append(more)
        if len(self.tables) >= self.MOST:
            self.tables = [stored(self.all())]

    def all(self) -> DataFrame:
        out = self.tables[0]
        for t in self.tables[1:]:
            out = out.unionByName(t)
        return self.merge(out) if len(self.tables) > 1 else out


def unseen(step: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """step's rows whose keys seen doesn't have. By an outer join: Spark pushes an anti join down below the join that made step, onto all edges."""
    return step.join(seen.select(*keys, F.lit(True).alias("__seen")), keys, "left").where("__seen is null").drop("__seen")


def _steps(edges: DataFrame, src: str, dst: str) -> DataFrame:
    """Stored once, for every round reads them."""
    return stored(edges.where("src is not null and dst is not null").select(F.col("src").alias(src), F.col("dst").alias(dst)).distinct())


def closure(starts: DataFrame, edges: DataFrame) -> DataFrame:
    """(src, dst) for each of starts (column src) and all it reaches, itself too: as many rows as there are such pairs. Cycles end: a pair is followed once."""
    edges = _steps(edges, "mid", "next")
    frontier = stored(starts.select("src", F.col("src").alias("dst")).distinct())
    seen = Seen(frontier)
    while not frontier.isEmpty():
        step = frontier.join(edges, F.col("dst") == F.col("mid")).select("src", F.col("next").alias("dst")).distinct()
        frontier = stored(step.join(seen.all(), ["src", "dst"], "left_anti"))
        seen.add(frontier)
    return seen.all()


def reachable(starts: DataFrame, edges: DataFrame) -> DataFrame:
    """The nodes (column node) that any of starts (column node) reaches, themselves too: a set, without pairs."""
    return reachable_by(starts, _steps(edges, "node", "next"))


def reachable_by(starts: DataFrame, steps: DataFrame) -> DataFrame:
    """`reachable` by steps (node, next) that are stored already, best in buckets by node."""
    frontier = stored(starts.select("node").distinct())
    seen = Seen(frontier)
    while not frontier.isEmpty():
        frontier = stored(unseen(frontier.join(steps, "node").select(F.col("next").alias("node")).distinct(), seen.all(), ["node"]))
        seen.add(frontier)
    return seen.all()


def roots(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes (column node) that no edge leads to; a pure cycle has none, and an edge to itself counts."""
    return nodes.select("node").join(edges.select(F.col("dst").alias("node")), "node", "left_anti")


def reversed_edges(edges: DataFrame) -> DataFrame:
    return edges.where("dst is not null").select(F.col("dst").alias("src"), F.col("src").alias("dst")).distinct()


def roots_of(nodes: DataFrame, edges: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """(node, root) for each of starts (all nodes, if not given) and the roots above it. For all nodes the walk goes down from the roots, so that no pair is made but those asked for."""
    top = roots(nodes, edges).distinct()
    if starts is None:
        return closure(top.select(F.col("node").alias("src")), edges).select(F.col("dst").alias("node"), F.col("src").alias("root"))
    up = closure(starts.select(F.col("node").alias("src")), reversed_edges(edges))
    return up.join(top.select(F.col("node").alias("dst")), "dst").select(F.col("src").alias("node"), F.col("dst").alias("root"))


def least_label(labelled: DataFrame, edges: DataFrame, greatest: bool = False) -> DataFrame:
    """(node, label): the least label (or the greatest) of those that reach each node: labelled (node, label) passed on along edges, one label a node.

    Each round passes on the labels that got better in the round before; nodes that nothing labelled reaches have no row.
    """
    pick = F.max if greatest else F.min
    edges = _steps(edges, "node", "next")
    fresh = stored(labelled.groupBy("node").agg(pick("label").alias("label")))
    seen = Seen(fresh, lambda df: df.groupBy("node").agg(pick("label").alias("label")))
    while not fresh.isEmpty():
        new = fresh.join(edges, "node").groupBy(F.col("next").alias("node")).agg(pick("label").alias("new"))
        better = F.col("new") > F.col("label") if greatest else F.col("new") < F.col("label")
        fresh = stored(new.join(seen.all(), "node", "left").where(F.col("label").isNull() | better).select("node", F.col("new").alias("label")))
        seen.add(fresh)
    return seen.all()


def best_root_of(nodes: DataFrame, edges: DataFrame, is_test) -> DataFrame:
    """(node, root): of the roots above each node one outside tests if there is any, then the least; is_test is of a column `root`. By least labels, so without a pair of node and root."""
    top = roots(nodes, edges).distinct().withColumnRenamed("node", "root")
    labelled = top.select(F.col("root").alias("node"), F.struct(is_test.alias("test"), F.col("root")).alias("label"))
    return least_label(labelled, edges).select("node", F.col("label.root").alias("root"))


def best_root(rooted: DataFrame, is_test) -> DataFrame:
    """(node, root): `best_root_of`, of pairs that are there already."""
    return rooted.groupBy("node").agg(F.min(F.struct(is_test.alias("test"), F.col("root"))).alias("best")).select("node", F.col("best.root").alias("root"))


def trimmed(edges: DataFrame) -> DataFrame:
    """Edges (src, dst) less those of nodes without an edge in or out, which are on no cycle; again as long as that takes half of them away."""
    left, n = edges, edges.count()
    while True:
        ins, outs = left.select(F.col("dst").alias("src")).distinct(), left.select(F.col("src").alias("dst")).distinct()
        left = stored(left.join(ins, "src", "left_semi").join(outs, "dst", "left_semi").select("src", "dst"))
        before, n = n, left.count()
        if 2 * n > before or not n:
            return left


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes of strongly connected components of two nodes or more; component is the greatest node of it.

    What can't be on a cycle is trimmed. Then colours: each node takes the greatest node that reaches it; the nodes that
    reach the namesake of their colour within the colour are its component. Components, and edges that lead from one colour
    to another, go, and the rest is coloured anew. One label a node in every round.
    """
    left = trimmed(_steps(edges, "src", "dst").where("src <> dst"))
    found = None
    while not left.isEmpty():
        nodes = left.select(F.col("src").alias("node")).unionByName(left.select(F.col("dst").alias("node"))).distinct()
        colours = stored(least_label(nodes.withColumn("label", F.col("node")), left, greatest=True))
        a, b = colours.select(F.col("node").alias("src"), F.col("label").alias("src_colour")), colours.select(F.col("node").alias("dst"), F.col("label").alias("dst_colour"))
        within = stored(left.join(a, "src").join(b, "dst").where("src_colour = dst_colour").select("src", "dst"))
        back = least_label(colours.where("node = label"), reversed_edges(within), greatest=True)
        own = stored(back.select("node", F.col("label").alias("component")))
        sized = own.groupBy("component").agg(F.count("*").alias("n")).where("n > 1").select("component")
        more = stored(own.join(sized, "component", "left_semi").select("node", "component"))
        found = Seen(more) if found is None else found
        if found.tables[-1] is not more:
            found.add(more)
        left = trimmed(within.join(own.select(F.col("node").alias("src")), "src", "left_anti").join(own.select(F.col("node").alias("dst")), "dst", "left_anti").select("src", "dst"))
    kind = edges.schema["src"].dataType.simpleString()
    return edges.sparkSession.createDataFrame([], f"node {kind}, component {kind}") if found is None else found.all()


def on_cycle(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that reach themselves by an edge at least: those of components, and those with an edge to themselves."""
    own = edges.where("src = dst").select(F.col("src").alias("node"))
    return nodes.select("node").distinct().join(components(edges).select("node").unionByName(own), "node", "left_semi")


INCLUDE_FINDINGS = "root string, src string, ordinal int, target string, code string"


def include_findings(records: DataFrame, contents: DataFrame, root_nodes: DataFrame) -> DataFrame:
    """Findings of includes, as by a depth-first walk in source order from each root.

    records: (src, ordinal, target (null: computed), guarded, testitem (null outside test bodies)); contents: (node), the
    files there are. A computed or missing target is reported unless guarded; a target on the way down is a loop, guarded
    or not; one that was met before is a duplicate, unless this include or every earlier one was guarded, which pardons it
    once. A test body has its own set of what it met.

    What is computed or missing is told by joins for every file that a root reaches. Records are stored once, in buckets by
    the file that includes; pairs of a root and a file below are made for files that include something. Only roots below
    which some file is included twice, or the root itself is, can have loops and duplicates: these alone are walked, each
    in one task.
    """
    there = contents.select(F.col("node").alias("target"), F.lit(True).alias("there"))
    including = records.select(F.col("src").alias("target")).distinct().withColumn("includes", F.lit(True))
    rows = records.join(there.join(including, "target", "left"), "target", "left")
    rows = bucketed(rows.repartition("src"), "src")
    # files that include nothing end a walk, and have no record to find: pairs are made for the others alone
    inner = rows.where("there AND includes").select("src", F.col("target").alias("dst"))
    below = closure(root_nodes.select(F.col("node").alias("src")), inner)
    plain = rows.where("NOT coalesce(guarded, false) AND there is null").join(below.select(F.col("dst").alias("src")).distinct(), "src", "left_semi")
    told = plain.select("src", "ordinal", "target", F.when(F.col("target").isNull(), "ComputedInclude").otherwise("MissingFile").alias("code"))
    met = below.select(F.col("src").alias("root"), F.col("dst").alias("src")).join(rows.where("there"), "src")
    again = stored(met.groupBy("root", "target").agg(F.count("*").alias("n")).where("n > 1 OR target = root").select("root").distinct())
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    columns = ["root", "src", "ordinal", "target", "guarded", "testitem", "there"]
    dealt = met.join(again, "root", "left_semi").select(*columns).repartition(n, "root").sortWithinPartitions("root", "src", "ordinal", "target")
    walked = dealt.mapInArrow(_walks, INCLUDE_FINDINGS).drop("root")
    return told.unionByName(walked).dropDuplicates(["src", "ordinal", "code"])


def _walks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by root; those of one root are held at a time."""
    root, rows = None, []
    names = [x.split()[0] for x in INCLUDE_FINDINGS.split(", ")]
    types = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.string()]

    def batch_of(out: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], names=names)

    out: list = []
    for batch in batches:
        for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if r[0] != root and rows:
                out += _walk(root, rows)
                rows = []
            root = r[0]
            rows.append(r)
        if len(out) > 10_000:
            yield batch_of(out)
            out = []
    if rows:
        out += _walk(root, rows)
    yield batch_of(out)


def _walk(root: str, rows: list) -> list[tuple]:
    by_file: dict[str, list] = {}
    for _, src, ordinal, target, guarded, body, _ in rows:
        by_file.setdefault(src, []).append((ordinal, target, bool(guarded), body))
    out = []
    seen: dict = {None: {root: False}}  # test body or None -> target -> whether every include so far was guarded
    stack = [(root, iter(by_file.get(root, ())), None)]
    on_way = {root}
    while stack:
        src, left, context = stack[-1]
        for ordinal, target, guarded, body in left:
            own = context or ((src, body) if body is not None else None)
            if target in on_way:
                code = "IncludeLoop"
            elif target in (met := seen.setdefault(own, {})):
                pardoned = guarded or met[target]
                code = None if pardoned else "DuplicateInclude"
                if met[target] and not guarded:
                    met[target] = False  # the pardon is spent
            else:
                met[target] = guarded
                stack.append((target, iter(by_file.get(target, ())), own))
                on_way.add(target)
                break
            if code:
                out.append((root, src, ordinal, target, code))
        else:
            stack.pop()
            on_way.discard(src)
    return out
