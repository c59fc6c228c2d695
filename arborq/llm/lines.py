"""Line dedup by levelled sorted runs of line hashes.

The index holds runs: tables of (h1, h2, n_docs), bucketed and sorted by the 128-bit hash of a line's key. A batch of
documents counts its lines, merge-anti-joins the runs one after another, which leaves out all keys whose fate is known,
takes over from the runs what they have counted so far, and becomes a run of level 0: the newest run that has a key has
its count over all batches. Once a level holds FANOUT runs, the next batch first merges them into one run of the next
level, so that a key is rewritten a number of times that grows with the logarithm of the number of batches. Runs are
bucketed alike and joined two at a time: no run is shuffled, and a batch only as its lines are counted. Everything here is
DataFrame operations; no Python runs on executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arborq.llm.common import ascii_lower, bucketed, drop, fresh, small, stored, table

#: Runs of a level that are merged into one of the next.
FANOUT = 2
#: Batches in which the query feeds the index.
BATCHES = 4
#: What is stripped at both ends of a line: blank and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def _hashes(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("second"), key).alias("h2")]


class LineRuns:
    """A levelled index of line hashes; ``n_docs`` counts the documents that hold a key, over all batches up to its run's.

    ``settled``: from this count on a key's fate is known, and later batches leave it out of their runs.
    """

    def __init__(self, spark: SparkSession, settled: int, fanout: int = FANOUT):
        self.spark, self.settled, self.fanout = spark, settled, fanout
        self.levels: list[list[DataFrame]] = []

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def novel(self, keys: DataFrame, known: int = 1) -> DataFrame:
        """Keys (h1, h2, ...) that no run holds with a count of `known` or more: one merge anti join a run."""
        for run in self.runs():
            keys = keys.join(run.where(F.col("n_docs") >= known).hint("merge"), ["h1", "h2"], "left_anti")
        return keys

    def add(self, batch: DataFrame) -> None:
        """batch: (h1, h2, n_docs), a row for each key of new documents."""
        for level in range(len(self.levels)):
            if len(self.levels[level]) >= self.fanout:
                self._merge(level)
        batch = self.novel(batch, self.settled).withColumn("before", F.lit(0).cast("long"))
        for run in self.runs():
            so_far = run.select("h1", "h2", F.col("n_docs").alias("so_far")).hint("merge")
            batch = batch.join(so_far, ["h1", "h2"], "left").withColumn("before", F.greatest("before", "so_far")).drop("so_far")
        self._push(0, bucketed(batch.select("h1", "h2", (F.col("n_docs") + F.col("before")).alias("n_docs")), "line-run", ["h1", "h2"], "uncompressed", dealt=bool(self.levels)))

    def _push(self, level: int, run: DataFrame) -> None:
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(run)

    def _merge(self, level: int) -> None:
        old = self.levels[level]
        merged = old[0]
        for i, run in enumerate(old[1:]):
            both = merged.hint("merge").join(run.withColumnRenamed("n_docs", "other"), ["h1", "h2"], "full")
            new = bucketed(both.select("h1", "h2", F.greatest("n_docs", "other").alias("n_docs")), "line-run", ["h1", "h2"], "uncompressed", dealt=True)
            if i:
                drop(merged)
            merged = new
        self.levels[level] = []
        for run in old:
            drop(run)
        self._push(level + 1, merged)

    def held(self, least: int) -> DataFrame:
        """(h1, h2) of keys that `least` documents or more hold; least is at most `settled`."""
        found = [run.where(F.col("n_docs") >= least).select("h1", "h2") for run in self.runs()]
        out = found[0] if found else self.spark.createDataFrame([], "h1 long, h2 long")
        for more in found[1:]:
            out = out.join(more.hint("merge"), ["h1", "h2"], "left_anti").unionByName(more)
        return out

    def close(self) -> None:
        """Deletes the runs."""
        for run in self.runs():
            drop(run)
        self.levels = []


def _lines(text: str) -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)


def drop_common_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, batches: int = BATCHES, id_col: str = "doc_id", text_col: str = "text", copies_once: bool = False) -> DataFrame:
    """Drops every line whose key occurs in at least min_docs rows and has at least min_chars code points.

    Returns docs' own columns with the text rewritten, plus ``n_lines`` and ``n_dropped`` (replacing columns of those
    names). A null or empty text is one empty line and comes back as an empty text; a document that loses all lines
    keeps its row with an empty text. A line that a document repeats counts once for it. Rows that repeat, or share an
    id, count as documents of their own; with copies_once, all rows of one text (A-Z in either case) count as one. A null
    id is an id. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    docs = docs.drop("n_lines", "n_dropped")
    whole = F.coalesce(F.col(text_col), F.lit(""))
    mark = F.xxhash64(ascii_lower(whole) if copies_once else whole)
    lines_, gone, id_of, mark_of, own_mark = fresh(docs, "lines", "gone", "id_of", "mark_of", "mark")
    counted = "mark" if copies_once else "row"
    keys = stored(
        # all that holds for a document before its lines are dealt out, or it is computed for each line
        docs.select(F.monotonically_increasing_id().alias("row"), F.pmod(mark if copies_once else F.xxhash64(F.col(id_col)), F.lit(batches)).cast("int").alias("batch"), F.col(id_col).alias("id"), mark.alias("mark"), _lines(text_col).alias("lines"))
        .select("row", "batch", "id", "mark", F.posexplode("lines").alias("pos", "line"))
        .withColumn("key", line_key(F.col("line")))
        .where(F.char_length("key") >= min_chars)
        .select("row", "batch", "id", "mark", "pos", *_hashes(F.col("key"))),
        "line-keys",
        "batch",
        "uncompressed",  # hashes don't compress, and a codec's buffers would lie outside the heap
    )
    index = LineRuns(spark, min_docs)
    for b in range(batches):
        once = keys.where(F.col("batch") == b).groupBy(counted, "h1", "h2").agg(F.lit(1).alias("one"))
        index.add(once.groupBy("h1", "h2").agg(F.count("*").alias("n_docs")))
    # as a table of its own, so that a small one is broadcast by its size, and a hot key's rows can be dealt to many tasks
    common = small(index.held(min_docs), "common-lines")
    index.close()
    found = keys.join(common, ["h1", "h2"], "left_semi").groupBy(F.col("id").alias(id_of), F.col("mark").alias(mark_of)).agg(F.collect_set("pos").alias(gone))
    out = docs.withColumn(own_mark, mark).join(found, F.col(id_col).eqNullSafe(F.col(id_of)) & (F.col(own_mark) == F.col(mark_of)), "left")
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size(lines_) - 1), F.col(gone)), lambda i: F.get(lines_, i))
    out = out.withColumn(lines_, _lines(text_col))
    return out.select(
        *[F.when(F.col(gone).isNull(), F.coalesce(F.col(text_col), F.lit(""))).otherwise(F.array_join(left, "\n")).alias(text_col) if c == text_col else F.col(c) for c in docs.columns],
        F.size(lines_).cast("long").alias("n_lines"),
        F.when(F.col(gone).isNull(), 0).otherwise(F.size(gone)).cast("long").alias("n_dropped"),
    )


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_common_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


OP10_SQL = r"""
WITH l AS (
  SELECT doc_id, pos, line, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)
), common AS (SELECT key FROM l WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
m AS (SELECT l.*, c.key IS NOT NULL AS gone FROM l LEFT JOIN common c ON l.key = c.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
