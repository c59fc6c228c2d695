"""Helpers that the operators of this package share: tables, the shared folder, Arrow batches."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows are handed on to numpy in slices of about this many bytes of text.
SLICE_BYTES = 8_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or one of our own where it is unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = "/tmp/checkpoints/arborq"
        if not spark.sparkContext.getCheckpointDir():
            spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


#: Tables written so far and not yet released, in this Python process.
_written: list[str] = []


def release(spark: SparkSession) -> None:
    """Deletes the tables that `stored` has written: for when all results that read them have been written themselves."""
    while _written:
        path = _written.pop()
        called = path.rpartition("/")[2].replace("-", "_")
        if _paths.pop(called, None):
            spark.sql(f"DROP TABLE IF EXISTS {called}")
        remove(spark, path)


def stored(df: DataFrame, name: str, partition_by: str | None = None, compression: str = "zstd") -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts lineage, and survives lost executors."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    _written.append(path)
    writer = df.write.mode("overwrite").option("compression", compression)
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Where the files of tables by `bucketed` lie, by name.
_paths: dict[str, str] = {}


def bucketed(df: DataFrame, name: str, keys: list[str], compression: str = "zstd", dealt: bool = False) -> DataFrame:
    """`stored` as a table bucketed and sorted by keys, in as many buckets as a shuffle has partitions: joins and sums by these keys move only what they are joined with. dealt: df comes from a join of such tables, a bucket to a task."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    called = path.rpartition("/")[2].replace("-", "_")
    _written.append(path)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    (df if dealt else df.repartition(n, *keys)).write.bucketBy(n, *keys).sortBy(*keys).option("path", path).option("compression", compression).saveAsTable(called)
    _paths[called] = path
    out = spark.table(called)
    out._stored_as = called
    return out


def drop(table_: DataFrame) -> None:
    """Deletes a table that `bucketed` has written."""
    called = table_._stored_as
    table_.sparkSession.sql(f"DROP TABLE IF EXISTS {called}")
    remove(table_.sparkSession, _paths[called])
    _written.remove(_paths.pop(called))


def small(df: DataFrame, name: str, spread: bool = False) -> DataFrame:
    """`stored`, for tables of a few numbers a document: in an eighth as many files as a shuffle has partitions, and without a codec, for they hold hashes and ids. spread: the last step is a long one, and goes on in all its tasks before their few rows are put together."""
    files = max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 8)
    return stored(df.repartition(files) if spread else df.coalesce(files), name, compression="uncompressed")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names, made longer where df has a column of that name."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def slices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that a slice has about SLICE_BYTES of the column, or one row."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        start = size = 0
        for i, n in enumerate(sizes):
            if size and size + n > SLICE_BYTES:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n
        if start < batch.num_rows:
            yield batch.slice(start)


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    return [x or "" for x in batch.column(column).to_pylist()]


def ascii_lower(c):
    """Lower-cases A-Z only. ``lower`` does just that where every character takes one byte."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, upper, upper.lower()))
