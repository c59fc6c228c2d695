"""Places in texts: 1-based lines and columns, counted in bytes of UTF-8, with LF, CRLF and lone CR as line breaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Cuts a text after each of its line breaks.
BREAK = "(?<=\n)|(?<=\r)(?!\n)"


def line_starts(text: Column) -> Column:
    """1-based byte offsets at which lines start, ascending. For texts of very many lines `line_table` is the better way: this copies the array for each."""
    sizes = F.transform(F.split(text, BREAK, -1), lambda x: F.octet_length(x))
    starts = F.aggregate(sizes, F.array(F.lit(1)), lambda acc, n: F.array_append(acc, F.element_at(acc, -1) + n))
    return F.slice(starts, 1, F.size(starts) - 1)


def line_table(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line_no, start, n_bytes without the break): a row for each line, 1-based."""
    lines = df.select(key, F.posexplode(F.split(text, BREAK, -1)).alias("i", "line"))
    before = Window.partitionBy(key).orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    size = F.octet_length("line")
    start = 1 + F.coalesce(F.sum(size.cast("long")).over(before), F.lit(0))
    return lines.select(key, (F.col("i") + 1).cast("long").alias("line_no"), start.alias("start"), F.octet_length(F.regexp_replace("line", "[\r\n]+$", "")).cast("long").alias("n_bytes"))


def line_at(starts: Column, offset: Column) -> Column:
    """The 1-based line of a 1-based byte offset."""
    return F.size(F.filter(starts, lambda s: s <= offset))


def column_at(starts: Column, offset: Column) -> Column:
    return offset - F.element_at(starts, line_at(starts, offset)) + 1
