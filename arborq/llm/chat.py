"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: the context is all turns before it, and only its own text is
trainable. Written out, the examples of a conversation of n turns hold about n * n / 4 turns. So a conversation's
formatted text is stored once, a segment to a turn with its place in the whole, and an example is a pair of spans in it:
``[0, example_end)`` is its text, ``[loss_start, loss_end)`` its loss mask. ``materialise`` writes examples out.

Offsets come from a prefix sum in two steps over ranges of (conversation, turn), so that a conversation with a third of
all turns is dealt to many tasks.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arborq.llm.common import stored, table

#: The template: what stands before a role, between role and text, and after a text.
START, MIDDLE, END = "<|turn|>", "<|says|>", "<|end|>\n"
#: Texts hold no "<" or "[" once escaped, and so no control string of this or another template that begins with one.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&#91;"))
SEGMENT = re.compile(re.escape(START) + "(.*?)" + re.escape(MIDDLE) + "(.*)" + re.escape(END), re.DOTALL)
TARGET = "assistant"
#: Code points of a role, and of a text, that tell its range among rows of one turn.
PREFIX = 32


def escaped(c: Column) -> Column:
    for plain, code in ESCAPES:
        c = F.replace(c, F.lit(plain), F.lit(code))
    return c


def unescape(text: str) -> str:
    for plain, code in reversed(ESCAPES):
        text = text.replace(code, plain)
    return text


def format_turns(turns: DataFrame, ranges: int | None = None) -> DataFrame:
    """turns: (conv_id, turn, role, text); other columns are left out. One row for each turn:

    conv_id, turn, seq (0-based place, an order of rows of equal turns by role and text), segment (formatted text),
    start, end (its place in the conversation's formatted text, in code points), is_target, and for targets example_end,
    loss_start and loss_end (null otherwise). A null role or text is empty. Rows with a null conv_id form one
    conversation; null turns come first; repeated rows are turns of their own. An empty table gives an empty result.
    """
    spark = turns.sparkSession
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    head = F.concat(F.lit(START), escaped(role), F.lit(MIDDLE))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    rows = rows.withColumns({"segment": F.concat(head, escaped(F.col("text")), F.lit(END)), "head": F.char_length(head)})
    order = ["turn", "role", "text"]
    # ranges are told by short keys, for samples of them go to the driver; what shares a beginning lies in one range
    long = F.char_length("role") > PREFIX
    keys = [F.left("role", F.lit(PREFIX)), long, F.when(~long, F.left("text", F.lit(PREFIX)))]
    rows = stored(rows.repartitionByRange(n, "conv_id", "turn", *keys).sortWithinPartitions("conv_id", *order).withColumn("part", F.spark_partition_id()), "turns")
    rows = rows.withColumn("n_chars", F.char_length("segment"))
    parts = rows.groupBy("conv_id", "part").agg(F.sum("n_chars").alias("chars"), F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.select("conv_id", "part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"base_{c}") for c in ("chars", "n")])
    own = Window.partitionBy("conv_id", "part").orderBy(*order)
    rows = rows.withColumns({"own_end": F.sum("n_chars").over(own.rowsBetween(Window.unboundedPreceding, 0)), "own_n": F.row_number().over(own)}).alias("r")
    base = base.alias("b")
    rows = rows.join(base, F.col("r.conv_id").eqNullSafe(F.col("b.conv_id")) & (F.col("r.part") == F.col("b.part")))
    end = F.col("base_chars") + F.col("own_end")
    target = F.col("role") == TARGET
    start = end - F.col("n_chars")
    return rows.select(
        "r.conv_id", "turn", (F.col("base_n") + F.col("own_n") - 1).alias("seq"), "segment", start.alias("start"), end.alias("end"), target.alias("is_target"),
        F.when(target, end).alias("example_end"), F.when(target, start + F.col("head")).alias("loss_start"), F.when(target, end - len(END)).alias("loss_end"),
    )


def examples(formatted: DataFrame) -> DataFrame:
    """(conv_id, target_seq, context_end, example_end, loss_start, loss_end): one row for each assistant turn."""
    return formatted.where("is_target").select("conv_id", F.col("seq").alias("target_seq"), F.col("start").alias("context_end"), "example_end", "loss_start", "loss_end")


def materialise(formatted: DataFrame) -> DataFrame:
    """Writes examples out: (conv_id, target_seq, example, loss_start, loss_end). The text is as long as all prefixes together."""
    e, f = examples(formatted).alias("e"), formatted.alias("f")
    pairs = e.join(f, F.col("e.conv_id").eqNullSafe(F.col("f.conv_id")) & (F.col("f.seq") <= F.col("e.target_seq")))
    parts = F.array_sort(F.collect_list(F.struct("f.seq", "f.segment")))
    out = pairs.groupBy("e.conv_id", "target_seq", "e.loss_start", "e.loss_end").agg(parts.alias("parts"))
    return out.select("conv_id", "target_seq", F.array_join(F.col("parts.segment"), "").alias("example"), "loss_start", "loss_end")


def read_back(formatted: DataFrame, made: DataFrame) -> DataFrame:
    """Columns of READ_BACK, a row for each conversation: all turns from the segments of `formatted`, and what is trainable from the rows of `made`, the examples.

    The digests run over a conversation's turns in order, so that one task goes through all of them; it holds no more than
    sums and running hashes.
    """
    spans = made.select(F.col("conv_id").alias("of"), F.col("target_seq"), "example_end", "loss_start", "loss_end")
    rows = formatted.select("conv_id", "seq", "segment", "start").join(spans, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("seq") == F.col("target_seq")), "left")
    return rows.drop("of", "target_seq").repartition("conv_id").sortWithinPartitions("conv_id", "seq").mapInArrow(_read_back, READ_BACK)


READ_BACK = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_examples long, example_chars long"


def _read_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (conv_id, seq). Only sums and running hashes of one conversation are held at a time."""
    state, key = None, object()
    done: list[tuple] = []

    def close() -> None:
        if state:
            done.append((key, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), *state[4:]))

    for batch in batches:
        for conv, segment, start, end, loss_start, loss_end in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "segment", "start", "example_end", "loss_start", "loss_end")), strict=True):
            if conv != key or state is None:
                close()
                key, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0, 0]
            role, text = map(unescape, SEGMENT.fullmatch(segment).groups())
            state[0] += 1
            state[1].update(f"{role}\n{text}\n".encode())
            if end is not None:
                loss = unescape(segment[loss_start - start : loss_end - start])
                state[2] += len(loss)
                state[3].update(loss.encode())
                state[5] += 1
                state[6] += end
            state[4] += len(segment)
        if len(done) > 10_000:
            yield _rows(done)
            done = []
    close()
    yield _rows(done)


def _rows(done: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
    columns = list(zip(*done, strict=True)) or [[]] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[x.split()[0] for x in READ_BACK.split(", ")])


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.createDataFrame([(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, TARGET, "</s>[INST] ok [/INST]")], turns.schema)
    formatted = stored(format_turns(turns.unionByName(planted)), "segments")
    return read_back(formatted, stored(examples(formatted), "examples"))


_CODE = "replace(replace(replace(coalesce({}, ''), '&', '&amp;'), '<', '&lt;'), '[', '&#91;')"
OP1_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), f AS (SELECT *, length({_CODE.format("role")}) + length({_CODE.format("text")}) + {len(START + MIDDLE + END)} AS n FROM t),
e AS (SELECT *, sum(n) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS upto FROM f)
SELECT conv_id::BIGINT AS conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(n)::BIGINT AS formatted_chars, count(*) FILTER (role = 'assistant')::BIGINT AS n_examples, coalesce(sum(upto) FILTER (role = 'assistant'), 0)::BIGINT AS example_chars
FROM e GROUP BY conv_id
"""
