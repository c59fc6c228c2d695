"""Conversation structure repair: the cheapest edits that bring a conversation to the grammar ``(s?(ua)+)?`` of role initials.

The search is a dynamic program over the grammar's states. Rows are dealt to hash partitions by segments of at most 256
rows of a conversation; in a partition a recursive DuckDB query goes through a batch of segments, each recursion one turn
on for all of them, and keeps the least cost and audit for each grammar state. A segment that begins a conversation starts
before the first row, any other in each of the states. Segments of a conversation are then put together by the same
recursion, a segment at a time and in levels of 256, so that a conversation with a third of all rows is searched in as many
tasks as its length calls for.

Least audits can be kept by prefix: of two ways of equal cost through the same rows to the same state neither audit begins
with the other, since the longer one would have more insertions and so cost more.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arborq.llm.common import stored, table

#: Grammar states: before the first row, nothing said, after s, after u, after a.
BEFORE, NOTHING, SYSTEM, USER, ASSISTANT = -1, 0, 1, 2, 3
STATES, FINAL = (NOTHING, SYSTEM, USER, ASSISTANT), (NOTHING, ASSISTANT)
SAID = {(NOTHING, "s"): SYSTEM, (NOTHING, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
#: Costs of edits, and of a truncated row that isn't deleted.
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
LEGAL = ("su", "ua", "au")
#: The contract's blanks and ends of sentences.
BLANKS, ENDS = " \t\n\x0b\x0c\r", ".!?"
#: Rows of a segment, as a power of two; rows of a batch.
SHIFT, BATCH_ROWS = 8, 50_000
#: Memory of the DuckDB of a task, which writes nothing to disk.
MEMORY = "512MB"


def _inserted() -> dict[int, list[tuple[int, int, str]]]:
    """state -> (state after, cost, audit) by insertions alone."""
    out = {}
    for state in STATES:
        out[state], at = [(state, 0, "")], state
        while (at := SAID.get((at, "u")) or SAID.get((at, "a"))) not in [x[0] for x in out[state]]:
            out[state].append((at, out[state][-1][1] + INSERT, out[state][-1][2] + "I"))
    out[BEFORE] = out[NOTHING]
    return out


def transitions() -> list[tuple[str, int, int, int, str]]:
    """(kind of row, state, state after, cost, audit): the cheapest ways through a row and insertions after it, of equally cheap ones the least audit. Kinds: d (must go), or the initial s, u, a or o (any other), with t for a truncated row."""
    inserted, out = _inserted(), []
    for kind in ["d", *[r + t for r in "suao" for t in ("", "t")]]:
        for state in (BEFORE, *STATES):
            best: dict[int, tuple[int, str]] = {}
            for at, c0, a0 in inserted[state] if state == BEFORE else [(state, 0, "")]:
                ways = [(at, DELETE, "D")]
                if kind != "d":
                    extra = TRUNCATED if kind.endswith("t") else 0
                    ways += [(SAID[at, kind[0]], extra, "K")] if (at, kind[0]) in SAID else []
                    ways += [(SAID[at, role], REROLE + extra, "R") for role in "ua" if (at, role) in SAID]
                for to, c1, a1 in ways:
                    for end, c2, a2 in inserted[to]:
                        best[end] = min(best.get(end, (1 << 60, "")), (c0 + c1 + c2, a0 + a1 + a2))
            out += [(kind, state, end, *way) for end, way in best.items()]
    return out


# --- rows and their faults


class Repaired(NamedTuple):
    """conversations: (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit); rows: (conv_id, seq, edit, turn, role, text) in the order of edits, deleted rows too, whole conversations in a partition and in order."""

    conversations: DataFrame
    rows: DataFrame


def conversation(c: Column) -> Column:
    """A text key, which is never null."""
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit(""))


def placed(turns: DataFrame, n: int | None = None) -> DataFrame:
    """turns (conv_id, turn, role, text) with conv, a key, and place, which orders the rows of a conversation: by turn (nulls first), then by the first 32 characters and a hash of the role, and of the text. Null roles and texts are one space. Dealt out by ranges of that order, so that a long conversation lies in many partitions."""
    n = n or int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blank = lambda c: F.coalesce(F.col(c), F.lit(" "))
    rows = turns.select(conversation(F.col("conv_id")).alias("conv"), "conv_id", F.col("turn").cast("long").alias("turn"), blank("role").alias("role"), blank("text").alias("text"))
    order = ["conv", "turn", *[f for c in ("role", "text") for f in (F.left(c, F.lit(32)), F.xxhash64(c))]]  # short keys, for samples of them go to the driver
    return stored(rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id()), "placed")


def faults(rows: DataFrame) -> DataFrame:
    """(conv, place, turn, initial, fault, kind) of placed rows. A row's first fault counts: blank, duplicate (role and text seen earlier in the conversation) or truncated (no end of a sentence last); else null.

    Repeats are found by the least place of each digest; only digests that occur again are joined.
    """
    said = F.rtrim("text", F.lit(BLANKS))
    digest = F.md5(F.concat_ws("\x00", F.char_length("conv").cast("string"), "conv", F.char_length("role").cast("string"), "role", "text"))
    initial = F.left("role", F.lit(1))
    initial = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    known = rows.select("conv", "place", "turn", initial.alias("initial"), (F.ltrim(said, F.lit(BLANKS)) == "").alias("is_blank"), (~F.right(said, F.lit(1)).isin(*ENDS)).alias("is_cut"), digest.alias("digest"))
    again = known.groupBy("digest").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    out = known.join(again, "digest", "left")
    fault = F.when(F.col("is_blank"), "blank").when(F.col("place") > F.col("first"), "duplicate").when(F.col("is_cut"), "truncated")
    kind = F.when(F.col("fault").isin("blank", "duplicate"), "d").otherwise(F.concat("initial", F.when(F.col("fault") == "truncated", "t").otherwise("")))
    return out.withColumn("fault", fault).select("conv", "place", "turn", "initial", "fault", kind.alias("kind"))


# --- the search


def _whole(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = BATCH_ROWS) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of about `rows` rows with whole groups of sorted keys, and where in them groups begin."""
    held: list[pa.RecordBatch] = []

    def cut(last: bool) -> Iterator[tuple[pa.Table, np.ndarray]]:
        t = pa.Table.from_batches(held).combine_chunks()
        new = np.zeros(t.num_rows, bool)
        new[:1] = True
        for k in keys:
            c = t.column(k)
            new[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy()
        starts = np.flatnonzero(new)
        end = t.num_rows if last else int(starts[-1])
        held[:] = t.slice(end).to_batches()
        if end:
            yield t.slice(0, end), starts if last else starts[:-1]

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            if sum(b.num_rows for b in held) >= rows:
                yield from cut(False)
    if held:
        yield from cut(True)


def _units(t: pa.Table, starts: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(starts)), np.diff(np.append(starts, t.num_rows)))


def _connect() -> duckdb.DuckDBPyConnection:
    return duckdb.connect(config={"threads": 1, "memory_limit": MEMORY, "temp_directory": ""})


#: Goes one step on for all units at once; only the least cost, and of that the least audit, stays for (unit, start, state).
_SEARCH = """
WITH RECURSIVE w(unit, start, state, seq, cost, audit) USING KEY (unit, start, state) AS (
  SELECT unit, start, start AS state, 0::BIGINT AS seq, 0::BIGINT AS cost, '' AS audit FROM begins
  UNION
  SELECT unit, start, state, seq, best.cost, best.audit FROM (
    SELECT w.unit, w.start, s.to_state AS state, w.seq + 1 AS seq, min(struct_pack(cost := w.cost + s.cost, audit := w.audit || s.audit)) AS best
    FROM w JOIN {steps} ON {on} GROUP BY ALL)
)
SELECT w.unit, w.start::INTEGER AS start, w.state::INTEGER AS state, w.cost, w.audit{more} FROM w JOIN sizes z ON z.unit = w.unit AND z.n = w.seq {join} ORDER BY ALL
"""
_SEGMENT_SEARCH = _SEARCH.format(
    steps="rows r ON r.unit = w.unit AND r.seq = w.seq + 1 JOIN steps s", on="s.kind = r.kind AND s.from_state = w.state",
    more=", w.start = -1 AND w.state = 0 AS lead, p.first_initial, p.last_initial, p.illegal",
    join="""JOIN (SELECT unit, arg_min(initial, seq) AS first_initial, arg_max(initial, seq) AS last_initial, (count(*) FILTER (before IS NOT NULL AND before || initial NOT IN ('su', 'ua', 'au')))::BIGINT AS illegal
  FROM (SELECT *, lag(initial) OVER (PARTITION BY unit ORDER BY seq) AS before FROM rows) GROUP BY unit) p ON p.unit = w.unit""",
)
_JOINT_SEARCH = _SEARCH.format(steps="rows s", on="s.unit = w.unit AND s.seq = w.seq + 1 AND s.from_state = w.state", more="", join="")
SEGMENTS = "conv string, segment long, start int, state int, cost long, audit string, lead boolean, first_initial string, last_initial string, illegal long"
JOINT = "conv string, segment long, start int, state int, cost long, audit string"


def _search_segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (conv, segment, place). A segment whose first row isn't the first of its block of places begins a conversation, since another one's row is before it; others may or may not."""
    con = _connect()
    con.execute("CREATE TABLE steps (kind VARCHAR, from_state INTEGER, to_state INTEGER, cost BIGINT, audit VARCHAR)")
    con.executemany("INSERT INTO steps VALUES (?, ?, ?, ?, ?)", [list(x) for x in transitions()])
    for t, starts in _whole(batches, ["conv", "segment"]):
        units = _units(t, starts)
        place = t.column("place").to_numpy()
        unsure = np.flatnonzero(place[starts] & ((1 << SHIFT) - 1) == 0)
        begins = [np.arange(len(starts)), *[unsure] * len(STATES)]
        con.register("rows", pa.table({"unit": units, "seq": np.arange(t.num_rows) - starts[units] + 1, "kind": t.column("kind"), "initial": t.column("initial")}))
        con.register("begins", pa.table({"unit": np.concatenate(begins), "start": np.repeat([BEFORE, *STATES], [len(b) for b in begins]).astype(np.int32)}))
        con.register("sizes", pa.table({"unit": np.arange(len(starts)), "n": np.diff(np.append(starts, t.num_rows))}))
        found = con.sql(_SEGMENT_SEARCH).to_arrow_table()
        at = starts[found.column("unit").to_numpy()]
        columns = [t.column("conv").take(at), t.column("segment").take(at), *[found.column(c) for c in found.column_names[1:]]]
        yield from pa.table(columns, names=[x.split()[0] for x in SEGMENTS.split(", ")]).to_batches()


def _search_joint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows are ways through segments, sorted by (conv, above, segment); they are put together for each (conv, above)."""
    con = _connect()
    for t, starts in _whole(batches, ["conv", "above"]):
        units = _units(t, starts)
        segment = t.column("segment").to_numpy()
        step = np.append(True, (segment[1:] != segment[:-1]) | (units[1:] != units[:-1])).cumsum()
        seq = step - step[starts][units] + 1
        con.register("rows", pa.table({"unit": units, "seq": seq, "from_state": t.column("start"), "to_state": t.column("state"), "cost": t.column("cost"), "audit": t.column("audit")}))
        con.register("begins", con.sql("SELECT DISTINCT unit, from_state AS start FROM rows WHERE seq = 1").to_arrow_table())
        con.register("sizes", pa.table({"unit": np.arange(len(starts)), "n": seq[np.append(starts[1:], t.num_rows) - 1]}))
        found = con.sql(_JOINT_SEARCH).to_arrow_table()
        at = starts[found.column("unit").to_numpy()]
        yield from pa.table([t.column("conv").take(at), t.column("above").take(at), *[found.column(c) for c in found.column_names[1:]]], names=[x.split()[0] for x in JOINT.split(", ")]).to_batches()


def search(known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv, cost, audit) and (conv, illegal), of the rows of `faults`."""
    n = int(known.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = known.select("conv", F.shiftright("place", SHIFT).alias("segment"), "place", "kind", "initial")
    ways = stored(rows.repartition(n, "conv", "segment").sortWithinPartitions("conv", "segment", "place").mapInArrow(_search_segments, SEGMENTS), "ways")
    order = Window.partitionBy("conv").orderBy("segment")
    pair = F.concat(F.lag("last_initial").over(order), "first_initial")
    illegal = ways.where("lead").withColumn("between", (pair.isNotNull() & ~pair.isin(*LEGAL)).cast("long")).groupBy("conv").agg(F.sum(F.col("illegal") + F.col("between")).alias("illegal"))
    ways = ways.select(*[x.split()[0] for x in JOINT.split(", ")])
    joined = lambda above: ways.withColumn("above", above).repartition(n, "conv", "above").sortWithinPartitions("conv", "above", "segment").mapInArrow(_search_joint, JOINT)
    while (ways.groupBy("conv").agg(F.count_distinct("segment").alias("n")).agg(F.max("n")).head()[0] or 0) > 1 << SHIFT:
        ways = stored(joined(F.shiftright("segment", SHIFT)), "ways")
    whole = joined(F.lit(0).cast("long")).where((F.col("start") == BEFORE) & F.col("state").isin(*FINAL))
    best = whole.groupBy("conv").agg(F.min(F.struct("cost", "audit")).alias("best"))
    return best.select("conv", "best.cost", "best.audit"), illegal


# --- the repair


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (conv, place), the audit's at the head of each conversation. Roles follow from the state: what is rerolled or inserted is the assistant's after the user, and else the user's."""
    conv_type, audit, at, state, seq, head = None, "", 0, NOTHING, 0, None
    out: list[tuple] = []

    def say(edit: str, turn, role: str | None, text: str) -> None:
        nonlocal state, seq
        if edit in "RI":
            role = "assistant" if state == USER else "user"
        if edit != "D":
            state = SAID[state, role[0]]
        out.append((head, seq, edit, turn, role, text))
        seq += 1

    def insert() -> None:
        nonlocal at
        while audit[at : at + 1] == "I":
            say("I", None, None, "")
            at += 1

    def batch_of() -> pa.RecordBatch:
        c = list(zip(*out, strict=True)) or [[]] * 6
        types = [conv_type or pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(c, types, strict=True)], names=["conv_id", "seq", "edit", "turn", "role", "text"])

    for batch in batches:
        conv_type = batch.schema.field("conv_id").type
        size = 0
        for conv_id, turn, role, text, told in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "audit")), strict=True):
            if told is not None:  # a new conversation
                insert()
                audit, at, state, seq, head = told, 0, NOTHING, 0, conv_id
                continue
            insert()
            say(audit[at], turn, role, text)
            at += 1
            size += len(text)
            if size > 8_000_000:
                yield batch_of()
                out.clear()
                size = 0
        if len(out) > 2000:
            yield batch_of()
            out.clear()
    insert()
    if conv_type is not None:
        yield batch_of()


def repair(turns: DataFrame) -> Repaired:
    """turns: (conv_id, turn, role, text); other columns are left out. Faults of each conversation and its cheapest repair.

    Keeping a row is free, a new role (user or assistant) costs 2, deleting 3, inserting an empty turn 2; blank and
    duplicate rows must go, and a truncated one that stays costs 1. audit has the edits' initials in order; of equally
    cheap ones it is the least in ASCII, and it determines the repair. Null roles and texts are one space, a null conv_id
    is a conversation of its own, null turns come first, rows of one turn are ordered as `placed` says, repeated rows are
    rows (and so duplicates), and an empty table gives empty results. gaps is null where turns span more than 64 bits.
    """
    spark = turns.sparkSession
    kind = turns.schema["conv_id"].dataType.simpleString()
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = placed(turns)
    known = stored(faults(rows), "faults")
    best, illegal = search(known)
    best = stored(best, "audits")
    ids = rows.groupBy("conv").agg(F.first("conv_id", ignorenulls=True).alias("conv_id"))
    width = F.try_add(F.try_subtract(F.max("turn"), F.min("turn")), F.lit(1))
    each = [F.count(F.when(F.col("fault") == x, 1)).alias(x) for x in ("blank", "duplicate", "truncated")]
    spans = known.groupBy("conv").agg(width.alias("width"), F.count("turn").alias("turns"), *each)
    distinct = known.where("turn is not null").groupBy("conv", "turn").agg(F.lit(1)).groupBy("conv").agg(F.count("*").alias("n_turns"))
    gaps = F.when(F.col("turns") == 0, F.lit(0).cast("long")).otherwise(F.col("width") - F.col("n_turns"))
    told = ids.join(spans, "conv").join(distinct, "conv", "left").join(illegal, "conv").join(best, "conv")
    conversations = told.select("conv_id", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    heads = best.join(ids, "conv").select("conv", "conv_id", F.lit(-1).cast("long").alias("place"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), "audit")
    lines = rows.select("conv", "conv_id", "place", "turn", "role", "text", F.lit(None).cast("string").alias("audit")).unionByName(heads)
    edited = lines.repartition(n, "conv").sortWithinPartitions("conv", "place").mapInArrow(_edited, f"conv_id {kind}, seq long, edit string, turn long, role string, text string")
    return Repaired(conversations, edited)


def digests(rows: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of `Repaired.rows`: what is left as role:text lines, joined by newlines. Goes along partitions, which hold whole conversations in order; only a running hash is held."""
    kind = rows.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv_type, done, head, sha, first = None, [], None, None, True
        for batch in batches:
            conv_type = batch.schema.field("conv_id").type
            for conv_id, seq, edit, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "seq", "edit", "role", "text")), strict=True):
                if seq == 0:
                    if sha:
                        done.append((head, sha.hexdigest()))
                    head, sha, first = conv_id, hashlib.sha256(), True
                if edit != "D":
                    sha.update(("" if first else "\n").encode() + f"{role}:{text}".encode())
                    first = False
        if sha:
            done.append((head, sha.hexdigest()))
        if conv_type is not None:
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], conv_type), pa.array([d[1] for d in done], pa.string())], names=["conv_id", "repaired_sha256"])

    return rows.mapInArrow(run, f"conv_id {kind}, repaired_sha256 string")


# --- the query


def damaged(turns: DataFrame) -> DataFrame:
    """Rows of turns (conv_id, turn, role, text) as the query's contract damages them, by crc32 of `conv_id:turn` modulo 20; nulls but those of conv_id and turn become one space."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    how = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn")).cast("binary")) % 20
    rows = turns.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), how.alias("how")).where("how <> 0")
    text = F.when(F.col("how") == 1, "").when(F.col("how") == 2, F.translate("text", ENDS, "")).otherwise(F.col("text"))
    role = F.when(F.col("how") == 4, "user").otherwise(F.col("role"))
    rows = rows.withColumn("again", F.explode(F.when(F.col("how") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    fixed = repair(damaged(turns))
    key = lambda df: df.withColumn("conv", conversation(F.col("conv_id"))).drop("conv_id")
    all_ids = turns.select("conv_id").distinct().withColumn("conv", conversation(F.col("conv_id")))
    out = all_ids.join(key(fixed.conversations), "conv", "left").join(key(digests(fixed.rows)), "conv", "left")
    zero, nothing = F.lit(0).cast("long"), F.lit(hashlib.sha256().hexdigest())
    counts = [F.when(F.col("audit").isNull(), zero).otherwise(F.col(c)).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", nothing).alias("repaired_sha256"))
