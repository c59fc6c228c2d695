"""Declared types: compatibility with three answers, calls that no method can take, and types that flow through assignments.

An answer is true, false, or null for unknown. Unknown never rules anything out, and false is only said where every step of
a walk up the supertypes was known.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from arborq.operators.graph import stored

#: The type above all, and a union whose members aren't known.
TOP, SOME_UNION = "Any", "Union"
#: A walk up the supertypes ends after 2 ** DOUBLINGS steps, without an answer: a cycle, or deeper than any real hierarchy.
DOUBLINGS = 5
#: Rows of a scope that one task holds at once; a scope with more goes through joins.
SCOPE = 200_000
#: Rows, of whole scopes, that are worked on together.
TOGETHER = 1 << 16
#: Parts that scopes are dealt to when rows are counted: only where a part has over SCOPE rows are they counted by scope.
PARTS = 1 << 16


def chains(supers: DataFrame) -> DataFrame:
    """(type, up, known): each type's way up, itself first, and whether it is known up to TOP (which is on no way but its own).

    supers: (type, super), a row for each declared type; a null super is one that wasn't found. A type with several
    supers is unknown from there on, as is one whose super has no row; TOP needs none. A null type is left out. The ways
    are found by pointer doubling: in round k each type takes over the 2**k steps of the type where its own steps end, so
    that 2**DOUBLINGS steps take DOUBLINGS joins, in which every type is one row.
    """
    one = supers.where(F.col("type").isNotNull() & (F.col("type") != TOP)).groupBy("type").agg(F.min("super").alias("super"), F.max("super").alias("other"), F.count("*").alias("n"), F.count("super").alias("there"))
    super_ = F.when((F.col("super") == F.col("other")) & (F.col("n") == F.col("there")), F.col("super"))
    ways = one.select("type", F.when(super_.isNull(), F.array().cast("array<string>")).otherwise(F.array(super_)).alias("steps"))
    ways = stored(ways.withColumn("open", F.size("steps") > 0).withColumn("open", F.col("open") & ~F.array_contains("steps", TOP)))
    for _ in range(DOUBLINGS):
        on = ways.select(F.col("type").alias("last"), F.col("steps").alias("more"), F.col("open").alias("on"))
        joined = ways.withColumn("last", F.when(F.col("open"), F.element_at("steps", -1))).join(on, "last", "left")
        steps = F.concat("steps", F.coalesce("more", F.array().cast("array<string>")))
        ways = stored(joined.select("type", steps.alias("steps"), (F.col("open") & F.coalesce("on", F.lit(False))).alias("open")))
    known = F.array_contains("steps", TOP)
    up = F.concat(F.array("type"), F.filter("steps", lambda t: t != TOP))
    top = supers.sparkSession.createDataFrame([(TOP, [TOP], True)], "type string, up array<string>, known boolean")
    return ways.select("type", up.alias("up"), known.alias("known")).unionByName(top)


# --- compatibility of types that carry their way up: structs (type, up, known)


def subtype(a: Column, b: Column) -> Column:
    """Whether one named type lies below another, or is it."""
    above = (b["type"] == TOP) | F.array_contains(a["up"], b["type"])
    return F.when(above, True).when(a["known"], False)


def compatible(a: Column, b: Column) -> Column:
    """Whether a value of a may be one of b: one lies below the other. Both are arrays of types, the members of a union; a union is compatible if any member is. An empty array is no information."""
    loose = F.exists(a, lambda x: x["type"] == SOME_UNION) | F.exists(b, lambda y: y["type"] == SOME_UNION)
    some = F.exists(a, lambda x: F.exists(b, lambda y: subtype(x, y) | subtype(y, x)))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), None).when(loose, True).otherwise(some)


TYPED = "array<array<struct<type: string, up: array<string>, known: boolean>>>"


def typed(df: DataFrame, column: str, ways: DataFrame, out: str) -> DataFrame:
    """df with `out`: for each of the types in `column` (array of texts, of which `A|B` is a union) its members with their ways up.

    A type that `ways` doesn't have is unknown; a null one is TOP, which everything is compatible with. Each different
    list of types is looked up once, whatever the number of rows that have it.
    """
    lists = df.select(F.col(column).alias("list")).where("list is not null").distinct()
    one = lists.select("list", F.posexplode("list").alias("at", "text"))
    member = one.select("list", "at", F.posexplode(F.split(F.coalesce("text", F.lit(TOP)), r"\|")).alias("member_at", "type")).withColumn("type", F.trim("type"))
    found = member.join(ways, "type", "left").withColumn("as", F.struct("type", F.coalesce("up", F.array("type")).alias("up"), F.coalesce("known", F.lit(False)).alias("known")))
    whole = found.groupBy("list", "at").agg(F.transform(F.array_sort(F.collect_list(F.struct("member_at", "as"))), lambda m: m["as"]).alias("members"))
    rows = whole.groupBy("list").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "members"))), lambda m: m["members"]).alias(out))
    empty = F.array().cast(TYPED)
    return df.join(rows, F.col(column) == F.col("list"), "left").drop("list").withColumn(out, F.coalesce(out, F.when(F.size(F.col(column)) == 0, empty)))


# --- calls and methods


def takes(call: dict[str, Column], method: dict[str, Column]) -> Column:
    """Whether a method may take a call, by count and by place.

    call: args (as of `typed`), kws (names), splat (it has arguments of unknown number). method: sig (as of `typed`: what
    is required, then what is optional), required (number), tail (null without a vararg, else the type of each further
    argument, an array of members), tail_n (null, or how many of these there must be), kws (names), kwsplat. Only a
    definite mismatch of a place rules a method out. A null args or sig has no places that are known.
    """
    args, sig, n = call["args"], method["sig"], F.size(call["args"])
    most = F.when(method["tail"].isNull(), F.size(sig)).when(method["tail_n"].isNotNull(), F.size(sig) + method["tail_n"])
    least = F.when(method["tail_n"].isNotNull(), F.size(sig) + method["tail_n"]).otherwise(method["required"])
    counts = F.when(call["splat"], most.isNull() | (n <= most)).otherwise((n >= least) & (most.isNull() | (n <= most)))
    places = F.concat(sig, F.array_repeat(F.coalesce(method["tail"], F.array().cast("array<struct<type: string, up: array<string>, known: boolean>>")), F.greatest(n - F.size(sig), F.lit(0))))
    agree = F.zip_with(args, F.slice(places, F.lit(1), n), lambda a, b: F.coalesce(compatible(a, b), F.lit(True)))
    keywords = (F.size(call["kws"]) == 0) | method["kwsplat"] | (F.size(F.array_except(call["kws"], method["kws"])) == 0)
    return F.coalesce(counts, F.lit(True)) & F.coalesce(F.forall(agree, lambda x: x), F.lit(True)) & F.coalesce(keywords, F.lit(True))


def prepared_calls(calls: DataFrame, ways: DataFrame) -> DataFrame:
    """calls (callee, args array<string>, kws array<string>, splat boolean, ...) with typed args; nulls mean no keywords and no splat."""
    none = F.array().cast("array<string>")
    return typed(calls.withColumns({"kws": F.coalesce("kws", none), "splat": F.coalesce("splat", F.lit(False))}), "args", ways, "args_typed")


def prepared_methods(methods: DataFrame, ways: DataFrame) -> DataFrame:
    """methods (callee, sig array<string>, required int, tail string, tail_n int, kws array<string>, kwsplat boolean, ...) with typed sig and tail; nulls mean that all is required, and no tail, keywords or splat."""
    none = F.array().cast("array<string>")
    full = methods.withColumns({"required": F.coalesce("required", F.size("sig")), "kws": F.coalesce("kws", none), "kwsplat": F.coalesce("kwsplat", F.lit(False)), "tails": F.when(F.col("tail").isNotNull(), F.array("tail"))})
    out = typed(typed(full, "sig", ways, "sig_typed"), "tails", ways, "tail_typed")
    return out.withColumn("tail_typed", F.get("tail_typed", 0)).drop("tails")


def _fits(c: str, m: str) -> Column:
    call = {"args": F.col(f"{c}.args_typed"), "kws": F.col(f"{c}.kws"), "splat": F.col(f"{c}.splat")}
    method = {"sig": F.col(f"{m}.sig_typed"), "required": F.col(f"{m}.required"), "tail": F.col(f"{m}.tail_typed"), "tail_n": F.col(f"{m}.tail_n"), "kws": F.col(f"{m}.kws"), "kwsplat": F.col(f"{m}.kwsplat")}
    return takes(call, method)


def unmatched(calls: DataFrame, methods: DataFrame) -> DataFrame:
    """Prepared calls whose callee has methods (prepared) none of which takes them: an equi join on the callee, the match on top of it."""
    known = calls.join(methods.select("callee").distinct(), "callee", "left_semi").alias("c")
    m = methods.alias("m")
    return known.join(m, (F.col("c.callee") == F.col("m.callee")) & _fits("c", "m"), "left_anti")


def matches(calls: DataFrame, methods: DataFrame, method_id: str) -> DataFrame:
    """Prepared calls with the methods that may take them: all columns of calls, and method_id, sig_typed of the method."""
    c, m = calls.alias("c"), methods.alias("m")
    return c.join(m, (F.col("c.callee") == F.col("m.callee")) & _fits("c", "m")).select("c.*", f"m.{method_id}", "m.sig_typed")


def dominates(a: Column, b: Column) -> Column:
    """Whether signature a is surely the more special: as many places, each below that of b, and not the same."""
    below = lambda x, y: F.zip_with(x, y, lambda p, q: F.coalesce(F.forall(p, lambda s: F.exists(q, lambda t: subtype(s, t))), F.lit(False)))
    return (F.size(a) == F.size(b)) & F.forall(below(a, b), lambda x: x) & ~F.forall(below(b, a), lambda x: x)


def most_special(found: DataFrame, call: list[str], method_id: str) -> DataFrame:
    """(call, methods): of the methods that may take a call those that no other dominates, ascending. A call's own matches are compared in its row."""
    got = found.groupBy(*call).agg(F.collect_list(F.struct(F.col(method_id).alias("id"), F.col("sig_typed").alias("sig"))).alias("all"))
    best = F.filter("all", lambda m: ~F.exists("all", lambda o: dominates(o["sig"], m["sig"])))
    return got.select(*call, F.array_sort(F.transform(best, lambda m: m["id"])).alias("methods"))


# --- inference


def inferred(bindings: DataFrame, literals: DataFrame, assigns: DataFrame, calls: DataFrame, returns: DataFrame, width: int = 4) -> DataFrame:
    """(binding, types): the types that flow to each of bindings (binding), ascending; [TOP] for more than `width` of them, and none where nothing is known.

    literals: (binding, type), what is written down for a binding. assigns: (binding, source), bindings that take another's
    value. calls: (binding, callee) and returns: (callee, type), results of functions. What flows only grows, and a binding
    with over `width` types is at the top and takes no more, so that the work ends after at most width + 2 changes of a
    binding. Each round joins the types that are new with the assignments, and drops those already there. Loops of
    assignments end, nulls are left out, repeated rows count once.
    """
    both = lambda df, a, b: df.select(a, b).where(F.col(a).isNotNull() & F.col(b).isNotNull())
    edges = stored(both(assigns, "binding", "source").distinct())
    start = both(literals, "binding", "type").unionByName(both(calls, "binding", "callee").join(both(returns, "callee", "type"), "callee").select("binding", "type"))
    seen = fresh = stored(_capped(start.distinct(), None, width))
    while not fresh.isEmpty():
        flow = edges.join(fresh.withColumnRenamed("binding", "source"), "source").select("binding", "type").distinct()
        fresh = stored(_capped(flow.join(seen, ["binding", "type"], "left_anti"), seen, width))
        gone = fresh.where(F.col("type") == TOP).select("binding")
        seen = stored(seen.join(gone, "binding", "left_anti").unionByName(fresh))
    types = seen.groupBy("binding").agg(F.array_sort(F.collect_set("type")).alias("types"))
    out = bindings.select("binding").distinct().join(types, "binding", "left")
    return out.select("binding", F.coalesce("types", F.array().cast("array<string>")).alias("types"))


def _capped(flow: DataFrame, seen: DataFrame | None, width: int) -> DataFrame:
    """New (binding, type) rows; just TOP for a binding that has too many by now or gets TOP, and none for one that is there."""
    new = flow.groupBy("binding").agg(F.collect_set("type").alias("types"))  # no more than there are declared types
    if seen is not None:
        old = seen.groupBy("binding").agg(F.count("*").alias("n"), F.max((F.col("type") == TOP).cast("int")).alias("top"))
        new = new.join(old, "binding", "left").where(F.coalesce("top", F.lit(0)) == 0)
    n = F.coalesce(F.col("n"), F.lit(0)) if seen is not None else F.lit(0)
    over = F.array_contains("types", TOP) | (F.size("types") + n > width)
    return new.select("binding", F.explode(F.when(over, F.array(F.lit(TOP))).otherwise(F.col("types"))).alias("type"))


# --- inference within scopes


def inferred_within(facts: DataFrame, width: int = 4) -> DataFrame:
    """(scope, binding, types): `inferred` where bindings take values only from those of their own scope.

    facts: (scope, binding, type, source). A row says that there is a binding, that a type is written down for it unless
    null, and that it takes the value of source unless null; source is of binding's kind. Every binding of facts that isn't
    null has one row. Nothing is known in a null scope. Repeated rows count once.

    Rows are dealt by scope, which moves nothing where they lie so already, and each task goes through its own, some scopes
    at a time: no round of a join, and nothing written, however long the ways. Scopes of over SCOPE rows are counted
    before and go through `inferred`, so that what a worker holds is bounded.
    """
    there = F.col("scope").isNotNull()
    facts = facts.where("binding is not null").select("scope", "binding", F.when(there, F.col("type")).alias("type"), F.when(there, F.col("source")).alias("source"))
    # not a repartition, which would move all rows once more
    sized = facts.withColumn("rows", F.count("*").over(Window.partitionBy("scope")))
    schema = StructType([facts.schema["scope"], facts.schema["binding"], StructField("types", ArrayType(StringType()))])
    got = sized.where(F.col("rows") <= SCOPE).drop("rows").mapInArrow(_scopes(width, TOGETHER), schema)
    if not _any_over(facts, SCOPE):
        return got
    large = stored(sized.where(F.col("rows") > SCOPE).select(F.struct("scope", "binding").alias("binding"), "type", F.when(F.col("source").isNotNull(), F.struct("scope", F.col("source").alias("binding"))).alias("source")))
    none = large.select("binding", F.lit("").alias("callee"), "type").limit(0)
    rest = inferred(large, large, large, none, none.select("callee", "type"), width)
    return got.unionByName(rest.select("binding.scope", "binding.binding", "types"))


def _any_over(facts: DataFrame, most: int) -> bool:
    """Whether a scope has over `most` rows."""
    parted = facts.select("scope", F.pmod(F.hash("scope"), F.lit(PARTS)).alias("part"))
    full = parted.groupBy("part").count().where(F.col("count") > most).select("part")
    return not full.isEmpty() and not parted.join(F.broadcast(full), "part").groupBy("scope").count().where(F.col("count") > most).isEmpty()


def _scopes(width: int, together: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow over facts of which those of a scope follow each other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows >= together:
                table = pa.Table.from_batches(held)
                scope = _codes(table["scope"])[0]
                others = np.flatnonzero(scope != scope[-1])
                whole = int(others[-1]) + 1 if len(others) else 0  # the last scope may go on
                if whole:
                    yield from _solved(table.slice(0, whole), width)
                held = table.slice(whole).to_batches()
                rows -= whole
        if rows:
            yield from _solved(pa.Table.from_batches(held), width)

    return run


def _codes(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """A number for each value, and the values by number; a null is one, too."""
    d = column.combine_chunks().dictionary_encode(null_encoding="encode")
    return d.indices.to_numpy(zero_copy_only=False).astype(np.int64), d.dictionary


def _solved(facts: pa.Table, width: int) -> Iterator[pa.RecordBatch]:
    """The bindings of whole scopes with their types."""
    n = facts.num_rows
    scope = _codes(facts["scope"])[0]
    names, values = _codes(pa.chunked_array([*facts["binding"].chunks, *facts["source"].chunks]))
    has = np.asarray(facts["source"].combine_chunks().is_valid())
    at = np.concatenate([scope * len(values) + names[:n], (scope * len(values) + names[n:])[has]])
    _, first, node = np.unique(at, return_index=True, return_inverse=True)
    kinds, texts = _codes(facts["type"])
    texts = texts.to_pylist()
    order = [TOP, *sorted({t for t in texts if t is not None} - {TOP})]
    number = {t: i for i, t in enumerate(order)}
    kind = np.array([number.get(t, -1) for t in texts], dtype=np.int64)[kinds]
    have, many = _flow(len(first), node[n:], node[:n][has], node[:n][kind >= 0], kind[kind >= 0], len(order), width)
    asked = first < n
    first, have, many = first[asked], np.sort(have[asked], axis=1), many[asked]  # empty places are the greatest
    flat = have[np.arange(have.shape[1]) < many[:, None]]
    types = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(many)]), pa.int32()), pa.array(order, pa.string()).take(pa.array(flat)))
    row = facts.select(["scope", "binding"]).take(pa.array(first))
    yield from row.append_column("types", types).combine_chunks().to_batches()


def _flow(n: int, source: np.ndarray, binding: np.ndarray, start: np.ndarray, kind: np.ndarray, kinds: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The types (numbers below kinds, TOP 0) of n bindings, in rows of `width` places, and how many of these are taken: each round passes on what was new in the one before."""
    out = np.argsort(source, kind="stable")
    to, begin = binding[out], np.concatenate([[0], np.cumsum(np.bincount(source, minlength=n))])
    have, many, top = np.full((n, max(width, 1)), kinds, dtype=np.int64), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=bool)
    b, t = start, kind
    while len(b):
        new = ~top[b] & (have[b] != t[:, None]).all(axis=1)
        b, t = np.divmod(np.unique(b[new] * kinds + t[new]), kinds)
        place = many[b] + np.arange(len(b)) - np.searchsorted(b, b)
        above = np.unique(b[(place >= width) | (t == 0)])
        top[above] = True
        fits = ~top[b]
        b, t, place = b[fits], t[fits], place[fits]
        have[b, place] = t
        np.maximum.at(many, b, place + 1)
        have[above], many[above] = kinds, 1
        have[above, 0] = 0
        b, t = np.concatenate([b, above]), np.concatenate([t, np.zeros(len(above), dtype=np.int64)])
        outs = begin[b + 1] - begin[b]
        each = np.repeat(np.arange(len(b)), outs)
        step = np.arange(len(each)) - np.repeat(np.cumsum(outs) - outs, outs)
        b, t = to[begin[b][each] + step], t[each]
    return have, many
