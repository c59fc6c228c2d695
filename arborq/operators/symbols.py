"""Declarations, what is visible where, and the joins from uses to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arborq.operators import relational
from arborq.operators.graph import stored

#: Kinds of declarations that later functions and assignments of the name don't replace.
DATATYPES = ("struct", "mutable_struct", "abstract", "primitive", "enum")
WEAK = ("function", "assignment")
#: Tiers of visible names, the higher over the lower.
WILDCARD, EXPLICIT, DECLARED = 1, 2, 3
#: Source priorities of completions, to which a depth is added for locals and modules.
PRIORITY = {"field": 0, "local": 0, "module": 100, "store": 500, "keyword": 900}
UNBOUNDED = 2**31 - 1


def item_ids(items: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """items with hash, of the key (46 bits), occurrence (0-based, of equal keys by order) and id: hash and occurrence (16 bits; for each further 65,536 occurrences another hash)."""
    out = items.withColumn("hash", F.xxhash64(*key).bitwiseAND((1 << 46) - 1))
    out = out.withColumn("occurrence", F.row_number().over(Window.partitionBy(*key).orderBy(*order)) - 1)
    room = 1 << 16  # an occurrence beyond takes another hash, so that it doesn't run into this one's bits
    hashed = F.when(F.col("occurrence") < room, F.col("hash")).otherwise(F.xxhash64("hash", F.shiftright("occurrence", 16)).bitwiseAND((1 << 46) - 1))
    return out.withColumn("id", F.shiftleft(hashed, 16).bitwiseOR(F.col("occurrence").bitwiseAND(room - 1).cast("long")))


def declared(items: DataFrame, key: list[str], order: str, kind: str = "kind") -> DataFrame:
    """The declaration that a name stands for: of items in order the last that is neither function nor assignment, if that is of a datatype, and else the last. One aggregation, no fold."""
    rest = [c for c in items.columns if c not in key]
    row = F.struct(*rest)
    strong = ~F.col(kind).isin(*WEAK)
    got = items.groupBy(*key).agg(F.max_by(row, order).alias("last"), F.max_by(row, F.when(strong, F.col(order))).alias("strong"))
    win = F.when(F.col(f"strong.{kind}").isin(*DATATYPES), F.col("strong")).otherwise(F.col("last"))
    return got.select(*key, win.alias("win")).select(*key, *[F.col(f"win.{c}").alias(c) for c in rest])


def visible(layers: list[tuple[DataFrame, int]], key: list[str], item: str, order: str) -> DataFrame:
    """(key, item, tier): names of several layers, each with a tier; the highest tier wins, and within it the last by order."""
    rows = None
    for df, tier in layers:
        own = df.select(*key, item, order, F.lit(tier).alias("tier"))
        rows = own if rows is None else rows.unionByName(own)
    got = rows.groupBy(*key).agg(F.max_by(F.struct(item, "tier"), F.struct("tier", order)).alias("w"))
    return got.select(*key, F.col(f"w.{item}").alias(item), F.col("w.tier").alias("tier"))


def arity_fits(call: dict[str, Column], method: dict[str, Column]) -> Column:
    """Whether a call (min, max, kws, has_splat) fits a method (min, max, kws, kwsplat) by counts and keywords alone."""
    positional = F.when(call["has_splat"], ~((call["min"] <= call["max"]) & (call["max"] < method["min"]))).otherwise((method["min"] <= call["min"]) & (call["max"] <= method["max"]))
    keywords = method["kwsplat"] | (F.size(F.array_except(call["kws"], method["kws"])) == 0)
    return positional & keywords


def fit_shapes(calls: DataFrame, methods: DataFrame, callee: list[str], shape: list[str], fits: Column) -> DataFrame:
    """(callee, shape, fit): each different shape of a call whose callee has methods, and whether any of these takes it.

    fits reads the columns `callee` and `shape` of calls as c, and any of methods as m. Calls and methods alike in these are
    one row each before they are joined, so that what is compared is kinds of calls with kinds of methods, however many
    there are of each; methods should have no columns but those. A shape may have nulls.
    """
    kinds = methods.distinct()
    own = calls.select(*callee, *shape).distinct().join(methods.select(*callee).distinct(), callee, "left_semi")
    same = F.lit(True)
    for k in callee:
        same = same & (F.col(f"c.{k}") == F.col(f"m.{k}"))
    good = own.alias("c").join(kinds.alias("m"), same & fits, "left_semi").withColumn("fit", F.lit(True))
    return own.withColumn("fit", F.lit(False)).unionByName(good).groupBy(*callee, *shape).agg(F.bool_or("fit").alias("fit"))


def of_shapes(calls: DataFrame, shapes: DataFrame) -> DataFrame:
    """calls that have one of shapes (callee and shape, as of `fit_shapes`); nulls are alike."""
    same = F.lit(True)
    for k in shapes.columns:
        same = same & F.col(f"c.{k}").eqNullSafe(F.col(f"s.{k}"))
    return calls.alias("c").join(shapes.alias("s"), same, "left_semi")


def fit_calls(calls: DataFrame, methods: DataFrame, callee: str, shape: list[str], fits: Column) -> DataFrame:
    """calls that some method of their callee fits, by `fit_shapes`."""
    return of_shapes(calls, fit_shapes(calls, methods, [callee], shape, fits).where("fit").drop("fit"))


def unfit_calls(calls: DataFrame, methods: DataFrame, callee: str, shape: list[str], fits: Column) -> DataFrame:
    """calls whose callee has methods, none of which fits, by `fit_shapes`."""
    return of_shapes(calls, fit_shapes(calls, methods, [callee], shape, fits).where("NOT fit").drop("fit"))


def references(refs: DataFrame, items: DataFrame, key: str) -> DataFrame:
    """Uses of items, by the item they lead to and not by name, so that aliases count; equal rows count once, and a place as often as it stands for different items."""
    return refs.join(items, key, "left_semi").distinct()


def rename_sites(sites: DataFrame, name: Column) -> DataFrame:
    """Sites (bound_name) that spell the declared name; others are aliases and stay."""
    strip = lambda c: F.regexp_replace(c, "^@", "")
    return sites.where(strip(F.col("bound_name")) == strip(name))


def highlights(sites: DataFrame, uri: str) -> DataFrame:
    return sites.where(F.col("uri") == uri).withColumn("kind", F.when(F.col("is_write"), "write").otherwise("read"))


def type_join(left: Column, right: Column) -> Column:
    """The nearest type that both chains of supertypes (arrays, a type itself first) have."""
    return F.get(F.array_intersect(left, right), 0)


def completion_rank(label: Column, query: str) -> Column:
    if not query:
        return F.lit(3)
    return F.when(label == query, 0).when(label.startswith(query), 1).when(F.lower(label).startswith(query.lower()), 2).otherwise(3)


def completions(names: DataFrame, query: str, cutoff: float = 0.6) -> DataFrame:
    """names (label, source, depth) that match, with rank_text, by (rank, source priority, label length, label).

    A match is a prefix (case aside only if the query has no upper case) or a similarity of at least cutoff: 1 less the
    share of edits, an approximation of a fuzzy score.
    """
    label = F.col("label")
    prefix = label.startswith(query) if query != query.lower() else F.lower(label).startswith(query)
    similar = 1 - F.levenshtein(label, F.lit(query)) / F.greatest(F.char_length(label), F.lit(len(query)), F.lit(1))
    base = F.create_map(*[x for k, v in PRIORITY.items() for x in (F.lit(k), F.lit(v))])[F.col("source")]
    priority = base + F.when(F.col("source").isin("local", "module"), F.col("depth")).otherwise(0)
    found = names.where(prefix | (similar >= cutoff)).withColumns({"rank": completion_rank(label, query), "priority": priority})
    order = ["rank", "priority", F.char_length("label"), "label", "source", "depth"]
    # ranks over all matches: a global order, so all of a range lies in one partition and only counts go across
    return relational_rank(found, order)


def relational_rank(df: DataFrame, order: list, width: int = 6) -> DataFrame:
    """df with place (1-based, in the whole order) and rank_text, of at least `width` digits and as many as the largest place has.

    Rows are dealt out by ranges of the order and stored in it, with their numbers in their range; what is counted is what
    is numbered, for ranges are sampled anew whenever they are dealt out. The sizes of ranges, a number a partition, are
    added up and joined to the stored rows.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [o if isinstance(o, Column) else F.col(o) for o in order]
    ranged = stored(df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", 33).cast("int")
    sizes = ranged.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()
    base, starts = 0, []
    for r in sorted(sizes):
        starts.append((r["part"], base))
        base += r["n"]
    before = spark.createDataFrame(starts, "__part int, __before long")
    out = ranged.withColumn("__part", part).join(F.broadcast(before), "__part")  # a row a partition
    place = F.col("__before") + F.col("__at").bitwiseAND((1 << 33) - 1) + 1
    return out.withColumn("place", place).withColumn("rank_text", F.lpad(F.col("place").cast("string"), max(width, len(str(base))), "0")).drop("__part", "__at", "__before")


def symbol_matches(items: DataFrame, query: str, name: str = "name") -> DataFrame:
    """Names that begin with the query, with or without the @ of a macro; an empty query takes all."""
    c = F.col(name)
    return items.where(c.startswith(query) | F.regexp_replace(c, "^@", "").startswith(query)) if query else items


def doc_search(docs: DataFrame, word: str, limit: int = 25, name: str = "name") -> DataFrame:
    """The `limit` entries nearest to the word, by edit distance, case aside, if that is under 2; half of it counts for entries that begin with the word, and the word itself is at 0."""
    c = F.lower(F.col(name))
    distance = F.levenshtein(c, F.lit(word.lower())).cast("double")
    score = F.when(F.col(name) == word, 0.0).when(c.startswith(word.lower()), distance / 2).otherwise(distance)
    return docs.withColumn("score", score).where("score < 2").orderBy("score", name).limit(limit)


def method_index(items: DataFrame, key: list[str], order: str, arity: Column) -> DataFrame:
    """(key, arities): all arities of a name in the order of declaration."""
    got = items.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), arity.alias("arity")))).alias("all"))
    return got.select(*key, F.col("all.arity").alias("arities"))


def overlay(layers: list[DataFrame], key: list[str], value: str) -> DataFrame:
    return relational.layered(layers, key, value)


def extended_methods(functions: DataFrame) -> DataFrame:
    """(owner, name, modules): for each function that other modules add methods to its own module and theirs, ascending, each once.

    functions: (module, name, extends_module, extends_name), a row for each function that a module has methods of; what it
    extends is itself for its own. Rows without what they extend are left out. Copies of a row are dropped before the
    shuffle, so that a function which every module extends sends one row a module.
    """
    rows = functions.where("extends_module IS NOT NULL AND extends_name IS NOT NULL AND module IS NOT NULL")
    other = rows.where("module <> extends_module OR name <> extends_name").select(F.col("extends_module").alias("owner"), F.col("extends_name").alias("name"), "module").distinct()
    got = other.groupBy("owner", "name").agg(F.collect_set("module").alias("modules"))
    return got.select("owner", "name", F.array_sort(F.array_union("modules", F.array("owner"))).alias("modules"))
