"""What names mean in modules, through imports of any length.

Three steps, none of which depends on an order of evaluation. Which names are bound at all is a least fixpoint, reached
from the declarations outward, a round for each import on the way. Each bound name then has one statement that binds it:
its own declaration over an explicit import over a wildcard one, of equal ones that with the shortest way to a
declaration, and then the last. So a name points to at most one name of another module, and pointer doubling finds the
declaration at the end.

What grows with the input is never sent whole to all tasks, for that goes through the driver: joins are told to merge.
Imports lie in buckets by what they lead to, so that a round moves names, of which there are fewer, and no imports.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arborq.operators.graph import Seen, bucketed, stored, unseen
from arborq.operators.symbols import DECLARED, EXPLICIT, WILDCARD

PAIR = ["module", "name"]


def statements(explicit: DataFrame, wildcard: DataFrame, exports: DataFrame) -> DataFrame:
    """(module, name, target, target_name, tier, ord): what each import would bind: explicit (module, name, target, target_name, ord) as it says, wildcard (module, target, ord) a row for each of the target's exports (module, name)."""
    listed = explicit.select(*PAIR, "target", "target_name", F.lit(EXPLICIT).alias("tier"), "ord")
    used = wildcard.join(exports.select(F.col("module").alias("target"), "name").distinct().hint("merge"), "target")
    return listed.unionByName(used.select("module", "name", "target", F.col("name").alias("target_name"), F.lit(WILDCARD).alias("tier"), "ord"))


def bound(declared: DataFrame, imports: DataFrame) -> DataFrame:
    """(module, name, round): names that are declared (round 0), or that some import binds, with the least number of imports to a declaration. Each round follows what the round before has bound; loops of imports end. imports: best in buckets by target and target_name."""
    back = imports.select(F.col("target").alias("at"), F.col("target_name").alias("at_name"), *PAIR).hint("merge")
    fresh = stored(declared.select(*PAIR).distinct().withColumn("round", F.lit(0)))
    seen, n = Seen(fresh), 0
    while not fresh.isEmpty():
        n += 1
        step = fresh.select(F.col("module").alias("at"), F.col("name").alias("at_name")).join(back, ["at", "at_name"]).select(*PAIR).distinct()
        fresh = stored(unseen(step, seen.all().hint("merge"), PAIR).withColumn("round", F.lit(n)))
        seen.add(fresh)
    return seen.all()


def visible(declared: DataFrame, explicit: DataFrame, wildcard: DataFrame, exports: DataFrame) -> DataFrame:
    """(module, name, tier, item_module, item_name): every name that is bound in a module, and the declaration that it stands for.

    declared: (module, name). The item is null where explicit imports lead round in a circle. Names that no declaration is
    behind aren't bound, whatever imports say; rows with nulls are left out, and repeated ones count once. One name of
    one module may be brought in by any number of others: what is joined on is that pair.
    """
    known = declared.where("module is not null and name is not null").select(*PAIR).distinct()
    said = statements(explicit, wildcard, exports).where("module is not null and name is not null and target is not null and target_name is not null and NOT (module = target AND name = target_name)")
    said = said.join(known.hint("merge"), PAIR, "left_anti")  # what a module declares itself no import replaces
    imports = bucketed(said.repartition("target", "target_name"), "target", "target_name")
    rounds = stored(bound(known, imports))
    at = rounds.select(F.col("module").alias("target"), F.col("name").alias("target_name"), "round")
    order = F.struct("tier", (-F.col("round")).alias("near"), "ord", "target", "target_name")
    best = imports.join(at.hint("merge"), ["target", "target_name"]).groupBy(*PAIR).agg(F.max_by(F.struct("tier", "target", "target_name"), order).alias("to"))
    own = known.select(*PAIR, F.lit(DECLARED).alias("tier"), F.col("module").alias("target"), F.col("name").alias("target_name"), F.lit(True).alias("done"))
    ways = stored(own.unionByName(best.select(*PAIR, "to.tier", "to.target", "to.target_name", F.lit(False).alias("done"))))
    left = -1
    while (open_ := ways.where("NOT done").count()) not in (0, left):  # what no doubling settles is on a circle, or leads to one
        left = open_
        on = ways.select(F.col("module").alias("target"), F.col("name").alias("target_name"), F.col("target").alias("t"), F.col("target_name").alias("n"), F.col("done").alias("d"))
        ways = stored(ways.where("NOT done").join(on.hint("merge"), ["target", "target_name"], "left").select(*PAIR, "tier", F.col("t").alias("target"), F.col("n").alias("target_name"), F.coalesce("d", F.lit(False)).alias("done")).unionByName(ways.where("done")))
    return ways.select(*PAIR, "tier", F.when(F.col("done"), F.col("target")).alias("item_module"), F.when(F.col("done"), F.col("target_name")).alias("item_name"))
