"""Merges over many steps: final keepers, and cycles in order, both by doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.plans.diffs import merge_cycles
from folioforge.sources.shared import cut


def targets_of(merges: DataFrame) -> DataFrame:
    """(node, to) of merges (retired, target): the least target of each retired id; incomplete rows are left out."""
    rows = merges.filter("retired IS NOT NULL AND target IS NOT NULL")
    return rows.groupBy(F.col("retired").alias("node")).agg(F.min("target").alias("to"))


def keepers(merges: DataFrame) -> DataFrame:
    """(retired, keeper, steps): where the merges (retired, target) of an id end; the keeper is null for an id on a cycle, or on the way to one.

    Each round doubles the steps that an id has gone, so that chains of n ids take log n joins. An id that is
    not retired itself ends a chain.
    """
    steps = targets_of(merges)
    ends = steps.select("to").distinct().join(steps.select(F.col("node").alias("to")), "to", "left_anti")
    state = steps.join(ends.withColumn("__end", F.lit(True)), "to", "left")
    state = cut(state.select("node", "to", F.lit(1).cast("long").alias("steps"), F.coalesce("__end", F.lit(False)).alias("done")))
    n, reach = state.count(), 1
    while reach <= n and not state.filter("NOT done").limit(1).isEmpty():
        on = state.select(F.col("node").alias("to"), F.col("to").alias("further"), F.col("steps").alias("more"), F.col("done").alias("over"))
        open_ = state.filter("NOT done").join(on, "to").select("node", F.col("further").alias("to"), (F.col("steps") + F.col("more")).alias("steps"), F.col("over").alias("done"))
        state, reach = cut(state.filter("done").unionByName(open_)), reach * 2
    return state.select(F.col("node").alias("retired"), F.when(F.col("done"), F.col("to")).alias("keeper"), F.when(F.col("done"), F.col("steps")).alias("steps"))


def cycle_members(merges: DataFrame) -> DataFrame:
    """(cycle, place, member): each cycle of the merges (retired, target) from its least member on, in the order of the merges, places from 0.

    A member's distance to the least one is found by doubling, whatever the cycle's length; an id that points
    at itself is a cycle of one.
    """
    steps = targets_of(merges)
    least = cut(merge_cycles(merges))
    first = least.select(F.col("cycle").alias("node"), F.col("cycle"))
    # the members are those whom the least one reaches: each round adds the members up to twice as far
    known = cut(first.select("node", "cycle", F.lit(0).cast("long").alias("place")))
    jumps = cut(steps)
    reach = 1
    while True:
        on = known.join(jumps, "node").select(F.col("to").alias("node"), "cycle", (F.col("place") + reach).alias("place"))
        more = cut(on.join(known.select("node"), "node", "left_anti").groupBy("node", "cycle").agg(F.min("place").alias("place")))
        if more.isEmpty():
            return known.select("cycle", "place", F.col("node").alias("member"))
        known = cut(known.unionByName(more))
        further = jumps.select(F.col("node").alias("to"), F.col("to").alias("further"))
        jumps, reach = cut(jumps.join(further, "to").select("node", F.col("further").alias("to"))), reach * 2


def cycle_errors(merges: DataFrame) -> DataFrame:
    """(cycle, error): the members of each cycle in order, and the first again."""
    rows = cycle_members(merges.filter("retired <> target")).groupBy("cycle").agg(F.array_sort(F.collect_list(F.struct("place", "member"))).alias("x"))
    names = F.transform("x", lambda v: v["member"].cast("string"))
    return rows.select("cycle", F.concat(F.lit("MERGE_CYCLE: "), F.array_join(F.concat(names, F.slice(names, 1, 1)), " -> ")).alias("error"))


def moved(links: DataFrame, merges: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(distinct links with each retired identity at its final keeper, links whose identity has none)."""
    ends = keepers(merges).select(F.col("retired").alias(key), "keeper", F.lit(True).alias("__retired"))
    joined = links.join(ends, key, "left")
    lost = F.col("__retired") & F.col("keeper").isNull()
    kept = joined.filter(~F.coalesce(lost, F.lit(False))).withColumn(key, F.coalesce("keeper", key)).select(*links.columns).distinct()
    return kept, joined.filter(F.coalesce(lost, F.lit(False))).select(*links.columns)
