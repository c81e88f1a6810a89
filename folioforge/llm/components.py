"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stage, stage_table

MAX_ROUNDS = 60
#: A node of more than this share of all links is hot: 4 / HOT_SHARE nodes at most, which are broadcast.
HOT_SHARE = 1e-4
HOT_LINKS = 256


def _hung(edges: DataFrame, least: DataFrame, n_links: int) -> DataFrame:
    """(v, m) of `edges` (u, v), with the m of their u from the table `least` (x, m, n), n being the number of u's edges.

    The edges of a hot node are not brought to one task: its m is broadcast.
    """
    at = F.col("u") == F.col("x")
    hot = least.filter(F.col("n") > max(HOT_LINKS, int(HOT_SHARE * n_links))).select("x", "m").collect()  # 4 / HOT_SHARE rows at most
    if not hot:
        return edges.join(least, at).select("v", "m")
    few = F.broadcast(edges.sparkSession.createDataFrame(hot, "x long, m long"))
    rest = edges.join(few.select("x"), at, "left_anti").join(least, at)
    return edges.join(few, at).select("v", "m").unionByName(rest.select("v", "m"))


def connected_components(links: DataFrame) -> DataFrame:
    """(a, b) links of long ids -> (node, root) for every node but the roots; root is the least id of the component.

    Each round hangs every neighbour of a node below the least one it knows. Minima are aggregated before
    they are shuffled, and those of nodes with very many links are broadcast back to the links. Every
    round's edges are written to the shared folder and replace those of the last. Links of a node to
    itself and repeated links do no harm. No links: no rows.
    """
    edges = stage_table(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "links"
    )
    mark, n_links = None, edges.count()
    for _ in range(MAX_ROUNDS):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        tally = [F.min("v").alias("m"), F.count(F.lit(1)).alias("n")]
        least = stage_table(both.groupBy("u").agg(*tally).select(F.col("u").alias("x"), F.least("u", "m").alias("m"), "n"), "least")
        large = _hung(both.filter("v > u"), least, n_links).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = stage_table(large.filter("u <> v").distinct(), "large")
        below = stage_table(large.groupBy("u").agg(*tally).select(F.col("u").alias("x"), "m", "n"), "below")
        small = _hung(large, below, n_links).select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.filter("u <> v").unionByName(below.select(F.col("x").alias("u"), F.col("m").alias("v"))).distinct()
        new = stage_table(small, "links")
        for old in (edges, least, large, below):
            drop_stage(old)
        edges = new
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            break
        mark, n_links = now, now[0]
    else:
        raise RuntimeError(f"components are not settled after {MAX_ROUNDS} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
