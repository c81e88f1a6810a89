"""Topic graphs: closures with least depth, roll-ups, cycles, redirects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.sources.shared import cut

MAX_DEPTH = 32
#: Levels after which the pairs found so far become one table again.
REWRITE = 6


def closure(edges: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """(parent, child) -> (ancestor, descendant, depth) with the least depth; cycles end, the start itself is kept where one leads back."""
    return closure_and_rest(edges, max_depth)[0]


def closure_and_rest(edges: DataFrame, max_depth: int = MAX_DEPTH) -> tuple[DataFrame, DataFrame]:
    """The closure, and (ancestor, descendant) that the walk would reach first beyond `max_depth`: none if it is complete.

    A frontier join per level; pairs that are known are cut by an anti join, so that a cycle adds nothing.
    What is known is written anew every few levels.
    """
    step = edges.select(F.col("parent").alias("ancestor"), F.col("child").alias("descendant")).distinct()
    found = step.withColumn("depth", F.lit(1))
    frontier, hop = step, step.select(F.col("ancestor").alias("descendant"), F.col("descendant").alias("next"))
    for depth in range(2, max_depth + 2):
        reached = frontier.join(hop, "descendant").select("ancestor", F.col("next").alias("descendant")).distinct()
        frontier = cut(reached.join(found, ["ancestor", "descendant"], "left_anti"))
        if depth > max_depth or frontier.isEmpty():
            break
        found = found.unionByName(frontier.withColumn("depth", F.lit(depth)))
        found = cut(found) if depth % REWRITE == 0 else found
    return found, frontier


def truncated(rest: DataFrame) -> DataFrame:
    """(ancestor) of topics from which the walk was cut off."""
    return rest.select("ancestor").distinct()


def cycles(closed: DataFrame) -> DataFrame:
    """Nodes that reach themselves."""
    return closed.filter(F.col("ancestor") == F.col("descendant")).select(F.col("ancestor").alias("node"), "depth")


def roll_up(closed: DataFrame, direct: DataFrame) -> DataFrame:
    """(topic, direct, inherited, combined) numbers of distinct items. direct: topic, item_id."""
    own = direct.distinct().withColumn("is_direct", F.lit(1))
    lifted = direct.join(closed.select(F.col("descendant").alias("topic"), "ancestor"), "topic").select(F.col("ancestor").alias("topic"), "item_id", F.lit(0).alias("is_direct"))
    per_item = own.unionByName(lifted).groupBy("topic", "item_id").agg(F.max("is_direct").alias("is_direct"))
    return per_item.groupBy("topic").agg(
        F.sum("is_direct").cast("long").alias("direct"), F.sum(1 - F.col("is_direct")).cast("long").alias("inherited"), F.count(F.lit(1)).alias("combined")
    )


def inherited_items(direct: DataFrame, descendants: DataFrame, topic) -> DataFrame:
    """Items of descendant topics that are not the topic's own: a semi and an anti join. direct: topic, item_id."""
    below = direct.join(descendants.select(F.col("descendant").alias("topic")), "topic", "left_semi").select("item_id").distinct()
    return below.join(direct.filter(F.col("topic") == topic).select("item_id"), "item_id", "left_anti")


def neighbours(related: DataFrame) -> DataFrame:
    """Both directions of undirected pairs that are stored once, low before high."""
    return related.select(F.col("low").alias("topic"), F.col("high").alias("other")).unionByName(related.select(F.col("high").alias("topic"), F.col("low").alias("other"))).distinct()


def siblings(edges: DataFrame) -> DataFrame:
    """(topic, other): children of a common parent."""
    a, b = edges.select("parent", F.col("child").alias("topic")), edges.select("parent", F.col("child").alias("other"))
    return a.join(b, "parent").filter("topic <> other").select("topic", "other").distinct()


def redirects(merges: DataFrame) -> DataFrame:
    """(retired, target) where a retired id has one target; two make none."""
    return merges.groupBy("retired").agg(F.countDistinct("target").alias("n"), F.min("target").alias("target")).filter("n = 1").drop("n")


def edge_errors(new: DataFrame, closed: DataFrame, related: DataFrame, rest: DataFrame | None = None) -> DataFrame:
    """(parent, child, error) of proposed edges: self, cycle, truncated, or already related; null where the edge is allowed.

    rest: as of `closure_and_rest`. Where the walk below the child was cut off, a cycle cannot be ruled out.
    """
    back = closed.select(F.col("descendant").alias("parent"), F.col("ancestor").alias("child"), F.lit(True).alias("closes")).distinct()
    pair = related.select(F.col("low").alias("__l"), F.col("high").alias("__h"), F.lit(True).alias("is_related"))
    rows = new.join(back, ["parent", "child"], "left").join(pair, (F.least("parent", "child") == F.col("__l")) & (F.greatest("parent", "child") == F.col("__h")), "left")
    open_ = truncated(rest).select(F.col("ancestor").alias("child"), F.lit(True).alias("is_open")) if rest is not None else None
    rows = rows.withColumn("is_open", F.lit(False)) if open_ is None else rows.join(open_, "child", "left")
    error = F.when(F.col("parent") == F.col("child"), "self").when(F.col("closes"), "cycle").when(F.col("is_open"), "truncated").when(F.col("is_related"), "related")
    return rows.select("parent", "child", error.alias("error"))


def neighbourhood(closed: DataFrame, edges: DataFrame, related: DataFrame) -> DataFrame:
    """(topic, other): descendants, ancestors, related topics and siblings of each topic, each once, itself left out."""
    down = closed.select(F.col("ancestor").alias("topic"), F.col("descendant").alias("other"))
    up = closed.select(F.col("descendant").alias("topic"), F.col("ancestor").alias("other"))
    united = down.unionByName(up).unionByName(neighbours(related)).unionByName(siblings(edges))
    return united.filter("topic <> other").distinct()


def topic_list(rolled: DataFrame, topics: DataFrame, labels: DataFrame, text: str = "") -> DataFrame:
    """(topic, label, items) of public topics with items, whose label or an alternate one contains the text.

    rolled: as of `roll_up`. topics: topic, label, is_public. labels: topic, alternate.
    """
    needle = text.strip().lower()
    rows = topics.filter("is_public").join(rolled.filter("combined > 0").select("topic", F.col("combined").alias("items")), "topic")
    if needle:
        hit = labels.filter(F.contains(F.lower("alternate"), F.lit(needle))).select("topic").distinct().withColumn("__hit", F.lit(True))
        rows = rows.join(hit, "topic", "left").filter(F.contains(F.lower("label"), F.lit(needle)) | F.col("__hit"))
    return rows.select("topic", "label", "items")


def topic_detail(topics: DataFrame, labels: DataFrame, edges: DataFrame, related: DataFrame, rolled: DataFrame) -> DataFrame:
    """(topic, label, alternates, parents, children, related, items): a topic's page, lists joined by ", " in order; each side is aggregated before it is joined."""
    def listed(rows: DataFrame, value: str, name: str) -> DataFrame:
        return rows.groupBy("topic").agg(F.array_join(F.array_sort(F.collect_set(value)), ", ").alias(name))

    sides = [
        listed(labels, "alternate", "alternates"), listed(edges.select(F.col("child").alias("topic"), F.col("parent").alias("x")), "x", "parents"),
        listed(edges.select(F.col("parent").alias("topic"), F.col("child").alias("x")), "x", "children"), listed(neighbours(related).select("topic", F.col("other").alias("x")), "x", "related"),
    ]
    rows = topics.select("topic", "label")
    for side, name in zip(sides, ("alternates", "parents", "children", "related"), strict=True):
        rows = rows.join(side, "topic", "left").withColumn(name, F.coalesce(name, F.lit("")))
    return rows.join(rolled.select("topic", F.col("combined").alias("items")), "topic", "left").withColumn("items", F.coalesce("items", F.lit(0)))


def provenance(direct: DataFrame, closed: DataFrame, topics: DataFrame) -> DataFrame:
    """(topic, item_id, is_direct, through): why an item stands under a topic: linked itself, and the topics below through which it is, ascending.

    direct: topic, item_id. topics: the topics asked for.
    """
    own = direct.join(topics.select("topic"), "topic", "left_semi").select("topic", "item_id", F.lit(None).cast("string").alias("via"))
    below = closed.join(topics.select(F.col("topic").alias("ancestor")), "ancestor", "left_semi").filter("ancestor <> descendant")
    lifted = direct.join(below.select(F.col("descendant").alias("topic"), "ancestor"), "topic").select(F.col("ancestor").alias("topic"), "item_id", F.col("topic").cast("string").alias("via"))
    return own.unionByName(lifted).groupBy("topic", "item_id").agg(F.bool_or(F.col("via").isNull()).alias("is_direct"), F.array_join(F.array_sort(F.collect_set("via")), ", ").alias("through"))
