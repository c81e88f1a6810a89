"""Topic graph queries over regions, nations and customers, and over derived edges."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioforge.operators import graph
from folioforge.registry import query
from folioforge.sources.tables import table

_EDGES = """edges AS (SELECT 'r' || n_regionkey AS parent, 'n' || n_nationkey AS child FROM nation
  UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey FROM customer)"""
_CLOSED = f"""WITH RECURSIVE {_EDGES}, walk AS (SELECT parent AS ancestor, child AS descendant, 1 AS depth FROM edges
  UNION SELECT w.ancestor, e.child, w.depth + 1 FROM walk w JOIN edges e ON w.descendant = e.parent WHERE w.depth < 32),
closed AS (SELECT ancestor, descendant, min(depth) AS depth FROM walk GROUP BY ALL)"""


def edges(spark, sf_dir):
    mark = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    upper = table(spark, sf_dir, "nation", ["n_nationkey", "n_regionkey"]).select(mark("r", "n_regionkey").alias("parent"), mark("n", "n_nationkey").alias("child"))
    lower = table(spark, sf_dir, "customer", ["c_custkey", "c_nationkey"]).select(mark("n", "c_nationkey").alias("parent"), mark("c", "c_custkey").alias("child"))
    return upper.unionByName(lower)


@query("topic_closure", f"{_CLOSED} SELECT ancestor, descendant, depth FROM closed")
def _(spark, sf_dir):
    return graph.closure(edges(spark, sf_dir))


_DIRECT = "direct AS (SELECT DISTINCT 'c' || o_custkey AS topic, o_orderkey AS item_id FROM orders UNION SELECT 'n' || o_orderkey % 25, o_orderkey FROM orders WHERE o_orderkey % 10 = 0)"


def direct(spark, sf_dir):
    orders = table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey"])
    own = orders.select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("topic"), F.col("o_orderkey").alias("item_id"))
    more = orders.filter("o_orderkey % 10 = 0").select(F.concat(F.lit("n"), (F.col("o_orderkey") % 25).cast("string")).alias("topic"), F.col("o_orderkey").alias("item_id"))
    return own.unionByName(more).distinct()


@query(
    "topic_rollup_counts",
    f"""{_CLOSED}, {_DIRECT}, a AS (SELECT topic, item_id, 1 AS d FROM direct UNION ALL SELECT c.ancestor, d.item_id, 0 FROM direct d JOIN closed c ON c.descendant = d.topic),
p AS (SELECT topic, item_id, max(d) AS d FROM a GROUP BY ALL)
SELECT topic, sum(d)::BIGINT AS direct, sum(1 - d)::BIGINT AS inherited, count(*)::BIGINT AS combined FROM p GROUP BY topic""",
)
def _(spark, sf_dir):
    return graph.roll_up(graph.closure(edges(spark, sf_dir)), direct(spark, sf_dir))


@query(
    "inherited_items",
    f"""{_CLOSED}, {_DIRECT} SELECT DISTINCT item_id FROM direct WHERE topic IN (SELECT descendant FROM closed WHERE ancestor = 'n3')
  AND item_id NOT IN (SELECT item_id FROM direct WHERE topic = 'n3')""",
)
def _(spark, sf_dir):
    below = graph.closure(edges(spark, sf_dir)).filter("ancestor = 'n3'")
    return graph.inherited_items(direct(spark, sf_dir), below, "n3")


_LOOP = "edges AS (SELECT DISTINCT n_nationkey AS parent, (n_nationkey * 7 + 3) % 25 AS child FROM nation)"


@query(
    "cycle_check",
    f"""WITH RECURSIVE {_LOOP}, walk AS (SELECT parent AS ancestor, child AS descendant, 1 AS depth FROM edges
  UNION SELECT w.ancestor, e.child, w.depth + 1 FROM walk w JOIN edges e ON w.descendant = e.parent WHERE w.depth < 32)
SELECT ancestor AS node, min(depth) AS depth FROM walk WHERE ancestor = descendant GROUP BY 1""",
)
def _(spark, sf_dir):
    k = F.col("n_nationkey")
    loop = table(spark, sf_dir, "nation", ["n_nationkey"]).select(k.alias("parent"), ((k * 7 + 3) % 25).alias("child"))
    return graph.cycles(graph.closure(loop))


_RELATED = "related AS (SELECT DISTINCT least(l_suppkey, l_partkey % 100) AS low, greatest(l_suppkey, l_partkey % 100) AS high FROM lineitem WHERE l_suppkey <> l_partkey % 100)"


def related(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem", ["l_suppkey", "l_partkey"]).withColumn("o", F.col("l_partkey") % 100).filter("l_suppkey <> o")
    return lines.select(F.least("l_suppkey", "o").alias("low"), F.greatest("l_suppkey", "o").alias("high")).distinct()


@query("related_topics", f"WITH {_RELATED} SELECT low AS topic, high AS other FROM related UNION SELECT high, low FROM related")
def _(spark, sf_dir):
    return graph.neighbours(related(spark, sf_dir))


@query("sibling_topics", "SELECT DISTINCT a.n_nationkey AS topic, b.n_nationkey AS other FROM nation a JOIN nation b USING (n_regionkey) WHERE a.n_nationkey <> b.n_nationkey")
def _(spark, sf_dir):
    return graph.siblings(table(spark, sf_dir, "nation", ["n_nationkey", "n_regionkey"]).select(F.col("n_regionkey").alias("parent"), F.col("n_nationkey").alias("child")))


@query(
    "retired_redirects",
    "SELECT l_orderkey AS retired, min(l_suppkey) AS target FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_suppkey) = 1",
)
def _(spark, sf_dir):
    merges = table(spark, sf_dir, "lineitem", ["l_orderkey", "l_suppkey"])
    return graph.redirects(merges.select(F.col("l_orderkey").alias("retired"), F.col("l_suppkey").alias("target")))


@query(
    "proposed_edge_errors",
    f"""{_CLOSED}, new AS (SELECT 'c' || c_custkey AS parent, 'r' || c_custkey % 5 AS child FROM customer WHERE c_custkey % 4 = 0
  UNION ALL SELECT 'n' || n_nationkey, 'n' || (n_nationkey + n_nationkey % 2) FROM nation),
related AS (SELECT 'n' || n_nationkey AS low, 'n' || (n_nationkey + 1) AS high FROM nation WHERE n_nationkey % 10 = 1)
SELECT n.parent, n.child, CASE WHEN n.parent = n.child THEN 'self'
  WHEN EXISTS (SELECT 1 FROM closed c WHERE c.ancestor = n.child AND c.descendant = n.parent) THEN 'cycle'
  WHEN EXISTS (SELECT 1 FROM related r WHERE r.low = least(n.parent, n.child) AND r.high = greatest(n.parent, n.child)) THEN 'related' END AS error FROM new n""",
)
def _(spark, sf_dir):
    k, c = F.col("n_nationkey"), F.col("c_custkey")
    mark = lambda letter, x: F.concat(F.lit(letter), x.cast("string"))
    nation = table(spark, sf_dir, "nation", ["n_nationkey"])
    new = table(spark, sf_dir, "customer", ["c_custkey"]).filter("c_custkey % 4 = 0").select(mark("c", c).alias("parent"), mark("r", c % 5).alias("child"))
    new = new.unionByName(nation.select(mark("n", k).alias("parent"), mark("n", k + k % 2).alias("child")))
    pairs = nation.filter("n_nationkey % 10 = 1").select(mark("n", k).alias("low"), mark("n", k + 1).alias("high"))
    closed, rest = graph.closure_and_rest(edges(spark, sf_dir))
    return graph.edge_errors(new, closed, pairs, rest)
