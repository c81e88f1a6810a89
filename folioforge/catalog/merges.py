"""Merges over many steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioforge.plans import merges
from folioforge.registry import query
from folioforge.sources.tables import table

#: A customer is merged into the one a third of its number, unless that is divisible by 7; those divisible by 50 form a ring.
_MERGES = """m AS (SELECT c_custkey AS retired, CASE WHEN c_custkey % 50 = 0 THEN CASE WHEN c_custkey + 50 > (SELECT max(c_custkey) FROM customer) THEN 50 ELSE c_custkey + 50 END ELSE c_custkey // 3 END AS target
  FROM customer WHERE c_custkey % 7 <> 0 OR c_custkey % 50 = 0)"""
_WALK = "r AS (SELECT retired, target AS stop, 1::BIGINT AS steps FROM m UNION ALL SELECT r.retired, m.target, steps + 1 FROM r JOIN m ON m.retired = r.stop WHERE steps < 2000)"


def _merges(spark, sf_dir):
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer", ["c_custkey"])
    top = rows.agg(F.max("c_custkey").alias("top"))
    ring = F.when(k + 50 > F.col("top"), F.lit(50).cast("long")).otherwise(k + 50)
    return rows.crossJoin(F.broadcast(top)).filter((k % 7 != 0) | (k % 50 == 0)).select(k.alias("retired"), F.when(k % 50 == 0, ring).otherwise(F.floor(k / 3)).alias("target"))  # one row


@query("merge_keepers", f"WITH RECURSIVE {_MERGES}, {_WALK}, e AS (SELECT retired, stop, steps FROM r WHERE stop NOT IN (SELECT retired FROM m)) SELECT m.retired, e.stop AS keeper, e.steps FROM m LEFT JOIN e ON e.retired = m.retired")
def _(spark, sf_dir):
    return merges.keepers(_merges(spark, sf_dir))


@query("merge_cycle_members", f"WITH RECURSIVE {_MERGES}, w AS (SELECT 50::BIGINT AS member, 0::BIGINT AS place UNION ALL SELECT m.target, place + 1 FROM w JOIN m ON m.retired = w.member WHERE m.target <> 50) SELECT 50::BIGINT AS cycle, place, member FROM w")
def _(spark, sf_dir):
    return merges.cycle_members(_merges(spark, sf_dir))


@query(
    "merge_moves",
    f"""WITH RECURSIVE {_MERGES}, {_WALK}, e AS (SELECT retired, stop FROM r WHERE stop NOT IN (SELECT retired FROM m))
SELECT DISTINCT coalesce(e.stop, o_custkey) AS person, o_orderpriority AS label FROM orders LEFT JOIN m ON m.retired = o_custkey LEFT JOIN e ON e.retired = o_custkey WHERE m.retired IS NULL OR e.stop IS NOT NULL""",
)
def _(spark, sf_dir):
    links = table(spark, sf_dir, "orders", ["o_custkey", "o_orderpriority"]).toDF("person", "label")
    return merges.moved(links, _merges(spark, sf_dir), "person")[0]
