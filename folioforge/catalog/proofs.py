"""Correspondence of snapshots: proofs with their first refusal, corresponding lines, mappings that may be carried over.

A conversation stands for a snapshot, three turns for a page, a turn for a line; ids, states and moments follow from the numbers.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from folioforge.plans import proofs
from folioforge.registry import query
from folioforge.sources.tables import table

_SNAPSHOTS = """c AS (SELECT DISTINCT conv_id AS snapshot FROM conversations), s AS (SELECT snapshot, snapshot // 10 AS document, CASE WHEN snapshot % 19 = 3 THEN 'PENDING' ELSE 'READY' END AS status,
  CASE WHEN snapshot % 17 = 2 THEN 'v1' ELSE 'v2' END AS parser, snapshot // 2 AS created FROM c),
g AS (SELECT DISTINCT conv_id AS snapshot, turn // 3 AS page FROM conversations WHERE turn < 6),
n AS (SELECT conv_id AS snapshot, turn // 3 AS page, turn AS position, conv_id * 1000 + turn AS line,
  CASE WHEN conv_id % 13 = 4 AND turn = 1 THEN '' WHEN conv_id % 11 = 5 AND turn = 2 THEN 'l1' WHEN conv_id % 23 = 6 AND turn = 0 THEN 'x' ELSE 'l' || turn END AS id
  FROM conversations WHERE turn < 6 AND NOT (conv_id % 29 = 7 AND turn = 1) AND turn <> 4),
l AS (SELECT *, row_number() OVER (PARTITION BY snapshot, page ORDER BY position, line) AS place FROM n)"""
#: The first reason of each pair, every level by itself.
_PROOFS = f"""{_SNAPSHOTS}, h AS (SELECT p.source, p.target, CASE WHEN a.document <> b.document THEN 1 WHEN a.status <> 'READY' THEN 2 WHEN b.status <> 'READY' THEN 3 WHEN a.parser <> b.parser THEN 4 END AS early
  FROM p JOIN s a ON a.snapshot = p.source JOIN s b ON b.snapshot = p.target),
gs AS (SELECT snapshot, list(page ORDER BY page) AS pages FROM g GROUP BY 1),
gd AS (SELECT source, target, 5 AS level, (SELECT min(x) FROM (SELECT unnest(list_filter(list_concat(a.pages, b.pages), lambda x: NOT (list_contains(a.pages, x) AND list_contains(b.pages, x)))) AS x)) AS page
  FROM h JOIN gs a ON a.snapshot = source JOIN gs b ON b.snapshot = target WHERE a.pages <> b.pages),
f AS (SELECT snapshot, page, place, CASE WHEN id = '' THEN 'MISSING_PROVIDER_LINE_ID' ELSE 'DUPLICATE_PROVIDER_LINE_ID' END AS refusal FROM
  (SELECT *, row_number() OVER (PARTITION BY snapshot, page, id ORDER BY place) AS again FROM l) WHERE id = '' OR again > 1 QUALIFY row_number() OVER (PARTITION BY snapshot ORDER BY page, place) = 1),
m AS (SELECT coalesce(a.source, b.source) AS source, coalesce(a.target, b.target) AS target, coalesce(a.page, b.page) AS page, coalesce(a.place, b.place) AS place, a.id AS aid, b.id AS bid,
  a.line AS source_line, b.line AS target_line, a.position AS source_position, b.position AS target_position
  FROM (SELECT h.source, h.target, l.* FROM h JOIN l ON l.snapshot = source) a FULL JOIN (SELECT h.source, h.target, l.* FROM h JOIN l ON l.snapshot = target) b
  ON a.source = b.source AND a.target = b.target AND a.page = b.page AND a.place = b.place),
u AS (SELECT source, target, early AS level, NULL::BIGINT AS page, NULL::BIGINT AS place, ['DIFFERENT_DOCUMENT', 'SOURCE_NOT_READY', 'TARGET_NOT_READY', 'PARSER_VERSION_MISMATCH'][early] AS refusal FROM h WHERE early IS NOT NULL
  UNION ALL SELECT source, target, level, page, NULL, 'PAGE_STRUCTURE_MISMATCH' FROM gd
  UNION ALL SELECT source, target, 6, page, place, refusal FROM h JOIN f ON snapshot = source UNION ALL SELECT source, target, 7, page, place, refusal FROM h JOIN f ON snapshot = target
  UNION ALL SELECT source, target, 8, page, place, 'CONTRIBUTING_LINE_COUNT_MISMATCH' FROM m WHERE aid IS NULL OR bid IS NULL
  UNION ALL SELECT source, target, 9, page, place, 'IDENTITY_SEQUENCE_MISMATCH' FROM m WHERE aid <> bid),
r AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY source, target ORDER BY level, page, place) = 1),
proof AS (SELECT h.source, h.target, r.refusal, r.page, r.place FROM h LEFT JOIN r USING (source, target))"""
_NEXT = "p AS (SELECT DISTINCT conv_id AS source, conv_id + unnest([1, 2, 3, 5]) AS target FROM conversations)"


def tables(spark, sf_dir):
    """(snapshots, pages, lines)"""
    turns, c, t = table(spark, sf_dir, "conversations", ["conv_id", "turn"]), F.col("conv_id"), F.col("turn")
    snapshots = turns.select(c.alias("snapshot")).distinct().select(
        "snapshot", F.floor(F.col("snapshot") / 10).alias("document"), F.when(F.col("snapshot") % 19 == 3, "PENDING").otherwise("READY").alias("status"),
        F.when(F.col("snapshot") % 17 == 2, "v1").otherwise("v2").alias("parser"), F.floor(F.col("snapshot") / 2).alias("created"),
    )
    first = turns.filter(t < 6).select(c.alias("snapshot"), F.floor(t / 3).alias("page"), "turn", c, (c * 1000 + t).alias("line"))
    line_id = F.when((c % 13 == 4) & (t == 1), " ").when((c % 11 == 5) & (t == 2), " l1").when((c % 23 == 6) & (t == 0), "x").otherwise(F.concat(F.lit("l"), t.cast("string")))
    lines = first.filter(~((c % 29 == 7) & (t == 1))).select("snapshot", "page", t.alias("position"), "line", line_id.alias("line_id"), (t != 4).alias("contributes"))
    return snapshots, first.select("snapshot", "page"), lines


def _next(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations", ["conv_id"]).distinct()
    return rows.select(F.col("conv_id").alias("source"), F.explode(F.transform(F.array(*map(F.lit, (1, 2, 3, 5))), lambda x: F.col("conv_id") + x)).alias("target"))


@query("correspondence_proofs", f"WITH {_NEXT}, {_PROOFS} SELECT * FROM proof")
def _(spark, sf_dir):
    return proofs.prove(_next(spark, sf_dir), *tables(spark, sf_dir))[0]


@query(
    "correspondence_lines",
    f"WITH {_NEXT}, {_PROOFS} SELECT source, target, m.page, m.place, aid AS line_id, source_line, target_line, source_position, target_position FROM m JOIN proof USING (source, target) WHERE refusal IS NULL",
)
def _(spark, sf_dir):
    return proofs.prove(_next(spark, sf_dir), *tables(spark, sf_dir))[1]


@query(
    "transferable_mappings",
    f"""WITH p AS (SELECT DISTINCT a.conv_id AS source, b.conv_id AS target FROM conversations a JOIN conversations b ON a.conv_id // 10 = b.conv_id // 10 AND a.conv_id // 2 < b.conv_id // 2 WHERE a.conv_id % 4 <> 1), {_PROOFS}
SELECT target, source * 7 AS mapping, source, row_number() OVER (PARTITION BY target ORDER BY source // 2 DESC, source DESC) AS place FROM proof WHERE refusal IS NULL""",
)
def _(spark, sf_dir):
    snapshots, pages, lines = tables(spark, sf_dir)
    mappings = snapshots.filter("snapshot % 4 <> 1").select((F.col("snapshot") * 7).alias("mapping"), "snapshot")
    return proofs.transferable(snapshots.select("snapshot"), mappings, snapshots, pages, lines)
