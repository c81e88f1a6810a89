"""Reviews, backfills, contracts and page geometry.

Second sides (links, mappings, reviews) are derived from the test tables by id; every table is read whole.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from folioforge.functions import contracts
from folioforge.plans import reviews
from folioforge.registry import query
from folioforge.sources import files
from folioforge.sources.tables import table


@query(
    "photo_link_plan",
    """WITH l AS (SELECT l_orderkey AS photo_id, l_suppkey AS person_id FROM lineitem), p AS (SELECT o_orderkey AS photo_id, CASE WHEN o_orderkey % 17 <> 0 THEN o_custkey END AS item_id FROM orders),
k AS (SELECT DISTINCT c_custkey AS item_id, c_custkey % 100 AS person_id FROM customer)
SELECT l.photo_id, l.person_id, CASE WHEN p.item_id IS NULL THEN 'ERROR' WHEN k.item_id IS NOT NULL THEN 'NOOP' ELSE 'CREATE' END AS status
FROM l LEFT JOIN p USING (photo_id) LEFT JOIN k ON k.item_id = p.item_id AND k.person_id = l.person_id""",
)
def _(spark, sf_dir):
    links = table(spark, sf_dir, "lineitem", ["l_orderkey", "l_suppkey"]).select(F.col("l_orderkey").alias("photo_id"), F.col("l_suppkey").alias("person_id"))
    photos = table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey"]).select(F.col("o_orderkey").alias("photo_id"), F.when(F.col("o_orderkey") % 17 != 0, F.col("o_custkey")).alias("item_id"))
    known = table(spark, sf_dir, "customer", ["c_custkey"]).select(F.col("c_custkey").alias("item_id"), (F.col("c_custkey") % 100).alias("person_id"))
    return reviews.link_plan(links, photos, known)


_REVIEWS = """r AS (SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'APPROVE' WHEN 1 THEN 'MERGE' ELSE 'REJECT' END AS status, p_name AS canonical,
  CASE WHEN p_partkey % 11 = 0 THEN NULL WHEN p_partkey % 13 = 0 THEN p_partkey ELSE p_partkey * 2 - p_partkey % 5 END AS target FROM part)"""


@query(
    "merge_review_errors",
    f"""WITH {_REVIEWS} SELECT a.id, CASE WHEN a.target IS NULL THEN 'missing_target' WHEN a.target = a.id THEN 'self' WHEN b.id IS NULL THEN 'absent' WHEN b.status <> 'APPROVE' THEN 'not_approved'
  WHEN a.canonical IS DISTINCT FROM b.canonical THEN 'canonical' END AS error FROM r a LEFT JOIN r b ON a.target = b.id WHERE a.status = 'MERGE'""",
)
def _(spark, sf_dir):
    k = F.col("p_partkey")
    status = F.when(k % 3 == 0, "APPROVE").when(k % 3 == 1, "MERGE").otherwise("REJECT")
    target = F.when(k % 11 == 0, None).when(k % 13 == 0, k).otherwise(k * 2 - k % 5)
    return reviews.merge_errors(table(spark, sf_dir, "part", ["p_partkey", "p_name"]).select(k.alias("id"), status.alias("status"), F.col("p_name").alias("canonical"), target.alias("target")))


@query(
    "import_plan",
    """SELECT c.c_custkey AS k, CASE WHEN s.s_suppkey IS NULL THEN 'ADD' WHEN c.c_nationkey = s.s_nationkey THEN 'NOOP' ELSE 'REPAIR' END AS status FROM customer c LEFT JOIN supplier s ON c.c_custkey = s.s_suppkey""",
)
def _(spark, sf_dir):
    wanted = table(spark, sf_dir, "customer", ["c_custkey", "c_nationkey"]).toDF("k", "nation")
    return reviews.import_plan(wanted, table(spark, sf_dir, "supplier", ["s_suppkey", "s_nationkey"]).toDF("k", "nation"), "k", "nation")


@query(
    "break_remap",
    """WITH b AS (SELECT conv_id AS snapshot, turn AS line_id FROM conversations WHERE role = 'user'), m AS (SELECT conv_id AS snapshot, turn AS line_id, CASE WHEN conv_id % 6 = 0 AND turn = 2 THEN 0 ELSE turn END AS target FROM conversations WHERE NOT (conv_id % 4 = 1 AND turn = 0))
SELECT snapshot, CASE WHEN count(*) FILTER (target IS NULL) = 0 AND count(DISTINCT target) = count(*) THEN string_agg(target, ',' ORDER BY target) END AS targets FROM b LEFT JOIN m USING (snapshot, line_id) GROUP BY snapshot""",
)
def _(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations", ["conv_id", "turn", "role"])
    breaks = turns.filter("role = 'user'").select(F.col("conv_id").alias("snapshot"), F.col("turn").alias("line_id"))
    target = F.when((F.col("conv_id") % 6 == 0) & (F.col("turn") == 2), 0).otherwise(F.col("turn"))
    mapping = turns.filter("NOT (conv_id % 4 = 1 AND turn = 0)").select(F.col("conv_id").alias("snapshot"), F.col("turn").alias("line_id"), target.alias("target"))
    return reviews.remap(breaks, mapping).select("snapshot", F.array_join("targets", ",").alias("targets"))


@query(
    "earlier_snapshots",
    """WITH s AS (SELECT o_orderkey AS snapshot_id, o_custkey AS document_id, o_orderdate AS created FROM orders)
SELECT a.snapshot_id AS newer, b.snapshot_id AS older, row_number() OVER (PARTITION BY a.snapshot_id ORDER BY b.created DESC, b.snapshot_id)::INTEGER AS place FROM s a JOIN s b USING (document_id) WHERE b.created < a.created""",
)
def _(spark, sf_dir):
    return reviews.earlier(table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderdate"]).toDF("snapshot_id", "document_id", "created"))


@query(
    "person_candidates",
    """WITH n AS (SELECT DISTINCT ' ' || upper(p_name) AS name FROM part), k AS (SELECT lower(trim(p_name)) AS k, p_partkey AS person_id FROM part UNION SELECT lower(trim(p_brand)), p_partkey FROM part)
SELECT DISTINCT n.name, k.person_id FROM n JOIN k ON lower(trim(n.name)) = k.k""",
)
def _(spark, sf_dir):
    part = table(spark, sf_dir, "part", ["p_partkey", "p_name", "p_brand"])
    names = part.select(F.concat(F.lit(" "), F.upper("p_name")).alias("name")).distinct()
    return reviews.candidates(names, part.select(F.col("p_name").alias("name"), F.col("p_partkey").alias("person_id")), part.select(F.col("p_brand").alias("alias"), F.col("p_partkey").alias("person_id")))


_GEOMETRY = """g AS (SELECT l_orderkey AS page, l_partkey % 50 AS line_id, l_quantity - 3 AS x0, (l_suppkey % 40)::DOUBLE AS y0, l_quantity + l_linenumber - 2 AS x1, (l_suppkey % 40 + l_partkey % 9)::DOUBLE AS y1 FROM lineitem),
c AS (SELECT page, count(*)::BIGINT AS lines, count(*) FILTER (x0 >= 0 AND y0 >= 0 AND x1 <= 50 AND y1 <= 44 AND x1 > x0 AND y1 > y0)::BIGINT AS valid, (count(line_id) - count(DISTINCT line_id))::BIGINT AS duplicate_ids,
  count(*) FILTER (NOT (x0 >= 0 AND y0 >= 0 AND x1 <= 50 AND y1 <= 44))::BIGINT AS out_of_bounds FROM g GROUP BY page),
p AS (SELECT *, CASE WHEN valid = lines THEN 'FULL' WHEN valid > 0 THEN 'PARTIAL' ELSE 'NONE' END AS capability FROM c)"""


def geometry(spark, sf_dir):
    q, s, p = F.col("l_quantity"), F.col("l_suppkey") % 40, F.col("l_partkey")
    return table(spark, sf_dir, "lineitem", ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity"]).select(
        F.col("l_orderkey").alias("page"), (p % 50).alias("line_id"), (q - 3).alias("x0"), s.cast("double").alias("y0"), (q + F.col("l_linenumber") - 2).alias("x1"), (s + p % 9).cast("double").alias("y1"),
        F.lit(50.0).alias("width"), F.lit(44.0).alias("height"),
    )


@query("page_capability", f"WITH {_GEOMETRY} SELECT page, lines, valid, duplicate_ids, out_of_bounds, capability FROM p")
def _(spark, sf_dir):
    return reviews.capability(geometry(spark, sf_dir))


@query("document_capability", f"WITH {_GEOMETRY} SELECT page // 4 AS document, CASE WHEN min(capability) = max(capability) THEN min(capability) ELSE 'MIXED' END AS capability FROM p GROUP BY 1")
def _(spark, sf_dir):
    return reviews.document_capability(reviews.capability(geometry(spark, sf_dir)), F.floor(F.col("page") / 4))


_SPANS = 's AS (SELECT conv_id AS snapshot, (turn * 100 + conv_id % 3)::BIGINT AS a, (turn * 100 + least(length(coalesce(text, \'\')), 90 + conv_id % 20))::BIGINT + conv_id % 3 AS b FROM conversations)'


@query(
    "text_segments",
    f"""WITH {_SPANS}, w AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY snapshot ORDER BY a, b), 0) AS before FROM s), g AS (SELECT * FROM w WHERE snapshot NOT IN (SELECT snapshot FROM w WHERE a < before))
SELECT snapshot, a AS start, b AS "end", 'line' AS kind FROM g UNION ALL SELECT snapshot, before, a, 'gap' FROM g WHERE a > before""",
)
def _(spark, sf_dir):
    k, start = F.col("conv_id") % 3, F.col("turn") * 100
    size = F.least(F.length(F.coalesce("text", F.lit(""))).cast("long"), 90 + F.col("conv_id") % 20)
    return reviews.segments(table(spark, sf_dir, "conversations", ["conv_id", "turn", "text"]).select(F.col("conv_id").alias("snapshot"), (start + k).alias("char_start"), (start + size + k).alias("char_end")))


@query(
    "group_representatives",
    """WITH m AS (SELECT l_suppkey AS g, l_orderkey AS item_id, row_number() OVER (PARTITION BY l_suppkey, l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice) AS ordinal, l_orderkey % 97 = 5 AS unusual FROM lineitem),
r AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY g ORDER BY item_id, ordinal) = 1 THEN 1 WHEN row_number() OVER (PARTITION BY g ORDER BY item_id DESC, ordinal DESC) = 1 THEN 2
  WHEN row_number() OVER (PARTITION BY g ORDER BY unusual DESC, item_id, ordinal) = 1 AND unusual THEN 3 WHEN ordinal = 1 THEN 4 END AS k FROM m)
SELECT g AS "group", item_id, ['first', 'last', 'unusual', 'new_item'][k] AS role FROM r WHERE k IS NOT NULL QUALIFY row_number() OVER (PARTITION BY g ORDER BY k, item_id, ordinal) <= 4""",
)
def _(spark, sf_dir):
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("l_suppkey", "l_orderkey").orderBy("l_linenumber", "l_partkey", "l_extendedprice"))
    members = table(spark, sf_dir, "lineitem", ["l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"]).select(
        F.col("l_suppkey").alias("group"), F.col("l_orderkey").alias("item_id"), place.alias("ordinal"), (F.col("l_orderkey") % 97 == 5).alias("unusual")
    )
    return reviews.representatives(members).select("group", "item_id", "role")


@query("single_targets", "SELECT l_orderkey AS k, min(l_suppkey) AS t, CASE WHEN count(DISTINCT l_suppkey) > 1 THEN 'ambiguous' END AS error FROM lineitem GROUP BY 1")
def _(spark, sf_dir):
    return reviews.single_target(table(spark, sf_dir, "lineitem", ["l_orderkey", "l_suppkey"]).toDF("k", "t"), "k", "t")


@query(
    "upload_types",
    """SELECT page_id, CASE WHEN page_id % 4 = 0 THEN 'image/jpeg' WHEN page_id % 4 = 1 THEN 'text/html' WHEN page_id % 4 = 2 THEN NULL ELSE 'application/pdf' END AS mime FROM pages""",
)
def _(spark, sf_dir):
    k = F.col("page_id")
    raw = F.when(k % 4 == 0, " IMAGE/JPG ").when(k % 4 == 1, "text/html; charset=utf-8").when(k % 4 == 2, "  ").otherwise("application/x-pdf")
    return table(spark, sf_dir, "pages", ["page_id"]).select("page_id", contracts.mime_type(raw).alias("mime"))


@query(
    "payload_errors",
    """WITH t AS (SELECT conv_id, count(*) AS n, bool_or(regexp_matches(coalesce(text, ''), '\\S')) AS has_text FROM conversations GROUP BY 1)
SELECT conv_id, CASE WHEN conv_id % 7 = 0 THEN 'version' WHEN conv_id % 5 = 0 THEN 'page_count' WHEN NOT has_text THEN 'no_text' END AS error FROM t""",
)
def _(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations", ["conv_id", "turn", "text"])
    pages = F.array_sort(F.collect_list(F.struct((F.col("turn") + 1).cast("int").alias("page_index"), F.coalesce("text", F.lit("")).alias("text"))))
    made = turns.groupBy("conv_id").agg(pages.alias("pages"))
    raw = F.to_json(F.struct(F.when(F.col("conv_id") % 7 == 0, 2).otherwise(1).alias("schema_version"), "pages"))
    expected = F.size("pages") + F.when(F.col("conv_id") % 5 == 0, 1).otherwise(0)
    return made.select("conv_id", contracts.payload_error(raw, expected).alias("error"))


@query(
    "snapshot_fingerprints",
    """WITH h AS (SELECT conv_id, string_agg(sha256(coalesce(text, '')), chr(10) ORDER BY turn) AS x FROM conversations GROUP BY 1) SELECT conv_id, sha256(x) AS print, sha256(sha256(x) || '|' || sha256('source') || '|' || sha256('route')) AS identity FROM h""",
)
def _(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations", ["conv_id", "turn", "text"])
    pages = F.array_sort(F.collect_list(F.struct("turn", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"))))
    hashes = turns.groupBy("conv_id").agg(pages.alias("p")).select("conv_id", F.transform("p", lambda x: x["sha"]).alias("h"))
    return hashes.select("conv_id", contracts.fingerprint(F.col("h")).alias("print"), contracts.attempt_identity(F.col("h"), F.lit("source"), F.lit("route")).alias("identity"))


@query(
    "text_revisions",
    """WITH h AS (SELECT doc_id AS result_id, 1 AS revision, lang AS text FROM documents UNION ALL SELECT doc_id, 2, source FROM documents WHERE doc_id % 3 = 0),
e AS (SELECT doc_id AS result_id, (doc_id % 2 + 1)::INT AS base, CASE WHEN doc_id % 5 = 0 THEN lang ELSE lang || source END AS text FROM documents),
n AS (SELECT result_id, max(revision) AS revision, arg_max(text, revision) AS text FROM h GROUP BY 1)
SELECT e.result_id, (base + 1)::INTEGER AS revision, e.text FROM e JOIN n ON e.result_id = n.result_id AND e.base = n.revision WHERE e.text <> n.text""",
)
def _(spark, sf_dir):
    docs, k = table(spark, sf_dir, "documents", ["doc_id", "lang", "source"]), F.col("doc_id")
    history = docs.select(k.alias("result_id"), F.lit(1).alias("revision"), F.col("lang").alias("text")).unionByName(docs.filter("doc_id % 3 = 0").select(k.alias("result_id"), F.lit(2).alias("revision"), F.col("source").alias("text")))
    edits = docs.select(k.alias("result_id"), (k % 2 + 1).cast("int").alias("base_revision"), F.when(k % 5 == 0, F.col("lang")).otherwise(F.concat("lang", "source")).alias("text"))
    return files.revise(history, edits)


@query(
    "change_log",
    """SELECT c_custkey AS k, 'MOVE' AS action, '{"nation":' || c_nationkey || '}' AS before, '{"nation":' || c_nationkey + 1 || '}' AS after FROM customer WHERE c_nationkey % 2 = 0""",
)
def _(spark, sf_dir):
    before = table(spark, sf_dir, "customer", ["c_custkey", "c_nationkey"]).toDF("k", "nation")
    after = before.withColumn("nation", F.when(F.col("nation") % 2 == 0, F.col("nation") + 1).otherwise(F.col("nation")))
    return files.events_of(before, after, "k", "MOVE")


@query("page_xml_lines")
def _(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations", ["conv_id", "turn", "text"])
    clean = F.regexp_replace(F.coalesce("text", F.lit("")), "[<>&]", " ")
    line = F.concat(F.lit("<TextLine id='l"), F.col("turn"), F.lit("'><Coords points='0,0 9,0 9,9'/><TextEquiv><Unicode>"), clean, F.lit("</Unicode></TextEquiv></TextLine>"))
    parts = F.array_sort(F.collect_list(F.struct("turn", line.alias("line"))))
    body = turns.groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda p: p["line"]), "").alias("b"))
    return files.page_xml_lines(body.select(F.col("conv_id").alias("page"), F.concat(F.lit("<PcGts xmlns='http://x'><Page>"), "b", F.lit("</Page></PcGts>")).alias("xml")))


@query(
    "merge_previews",
    """WITH m AS (SELECT c_custkey AS retired, c_custkey - 1 AS target FROM customer WHERE c_custkey % 10 = 7), l AS (SELECT DISTINCT o_custkey AS identity, o_orderkey % 200 AS item_id FROM orders),
s AS (SELECT DISTINCT o_custkey AS identity, o_orderkey % 50 AS item_id, o_orderstatus AS action FROM orders)
SELECT retired, target, (SELECT count(*) FROM l WHERE identity = retired AND item_id NOT IN (SELECT item_id FROM l k WHERE k.identity = target))::BIGINT AS moved,
  (SELECT count(*) FROM l WHERE identity = retired AND item_id IN (SELECT item_id FROM l k WHERE k.identity = target))::BIGINT AS dropped,
  (SELECT count(*) FROM s a JOIN s b ON a.item_id = b.item_id AND a.action = b.action WHERE a.identity = retired AND b.identity = target)::BIGINT AS blockers FROM m""",
)
def _(spark, sf_dir):
    orders = table(spark, sf_dir, "orders", ["o_custkey", "o_orderkey", "o_orderstatus"])
    links = orders.select(F.col("o_custkey").alias("identity"), (F.col("o_orderkey") % 200).alias("item_id")).distinct()
    pending = orders.select(F.col("o_custkey").alias("identity"), (F.col("o_orderkey") % 50).alias("item_id"), F.col("o_orderstatus").alias("action")).distinct()
    merges = table(spark, sf_dir, "customer", ["c_custkey"]).filter("c_custkey % 10 = 7").select(F.col("c_custkey").alias("retired"), (F.col("c_custkey") - 1).alias("target"))
    return reviews.merge_preview(links, pending, merges)


@query(
    "overlap_cleanup_reasons",
    """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_partkey % 11 = 0 THEN 'stale_source' WHEN l_suppkey % 13 = 0 THEN 'wrong_normalization_version' WHEN l_returnflag = 'N' THEN 'not_currently_accepted'
  WHEN l_quantity < 10 THEN 'not_contained' WHEN l_linestatus = 'O' THEN 'mixed_or_nonpending_status' WHEN l_discount > 0.08 THEN 'has_authoritative_occurrence' WHEN l_tax < 0.01 THEN 'missing_detect_event' ELSE 'eligible' END AS reason FROM lineitem""",
)
def _(spark, sf_dir):
    c = F.col
    lines = table(spark, sf_dir, "lineitem").withColumns({
        "sha": F.lit("a"), "current_sha": F.when(c("l_partkey") % 11 == 0, "b").otherwise("a"), "version": F.when(c("l_suppkey") % 13 == 0, 2).otherwise(1), "accepted": c("l_returnflag") != "N",
        "contained": c("l_quantity") >= 10, "all_pending": c("l_linestatus") != "O", "authoritative": c("l_discount") > 0.08, "detected": c("l_tax") >= 0.01,
    })
    return reviews.overlap_reasons(lines).select("l_orderkey", "l_linenumber", "l_partkey", "reason")


@query(
    "run_lineages",
    """WITH r AS (SELECT user_id AS document, event_type AS collection, event_id % 3 AS model, CASE WHEN event_id % 4 > 0 THEN event_id // 3 END AS remote, value > 90 AS verified FROM events),
s AS (SELECT remote FROM r WHERE remote IS NOT NULL GROUP BY 1 HAVING count(DISTINCT (document, collection, model)) > 1)
SELECT document, collection, model, count(*)::BIGINT AS runs, count(DISTINCT remote)::BIGINT AS remotes, coalesce(bool_or(remote IN (SELECT remote FROM s)), false) AS shared, bool_or(verified) AS verified FROM r GROUP BY ALL""",
)
def _(spark, sf_dir):
    k = F.col("event_id")
    rows = table(spark, sf_dir, "events", ["event_id", "user_id", "event_type", "value"]).select(
        F.col("user_id").alias("document"), F.col("event_type").alias("collection"), (k % 3).alias("model"), F.when(k % 4 > 0, F.floor(k / 3)).alias("remote"), (F.col("value") > 90).alias("verified")
    )
    return reviews.lineages(rows)


@query(
    "version_audit",
    """WITH v AS (SELECT conv_id AS page, turn AS version, CASE role WHEN 'user' THEN 'a' WHEN 'assistant' THEN 'b' END AS sha, CASE WHEN conv_id % 9 > 0 THEN 'a' END AS o FROM conversations)
SELECT page, coalesce(string_agg(version, ',' ORDER BY version) FILTER (sha = o), '') AS original, coalesce(string_agg(version, ',' ORDER BY version) FILTER (sha <> o), '') AS non_matching,
  coalesce(string_agg(version, ',' ORDER BY version) FILTER (sha IS NULL OR o IS NULL), '') AS insufficient FROM v GROUP BY page""",
)
def _(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations", ["conv_id", "turn", "role"])
    sha = F.when(F.col("role") == "user", "a").when(F.col("role") == "assistant", "b")
    made = reviews.version_audit(turns.select(F.col("conv_id").alias("page"), F.col("turn").alias("version"), sha.alias("sha"), F.when(F.col("conv_id") % 9 > 0, "a").alias("original_sha")))
    return made.select("page", *[F.array_join(c, ",").alias(c) for c in ("original", "non_matching", "insufficient")])
