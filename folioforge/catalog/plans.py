"""Diff, merge and append plans.

A plan compares two states. The test tables hold one, so that the other is derived from it by id: an old
index, stored keys, taken slugs. Both sides come from whole tables.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from folioforge.plans import diffs
from folioforge.registry import query
from folioforge.sources.tables import table


@query(
    "index_drift_check",
    """WITH i AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'old' ELSE sha256(coalesce(text, '')) END AS sha FROM documents WHERE doc_id % 7 <> 0 UNION ALL SELECT -doc_id - 1, 'x' FROM documents WHERE doc_id % 11 = 0),
c AS (SELECT doc_id, sha256(coalesce(text, '')) AS sha FROM documents)
SELECT coalesce(i.doc_id, c.doc_id) AS doc_id, CASE WHEN i.doc_id IS NULL THEN 'missing' WHEN c.doc_id IS NULL THEN 'extra' WHEN i.sha IS DISTINCT FROM c.sha THEN 'mismatch' ELSE 'ok' END AS status
FROM i FULL JOIN c ON i.doc_id = c.doc_id""",
)
def _(spark, sf_dir):
    k = F.col("doc_id")
    current = table(spark, sf_dir, "documents", ["doc_id", "text"]).select(k, F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"))
    index = current.filter(k % 7 != 0).select(k, F.when(k % 5 == 0, "old").otherwise(F.col("sha")).alias("sha"))
    index = index.unionByName(current.filter(k % 11 == 0).select((-k - 1).alias("doc_id"), F.lit("x").alias("sha")))
    return diffs.drift(index, current, "doc_id", "sha")


@query(
    "index_upsert",
    """SELECT doc_id, 'new' AS state FROM documents WHERE doc_id % 9 = 0 UNION ALL SELECT doc_id, 'old' FROM documents WHERE doc_id % 2 = 0 AND doc_id % 9 <> 0""",
)
def _(spark, sf_dir):
    ids = table(spark, sf_dir, "documents", ["doc_id"])
    old, new = ids.filter("doc_id % 2 = 0").withColumn("state", F.lit("old")), ids.filter("doc_id % 9 = 0").withColumn("state", F.lit("new"))
    return diffs.upsert(old, new, "doc_id")


@query(
    "orphan_keys",
    """SELECT p_partkey, p_size AS modified FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45) AND p_size < 30""",
)
def _(spark, sf_dir):
    listing = table(spark, sf_dir, "part", ["p_partkey", "p_size"]).withColumnRenamed("p_size", "modified")
    used = table(spark, sf_dir, "lineitem", ["l_partkey", "l_quantity"]).filter("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return diffs.orphans(listing, used, "p_partkey", F.col("modified") < 30)


_OPS = """b AS (SELECT CASE WHEN event_id % 10 = 0 THEN ' ' ELSE 'k' || user_id || '-' || event_id % 37 END AS operation_key, event_type || '-' || event_id % 3 AS request FROM events WHERE event_id % 2 = 0),
x AS (SELECT 'k' || user_id || '-' || event_id % 37 AS operation_key, min(event_type || '-' || event_id % 3) AS request FROM events WHERE event_id % 2 = 1 AND event_id % 10 <> 5 GROUP BY 1)"""


@query(
    "idempotent_append",
    f"""WITH {_OPS}, f AS (SELECT operation_key, min(request) AS first FROM b WHERE trim(operation_key) <> '' GROUP BY 1)
SELECT b.operation_key, b.request, CASE WHEN trim(b.operation_key) = '' THEN 'append' WHEN b.request <> coalesce(x.request, f.first) THEN 'conflict' WHEN x.request IS NOT NULL THEN 'replay' ELSE 'append' END AS status
FROM b LEFT JOIN x USING (operation_key) LEFT JOIN f USING (operation_key)""",
)
def _(spark, sf_dir):
    e, k = table(spark, sf_dir, "events", ["event_id", "user_id", "event_type"]), F.col("event_id")
    key = F.concat(F.lit("k"), F.col("user_id").cast("string"), F.lit("-"), (k % 37).cast("string"))
    request = F.concat("event_type", F.lit("-"), (k % 3).cast("string"))
    batch = e.filter(k % 2 == 0).select(F.when(k % 10 == 0, " ").otherwise(key).alias("operation_key"), request.alias("request"))
    stored = e.filter((k % 2 == 1) & (k % 10 != 5)).select(key.alias("operation_key"), request.alias("request"))
    return diffs.append_once(stored, batch)


@query(
    "duplicate_marking",
    """SELECT doc_id, count(*) OVER (PARTITION BY sha256(coalesce(text, ''))) > 1 AS same_text, count(*) OVER (PARTITION BY source, n_chars) > 1 AS same_size FROM documents""",
)
def _(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", ["doc_id", "text", "source", "n_chars"]).withColumn("sha", F.sha2(F.coalesce("text", F.lit("")), 256))
    return diffs.mark_duplicates(docs.drop("text"), {"same_text": ["sha"], "same_size": ["source", "n_chars"]}).select("doc_id", "same_text", "same_size")


@query(
    "row_findings",
    """SELECT d.doc_id, array_to_string(list_filter([CASE WHEN l.doc_id IS NULL THEN 'unlabelled' END, CASE WHEN l.toxic = 1 THEN 'toxic' END, CASE WHEN n_chars < 100 THEN 'short' END,
  CASE WHEN lang <> 'en' THEN 'foreign' END], lambda x: x IS NOT NULL), ',') AS findings FROM documents d LEFT JOIN labels l USING (doc_id)""",
)
def _(spark, sf_dir):
    labels = table(spark, sf_dir, "labels", ["doc_id", "toxic"]).withColumn("known", F.lit(True))
    rows = table(spark, sf_dir, "documents", ["doc_id", "lang", "n_chars"]).join(labels, "doc_id", "left")
    found = diffs.findings(unlabelled=F.col("known").isNull(), toxic=F.col("toxic") == 1, short=F.col("n_chars") < 100, foreign=F.col("lang") != "en")
    return rows.select("doc_id", F.array_join(found, ",").alias("findings"))


@query(
    "slug_collisions",
    """WITH b AS (SELECT p_partkey AS id, regexp_replace(lower(trim(p_name)), '[^a-z0-9]+', '-', 'g') AS base FROM part WHERE p_partkey % 40 <> 0),
t AS (SELECT base, count(*) AS used FROM (SELECT DISTINCT regexp_replace(lower(trim(p_name)), '[^a-z0-9]+', '-', 'g') AS base FROM part WHERE p_partkey % 40 = 0) GROUP BY 1),
r AS (SELECT id, b.base, row_number() OVER (PARTITION BY b.base ORDER BY id) + coalesce(used, 0) AS n FROM b LEFT JOIN t ON b.base = t.base)
SELECT id, CASE WHEN n = 1 THEN base ELSE base || '-' || n END AS slug FROM r""",
)
def _(spark, sf_dir):
    from folioforge.functions.text import slug

    part = table(spark, sf_dir, "part", ["p_partkey", "p_name"])
    taken = part.filter("p_partkey % 40 = 0").select(slug(F.col("p_name")).alias("slug")).distinct()
    return diffs.unique_slugs(part.filter("p_partkey % 40 <> 0").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name")), taken)


_NAMES = """n AS (SELECT c_custkey AS id, CASE c_custkey % 4 WHEN 0 THEN 'בית־ספר ' || c_mktsegment WHEN 1 THEN 'Müller & ' || c_mktsegment WHEN 2 THEN 'שלום' ELSE '?!' END AS name FROM customer)"""


@query(
    "slugs_of_names",
    f"""WITH {_NAMES}, k AS (SELECT id, regexp_replace(lower(name), '[^\\p{{L}}\\p{{N}}_\\s-]', '', 'g') AS kept FROM n),
b AS (SELECT id, coalesce(nullif(trim(regexp_replace(kept, '[-\\s]+', '-', 'g'), '-_'), ''), 'item') AS base FROM k),
r AS (SELECT id, base, row_number() OVER (PARTITION BY base ORDER BY id) AS n FROM b)
SELECT id, CASE WHEN n = 1 THEN base ELSE base || '-' || n END AS slug FROM r""",
)
def _(spark, sf_dir):
    k, segment = F.col("c_custkey"), F.col("c_mktsegment")
    name = F.when(k % 4 == 0, F.concat(F.lit("בית־ספר "), segment)).when(k % 4 == 1, F.concat(F.lit("Müller & "), segment)).when(k % 4 == 2, F.lit("שלום")).otherwise(F.lit("?!"))
    names = table(spark, sf_dir, "customer", ["c_custkey", "c_mktsegment"]).select(k.alias("id"), name.alias("name"))
    return diffs.unique_slugs(names, spark.createDataFrame([], "slug string"))


@query("merge_identities", "SELECT DISTINCT CASE WHEN o_custkey % 10 = 3 THEN o_custkey - 3 ELSE o_custkey END AS c, l_partkey AS item FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def _(spark, sf_dir):
    orders = table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey"])
    links = orders.join(table(spark, sf_dir, "lineitem", ["l_orderkey", "l_partkey"]), F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("c"), F.col("l_partkey").alias("item"))
    merges = orders.filter("o_custkey % 10 = 3").select(F.col("o_custkey").alias("retired"), (F.col("o_custkey") - 3).alias("target")).distinct()
    return diffs.repoint(links, merges, "c")


_SLOTS = "s AS (SELECT l_orderkey AS item_id, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, min(l_partkey), l_suppkey) - 1) AS position, l_suppkey % 10 AS author_id FROM lineitem GROUP BY l_orderkey, l_linenumber, l_suppkey)"


def slots(spark, sf_dir):
    from pyspark.sql import Window

    lines = table(spark, sf_dir, "lineitem", ["l_orderkey", "l_linenumber", "l_suppkey", "l_partkey"])
    one = lines.groupBy("l_orderkey", "l_linenumber", "l_suppkey").agg(F.min("l_partkey").alias("p"))
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "p", "l_suppkey")) - 1
    return one.select(F.col("l_orderkey").alias("item_id"), place.alias("position"), (F.col("l_suppkey") % 10).alias("author_id"))


@query(
    "merge_ordered_authors",
    f"""WITH {_SLOTS}, m AS (SELECT *, max((author_id = 2)::INT) OVER (PARTITION BY item_id) AS linked FROM s)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY position) - 1)::INTEGER AS position, CASE WHEN author_id = 7 THEN 2 ELSE author_id END AS author_id FROM m WHERE NOT (author_id = 7 AND linked = 1)""",
)
def _(spark, sf_dir):
    return diffs.merge_ordered(slots(spark, sf_dir), 2, 7)


@query(
    "rename_joined_authors",
    f"""WITH {_SLOTS} SELECT item_id, string_agg('Author ' || author_id, ', ' ORDER BY position) AS joined, length(string_agg('Author ' || author_id, ', ' ORDER BY position)) > 40 AS too_long FROM s GROUP BY item_id""",
)
def _(spark, sf_dir):
    names = spark.range(10).select(F.col("id").alias("author_id"), F.concat(F.lit("Author "), F.col("id").cast("string")).alias("name"))
    return diffs.rename_joined(slots(spark, sf_dir), names, 40)


@query(
    "apply_state",
    "WITH c AS (SELECT count(*) FILTER (quality = 1) AS found, count(*) FILTER (quality = 1) AS approved FROM labels UNION ALL SELECT count(*), count(*) FROM region) SELECT CASE WHEN bool_and(found = 0) THEN 'ALREADY_APPLIED' WHEN bool_and(found = approved) THEN 'READY_TO_APPLY' ELSE 'DRIFT' END AS state FROM c",
)
def _(spark, sf_dir):
    good = table(spark, sf_dir, "labels", ["quality"]).filter("quality = 1").agg(F.count(F.lit(1)).alias("found")).withColumn("approved", F.col("found"))
    return diffs.apply_state(good.unionByName(table(spark, sf_dir, "region", ["r_regionkey"]).agg(F.count(F.lit(1)).alias("found")).withColumn("approved", F.col("found"))))


@query(
    "merge_cycles",
    """WITH RECURSIVE e AS (SELECT n_nationkey AS a, (n_nationkey * 7 + 3) % 25 AS b FROM nation), w AS (SELECT a, b, 1 AS d FROM e UNION SELECT w.a, e.b, d + 1 FROM w JOIN e ON w.b = e.a WHERE d < 30),
o AS (SELECT DISTINCT a FROM w WHERE a = b) SELECT DISTINCT min(b) AS cycle FROM w WHERE a IN (SELECT a FROM o) AND b IN (SELECT a FROM o) GROUP BY a""",
)
def _(spark, sf_dir):
    k = F.col("n_nationkey")
    return diffs.merge_cycles(table(spark, sf_dir, "nation", ["n_nationkey"]).select(k.alias("retired"), ((k * 7 + 3) % 25).alias("target")))


@query(
    "metadata_backfill",
    """SELECT source, count(*) FILTER (l.doc_id IS NULL)::BIGINT AS to_add, count(*) FILTER (l.doc_id IS NOT NULL)::BIGINT AS skipped FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY source""",
)
def _(spark, sf_dir):
    linked = table(spark, sf_dir, "labels", ["doc_id"]).withColumn("known", F.lit(True))
    rows = table(spark, sf_dir, "documents", ["doc_id", "source"]).join(linked, "doc_id", "left")
    return rows.groupBy("source").agg(F.count_if(F.col("known").isNull()).alias("to_add"), F.count_if(F.col("known")).alias("skipped"))
