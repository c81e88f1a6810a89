"""Choice among results, roll-ups, backlogs."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioforge.operators import filters, selection
from folioforge.registry import query
from folioforge.sources.archive import RESULTS_SQL, text_results
from folioforge.sources.tables import table

_LATEST = f"""WITH {RESULTS_SQL}, latest AS (SELECT * FROM results WHERE status IN ('SUCCEEDED', 'NEEDS_REVIEW') AND regexp_matches(text, '\\S')
QUALIFY row_number() OVER (PARTITION BY doc_id, result_type ORDER BY status = 'SUCCEEDED' DESC, created_at DESC, result_id DESC) = 1)"""


@query("latest_displayable", f"{_LATEST} SELECT doc_id, result_type, result_id, status, engine, text FROM latest")
def _(spark, sf_dir):
    return selection.latest_displayable(text_results(spark, sf_dir))


@query(
    "latest_failed",
    f"""WITH {RESULTS_SQL} SELECT doc_id, result_type, result_id FROM results WHERE status = 'FAILED'
QUALIFY row_number() OVER (PARTITION BY doc_id, result_type ORDER BY created_at DESC, result_id DESC) = 1""",
)
def _(spark, sf_dir):
    return selection.latest_failed(text_results(spark, sf_dir))


@query(
    "displayed_transcription",
    f"""{_LATEST}, p AS (SELECT doc_id, max(result_id) FILTER (result_type = 'SOURCE_TEXT') AS s, max(result_id) FILTER (result_type = 'HEBREW_TEXT') AS h FROM latest GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.lang = 'he' THEN coalesce(h, s) ELSE coalesce(s, h) END AS result_id FROM documents d LEFT JOIN p USING (doc_id)""",
)
def _(spark, sf_dir):
    return selection.displayed_transcription(selection.latest_displayable(text_results(spark, sf_dir)), table(spark, sf_dir, "documents", ["doc_id", "lang"]))


@query(
    "processing_state_rollup",
    f"""WITH {RESULTS_SQL}, own AS (SELECT doc_id, result_type, max((status = 'FAILED')::INT) AS failed,
  max((status IN ('SUCCEEDED', 'NEEDS_REVIEW') AND regexp_matches(text, '\\S'))::INT) AS usable FROM results WHERE engine <> 'vision' GROUP BY ALL),
e AS (SELECT doc_id, unnest(CASE WHEN lang = 'he' THEN ['HEBREW_TEXT'] ELSE ['SOURCE_TEXT', 'HEBREW_TEXT'] END) AS result_type FROM documents)
SELECT doc_id, CASE WHEN count(*) FILTER (failed IS NULL) > 0 THEN 'PARTIAL' WHEN min(failed) = 1 THEN 'FAILED' WHEN min(usable) = 1 THEN 'READY' ELSE 'PARTIAL' END AS state
FROM e LEFT JOIN own USING (doc_id, result_type) GROUP BY doc_id""",
)
def _(spark, sf_dir):
    results = text_results(spark, sf_dir).filter("engine <> 'vision'").withColumn("engine", F.lit("any"))
    return selection.processing_state(table(spark, sf_dir, "documents", ["doc_id", "lang"]), results, "any")


@query(
    "page_quality_rollup",
    """WITH p AS (SELECT d.doc_id // 4 AS doc_id, CASE WHEN quality = 1 THEN 'GOOD' WHEN quality = 0 THEN 'LOW' END AS quality, text, lang <> 'de' AS unassisted
  FROM documents d LEFT JOIN labels l USING (doc_id))
SELECT doc_id, CASE WHEN count(*) FILTER (quality IS NULL OR NOT regexp_matches(coalesce(text, ''), '\\S')) > 0 THEN 'UNKNOWN'
  WHEN 2 * count(*) FILTER (quality = 'LOW') >= count(*) THEN 'LOW'
  WHEN bool_and(unassisted) AND count(*) FILTER (contains(text, '[UNCLEAR]')) = 0 THEN 'GOOD' ELSE 'MEDIUM' END AS quality FROM p GROUP BY doc_id""",
)
def _(spark, sf_dir):
    labels = table(spark, sf_dir, "labels", ["doc_id", "quality"])
    pages = table(spark, sf_dir, "documents", ["doc_id", "text", "lang"]).join(labels, "doc_id", "left")
    quality = F.when(F.col("quality") == 1, "GOOD").when(F.col("quality") == 0, "LOW")
    return selection.quality_of_pages(pages.select(F.floor(F.col("doc_id") / 4).alias("doc_id"), quality.alias("quality"), "text", (F.col("lang") != "de").alias("unassisted")))


@query(
    "attempt_assembly",
    """WITH p AS (SELECT conv_id AS attempt, turn + 1 AS page, role <> 'system' AS ok, text FROM conversations),
e AS (SELECT attempt, max(page)::BIGINT AS n FROM p GROUP BY attempt),
d AS (SELECT attempt, count(DISTINCT page) AS done, string_agg(trim(text), chr(10) || chr(10) ORDER BY page, trim(text)) AS text FROM p WHERE ok GROUP BY attempt)
SELECT e.attempt, CASE WHEN n > coalesce(done, 0) THEN 'PARTIAL' ELSE 'COMPLETED' END AS status, (n - coalesce(done, 0))::BIGINT AS missing, coalesce(text, '') AS text FROM e LEFT JOIN d USING (attempt)""",
)
def _(spark, sf_dir):
    pages = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("attempt"), (F.col("turn") + 1).alias("page"), (F.col("role") != "system").alias("ok"), "text")
    return selection.assemble(pages, pages.groupBy("attempt").agg(F.max("page").alias("n")))


@query(
    "review_backlog",
    f"""WITH {RESULTS_SQL}, p AS (SELECT r.* FROM results r LEFT JOIN labels l USING (doc_id) WHERE status = 'NEEDS_REVIEW' AND coalesce(toxic, 0) = 0 AND regexp_matches(r.text, '\\S'))
SELECT doc_id, lang FROM documents d WHERE EXISTS (SELECT 1 FROM p WHERE p.doc_id = d.doc_id AND engine = 'gemini') AND EXISTS (SELECT 1 FROM p WHERE p.doc_id = d.doc_id AND created_at > 20)""",
)
def _(spark, sf_dir):
    labels = table(spark, sf_dir, "labels", ["doc_id", "toxic"])
    results = text_results(spark, sf_dir).join(labels, "doc_id", "left")
    verification = F.when(F.coalesce("toxic", F.lit(0)) == 0, "UNVERIFIED").otherwise("VERIFIED")
    pending = filters.pending_review(results, verification)
    return filters.backlog(table(spark, sf_dir, "documents", ["doc_id", "lang"]), pending, F.col("engine") == "gemini", F.col("created_at") > 20)


@query(
    "pending_summary",
    f"""WITH {RESULTS_SQL} SELECT doc_id, count(*)::BIGINT AS n, array_to_string(list_sort(list_distinct(list(engine))), ',') AS engines,
  array_to_string(list_sort(list_distinct(list(result_type))), ',') AS types FROM results WHERE status = 'NEEDS_REVIEW' GROUP BY doc_id""",
)
def _(spark, sf_dir):
    pending = text_results(spark, sf_dir).filter("status = 'NEEDS_REVIEW'")
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    return pending.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), listed("engine").alias("engines"), listed("result_type").alias("types"))


@query(
    "quality_ladders",
    """SELECT doc_id, CASE WHEN quality = 1 THEN CASE WHEN doc_id % 3 = 0 THEN 'UNKNOWN' WHEN doc_id % 3 = 1 THEN 'LOW' ELSE 'MEDIUM' END
  ELSE CASE WHEN doc_id % 3 = 0 THEN 'UNKNOWN' ELSE 'LOW' END END AS inherited,
  CASE WHEN toxic = 1 THEN 'LOW' WHEN quality = 1 THEN 'VERIFIED' ELSE 'MEDIUM' END AS effective FROM labels""",
)
def _(spark, sf_dir):
    labels = table(spark, sf_dir, "labels", ["doc_id", "quality", "toxic"])
    source = F.when(F.col("quality") == 1, "GOOD").otherwise("LOW")
    candidate = F.element_at(F.array(*map(F.lit, ("UNKNOWN", "LOW", "MEDIUM"))), (F.col("doc_id") % 3 + 1).cast("int"))
    verification = F.when(F.col("toxic") == 1, "REJECTED").when(F.col("quality") == 1, "VERIFIED")
    return labels.select("doc_id", selection.inherited_quality(source, candidate).alias("inherited"), selection.effective_quality(F.lit("MEDIUM"), verification).alias("effective"))


@query(
    "inventory_matrix",
    """SELECT source, lang, count(*)::BIGINT AS n FROM documents GROUP BY GROUPING SETS ((source, lang), (source), (lang), ())""",
)
def _(spark, sf_dir):
    table(spark, sf_dir, "documents", ["source", "lang"]).createOrReplaceTempView("__inventory")
    return spark.sql("SELECT source, lang, count(*) AS n FROM __inventory GROUP BY GROUPING SETS ((source, lang), (source), (lang), ())")


@query(
    "photo_cluster_histogram",
    """WITH n AS (SELECT c_custkey, count(o_orderkey) AS photos FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1) SELECT photos::BIGINT AS photos, count(*)::BIGINT AS items FROM n GROUP BY 1""",
)
def _(spark, sf_dir):
    counted = table(spark, sf_dir, "orders", ["o_custkey"]).groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("photos"))
    return table(spark, sf_dir, "customer", ["c_custkey"]).join(counted, "c_custkey", "left").groupBy(F.coalesce("photos", F.lit(0)).alias("photos")).agg(F.count(F.lit(1)).alias("items"))
