"""Choice among competing results, and status roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_displayable(results: DataFrame, blank: bool = True) -> DataFrame:
    """Per document and type the newest SUCCEEDED result, else the newest NEEDS_REVIEW; failures never, nor blank texts, or only empty ones where `blank` is false.

    An aggregate with map-side combine instead of a window: the best row is a maximum of structs.
    """
    usable = results.filter(F.col("status").isin("SUCCEEDED", "NEEDS_REVIEW") & (F.col("text").rlike("\\S") if blank else F.col("text") != ""))
    best = F.max(F.struct((F.col("status") == "SUCCEEDED").alias("ok"), "created_at", "result_id", "status", "engine", "text"))
    return usable.groupBy("doc_id", "result_type").agg(best.alias("x")).select("doc_id", "result_type", "x.result_id", "x.status", "x.engine", "x.text")


def latest_failed(results: DataFrame) -> DataFrame:
    failed = results.filter(F.col("status") == "FAILED")
    return failed.groupBy("doc_id", "result_type").agg(F.max(F.struct("created_at", "result_id")).alias("x")).select("doc_id", "result_type", "x.result_id")


def displayed_transcription(latest: DataFrame, language: DataFrame) -> DataFrame:
    """One result per document: Hebrew documents show HEBREW_TEXT first, others SOURCE_TEXT first."""
    by_type = latest.groupBy("doc_id").pivot("result_type", ["SOURCE_TEXT", "HEBREW_TEXT"]).agg(F.first("result_id"))
    joined = language.join(by_type, "doc_id", "left")
    first = F.when(F.col("lang") == "he", F.coalesce("HEBREW_TEXT", "SOURCE_TEXT")).otherwise(F.coalesce("SOURCE_TEXT", "HEBREW_TEXT"))
    return joined.select("doc_id", first.alias("result_id"))


def displayed_translation(latest: DataFrame, language: DataFrame) -> DataFrame:
    """(doc_id, result_id): the Hebrew text of documents in another language whose source text is shown as well."""
    own = latest.filter("result_type = 'HEBREW_TEXT'").join(language.filter("lang <> 'he'").select("doc_id"), "doc_id", "left_semi")
    return own.join(latest.filter("result_type = 'SOURCE_TEXT'").select("doc_id"), "doc_id", "left_semi").select("doc_id", "result_id")


def next_positions(items: DataFrame, photos: DataFrame) -> DataFrame:
    """(item_id, position) that a further photo of each item gets; 1 for the first."""
    last = photos.groupBy("item_id").agg(F.max("position").alias("last"))
    return items.join(last, "item_id", "left").select("item_id", (F.coalesce("last", F.lit(0)) + 1).cast("long").alias("position"))


def processing_state(documents: DataFrame, results: DataFrame, engine: str) -> DataFrame:
    """(doc_id, state) of one engine: a missing expected type is PARTIAL, all failed FAILED, all usable READY, else PARTIAL."""
    own = results.filter(F.col("engine") == engine)
    per_type = own.groupBy("doc_id", "result_type").agg(
        F.max((F.col("status") == "FAILED").cast("int")).alias("failed"),
        F.max((F.col("status").isin("SUCCEEDED", "NEEDS_REVIEW") & F.col("text").rlike("\\S")).cast("int")).alias("usable"),
    )
    expected = documents.withColumn("result_type", F.explode(F.when(F.col("lang") == "he", F.array(F.lit("HEBREW_TEXT"))).otherwise(F.array(F.lit("SOURCE_TEXT"), F.lit("HEBREW_TEXT")))))
    joined = expected.join(per_type, ["doc_id", "result_type"], "left")
    state = (
        F.when(F.count_if(F.col("failed").isNull()) > 0, "PARTIAL").when(F.min("failed") == 1, "FAILED").when(F.min("usable") == 1, "READY").otherwise("PARTIAL")
    )
    return joined.groupBy("doc_id").agg(state.alias("state"))


def quality_of_pages(pages: DataFrame) -> DataFrame:
    """(doc_id, quality) of pages (doc_id, quality null if missing, text, unassisted)."""
    n, low = F.count(F.lit(1)), F.count_if(F.col("quality") == "LOW")
    quality = (
        F.when(F.count_if(F.col("quality").isNull() | ~F.coalesce(F.col("text").rlike("\\S"), F.lit(False))) > 0, "UNKNOWN")
        .when(2 * low >= n, "LOW")
        .when(F.bool_and("unassisted") & (F.count_if(F.contains("text", F.lit("[UNCLEAR]"))) == 0), "GOOD")
        .otherwise("MEDIUM")
    )
    return pages.groupBy("doc_id").agg(quality.alias("quality"))


def assemble(pages: DataFrame, expected: DataFrame) -> DataFrame:
    """(attempt, status, missing, text): page texts in order; a page that has not succeeded makes the attempt PARTIAL.

    pages: attempt, page, ok, text. expected: attempt, n. An attempt's pages are one row: it is a document of bounded pages.
    """
    done = pages.filter("ok").groupBy("attempt").agg(F.array_sort(F.collect_list(F.struct("page", F.trim("text").alias("text")))).alias("done"))
    joined = expected.join(done, "attempt", "left").withColumn("done", F.coalesce("done", F.array().cast("array<struct<page:bigint,text:string>>")))
    missing = F.array_except(F.sequence(F.lit(1).cast("long"), F.col("n")), F.transform("done", lambda p: p["page"]))
    status = F.when(F.size(missing) > 0, "PARTIAL").otherwise("COMPLETED")
    return joined.select("attempt", status.alias("status"), F.size(missing).cast("long").alias("missing"), F.array_join(F.transform("done", lambda p: p["text"]), "\n\n").alias("text"))


def inherited_quality(source: Column, candidate: Column) -> Column:
    """The lower of two qualities; UNKNOWN wins over any."""
    rank = lambda q: F.when(q == "LOW", 1).when(q == "MEDIUM", 2).when(q == "GOOD", 3).otherwise(0)
    least = F.least(rank(source), rank(candidate))
    return F.element_at(F.array(*map(F.lit, ("UNKNOWN", "LOW", "MEDIUM", "GOOD"))), least + 1)


def effective_quality(stored: Column, verification: Column) -> Column:
    return F.when(verification == "VERIFIED", "VERIFIED").when(verification == "REJECTED", "LOW").otherwise(F.coalesce(stored, F.lit("UNKNOWN")))
