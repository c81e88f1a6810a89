"""The archive's tables as views of the generic test tables.

An item is a row of `documents`: its title is the first line, its author and category are the source,
and visibility, type and upload status follow from the id. Real archives bring these columns along.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import shared_folder
from .tables import table


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", ["doc_id", "text", "lang", "source"])
    k = F.col("doc_id")
    return docs.select(
        k.alias("item_id"),
        F.split(F.coalesce("text", F.lit("")), "\n")[0].alias("title"),
        F.coalesce("text", F.lit("")).alias("body"),
        F.col("source").alias("author"),
        F.concat_ws(" ", "lang", "source").alias("metadata"),
        F.col("lang").alias("language"),
        F.when(k % 10 < 7, "PUBLIC").when(k % 10 < 9, "PRIVATE").otherwise("RESTRICTED").alias("visibility"),
        F.element_at(F.array(*map(F.lit, ("DOCUMENT", "TEXT", "PHOTO", "VIDEO"))), (k % 4 + 1).cast("int")).alias("item_type"),
        F.when(k % 7 == 0, "PENDING").otherwise("UPLOADED").alias("upload_status"),
        (k % 365).cast("long").alias("created_day"),
    )


ITEMS_SQL = """items AS (
  SELECT doc_id AS item_id, string_split(coalesce(text, ''), chr(10))[1] AS title, coalesce(text, '') AS body, source AS author,
         concat_ws(' ', lang, source) AS metadata, lang AS language,
         CASE WHEN doc_id % 10 < 7 THEN 'PUBLIC' WHEN doc_id % 10 < 9 THEN 'PRIVATE' ELSE 'RESTRICTED' END AS visibility,
         CASE doc_id % 4 WHEN 0 THEN 'DOCUMENT' WHEN 1 THEN 'TEXT' WHEN 2 THEN 'PHOTO' ELSE 'VIDEO' END AS item_type,
         CASE WHEN doc_id % 7 = 0 THEN 'PENDING' ELSE 'UPLOADED' END AS upload_status, (doc_id % 365)::BIGINT AS created_day
  FROM documents)"""


def text_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Competing results per document and type: three engines with statuses by id, texts that may be blank."""
    docs = table(spark, sf_dir, "documents", ["doc_id", "text", "lang"])
    k, e = F.col("doc_id"), F.col("engine_no")
    rows = docs.withColumn("engine_no", F.explode(F.array(*[F.lit(i) for i in range(3)])))
    return rows.select(
        (k * 3 + e).alias("result_id"), k.alias("doc_id"), "lang",
        F.when((k + e) % 2 == 0, "SOURCE_TEXT").otherwise("HEBREW_TEXT").alias("result_type"),
        F.element_at(F.array(*map(F.lit, ("gemini", "vision", "htr"))), e + 1).alias("engine"),
        F.element_at(F.array(*map(F.lit, ("SUCCEEDED", "NEEDS_REVIEW", "FAILED", "SUCCEEDED", "NEEDS_REVIEW"))), ((k * 7 + e * 3) % 5 + 1).cast("int")).alias("status"),
        F.when((k * 3 + e) % 11 == 0, "  ").otherwise(F.coalesce("text", F.lit(""))).alias("text"),
        ((k * 13 + e * 5) % 97).cast("long").alias("created_at"),
    )


RESULTS_SQL = """results AS (
  SELECT doc_id * 3 + e AS result_id, doc_id, lang, CASE WHEN (doc_id + e) % 2 = 0 THEN 'SOURCE_TEXT' ELSE 'HEBREW_TEXT' END AS result_type,
         ['gemini', 'vision', 'htr'][e + 1] AS engine,
         ['SUCCEEDED', 'NEEDS_REVIEW', 'FAILED', 'SUCCEEDED', 'NEEDS_REVIEW'][(doc_id * 7 + e * 3) % 5 + 1] AS status,
         CASE WHEN (doc_id * 3 + e) % 11 = 0 THEN '  ' ELSE coalesce(text, '') END AS text,
         ((doc_id * 13 + e * 5) % 97)::BIGINT AS created_at
  FROM documents, (SELECT unnest([0, 1, 2]) AS e))"""


_indexes: dict[tuple[str, str], str] = {}


def search_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The postings of a directory's items, written to the shared folder once in a session and read from there by every search."""
    from folioforge.operators.search import write_index

    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"))
    if key not in _indexes:
        path = f"{shared_folder(spark)}/folioforge-search/{uuid.uuid4().hex}"
        write_index(items(spark, sf_dir), path)
        _indexes[key] = path
    return spark.read.parquet(_indexes[key])
