"""The segmented search index: refreshes of changed items, tombstones, merges."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from folioforge.operators.segments import Index
from folioforge.registry import query
from folioforge.sources.shared import shared_folder
from folioforge.sources.tables import table

#: Items divisible by 11 lose their document, those divisible by 3 or 5 are refreshed, the rest keeps that of the first writing, whose metadata say so.
_DOCUMENTS = """docs AS (SELECT doc_id AS item_id, string_split(coalesce(text, ''), chr(10))[1] AS title, concat_ws(' ', lang, source) || CASE WHEN doc_id % 3 = 0 OR doc_id % 5 = 0 THEN '' ELSE ' first' END AS metadata,
  coalesce(text, '') AS body, string_split(coalesce(text, ''), chr(10))[2] AS translation FROM documents WHERE doc_id % 11 <> 0)"""
_TOKENS = "list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"
_POSTINGS = f"""{_DOCUMENTS},
f AS (SELECT item_id, unnest(['A', 'B', 'C', 'D']) AS field, unnest([{", ".join(_TOKENS.format(f"coalesce({c}, '')") for c in ("title", "metadata", "body", "translation"))}]) AS t FROM docs),
e AS (SELECT item_id, field, unnest(t) AS token, unnest(range(len(t))) AS pos FROM f)"""
_built: dict[tuple[str, str], str] = {}


def index(spark, sf_dir) -> Index:
    """The index of a directory's items, in one base and three refreshes, built once in a session."""
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"))
    if key not in _built:
        made = Index(spark, f"{shared_folder(spark)}/folioforge-segments/{uuid.uuid4().hex}")
        docs, k = table(spark, sf_dir, "documents", ["doc_id", "text", "lang", "source"]), F.col("doc_id")
        text = F.coalesce("text", F.lit(""))
        rows = docs.select(
            k.alias("item_id"), F.substring_index(text, "\n", 1).alias("title"), F.concat_ws(" ", "lang", "source").alias("metadata"), text.alias("body"), F.get(F.split(text, "\n"), F.lit(1)).alias("translation")
        )
        ids = rows.select("item_id")
        made.refresh(rows.withColumn("metadata", F.concat("metadata", F.lit(" first"))), ids)
        made.refresh(rows, ids.filter("item_id % 3 = 0"))
        made.refresh(rows, ids.filter("item_id % 5 = 0").unionByName(ids.filter("item_id % 15 = 0")))
        made.refresh(rows.filter("item_id % 11 <> 0"), ids.filter("item_id % 11 = 0").unionByName(spark.range(1).select((F.col("id") - 7).alias("item_id"))))
        _built[key] = made.path
    return Index(spark, _built[key])


@query("segment_postings", f"WITH {_POSTINGS} SELECT item_id, token, field, count(*)::BIGINT AS n, min(pos)::BIGINT AS first FROM e GROUP BY ALL")
def _(spark, sf_dir):
    return index(spark, sf_dir).postings().select("item_id", "token", "field", "n", "first")


def _search_sql(terms: list[str]) -> str:
    """The same search over the documents as they are in the end."""
    has = {t: " OR ".join(f"list_contains(t{f}, '{t}')" for f in "abcd") + f" OR contains(lower(title), '{t}') OR contains(lower(metadata), '{t}')" for t in terms}
    rank = " + ".join([f"CASE WHEN {' AND '.join(f'''list_contains(t{f}, '{t}')''' for t in terms)} THEN {w} ELSE 0 END" for f, w in (("a", 1.0), ("b", 0.4), ("c", 0.2), ("d", 0.2))])
    boost = " + ".join(f"CASE WHEN {' OR '.join(f'''contains(lower({c}), '{t}')''' for t in terms)} THEN {w} ELSE 0 END" for c, w in (("title", 1.0), ("metadata", 0.4)))
    lists = ", ".join(f"{_TOKENS.format(f'''coalesce({c}, '')''')} AS t{f}" for c, f in (("title", "a"), ("metadata", "b"), ("body", "c"), ("translation", "d")))
    return f"WITH {_DOCUMENTS}, t AS (SELECT *, {lists} FROM docs) SELECT item_id, title, round(({rank} + {boost})::DOUBLE, 6) AS relevance FROM t WHERE ({') AND ('.join(has.values())})"


@query("segment_search", _search_sql(["the", "src1"]))
def _(spark, sf_dir):
    return index(spark, sf_dir).search("The src1")


@query("segment_search_after_merge", _search_sql(["first", "der"]))
def _(spark, sf_dir):
    own = index(spark, sf_dir)
    own.compact()
    return own.search("first DER")
