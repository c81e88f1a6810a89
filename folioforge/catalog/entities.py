"""Entities in texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioforge.operators import entities
from folioforge.registry import query
from folioforge.sources.tables import table

_WORDS = "list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}\\p{{M}}]+'), lambda x: x <> '')"
_DOC_WORDS = _WORDS.format("coalesce(text, '')")
#: Surfaces of one to three words: the beginnings of the benchmark's passages, and common words.
_SURFACES = f"""surfaces AS (SELECT DISTINCT array_to_string({_WORDS.format('text')}[1:n], ' ') AS surface FROM benchmark, (SELECT unnest([1, 2, 3]) AS n) UNION SELECT unnest(['the thing', 'of the']))"""
_HITS = f"""WITH {_SURFACES}, w AS (SELECT doc_id AS item_id, {_DOC_WORDS} AS words FROM documents),
g AS (SELECT item_id, n, unnest(range(0, len(words) - n + 1)) AS start, words FROM w, (SELECT unnest([1, 2, 3]) AS n)),
hits AS (SELECT item_id, surface, start::INTEGER AS start, (start + n)::INTEGER AS "end" FROM g JOIN surfaces ON surface = array_to_string(words[start + 1:start + n], ' '))"""


def surfaces(spark, sf_dir):
    words = F.filter(F.split(F.lower("text"), "[^\\p{L}\\p{N}\\p{M}]+"), lambda w: w != "")
    rows = table(spark, sf_dir, "benchmark", ["text"]).select(words.alias("w")).select(F.explode(F.array(*[F.array_join(F.slice("w", 1, n), " ") for n in (1, 2, 3)])).alias("surface"))
    return rows.unionByName(spark.createDataFrame([("the thing",), ("of the",)], "surface string")).distinct()


def texts(spark, sf_dir):
    return table(spark, sf_dir, "documents", ["doc_id", "text"]).select(F.col("doc_id").alias("item_id"), F.coalesce("text", F.lit("")).alias("text"))


def hits(spark, sf_dir):
    return entities.detect(texts(spark, sf_dir), surfaces(spark, sf_dir))


@query("entity_detection", f'{_HITS} SELECT surface, count(*)::BIGINT AS hits, count(DISTINCT item_id)::BIGINT AS items, min(start)::INTEGER AS least, max("end")::INTEGER AS most FROM hits GROUP BY surface')
def _(spark, sf_dir):
    return hits(spark, sf_dir).groupBy("surface").agg(
        F.count(F.lit(1)).alias("hits"), F.countDistinct("item_id").alias("items"), F.min("start").alias("least"), F.max("end").alias("most")
    )


@query(
    "containment_suppression",
    f"""{_HITS} SELECT item_id, surface, start, "end" FROM hits a WHERE NOT EXISTS (SELECT 1 FROM hits b WHERE b.item_id = a.item_id AND b.start <= a.start AND b."end" >= a."end" AND b."end" - b.start > a."end" - a.start)""",
)
def _(spark, sf_dir):
    return entities.surviving(hits(spark, sf_dir), entities.shares(texts(spark, sf_dir)))


@query(
    "covering_hits",
    f"""{_HITS} SELECT a.item_id, a.surface, a.start, a."end", arg_min(b.surface, (b.start - b."end", b.start, b.surface)) AS cover FROM hits a JOIN hits b
  ON b.item_id = a.item_id AND b.start <= a.start AND b."end" >= a."end" AND b."end" - b.start > a."end" - a.start GROUP BY ALL""",
)
def _(spark, sf_dir):
    return entities.cover_of(hits(spark, sf_dir))


@query(
    "grouped_review",
    f"""{_HITS} SELECT surface, sha256('{{"surface":"' || surface || '"}}') AS group_id, count(DISTINCT item_id)::BIGINT AS items, count(*)::BIGINT AS hits, min(item_id) AS first_item,
  count(DISTINCT item_id) >= 5 AS many_items, length(surface) <= 3 AS short_surface FROM hits GROUP BY surface""",
)
def _(spark, sf_dir):
    return entities.grouped(hits(spark, sf_dir))


_REGISTRY = """e AS (SELECT p_partkey AS entity_id, p_name AS display, p_brand || ' ' || p_name AS canonical FROM part),
a AS (SELECT l_partkey AS entity_id, p_type || '-' || p_size AS alias FROM lineitem JOIN part ON p_partkey = l_partkey)"""


@query(
    "registry_rank",
    f"""WITH {_REGISTRY}, r AS (SELECT entity_id, CASE WHEN lower(display) = 'small ring' THEN 1 WHEN lower(canonical) = 'small ring' THEN 2
  WHEN starts_with(lower(display), 'small ring') OR starts_with(lower(canonical), 'small ring') THEN 4 WHEN contains(lower(display), 'small ring') OR contains(lower(canonical), 'small ring') THEN 6 END AS rank FROM e
UNION ALL SELECT entity_id, CASE WHEN lower(alias) = 'small ring' THEN 3 WHEN starts_with(lower(alias), 'small ring') THEN 5 WHEN contains(lower(alias), 'small ring') THEN 7 END FROM a)
SELECT entity_id, min(rank) AS rank FROM r WHERE rank IS NOT NULL GROUP BY 1""",
)
def _(spark, sf_dir):
    return _ranked(spark, sf_dir, "small ring")


@query(
    "registry_rank_alias",
    f"""WITH {_REGISTRY}, r AS (SELECT entity_id, CASE WHEN lower(alias) = 'small-1' THEN 3 WHEN starts_with(lower(alias), 'small-1') THEN 5 WHEN contains(lower(alias), 'small-1') THEN 7 END AS rank FROM a)
SELECT entity_id, min(rank) AS rank FROM r WHERE rank IS NOT NULL GROUP BY 1""",
)
def _(spark, sf_dir):
    return _ranked(spark, sf_dir, "Small–1")


_HEBREW = """e AS (SELECT p_partkey AS entity_id, CASE WHEN p_partkey % 3 = 0 THEN 'בית־ספר ' || p_name ELSE 'a−b ' || p_name END AS display, p_name AS canonical FROM part),
a AS (SELECT p_partkey AS alias_id, p_partkey // 2 AS entity_id, CASE WHEN p_partkey % 5 = 0 THEN 'OCR_VARIANT' ELSE 'OTHER' END AS kind, p_type || '–' || p_size AS alias FROM part)"""


def _hebrew(spark, sf_dir):
    k, part = F.col("p_partkey"), table(spark, sf_dir, "part", ["p_partkey", "p_name", "p_type", "p_size"])
    names = part.select(k.alias("entity_id"), F.concat(F.when(k % 3 == 0, "בית־ספר ").otherwise("a−b "), "p_name").alias("display"), F.col("p_name").alias("canonical"))
    kind = F.when(k % 5 == 0, "OCR_VARIANT").otherwise("OTHER")
    return names, part.select(k.alias("alias_id"), F.floor(k / 2).alias("entity_id"), kind.alias("kind"), F.concat("p_type", F.lit("–"), F.col("p_size").cast("string")).alias("alias"))


@query("registry_rank_maqaf", f"WITH {_HEBREW} SELECT entity_id, 4 AS rank FROM e WHERE starts_with(display, 'בית־ספר s')")
def _(spark, sf_dir):
    names, aliases = _hebrew(spark, sf_dir)
    return entities.registry_rank(names, aliases.select("entity_id", "alias"), " בית־ספר S")


@query(
    "registry_matched_alias",
    f"""WITH {_HEBREW}, l AS (SELECT *, replace(lower(alias), '–', '-') AS low FROM a WHERE kind <> 'OCR_VARIANT'),
r AS (SELECT *, CASE WHEN low = 'small-1' THEN 3 WHEN starts_with(low, 'small-1') THEN 5 WHEN contains(low, 'small-1') THEN 7 END AS rank FROM l)
SELECT entity_id, replace(alias, '–', '-') AS alias FROM r WHERE rank IS NOT NULL QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY rank, low, alias_id) = 1""",
)
def _(spark, sf_dir):
    return entities.matched_aliases(_hebrew(spark, sf_dir)[1], "Small−1")


def _ranked(spark, sf_dir, text):
    part = table(spark, sf_dir, "part", ["p_partkey", "p_name", "p_brand", "p_type", "p_size"])
    names = part.select(F.col("p_partkey").alias("entity_id"), F.col("p_name").alias("display"), F.concat_ws(" ", "p_brand", "p_name").alias("canonical"))
    linked = table(spark, sf_dir, "lineitem", ["l_partkey"]).join(part, F.col("l_partkey") == F.col("p_partkey"))
    return entities.registry_rank(names, linked.select(F.col("l_partkey").alias("entity_id"), F.concat("p_type", F.lit("-"), F.col("p_size").cast("string")).alias("alias")), text)


@query(
    "occurrence_validity",
    """WITH o AS (SELECT doc_id AS item_id, sha256(CASE WHEN doc_id % 3 = 0 THEN coalesce(text, '') || ' ' ELSE coalesce(text, '') END) AS sha FROM documents)
SELECT o.item_id, o.sha FROM o JOIN documents d ON d.doc_id = o.item_id WHERE sha256(coalesce(d.text, '')) = o.sha""",
)
def _(spark, sf_dir):
    docs = table(spark, sf_dir, "documents", ["doc_id", "text"])
    text = F.coalesce("text", F.lit(""))
    pinned = docs.select(F.col("doc_id").alias("item_id"), F.sha2(F.when(F.col("doc_id") % 3 == 0, F.concat(text, F.lit(" "))).otherwise(text), 256).alias("sha"))
    return entities.valid_occurrences(pinned, docs.select(F.col("doc_id").alias("item_id"), "text"))
