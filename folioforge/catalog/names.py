"""The registry's names behind grams: ranked lookups, short queries, pages of results and of the whole directory."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from folioforge.operators.names import Registry
from folioforge.registry import query
from folioforge.sources.shared import shared_folder
from folioforge.sources.tables import table

#: Every 7th display name is blank, every 3rd begins in Hebrew, the others with a minus sign; every 41st entity is retired.
_NAMES = """e AS (SELECT p_partkey AS entity_id, CASE WHEN p_partkey % 7 = 0 THEN '  ' WHEN p_partkey % 3 = 0 THEN 'בית־ספר ' || p_name ELSE 'a−b ' || p_name END AS display, p_brand || ' ' || p_name AS canonical,
  p_brand AS entity_type FROM part WHERE p_partkey % 41 <> 0),
p AS (SELECT *, replace(CASE WHEN trim(display) <> '' THEN display ELSE canonical END, '−', '-') AS public FROM e),
n AS (SELECT entity_id, 1 AS source, NULL::BIGINT AS alias_id, display AS name, false AS hidden FROM e UNION ALL SELECT entity_id, 2, NULL, canonical, false FROM e
  UNION ALL SELECT p_partkey // 2, 3, p_partkey, p_type || '–' || p_size, p_partkey % 5 = 0 FROM part WHERE (p_partkey // 2) % 41 <> 0),
l AS (SELECT *, replace(replace(name, '–', '-'), '−', '-') AS shown FROM n)"""
_built: dict[tuple[str, str], str] = {}


def _lookup_sql(text: str) -> str:
    """The same lookup as a scan of all names; `text` is folded."""
    return f"""{_NAMES}, m AS (SELECT *, CASE WHEN lower(shown) = '{text}' THEN source WHEN starts_with(lower(shown), '{text}') THEN CASE WHEN source = 3 THEN 5 ELSE 4 END
  WHEN contains(lower(shown), '{text}') THEN CASE WHEN source = 3 THEN 7 ELSE 6 END END AS rank FROM l),
b AS (SELECT entity_id, min(rank)::INTEGER AS rank FROM m WHERE rank IS NOT NULL GROUP BY 1),
s AS (SELECT entity_id, shown FROM m WHERE rank IS NOT NULL AND source = 3 AND NOT hidden QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY rank, lower(shown), alias_id) = 1),
found AS (SELECT b.entity_id, b.rank, p.public, p.entity_type, CASE WHEN b.rank IN (3, 5, 7) THEN s.shown END AS matched_alias FROM b JOIN p USING (entity_id) LEFT JOIN s USING (entity_id))"""


def names(spark, sf_dir) -> Registry:
    """The index of a directory's names, built once in a session."""
    key = (spark.sparkContext.applicationId, sf_dir.rstrip("/"))
    if key not in _built:
        part, k = table(spark, sf_dir, "part", ["p_partkey", "p_name", "p_brand", "p_type", "p_size"]), F.col("p_partkey")
        display = F.when(k % 7 == 0, "  ").when(k % 3 == 0, F.concat(F.lit("בית־ספר "), "p_name")).otherwise(F.concat(F.lit("a−b "), "p_name"))
        entities = part.select(k.alias("entity_id"), display.alias("display"), F.concat_ws(" ", "p_brand", "p_name").alias("canonical"), F.col("p_brand").alias("entity_type"))
        alias, kind = F.concat("p_type", F.lit("–"), F.col("p_size").cast("string")), F.when(k % 5 == 0, "OCR_VARIANT").otherwise("OTHER")
        aliases = part.select(k.alias("alias_id"), F.floor(k / 2).alias("entity_id"), alias.alias("alias"), kind.alias("kind"))
        retired = part.filter(k % 41 == 0).select(k.alias("entity_id"))
        _built[key] = Registry(spark, f"{shared_folder(spark)}/folioforge-names/{uuid.uuid4().hex}").build(entities, aliases, retired).path
    return Registry(spark, _built[key])


def _register(name: str, raw: str, text: str) -> None:
    @query(name, f"WITH {_lookup_sql(text)} SELECT entity_id, rank, public, matched_alias FROM found")
    def _(spark, sf_dir):
        return names(spark, sf_dir).lookup(raw)


_register("names_lookup", " Small−1 ", "small-1")
_register("names_lookup_maqaf", "בית־ספר S", "בית־ספר s")
_register("names_lookup_short", "5", "5")
_register("names_lookup_within", "D WIDG", "d widg")


@query(
    "names_lookup_page",
    f"WITH {_lookup_sql('ring')} SELECT row_number() OVER (ORDER BY rank, lower(public), entity_id) AS place, entity_id, rank, public, matched_alias FROM found WHERE entity_type = 'Brand#2' QUALIFY place BETWEEN 1 AND 5",
)
def _(spark, sf_dir):
    return names(spark, sf_dir).page("ring", 0, 5, "Brand#2")[0]


_SORTED = "CASE WHEN starts_with(public, 'בית') THEN 0 ELSE 1 END, lower(public), entity_id"


@query(
    "names_directory_last_page",
    f"""WITH {_NAMES}, o AS (SELECT row_number() OVER (ORDER BY {_SORTED}) AS place, entity_id, 0 AS rank, public, NULL::VARCHAR AS matched_alias FROM p)
SELECT * FROM o WHERE place > (SELECT (count(*) - 1) // 10 * 10 FROM o)""",
)
def _(spark, sf_dir):
    return names(spark, sf_dir).page("", 1_000_000_000, 10)[0]
