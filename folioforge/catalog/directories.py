"""Directories, holdings, letters and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioforge.operators import directory
from folioforge.registry import query
from folioforge.sources.tables import table

_PAIRS = """pairs AS (SELECT o_custkey AS identity, l_partkey AS item_id, ['PHOTO', 'TEXT', 'VIDEO'][(l_partkey + l_linenumber) % 3 + 1] AS item_type
  FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"""


def pairs(spark, sf_dir):
    orders = table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey"])
    lines = table(spark, sf_dir, "lineitem", ["l_orderkey", "l_partkey", "l_linenumber"])
    kind = F.element_at(F.array(*map(F.lit, ("PHOTO", "TEXT", "VIDEO"))), ((F.col("l_partkey") + F.col("l_linenumber")) % 3 + 1).cast("int"))
    return orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("identity"), F.col("l_partkey").alias("item_id"), kind.alias("item_type"))


_HOLDINGS = f"""WITH {_PAIRS}, one AS (SELECT identity, item_id, min(item_type) AS item_type FROM pairs GROUP BY ALL),
h AS (SELECT identity, item_type, count(*)::BIGINT AS n FROM one GROUP BY ALL)"""


@query("holdings_by_type", f"{_HOLDINGS} SELECT identity, item_type, n FROM h")
def _(spark, sf_dir):
    return directory.holdings(pairs(spark, sf_dir))


@query(
    "holdings_summary",
    f"""{_HOLDINGS} SELECT identity, string_agg(n || ' ' || lower(item_type) || CASE WHEN n = 1 THEN '' ELSE 's' END, ' · '
  ORDER BY list_position(['TEXT', 'PHOTO', 'VIDEO'], item_type)) AS summary FROM h GROUP BY identity""",
)
def _(spark, sf_dir):
    return directory.holdings_summary(directory.holdings(pairs(spark, sf_dir)), ("TEXT", "PHOTO", "VIDEO"))


_UNION = """u AS (SELECT c_name AS name, 0 AS kind_rank, c_custkey AS id FROM customer
  UNION ALL SELECT s_name, 1, s_suppkey FROM supplier WHERE s_suppkey * 31 NOT IN (SELECT c_custkey FROM customer))"""


def identities(spark, sf_dir):
    persons = table(spark, sf_dir, "customer", ["c_custkey", "c_name"]).select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    authors = table(spark, sf_dir, "supplier", ["s_suppkey", "s_name"]).select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), (F.col("s_suppkey") * 31).alias("person_id"))
    return directory.union_directory(persons, authors)


@query("directory_union_page", f"WITH {_UNION} SELECT name, kind_rank, id FROM u ORDER BY name, kind_rank, id LIMIT 48 OFFSET 48")
def _(spark, sf_dir):
    return identities(spark, sf_dir).orderBy("name", "kind_rank", "id").offset(48).limit(48)


@query(
    "directory_places",
    f"WITH {_UNION} SELECT id, kind_rank, row_number() OVER (ORDER BY name, kind_rank, id)::BIGINT AS place FROM u",
)
def _(spark, sf_dir):
    return directory.with_places(identities(spark, sf_dir), ["name", "kind_rank", "id"]).select("id", "kind_rank", "place")


@query(
    "letter_pages",
    """WITH p AS (SELECT p_name AS name, p_partkey AS id, row_number() OVER (ORDER BY p_name, p_partkey) AS place FROM part)
SELECT upper(name[1]) AS letter, (min(place - 1) // 48 + 1)::BIGINT AS page FROM p GROUP BY 1""",
)
def _(spark, sf_dir):
    return directory.letter_pages(table(spark, sf_dir, "part", ["p_partkey", "p_name"]).select(F.col("p_name").alias("name"), F.col("p_partkey").alias("id")), 48)


@query(
    "letter_islands",
    """WITH n AS (SELECT p_size AS scope, p_brand AS k, upper(p_name[1]) AS letter, p_partkey AS id FROM part),
s AS (SELECT *, coalesce((letter <> lag(letter) OVER w)::INT, 1) AS step FROM n WINDOW w AS (PARTITION BY scope ORDER BY k, id)),
r AS (SELECT *, sum(step) OVER (PARTITION BY scope ORDER BY k, id) AS run FROM s),
g AS (SELECT scope, run::BIGINT AS run, letter, count(*)::BIGINT AS n FROM r GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY scope, letter ORDER BY run)::INTEGER AS occurrence FROM g""",
)
def _(spark, sf_dir):
    from pyspark.sql import Window

    from folioforge.functions.text import index_letter

    rows = table(spark, sf_dir, "part", ["p_partkey", "p_name", "p_brand", "p_size"])
    order = Window.partitionBy("scope").orderBy("k", "id")
    rows = rows.select(F.col("p_size").alias("scope"), F.col("p_brand").alias("k"), index_letter(F.col("p_name")).alias("letter"), F.col("p_partkey").alias("id"))
    return directory.runs_of(rows, order)


@query("keyset_scan", "SELECT doc_id, lang FROM documents WHERE doc_id > 100 ORDER BY doc_id LIMIT 50")
def _(spark, sf_dir):
    return directory.keyset(table(spark, sf_dir, "documents", ["doc_id", "lang"]), "doc_id", 100, 50)


@query(
    "staff_counts_distinct",
    """SELECT s_suppkey, (SELECT count(DISTINCT l_partkey) FROM lineitem WHERE l_suppkey = s_suppkey)::BIGINT AS parts,
  (SELECT count(DISTINCT c_custkey) FROM customer WHERE c_nationkey = s_nationkey)::BIGINT AS neighbours FROM supplier""",
)
def _(spark, sf_dir):
    base = table(spark, sf_dir, "supplier", ["s_suppkey", "s_nationkey"])
    parts = table(spark, sf_dir, "lineitem", ["l_suppkey", "l_partkey"]).withColumnRenamed("l_suppkey", "s_suppkey")
    near = table(spark, sf_dir, "customer", ["c_custkey", "c_nationkey"]).withColumnRenamed("c_nationkey", "s_nationkey")
    first = directory.counts_without_fan_out(base, "s_suppkey", {"parts": (parts, "l_partkey")})
    return directory.counts_without_fan_out(first, "s_nationkey", {"neighbours": (near, "c_custkey")}).select("s_suppkey", "parts", "neighbours")


@query(
    "photo_superset_division",
    """WITH l AS (SELECT o_custkey AS item_id, l_orderkey AS photo_id, (l_orderkey % 7)::BIGINT AS position, l_returnflag AS person FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
f AS (SELECT item_id, photo_id, position FROM l WHERE person IN ('A', 'N', 'R') GROUP BY ALL HAVING count(DISTINCT person) = 3)
SELECT item_id, arg_min(photo_id, (position, photo_id)) AS photo_id FROM f GROUP BY item_id""",
)
def _(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem", ["l_orderkey", "l_returnflag"])
    orders = table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey"])
    links = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("item_id"), F.col("l_orderkey").alias("photo_id"), (F.col("l_orderkey") % 7).alias("position"), F.col("l_returnflag").alias("person_id")
    )
    return directory.photos_with_all(links, ["A", "N", "R"])


@query(
    "first_photo_scalar",
    "SELECT o_custkey AS item_id, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS photo_id, count(*)::BIGINT AS photos FROM orders GROUP BY 1",
)
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderdate"])
    first = F.min(F.struct("o_orderdate", "o_orderkey"))["o_orderkey"]
    return rows.groupBy(F.col("o_custkey").alias("item_id")).agg(first.alias("photo_id"), F.count(F.lit(1)).alias("photos"))


@query("sample_cards")
def _(spark, sf_dir):
    from folioforge.operators.access import visible
    from folioforge.sources.archive import items

    return visible(items(spark, sf_dir)).select("item_id", "title").orderBy(F.rand()).limit(3)
