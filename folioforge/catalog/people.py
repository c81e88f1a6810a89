"""Persons, authors and their names."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioforge.operators import people
from folioforge.registry import query
from folioforge.sources.tables import table


def _persons(spark, sf_dir):
    k = F.col("c_custkey")
    biography = F.when(k % 4 == 0, "  ").when(k % 4 == 1, F.col("c_mktsegment"))
    return table(spark, sf_dir, "customer", ["c_custkey", "c_name", "c_mktsegment"]).select(k.alias("person_id"), F.col("c_name").alias("name"), biography.alias("biography"))


def _visible(spark, sf_dir):
    return table(spark, sf_dir, "orders", ["o_orderkey", "o_orderstatus"]).filter("o_orderstatus = 'O'").select(F.col("o_orderkey").alias("item_id"))


def _authors(spark, sf_dir):
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier", ["s_suppkey"]).select(k.alias("author_id"), F.when(k % 2 == 0, k * 3).alias("person_id"))


def _links(spark, sf_dir):
    return table(spark, sf_dir, "lineitem", ["l_orderkey", "l_suppkey", "l_returnflag"]).filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("item_id"), F.col("l_suppkey").alias("author_id"))


_BASE = """visible AS (SELECT o_orderkey AS item_id FROM orders WHERE o_orderstatus = 'O'),
authors AS (SELECT s_suppkey AS author_id, CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey * 3 END AS person_id FROM supplier),
links AS (SELECT l_orderkey AS item_id, l_suppkey AS author_id FROM lineitem WHERE l_returnflag = 'R'),
written AS (SELECT DISTINCT person_id, item_id FROM links JOIN visible USING (item_id) JOIN authors USING (author_id) WHERE person_id IS NOT NULL)"""


@query(
    "person_search",
    """SELECT c_custkey AS person_id FROM customer WHERE contains(lower(c_name), 'n_1') UNION SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 3 = 0 AND contains(lower(n_name), 'n_1')
UNION SELECT c_custkey FROM customer WHERE c_custkey % 4 = 0 AND contains(lower(c_mktsegment), 'n_1') UNION SELECT c_custkey FROM customer WHERE c_custkey % 4 = 1 AND contains('family_n_1' || c_custkey, 'n_1')""",
)
def _(spark, sf_dir):
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer", ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"]).withColumnRenamed("c_custkey", "person_id")
    k = F.col("person_id")
    nation = table(spark, sf_dir, "nation", ["n_nationkey", "n_name"])
    aliases = rows.filter(k % 3 == 0).join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("person_id", F.col("n_name").alias("name"))
    families = rows.filter(k % 4 == 0).select("person_id", F.col("c_mktsegment").alias("name")).unionByName(rows.filter(k % 4 == 1).select("person_id", F.concat(F.lit("FAMILY_N_1"), k).alias("name")))
    return people.named(rows.select("person_id", F.col("c_name").alias("name")), aliases, families, " N_1 ")


@query("person_authored_items", f"WITH {_BASE} SELECT person_id, item_id FROM written")
def _(spark, sf_dir):
    return people.authored(_links(spark, sf_dir), _authors(spark, sf_dir), _visible(spark, sf_dir))


@query("public_authors", f"WITH {_BASE} SELECT author_id FROM authors WHERE author_id IN (SELECT author_id FROM links JOIN visible USING (item_id))")
def _(spark, sf_dir):
    return people.public_authors(_authors(spark, sf_dir), _links(spark, sf_dir), _visible(spark, sf_dir)).select("author_id")


_WAYS = f"""WITH {_BASE}, direct AS (SELECT DISTINCT o_custkey AS person_id, o_orderkey AS item_id FROM orders WHERE o_orderpriority LIKE '1%'),
pictured AS (SELECT l_suppkey % 40 AS person_id, l_orderkey AS item_id, l_linenumber AS position, l_partkey AS photo_id FROM lineitem WHERE l_returnflag = 'A')"""


def _ways(spark, sf_dir):
    direct = table(spark, sf_dir, "orders", ["o_custkey", "o_orderkey", "o_orderpriority"]).filter("o_orderpriority LIKE '1%'").select(F.col("o_custkey").alias("person_id"), F.col("o_orderkey").alias("item_id"))
    pictured = table(spark, sf_dir, "lineitem", ["l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_returnflag"]).filter("l_returnflag = 'A'").select(
        (F.col("l_suppkey") % 40).alias("person_id"), F.col("l_orderkey").alias("item_id"), F.col("l_linenumber").alias("position"), F.col("l_partkey").alias("photo_id")
    )
    return direct, pictured, people.authored(_links(spark, sf_dir), _authors(spark, sf_dir), _visible(spark, sf_dir))


@query(
    "public_persons",
    f"""{_WAYS} SELECT c_custkey AS person_id FROM customer WHERE c_custkey % 4 = 1 OR c_custkey IN (SELECT person_id FROM written) OR c_custkey IN (SELECT person_id FROM direct)""",
)
def _(spark, sf_dir):
    direct, _, written = _ways(spark, sf_dir)
    return people.public_persons(_persons(spark, sf_dir), direct, written).select("person_id")


@query(
    "person_items",
    f"""{_WAYS}, f AS (SELECT person_id, item_id, arg_min(photo_id, (position, photo_id)) AS photo_id FROM pictured GROUP BY ALL),
k AS (SELECT person_id, item_id FROM direct UNION ALL SELECT person_id, item_id FROM f UNION ALL SELECT person_id, item_id FROM written), u AS (SELECT person_id, item_id, count(*)::BIGINT AS ways FROM k GROUP BY ALL)
SELECT person_id, item_id, ways, photo_id FROM u LEFT JOIN f USING (person_id, item_id)""",
)
def _(spark, sf_dir):
    return people.items_of_persons(*_ways(spark, sf_dir))


@query(
    "person_further_names",
    """WITH a AS (SELECT p_size AS person_id, p_partkey AS alias_id, trim(CASE WHEN p_partkey % 9 = 0 THEN ' ' WHEN p_partkey % 2 = 0 THEN upper(p_name) ELSE p_name END) AS name, p_type AS kind FROM part WHERE p_partkey % 5 <> 0),
o AS (SELECT a.*, lower(name) AS key FROM a WHERE name <> '' AND lower(name) <> 'small ring'), f AS (SELECT person_id, key, arg_min(name, alias_id) AS name, arg_min(kind, alias_id) AS kind FROM o GROUP BY ALL)
SELECT person_id, CASE WHEN kind IN ('ECONOMY', 'PROMO') THEN kind ELSE 'other' END AS kind, string_agg(name, ', ' ORDER BY name COLLATE "C") AS names FROM f GROUP BY ALL""",
)
def _(spark, sf_dir):
    k = F.col("p_partkey")
    part = table(spark, sf_dir, "part", ["p_partkey", "p_name", "p_type", "p_size"])
    name = F.when(k % 9 == 0, " ").when(k % 2 == 0, F.upper("p_name")).otherwise(F.col("p_name"))
    aliases = part.select(F.col("p_size").alias("person_id"), k.alias("alias_id"), name.alias("name"), F.col("p_type").alias("kind"), (k % 5 != 0).alias("is_public"))
    return people.further_names(aliases.select("person_id").distinct().withColumn("name", F.lit("Small Ring")), aliases, ("ECONOMY", "PROMO"))


@query(
    "photo_metadata_segments",
    """WITH p AS (SELECT o_custkey AS item_id, o_orderkey AS photo_id, o_orderkey % 5 AS position, [o_orderpriority, ' ' || o_orderstatus || '  x ', ''] AS texts FROM orders),
t AS (SELECT item_id, trim(regexp_replace(unnest(texts), '\\s+', ' ', 'g')) AS x, position, photo_id, unnest(range(len(texts))) AS k FROM p),
s AS (SELECT DISTINCT item_id, 'Person ' || l_suppkey % 3 AS x FROM p JOIN lineitem ON l_orderkey = photo_id),
u AS (SELECT item_id, x, (position, photo_id, k) AS o, 0 AS part FROM t UNION ALL SELECT item_id, x, (0, 0, 0), 1 FROM s),
f AS (SELECT item_id, x, min(part) AS part, min(o) FILTER (part = 0) AS o FROM u WHERE x <> '' GROUP BY ALL)
SELECT item_id, string_agg(x, chr(10) ORDER BY part, o, x) AS segments FROM f GROUP BY item_id""",
)
def _(spark, sf_dir):
    k = F.col("o_orderkey")
    texts = F.array(F.col("o_orderpriority"), F.concat(F.lit(" "), "o_orderstatus", F.lit("  x ")), F.lit(""))
    photos = table(spark, sf_dir, "orders", ["o_custkey", "o_orderkey", "o_orderpriority", "o_orderstatus"]).select(F.col("o_custkey").alias("item_id"), k.alias("photo_id"), (k % 5).alias("position"), texts.alias("texts"))
    shown = table(spark, sf_dir, "lineitem", ["l_orderkey", "l_suppkey"]).select(F.col("l_orderkey").alias("photo_id"), F.concat(F.lit("Person "), F.col("l_suppkey") % 3).alias("name"))
    return people.photo_fields(photos, shown)


@query(
    "group_outliers",
    """WITH m AS (SELECT l_suppkey AS "group", l_orderkey * 10 + l_linenumber AS member, l_quantity > 45 AS short, l_discount > 0.09 AS many FROM lineitem GROUP BY ALL),
c AS (SELECT *, count(*) FILTER (short) OVER w AS s, count(*) FILTER (many) OVER w AS k, count(*) OVER w AS n FROM m WINDOW w AS (PARTITION BY "group")),
r AS (SELECT "group", member, CASE WHEN short AND s < n THEN 0 WHEN many AND k < n THEN 1 END AS risk FROM c)
SELECT "group", member, (row_number() OVER (PARTITION BY "group" ORDER BY risk, member))::INTEGER AS place FROM r WHERE risk IS NOT NULL QUALIFY place <= 3""",
)
def _(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem", ["l_suppkey", "l_orderkey", "l_linenumber", "l_quantity", "l_discount"])
    members = lines.select(F.col("l_suppkey").alias("group"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("member"), (F.col("l_quantity") > 45).alias("short"), (F.col("l_discount") > 0.09).alias("many"))
    return people.outliers(members.distinct(), ("short", "many"))
