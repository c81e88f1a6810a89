"""Search, authorisation and filter queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioforge.operators import access, filters, search
from folioforge.registry import query
from folioforge.sources.archive import ITEMS_SQL, items, search_index
from folioforge.sources.tables import table

QUERY = "the ing"
_TOKENS = "list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"


def _tok(field: str) -> str:
    return _TOKENS.format(field)


def _search_sql(terms: list[str], body: str) -> str:
    every = " AND ".join(
        f"(list_contains(t_title, '{t}') OR list_contains(t_meta, '{t}') OR list_contains(t_body, '{t}') OR contains(lower(title), '{t}') OR contains(lower(metadata), '{t}'))" for t in terms
    )
    whole = lambda f: " AND ".join(f"list_contains({f}, '{t}')" for t in terms)
    some = lambda f: " OR ".join(f"contains(lower({f}), '{t}')" for t in terms)
    return f"""WITH {ITEMS_SQL},
v AS (SELECT *, {_tok('title')} AS t_title, {_tok('metadata')} AS t_meta, {_tok('body')} AS t_body FROM items WHERE visibility = 'PUBLIC'),
hit AS (SELECT *, round((CASE WHEN {whole('t_title')} THEN 1.0 ELSE 0.0 END + CASE WHEN {whole('t_meta')} THEN 0.4 ELSE 0.0 END
  + CASE WHEN {whole('t_body')} THEN 0.2 ELSE 0.0 END + CASE WHEN {some('title')} THEN 1.0 ELSE 0.0 END + CASE WHEN {some('metadata')} THEN 0.4 ELSE 0.0 END)::DOUBLE, 6) AS relevance
  FROM v WHERE {every})
{body}"""


def _search(spark, sf_dir, text):
    return search.search(access.visible(items(spark, sf_dir)), search_index(spark, sf_dir), text)


def order():
    return [F.desc("relevance"), F.desc("created_day"), F.asc("item_id")]


@query("search_ranked_page", _search_sql(["the", "ing"], "SELECT item_id, relevance, created_day FROM hit ORDER BY relevance DESC, created_day DESC, item_id LIMIT 48"))
def _(spark, sf_dir):
    found = _search(spark, sf_dir, QUERY)
    return search.page(found, order()).select("item_id", "relevance", "created_day")


@query("search_second_page", _search_sql(["of"], "SELECT item_id, relevance FROM hit ORDER BY relevance DESC, created_day DESC, item_id LIMIT 24 OFFSET 24"))
def _(spark, sf_dir):
    found = _search(spark, sf_dir, "of")
    return search.page(found, order(), number=2, size=24).select("item_id", "relevance")


@query("search_all_matches", _search_sql(["and"], "SELECT item_id, relevance FROM hit"))
def _(spark, sf_dir):
    return _search(spark, sf_dir, "And").select("item_id", "relevance")


@query(
    "search_type_tab_counts",
    _search_sql(["the"], """SELECT count(*)::BIGINT AS all_items, count(*) FILTER (item_type IN ('DOCUMENT', 'TEXT'))::BIGINT AS documents_and_texts,
  count(*) FILTER (item_type = 'PHOTO')::BIGINT AS photos, count(*) FILTER (item_type = 'VIDEO')::BIGINT AS videos FROM hit"""),
)
def _(spark, sf_dir):
    return search.type_counts(_search(spark, sf_dir, "the"))


@query(
    "public_last_page",
    f"""WITH {ITEMS_SQL}, v AS (SELECT item_id, created_day FROM items WHERE visibility = 'PUBLIC'), n AS (SELECT greatest(1, (count(*) + 23) // 24) AS last, count(*) AS total FROM v),
r AS (SELECT *, row_number() OVER (ORDER BY created_day DESC, item_id DESC) AS place FROM v)
SELECT item_id, last::BIGINT AS page, total::BIGINT AS total FROM r, n WHERE place > (last - 1) * 24""",
)
def _(spark, sf_dir):
    rows, number, total = search.clamped_page(access.visible(items(spark, sf_dir)), [F.desc("created_day"), F.desc("item_id")], 10**9, 24)
    return rows.select("item_id", F.lit(number).cast("long").alias("page"), F.lit(total).cast("long").alias("total"))


@query(
    "search_term_union_candidates",
    f"""WITH {ITEMS_SQL}, v AS (SELECT * FROM items WHERE visibility = 'PUBLIC')
SELECT item_id FROM v WHERE list_contains({_tok("concat_ws(' ', title, metadata, body)")}, 'der')
UNION SELECT item_id FROM v WHERE contains(lower(title), 'der') UNION SELECT item_id FROM v WHERE contains(lower(metadata), 'der')""",
)
def _(spark, sf_dir):
    return search.term_candidates(access.visible(items(spark, sf_dir)), search_index(spark, sf_dir), "der")


@query(
    "facet_choices",
    f"""WITH {ITEMS_SQL}, v AS (SELECT * FROM items WHERE visibility = 'PUBLIC'),
p AS (SELECT 'author' AS dimension, author AS choice FROM v UNION SELECT 'language', language FROM v UNION SELECT 'item_type', item_type FROM v)
SELECT * FROM p WHERE choice IS NOT NULL AND choice <> 'src3'""",
)
def _(spark, sf_dir):
    return search.facets(access.visible(items(spark, sf_dir)), ["src3"])


@query(
    "posting_index",
    f"""WITH {ITEMS_SQL},
f AS (SELECT item_id, 'A' AS field, {_tok('title')} AS t FROM items UNION ALL SELECT item_id, 'B', {_tok('metadata')} FROM items UNION ALL SELECT item_id, 'C', {_tok('body')} FROM items),
e AS (SELECT item_id, field, unnest(t) AS token, unnest(range(len(t))) AS pos FROM f)
SELECT item_id, token, field, count(*)::BIGINT AS n, min(pos)::BIGINT AS first FROM e GROUP BY ALL""",
)
def _(spark, sf_dir):
    return search.postings(items(spark, sf_dir))


@query(
    "match_source_label",
    f"""WITH {ITEMS_SQL}, h AS (SELECT item_id, coalesce(contains(lower(author), 'src1'), false) AS a, coalesce(contains(lower(language), 'src1'), false) AS l, coalesce(contains(lower(title), 'src1'), false) AS t FROM items)
SELECT item_id, CASE WHEN a::INT + l::INT + t::INT > 1 THEN 'several' WHEN a THEN 'author' WHEN l THEN 'language' WHEN t THEN 'title' ELSE 'none' END AS label FROM h""",
)
def _(spark, sf_dir):
    return search.match_label(items(spark, sf_dir), "src1")


@query(
    "literal_match_counts",
    f"WITH {ITEMS_SQL} SELECT item_id, ((length(lower(body)) - length(replace(lower(body), 'the', ''))) // 3)::BIGINT AS n FROM items",
)
def _(spark, sf_dir):
    return items(spark, sf_dir).select("item_id", search.literal_matches(F.col("body"), "the").alias("n"))


@query(
    "visibility_rls",
    f"""WITH {ITEMS_SQL}, r AS (SELECT unnest(['public', 'family', 'admin']) AS role)
SELECT role, visibility, count(*)::BIGINT AS n FROM items, r
WHERE visibility = 'PUBLIC' OR (visibility = 'PRIVATE' AND role <> 'public') OR (visibility = 'RESTRICTED' AND role = 'admin') GROUP BY ALL""",
)
def _(spark, sf_dir):
    base = items(spark, sf_dir).select("item_id", "visibility")
    roles = [access.visible(base, r).groupBy("visibility").agg(F.count(F.lit(1)).alias("n")).select(F.lit(r).alias("role"), "visibility", "n") for r in access.ALLOWED]
    return roles[0].unionByName(roles[1]).unionByName(roles[2])


_PHOTOS = """photos AS (SELECT o_custkey AS item_id, o_orderkey AS photo_id, (o_orderkey % 5)::INTEGER AS position,
  CASE WHEN o_orderstatus = 'F' THEN 'FAILED' ELSE 'UPLOADED' END AS status, CASE WHEN o_orderkey % 13 = 0 THEN ' ' ELSE 'k' || o_orderkey END AS key FROM orders)"""


def photos(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders", ["o_custkey", "o_orderkey", "o_orderstatus"]).select(
        F.col("o_custkey").alias("item_id"), k.alias("photo_id"), (k % 5).cast("int").alias("position"),
        F.when(F.col("o_orderstatus") == "F", "FAILED").otherwise("UPLOADED").alias("status"), F.when(k % 13 == 0, " ").otherwise(F.concat(F.lit("k"), k)).alias("key"),
    )


@query(
    "browse_renderable",
    f"""WITH {ITEMS_SQL}, {_PHOTOS},
first AS (SELECT * FROM photos QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY position, photo_id) = 1),
good AS (SELECT item_id FROM first WHERE status = 'UPLOADED' AND length(trim(key)) > 0)
SELECT i.item_id, i.item_type FROM items i LEFT JOIN good g ON i.item_id = g.item_id
WHERE visibility = 'PUBLIC' AND CASE item_type WHEN 'PHOTO' THEN g.item_id IS NOT NULL WHEN 'DOCUMENT' THEN upload_status = 'UPLOADED' ELSE true END""",
)
def _(spark, sf_dir):
    return access.renderable(access.visible(items(spark, sf_dir)), photos(spark, sf_dir)).select("item_id", "item_type")


@query("uploaded_documents", f"WITH {ITEMS_SQL} SELECT item_id FROM items WHERE visibility IN ('PUBLIC', 'PRIVATE') AND upload_status = 'UPLOADED'")
def _(spark, sf_dir):
    return access.uploaded_for(items(spark, sf_dir), "family").select("item_id")


@query(
    "exists_or_membership",
    """WITH i AS (SELECT o_orderkey AS item_id, 'Customer#' || lpad((o_orderkey % 2000)::VARCHAR, 9, '0') AS author FROM orders),
l AS (SELECT l_orderkey AS item_id, l_suppkey AS author_id FROM lineitem WHERE l_returnflag = 'R'),
n AS (SELECT c_name AS name, min(c_custkey) AS author_id FROM customer GROUP BY 1 HAVING count(*) = 1)
SELECT DISTINCT i.item_id, l.author_id FROM i JOIN l USING (item_id)
UNION SELECT i.item_id, n.author_id FROM i JOIN n ON i.author = n.name WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.item_id = i.item_id)""",
)
def _(spark, sf_dir):
    k = F.col("o_orderkey")
    own = table(spark, sf_dir, "orders", ["o_orderkey"]).select(k.alias("item_id"), F.concat(F.lit("Customer#"), F.lpad((k % 2000).cast("string"), 9, "0")).alias("author"))
    links = table(spark, sf_dir, "lineitem", ["l_orderkey", "l_suppkey", "l_returnflag"]).filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("item_id"), F.col("l_suppkey").alias("author_id"))
    names = table(spark, sf_dir, "customer", ["c_custkey", "c_name"]).select(F.col("c_custkey").alias("author_id"), F.col("c_name").alias("name"))
    return access.member_or_named(own, links, names)


@query(
    "advanced_filter_all",
    f"""WITH {ITEMS_SQL} SELECT item_id, language FROM items
WHERE language IN ('en', 'fr') AND item_type IN ('TEXT', 'PHOTO') AND item_id IN (SELECT doc_id FROM labels WHERE quality = 1)""",
)
def _(spark, sf_dir):
    labels = table(spark, sf_dir, "labels", ["doc_id", "quality"]).select(F.col("doc_id").alias("item_id"), F.col("quality").alias("value"))
    return filters.advanced(items(spark, sf_dir), {"language": ["en", "fr"], "item_type": ["TEXT", "PHOTO"], "quality": [1]}, {"quality": labels}).select("item_id", "language")


@query(
    "route_requests",
    """WITH t(event_type, k, engine) AS (VALUES ('view', 0, 'gemini'), ('view', 1, 'vision'), ('click', 0, 'htr'), ('error', 1, 'gemini'))
SELECT e.event_id, t.engine, CASE WHEN t.engine IS NULL THEN 'no_route' END AS error FROM events e LEFT JOIN t ON e.event_type = t.event_type AND e.user_id % 2 = t.k""",
)
def _(spark, sf_dir):
    route = spark.createDataFrame([("view", 0, "gemini"), ("view", 1, "vision"), ("click", 0, "htr"), ("error", 1, "gemini")], "event_type string, k long, engine string")
    own = table(spark, sf_dir, "events", ["event_id", "event_type", "user_id"]).withColumn("k", F.col("user_id") % 2)
    return filters.routes(own, route, ["event_type", "k"]).select("event_id", "engine", "error")
