"""Reviewed registries, entity runs, topic pages, backfills, and the small rules of texts and dates."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioforge.catalog.entities import _HITS, hits, surfaces
from folioforge.catalog.graphs import _CLOSED, _DIRECT, direct, edges
from folioforge.catalog.text import words
from folioforge.functions import dates, text
from folioforge.operators import entities, graph, ordered, search
from folioforge.plans import registry as plans
from folioforge.registry import query
from folioforge.sources import files
from folioforge.sources.archive import ITEMS_SQL, RESULTS_SQL, items, text_results
from folioforge.sources.tables import table

def _k():
    return F.col("p_partkey")

_REVIEW = """rows AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 4 = 0 THEN 'REJECT' ELSE 'APPROVE' END AS decision, p_name AS canonical FROM part),
aliases AS (SELECT p_partkey AS alias_id, CASE WHEN p_partkey % 17 = 0 THEN '' ELSE (p_partkey // 2 + (p_partkey % 19 = 0)::INT * 100000)::VARCHAR END AS target, CASE WHEN p_partkey % 13 = 0 THEN '' ELSE p_brand END AS name,
  CASE WHEN p_partkey % 5 = 0 THEN 'ODD' ELSE 'SPELLING' END AS kind, CASE WHEN p_partkey % 6 = 0 THEN 'PENDING' ELSE 'APPROVED' END AS status, CASE WHEN p_partkey % 3 = 0 THEN 'x' ELSE p_name END AS canonical FROM part)"""


@query(
    "alias_review_errors",
    f"""WITH {_REVIEW}, m AS (SELECT a.*, r.decision, r.canonical AS own, r.id IS NOT NULL AS known, count(*) OVER (PARTITION BY target, name) > 1 AS twice FROM aliases a LEFT JOIN rows r ON a.target = r.id::VARCHAR),
e AS (SELECT alias_id, CASE WHEN target = '' THEN 'ALIAS_TARGET_MISSING' ELSE array_to_string(list_filter([CASE WHEN name = '' THEN 'ALIAS_NAME_BLANK' END, CASE WHEN kind <> 'SPELLING' THEN 'INVALID_ALIAS_KIND' END,
  CASE WHEN status <> 'APPROVED' THEN 'ALIAS_REVIEW_STATUS_NOT_APPROVED' END, CASE WHEN NOT known THEN 'ALIAS_TARGET_ABSENT' WHEN decision <> 'APPROVE' THEN 'ALIAS_TARGET_NOT_APPROVE' WHEN canonical <> own THEN 'ALIAS_CANONICAL_MISMATCH' END,
  CASE WHEN twice AND name <> '' THEN 'DUPLICATE_ALIAS' END], lambda x: x IS NOT NULL), ',') END AS errors FROM m)
SELECT alias_id, errors FROM e WHERE errors <> ''""",
)
def _(spark, sf_dir):
    part = table(spark, sf_dir, "part", ["p_partkey", "p_name", "p_brand"])
    rows = part.select(_k().cast("string").alias("id"), F.when(_k() % 4 == 0, "REJECT").otherwise("APPROVE").alias("decision"), F.col("p_name").alias("canonical"))
    target = F.when(_k() % 17 == 0, "").otherwise((F.floor(_k() / 2) + (_k() % 19 == 0).cast("int") * 100000).cast("string"))
    aliases = part.select(
        _k().alias("alias_id"), target.alias("target"), F.when(_k() % 13 == 0, "").otherwise(F.col("p_brand")).alias("name"), F.when(_k() % 5 == 0, "ODD").otherwise("SPELLING").alias("kind"),
        F.when(_k() % 6 == 0, "PENDING").otherwise("APPROVED").alias("status"), F.when(_k() % 3 == 0, "x").otherwise(F.col("p_name")).alias("canonical"),
    )
    return plans.alias_errors(aliases, rows, ("SPELLING", "SHORT_FORM"))


@query(
    "registry_diff",
    """WITH w AS (SELECT 'k' || c_custkey AS key, CASE WHEN c_custkey % 3 <> 0 THEN c_custkey + (c_custkey % 50 = 1)::INT * 10000000 END AS person_id, CASE WHEN c_custkey % 5 = 0 THEN 'New' ELSE c_name END AS name FROM customer WHERE c_custkey % 7 <> 0),
b AS (SELECT 'k' || c_custkey AS key, c_custkey + (c_custkey % 10 = 4)::INT AS person_id FROM customer WHERE c_custkey % 2 = 0),
j AS (SELECT coalesce(w.key, b.key) AS key, w.key IS NOT NULL AS wanted, w.person_id, w.name, b.key IS NOT NULL AS is_bound, b.person_id AS bound FROM w FULL JOIN b ON w.key = b.key)
SELECT key, CASE WHEN NOT wanted THEN 'UNEXPECTED_BINDING' WHEN person_id IS NOT NULL AND c_custkey IS NULL THEN 'MISSING_PERSON' WHEN is_bound AND bound IS DISTINCT FROM person_id THEN 'BOUND_ELSEWHERE' WHEN person_id IS NULL THEN 'CREATE' WHEN name <> c_name THEN 'UPDATE' ELSE 'NOOP' END AS status
FROM j LEFT JOIN customer ON c_custkey = person_id""",
)
def _(spark, sf_dir):
    c = F.col("c_custkey")
    rows, key = table(spark, sf_dir, "customer", ["c_custkey", "c_name"]), F.concat(F.lit("k"), c).alias("key")
    wanted = rows.filter(c % 7 != 0).select(key, F.when(c % 3 != 0, c + (c % 50 == 1).cast("int") * 10_000_000).alias("person_id"), F.when(c % 5 == 0, "New").otherwise(F.col("c_name")).alias("name"))
    bindings = rows.filter(c % 2 == 0).select(key, (c + (c % 10 == 4).cast("int")).alias("person_id"))
    return plans.registry_diff(wanted, rows.select(c.alias("person_id"), F.col("c_name").alias("name")), bindings)


@query(
    "frozen_tag_deletion",
    """WITH f AS (SELECT n_nationkey AS id, n_name AS name FROM nation WHERE n_nationkey % 5 = 0), l AS (SELECT c_nationkey AS id FROM customer WHERE c_nationkey % 5 <> 0)
SELECT CASE WHEN (SELECT count(*) FROM l SEMI JOIN f USING (id)) > 0 THEN 'BLOCKED' ELSE 'ALL_PRESENT' END AS state, count(*)::BIGINT AS found, 0::BIGINT AS links, 0::BIGINT AS pending FROM f""",
)
def _(spark, sf_dir):
    present = table(spark, sf_dir, "nation", ["n_nationkey", "n_name"]).toDF("id", "name")
    links = table(spark, sf_dir, "customer", ["c_nationkey"]).filter("c_nationkey % 5 <> 0").toDF("id")
    return plans.all_or_none(present.filter("id % 5 = 0"), present, links, table(spark, sf_dir, "region", ["r_name"]).toDF("name"))


@query(
    "frozen_tag_people",
    """WITH f AS (SELECT n_name AS tag, n_nationkey * 3 AS person_id FROM nation WHERE n_nationkey % 2 = 0), t AS (SELECT o_orderkey AS item_id, n_name AS tag FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)
SELECT DISTINCT item_id, person_id, CASE WHEN item_id % 4 = person_id % 4 THEN 'PRESENT' ELSE 'PLANNED' END AS status FROM t JOIN f USING (tag)""",
)
def _(spark, sf_dir):
    nation = table(spark, sf_dir, "nation", ["n_nationkey", "n_name"])
    frozen = nation.filter("n_nationkey % 2 = 0").select(F.col("n_name").alias("tag"), (F.col("n_nationkey") * 3).alias("person_id"))
    orders = table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey"])
    tagged = orders.join(table(spark, sf_dir, "customer", ["c_custkey", "c_nationkey"]), F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    linked = orders.select(F.col("o_orderkey").alias("item_id")).join(F.broadcast(frozen.select("person_id")), F.col("item_id") % 4 == F.col("person_id") % 4)
    return plans.tag_plan(frozen, tagged.select(F.col("o_orderkey").alias("item_id"), F.col("n_name").alias("tag")), linked)


@query(
    "guarded_link_insert",
    "SELECT o_orderkey AS item_id, o_custkey AS person_id, CASE WHEN o_orderkey % 3 = 0 THEN 'old' ELSE 'new' END AS source FROM orders WHERE o_orderkey % 3 = 0 OR o_orderkey % 2 = 0",
)
def _(spark, sf_dir):
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey"]).select(k.alias("item_id"), F.col("o_custkey").alias("person_id"))
    stored = rows.filter("item_id % 3 = 0").withColumn("source", F.lit("old"))
    new = rows.filter("item_id % 2 = 0").withColumn("source", F.lit("new"))
    return plans.guarded_insert(stored, new.unionByName(new.filter("item_id % 4 = 0")), ["item_id", "person_id"], stored.filter("item_id % 9 = 0"))


@query(
    "geometry_repairs",
    """WITH a AS (SELECT conv_id AS snapshot, turn, coalesce(text, '') AS text FROM conversations)
SELECT snapshot, CASE WHEN bool_or(snapshot % 5 = 0 AND turn = 1) THEN 'REFUSED' WHEN snapshot % 3 = 0 THEN 'ALREADY_APPLIED' ELSE 'READY_TO_APPLY' END AS state FROM a GROUP BY snapshot""",
)
def _(spark, sf_dir):
    from folioforge.catalog.text import lines

    stored = ordered.canonical_offsets(lines(spark, sf_dir)).withColumn("polygon", F.lit("0,0 1,1"))
    s, changed = F.col("snapshot"), (F.col("snapshot") % 5 == 0) & (F.col("position") == 1)
    parsed = stored.withColumn("text", F.when(changed, F.concat("text", F.lit("!"))).otherwise(F.col("text"))).withColumn("polygon", F.when(s % 3 == 0, F.col("polygon")).otherwise("0,0 2,2"))
    return plans.geometry_repair(stored, parsed)


@query(
    "operation_errors",
    """SELECT event_id, [NULL, 'object', 'id', 'op', 'document_id', 'unknown_field', 'missing_field', NULL][event_id % 8 + 1] AS error FROM events""",
)
def _(spark, sf_dir):
    made = (
        '{"id":"1","op":"create_person","local_person_ref":"p1","canonical_name":"Ann"}', "no json", '{"id":" ","op":"create_person"}', '{"id":"1","op":"drop"}', '{"id":"1","op":"link_photo","document_id":4,"photo_id":1,"person_ref":"p"}',
        '{"id":"1","op":"add_alias","person_ref":"p","alias":"A","x":1}', '{"id":"1","op":"add_alias","person_ref":"p","alias":""}', '{"id":"1","op":"link_photo","photo_id":7,"person_ref":"p1"}',
    )
    raw = F.element_at(F.array(*map(F.lit, made)), (F.col("event_id") % 8 + 1).cast("int"))
    return table(spark, sf_dir, "events", ["event_id"]).select("event_id", plans.operation_error(raw).alias("error"))


@query("engine_backfill", f"WITH {RESULTS_SQL} SELECT result_id, CASE WHEN engine = 'htr' THEN 'legacy' ELSE engine END AS engine, '1' AS version FROM results")
def _(spark, sf_dir):
    rows = text_results(spark, sf_dir).select("result_id", F.when(F.col("engine") != "htr", F.col("engine")).alias("engine"))
    return plans.with_engine(rows, engine="legacy", version="1")


@query("item_backfill", "SELECT o_orderkey AS item_id, o_orderpriority AS title, o_orderdate::VARCHAR AS created, (o_orderdate + INTERVAL 3 DAY)::VARCHAR AS updated FROM orders WHERE o_orderkey % 4 = 0")
def _(spark, sf_dir):
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders", ["o_orderkey", "o_orderpriority", "o_orderdate"]).select(
        k.alias("document_id"), F.when(k % 4 != 0, k).alias("item_id"), F.col("o_orderpriority").alias("title"), F.col("o_orderdate").alias("created_at"), (F.col("o_orderdate") + F.expr("INTERVAL 3 DAYS")).alias("updated_at")
    )
    shown = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return plans.items_for(rows, ["title"]).select("item_id", "title", shown("created_at").alias("created"), shown("updated_at").alias("updated"))


@query(
    "translation_revisions",
    f"""WITH {RESULTS_SQL}, r AS (SELECT result_id, doc_id AS document_id, engine, CASE WHEN result_id % 2 = 0 THEN 'SOURCE_TEXT' ELSE 'HEBREW_TEXT' END AS result_type, created_at AS revision, result_id // 6 AS d FROM results),
s AS (SELECT d, arg_max(revision, result_id) AS based_on FROM r WHERE result_type = 'SOURCE_TEXT' GROUP BY d) SELECT result_id, based_on FROM r LEFT JOIN s USING (d) WHERE result_type = 'HEBREW_TEXT'""",
)
def _(spark, sf_dir):
    k = F.col("result_id")
    rows = text_results(spark, sf_dir).select(k, F.floor(k / 6).alias("document_id"), F.lit("e").alias("engine"), F.when(k % 2 == 0, "SOURCE_TEXT").otherwise("HEBREW_TEXT").alias("result_type"), F.col("created_at").alias("revision"))
    return plans.translation_bases(rows)


# --- entity runs


@query(
    "entity_exclusions",
    f"WITH {ITEMS_SQL} SELECT count(*) FILTER (item_type = 'PHOTO')::BIGINT AS photos, count(*) FILTER (item_type = 'VIDEO')::BIGINT AS videos, count(*) FILTER (item_type IN ('DOCUMENT', 'TEXT') AND item_id % 8 = 0)::BIGINT AS without_text FROM items WHERE item_id > 20 AND item_id <= 5000",
)
def _(spark, sf_dir):
    rows = items(spark, sf_dir).select("item_id", "item_type", F.when(F.col("item_id") % 8 != 0, F.col("body")).alias("text"))
    return entities.excluded(rows, high=5000, after=20)


@query(
    "entity_run_report",
    """WITH e AS (SELECT doc_id AS item_id, CASE WHEN text IS NULL THEN 'missing_text' WHEN doc_id % 41 = 40 THEN 'stale_text' END AS failure FROM documents)
SELECT count(*)::BIGINT AS examined, count(failure)::BIGINT AS failures, max(item_id) FILTER (item_id < (SELECT min(item_id) FROM e WHERE failure IS NOT NULL)) AS cursor FROM e""",
)
def _(spark, sf_dir):
    k = F.col("doc_id")
    rows = table(spark, sf_dir, "documents", ["doc_id", "text"]).select(k.alias("item_id"), "text", F.when(k % 41 == 40, "old").otherwise(F.sha2("text", 256)).alias("sha"))
    return entities.run_report(entities.checked(rows))


_LEDGER = "found AS (SELECT DISTINCT l_partkey AS entity, l_suppkey AS item FROM lineitem WHERE l_returnflag = 'A'), stored AS (SELECT DISTINCT l_partkey AS entity, l_suppkey AS item FROM lineitem WHERE l_returnflag = 'R')"


@query("entity_ledger_counts", f"WITH {_LEDGER} SELECT (SELECT count(*) FROM (SELECT * FROM found EXCEPT SELECT * FROM stored))::BIGINT AS new, (SELECT count(*) FROM (SELECT * FROM found INTERSECT SELECT * FROM stored))::BIGINT AS existing")
def _(spark, sf_dir):
    return _ledger(spark, sf_dir)[1]


@query("entity_ledger_appends", f"WITH {_LEDGER} SELECT * FROM found EXCEPT SELECT * FROM stored")
def _(spark, sf_dir):
    return _ledger(spark, sf_dir)[0]


def _ledger(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem", ["l_partkey", "l_suppkey", "l_returnflag"])
    side = lambda flag: lines.filter(F.col("l_returnflag") == flag).select(F.col("l_partkey").alias("entity"), F.col("l_suppkey").alias("item"))
    return entities.ledger(side("A"), side("R"), ["entity", "item"])


@query("entities_not_retired", "SELECT p_partkey AS entity_id, p_name FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity = 50)")
def _(spark, sf_dir):
    retired = table(spark, sf_dir, "lineitem", ["l_partkey", "l_quantity"]).filter("l_quantity = 50").select(F.col("l_partkey").alias("entity_id"))
    return entities.without_retired(table(spark, sf_dir, "part", ["p_partkey", "p_name"]).withColumnRenamed("p_partkey", "entity_id"), retired)


@query(
    "entity_batch_appends",
    f"""{_HITS}, s AS (SELECT * FROM hits a WHERE item_id % 3 <> 0 AND NOT EXISTS (SELECT 1 FROM hits b WHERE b.item_id = a.item_id AND b.start <= a.start AND b."end" >= a."end" AND b."end" - b.start > a."end" - a.start))
SELECT item_id, surface, start FROM s WHERE NOT (item_id % 2 = 0 AND start % 2 = 0)""",
)
def _(spark, sf_dir):
    k = F.col("doc_id")
    rows = table(spark, sf_dir, "documents", ["doc_id", "text"]).select(k.alias("item_id"), F.coalesce("text", F.lit("")).alias("text"), F.when(k % 3 != 0, F.sha2(F.coalesce("text", F.lit("")), 256)).alias("sha"))
    names = surfaces(spark, sf_dir)
    stored = hits(spark, sf_dir).filter("item_id % 2 = 0 AND start % 2 = 0").select("item_id", "surface", "start")
    return entities.examine(rows, names, stored)[0].select("item_id", "surface", "start")


@query("document_pages", "SELECT l_orderkey AS document_id, l_partkey * 10 + l_linenumber AS file_id, (row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey * 10 + l_linenumber))::INTEGER AS page FROM lineitem")
def _(spark, sf_dir):
    c = F.col
    lines = table(spark, sf_dir, "lineitem", ["l_orderkey", "l_linenumber", "l_partkey"])
    return files.page_rows(lines.select(c("l_orderkey").alias("document_id"), (c("l_partkey") * 10 + c("l_linenumber")).alias("file_id"), c("l_linenumber").alias("position")))


@query("photo_object_keys", "SELECT DISTINCT p_brand AS key FROM part UNION SELECT p_type FROM part WHERE p_partkey % 3 = 0")
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "part", ["p_partkey", "p_brand", "p_type"]).select(F.concat(F.lit(" "), "p_brand").alias("original"), F.when(_k() % 3 == 0, F.col("p_type")).when(_k() % 3 == 1, " ").alias("thumbnail"))
    return files.keys_of(rows, "original", "thumbnail")


# --- topics


_TOPICS = f"""{_CLOSED}, {_DIRECT}, topics AS (SELECT DISTINCT parent AS topic, 'Topic ' || upper(parent) AS label, right(parent, 1) <> '3' AS is_public FROM edges),
labels AS (SELECT 'n' || n_nationkey AS topic, n_name AS alternate FROM nation UNION ALL SELECT 'r' || r_regionkey, r_name FROM region),
related AS (SELECT 'n' || n_nationkey AS low, 'n' || (n_nationkey + 2) AS high FROM nation WHERE n_nationkey BETWEEN 3 AND 6),
under AS (SELECT topic, item_id FROM direct UNION SELECT c.ancestor, d.item_id FROM direct d JOIN closed c ON c.descendant = d.topic), rolled AS (SELECT topic, count(*)::BIGINT AS items FROM under GROUP BY topic)"""


def _topics(spark, sf_dir):
    own = edges(spark, sf_dir)
    mark = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string")).alias("topic")
    topics = own.select(F.col("parent").alias("topic")).distinct().select("topic", F.concat(F.lit("Topic "), F.upper("topic")).alias("label"), (F.right("topic", F.lit(1)) != "3").alias("is_public"))
    nation = table(spark, sf_dir, "nation", ["n_nationkey", "n_name"])
    labels = nation.select(mark("n", "n_nationkey"), F.col("n_name").alias("alternate")).unionByName(table(spark, sf_dir, "region", ["r_regionkey", "r_name"]).select(mark("r", "r_regionkey"), F.col("r_name").alias("alternate")))
    pairs = nation.filter("n_nationkey BETWEEN 3 AND 6").select(F.concat(F.lit("n"), "n_nationkey").alias("low"), F.concat(F.lit("n"), F.col("n_nationkey") + 2).alias("high"))
    return own, topics, labels, pairs


@query(
    "topic_neighbourhoods",
    f"""{_TOPICS}, o AS (SELECT ancestor AS topic, descendant AS other FROM closed UNION SELECT descendant, ancestor FROM closed UNION SELECT low, high FROM related UNION SELECT high, low FROM related
  UNION SELECT a.child, b.child FROM edges a JOIN edges b USING (parent)) SELECT topic, other FROM o WHERE topic <> other AND topic LIKE 'n%' AND other NOT LIKE 'c%'""",
)
def _(spark, sf_dir):
    own, _, _, pairs = _topics(spark, sf_dir)
    upper = own.filter("child NOT LIKE 'c%'")
    return graph.neighbourhood(graph.closure(upper), upper, pairs).filter("topic LIKE 'n%' AND other NOT LIKE 'c%'")


@query("topic_list", f"{_TOPICS} SELECT topic, label, items FROM topics JOIN rolled USING (topic) WHERE is_public AND (contains(lower(label), 'n_1') OR topic IN (SELECT topic FROM labels WHERE contains(lower(alternate), 'n_1')))")
def _(spark, sf_dir):
    own, topics, labels, _ = _topics(spark, sf_dir)
    return graph.topic_list(graph.roll_up(graph.closure(own), direct(spark, sf_dir)), topics, labels, " N_1")


@query(
    "topic_details",
    f"""{_TOPICS}, e AS (SELECT * FROM edges WHERE child NOT LIKE 'c%')
SELECT topic, label, coalesce((SELECT string_agg(DISTINCT alternate, ', ' ORDER BY alternate) FROM labels l WHERE l.topic = t.topic), '') AS alternates,
  coalesce((SELECT string_agg(DISTINCT parent, ', ' ORDER BY parent) FROM e WHERE child = t.topic), '') AS parents, coalesce((SELECT string_agg(DISTINCT child, ', ' ORDER BY child) FROM e WHERE parent = t.topic), '') AS children,
  coalesce((SELECT string_agg(DISTINCT o, ', ' ORDER BY o) FROM (SELECT low AS x, high AS o FROM related UNION SELECT high, low FROM related) WHERE x = t.topic), '') AS related, coalesce(items, 0)::BIGINT AS items
FROM topics t LEFT JOIN rolled USING (topic)""",
)
def _(spark, sf_dir):
    own, topics, labels, pairs = _topics(spark, sf_dir)
    return graph.topic_detail(topics, labels, own.filter("child NOT LIKE 'c%'"), pairs, graph.roll_up(graph.closure(own), direct(spark, sf_dir)))


@query(
    "topic_item_provenance",
    f"""{_TOPICS}, a AS (SELECT topic, item_id, NULL::VARCHAR AS via FROM direct UNION SELECT c.ancestor, d.item_id, d.topic FROM direct d JOIN closed c ON c.descendant = d.topic)
SELECT topic, item_id, bool_or(via IS NULL) AS is_direct, coalesce(string_agg(via, ', ' ORDER BY via COLLATE "C"), '') AS through FROM a WHERE topic IN ('n3', 'r1') GROUP BY ALL""",
)
def _(spark, sf_dir):
    asked = spark.createDataFrame([("n3",), ("r1",)], "topic string")
    return graph.provenance(direct(spark, sf_dir), graph.closure(edges(spark, sf_dir)), asked)


# --- texts, dates, bands


@query("stripped_equality", """SELECT doc_id, trim(coalesce(text, ''), chr(32) || chr(9) || chr(10) || chr(13)) = trim(CASE WHEN doc_id % 3 = 0 THEN coalesce(text, '') || chr(10) || ' ' WHEN doc_id % 3 = 1 THEN 'x' || coalesce(text, '') ELSE text END, chr(32) || chr(9) || chr(10) || chr(13)) IS TRUE OR (text IS NULL AND doc_id % 3 <> 1) AS same FROM documents""")
def _(spark, sf_dir):
    k, body = F.col("doc_id"), F.coalesce("text", F.lit(""))
    other = F.when(k % 3 == 0, F.concat(body, F.lit("\n "))).when(k % 3 == 1, F.concat(F.lit("x"), body)).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents", ["doc_id", "text"]).select("doc_id", text.equivalent(F.col("text"), other).alias("same"))


@query("band_texts", """SELECT conv_id AS page, sha256(string_agg(trim(coalesce(text, ''), chr(32) || chr(9) || chr(10) || chr(13)), chr(10) ORDER BY turn)) AS sha FROM conversations GROUP BY 1""")
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations", ["conv_id", "turn", "text"])
    bands = F.transform(F.array_sort(F.collect_list(F.struct("turn", F.concat(F.lit(" "), F.coalesce("text", F.lit("")), F.lit("\n")).alias("text")))), lambda x: x["text"])
    return rows.groupBy(F.col("conv_id").alias("page")).agg(F.sha2(text.joined_bands(bands), 256).alias("sha"))


@query("sorted_counter", "SELECT l_suppkey::VARCHAR AS key, count(*)::BIGINT AS n FROM lineitem GROUP BY 1 ORDER BY 1")
def _(spark, sf_dir):
    return table(spark, sf_dir, "lineitem", ["l_suppkey"]).groupBy(F.col("l_suppkey").cast("string").alias("key")).agg(F.count(F.lit(1)).alias("n")).orderBy("key")


@query(
    "suggested_values",
    """WITH p AS (SELECT doc_id, list_transform(regexp_split_to_array(coalesce(text, ''), '[,\\n]'), lambda x: trim(x, ' ')) AS x FROM documents), u AS (SELECT doc_id, unnest(x) AS name, unnest(range(len(x))) AS k FROM p),
f AS (SELECT doc_id, name, min(k) AS k FROM u WHERE name <> '' GROUP BY ALL) SELECT doc_id, count(*)::BIGINT AS n, sha256(string_agg(name, '|' ORDER BY k)) AS names FROM f GROUP BY doc_id""",
)
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "documents", ["doc_id", "text"]).select("doc_id", text.suggested_values(F.coalesce("text", F.lit(""))).alias("names"))
    return rows.filter(F.size("names") > 0).select("doc_id", F.size("names").cast("long").alias("n"), F.sha2(F.array_join("names", "|"), 256).alias("names"))


@query(
    "limited_names",
    """WITH n AS (SELECT p_partkey, p_name || ', ' || p_type || ',,' || p_name AS raw, length(p_name) > 12 OR length(p_type) > 12 AS error FROM part) SELECT p_partkey, CASE WHEN p_name = p_type THEN p_name ELSE p_name || '|' || p_type END AS names, error FROM n JOIN part USING (p_partkey)""",
)
def _(spark, sf_dir):
    raw = F.concat("p_name", F.lit(", "), "p_type", F.lit(",,"), "p_name")
    rows = table(spark, sf_dir, "part", ["p_partkey", "p_name", "p_type"]).select("p_partkey", text.limited_names(raw, 12).alias("x"))
    return rows.select("p_partkey", F.array_join("x.names", "|").alias("names"), F.col("x.error").alias("error"))


@query(
    "iso_date_parts",
    """WITH r AS (SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN '1999-02-30' WHEN 2 THEN ' ' || strftime(o_orderdate, '%Y-%m-%d') || ' ' ELSE 'soon' END AS raw, o_orderdate FROM orders)
SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN year(o_orderdate)::INT END AS year, CASE WHEN o_orderkey % 2 = 0 THEN month(o_orderdate)::INT END AS month, CASE WHEN o_orderkey % 2 = 0 THEN day(o_orderdate)::INT END AS day FROM r""",
)
def _(spark, sf_dir):
    k, iso = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    raw = F.when(k % 4 == 0, iso).when(k % 4 == 1, "1999-02-30").when(k % 4 == 2, F.concat(F.lit(" "), iso, F.lit(" "))).otherwise("soon")
    return table(spark, sf_dir, "orders", ["o_orderkey", "o_orderdate"]).select("o_orderkey", dates.parts(raw).alias("x")).select("o_orderkey", "x.year", "x.month", "x.day")


@query(
    "stored_date_errors",
    """SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 THEN 'date_precision' WHEN o_orderkey % 3 = 0 THEN 'date_end' END AS error FROM orders""",
)
def _(spark, sf_dir):
    k, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    precision = F.element_at(F.array(*map(F.lit, ("DAY", "MONTH", "YEAR", "UNKNOWN", "DECADE"))), (k % 5 + 1).cast("int"))
    end = F.when(k % 3 == 0, F.date_sub(day, 1)).when(k % 3 == 1, day)
    return table(spark, sf_dir, "orders", ["o_orderkey", "o_orderdate"]).select("o_orderkey", dates.stored_error(precision, day, end).alias("error"))


@query(
    "search_documents",
    """WITH i AS (SELECT o_orderkey AS item_id, ' ' || o_orderpriority || '  x' AS title, 'Legacy ' || o_custkey % 7 AS author, CASE WHEN o_orderkey % 3 = 0 THEN 'Source' END AS source, CASE WHEN o_orderkey % 4 = 0 THEN ' a  note ' ELSE '' END AS note FROM orders),
l AS (SELECT l_orderkey AS item_id, l_linenumber, l_suppkey, l_partkey, l_returnflag, l_linestatus, l_quantity FROM lineitem),
p AS (SELECT item_id, 0 AS part, (l_linenumber, 'Author ' || l_suppkey % 5) AS o, 0 AS k, 'Author ' || l_suppkey % 5 AS x FROM l WHERE l_quantity > 25 UNION ALL SELECT item_id, 0, (0, ''), 0, author FROM i WHERE item_id NOT IN (SELECT item_id FROM l WHERE l_quantity > 25)
  UNION ALL SELECT item_id, 1, (0, ''), 0, source FROM i UNION ALL SELECT item_id, 2, (0, l_returnflag), 0, l_returnflag FROM l UNION ALL SELECT item_id, 3, (0, l_linestatus), 0, l_linestatus FROM l UNION ALL SELECT item_id, 4, (0, ''), 0, note FROM i
  UNION ALL SELECT item_id, 5, (l_partkey, 'Person ' || (l_partkey + 1000000)), k, CASE k WHEN 0 THEN 'Person ' || (l_partkey + 1000000) ELSE 'Alias ' || l_partkey % 3 END FROM l, (SELECT unnest([0, 1]) AS k) WHERE l_quantity < 10),
c AS (SELECT item_id, part, o, k, trim(regexp_replace(x, '\\s+', ' ', 'g')) AS x FROM p WHERE x IS NOT NULL), f AS (SELECT item_id, x, min((part, o, k)) AS o FROM c WHERE x <> '' GROUP BY ALL), m AS (SELECT item_id, string_agg(x, chr(10) ORDER BY o) AS metadata FROM f GROUP BY 1)
SELECT item_id, trim(regexp_replace(title, '\\s+', ' ', 'g')) AS title, coalesce(metadata, '') AS metadata FROM i LEFT JOIN m USING (item_id)""",
)
def _(spark, sf_dir):
    c, k = F.col, F.col("o_orderkey")
    own = table(spark, sf_dir, "orders", ["o_orderkey", "o_custkey", "o_orderpriority"]).select(
        k.alias("item_id"), F.concat(F.lit(" "), "o_orderpriority", F.lit("  x")).alias("title"), F.concat(F.lit("Legacy "), c("o_custkey") % 7).alias("author"), F.when(k % 3 == 0, "Source").alias("source"), F.when(k % 4 == 0, " a  note ").otherwise("").alias("note")
    )
    lines = table(spark, sf_dir, "lineitem", ["l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_returnflag", "l_linestatus", "l_quantity"]).withColumnRenamed("l_orderkey", "item_id")
    authors = lines.filter("l_quantity > 25").select("item_id", c("l_linenumber").alias("position"), F.concat(F.lit("Author "), c("l_suppkey") % 5).alias("name"))
    kinds = {"categories": lines.select("item_id", c("l_returnflag").alias("name")).distinct(), "tags": lines.select("item_id", c("l_linestatus").alias("name")).distinct()}
    shown = lines.filter("l_quantity < 10").select("item_id", c("l_partkey").alias("person_id"), F.concat(F.lit("Person "), c("l_partkey") + 1_000_000).alias("name"), F.array(F.concat(F.lit("Alias "), c("l_partkey") % 3)).alias("others"))
    return search.documents(own, authors=authors, labels=kinds, persons=shown)


@query(
    "review_groups",
    """WITH c AS (SELECT l_orderkey * 10 + l_linenumber AS candidate_id, l_suppkey AS entity_id, lower(l_returnflag) || l_suppkey AS surface, l_linestatus AS text_kind, min(l_orderkey % 50) AS item_id FROM lineitem GROUP BY ALL),
r AS (SELECT l_orderkey * 10 + l_linenumber AS candidate_id, CASE WHEN l_quantity > 25 THEN 'exact' ELSE 'alias' END || '/' || CASE WHEN l_discount > 0.05 THEN 'SHORT' ELSE '' END AS x FROM lineitem WHERE l_tax > 0.02),
s AS (SELECT candidate_id, string_agg(DISTINCT x, ',' ORDER BY x) AS reasons FROM r GROUP BY 1), g AS (SELECT entity_id, surface, text_kind, coalesce(reasons, '') AS reasons, count(*)::BIGINT AS members, count(DISTINCT item_id)::BIGINT AS items FROM c LEFT JOIN s USING (candidate_id) GROUP BY ALL)
SELECT sha256('{"entity_id":' || entity_id || ',"surface":"' || surface || '","text_kind":"' || text_kind || '","reasons":"' || reasons || '"}') AS group_id, *, length(surface) <= 3 AS short_surface, items >= 5 AS many_items, contains(reasons, ',') AS several_reasons FROM g""",
)
def _(spark, sf_dir):
    c = F.col
    lines = table(spark, sf_dir, "lineitem", ["l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag", "l_linestatus", "l_quantity", "l_discount", "l_tax"])
    key = (c("l_orderkey") * 10 + c("l_linenumber")).alias("candidate_id")
    rows = lines.select(key, c("l_suppkey").alias("entity_id"), F.concat(F.lower("l_returnflag"), c("l_suppkey").cast("string")).alias("surface"), c("l_linestatus").alias("text_kind"), (c("l_orderkey") % 50).alias("item_id"))
    candidates = rows.groupBy("candidate_id", "entity_id", "surface", "text_kind").agg(F.min("item_id").alias("item_id"))
    why = lines.filter("l_tax > 0.02").select(key, F.when(c("l_quantity") > 25, "exact").otherwise("alias").alias("method"), F.when(c("l_discount") > 0.05, "SHORT").alias("alias_kind"))
    return entities.review_groups(candidates, why)


@query(
    "page_geometry_counters",
    """WITH l AS (SELECT l_orderkey % 40 AS page, l_suppkey AS region_id, CASE WHEN l_partkey % 7 <> 0 THEN l_partkey % 20 END AS line_id, CASE WHEN l_partkey % 5 = 0 THEN ' ' ELSE 'x' END AS text, l_partkey % 9 AS k, l_quantity::INT AS q, CASE WHEN l_partkey % 2 = 0 THEN '0,1 2,3' END AS baseline, l_orderkey % 40 % 3 <> 2 AS sized FROM lineitem),
g AS (SELECT *, k NOT IN (0, 1, 2) AS given_and_read, k IN (3, 4) AS flat, k > 2 AND sized AND (k = 4 OR 10 + q > 50) AS beyond FROM l)
SELECT page, count(DISTINCT region_id)::BIGINT AS regions, count(*)::BIGINT AS lines, count(*) FILTER (text = 'x')::BIGINT AS with_text, count(*) FILTER (k NOT IN (0, 1))::BIGINT AS with_coords, count(*) FILTER (k > 2 AND NOT flat AND NOT beyond)::BIGINT AS valid,
  count(*) FILTER (text = 'x' AND k > 2 AND NOT flat AND NOT beyond)::BIGINT AS with_text_and_valid, count(baseline)::BIGINT AS with_baseline, count(*) FILTER (text = 'x' AND baseline IS NOT NULL)::BIGINT AS with_text_and_baseline, count(line_id)::BIGINT AS with_id,
  (count(line_id) - count(DISTINCT line_id))::BIGINT AS duplicate_ids, count(*) FILTER (k = 2)::BIGINT AS malformed, count(*) FILTER (flat)::BIGINT AS degenerate, count(*) FILTER (beyond)::BIGINT AS out_of_bounds FROM g GROUP BY page""",
)
def _(spark, sf_dir):
    c, k, q = F.col, F.col("l_partkey") % 9, F.col("l_quantity").cast("int")
    wide = F.concat(F.lit("10,10 "), (q + 10).cast("string"), F.lit(",10 10,20"))
    points = F.when(k == 1, "  ").when(k == 2, "1,2 x,3 4,5").when(k == 3, F.concat(F.lit("10,10 "), (q + 10).cast("string"), F.lit(",10"))).when(k == 4, F.concat(F.lit("10,-5 "), (q + 10).cast("string"), F.lit(",-5 30,-5"))).when(k > 4, wide)
    lines = table(spark, sf_dir, "lineitem", ["l_orderkey", "l_suppkey", "l_partkey", "l_quantity"])
    sized = c("l_orderkey") % 40 % 3 != 2
    return ordered.geometry_counters(lines.select(
        (c("l_orderkey") % 40).alias("page"), c("l_suppkey").alias("region_id"), F.when(c("l_partkey") % 7 != 0, c("l_partkey") % 20).alias("line_id"), F.when(c("l_partkey") % 5 == 0, " ").otherwise("x").alias("text"), points.alias("points"),
        F.when(c("l_partkey") % 2 == 0, "0,1 2,3").alias("baseline"), F.when(sized, 50).alias("width"), F.when(sized, 1000).alias("height"),
    ))


_BANDS = "rects AS (SELECT k::INT AS band, k * 300.0 - CASE WHEN k = 3 THEN 40 ELSE 0 END AS top, (k + 1) * 300.0 AS bottom FROM range(0, 4) t(k))"


@query(
    "words_in_bands",
    f"""WITH w AS (SELECT l_orderkey // 8 AS page, round(l_extendedprice / 100) AS ymin, round(l_extendedprice / 100) + l_quantity % 7 AS ymax FROM lineitem), {_BANDS},
m AS (SELECT w.page, w.ymin, w.ymax, count(*) FILTER (ymin >= top AND ymax < bottom) AS n, max(band) FILTER (ymin >= top AND ymax < bottom) AS band, bool_or(ymin < bottom AND ymax >= top AND NOT (ymin >= top AND ymax < bottom)) AS crossed
  FROM (SELECT *, row_number() OVER () AS r FROM w) w, rects GROUP BY r, w.page, w.ymin, w.ymax)
SELECT page, ymin, ymax, CASE WHEN n = 1 AND NOT crossed THEN band END AS band, CASE WHEN crossed THEN 'crosses_cut' WHEN n <> 1 THEN 'not_one_band' END AS error FROM m""",
)
def _(spark, sf_dir):
    own = words(spark, sf_dir)
    band = F.explode(F.sequence(F.lit(0), F.lit(3))).alias("band")
    rects = own.select("page").distinct().select("page", band)
    b = F.col("band")
    rects = rects.select("page", "band", (b * 300.0 - F.when(b == 3, 40).otherwise(0)).alias("top"), ((b + 1) * 300.0).alias("bottom"))
    placed = ordered.words_in_bands(own, rects)
    return placed.join(own.withColumnRenamed("page", "p"), ["word"]).select("page", "ymin", "ymax", "band", "error")
