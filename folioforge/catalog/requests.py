"""Requests, runs, results and the document list of staff."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioforge.operators import access, filters, requests, selection
from folioforge.registry import query
from folioforge.sources.archive import ITEMS_SQL, RESULTS_SQL, items, text_results
from folioforge.sources.tables import table

def _k():
    return F.col("event_id")


def _events(spark, sf_dir, *columns):
    return table(spark, sf_dir, "events", ["event_id", *columns])


@query("type_tab_items", f"WITH {ITEMS_SQL} SELECT item_id FROM items WHERE item_type IN ('DOCUMENT', 'TEXT')")
def _(spark, sf_dir):
    return requests.of_tab(items(spark, sf_dir), "documents_and_texts").select("item_id")


@query(
    "type_slugs",
    """WITH r AS (SELECT event_id, [' Photo ', 'video', 'Documents_and_Texts', 'junk', NULL, ''][event_id % 6 + 1] AS raw FROM events)
SELECT event_id, CASE WHEN lower(trim(raw)) IN ('photo', 'video', 'documents_and_texts') THEN lower(trim(raw)) ELSE '' END AS slug FROM r""",
)
def _(spark, sf_dir):
    raw = F.element_at(F.array(*map(F.lit, (" Photo ", "video", "Documents_and_Texts", "junk", None, ""))), (_k() % 6 + 1).cast("int"))
    return _events(spark, sf_dir).select("event_id", requests.type_tab(raw).alias("slug"))


@query(
    "filter_parameters",
    """WITH r AS (SELECT event_id, string_split(user_id || ', x,-3,0,' || event_id % 7 || ',' || user_id, ',') AS raw, CASE event_id % 5 WHEN 0 THEN 'abc' WHEN 1 THEN NULL WHEN 2 THEN '0' ELSE (1900 + event_id % 50)::VARCHAR END AS y,
  CASE event_id % 3 WHEN 0 THEN 'x' WHEN 1 THEN '1910' ELSE '2000' END AS z FROM events),
n AS (SELECT event_id, unnest(raw) AS x, unnest(range(len(raw))) AS k, y, z FROM r),
i AS (SELECT event_id, x::BIGINT AS id, min(k) AS k FROM (SELECT event_id, trim(x) AS x, k FROM n WHERE regexp_matches(trim(x), '^[0-9]+$')) WHERE x::BIGINT > 0 GROUP BY ALL),
g AS (SELECT event_id, string_agg(id::VARCHAR, ',' ORDER BY k) AS ids FROM i GROUP BY event_id),
h AS (SELECT event_id, CASE WHEN regexp_matches(y, '^[0-9]{1,4}$') AND y::INT > 0 THEN y::INT END AS low, CASE WHEN regexp_matches(z, '^[0-9]{1,4}$') THEN z::INT END AS up FROM r)
SELECT h.event_id, coalesce(ids, '') AS ids, low, CASE WHEN low IS NOT NULL THEN greatest(low, coalesce(up, low)) END AS high FROM h LEFT JOIN g USING (event_id)""",
)
def _(spark, sf_dir):
    raw = F.concat("user_id", F.lit(", x,-3,0,"), _k() % 7, F.lit(","), "user_id")
    year = F.when(_k() % 5 == 0, "abc").when(_k() % 5 == 1, None).when(_k() % 5 == 2, "0").otherwise((1900 + _k() % 50).cast("string"))
    up = F.when(_k() % 3 == 0, "x").when(_k() % 3 == 1, "1910").otherwise("2000")
    rows = _events(spark, sf_dir, "user_id").select("event_id", F.array_join(requests.positive_ids(raw), ",").alias("ids"), requests.year_range(F.array(F.lit("1"), year), F.array(up)).alias("y"))
    return rows.select("event_id", "ids", F.col("y.low").alias("low"), F.col("y.high").alias("high"))


@query("agent_documents", f"WITH {ITEMS_SQL} SELECT item_id FROM items WHERE item_type = 'DOCUMENT' AND language IN ('en', 'fr') AND visibility IN ('PUBLIC', 'PRIVATE') AND upload_status = 'UPLOADED'")
def _(spark, sf_dir):
    return access.uploaded_for(items(spark, sf_dir), "family").filter("item_type = 'DOCUMENT' AND language IN ('en', 'fr')").select("item_id")


def _requests(spark, sf_dir):
    status = F.element_at(F.array(*map(F.lit, ("QUEUED", "RUNNING", "ENQUEUE_FAILED", "RECOVERY_REQUIRED", "COMPLETED", "FAILED"))), (_k() % 6 + 1).cast("int"))
    return _events(spark, sf_dir, "user_id", "value").select(
        _k().alias("request_id"), F.col("user_id").alias("document_id"), status.alias("status"), F.when(_k() % 4 != 0, F.col("value")).alias("lease"), F.when(_k() % 5 != 0, F.col("value")).alias("enqueued_at"), F.col("value").alias("updated_at"),
        F.when(_k() % 12 == 5, requests.ABANDONED).alias("failure"), F.when(_k() % 3 == 0, "TRANSLATION").otherwise("OCR").alias("operation"),
    )


_REQUESTS = """r AS (SELECT event_id AS request_id, user_id AS document_id, ['QUEUED', 'RUNNING', 'ENQUEUE_FAILED', 'RECOVERY_REQUIRED', 'COMPLETED', 'FAILED'][event_id % 6 + 1] AS status,
  CASE WHEN event_id % 4 <> 0 THEN value END AS lease, CASE WHEN event_id % 5 <> 0 THEN value END AS enqueued_at, value AS updated_at, CASE WHEN event_id % 12 = 5 THEN 'STAFF_ABANDONED' END AS failure,
  CASE WHEN event_id % 3 = 0 THEN 'TRANSLATION' ELSE 'OCR' END AS operation FROM events)"""


@query(
    "fence_scope",
    f"""WITH {_REQUESTS}, e AS (SELECT * FROM r WHERE status = 'RUNNING' AND (lease IS NULL OR lease <= 50))
SELECT request_id, place::BIGINT AS place FROM (VALUES (61, 1), (1, 2), (7, 3), (13, 5), (301, 6), (403, 7)) t(request_id, place) JOIN e USING (request_id) ORDER BY place LIMIT 4""",
)
def _(spark, sf_dir):
    return requests.scope(filters.expired(_requests(spark, sf_dir), F.lit(50.0)), ids=[61, 1, 7, 999_999_999, 13, 301, 403, 7], limit=4).select("request_id", "place")


@query(
    "fence_scope_of_documents",
    f"""WITH {_REQUESTS} SELECT request_id FROM r WHERE status = 'RUNNING' AND (lease IS NULL OR lease <= 50) AND document_id IN (3, 5, 8, 13)""",
)
def _(spark, sf_dir):
    return requests.scope(filters.expired(_requests(spark, sf_dir), F.lit(50.0)), documents=[3, 5, 8, 13]).select("request_id")


@query("recovery_candidates", f"WITH {_REQUESTS} SELECT request_id, status FROM r WHERE ((status = 'QUEUED' AND enqueued_at IS NULL) OR status = 'ENQUEUE_FAILED') AND updated_at <= 60 - 15")
def _(spark, sf_dir):
    return requests.recoverable(_requests(spark, sf_dir), F.lit(60.0), F.lit(15.0)).select("request_id", "status")


@query("request_coalescing_outcomes", f"WITH {_REQUESTS} SELECT request_id, CASE status WHEN 'RUNNING' THEN 'ALREADY_RUNNING' WHEN 'RECOVERY_REQUIRED' THEN 'BLOCKED_RECOVERY_REQUIRED' ELSE 'ALREADY_QUEUED' END AS outcome FROM r")
def _(spark, sf_dir):
    return _requests(spark, sf_dir).select("request_id", requests.coalesce_outcome(F.col("status")).alias("outcome"))


@query(
    "staff_abandonment",
    f"""WITH {_REQUESTS}, a AS (SELECT event_id AS request_id, user_id + (event_id % 14 = 0)::INT AS asked FROM events WHERE event_id % 7 = 0 UNION ALL SELECT -1, 0),
j AS (SELECT a.request_id, status, failure, CASE WHEN status IS NULL THEN 'REQUEST_NOT_FOUND' WHEN document_id <> asked THEN 'DOCUMENT_MISMATCH' WHEN status IN ('COMPLETED', 'PARTIAL', 'FAILED') THEN 'ALREADY_TERMINAL'
  WHEN status = 'RECOVERY_REQUIRED' THEN 'ABANDONED' ELSE 'NOT_ABANDONABLE' END AS outcome FROM a LEFT JOIN r USING (request_id))
SELECT request_id, outcome, CASE WHEN outcome = 'ABANDONED' THEN 'FAILED' ELSE status END AS status, CASE WHEN outcome = 'ABANDONED' THEN 'STAFF_ABANDONED' ELSE failure END AS failure FROM j""",
)
def _(spark, sf_dir):
    asked = _events(spark, sf_dir, "user_id").filter(_k() % 7 == 0).select(_k().alias("request_id"), (F.col("user_id") + (_k() % 14 == 0).cast("int")).alias("document_id"))
    return requests.abandoned(_requests(spark, sf_dir), asked.unionByName(spark.range(1).select(F.lit(-1).cast("long").alias("request_id"), F.lit(0).cast("long").alias("document_id"))))


@query(
    "staff_retries",
    f"""WITH {_REQUESTS}, l AS (SELECT DISTINCT document_id FROM r WHERE status = 'RUNNING' AND lease > 180)
SELECT request_id, CASE WHEN operation = 'OCR' AND (status = 'RECOVERY_REQUIRED' OR (status = 'FAILED' AND coalesce(failure = 'STAFF_ABANDONED', false))) AND l.document_id IS NOT NULL THEN 'PAGE_LEASE_LIVE'
  WHEN status = 'RECOVERY_REQUIRED' THEN 'ABANDON_AND_ENQUEUE' WHEN status = 'FAILED' AND coalesce(failure = 'STAFF_ABANDONED', false) THEN 'ENQUEUE'
  WHEN status IN ('COMPLETED', 'PARTIAL', 'FAILED') THEN 'REQUEST_ALREADY_FINISHED' ELSE 'REQUEST_ACTIVE' END AS outcome FROM r LEFT JOIN l ON r.document_id = l.document_id""",
)
def _(spark, sf_dir):
    rows = _requests(spark, sf_dir)
    return requests.retried(rows, rows.select("document_id", "status", "lease"), F.lit(180.0))


@query(
    "page_claims",
    """WITH a AS (SELECT conv_id AS attempt, max(turn) AS pages FROM conversations GROUP BY 1), c AS (SELECT conv_id AS attempt, turn AS page, conv_id % 7 AS fingerprint FROM conversations),
k AS (SELECT conv_id AS attempt, turn AS page, (conv_id + (turn = 2)::INT) % 7 AS fingerprint, ['SUCCEEDED', 'RUNNING', 'FAILED'][(conv_id + turn) % 3 + 1] AS status, (conv_id * 5) % 100 AS lease FROM conversations WHERE turn % 4 <> 3)
SELECT c.attempt, c.page, CASE WHEN c.page < 1 OR c.page > pages THEN 'OUT_OF_RANGE' WHEN k.fingerprint <> c.fingerprint THEN 'FINGERPRINT_MISMATCH' WHEN status = 'SUCCEEDED' THEN 'REUSE' WHEN status = 'RUNNING' AND lease > 40 THEN 'BUSY' ELSE 'RUN' END AS action
FROM c JOIN a USING (attempt) LEFT JOIN k ON k.attempt = c.attempt AND k.page = c.page""",
)
def _(spark, sf_dir):
    c, t = F.col("conv_id"), F.col("turn")
    rows = table(spark, sf_dir, "conversations", ["conv_id", "turn"])
    claims = rows.select(c.alias("attempt"), t.alias("page"), (c % 7).alias("fingerprint"))
    status = F.element_at(F.array(*map(F.lit, ("SUCCEEDED", "RUNNING", "FAILED"))), ((c + t) % 3 + 1).cast("int"))
    held = rows.filter(t % 4 != 3).select(c.alias("attempt"), t.alias("page"), ((c + (t == 2).cast("int")) % 7).alias("fingerprint"), status.alias("status"), ((c * 5) % 100).alias("lease"))
    return requests.page_claims(claims, held, claims.groupBy("attempt").agg(F.max("page").alias("pages")), F.lit(40))


@query(
    "whole_transcripts",
    """WITH p AS (SELECT l_orderkey AS document, l_linenumber % 4 AS page, CASE WHEN l_returnflag <> 'N' OR l_orderkey % 2 = 0 THEN l_partkey END AS transcript FROM lineitem),
g AS (SELECT document, page, count(transcript) AS n, min(transcript) AS transcript FROM p GROUP BY ALL) SELECT document, page, transcript FROM g QUALIFY bool_and(n = 1) OVER (PARTITION BY document)""",
)
def _(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem", ["l_orderkey", "l_linenumber", "l_returnflag", "l_partkey"])
    transcript = F.when((F.col("l_returnflag") != "N") | (F.col("l_orderkey") % 2 == 0), F.col("l_partkey"))
    return requests.whole_transcripts(lines.select(F.col("l_orderkey").alias("document"), (F.col("l_linenumber") % 4).alias("page"), transcript.alias("transcript")))


@query(
    "queue_dispatch",
    """SELECT event_id, CASE WHEN event_id % 5 = 0 AND event_id > 0 THEN 'PROCESS_DOCUMENT' WHEN event_id % 5 = 1 AND user_id > 0 THEN 'SYNC_CORRECTED' ELSE 'dead_letter' END AS route FROM events""",
)
def _(spark, sf_dir):
    made = lambda kind, x: F.to_json(F.struct(F.lit(kind).alias("type"), x.cast("long").alias("request_id")))
    body = F.when(_k() % 5 == 0, made("PROCESS_DOCUMENT", _k())).when(_k() % 5 == 1, made("SYNC_CORRECTED", F.col("user_id"))).when(_k() % 5 == 2, made("OTHER", F.lit(4))).when(_k() % 5 == 3, "no json").otherwise(made("PROCESS_DOCUMENT", F.lit(-1)))
    return requests.dispatched(_events(spark, sf_dir, "user_id").select("event_id", body.alias("body"))).select("event_id", "route")


@query("queue_messages", f"""WITH {_REQUESTS} SELECT '{{"type":"PROCESS_DOCUMENT","request_id":' || request_id || '}}' AS body FROM r WHERE status = 'QUEUED'""")
def _(spark, sf_dir):
    return requests.messages(_requests(spark, sf_dir).filter("status = 'QUEUED'"))


_DOCUMENTS = """d AS (SELECT o_orderkey AS document_id, CASE WHEN o_orderkey % 3 = 0 THEN 'PDF' ELSE 'IMAGE' END AS kind, CASE WHEN o_orderkey % 5 = 0 THEN 4 END AS expected_files, CASE WHEN o_orderkey % 4 = 0 THEN 'k' ELSE '' END AS file_key,
  CASE WHEN o_orderkey % 7 = 0 THEN 'PHOTO' ELSE 'DOCUMENT' END AS item_type, CASE WHEN o_orderstatus = 'F' THEN 'PENDING' ELSE 'UPLOADED' END AS upload_status, o_orderdate AS updated_at, o_orderdate AS created_at,
  CASE o_orderkey % 3 WHEN 0 THEN NULL WHEN 1 THEN '  ' ELSE 't' END AS thumbnail_key, (o_orderkey % 3)::INT AS pages, o_orderkey % 11 = 0 AS busy, o_orderpriority AS title, CASE WHEN o_orderkey % 6 = 0 THEN 'Letters' END AS category,
  'file' || o_orderkey % 50 AS file_name, CASE WHEN o_orderkey % 9 = 0 THEN 'From URGENT box' END AS notes, CASE WHEN o_orderkey % 2 = 0 THEN 'PRIVATE' ELSE 'PUBLIC' END AS visibility FROM orders),
f AS (SELECT l_orderkey * 10 + l_linenumber AS file_id, l_orderkey AS document_id, (l_linenumber - 1)::INT AS position, l_linenumber < 4 AS in_ocr, CASE WHEN l_returnflag = 'R' THEN 'FAILED' ELSE 'UPLOADED' END AS status, l_shipdate AS updated_at,
  CASE WHEN l_partkey % 4 = 0 THEN '' ELSE 's' || l_partkey END AS key FROM lineitem)"""


def _documents(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders", ["o_orderkey", "o_orderstatus", "o_orderdate", "o_orderpriority"]).select(
        k.alias("document_id"), F.when(k % 3 == 0, "PDF").otherwise("IMAGE").alias("kind"), F.when(k % 5 == 0, 4).alias("expected_files"), F.when(k % 4 == 0, "k").otherwise("").alias("file_key"),
        F.when(k % 7 == 0, "PHOTO").otherwise("DOCUMENT").alias("item_type"), F.when(F.col("o_orderstatus") == "F", "PENDING").otherwise("UPLOADED").alias("upload_status"), F.col("o_orderdate").alias("updated_at"), F.col("o_orderdate").alias("created_at"),
        F.when(k % 3 == 1, "  ").when(k % 3 == 2, "t").alias("thumbnail_key"), (k % 3).cast("int").alias("pages"), (k % 11 == 0).alias("busy"), F.col("o_orderpriority").alias("title"), F.when(k % 6 == 0, "Letters").alias("category"),
        F.concat(F.lit("file"), k % 50).alias("file_name"), F.when(k % 9 == 0, "From URGENT box").alias("notes"), F.when(k % 2 == 0, "PRIVATE").otherwise("PUBLIC").alias("visibility"),
    )


def _files(spark, sf_dir):
    c = F.col
    return table(spark, sf_dir, "lineitem", ["l_orderkey", "l_linenumber", "l_returnflag", "l_shipdate", "l_partkey"]).select(
        (c("l_orderkey") * 10 + c("l_linenumber")).alias("file_id"), c("l_orderkey").alias("document_id"), (c("l_linenumber") - 1).alias("position"), (c("l_linenumber") < 4).alias("in_ocr"),
        F.when(c("l_returnflag") == "R", "FAILED").otherwise("UPLOADED").alias("status"), c("l_shipdate").alias("updated_at"), F.when(c("l_partkey") % 4 == 0, "").otherwise(F.concat(F.lit("s"), "l_partkey")).alias("key"),
    )


def _before():
    return F.lit("1996-06-01").cast("timestamp")


@query("stale_drafts", f"WITH {_DOCUMENTS} SELECT document_id FROM d WHERE kind = 'IMAGE' AND expected_files IS NULL AND file_key = '' AND item_type = 'DOCUMENT' AND upload_status <> 'UPLOADED' AND updated_at < TIMESTAMP '1996-06-01'")
def _(spark, sf_dir):
    return requests.stale_drafts(_documents(spark, sf_dir), _before()).select("document_id")


@query(
    "stale_display_extras",
    f"WITH {_DOCUMENTS} SELECT file_id, f.position FROM f JOIN d USING (document_id) WHERE NOT in_ocr AND f.status IN ('PENDING', 'FAILED') AND f.updated_at < TIMESTAMP '1996-06-01' AND d.upload_status = 'UPLOADED' AND NOT busy AND f.position >= d.pages",
)
def _(spark, sf_dir):
    return requests.stale_extras(_files(spark, sf_dir), _documents(spark, sf_dir), _before()).select("file_id", "position")


@query(
    "documents_without_thumbnail",
    f"""WITH {_DOCUMENTS}, s AS (SELECT document_id, min(key) AS source_key FROM f WHERE position = 0 AND key <> '' GROUP BY 1)
SELECT document_id, source_key FROM d JOIN s USING (document_id) WHERE kind = 'IMAGE' AND upload_status = 'UPLOADED' AND trim(coalesce(thumbnail_key, '')) = ''""",
)
def _(spark, sf_dir):
    return requests.without_thumbnail(_documents(spark, sf_dir), _files(spark, sf_dir))


@query(
    "staff_document_list",
    f"""WITH {_DOCUMENTS}, t AS (SELECT l_orderkey AS document_id, l_shipdate, 'Tag ' || l_returnflag || CASE WHEN l_quantity > 45 THEN ' urgent' ELSE '' END AS name FROM lineitem)
SELECT document_id, created_at::VARCHAR AS created FROM d WHERE visibility = 'PRIVATE' AND (contains(lower(title), 'urgent') OR contains(lower(coalesce(category, '')), 'urgent') OR contains(lower(coalesce(notes, '')), 'urgent') OR document_id IN (SELECT document_id FROM t WHERE contains(lower(name), 'urgent')))""",
)
def _(spark, sf_dir):
    name = F.concat(F.lit("Tag "), "l_returnflag", F.when(F.col("l_quantity") > 45, " urgent").otherwise(""))
    tags = table(spark, sf_dir, "lineitem", ["l_orderkey", "l_returnflag", "l_quantity"]).select(F.col("l_orderkey").alias("document_id"), name.alias("name"))
    rows = requests.staff_documents(_documents(spark, sf_dir), tags, admin=True, text=" Urgent ", visibility="PRIVATE")
    return rows.select("document_id", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created"))


@query(
    "document_list_page_json",
    f"""WITH {_DOCUMENTS} SELECT '{{"document_id":' || document_id || ',"title":"' || title || '"}}' AS body FROM d WHERE kind = 'PDF' ORDER BY created_at DESC, document_id DESC LIMIT 50""",
)
def _(spark, sf_dir):
    rows = requests.staff_documents(_documents(spark, sf_dir), spark.createDataFrame([], "document_id long, name string"), admin=False, visibility="PRIVATE", kind="PDF")
    return rows.limit(50).select(F.to_json(F.struct("document_id", "title")).alias("body"))


@query(
    "reprocess_errors",
    f"""WITH {_DOCUMENTS}, v AS (SELECT DISTINCT l_orderkey AS document_id FROM lineitem WHERE l_quantity > 40)
SELECT document_id, CASE WHEN upload_status <> 'UPLOADED' THEN 'not_uploaded' WHEN busy THEN 'not_eligible_state' WHEN category IS NOT NULL THEN 'no_item' WHEN item_type <> 'DOCUMENT' THEN 'not_a_document' WHEN v.document_id IS NOT NULL THEN 'has_verified_result' END AS error
FROM d LEFT JOIN v USING (document_id)""",
)
def _(spark, sf_dir):
    verified = table(spark, sf_dir, "lineitem", ["l_orderkey", "l_quantity"]).filter("l_quantity > 40").select(F.col("l_orderkey").alias("document_id")).distinct().withColumn("verified", F.lit(True))
    rows = _documents(spark, sf_dir).withColumn("state", F.when(F.col("busy"), "PROCESSING").otherwise("READY")).withColumn("item_id", F.when(F.col("category").isNull(), F.col("document_id")))
    return rows.join(verified, "document_id", "left").select("document_id", requests.reprocess_error(F.coalesce("verified", F.lit(False))).alias("error"))


_RUNS = """u AS (SELECT l_orderkey * 10 + l_linenumber AS run_id, l_suppkey AS document_id, l_returnflag AS model, ['STARTED', 'UPLOADED', 'RECOGNITION_STARTED', 'SUCCEEDED', 'FAILED', 'FAILED'][l_partkey % 6 + 1] AS status,
  CASE l_linenumber % 3 WHEN 0 THEN NULL WHEN 1 THEN ' ' ELSE 'r' || l_partkey END AS remote_id, CASE WHEN l_partkey % 5 = 0 THEN '' ELSE '1-3' END AS pages, l_shipdate AS created_at FROM lineitem)"""


def _runs(spark, sf_dir):
    c = F.col
    lines = table(spark, sf_dir, "lineitem", ["l_orderkey", "l_linenumber", "l_suppkey", "l_returnflag", "l_partkey", "l_shipdate"])
    status = F.element_at(F.array(*map(F.lit, ("STARTED", "UPLOADED", "RECOGNITION_STARTED", "SUCCEEDED", "FAILED", "FAILED"))), (c("l_partkey") % 6 + 1).cast("int"))
    remote = F.when(c("l_linenumber") % 3 == 1, " ").when(c("l_linenumber") % 3 == 2, F.concat(F.lit("r"), "l_partkey"))
    return lines.select(
        (c("l_orderkey") * 10 + c("l_linenumber")).alias("run_id"), c("l_suppkey").alias("document_id"), c("l_returnflag").alias("model"), status.alias("status"), remote.alias("remote_id"),
        F.when(c("l_partkey") % 5 == 0, "").otherwise("1-3").alias("pages"), c("l_shipdate").alias("created_at"),
    )


_LAST = "QUALIFY row_number() OVER (PARTITION BY document_id, model ORDER BY created_at DESC, run_id DESC, pages DESC, remote_id DESC NULLS LAST, status DESC) = 1"


@query("reusable_runs", f"WITH {_RUNS} SELECT document_id, model, run_id FROM u WHERE status IN ('FAILED', 'UPLOADED', 'RECOGNITION_STARTED') AND trim(coalesce(remote_id, '')) <> '' AND pages <> '' {_LAST}")
def _(spark, sf_dir):
    return requests.latest(_runs(spark, sf_dir), ["document_id", "model"], ["created_at", "run_id"], requests.reusable_run()).select("document_id", "model", "run_id")


@query("blocking_runs", f"WITH {_RUNS} SELECT document_id, model, run_id FROM u WHERE status IN ('STARTED', 'UPLOADED', 'RECOGNITION_STARTED', 'SUCCEEDED') OR (status = 'FAILED' AND trim(coalesce(remote_id, '')) <> '') {_LAST}")
def _(spark, sf_dir):
    return requests.latest(_runs(spark, sf_dir), ["document_id", "model"], ["created_at", "run_id"], requests.blocking_run()).select("document_id", "model", "run_id")


@query("latest_terminal_requests", f"WITH {_REQUESTS} SELECT document_id, operation, max(request_id) AS request_id FROM r WHERE status IN ('COMPLETED', 'PARTIAL', 'FAILED') GROUP BY ALL")
def _(spark, sf_dir):
    rows = _requests(spark, sf_dir).select("document_id", "operation", "request_id", "status")
    return requests.latest(rows, ["document_id", "operation"], ["request_id"], F.col("status").isin(*requests.TERMINAL)).drop("status")


@query("latest_target_events", "SELECT user_id AS target, event_id, event_type AS action FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")
def _(spark, sf_dir):
    rows = _events(spark, sf_dir, "user_id", "event_type").select(F.col("user_id").alias("target"), "event_id", F.col("event_type").alias("action"))
    return requests.latest(rows, ["target"], ["event_id"])


@query(
    "latest_nonempty_results",
    f"""WITH {RESULTS_SQL} SELECT doc_id, result_type, result_id FROM results WHERE status IN ('SUCCEEDED', 'NEEDS_REVIEW') AND text <> ''
QUALIFY row_number() OVER (PARTITION BY doc_id, result_type ORDER BY status = 'SUCCEEDED' DESC, created_at DESC, result_id DESC) = 1""",
)
def _(spark, sf_dir):
    return selection.latest_displayable(text_results(spark, sf_dir), blank=False).select("doc_id", "result_type", "result_id")


@query(
    "displayed_translations",
    f"""WITH {RESULTS_SQL}, latest AS (SELECT * FROM results WHERE status IN ('SUCCEEDED', 'NEEDS_REVIEW') AND regexp_matches(text, '\\S')
QUALIFY row_number() OVER (PARTITION BY doc_id, result_type ORDER BY status = 'SUCCEEDED' DESC, created_at DESC, result_id DESC) = 1)
SELECT h.doc_id, h.result_id FROM latest h JOIN documents d USING (doc_id) WHERE h.result_type = 'HEBREW_TEXT' AND CASE WHEN doc_id % 4 = 0 THEN 'he' ELSE d.lang END <> 'he' AND EXISTS (SELECT 1 FROM latest s WHERE s.doc_id = h.doc_id AND s.result_type = 'SOURCE_TEXT')""",
)
def _(spark, sf_dir):
    language = table(spark, sf_dir, "documents", ["doc_id", "lang"]).withColumn("lang", F.when(F.col("doc_id") % 4 == 0, "he").otherwise(F.col("lang")))
    return selection.displayed_translation(selection.latest_displayable(text_results(spark, sf_dir)), language)


@query("next_photo_positions", "SELECT c_custkey AS item_id, (coalesce(max(o_orderkey % 5), 0) + 1)::BIGINT AS position FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def _(spark, sf_dir):
    photos = table(spark, sf_dir, "orders", ["o_custkey", "o_orderkey"]).select(F.col("o_custkey").alias("item_id"), (F.col("o_orderkey") % 5).alias("position"))
    return selection.next_positions(table(spark, sf_dir, "customer", ["c_custkey"]).select(F.col("c_custkey").alias("item_id")), photos)


_BINDINGS = """t AS (SELECT doc_id * 2 + k AS result_id, doc_id AS document_id, CASE k WHEN 0 THEN 'SOURCE_TEXT' ELSE 'HEBREW_TEXT' END AS result_type, 's' || doc_id % 5 AS sha, (doc_id % 3)::INT AS revision, (doc_id % 4)::INT AS based_on FROM documents, (SELECT unnest([0, 1]) AS k)),
b AS (SELECT result_id, document_id AS snapshot_id, CASE WHEN result_id % 9 = 0 THEN 'OTHER' WHEN result_type = 'SOURCE_TEXT' THEN 'SOURCE' ELSE 'TRANSLATION' END AS role, 1 AS bound_revision, 's' || document_id % 5 AS bound_sha FROM t WHERE result_id % 7 <> 0),
s AS (SELECT doc_id AS snapshot_id, doc_id + (doc_id % 13 = 0)::INT AS snapshot_document, CASE WHEN doc_id % 11 = 0 THEN 'PENDING' ELSE 'READY' END AS snapshot_status, 's' || doc_id % 5 AS canonical_sha, doc_id % 2 = 0 AS hover_eligible FROM documents)"""


def _bindings(spark, sf_dir):
    c = F.col
    docs = table(spark, sf_dir, "documents", ["doc_id"])
    k = F.explode(F.array(F.lit(0), F.lit(1)))
    sha = lambda x: F.concat(F.lit("s"), x % 5)
    results = docs.withColumn("k", k).select(
        (c("doc_id") * 2 + c("k")).alias("result_id"), c("doc_id").alias("document_id"), F.when(c("k") == 0, "SOURCE_TEXT").otherwise("HEBREW_TEXT").alias("result_type"), sha(c("doc_id")).alias("sha"),
        (c("doc_id") % 3).cast("int").alias("revision"), (c("doc_id") % 4).cast("int").alias("based_on"),
    )
    role = F.when(c("result_id") % 9 == 0, "OTHER").when(c("result_type") == "SOURCE_TEXT", "SOURCE").otherwise("TRANSLATION")
    bindings = results.filter("result_id % 7 <> 0").select("result_id", c("document_id").alias("snapshot_id"), role.alias("role"), F.lit(1).alias("bound_revision"), sha(c("document_id")).alias("bound_sha"))
    snapshots = docs.select(
        c("doc_id").alias("snapshot_id"), (c("doc_id") + (c("doc_id") % 13 == 0).cast("int")).alias("snapshot_document"), F.when(c("doc_id") % 11 == 0, "PENDING").otherwise("READY").alias("snapshot_status"), sha(c("doc_id")).alias("canonical_sha"),
        (c("doc_id") % 2 == 0).alias("hover_eligible"),
    )
    return results, bindings, snapshots


@query(
    "binding_trust",
    f"""WITH {_BINDINGS}, j AS (SELECT t.*, b.role, hover_eligible, coalesce(b.role = CASE result_type WHEN 'SOURCE_TEXT' THEN 'SOURCE' ELSE 'TRANSLATION' END AND snapshot_document = document_id AND snapshot_status = 'READY' AND bound_sha = canonical_sha AND bound_revision >= 1
  AND CASE result_type WHEN 'HEBREW_TEXT' THEN based_on ELSE revision END = bound_revision AND (result_type = 'HEBREW_TEXT' OR sha = bound_sha), false) AS fresh FROM t LEFT JOIN b USING (result_id) LEFT JOIN s USING (snapshot_id))
SELECT result_id, role IS NOT NULL AS bound, fresh, fresh AND coalesce(hover_eligible, false) AS hover FROM j""",
)
def _(spark, sf_dir):
    return requests.binding_trust(*_bindings(spark, sf_dir))


@query(
    "binding_upsert",
    f"""WITH {_BINDINGS}, o AS (SELECT result_id, snapshot_id, role, bound_revision FROM b WHERE result_id % 2 = 0), a AS (SELECT result_id, document_id AS snapshot_id, 'NEW' AS role, (result_id % 3)::INT AS bound_revision FROM t WHERE result_id % 4 = 0),
g AS (SELECT a.* FROM a JOIN t USING (result_id) JOIN s USING (snapshot_id) WHERE snapshot_status = 'READY' AND snapshot_document = document_id AND sha = canonical_sha AND bound_revision >= 1)
SELECT * FROM g UNION ALL SELECT * FROM o WHERE result_id NOT IN (SELECT result_id FROM g)""",
)
def _(spark, sf_dir):
    results, bindings, snapshots = _bindings(spark, sf_dir)
    asked = results.filter("result_id % 4 = 0").select("result_id", F.col("document_id").alias("snapshot_id"), F.lit("NEW").alias("role"), (F.col("result_id") % 3).cast("int").alias("bound_revision"))
    return requests.bind(bindings.filter("result_id % 2 = 0").drop("bound_sha"), asked, results.select("result_id", "document_id", "sha"), snapshots)
