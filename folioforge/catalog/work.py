"""The request queue."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioforge.operators import filters
from folioforge.registry import query
from folioforge.sources.tables import table
from folioforge.streaming import leases


def deliveries(spark, sf_dir):
    """Events as deliveries: a user is a request; views and clicks deliver, purchases complete, errors fail, sign-ups recover."""
    kind = F.col("event_type")
    action = F.when(kind.isin("view", "click"), "deliver").when(kind == "purchase", "COMPLETED").when(kind == "error", "NOOP").otherwise("recover")
    now = F.unix_seconds(F.col("ts").cast("timestamp")).cast("double")
    return table(spark, sf_dir, "events", ["event_id", "ts", "user_id", "event_type"]).select(
        F.col("user_id").alias("request_id"), "event_id", now.alias("now"), action.alias("action"), F.lit(-1).cast("long").alias("token")
    )


@query("lease_replay")
def _(spark, sf_dir):
    return leases.replay(deliveries(spark, sf_dir))


@query(
    "coalesce_active_requests",
    """WITH a AS (SELECT user_id AS document_id, event_id AS request_id, value AS enqueued FROM events WHERE event_type <> 'purchase')
SELECT document_id, arg_min(request_id, (enqueued, request_id)) AS request_id, (count(*) - 1)::BIGINT AS duplicates FROM a GROUP BY 1""",
)
def _(spark, sf_dir):
    status = F.when(F.col("event_type") == "purchase", "COMPLETED").otherwise("QUEUED")
    rows = table(spark, sf_dir, "events", ["event_id", "user_id", "event_type", "value"])
    return leases.coalesced(rows.select(F.col("user_id").alias("document_id"), F.col("event_id").alias("request_id"), F.col("value").alias("enqueued"), status.alias("status")))


@query("expired_leases", """SELECT event_id AS request_id, CASE WHEN event_id % 9 <> 0 THEN value END AS lease FROM events WHERE event_type = 'view' AND (event_id % 9 = 0 OR value <= 50)""")
def _(spark, sf_dir):
    rows = table(spark, sf_dir, "events", ["event_id", "event_type", "value"]).select(
        F.col("event_id").alias("request_id"), F.when(F.col("event_type") == "view", "RUNNING").otherwise("QUEUED").alias("status"), F.when(F.col("event_id") % 9 != 0, F.col("value")).alias("lease")
    )
    return filters.expired(rows, F.lit(50.0)).select("request_id", "lease")


@query(
    "persist_fencing",
    """WITH w AS (SELECT event_id, CASE WHEN event_id % 6 = 0 THEN NULL ELSE event_id // 2 END AS request_id, user_id AS document_id, event_id % 3 AS token FROM events),
r AS (SELECT event_id AS request_id, user_id AS document_id, event_id % 3 AS token FROM events WHERE event_type IN ('view', 'click'))
SELECT event_id FROM w WHERE request_id IS NULL OR EXISTS (SELECT 1 FROM r WHERE r.request_id = w.request_id AND r.document_id = w.document_id AND r.token = w.token)""",
)
def _(spark, sf_dir):
    e, k = table(spark, sf_dir, "events", ["event_id", "user_id", "event_type"]), F.col("event_id")
    writes = e.select("event_id", F.when(k % 6 != 0, F.floor(k / 2)).alias("request_id"), F.col("user_id").alias("document_id"), (k % 3).alias("token"))
    status = F.when(F.col("event_type").isin("view", "click"), "RUNNING").otherwise("COMPLETED")
    requests = e.select(k.alias("request_id"), F.col("user_id").alias("document_id"), (k % 3).alias("token"), status.alias("status"))
    return leases.may_persist(writes, requests).select("event_id")
