"""The request queue: claims under leases, as a batch replay and as a stateful stream.

A delivery of a request claims it if it is queued, waits if another holder's lease is alive, and parks it
for recovery if the lease is over. A terminal action ends it if it carries the holder's token.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

LEASE_SECONDS = 45 * 60
DEFER_SECONDS = 120
TERMINAL = ("COMPLETED", "PARTIAL", "FAILED")
SCHEMA = "request_id long, event_id long, outcome string, status string"


@dataclass
class Request:
    status: str = "QUEUED"
    token: int = -1
    lease: float = 0.0

    def deliver(self, now: float, token: int) -> str:
        """EXECUTE (with a new token and lease), DEFER or ACK."""
        if self.status in ("QUEUED", "ENQUEUE_FAILED"):
            self.status, self.token, self.lease = "RUNNING", token, now + LEASE_SECONDS
            return "EXECUTE"
        if self.status == "RUNNING":
            if self.lease > now:
                return "DEFER"
            self.status = "RECOVERY_REQUIRED"  # the token stays: the late holder may still finish
        return "ACK"

    def finish(self, outcome: str, token: int) -> str:
        """DONE, or REFUSED where the request is not running or another holds it; NOOP ends as FAILED."""
        if self.status not in ("RUNNING", "RECOVERY_REQUIRED") or token != self.token:
            return "REFUSED"
        self.status = "FAILED" if outcome == "NOOP" else outcome
        return "DONE"

    def recover(self, now: float, token: int) -> str:
        if self.status != "RECOVERY_REQUIRED":
            return "REFUSED"
        self.status, self.token, self.lease = "QUEUED", -1, 0.0
        return "REQUEUED"

    def step(self, action: str, now: float, event: int, token: int) -> str:
        if action == "deliver":
            return self.deliver(now, event)
        if action == "recover":
            return self.recover(now, event)
        return self.finish(action, self.token if token < 0 else token)


def _step(a, x):
    """The state (status, token, lease, out) of a request after one more delivery: the rules of `Request` as expressions."""
    deliver, recover = x["action"] == "deliver", x["action"] == "recover"
    running, parked = a["status"] == "RUNNING", a["status"] == "RECOVERY_REQUIRED"
    holds = (running | parked) & (F.when(x["token"] < 0, a["token"]).otherwise(x["token"]) == a["token"])
    outcome = (
        F.when(deliver & a["status"].isin("QUEUED", "ENQUEUE_FAILED"), "EXECUTE").when(deliver & running & (a["lease"] > x["now"]), "DEFER").when(deliver, "ACK")
        .when(recover & parked, "REQUEUED").when(recover, "REFUSED").when(holds, "DONE").otherwise("REFUSED")
    )
    status = (
        F.when(outcome == "EXECUTE", "RUNNING").when((outcome == "ACK") & running, "RECOVERY_REQUIRED").when(outcome == "REQUEUED", "QUEUED")
        .when(outcome == "DONE", F.when(x["action"] == "NOOP", "FAILED").otherwise(x["action"])).otherwise(a["status"])
    )
    token = F.when(outcome == "EXECUTE", x["event_id"]).when(outcome == "REQUEUED", F.lit(-1).cast("long")).otherwise(a["token"])
    lease = F.when(outcome == "EXECUTE", x["now"] + float(LEASE_SECONDS)).when(outcome == "REQUEUED", F.lit(0.0)).otherwise(a["lease"])
    row = F.struct(x["event_id"].alias("event_id"), outcome.alias("outcome"), status.alias("status"))
    return F.struct(status.alias("status"), token.alias("token"), lease.alias("lease"), F.array_append(a["out"], row).alias("out"))


def replay(deliveries: DataFrame) -> DataFrame:
    """Outcome of each delivery (request_id, event_id, now, action, token), folded per request in order of (now, event_id).

    A request's deliveries are one array, folded by built-in functions; it is left after its terminal
    action, which bounds a real queue's arrays.
    """
    step = F.struct(F.col("now").cast("double").alias("now"), F.col("event_id").cast("long").alias("event_id"), "action", F.col("token").cast("long").alias("token"))
    own = deliveries.groupBy("request_id").agg(F.array_sort(F.collect_list(step)).alias("steps"))
    none = F.array().cast("array<struct<event_id:bigint,outcome:string,status:string>>")
    begin = F.struct(F.lit("QUEUED").alias("status"), F.lit(-1).cast("long").alias("token"), F.lit(0.0).alias("lease"), none.alias("out"))
    rows = own.select("request_id", F.explode(F.aggregate("steps", begin, _step)["out"]).alias("x"))
    return rows.select(F.col("request_id").cast("long").alias("request_id"), "x.event_id", "x.outcome", "x.status")


def stream(deliveries: DataFrame) -> DataFrame:
    """The same over a stream, with the request's status, token and lease as keyed state."""

    def fold(key: tuple, groups: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        own = Request(*state.get) if state.exists else Request()
        rows = []
        whole = pd.concat(list(groups))
        for r in whole.sort_values(["now", "event_id"]).itertuples(index=False):
            outcome = own.step(r.action, r.now, r.event_id, r.token)
            rows.append((key[0], r.event_id, outcome, own.status))
        state.update((own.status, own.token, own.lease))
        yield pd.DataFrame(rows, columns=["request_id", "event_id", "outcome", "status"])

    return deliveries.groupBy("request_id").applyInPandasWithState(fold, SCHEMA, "status string, token long, lease double", "append", "NoTimeout")


TIMED = "request_id long, event_id long, outcome string, status string, visible_after double"
#: Seconds for which the end of a request is remembered, so that copies of its messages are told to go: the longest that a queue keeps a message.
RETENTION_SECONDS = 14 * 24 * 3600
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class LeaseProcessor(StatefulProcessor):
    """A request's status, token and lease as state, and one timer: the end of the lease, or of what is remembered of its end."""

    def __init__(self, retention: float = RETENTION_SECONDS):
        self.retention = retention

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("request", "status string, token long, lease double, timer long")

    def _keep(self, own: Request, timer: int | None, due: float | None) -> None:
        """Store the request and its only timer, or nothing at all where it ended and nothing is to be remembered."""
        wanted = None if due is None else int(due * 1000)
        if timer is not None and timer != wanted:
            self.handle.deleteTimer(timer)
        if own.status in TERMINAL and wanted is None:
            self.state.clear()
            return
        if wanted is not None and timer != wanted:
            self.handle.registerTimer(wanted)
        self.state.update((own.status, own.token, own.lease, wanted))

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803  names of the interface
        own, timer = Request(), None
        if self.state.exists():
            status, token, lease, timer = self.state.get()
            own = Request(status, token, lease)
        last = 0.0
        for r in sorted(rows, key=lambda r: (r.now, r.event_id)):  # of one request and one batch
            outcome, last = own.step(r.action, r.now, r.event_id, r.token), r.now
            after = {"EXECUTE": own.lease, "DEFER": r.now + DEFER_SECONDS}.get(outcome)
            yield Row(request_id=key[0], event_id=r.event_id, outcome=outcome, status=own.status, visible_after=after)
        if own.status == "RUNNING":
            due = own.lease
        elif own.status in TERMINAL and self.retention:
            due = timer / 1000 if timer is not None and status in TERMINAL else last + self.retention
        else:
            due = None
        self._keep(own, timer, due)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        if not self.state.exists():
            return
        status, token, lease, timer = self.state.get()
        if timer != expiredTimerInfo.getExpiryTimeInMs():
            return
        if status in TERMINAL:
            self.state.clear()
        elif status == "RUNNING":  # nobody has to ask: the holder is fenced, and keeps its token
            self.state.update(("RECOVERY_REQUIRED", token, lease, None))
            yield Row(request_id=key[0], event_id=None, outcome="EXPIRED", status="RECOVERY_REQUIRED", visible_after=None)

    def close(self) -> None:
        pass


def timed_stream(deliveries: DataFrame, *, late: str = "2 minutes", retention: float = RETENTION_SECONDS, time_mode: str = "EventTime") -> DataFrame:
    """Outcomes of a stream of deliveries (request_id, event_id, now, action, token), and an EXPIRED row for a lease whose end passes without an event of its request.

    `visible_after` is when a message that stays in the queue is to be seen again: at the end of the lease for
    EXECUTE, DEFER_SECONDS on for DEFER. With `time_mode` EventTime leases end as the deliveries' own time
    goes on, and one that comes more than `late` after a newer one is dropped by Spark, so that a rerun gives
    the same; with ProcessingTime they end by the clock, and none is dropped. A request that has ended is
    remembered for `retention` seconds and leaves no state after them, at once if that is 0.
    """
    rows = deliveries.withColumn("at", F.timestamp_millis((F.col("now") * 1000).cast("long")))
    rows = rows.withWatermark("at", late) if time_mode == "EventTime" else rows
    return rows.groupBy("request_id").transformWithState(LeaseProcessor(retention), TIMED, "Append", time_mode)


def acknowledgements(outcomes: DataFrame) -> DataFrame:
    """(event_id, action, visible_after): what the queue is told of each message: `delete` one that is done or refused, `extend` one that is executed or deferred."""
    kept = F.col("outcome").isin("EXECUTE", "DEFER")
    return outcomes.filter("event_id IS NOT NULL").select("event_id", F.when(kept, "extend").otherwise("delete").alias("action"), F.when(kept, F.col("visible_after")).alias("visible_after"))


def acknowledge_to(path: str):
    """A foreachBatch function: outcomes and acknowledgements of a batch as tables below its own number.

    A batch that is run again after a restart takes the place of what it left, so that both tables hold each
    delivery once.
    """
    def put(batch: DataFrame, number: int) -> None:
        held = batch.persist()
        try:
            held.write.mode("overwrite").parquet(f"{path}/outcomes/batch={number}")
            acknowledgements(held).write.mode("overwrite").parquet(f"{path}/acknowledgements/batch={number}")
        finally:
            held.unpersist()

    return put


def run_queue(deliveries: DataFrame, path: str, checkpoint: str, **options):
    """Start `timed_stream` over what is there now, with outcomes and acknowledgements below `path`; the query. State is in RocksDB, as timers need."""
    spark = deliveries.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    writer = timed_stream(deliveries, **options).writeStream.foreachBatch(acknowledge_to(path)).outputMode("append")
    return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def coalesced(requests: DataFrame) -> DataFrame:
    """(document_id, request_id, duplicates): the first active request of each document, and how many repeat it."""
    active = requests.filter(~F.col("status").isin(*TERMINAL))
    first = F.min(F.struct("enqueued", "request_id"))
    return active.groupBy("document_id").agg(first["request_id"].alias("request_id"), (F.count(F.lit(1)) - 1).alias("duplicates"))


def may_persist(writes: DataFrame, requests: DataFrame) -> DataFrame:
    """Writes whose request exists, is of the same document, is running or parked, and has the same token; writes without a request pass."""
    known = requests.filter(F.col("status").isin("RUNNING", "RECOVERY_REQUIRED")).select("request_id", "document_id", "token")
    legacy = writes.filter("request_id IS NULL")
    return writes.join(known, ["request_id", "document_id", "token"], "left_semi").select(*writes.columns).unionByName(legacy)
