import random

import pytest
from pyspark.sql import functions as F

from folioforge.streaming import leases

#: Times are seconds of an epoch; at its beginning Spark takes rows for late.
START = 1_000_000.0
KIND = "request_id long, event_id long, now double, action string, token long"


def put(spark, folder, name, rows):
    spark.createDataFrame([(r, e, START + now, *more) for r, e, now, *more in rows], KIND).coalesce(1).write.parquet(f"{folder}/{name}")


def run(spark, tmp_path, **options):
    """All files that are there now, one a batch; the outcomes so far."""
    source = spark.readStream.schema(KIND).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    query = leases.run_queue(source, f"{tmp_path}/out", f"{tmp_path}/ck", **options)
    assert query.awaitTermination(180) and query.exception() is None
    return query, sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out/outcomes").select("request_id", F.coalesce("event_id", F.lit(-1)), "outcome", "status").collect())


def state_rows(query):
    return query.lastProgress["stateOperators"][0]["numRowsTotal"]


def test_a_lease_ends_without_an_event_and_a_restart_repeats_nothing(spark, tmp_path):
    put(spark, f"{tmp_path}/in", "a", [(1, 10, 0.0, "deliver", -1), (2, 20, 5.0, "deliver", -1), (2, 21, 6.0, "deliver", -1)])
    query, got = run(spark, tmp_path)
    assert got == [(1, 10, "EXECUTE", "RUNNING"), (2, 20, "EXECUTE", "RUNNING"), (2, 21, "DEFER", "RUNNING")]
    # another request's time goes on past the end of both leases
    put(spark, f"{tmp_path}/in", "b", [(3, 30, 4000.0, "deliver", -1)])
    query, got = run(spark, tmp_path)
    assert got == [(1, -1, "EXPIRED", "RECOVERY_REQUIRED"), (1, 10, "EXECUTE", "RUNNING"), (2, -1, "EXPIRED", "RECOVERY_REQUIRED"), (2, 20, "EXECUTE", "RUNNING"), (2, 21, "DEFER", "RUNNING"), (3, 30, "EXECUTE", "RUNNING")]
    # the late holder still ends its request; the parked one is recovered and claimed anew
    put(spark, f"{tmp_path}/in", "c", [(1, 11, 4001.0, "COMPLETED", 10), (2, 22, 4001.0, "recover", -1), (2, 23, 4002.0, "deliver", -1), (3, 31, 4003.0, "COMPLETED", 99)])
    query, got = run(spark, tmp_path)
    assert [r for r in got if r[1] in (11, 22, 23, 31)] == [(1, 11, "DONE", "COMPLETED"), (2, 22, "REQUEUED", "QUEUED"), (2, 23, "EXECUTE", "RUNNING"), (3, 31, "REFUSED", "RUNNING")]
    assert len(got) == 10
    told = {r.event_id: (r.action, r.visible_after) for r in spark.read.parquet(f"{tmp_path}/out/acknowledgements").collect()}
    assert told[20] == ("extend", START + 5.0 + leases.LEASE_SECONDS) and told[21] == ("extend", START + 6.0 + leases.DEFER_SECONDS) and told[11] == ("delete", None) and len(told) == 8


@pytest.mark.parametrize("retention", [0, 100])
def test_an_ended_request_leaves_no_state(spark, tmp_path, retention):
    put(spark, f"{tmp_path}/in", "a", [(i, 10 * i, float(i), "deliver", -1) for i in range(1, 6)] + [(i, 10 * i + 1, 20.0 + i, "COMPLETED", -1) for i in range(1, 6)])
    query, _ = run(spark, tmp_path, retention=retention, late="0 seconds")
    if retention:
        put(spark, f"{tmp_path}/in", "b", [(1, 12, 60.0, "deliver", -1)])
        query, got = run(spark, tmp_path, retention=retention, late="0 seconds")
        assert (1, 12, "ACK", "COMPLETED") in got
    put(spark, f"{tmp_path}/in", "c", [(9, 90, 500.0, "deliver", -1)])
    query, got = run(spark, tmp_path, retention=retention, late="0 seconds")
    assert not any(r[2] == "EXPIRED" for r in got)
    put(spark, f"{tmp_path}/in", "d", [(9, 91, 501.0, "COMPLETED", -1)])
    put(spark, f"{tmp_path}/in", "e", [(8, 80, 900.0, "deliver", -1)])
    put(spark, f"{tmp_path}/in", "f", [(8, 81, 901.0, "FAILED", -1)])
    put(spark, f"{tmp_path}/in", "g", [(7, 70, 5000.0, "recover", -1)])
    query, got = run(spark, tmp_path, retention=retention, late="0 seconds")
    source = spark.read.format("statestore").option("stateVarName", "request").load(f"{tmp_path}/ck")
    assert [r[0][0] for r in source.select("key").collect()] == [7]


def test_outcomes_are_those_of_the_replay(spark, tmp_path):
    rng = random.Random(6)
    rows, now = [], 0.0
    for k in range(300):
        now += rng.choice([1, 30, 400])
        rows.append((rng.randrange(12), k, now, rng.choice(["deliver", "deliver", "deliver", "recover", "COMPLETED", "NOOP"]), rng.choice([-1, -1, k - 3])))
    for i in range(4):
        put(spark, f"{tmp_path}/in", f"{i}", rows[i * 75 : (i + 1) * 75])
    _, got = run(spark, tmp_path, late="1 day")  # no timer is due before a later delivery tells
    want = sorted((r.request_id, r.event_id, r.outcome, r.status) for r in leases.replay(spark.createDataFrame(rows, KIND)).collect())
    assert [r for r in got if r[1] >= 0] == want
