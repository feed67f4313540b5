"""A stream of reports, heartbeats and timers against the batch replay of its log, across a restart; rules of single steps."""

import random

from pyspark.sql import functions as F

from tessellate.streaming import requests as R

SECOND = 1_000_000
SCHEMA = "request_id long, ts timestamp, event_id long, report string"


def events(spark, rows):
    df = spark.createDataFrame([(k, t, i, r) for i, (k, t, r) in enumerate(rows)], "request_id long, s long, event_id long, report string")
    return df.select("request_id", F.timestamp_seconds("s").alias("ts"), "event_id", "report")


def test_steps():
    life, out = R.take(None, 0, "done")
    assert life.state == "requested" and out == []
    life, out = R.take(life, 5, "running")
    assert out == [(5, "reported", "running")] and R.due(life) == (5 + R.LEASE, "released")
    life, _ = R.take(life, 9, R.HEARTBEAT)
    life, _ = R.take(life, 7, R.HEARTBEAT)
    assert life.seen == 9
    life, out = R.pass_time(life, 9 + R.LEASE)
    assert life.state == "requested" and out == [(9 + R.LEASE, "released", "requested")]
    life, _ = R.take(R.take(life, R.DAY, "running")[0], R.DAY, "needs_documents")
    assert R.take(life, R.DAY, "running")[0] == life
    assert R.pass_time(life, R.DAY + R.KEEP) == (None, [(R.DAY + R.KEEP, "purged", "purged")])


def test_stream_equals_replay_across_a_restart(spark, tmp_path):
    rng, rows, t = random.Random(5), [], 0
    reports = ["running", "running", R.HEARTBEAT, R.HEARTBEAT, "done", "failed", "paused_quota", "needs_login", "needs_documents", "needs_documents", "cancelled", None]
    for _ in range(400):
        t += rng.choice([0, 1, 5, 20, 90])
        rows.append((rng.randrange(9), t, rng.choice(reports)))
    # the last event carries the watermark beyond every lease and purge
    rows.append((99, t + 10_000, "running"))
    log = events(spark, rows)
    lease, keep = 200 * SECOND, 900 * SECOND
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", R.ROCKSDB)
    try:
        stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
        changes = R.lives(stream, "0 seconds", lease, keep)
        parts = [log.where(f"event_id >= {a} AND event_id < {b}") for a, b in ((0, 150), (150, 300), (300, 401))]
        for i, part in enumerate(parts):
            # each round is a run of its own that goes on from the checkpoint of the one before
            part.coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
            q = changes.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").outputMode("append").trigger(availableNow=True).start()
            q.awaitTermination(240)
            assert q.exception() is None
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    key = lambda r: (r.request_id, r.ts, r.change, r.state)
    got = sorted(map(key, spark.read.parquet(f"{tmp_path}/out").collect()))
    until = spark.range(1).select(F.timestamp_seconds(F.lit(t + 10_000)).cast("string")).head()[0]
    want = sorted(map(key, R.replayed(log, until, lease, keep).collect()))
    assert got == want
    assert {r[2] for r in got} == {"reported", "released", "purged"} and "needs_documents" in {r[3] for r in got}


def test_empty_log(spark):
    assert R.replayed(events(spark, [(1, 1, "running")]).limit(0), "2024-01-01").count() == 0
