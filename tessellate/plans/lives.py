"""The log of events read as reports of requests, replayed with leases and purges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..streaming.requests import DAY, HEARTBEAT, MINUTE, NEXT, replayed
from .search import table

LEASE, KEEP, UNTIL = 360 * MINUTE, 3 * DAY, "2024-02-10 00:00:00"
REPORTS = {"view": "running", "click": HEARTBEAT, "signup": "paused_quota", "purchase": "done", "error": "needs_documents"}


def c5_lives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every change of every request: reports that were taken, leases that ran out, purges."""
    kinds = F.create_map(*[F.lit(x) for kv in REPORTS.items() for x in kv])
    report = F.when((F.col("event_type") == "error") & (F.col("event_id") % 2 == 0), "failed").otherwise(F.try_element_at(kinds, F.col("event_type")))
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("request_id"), F.col("ts").cast("timestamp").alias("ts"), "event_id", report.alias("report"))
    return replayed(events, UNTIL, LEASE, KEEP).select("request_id", F.unix_micros("ts").alias("micros"), "change", "state")


_ALLOWED = " OR ".join(f"(s = '{a}' AND report IN ({', '.join(repr(b) for b in after)}))" for a, after in NEXT.items() if after)
_CLOSED = ", ".join(repr(a) for a, after in NEXT.items() if not after)
QUERIES = {"c5_lives": c5_lives}
SQL = {
    "c5_lives": f"""
WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) AS t, CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN 'failed' ELSE CASE event_type {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in REPORTS.items())} END END AS report,
  row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events WHERE ts <= TIMESTAMP '{UNTIL}'),
n AS (SELECT user_id, t, report, i FROM e UNION ALL SELECT user_id, epoch_us(TIMESTAMP '{UNTIL}'), NULL, max(i) + 1 FROM e GROUP BY user_id),
w AS (SELECT user_id, 0::BIGINT AS i, NULL::VARCHAR AS state, 0::BIGINT AS since, 0::BIGINT AS seen, NULL::VARCHAR AS late, 0::BIGINT AS late_at, NULL::VARCHAR AS taken, 0::BIGINT AS t FROM (SELECT DISTINCT user_id FROM e)
  UNION ALL
  SELECT user_id, i, CASE WHEN ok THEN report ELSE s END, CASE WHEN ok THEN t WHEN fresh THEN t ELSE b END, CASE WHEN ok OR fresh OR report = '{HEARTBEAT}' THEN greatest(t, CASE WHEN fresh THEN 0 ELSE seen END) ELSE seen END, late, late_at, CASE WHEN ok THEN report END, t FROM (
    SELECT *, coalesce({_ALLOWED}, false) AS ok FROM (
      SELECT user_id, i, t, report, seen, late, late_at, late = 'purged' OR state IS NULL AS fresh, CASE WHEN late IS NOT NULL OR state IS NULL THEN 'requested' ELSE state END AS s, CASE WHEN late = 'released' THEN late_at ELSE since END AS b FROM (
        SELECT n.user_id, n.i, n.t, n.report, w.state, w.since, w.seen, CASE WHEN w.state = 'running' AND w.seen + {LEASE} <= n.t THEN 'released' WHEN w.state IN ({_CLOSED}) AND w.since + {KEEP} <= n.t THEN 'purged' END AS late,
          CASE WHEN w.state = 'running' THEN w.seen + {LEASE} ELSE w.since + {KEEP} END AS late_at FROM w JOIN n ON w.user_id = n.user_id AND n.i = w.i + 1))))
SELECT user_id AS request_id, late_at AS micros, late AS change, CASE WHEN late = 'released' THEN 'requested' ELSE 'purged' END AS state FROM w WHERE late IS NOT NULL
UNION ALL SELECT user_id, t, 'reported', taken FROM w WHERE taken IS NOT NULL"""
}
