"""Windows over ordered rows, islands, gaps, rate limits and leases (W*, A18, A21, C*, D6, D8, F10, O6, P7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.scan import ordered_scan
from .search import table

NOW = "2024-01-03 12:00:00"


def format_pages(pages: DataFrame, key: str, page: str) -> DataFrame:
    """Distinct pages of a key as '3, 6, 12-13' (gaps and islands)."""
    w = Window.partitionBy(key).orderBy(page)
    runs = pages.select(key, page).distinct().withColumn("_i", F.col(page) - F.row_number().over(w)).groupBy(key, "_i").agg(F.min(page).alias("lo"), F.max(page).alias("hi"))
    text = F.when(F.col("lo") == F.col("hi"), F.col("lo").cast("string")).otherwise(F.concat_ws("-", "lo", "hi"))
    return runs.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("lo", text.alias("t")))).alias("r")).select(key, F.array_join(F.transform("r", lambda x: x["t"]), ", ").alias("pages"))


def w6_page_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").where("l_returnflag <> 'N'")
    return format_pages(li.select("l_orderkey", F.col("l_linenumber").alias("page")), "l_orderkey", "page")


def a18_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Missing numbers between an order's lowest and highest line, and the numbers it has twice."""
    li = table(spark, sf_dir, "lineitem").where("l_returnflag <> 'A'")
    g = li.groupBy("l_orderkey").agg(F.sort_array(F.collect_set("l_linenumber")).alias("have"), F.count("*").alias("n"))
    missing = F.array_except(F.sequence(F.array_min("have"), F.array_max("have")), "have")
    return g.select("l_orderkey", F.array_join(missing, ",").alias("missing"), (F.col("n") - F.size("have")).alias("n_repeated"))


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").dropDuplicates(["conv_id", "turn"])
    return c.select("conv_id", "turn", "role", F.length("text").alias("size"))


def w2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Next row, last user turn before, filled-down key, running scope, next place with wrap-around."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    user = F.when(F.col("role") == "user", F.col("turn"))
    return _turns(spark, sf_dir).select(
        "conv_id", "turn", F.lead("role").over(w).alias("next_role"), (F.lead("size").over(w) > F.col("size")).alias("is_heading"),
        F.last(user, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("prev_user"),
        F.last(user, ignorenulls=True).over(w).alias("filled"), F.sum(F.when(F.col("role") == "user", 1).otherwise(0)).over(w).alias("scope"),
        (F.row_number().over(w) - 1).alias("queue_place"), F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn") <= 1, "turn")).alias("review_place"),
    )


def a21_hierarchy_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each major item after its key is filled down; rows before the first go with it; big ones are split."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    key = F.when(F.col("role") == "user", F.col("turn"))
    t = _turns(spark, sf_dir).withColumn("k", F.coalesce(F.last(key, ignorenulls=True).over(w), F.first(key, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.lit(-1)))
    return t.groupBy("conv_id", "k").agg(F.count("*").alias("n"), (F.count("*") > 2).alias("split"))


def c2_sliding_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sends of a user in the 60 s up to each one, itself included, and whether a limit of 2 holds it back."""
    w = Window.partitionBy("user_id").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(-60_000_000, 0)
    n = F.count("*").over(w)
    return table(spark, sf_dir, "events").select("event_id", n.alias("n"), (n > 2).alias("waits"))


def c3_leases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running requests without a sign of life for 2 minutes go back to the queue; online state; purge dates."""
    e = table(spark, sf_dir, "events")
    now = F.lit(NOW).cast("timestamp")
    seen = F.when(F.col("event_type") != "error", F.col("ts"))
    lost = (F.col("event_id") % 2 == 0) & (seen.isNull() | (seen < now - F.expr("INTERVAL 2 MINUTES")))
    deleted = F.when(F.col("event_id") % 3 == 0, F.col("ts"))
    return e.select(
        "event_id", F.when(F.col("event_id") % 2 != 0, "requested").when(lost, "requested").otherwise("running").alias("state"),
        F.when(seen.isNull(), "never").when(now - seen < F.expr("INTERVAL 2 MINUTES"), "online").otherwise("offline").alias("runner"),
        F.coalesce(deleted.isNotNull() & (deleted + F.expr("INTERVAL 30 DAYS") <= F.lit("2024-02-01").cast("timestamp")), F.lit(False)).alias("purge"), deleted.isNull().alias("live"),
    )


def c4_next_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who would be claimed next: first in, first out among the claimable of each kind."""
    e = table(spark, sf_dir, "events").where((F.col("event_type") != "error") & ((F.col("value") > 5) | (F.col("ts") <= F.lit(NOW).cast("timestamp"))))
    return e.groupBy("event_type").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.count("*").alias("waiting"))


def c1_fixed_windows(events: DataFrame, key: str = "user_id", ts: str = "ts", window_s: int = 60, limit: int = 120) -> DataFrame:
    """A window begins with a key's first request and ends more than window_s after it; requests over the limit are refused.

    The scan's state is the window's begin and count; a key's requests may fill many tasks."""

    def step(state, micros):
        begin, n = state if state and micros - state[0] <= window_s * 1_000_000 else (micros, 0)
        return [begin, n + 1], (n + 1, n + 1 > limit)

    rows = events.select(F.col(key).alias("key"), F.unix_micros(F.col(ts).cast("timestamp")).alias("micros"), "event_id")
    return ordered_scan(rows, "key", ["micros", "event_id"], ["micros"], None, step, "n long, limited boolean")


def c1_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return c1_fixed_windows(table(spark, sf_dir, "events"), window_s=3600, limit=3).select("event_id", "n", "limited")


QUERIES = {f.__name__: f for f in (w6_page_ranges, a18_gaps, w2_neighbours, a21_hierarchy_counts, c2_sliding_limit, c3_leases, c4_next_claims, c1_rate_limit)}
TURNS = "WITH t AS (SELECT conv_id, turn, any_value(role) AS role, any_value(length(text)) AS size FROM conversations GROUP BY 1, 2)"
SQL = {
    "w6_page_ranges": "WITH d AS (SELECT DISTINCT l_orderkey, l_linenumber AS p FROM lineitem WHERE l_returnflag <> 'N'), i AS (SELECT *, p - row_number() OVER (PARTITION BY l_orderkey ORDER BY p) AS g FROM d), r AS (SELECT l_orderkey, min(p) AS lo, max(p) AS hi FROM i GROUP BY l_orderkey, g) SELECT l_orderkey, string_agg(CASE WHEN lo = hi THEN lo::VARCHAR ELSE lo || '-' || hi END, ', ' ORDER BY lo) AS pages FROM r GROUP BY 1",
    "a18_gaps": "WITH g AS (SELECT l_orderkey, list(DISTINCT l_linenumber) AS have, count(*) AS n FROM lineitem WHERE l_returnflag <> 'A' GROUP BY 1) SELECT l_orderkey, array_to_string(list_filter(range(list_min(have), list_max(have) + 1), lambda x: NOT list_contains(have, x)), ',') AS missing, n - len(have) AS n_repeated FROM g",
    "w2_neighbours": TURNS + " SELECT conv_id, turn, lead(role) OVER w AS next_role, lead(size) OVER w > size AS is_heading, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_user, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS filled, (sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER w)::BIGINT AS scope, (row_number() OVER w - 1)::INTEGER AS queue_place, row_number() OVER (PARTITION BY conv_id ORDER BY turn <= 1, turn)::INTEGER AS review_place FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn)",
    "a21_hierarchy_counts": TURNS + ", k AS (SELECT conv_id, turn, coalesce((SELECT max(u.turn) FROM t u WHERE u.conv_id = t.conv_id AND u.role = 'user' AND u.turn <= t.turn), (SELECT min(u.turn) FROM t u WHERE u.conv_id = t.conv_id AND u.role = 'user'), -1) AS k FROM t) SELECT conv_id, k, count(*) AS n, count(*) > 2 AS split FROM k GROUP BY 1, 2",
    "c2_sliding_limit": "WITH n AS (SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 60 SECONDS PRECEDING AND CURRENT ROW) AS n FROM events) SELECT event_id, n, n > 2 AS waits FROM n",
    "c3_leases": "WITH s AS (SELECT *, CASE WHEN event_type <> 'error' THEN ts END AS seen, CASE WHEN event_id % 3 = 0 THEN ts END AS gone, TIMESTAMP '2024-01-03 12:00:00' AS now FROM events) SELECT event_id, CASE WHEN event_id % 2 <> 0 OR seen IS NULL OR seen < now - INTERVAL 2 MINUTES THEN 'requested' ELSE 'running' END AS state, CASE WHEN seen IS NULL THEN 'never' WHEN now - seen < INTERVAL 2 MINUTES THEN 'online' ELSE 'offline' END AS runner, coalesce(gone + INTERVAL 30 DAYS <= TIMESTAMP '2024-02-01', false) AS purge, gone IS NULL AS live FROM s",
    "c4_next_claims": "SELECT event_type, arg_min(event_id, (ts, event_id)) AS event_id, count(*) AS waiting FROM events WHERE event_type <> 'error' AND (value > 5 OR ts <= TIMESTAMP '2024-01-03 12:00:00') GROUP BY 1",
}
