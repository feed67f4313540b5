"""Roll-ups, joins and verdicts (A*, J*, P*, F14-F18, O7, U*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators.places import global_places
from .search import table


def cents(c: Column) -> Column:
    return F.round(c, 2)


def a1_order_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line, column and grand totals of an order's lines; an order without lines has zeros."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    sums = li.groupBy("l_orderkey").agg(*[F.sum(F.col(c).cast("decimal(18,2)")).cast("double").alias(n) for c, n in (("l_quantity", "qty"), ("l_extendedprice", "price"), ("l_tax", "tax"))], F.count("*").alias("n_lines"))
    rows = o.select("o_orderkey").join(sums, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return rows.select("o_orderkey", zero("qty").alias("qty"), zero("price").alias("price"), zero("tax").alias("tax"), cents(zero("qty") + zero("price") + zero("tax")).alias("grand"), F.coalesce("n_lines", F.lit(0)).alias("n_lines"))


def a1_nested_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same sum over a nested array of items with amounts as text, blank counted as 0."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.when(F.col("l_returnflag") == "A", F.lit("")).otherwise(F.col("l_quantity").cast("int").cast("string"))).alias("items"))
    return li.select("l_orderkey", F.aggregate("items", F.lit(0.0), lambda a, x: a + S.number(x)).alias("total"), F.size("items").alias("n"))


def a4_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("month", F.date_format("o_orderdate", "yyyy-MM"))
    return o.groupBy("month").agg(F.sum(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice").cast("decimal(18,2)"))).cast("double").alias("total_f"), F.count_if(F.col("o_orderstatus") == "O").alias("n_open"), F.count("*").alias("n"), F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("latest"))


def a8_cross_tab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status by priority with zeros and a TOTAL row."""
    o = table(spark, sf_dir, "orders")
    per = [F.count_if(F.col("o_orderstatus") == s).alias(f"n_{s.lower()}") for s in ("F", "O", "P", "X")]
    groups = o.groupBy(F.col("o_orderpriority").alias("grp")).agg(*per, F.count("*").alias("n"))
    total = groups.agg(*[F.sum(c).alias(c) for c in groups.columns[1:]]).select(F.lit("TOTAL").alias("grp"), *groups.columns[1:])
    return groups.unionByName(total)


def a11_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checked of total in percent, skipped rows left out, 0 when nothing is left; all-decided test."""
    e = table(spark, sf_dir, "events")
    live = F.col("event_type") != "error"
    done = live & (F.col("value") > 10)
    g = e.groupBy("user_id").agg(F.count_if(done).alias("checked"), F.count_if(live).alias("total"), F.coalesce(F.bool_and(F.when(live, F.col("value") > 1)), F.lit(False)).alias("decided"))
    return g.select("user_id", "checked", "total", F.when(F.col("total") == 0, 0).otherwise(F.floor(100 * F.col("checked") / F.col("total") + 0.5)).cast("int").alias("percent"), "decided", F.when(F.col("checked") == F.col("total"), "done").when(F.col("checked") > 0, "doing").otherwise("todo").alias("step"))


def a14_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most common size of a brand, the smallest of equals."""
    n = table(spark, sf_dir, "part").groupBy("p_brand", "p_size").count()
    return n.groupBy("p_brand").agg(F.max_by("p_size", F.struct("count", -F.col("p_size"))).alias("mode"), F.count("*").alias("n_sizes"))


def a23_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p50 and p90 by index floor(p * n), not interpolated: places in the order of all types, less those of the types before."""
    e = table(spark, sf_dir, "events").where("value IS NOT NULL").select("event_type", "value", "event_id")
    placed = global_places(e, F.col("event_type"), F.col("value"), F.col("event_id"))
    spans = placed.groupBy("event_type").agg(F.min("place").alias("first"), F.count("*").alias("n"), F.max("value").alias("most"))
    at = lambda p: F.col("first") + F.least(F.floor(F.col("n") * p), F.col("n") - 1)
    wanted = spans.select("event_type", "most", at(0.5).alias("at50"), at(0.9).alias("at90"))
    found = placed.join(wanted, "event_type").where("place IN (at50, at90)")
    pick = lambda c: F.max(F.when(F.col("place") == F.col(c), F.col("value")))
    return found.groupBy("event_type").agg(pick("at50").alias("p50"), pick("at90").alias("p90"), F.max("most").alias("most"))


def j1_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Left join to one with a default name."""
    n = table(spark, sf_dir, "nation").where("n_nationkey % 2 = 0")
    return table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", F.coalesce("n_name", F.lit("system")).alias("actor"))


def j2_nested_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("lines"))
    o = table(spark, sf_dir, "orders").join(li, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return o.select("o_orderkey", F.coalesce(F.array_join(F.transform("lines", lambda x: F.concat_ws(":", x["l_linenumber"], x["l_partkey"])), " "), F.lit("")).alias("lines"))


def j4_with_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some / none of a relation."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders").where("o_totalprice > 300000").select(F.col("o_custkey").alias("c_custkey"))
    some = c.join(o, "c_custkey", "left_semi").select("c_custkey", F.lit("some").alias("kind"))
    return some.unionByName(c.join(o, "c_custkey", "left_anti").select("c_custkey", F.lit("none").alias("kind")))


def f17_exactly_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scalar count of 1, and a guard that looks at another table."""
    s = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("n"), F.min("s_suppkey").alias("s_suppkey")).where("n = 1")
    guard = table(spark, sf_dir, "customer").where("c_acctbal > 1e9").limit(1)
    return table(spark, sf_dir, "nation").join(s, F.col("n_nationkey") == F.col("s_nationkey")).join(guard.select(F.lit(1).alias("x")), F.lit(True), "left_anti").select("n_name", "s_suppkey")


def j8_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest event a user has, and what state the requests are in."""
    e = table(spark, sf_dir, "events")
    last = F.max_by(F.struct("event_id", "event_type", "value"), F.struct("ts", "event_id"))
    return e.groupBy("user_id").agg(last.alias("l"), F.max("ts").alias("seen"), F.count_if(F.col("event_type") == "error").alias("n_errors")).select("user_id", "l.*", "seen", "n_errors")


def j12_unique_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An exact name, else the only name that contains the text, else nothing."""
    parts = table(spark, sf_dir, "part").groupBy("p_name").count().select("p_name")
    asked = spark.createDataFrame([("small ring",), ("small",), ("purple w",), ("zzz",), ("blue widget",)], "ask string")
    exact = asked.join(parts, F.col("ask") == F.col("p_name"), "left_semi").select("ask", F.col("ask").alias("found"))
    near = parts.join(F.broadcast(asked), F.contains(F.col("p_name"), F.col("ask"))).groupBy("ask").agg(F.count("*").alias("n"), F.min("p_name").alias("only")).where("n = 1")
    rest = asked.join(exact, "ask", "left_anti").join(near, "ask", "left").select("ask", F.col("only").alias("found"))
    return exact.unionByName(rest)


def o7_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three best a group: a label hit first, then the share, then the order of the source."""
    li = table(spark, sf_dir, "lineitem")
    w = Window.partitionBy("l_suppkey").orderBy(F.when(F.col("l_returnflag") == "R", 0).otherwise(1), F.desc("l_extendedprice"), "l_orderkey", "l_linenumber", "l_partkey")
    return li.withColumn("place", F.row_number().over(w)).where("place <= 3").select("l_suppkey", "place", "l_orderkey", "l_linenumber")


def s18_picked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows in the order they were picked, the first of a repeated pick counts."""
    picks = [7, 3, 900, 3, 12, 7, 100000]
    p = F.broadcast(spark.createDataFrame([(i, k) for i, k in enumerate(picks)], "pos int, p_partkey long").groupBy("p_partkey").agg(F.min("pos").alias("pos")))
    return table(spark, sf_dir, "part").join(p, "p_partkey").select("pos", "p_partkey", "p_name")


def p3_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row verdict: fail over review over ok, with the reasons; headings are left alone."""
    li = table(spark, sf_dir, "lineitem")
    axes = {
        "price": F.when(F.col("l_extendedprice") > 90000, "fail").when(F.col("l_extendedprice") > 60000, "review").otherwise("ok"),
        "tax": F.when(F.col("l_tax") > 0.07, "review").when(F.col("l_tax") == 0, None).otherwise("ok"),
        "flag": F.when(F.col("l_returnflag") == "A", "fail").otherwise("ok"),
    }
    found = F.filter(F.array(*[F.struct(F.lit(n).alias("axis"), F.coalesce(v, F.lit("not_applicable")).alias("v")) for n, v in axes.items()]), lambda x: ~x["v"].isin("ok", "not_applicable"))
    rows = li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", found.alias("found"))
    worst = F.when(F.exists("found", lambda x: x["v"] == "fail"), "fail").when(F.size("found") > 0, "review").otherwise("ok")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", worst.alias("verdict"), F.array_join(F.transform("found", lambda x: x["axis"]), ",").alias("reasons"))


def u1_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two kinds of rows one after the other with a running position for each order."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    a = li.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("k"), F.lit(0).alias("kind"), F.col("l_linenumber").alias("spot"), F.col("l_partkey").alias("ref"))
    b = o.where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("k"), F.lit(1).alias("kind"), F.lit(0).alias("spot"), F.col("o_custkey").alias("ref"))
    w = Window.partitionBy("k").orderBy("kind", "spot", "ref")
    return a.unionByName(b).select("k", "kind", "spot", "ref", F.row_number().over(w).alias("pos"))


def u3_set_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set equality, union, difference of two arrays a customer has."""
    o = table(spark, sf_dir, "orders")
    g = o.groupBy("o_custkey").agg(F.collect_set(F.when(F.col("o_orderstatus") != "P", F.substring("o_orderpriority", 1, 1))).alias("a"), F.collect_set(F.when(F.col("o_orderstatus") == "F", F.substring("o_orderpriority", 1, 1))).alias("b"))
    text = lambda c: F.array_join(F.array_sort(c), ",")
    return g.select("o_custkey", (text("a") == text("b")).alias("same"), text(F.array_union("a", "b")).alias("both"), text(F.array_except("a", "b")).alias("only_a"))


QUERIES = {f.__name__: f for f in (a1_order_totals, a1_nested_items, a4_monthly, a8_cross_tab, a11_progress, a14_mode, a23_percentiles, j1_names, j2_nested_lines, j4_with_orders, f17_exactly_one, j8_latest, j12_unique_match, o7_top3, s18_picked, p3_verdicts, u1_union, u3_set_changes)}
SQL = {
    "a1_order_totals": "SELECT o_orderkey, coalesce(sum(l_quantity::DECIMAL(18,2)), 0)::DOUBLE AS qty, coalesce(sum(l_extendedprice::DECIMAL(18,2)), 0)::DOUBLE AS price, coalesce(sum(l_tax::DECIMAL(18,2)), 0)::DOUBLE AS tax, coalesce(sum(l_quantity::DECIMAL(18,2) + l_extendedprice::DECIMAL(18,2) + l_tax::DECIMAL(18,2)), 0)::DOUBLE AS grand, count(l_orderkey) AS n_lines FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey",
    "a1_nested_items": "SELECT l_orderkey, sum(CASE WHEN l_returnflag = 'A' THEN 0 ELSE l_quantity END) AS total, count(*)::INTEGER AS n FROM lineitem GROUP BY 1",
    "a4_monthly": "SELECT strftime(o_orderdate, '%Y-%m') AS month, (sum(o_totalprice::DECIMAL(18,2)) FILTER (o_orderstatus = 'F'))::DOUBLE AS total_f, count(*) FILTER (o_orderstatus = 'O') AS n_open, count(*) AS n, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS latest FROM orders GROUP BY 1",
    "a8_cross_tab": "SELECT coalesce(o_orderpriority, 'TOTAL') AS grp, count(*) FILTER (o_orderstatus = 'F') AS n_f, count(*) FILTER (o_orderstatus = 'O') AS n_o, count(*) FILTER (o_orderstatus = 'P') AS n_p, count(*) FILTER (o_orderstatus = 'X') AS n_x, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderpriority), ())",
    "a11_progress": "WITH g AS (SELECT user_id, count(*) FILTER (event_type <> 'error' AND value > 10) AS checked, count(*) FILTER (event_type <> 'error') AS total, coalesce(bool_and(value > 1) FILTER (event_type <> 'error'), false) AS decided FROM events GROUP BY 1) SELECT user_id, checked, total, CASE WHEN total = 0 THEN 0 ELSE floor(100.0 * checked / total + 0.5) END::INTEGER AS percent, decided, CASE WHEN checked = total THEN 'done' WHEN checked > 0 THEN 'doing' ELSE 'todo' END AS step FROM g",
    "a14_mode": "WITH n AS (SELECT p_brand, p_size, count(*) AS c FROM part GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY c DESC, p_size) AS k, count(*) OVER (PARTITION BY p_brand) AS n_sizes FROM n) SELECT p_brand, p_size AS mode, n_sizes FROM r WHERE k = 1",
    "a23_percentiles": "WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) SELECT event_type, max(value) FILTER (i = least(floor(n * 0.5), n - 1)) AS p50, max(value) FILTER (i = least(floor(n * 0.9), n - 1)) AS p90, max(value) AS most FROM r GROUP BY 1",
    "j1_names": "SELECT c_custkey, coalesce(n_name, 'system') AS actor FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey AND n_nationkey % 2 = 0",
    "j2_nested_lines": "WITH l AS (SELECT l_orderkey, string_agg(l_linenumber || ':' || l_partkey, ' ' ORDER BY l_linenumber, l_partkey) AS lines FROM lineitem GROUP BY 1) SELECT o_orderkey, coalesce(lines, '') AS lines FROM orders LEFT JOIN l ON o_orderkey = l_orderkey",
    "j4_with_orders": "SELECT c_custkey, CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000) THEN 'some' ELSE 'none' END AS kind FROM customer",
    "f17_exactly_one": "SELECT n_name, (SELECT min(s_suppkey) FROM supplier WHERE s_nationkey = n_nationkey) AS s_suppkey FROM nation WHERE (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) = 1 AND NOT EXISTS (SELECT 1 FROM customer WHERE c_acctbal > 1e9)",
    "j8_latest": "WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k, max(ts) OVER (PARTITION BY user_id) AS seen, count(*) FILTER (event_type = 'error') OVER (PARTITION BY user_id) AS n_errors FROM events) SELECT user_id, event_id, event_type, value, seen, n_errors FROM r WHERE k = 1",
    "j12_unique_match": "WITH a AS (SELECT unnest(['small ring', 'small', 'purple w', 'zzz', 'blue widget']) AS ask), p AS (SELECT DISTINCT p_name FROM part) SELECT ask, CASE WHEN ask IN (SELECT p_name FROM p) THEN ask WHEN (SELECT count(*) FROM p WHERE contains(p_name, ask)) = 1 THEN (SELECT min(p_name) FROM p WHERE contains(p_name, ask)) END AS found FROM a",
    "o7_top3": "WITH r AS (SELECT l_suppkey, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_returnflag <> 'R', l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey)::INTEGER AS place FROM lineitem) SELECT * FROM r WHERE place <= 3",
    "s18_picked": "SELECT (list_position([7, 3, 900, 3, 12, 7, 100000], p_partkey) - 1)::INTEGER AS pos, p_partkey, p_name FROM part WHERE p_partkey IN (7, 3, 900, 12, 100000)",
    "p3_verdicts": "WITH a AS (SELECT *, CASE WHEN l_extendedprice > 90000 THEN 'fail' WHEN l_extendedprice > 60000 THEN 'review' ELSE 'ok' END AS p, CASE WHEN l_tax > 0.07 THEN 'review' ELSE 'ok' END AS t, CASE WHEN l_returnflag = 'A' THEN 'fail' ELSE 'ok' END AS f FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN 'fail' IN (p, t, f) THEN 'fail' WHEN 'review' IN (p, t, f) THEN 'review' ELSE 'ok' END AS verdict, concat_ws(',', CASE WHEN p <> 'ok' THEN 'price' END, CASE WHEN t <> 'ok' THEN 'tax' END, CASE WHEN f <> 'ok' THEN 'flag' END) AS reasons FROM a",
    "u1_union": "WITH u AS (SELECT l_orderkey AS k, 0 AS kind, l_linenumber AS spot, l_partkey AS ref FROM lineitem WHERE l_returnflag = 'R' UNION ALL SELECT o_orderkey, 1, 0, o_custkey FROM orders WHERE o_orderstatus = 'P') SELECT *, row_number() OVER (PARTITION BY k ORDER BY kind, spot, ref)::INTEGER AS pos FROM u",
    "u3_set_changes": "WITH g AS (SELECT o_custkey, coalesce(list_sort(list(DISTINCT substr(o_orderpriority, 1, 1)) FILTER (o_orderstatus <> 'P')), []) AS a, coalesce(list_sort(list(DISTINCT substr(o_orderpriority, 1, 1)) FILTER (o_orderstatus = 'F')), []) AS b FROM orders GROUP BY 1) SELECT o_custkey, a = b AS same, array_to_string(list_sort(list_distinct(list_concat(a, b))), ',') AS both, array_to_string(list_filter(a, lambda x: NOT list_contains(b, x)), ',') AS only_a FROM g",
}
