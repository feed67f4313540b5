"""Scalar functions over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from .search import table


def m1_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    text = F.when(F.col("c_custkey") % 4 == 0, "").when(F.col("c_custkey") % 4 == 1, F.concat(F.col("c_custkey"), F.lit("abc"))).when(F.col("c_custkey") % 4 == 2, F.concat(F.lit(" -"), F.col("c_custkey"), F.lit(".5x"))).otherwise(F.concat(F.col("c_custkey"), F.lit(",000")))
    return c.select("c_custkey", text.alias("txt")).select("c_custkey", S.number(F.col("txt")).alias("num"), S.number_or_null(F.col("txt")).alias("num_or_null"), (S.half_up(S.number(F.col("txt")) / 7, 100)).alias("cents"))


M1 = r"""WITH t AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '' WHEN 1 THEN c_custkey || 'abc' WHEN 2 THEN ' -' || c_custkey || '.5x' ELSE c_custkey || ',000' END AS txt FROM customer),
n AS (SELECT c_custkey, try_cast(regexp_extract(txt, '^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)', 1) AS DOUBLE) AS x FROM t)
SELECT c_custkey, coalesce(x, 0) AS num, x AS num_or_null, floor(coalesce(x, 0) / 7 * 100 + 0.5) / 100 AS cents FROM n"""


def d1_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    day = F.col("o_orderdate").cast("date")
    raw = F.when(F.col("o_orderkey") % 3 == 0, F.lit("2023-02-29")).when(F.col("o_orderkey") % 3 == 1, F.date_format(F.date_add(day, 3000), "yyyy-MM-dd")).otherwise(F.date_format(day, "d/M/yyyy"))
    parts = S.split_day(raw)
    return o.select("o_orderkey", S.strict_date(raw).alias("strict"), S.years_back(F.make_date(F.lit(2024), F.lit(2), F.lit(29)), (F.col("o_orderkey") % 5).cast("int")).alias("back"), S.common_era(F.year(day) + F.when(F.col("o_orderkey") % 2 == 0, 543).otherwise(0)).alias("ce"), (F.year(day) + 543).alias("be"), S.bangkok_day(F.col("o_orderdate") + F.expr("interval 18 hours")).alias("bkk"), parts["day"].alias("d"), parts["month"].alias("m"), parts["year"].alias("y"))


D1 = r"""WITH t AS (SELECT o_orderkey, o_orderdate::DATE AS day, o_orderdate AS ts, CASE o_orderkey % 3 WHEN 0 THEN '2023-02-29' WHEN 1 THEN strftime(o_orderdate::DATE + 3000, '%Y-%m-%d') ELSE strftime(o_orderdate, '%-d/%-m/%Y') END AS raw FROM orders)
SELECT o_orderkey, CASE WHEN regexp_full_match(raw, '\d{4}-\d{2}-\d{2}') AND year(try_cast(raw AS DATE)) BETWEEN 2000 AND 2100 THEN try_cast(raw AS DATE) END AS strict,
  make_date(2024 - (o_orderkey % 5), 2, 1) + 28 AS back, year(day)::INTEGER AS ce, (year(day) + 543)::INTEGER AS be, (ts + INTERVAL 25 HOURS)::DATE AS bkk,
  CASE WHEN raw LIKE '%/%' THEN split_part(raw, '/', 1) ELSE split_part(raw, '-', 3) END::INTEGER AS d,
  CASE WHEN raw LIKE '%/%' THEN split_part(raw, '/', 2) ELSE split_part(raw, '-', 2) END::INTEGER AS m,
  CASE WHEN raw LIKE '%/%' THEN split_part(raw, '/', 3) ELSE split_part(raw, '-', 1) END::INTEGER AS y FROM t"""


def t1_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    raw = F.concat(F.lit("  "), F.upper("p_name"), F.lit("   "), F.col("p_brand"), F.lit(" ๒๕"), F.col("p_size"))
    v = F.concat(F.lit("v"), F.col("p_size"), F.lit("."), F.col("p_partkey") % 10)
    path = F.concat(F.col("p_size"), F.lit("."), F.col("p_partkey") % 7, F.lit("."))
    return p.select(
        "p_partkey", S.title_key(raw).alias("title"), S.slug(raw).alias("slug"), S.arabic_digits(raw).alias("digits"), S.is_thai(raw).alias("thai"),
        F.array_join(S.version_key(v), ".").alias("version"), F.array_join(S.item_path(path), "/").alias("path"), S.is_inside(S.item_path(path), F.array(F.col("p_size"))).alias("inside"),
        F.array_join(F.array_sort(S.value_tokens(F.concat_ws(" ", "p_name", "p_type", "p_partkey"), ("ring",))), ",").alias("tokens"), S.named_in(F.col("p_name"), "ring").alias("named"),
    )


T1 = r"""WITH t AS (SELECT *, '  ' || upper(p_name) || '   ' || p_brand || ' ๒๕' || p_size AS raw, lower(p_name || ' ' || p_type || ' ' || p_partkey) AS w FROM part)
SELECT p_partkey, lower(trim(regexp_replace(raw, '\s+', ' ', 'g'))) AS title, regexp_replace(regexp_replace(lower(raw), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')[1:60] AS slug,
  translate(raw, '๐๑๒๓๔๕๖๗๘๙', '0123456789') AS digits, true AS thai, p_size || '.' || p_partkey % 10 || '.0' AS version, p_size || '/' || p_partkey % 7 AS path, true AS inside,
  array_to_string(list_sort(list_filter(list_distinct(list_concat(regexp_extract_all(w, '\d[\d.,]*\d'), regexp_extract_all(w, '[a-z]{4,}'))), lambda x: x <> 'ring')), ',') AS tokens,
  regexp_matches(lower(p_name), '(^|[^a-z0-9])ring($|[^a-z0-9])') AS named FROM t"""


def t13_page_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").distinct()
    text = F.concat(F.lit("see page "), F.col("l_linenumber") + 1, F.lit(", "), F.col("l_linenumber"), F.lit(" and "), F.col("l_partkey") % 9 + 1, F.lit("-"), F.col("l_partkey") % 9 + F.col("l_linenumber"))
    rows = li.select("l_orderkey", "l_linenumber", "l_partkey", text.alias("t"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", *[F.array_join(S.page_list(F.col("t"), most, span, order), ",").alias(n) for n, most, span, order in (("review", 5000, 50, False), ("cited", 100_000, 1000, True), ("worker", 100_000, 3, True))])


T13 = """WITH t AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_partkey % 9 + 1 AS a, l_partkey % 9 + l_linenumber AS b FROM lineitem),
r AS (SELECT *, list_concat([l_linenumber + 1, l_linenumber], range(a, b + 1)) AS p, list_concat([l_linenumber + 1, l_linenumber], CASE WHEN b - a <= 3 THEN range(a, b + 1) ELSE [] END) AS q FROM t)
SELECT l_orderkey, l_linenumber, l_partkey, array_to_string(list_filter(p, lambda x, i: list_position(p, x) = i), ',') AS review, array_to_string(list_sort(list_distinct(p)), ',') AS cited, array_to_string(list_sort(list_distinct(q)), ',') AS worker FROM r"""


def p14_fares(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    # Fixed values of the tariff: from km, to km, price a km
    tiers = [(1.0, 10.0, 6.5), (10.0, 20.0, 7.0), (20.0, 40.0, 8.0), (40.0, 60.0, 8.5), (60.0, 80.0, 9.0), (80.0, None, 10.5)]
    price = S.fare(F.col("l_quantity") * 2, F.col("l_tax") * 100, tiers, 35.0, 3.0, F.when(F.col("l_returnflag") == "R", 50.0).otherwise(0.0))
    return li.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", price.alias("price"), S.money(F.floor(price) * (F.col("l_linenumber") % 2), 0).alias("shown"))


P14 = """WITH t AS (SELECT *, l_quantity * 2 AS km FROM lineitem), u AS (SELECT *, floor((35 + l_tax * 100 * 3 + greatest(0, least(km, 10) - 1) * 6.5 + greatest(0, least(km, 20) - 10) * 7.0 + greatest(0, least(km, 40) - 20) * 8.0
 + greatest(0, least(km, 60) - 40) * 8.5 + greatest(0, least(km, 80) - 60) * 9.0 + greatest(0, km - 80) * 10.5 + CASE WHEN l_returnflag = 'R' THEN 50 ELSE 0 END)::DOUBLE * 100 + 0.5) / 100 AS price FROM t)
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, price, CASE WHEN l_linenumber % 2 = 0 THEN '-' ELSE format('{:,}', floor(price)::BIGINT) END AS shown FROM u"""

QUERIES = {"m1_numbers": m1_numbers, "d1_dates": d1_dates, "t1_texts": t1_texts, "t13_page_lists": t13_page_lists, "p14_fares": p14_fares}
SQL = {"m1_numbers": M1, "d1_dates": D1, "t1_texts": T1, "t13_page_lists": T13, "p14_fares": P14}
