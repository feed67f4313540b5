"""Row-wise derivations, paths, terms and labels (P*, T*, S5, S12, F13, F20, J7, J13, A16, A20, A27, V5)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from .search import contains_ci, table


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A crawl-like path for each part."""
    p = table(spark, sf_dir, "part")
    tail = F.when(F.col("p_partkey") % 5 == 0, " attachment").when(F.col("p_partkey") % 7 == 0, " PO").otherwise("")
    code = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("/AB-"), 100 + F.col("p_partkey") % 90, F.lit(" job"))).otherwise("/misc")
    return p.select("p_partkey", F.concat(F.lit("/share/"), F.col("p_type"), code, F.lit("/offer XYZ "), 200 + F.col("p_partkey") % 50, tail, F.lit(".pdf")).alias("path"))


def project_code(path):
    """The code nearest above the file, folder by folder, and the file's own last; PO is no code."""
    seg = F.split(path, "/")
    order = F.concat(F.reverse(F.slice(seg, F.lit(1), F.size(seg) - 1)), F.slice(seg, -1, 1))
    pattern = r"(?<![A-Za-z])([A-Za-z]{2,6}[ -]?\d{3})(?!\d)"
    codes = F.flatten(F.transform(order, lambda s: F.regexp_extract_all(s, F.lit(pattern), 1)))
    plain = F.transform(codes, lambda c: F.upper(F.regexp_replace(c, "[ -]", "")))
    return F.get(F.filter(plain, lambda c: ~c.rlike(r"^PO\d")), 0)


def is_excluded(path):
    name = F.element_at(F.split(path, "/"), -1)
    return F.lower(name).rlike("attachment|appendix") | name.rlike("(?i)(?<![A-Za-z])PO(?![A-Za-z])")


def s5_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crawled paths grouped by project code and kind; codes that only excluded files name."""
    rows = _paths(spark, sf_dir).select("p_partkey", "path", project_code(F.col("path")).alias("code"), is_excluded(F.col("path")).alias("out"))
    g = rows.where("code IS NOT NULL").groupBy("code")
    return g.agg(F.count_if(~F.col("out")).alias("n_files"), F.count_if("out").alias("n_excluded"), F.min_by(F.element_at(F.split("path", "/"), 3), "p_partkey").alias("client"), F.bool_and("out").alias("only_excluded"))


def t2_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts to dictionary terms: an exact one, else those that contain it, else none (T2); prefix of a word."""
    terms = table(spark, sf_dir, "part").select(F.lower("p_name").alias("term")).distinct()
    asked = F.broadcast(spark.createDataFrame([("small ring",), ("ring",), ("pur",), ("zz",), ("blue w",)], "ask string"))
    exact = asked.join(terms, F.col("ask") == F.col("term"), "left_semi")
    near = asked.join(exact, "ask", "left_anti").join(terms, F.contains(F.col("term"), F.col("ask")))
    prefix = terms.join(asked, F.exists(F.split("term", "[^a-z0-9]+"), lambda w: F.startswith(w, F.col("ask"))))
    return exact.select("ask", F.col("ask").alias("term"), F.lit("exact").alias("how")).unionByName(near.select("ask", "term", F.lit("part").alias("how"))).unionByName(prefix.select("ask", "term", F.lit("prefix").alias("how")))


def t10_unique_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal titles get ' (n)' from the second on, within 24 characters."""
    p = table(spark, sf_dir, "part").withColumn("k", S.title_key(F.col("p_name")))
    n = F.row_number().over(Window.partitionBy("k").orderBy("p_partkey"))
    tail = F.concat(F.lit(" ("), n, F.lit(")"))
    return p.select("p_partkey", F.when(n == 1, F.substring("p_name", 1, 24)).otherwise(F.concat(F.expr("p_name").substr(F.lit(1), 24 - F.length(tail)), tail)).alias("title"))


def t20_doubled_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A word of three letters or more twice in a row (T20); style by letters (T21); labels like 5.3.1."""
    d = table(spark, sf_dir, "documents")
    thai, latin = F.length(F.regexp_replace("text", "[^\\u0E00-\\u0E7F]", "")), F.length(F.regexp_replace("text", "[^A-Za-z]", ""))
    return d.select("doc_id", F.col("text").rlike(r"(?<![a-z])([a-z]{3,}) \1(?![a-z])").alias("doubled"), F.when(thai >= latin, "thai").otherwise("english").alias("style"), F.size(F.regexp_extract_all("text", F.lit(r"(?<![0-9.])(\d+(?:\.\d+)+)(?![0-9])"), 1)).alias("n_labels"))


def t24_citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A citation text split into its parts; a part that names only pages belongs to the name before it."""
    p = table(spark, sf_dir, "part")
    text = F.concat(F.lit("01 - "), "p_name", F.lit(".pdf page "), F.col("p_size"), F.lit("; page "), F.col("p_size") + 2, F.lit("; "), "p_type", F.lit(".pdf"))
    parts = p.select("p_partkey", F.posexplode(F.split(text, r"[;\n]")).alias("pos", "part")).withColumn("part", F.trim("part"))
    name = F.regexp_extract("part", r"^(?:\d+ - )?(.+?)\.pdf", 1)
    w = Window.partitionBy("p_partkey").orderBy("pos")
    named = parts.withColumn("name", F.last(F.nullif(name, F.lit("")), ignorenulls=True).over(w))
    return named.groupBy("p_partkey", "name").agg(F.min("pos").alias("first"), F.sort_array(F.collect_list(F.struct("pos", "part"))).alias("c")).select("p_partkey", "name", "first", F.size("c").alias("n_parts"))


def p1_card_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text forms of decimals and days, range text, labels with a fallback."""
    o = table(spark, sf_dir, "orders")
    labels = F.create_map(*[F.lit(x) for kv in (("F", "finished"), ("O", "open")) for x in kv])
    low, high = F.when(F.col("o_orderkey") % 3 != 0, F.year("o_orderdate")), F.when(F.col("o_orderkey") % 2 == 0, F.year("o_orderdate") + 2)
    span = F.when(low.isNotNull() & high.isNotNull(), F.concat_ws("–", low, high)).when(low.isNotNull(), F.concat(F.lit("from "), low)).when(high.isNotNull(), F.concat(F.lit("to "), high))
    return o.select("o_orderkey", F.col("o_totalprice").cast("decimal(15,2)").cast("string").alias("price"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.coalesce(F.get(F.map_values(F.map_filter(labels, lambda k, _: k == F.col("o_orderstatus"))), 0), F.col("o_orderstatus")).alias("label"), span.alias("span"), F.substring("o_orderpriority", 1, 5).alias("short"))


def p8_relative_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.datediff(F.to_date(F.lit("2024-01-05")), F.col("ts").cast("date"))
    return table(spark, sf_dir, "events").select("event_id", F.when(day == 0, "today").when(day == 1, "yesterday").when(day < 7, F.concat(day, F.lit(" days ago"))).otherwise(F.date_format("ts", "yyyy-MM-dd")).alias("label"))


def j7_update_from(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = F.broadcast(spark.createDataFrame([("ECONOMY", "eco"), ("PROMO", "promo,sale")], "p_type string, synonyms string"))
    return table(spark, sf_dir, "part").join(values, "p_type", "left").select("p_partkey", F.coalesce("synonyms", F.lower("p_type")).alias("synonyms"))


def j13_deepest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The deepest section that a dotted number lies in: its prefixes meet the sections, the longest wins."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").distinct()
    number = F.concat_ws(".", F.col("l_partkey") % 5, F.col("l_linenumber"), F.col("l_partkey") % 3)
    sections = spark.createDataFrame([("1",), ("1.2",), ("1.2.0",), ("3",), ("4.1",)], "section string")
    parts = li.withColumn("s", F.split(number, r"\."))
    prefixes = parts.select("l_orderkey", "l_linenumber", "l_partkey", F.explode(F.sequence(F.lit(1), F.size("s"))).alias("depth"), "s").withColumn("section", F.array_join(F.slice("s", F.lit(1), F.col("depth")), "."))
    hit = prefixes.join(F.broadcast(sections), "section").groupBy("l_orderkey", "l_linenumber", "l_partkey").agg(F.max_by("section", "depth").alias("section"))
    return li.join(hit, ["l_orderkey", "l_linenumber", "l_partkey"], "left")


def f13_visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows a person may see: their own or imported ones; levels of access."""
    o = table(spark, sf_dir, "orders")
    levels = F.array(*map(F.lit, ("5-LOW", "4-NOT SPECIFIED", "3-MEDIUM", "2-HIGH", "1-URGENT")))
    enough = F.array_position(levels, F.col("o_orderpriority")) >= F.array_position(levels, F.lit("3-MEDIUM"))
    return o.where((F.col("o_custkey") == 7) | ((F.col("o_orderstatus") == "P") & enough)).select("o_orderkey", "o_custkey")


def a16_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts over several tables, a table at a time."""
    def one(name, **conds):
        return table(spark, sf_dir, name).agg(*[F.count_if(F.expr(c)).alias(k) for k, c in conds.items()])

    frames = [one("customer", users="true", live="c_acctbal >= 0"), one("orders", found="o_orderstatus <> 'P'", undecided="o_orderstatus = 'P'"), one("events", last_day="ts >= timestamp'2024-01-04'")]
    return reduce(lambda a, b: a.join(b, F.lit(True)), [F.broadcast(f) for f in frames])


def s12_cached_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Wanted cells that a cache log doesn't hold yet; the last entry of a key counts.

    Wanted are the first 200 cells, every cell of the log and its two neighbours."""
    e = table(spark, sf_dir, "events")
    cache = e.groupBy(F.col("user_id").alias("cell")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("text")).where("text <> 'error'")
    near = e.select("user_id").distinct().select(F.explode(F.sequence(F.col("user_id") - 1, F.col("user_id") + 1)).alias("cell")).where("cell >= 0")
    wanted = spark.range(0, 200).select(F.col("id").alias("cell")).unionByName(near).distinct()
    return wanted.join(cache, "cell", "left_anti").where(~contains_ci(F.col("cell").cast("string"), "99"))


QUERIES = {f.__name__: f for f in (s5_projects, t2_terms, t10_unique_titles, t20_doubled_words, t24_citations, p1_card_rows, p8_relative_days, j7_update_from, j13_deepest, f13_visible, a16_counts, s12_cached_cells)}
SQL = {
    "s5_projects": "WITH r AS (SELECT p_partkey, p_type, CASE WHEN p_partkey % 3 = 0 THEN 'AB' || (100 + p_partkey % 90) ELSE 'XYZ' || (200 + p_partkey % 50) END AS code, p_partkey % 5 = 0 OR p_partkey % 7 = 0 AS x FROM part) SELECT code, count(*) FILTER (NOT x) AS n_files, count(*) FILTER (x) AS n_excluded, arg_min(p_type, p_partkey) AS client, bool_and(x) AS only_excluded FROM r GROUP BY 1",
    "t2_terms": "WITH a AS (SELECT unnest(['small ring', 'ring', 'pur', 'zz', 'blue w']) AS ask), t AS (SELECT DISTINCT lower(p_name) AS term FROM part) SELECT ask, ask AS term, 'exact' AS how FROM a WHERE ask IN (SELECT term FROM t) UNION ALL SELECT ask, term, 'part' FROM a, t WHERE ask NOT IN (SELECT term FROM t) AND contains(term, ask) UNION ALL SELECT ask, term, 'prefix' FROM a, t WHERE len(list_filter(regexp_split_to_array(term, '[^a-z0-9]+'), lambda w: starts_with(w, ask))) > 0",
    "t10_unique_titles": "WITH n AS (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY lower(trim(regexp_replace(p_name, '\\s+', ' ', 'g'))) ORDER BY p_partkey) AS n FROM part) SELECT p_partkey, CASE WHEN n = 1 THEN p_name[1:24] ELSE substr(p_name, 1, 24 - length(' (' || n || ')')) || ' (' || n || ')' END AS title FROM n",
    "p1_card_rows": "WITH o AS (SELECT *, CASE WHEN o_orderkey % 3 <> 0 THEN year(o_orderdate) END AS lo, CASE WHEN o_orderkey % 2 = 0 THEN year(o_orderdate) + 2 END AS hi FROM orders) SELECT o_orderkey, o_totalprice::DECIMAL(15,2)::VARCHAR AS price, strftime(o_orderdate, '%Y-%m-%d') AS day, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' ELSE o_orderstatus END AS label, CASE WHEN lo IS NOT NULL AND hi IS NOT NULL THEN lo || '–' || hi WHEN lo IS NOT NULL THEN 'from ' || lo WHEN hi IS NOT NULL THEN 'to ' || hi END AS span, o_orderpriority[1:5] AS short FROM o",
    "p8_relative_days": "WITH d AS (SELECT event_id, ts, DATE '2024-01-05' - ts::DATE AS d FROM events) SELECT event_id, CASE WHEN d = 0 THEN 'today' WHEN d = 1 THEN 'yesterday' WHEN d < 7 THEN d || ' days ago' ELSE strftime(ts, '%Y-%m-%d') END AS label FROM d",
    "j7_update_from": "SELECT p_partkey, coalesce(s, lower(p.p_type)) AS synonyms FROM part p LEFT JOIN (VALUES ('ECONOMY', 'eco'), ('PROMO', 'promo,sale')) v(t, s) ON p.p_type = v.t",
    "j13_deepest": "WITH l AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, (l_partkey % 5) || '.' || l_linenumber || '.' || (l_partkey % 3) AS n FROM lineitem), s AS (SELECT unnest(['1', '1.2', '1.2.0', '3', '4.1']) AS section) SELECT l_orderkey, l_linenumber, l_partkey, (SELECT arg_max(section, length(section)) FROM s WHERE n = section OR starts_with(n, section || '.')) AS section FROM l",
    "f13_visible": "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey = 7 OR (o_orderstatus = 'P' AND o_orderpriority IN ('3-MEDIUM', '2-HIGH', '1-URGENT'))",
    "a16_counts": "SELECT (SELECT count(*) FROM customer) AS users, (SELECT count(*) FROM customer WHERE c_acctbal >= 0) AS live, (SELECT count(*) FROM orders WHERE o_orderstatus <> 'P') AS found, (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') AS undecided, (SELECT count(*) FROM events WHERE ts >= TIMESTAMP '2024-01-04') AS last_day",
    "s12_cached_cells": "WITH c AS (SELECT user_id, arg_max(event_type, (ts, event_id)) AS t FROM events GROUP BY 1), w AS (SELECT range AS cell FROM range(200) UNION SELECT user_id + d FROM (SELECT DISTINCT user_id FROM events), (VALUES (-1), (0), (1)) v(d)) SELECT cell FROM w WHERE cell >= 0 AND cell NOT IN (SELECT user_id FROM c WHERE t <> 'error') AND NOT contains(cell::VARCHAR, '99')",
    "t24_citations": "SELECT p_partkey, p_name AS name, 0 AS first, 2 AS n_parts FROM part UNION ALL SELECT p_partkey, p_type, 2, 1 FROM part",
}
