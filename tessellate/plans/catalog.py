"""Catalog search: filters, facets, sorts and query relaxation (F*, A5-A7, O*, W9, K11, J9)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators.places import global_places
from .search import contains_ci, table


def names_client(client: Column, name: str) -> Column:
    """The client's whole name, or its name before or inside brackets; never a mere substring."""
    c, n = F.lower(client), name.lower()
    return (c == n) | F.startswith(c, F.lit(n + " (")) | F.endswith(c, F.lit("(" + n + ")"))


def split_client(client: Column) -> Column:
    """'OWNER (CONTRACTOR)' to both names."""
    pattern = r"^(.+?) \((.+)\)$"
    return F.when(client.rlike(pattern), F.array(F.regexp_extract(client, pattern, 1), F.regexp_extract(client, pattern, 2))).otherwise(F.array(client))


def _clients(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    return s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.when(F.col("s_suppkey") % 3 == 0, F.col("n_name")).otherwise(F.concat("n_name", F.lit(" (MAKER_"), F.col("s_suppkey") % 4, F.lit(")"))).alias("client"))


def f4_client_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _clients(spark, sf_dir)
    return c.where(names_client(F.col("client"), "nation_1") | names_client(F.col("client"), "maker_2"))


def a6_client_facet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _clients(spark, sf_dir).select(F.explode(split_client(F.col("client"))).alias("name")).groupBy("name").agg(F.count("*").alias("n"))


CLIENTS = "WITH c AS (SELECT s_suppkey, CASE WHEN s_suppkey % 3 = 0 THEN n_name ELSE n_name || ' (MAKER_' || s_suppkey % 4 || ')' END AS client FROM supplier JOIN nation ON s_nationkey = n_nationkey)"


def _tagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row an order with its distinct return flags as tags and its priority as main category."""
    tags = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_returnflag")).alias("tags"))
    return table(spark, sf_dir, "orders").join(tags, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", "o_orderstatus", "o_orderdate", "o_totalprice", F.coalesce("tags", F.array().cast("array<string>")).alias("tags"))


TAGGED = "WITH g AS (SELECT o_orderkey, any_value(o_orderstatus) AS o_orderstatus, any_value(o_orderdate) AS o_orderdate, any_value(o_totalprice) AS o_totalprice, coalesce(list_sort(list(DISTINCT l_returnflag) FILTER (l_returnflag IS NOT NULL)), []) AS tags FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey)"


def f5_tag_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main column or array member; any overlap."""
    o = _tagged(spark, sf_dir)
    wanted = F.array(F.lit("R"), F.lit("A"))
    return o.where((F.col("o_orderstatus") == "O") | F.arrays_overlap("tags", wanted)).where(~F.array_contains("tags", "N")).select("o_orderkey", F.array_join("tags", ",").alias("tags"))


def a7_zero_filled_facet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct status and tags of an order count once each; terms without an order count 0."""
    o = _tagged(spark, sf_dir)
    counts = o.select(F.explode(F.array_distinct(F.array_union(F.array("o_orderstatus"), "tags"))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    terms = spark.createDataFrame([(t,) for t in ("A", "F", "N", "O", "P", "R", "X")], "term string")
    return F.broadcast(terms).join(counts, "term", "left").select("term", F.coalesce("n", F.lit(0)).alias("n"))


def f9_newer_than(spark: SparkSession, sf_dir: str) -> DataFrame:
    since = S.years_back(F.to_date(F.lit("2000-02-29")), 1)
    return table(spark, sf_dir, "orders").where(F.col("o_orderdate").cast("date") >= since).select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"))


def f11_haystack(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    month, year = F.month("o_orderdate"), F.year("o_orderdate")
    hay = F.concat_ws(" ", "o_orderpriority", "o_orderkey", month, year, F.concat(month, F.lit("/"), year))
    rows = o.where((F.col("o_orderstatus") == "F") & contains_ci(hay, "7 1997 7/1997")).withColumn("month", month)
    return global_places(rows.select("o_orderkey", "month", "o_totalprice"), F.col("month"), F.col("o_totalprice"), F.col("o_orderkey")).drop("o_totalprice")


def o2_null_last_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descending by a key with nulls last, ties by year (newest first, nulls last) and code; the place is a column."""
    c = table(spark, sf_dir, "customer").withColumn("budget", F.when(F.col("c_custkey") % 5 != 0, F.floor("c_acctbal").cast("long"))).withColumn("yr", F.when(F.col("c_custkey") % 7 != 0, (F.col("c_custkey") % 11).cast("int")))
    return global_places(c.select("c_custkey", "budget", "yr"), F.col("budget").isNull(), F.desc("budget"), F.desc_nulls_last("yr"), F.col("c_custkey"))


def w9_main_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose main category is asked for come first; the order is kept inside each half."""
    p = table(spark, sf_dir, "part").where((F.col("p_type") == "ECONOMY") | contains_ci(F.col("p_name"), "ring"))
    rows = p.select("p_partkey", "p_size", F.when(F.col("p_type") == "ECONOMY", 0).otherwise(1).alias("half"))
    return global_places(rows, F.col("half"), F.desc("p_size"), F.col("p_partkey")).select("p_partkey", "place")


def relax(rows: DataFrame, tries: list[tuple[str, Column]]) -> DataFrame:
    """One pass: counts of all tries, the first one that finds a row wins (none: no row)."""
    counts = rows.agg(*[F.count_if(c).alias(f"t{k}") for k, (_, c) in enumerate(tries)])
    found = F.filter(F.array(*[F.struct(F.lit(k).alias("try"), F.lit(n).alias("name"), F.col(f"t{k}").alias("n")) for k, (n, _) in enumerate(tries)]), lambda x: x["n"] > 0)
    return counts.select(F.get(found, 0).alias("f")).where("f IS NOT NULL").select("f.*")


#: Thai vowel and tone marks, which stand on another letter; the fewest letters of a Thai run.
THAI_MARKS = re.compile("[\u0e31\u0e34-\u0e3a\u0e47-\u0e4e]")
THAI_LEAST = 4


def runs_of_words(query: str, least: int = 3, most: int = 8, generic: tuple[str, ...] = ()) -> list[str]:
    """Contiguous word runs shorter than the whole, longest first, then as they stand.

    A run that is a generic word or too short is left out; Thai counts letters without marks. Words end at white space."""
    words = query.split()
    runs = dict.fromkeys(" ".join(words[i:j]) for i in range(len(words)) for j in range(i + 1, len(words) + 1) if j - i < len(words))
    thai = re.compile("[\u0e00-\u0e7f]")
    enough = lambda r: len(THAI_MARKS.sub("", r)) >= THAI_LEAST if thai.search(r) else len(r) >= least
    return sorted((r for r in runs if enough(r) and r.lower() not in generic), key=lambda r: -len(r))[:most]


def k11_relaxation(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    tries = [(r, contains_ci(F.col("p_name"), r) & (F.col("p_size") > 45)) for r in runs_of_words("small purple ring")]
    return relax(p, [*tries, ("", F.col("p_size") > 45)])


def f22_chips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of each status with every other filter held, plus totals without any filter."""
    o = table(spark, sf_dir, "orders")
    others = F.col("o_totalprice") > 100_000
    return o.agg(*[F.count_if(others & (F.col("o_orderstatus") == s)).alias(f"n_{s.lower()}") for s in "FOP"], F.count_if(others).alias("n_all"), F.count("*").alias("n_total"), F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("n_urgent"))


def a26_group_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filtered rows with their group's roll-up over all its rows."""
    o = table(spark, sf_dir, "orders")
    head = o.groupBy("o_custkey").agg(F.count("*").alias("n_rows"), F.count_if(F.col("o_orderstatus") == "F").alias("n_settled"), F.count_if(F.col("o_orderstatus") == "P").alias("n_review"))
    folded = head.where("n_rows < 5").select("o_custkey")
    return o.where("o_totalprice > 400000").join(folded, "o_custkey", "left_anti").join(head, "o_custkey").select("o_orderkey", "o_custkey", "n_rows", "n_settled", "n_review")


def j9_names_in_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest dictionary word that a text names as a whole word; the first of equals."""
    words = ["the", "and", "der", "license", "pathetic", "und", "les", "general public", "that"]
    hits = F.filter(F.array(*[F.when(S.named_in(F.col("text"), w), F.struct(F.lit(-len(w)).alias("size"), F.lit(k).alias("ord"), F.lit(w).alias("word"))) for k, w in enumerate(words)]), lambda x: x.isNotNull())
    return table(spark, sf_dir, "documents").select("doc_id", F.array_min(hits)["word"].alias("word"), F.size(hits).alias("n"))


_WORDS = "['the', 'and', 'der', 'license', 'pathetic', 'und', 'les', 'general public', 'that']"
_RELAX = ", ".join(f"({k}, '{r}', (SELECT count(*) FROM part WHERE contains(lower(p_name), '{r}') AND p_size > 45))" for k, r in enumerate([*runs_of_words("small purple ring"), ""]))
QUERIES = {f.__name__: f for f in (f4_client_match, a6_client_facet, f5_tag_filter, a7_zero_filled_facet, f9_newer_than, f11_haystack, o2_null_last_sort, w9_main_first, k11_relaxation, f22_chips, a26_group_headers, j9_names_in_text)}
SQL = {
    "f4_client_match": CLIENTS + " SELECT * FROM c WHERE lower(client) = 'nation_1' OR starts_with(lower(client), 'nation_1 (') OR ends_with(lower(client), '(nation_1)') OR lower(client) = 'maker_2' OR starts_with(lower(client), 'maker_2 (') OR ends_with(lower(client), '(maker_2)')",
    "a6_client_facet": CLIENTS + r" SELECT name, count(*) AS n FROM (SELECT CASE WHEN client LIKE '% (%)' THEN split_part(client, ' (', 1) ELSE client END AS name FROM c UNION ALL SELECT regexp_extract(client, '\((.+)\)$', 1) FROM c WHERE client LIKE '% (%)') GROUP BY name",
    "f5_tag_filter": TAGGED + " SELECT o_orderkey, array_to_string(tags, ',') AS tags FROM g WHERE (o_orderstatus = 'O' OR list_has_any(tags, ['R', 'A'])) AND NOT list_contains(tags, 'N')",
    "a7_zero_filled_facet": TAGGED + ", t AS (SELECT unnest(list_distinct(list_append(tags, o_orderstatus))) AS term FROM g) SELECT d.term, count(t.term) AS n FROM (SELECT unnest(['A', 'F', 'N', 'O', 'P', 'R', 'X']) AS term) d LEFT JOIN t ON d.term = t.term GROUP BY d.term",
    "f9_newer_than": "SELECT o_orderkey, o_orderdate::DATE AS day FROM orders WHERE o_orderdate >= DATE '1999-03-01'",
    "f11_haystack": "WITH h AS (SELECT *, month(o_orderdate)::INTEGER AS month, o_orderpriority || ' ' || o_orderkey || ' ' || month(o_orderdate) || ' ' || year(o_orderdate) || ' ' || month(o_orderdate) || '/' || year(o_orderdate) AS hay FROM orders) SELECT o_orderkey, month, row_number() OVER (ORDER BY month, o_totalprice, o_orderkey) AS place FROM h WHERE o_orderstatus = 'F' AND contains(lower(hay), '7 1997 7/1997')",
    "o2_null_last_sort": "WITH c AS (SELECT c_custkey, CASE WHEN c_custkey % 5 <> 0 THEN floor(c_acctbal)::BIGINT END AS budget, CASE WHEN c_custkey % 7 <> 0 THEN (c_custkey % 11)::INTEGER END AS yr FROM customer) SELECT *, row_number() OVER (ORDER BY budget DESC NULLS LAST, yr DESC NULLS LAST, c_custkey) AS place FROM c",
    "w9_main_first": "SELECT p_partkey, row_number() OVER (ORDER BY p_type <> 'ECONOMY', p_size DESC, p_partkey) AS place FROM part WHERE p_type = 'ECONOMY' OR contains(lower(p_name), 'ring')",
    "k11_relaxation": f"SELECT t AS try, name, n FROM (VALUES {_RELAX}) v(t, name, n) WHERE n > 0 ORDER BY t LIMIT 1",
    "f22_chips": "SELECT count(*) FILTER (o_totalprice > 100000 AND o_orderstatus = 'F') AS n_f, count(*) FILTER (o_totalprice > 100000 AND o_orderstatus = 'O') AS n_o, count(*) FILTER (o_totalprice > 100000 AND o_orderstatus = 'P') AS n_p, count(*) FILTER (o_totalprice > 100000) AS n_all, count(*) AS n_total, count(*) FILTER (o_orderpriority = '1-URGENT') AS n_urgent FROM orders",
    "a26_group_headers": "WITH h AS (SELECT o_custkey, count(*) AS n_rows, count(*) FILTER (o_orderstatus = 'F') AS n_settled, count(*) FILTER (o_orderstatus = 'P') AS n_review FROM orders GROUP BY 1) SELECT o_orderkey, o_custkey, n_rows, n_settled, n_review FROM orders JOIN h USING (o_custkey) WHERE o_totalprice > 400000 AND n_rows >= 5",
    "j9_names_in_text": f"WITH h AS (SELECT doc_id, list_filter({_WORDS}, lambda w: regexp_matches(lower(text), '(^|[^a-z0-9])' || w || '($|[^a-z0-9])')) AS w FROM documents) SELECT doc_id, list_reduce(w, lambda a, b: CASE WHEN length(b) > length(a) THEN b ELSE a END) AS word, len(w)::INTEGER AS n FROM h WHERE len(w) > 0 UNION ALL SELECT doc_id, NULL, 0 FROM h WHERE len(w) = 0",
}
