"""Questions to filters, located rows, split items and read-back guards."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators.places import by_key
from ..operators.scan import ordered_scan
from .search import table

CERTIFICATE_YEARS = (1, 3, 5, 10)


def grounded(question: Column, number: Column) -> Column:
    """A number of the model's answer, kept only if its digits stand in the question."""
    digits = F.regexp_extract_all(S.arabic_digits(question), F.lit(r"(\d+)"), 1)
    return F.when(F.array_contains(digits, number.cast("string")), number)


def option_above(years: Column) -> Column:
    """The smallest offered number of years that is not less; none beyond the last."""
    return F.get(F.filter(F.array(*map(F.lit, CERTIFICATE_YEARS)), lambda o: o >= years), 0)


def keyword(text: Column, names: tuple[str, ...], generic: tuple[str, ...]) -> Column:
    """The text without dictionary names (longest first) and generic words; null if nothing is left."""
    out = F.lower(text)
    for name in (*sorted(names, key=lambda n: (-len(n), n)), *generic):
        out = F.regexp_replace(out, rf"(?<![a-z0-9]){name}(?![a-z0-9])", " ")
    return F.nullif(F.trim(F.regexp_replace(out, r"\s+", " ")), F.lit(""))


def k12_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    question = F.concat(F.lower("p_type"), F.lit(" projects for "), "p_name", F.lit(" since "), 2540 + k % 20, F.lit(" over "), "p_size", F.lit(" million, last "), k % 12, F.lit(" years"))
    answer = F.from_json(F.to_json(F.struct((2540 + k % 20).alias("year"), (F.col("p_size") + F.when(k % 4 == 0, 100).otherwise(0)).alias("budget"), (k % 12).alias("cert"))), "year int, budget int, cert int")
    r = p.select("p_partkey", "p_name", question.alias("q"), answer.alias("a"))
    return r.select("p_partkey", S.common_era(grounded(F.col("q"), F.col("a.year"))).alias("year_from"), (grounded(F.col("q"), F.col("a.budget")).cast("long") * 1_000_000).alias("budget_min"), option_above(grounded(F.col("q"), F.col("a.cert"))).alias("cert"), keyword(F.concat("p_name", F.lit(" project")), ("ring", "blue"), ("project", "projects")).alias("keyword"))


def j14_located(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Asked (order, line, part): by line and part, else the only line with the part, else the only line of that number."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    li = by_key(lines, lines.count(), "l_orderkey").distinct()
    asked = li.select("l_orderkey", F.when(F.col("l_partkey") % 3 == 0, F.col("l_linenumber") + 1).otherwise(F.col("l_linenumber")).alias("line"), F.when(F.col("l_partkey") % 4 == 0, -1).otherwise(F.col("l_partkey")).cast("long").alias("part")).distinct()
    stages = [(F.col("l_linenumber") == F.col("line")) & (F.col("l_partkey") == F.col("part")), F.col("l_partkey") == F.col("part"), F.col("l_linenumber") == F.col("line")]
    j = asked.join(li.hint("merge"), "l_orderkey")
    found = j.groupBy("l_orderkey", "line", "part").agg(*[F.count_if(c).alias(f"n{k}") for k, c in enumerate(stages)], *[F.max(F.when(c, F.col("l_linenumber"))).alias(f"at{k}") for k, c in enumerate(stages)])
    place = F.coalesce(*[F.when(F.col(f"n{k}") == 1, F.col(f"at{k}")) for k in range(3)])
    return found.select("l_orderkey", "line", "part", place.alias("located"))


def split_items(lines: DataFrame) -> DataFrame:
    """lines (doc_id, position, text) to items (doc_id, part, number, first, text).

    'N. text' begins an item if N follows the last one; 1 begins a new part (an annex) or the first; any other
    line goes on with its item, and lines before the first item are left out."""

    def step(state, text):
        part, number = state
        head = re.match(r"\s*(\d+)[.)]\s+(\S.*)", (text or "").translate(digits))
        n = int(head[1]) if head else 0
        if n == 1 and (number != 1 or part == 0):
            part, number = part + 1, 1
        elif head and number and n == number + 1:
            number = n
        else:
            head = None
        return [part, number], (part, number, head[2] if head else (text or "").strip())

    digits = str.maketrans(S.THAI_DIGITS, "0123456789")
    scanned = ordered_scan(lines.select("doc_id", "position", F.col("text").alias("line")), "doc_id", ["position"], ["line"], [0, 0], step, "part int, number int, text string")
    rows = scanned.where("part > 0")
    # an item's lines: bounded by its document
    return rows.groupBy("doc_id", "part", "number").agg(F.min("position").alias("first"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("position", "text"))), lambda x: x["text"]), " ").alias("text"))


def k7_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").dropDuplicates(["conv_id", "turn"])
    w = Window.partitionBy("conv_id").orderBy("turn")
    n = F.row_number().over(w)
    text = F.when(F.col("role") == "user", F.concat((F.floor((n + 1) / 2)).cast("string"), F.lit(". "), F.col("text"))).otherwise(F.col("text"))
    return split_items(c.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("position"), text.alias("text")))


def t23_read_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A written reference parsed again must give the same document and the same pages."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_linenumber")).alias("pages"))
    written = F.concat(F.lit("Order-"), "l_orderkey", F.lit(": page "), F.array_join(F.when(F.col("l_orderkey") % 5 == 0, F.slice("pages", 1, 1)).otherwise(F.col("pages")), ", "))
    r = li.select("l_orderkey", "pages", written.alias("t"))
    back = S.page_list(F.regexp_extract("t", ": page (.*)$", 1), 5000, 50, True)
    return r.select("l_orderkey", F.when(F.regexp_extract("t", r"^Order-(\d+):", 1).cast("long") != F.col("l_orderkey"), "document").when(F.coalesce(back != F.col("pages"), F.lit(True)), "pages").otherwise("ok").alias("problem"))


QUERIES = {f.__name__: f for f in (k12_filters, j14_located, k7_items, t23_read_back)}
SQL = {
    "k12_filters": "SELECT p_partkey, (1997 + p_partkey % 20)::BIGINT AS year_from, CASE WHEN p_partkey % 4 <> 0 OR p_size + 100 IN (2540 + p_partkey % 20, p_partkey % 12) THEN (p_size + CASE WHEN p_partkey % 4 = 0 THEN 100 ELSE 0 END)::BIGINT * 1000000 END AS budget_min, CASE WHEN p_partkey % 12 <= 1 THEN 1 WHEN p_partkey % 12 <= 3 THEN 3 WHEN p_partkey % 12 <= 5 THEN 5 WHEN p_partkey % 12 <= 10 THEN 10 END AS cert, nullif(array_to_string(list_filter(string_split(p_name, ' '), lambda w: w NOT IN ('ring', 'blue')), ' '), '') AS keyword FROM part",
    "j14_located": "WITH l AS (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey FROM lineitem), a AS (SELECT DISTINCT l_orderkey, CASE WHEN l_partkey % 3 = 0 THEN l_linenumber + 1 ELSE l_linenumber END AS line, CASE WHEN l_partkey % 4 = 0 THEN -1 ELSE l_partkey END AS part FROM l), f AS (SELECT a.l_orderkey, line, part, count(*) FILTER (l_linenumber = line AND l_partkey = part) AS n0, max(l_linenumber) FILTER (l_linenumber = line AND l_partkey = part) AS a0, count(*) FILTER (l_partkey = part) AS n1, max(l_linenumber) FILTER (l_partkey = part) AS a1, count(*) FILTER (l_linenumber = line) AS n2, max(l_linenumber) FILTER (l_linenumber = line) AS a2 FROM a JOIN l ON a.l_orderkey = l.l_orderkey GROUP BY 1, 2, 3) SELECT l_orderkey, line, part, CASE WHEN n0 = 1 THEN a0 WHEN n1 = 1 THEN a1 WHEN n2 = 1 THEN a2 END AS located FROM f",
    "t23_read_back": "WITH g AS (SELECT l_orderkey, count(DISTINCT l_linenumber) AS n FROM lineitem GROUP BY 1) SELECT l_orderkey, CASE WHEN l_orderkey % 5 = 0 AND n > 1 THEN 'pages' ELSE 'ok' END AS problem FROM g",
}
