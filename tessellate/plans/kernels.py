"""Text alignment over the driver tables (K1-K6, K10, W5, W8): rows-only, tested on small inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import alignment as A
from .search import table


def k6_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of every benchmark passage, some changed, against a source that holds four passages as its numbered items."""
    b = table(spark, sf_dir, "benchmark")
    item = b.select((F.col("item_id") / 4).cast("long").alias("doc_id"), (F.col("item_id") % 4 + 1).cast("int").alias("n"), "text")
    rows = item.select("doc_id", "n", F.posexplode(F.split("text", r"\.\s*")).alias("place", "text")).where("trim(text) <> ''")
    changed = F.when(F.col("place") % 3 == 1, F.regexp_replace("text", "^[A-Za-z]+", "changed")).when(F.col("place") % 3 == 2, F.upper("text")).otherwise(F.col("text"))
    number = F.col("n").cast("string")
    # an item's first row is its heading and names its number; the last item of every second source is asked for but not there
    rows = rows.select("doc_id", (F.col("n") * 10_000 + F.col("place")).cast("long").alias("position"), number.alias("major"), F.when(F.col("place") == 0, number).alias("item"), changed.alias("text"), F.lit(False).alias("image"))
    pages = item.where("n < 4 OR doc_id % 2 = 0").select("doc_id", F.col("n").alias("page"), F.concat(number, F.lit(". "), F.col("text")).alias("text"), F.lit(False).alias("picture"))
    return A.align(rows, pages).select("doc_id", "section", "position", "outcome", "page", "no_section")


def t11_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names with a font's private-use glyphs, repaired and composed."""
    k = (F.col("p_partkey") % 27).cast("int")
    glyphs = F.array(*[F.lit(chr(0xF700 + i)) for i in range(27)])
    text = F.concat("p_name", F.lit(" e\u0301"), F.get(glyphs, k), F.lit("\ue123"))
    return table(spark, sf_dir, "part").select("p_partkey", A.repair_glyphs(text).alias("name"))


def k10_word_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    other = F.regexp_replace("text", r"\bthe\b", "this")
    return b.select("item_id", A.word_diff_udf(F.col("text"), other).alias("diff"), F.round(A.similarity_udf(F.col("text"), other), 4).alias("similarity"))


def w5_major_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"))
    item = F.when(F.col("p") % 3 == 0, F.concat_ws(".", "l_linenumber", F.col("p") % 4)).otherwise(F.col("l_linenumber").cast("string"))
    return A.major_items(li.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").cast("long").alias("position"), item.alias("item")))


def w8_page_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity"))).alias("r"))
    pages = A.page_breaks(F.transform("r", lambda x: x["l_quantity"]), 60.0)
    return li.select("l_orderkey", F.array_join(pages, ",").alias("pages"))


QUERIES = {f.__name__: f for f in (k6_compare, t11_repaired, k10_word_diff, w5_major_items, w8_page_breaks)}
SQL: dict[str, str] = {
    "t11_repaired": f"SELECT p_partkey, nfc_normalize(p_name || ' e' || chr(769) || ({list(A.GLYPHS)})[p_partkey % 27 + 1]) AS name FROM part",
    "w8_page_breaks": "WITH RECURSIVE o AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) AS k, l_quantity AS h FROM lineitem), f AS (SELECT l_orderkey, k, h AS used, 0 AS page FROM o WHERE k = 1 UNION ALL SELECT o.l_orderkey, o.k, CASE WHEN f.used + h > 60 THEN h ELSE f.used + h END, f.page + CASE WHEN f.used + h > 60 THEN 1 ELSE 0 END FROM f JOIN o ON o.l_orderkey = f.l_orderkey AND o.k = f.k + 1) SELECT l_orderkey, string_agg(page, ',' ORDER BY k) AS pages FROM f GROUP BY 1",
}
