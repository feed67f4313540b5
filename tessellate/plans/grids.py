"""Headers and column roles of sheets and word tables that hold the parts of a brand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.table_roles import headers, word_roles
from .search import table

#: header layouts with the row behind them: (row below the header's first, column, text), and merges (top, left, bottom, right) below the first row
LAYOUTS = (
    ([(0, 0, "No."), (0, 1, "Requirement"), (0, 2, "Offer"), (0, 3, "Reference page"), (1, 0, "1")], []),
    ([(0, 0, "Item"), (0, 1, "TOR"), (0, 2, "Bidder"), (1, 2, "Comply"), (1, 3, "Proposed"), (0, 4, "Remark"), (2, 0, "1")], [(0, 2, 0, 3), (0, 0, 1, 0), (0, 1, 1, 1)]),
    ([(0, 1, "Item No."), (0, 2, "Specification"), (0, 3, "Vendor"), (1, 3, "text"), (2, 3, "Document"), (2, 4, "Price"), (3, 1, "1")], [(0, 3, 0, 4), (1, 3, 1, 4)]),
    ([(0, 0, "Part"), (0, 1, "Requirement"), (0, 2, "Offer")], []),
)


def k14_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The header of each brand's sheet: it begins at a row of its own, by one of four layouts."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", "p_brand", F.substring("p_brand", 7, 9).cast("int").alias("b"))
    sheet = [F.col("p_brand").alias("path"), F.lit("0").alias("part")]
    brands = p.select("p_brand", "b").distinct().withColumn("first", (F.col("b") * 3).cast("int"))
    kind = F.col("b") % len(LAYOUTS)
    head = F.coalesce(*[F.when(kind == i, F.array(*[F.struct((F.col("first") + r).alias("row"), F.lit(c).alias("col"), F.lit(t).alias("text")) for r, c, t in cells])) for i, (cells, _) in enumerate(LAYOUTS)])
    none = F.array().cast("array<struct<top:int,left:int,bottom:int,right:int>>")
    spans = F.coalesce(*[F.when(kind == i, F.array(*[F.struct((F.col("first") + t).alias("top"), F.lit(x).alias("left"), (F.col("first") + b).alias("bottom"), F.lit(y).alias("right")) for t, x, b, y in merges]) if merges else none) for i, (_, merges) in enumerate(LAYOUTS)])
    title = brands.where("first > 0").select(*sheet, F.lit(0).alias("row"), F.lit(1).alias("col"), F.lit("Requirement and offer of a brand").alias("text"))
    # data stands at rows that the part key gives, behind every header
    body = p.select(*sheet, (F.col("b") * 3 + 10 + F.col("p_partkey")).cast("int").alias("row"), F.inline(F.array(F.struct(F.lit(0).alias("col"), F.col("p_partkey").cast("string").alias("text")), F.struct(F.lit(1).alias("col"), F.col("p_name").alias("text")), F.struct(F.lit(2).alias("col"), F.col("p_size").cast("string").alias("text")))))
    cells = brands.select(*sheet, F.inline(head)).unionByName(title).unionByName(body)
    found = headers(cells, brands.select(*sheet, F.inline(spans)))
    entries = F.array_join(F.array_sort(F.transform(F.map_entries("columns"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))), ";")
    return found.select("path", "first", "last", entries.alias("columns"))


def k15_word_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Column roles of each brand's word table: where the offer, the references and the remarks stand."""
    k, b = F.col("p_partkey"), F.substring("p_brand", 7, 9).cast("int")
    p = table(spark, sf_dir, "part")
    cell = lambda place, col, text, span=1: F.struct(F.lit(place).alias("place"), F.lit(col).cast("int").alias("col"), F.lit(span).alias("span"), text.alias("text"))
    number = F.when(k % 10 != 0, F.concat(F.lit("1."), k.cast("string"))).otherwise(F.lit("note"))
    offer = F.when(b % 3 == 0, F.lit("☑")).otherwise(F.col("p_name"))
    cite = F.when(k % 2 == 0, F.concat(F.lit("page "), k.cast("string"))).otherwise(F.lit("see there"))
    at = F.when(k % 4 == 0, 2).otherwise(3)
    rows = p.select(F.col("p_brand").alias("path"), F.lit("0").alias("part"), (k + 2).alias("row"), F.inline(F.array(cell(0, 0, number), cell(1, 1, F.col("p_name")), F.struct(F.lit(2).alias("place"), at.alias("col"), F.lit(1).alias("span"), offer.alias("text")), F.struct(F.lit(3).alias("place"), F.when(k % 5 == 0, 6).otherwise(5).alias("col"), F.lit(1).alias("span"), cite.alias("text")), cell(4, 7, F.when(k % 7 == 0, F.lit("a remark")).otherwise(F.lit(""))))))
    brands = p.select("p_brand", b.alias("b")).distinct().where("b % 2 = 0")
    head = brands.select(F.col("p_brand").alias("path"), F.lit("0").alias("part"), F.lit(1).cast("long").alias("row"), F.inline(F.array(cell(0, 0, F.lit("Item")), cell(1, 1, F.lit("Requirement")), cell(2, 2, F.lit("Offer")), cell(3, 4, F.lit("Reference"), 2), cell(4, 7, F.lit("Remark")))))
    return word_roles(rows.unionByName(head)).drop("part")


QUERIES = {f.__name__: f for f in (k14_headers, k15_word_roles)}
SQL = {
    "k14_headers": """WITH b AS (SELECT DISTINCT p_brand AS path, substr(p_brand, 7)::INTEGER AS b FROM part)
SELECT path, b * 3 AS first, b * 3 + CASE b % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS last, CASE b % 4 WHEN 0 THEN 'item=0;proposal=2;reference=3;tor=1' WHEN 1 THEN 'comply=2;item=0;proposal=3;remark=4;tor=1' ELSE 'item=1;proposal=4;reference=3;tor=2' END AS columns FROM b WHERE b % 4 <> 3""",
    "k15_word_roles": """WITH r AS (SELECT p_brand AS path, substr(p_brand, 7)::INTEGER AS b, p_partkey AS k, CASE WHEN p_partkey % 4 = 0 THEN 2 ELSE 3 END AS start, CASE WHEN p_partkey % 5 = 0 THEN 6 ELSE 5 END AS c, p_partkey % 2 = 0 AS cites, p_partkey % 7 = 0 AS remarks FROM part WHERE p_partkey % 10 <> 0),
o AS (SELECT path, any_value(b) AS b, CASE WHEN count(*) FILTER (start = 2) >= count(*) FILTER (start = 3) THEN 2 ELSE 3 END AS offer, CASE WHEN count(*) FILTER (cites) = 0 THEN NULL WHEN count(*) FILTER (cites AND c = 5) >= count(*) FILTER (cites AND c = 6) THEN 5 ELSE 6 END AS l, bool_or(remarks) AS said, bool_or(c = 6) AS six, bool_or(c = 5) AS five FROM r GROUP BY path)
SELECT path, offer, b % 3 = 0 AS no_offer, CASE WHEN b % 2 = 0 THEN 4 ELSE l END AS reference_from, CASE WHEN b % 2 = 0 THEN 5 ELSE l END AS reference_to,
  CASE WHEN b % 2 = 0 THEN 7 WHEN l = 5 AND six THEN 6 WHEN l IS NOT NULL AND said THEN 7 END AS remark_from, CASE WHEN b % 2 = 0 THEN 7 WHEN l = 5 AND six THEN 6 WHEN l IS NOT NULL AND said THEN 7 END AS remark_to FROM o""",
}
