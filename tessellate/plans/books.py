"""Exports as files, written and read back: catalogue workbooks with their conditions, result workbooks, log files."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources import exports as X
from ..sources.office import csv_text, read_cells
from .feed import _cards
from .search import table

VAT = {"included": "with VAT", "excluded": "without VAT"}


def _folder(spark: SparkSession, name: str) -> str:
    """A new folder that all executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='spark-')}"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def catalogue_cells() -> dict[str, Column]:
    """The 17 columns of a catalogue sheet over cards; blank texts and empty lists are empty cells."""
    text = lambda c: X.text_cell(F.nullif(F.col(c), F.lit("")))
    listed = lambda c: X.text_cell(F.nullif(F.array_join(c, ", "), F.lit("")))
    vat = F.coalesce(*[F.when(F.col("vatStatus") == k, v) for k, v in VAT.items()], "vatStatus")
    checked = F.when(F.col("budgetAmount").isNotNull(), F.when(F.col("budgetVerified"), "confirmed").otherwise("not confirmed"))
    return {
        "Code": text("projectCode"), "Client": text("client"), "Name": text("projectName"), "Year": X.number_cell(F.col("year")), "Budget": X.number_cell(F.col("budgetAmount"), 1), "VAT": X.text_cell(vat), "Budget status": X.text_cell(checked),
        "Main category": text("category"), "Other categories": listed("tags"), "Work types": listed("workTypes"), "Description (th)": text("descriptionTh"), "Description (en)": text("descriptionEn"), "Note": text("budgetNote"),
        "Certificate date": X.date_cell(F.col("certificateDate")), "Project folder": text("projectFolderPath"), "Contract": text("contractPath"), "Certificate": text("certificatePath"),
    }


def export_catalogue(cards: DataFrame, book: Column, path: str, conditions: dict[str, Column]) -> None:
    """One workbook a book: its cards by code, and a sheet with the conditions of the search and the number of cards."""
    sheet = X.sheet_rows(cards, book, 0, "Projects", [F.col("projectCode")], catalogue_cells())
    counted = cards.groupBy(book.cast("string").alias("b")).agg(F.count("*").alias("n"))
    lines = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(k).alias("k"), v.cast("string").alias("v")) for i, (k, v) in enumerate(conditions.items())])
    terms = counted.select("b", F.inline(lines))
    X.write_books(sheet.unionByName(X.sheet_rows(terms, F.col("b"), 1, "Conditions", [F.col("i")], {"Condition": X.text_cell(F.col("k")), "Value": X.text_cell(F.col("v"))})), path)


def _read_back(spark: SparkSession, path: str) -> DataFrame:
    # a book that can't be read stops the run: it must not go missing
    cells = read_cells(spark, path).withColumn("text", F.when(F.col("error").isNotNull(), F.raise_error(F.col("error"))).otherwise(F.col("text")))
    return X.joined_sheets(cells.where("text <> ''")).select(F.regexp_extract("path", r"([^/]+)\.xlsx$", 1).alias("book"), F.col("part").alias("sheet"), "row", "col", "text")


def s16_workbooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Catalogue workbooks of found cards, a file for each hundred codes, read back cell by cell."""
    cards = _cards(spark, sf_dir).where(F.col("descriptionSource") != "manual")
    cards = cards.withColumn("budgetNote", F.when(F.col("budgetAmount").isNull(), "a <b> & \"c\"\n_x0041_ ").otherwise(F.lit("")))
    number = F.substring("projectCode", 3, 12).cast("long")
    path = _folder(spark, "catalogue")
    export_catalogue(cards, F.concat(F.lit("cards "), F.floor(number / 100).cast("string")), path, {"Exported by": F.lit("a user"), "Count": F.concat(F.col("n").cast("string"), F.lit(" projects")), "Sorted by": F.lit("code"), "Filter": F.lit("not edited by hand")})
    return _read_back(spark, path)


def s17_workbooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result workbooks, one a customer segment: a summary with totals, and a sheet of lines for each state of an order."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    rows = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.coalesce("c_mktsegment", F.lit("none")).alias("segment"), "o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice")
    levels = ("F", "O", "P")
    counts = rows.groupBy("segment", "o_orderpriority").agg(F.count("*").alias("n"), *[F.count_if(F.col("o_orderstatus") == x).alias(x) for x in levels])
    total = counts.groupBy("segment").agg(F.lit("total").alias("o_orderpriority"), *[F.sum(x).alias(x) for x in ("n", *levels)])
    both = counts.withColumn("last", F.lit(0)).unionByName(total.withColumn("last", F.lit(1)))
    summary = X.sheet_rows(both, F.col("segment"), 0, "Summary", [F.col("last"), F.col("o_orderpriority")], {"Group": X.text_cell(F.col("o_orderpriority")), "Rows": X.number_cell(F.col("n")), **{x: X.number_cell(F.col(x)) for x in levels}})
    lines = X.sheet_rows(rows, F.col("segment"), 1, F.concat(F.lit("State: "), "o_orderstatus"), [F.col("o_orderkey")], {"Order": X.number_cell(F.col("o_orderkey")), "Group": X.text_cell(F.col("o_orderpriority")), "Price": X.number_cell(F.col("o_totalprice"), 1)})
    path = _folder(spark, "results")
    X.write_books(summary.unionByName(lines), path)
    return _read_back(spark, path)


def s15_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 10,000 entries of each kind of event as a CSV file, its bytes read back."""
    e = table(spark, sf_dir, "events")
    newest = Window.partitionBy("event_type").orderBy(F.desc("ts"), F.desc("event_id"))
    rows = e.withColumn("place", F.row_number().over(newest)).where("place <= 10000")
    cut = rows.select(F.col("event_type").alias("book"), "place", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("time"), F.when(F.col("user_id") % 5 != 0, F.col("user_id")).alias("actor"), "event_id", F.concat(F.lit('said "'), "event_type", F.lit('"')).alias("summary"))
    path = _folder(spark, "log")
    X.write_books(csv_text(cut, ("book", "place")).select("book", F.lit(0).alias("number"), F.lit("").alias("sheet"), "place", "line"), path, "csv", "time,actor,entity_id,summary")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(path)
    return files.select(F.regexp_extract("path", r"([^/]+)\.csv$", 1).alias("book"), F.length("content").cast("long").alias("n_bytes"), F.sha2("content", 256).alias("digest"))


_C = "p_partkey"
QUERIES = {f.__name__: f for f in (s15_files, s16_workbooks, s17_workbooks)}
SQL = {
    "s15_files": """WITH r AS (SELECT event_type AS book, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS place, '"' || strftime(ts, '%Y-%m-%d %H:%M:%S') || '","' || CASE WHEN user_id % 5 <> 0 THEN user_id::VARCHAR ELSE '' END || '","' || event_id || '","said ""' || event_type || '""' || chr(34) AS line FROM events),
f AS (SELECT book, chr(65279) || 'time,actor,entity_id,summary' || chr(13) || chr(10) || string_agg(line, chr(13) || chr(10) ORDER BY place) AS text FROM r WHERE place <= 10000 GROUP BY book)
SELECT book, octet_length(encode(text))::BIGINT AS n_bytes, sha256(text) AS digest FROM f""",
    "s16_workbooks": f"""WITH c AS (SELECT 'cards ' || ({_C} // 100) AS book, 'P-' || {_C} AS code, {_C} AS k FROM part WHERE {_C} % 5 <> 1 AND {_C} % 11 <> 0),
h AS (SELECT DISTINCT book, 0 AS place, ['Code', 'Client', 'Name', 'Year', 'Budget', 'VAT', 'Budget status', 'Main category', 'Other categories', 'Work types', 'Description (th)', 'Description (en)', 'Note', 'Certificate date', 'Project folder', 'Contract', 'Certificate'] AS cells FROM c),
r AS (SELECT book, row_number() OVER (PARTITION BY book ORDER BY code) AS place, [code, 'old client', 'old name', '1999', CASE WHEN k % 3 = 0 THEN '5.0' END, NULL, CASE WHEN k % 3 = 0 THEN CASE WHEN k % 7 = 0 THEN 'confirmed' ELSE 'not confirmed' END END, 'SMALL', 'LARGE, PROMO', 'build', 'old th', NULL,
  CASE WHEN k % 3 <> 0 THEN 'a <b> & "c"' || chr(10) || '_x0041_ ' END, (DATE '2020-01-01' - DATE '1899-12-30')::VARCHAR, NULL, '/old/' || k, NULL] AS cells FROM c),
t AS (SELECT book, unnest([{{'place': 0, 'cells': ['Condition', 'Value']}}, {{'place': 1, 'cells': ['Exported by', 'a user']}}, {{'place': 2, 'cells': ['Count', n || ' projects']}}, {{'place': 3, 'cells': ['Sorted by', 'code']}}, {{'place': 4, 'cells': ['Filter', 'not edited by hand']}}], recursive := true) FROM (SELECT book, count(*) AS n FROM c GROUP BY book)),
a AS (SELECT book, 'Projects' AS sheet, place, cells FROM h UNION ALL SELECT book, 'Projects', place, cells FROM r UNION ALL SELECT book, 'Conditions', place, cells FROM t)
SELECT book, sheet, place::INTEGER AS row, (i - 1)::INTEGER AS col, cells[i] AS text FROM (SELECT *, unnest(range(1, len(cells) + 1)) AS i FROM a) WHERE coalesce(cells[i], '') <> ''""",
    "s17_workbooks": """WITH r AS (SELECT coalesce(c_mktsegment, 'none') AS book, o_orderkey, o_orderstatus AS s, o_orderpriority AS g, o_totalprice AS p FROM orders JOIN customer ON o_custkey = c_custkey),
n AS (SELECT book, coalesce(g, 'total') AS g, grouping(g) AS last, count(*) AS n, count(*) FILTER (s = 'F') AS f, count(*) FILTER (s = 'O') AS o, count(*) FILTER (s = 'P') AS p FROM r GROUP BY GROUPING SETS ((book, g), (book))),
a AS (SELECT book, 'Summary' AS sheet, row_number() OVER (PARTITION BY book ORDER BY last, g) AS place, [g, n::VARCHAR, f::VARCHAR, o::VARCHAR, p::VARCHAR] AS cells FROM n UNION ALL SELECT DISTINCT book, 'Summary', 0, ['Group', 'Rows', 'F', 'O', 'P'] FROM r
  UNION ALL SELECT book, 'State  ' || s, row_number() OVER (PARTITION BY book, s ORDER BY o_orderkey), [o_orderkey::VARCHAR, g, p::VARCHAR] FROM r UNION ALL SELECT DISTINCT book, 'State  ' || s, 0, ['Order', 'Group', 'Price'] FROM r)
SELECT book, sheet, place::INTEGER AS row, (i - 1)::INTEGER AS col, cells[i] AS text FROM (SELECT *, unnest(range(1, len(cells) + 1)) AS i FROM a) WHERE coalesce(cells[i], '') <> ''""",
}
