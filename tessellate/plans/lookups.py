"""Asks against a dictionary by an index of prefixes, and rows found by number with fallbacks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import arabic_digits
from ..operators.places import by_key
from .search import table

#: Thai letters and marks; asks of fewer letters must be a whole word of a work type.
THAI = "[\\u0E00-\\u0E7F]"
PREFIX_FROM = 3


def _prefixes(text: Column, least: Column | int = 1) -> Column:
    """The beginnings of a text of at least so many characters."""
    size = F.length(text)
    return F.when(size >= least, F.transform(F.sequence(F.lit(1) * least, size), lambda n: F.substring(text, F.lit(1), n))).otherwise(F.array().cast("array<string>"))


def term_keys(terms: DataFrame, whole: bool) -> DataFrame:
    """terms (value, en, th, synonyms) to every ask that finds them: (key, value), each once.

    A Latin ask finds a term whose label or synonym, or a word of it, begins with it; with `whole` (work types) it is
    the label, a word of it, or the beginning of a word from three letters on. A Thai ask is found anywhere in the
    Thai label or a synonym. The index grows with the dictionary's letters, for Thai labels with their square."""
    none = F.array().cast("array<string>")
    more = F.coalesce("synonyms", none)
    label = lambda c: F.transform(F.array_compact(F.concat(F.array(c), more)), F.lower)
    latin = terms.select("value", F.explode(label(F.col("en"))).alias("text"))
    words = F.filter(F.split("text", "[^a-z0-9]+"), lambda w: w != "")
    if whole:
        keys = F.concat(F.array("text"), words, F.flatten(F.transform(words, lambda w: _prefixes(w, PREFIX_FROM))))
    else:
        keys = F.concat(_prefixes(F.col("text")), F.flatten(F.transform(words, _prefixes)))
    found = latin.select("value", F.explode(keys).alias("key")).where(~F.col("key").rlike(THAI))
    thai = terms.select("value", F.explode(label(F.col("th"))).alias("text")).where(F.col("text").rlike(THAI))
    tails = F.transform(F.sequence(F.lit(1), F.length("text")), lambda n: F.substring("text", n, F.length("text")))
    inside = thai.select("value", F.explode(F.flatten(F.transform(tails, _prefixes))).alias("key")).where(F.col("key").rlike(THAI))
    return found.unionByName(inside).where("key <> ''").distinct().select("key", "value")


def matched_terms(asks: DataFrame, terms: DataFrame, whole: bool) -> DataFrame:
    """asks (ask) to (ask, value) of the terms they find (T3, T4): an equi-join with the index; blank asks find none."""
    q = asks.select("ask", F.trim(F.lower("ask")).alias("key")).distinct()
    return q.join(term_keys(terms, whole), "key").select("ask", "value")


def _part_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands as a dictionary: the first part's name is the label, its type and brand are synonyms."""
    p = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.min_by(F.struct("p_name", "p_type"), "p_partkey").alias("own"))
    return p.select(F.col("p_brand").alias("value"), F.col("own.p_name").alias("en"), F.lit(None).cast("string").alias("th"), F.array("own.p_type", "p_brand").alias("synonyms"))


def _asks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What people type: beginnings of the words of names, whole names, blanks."""
    n = F.pmod("p_partkey", F.lit(8)).cast("int")
    word = F.element_at(F.split("p_name", " "), F.when(F.col("p_partkey") % 2 == 0, 1).otherwise(-1))
    ask = F.when(n == 0, F.upper("p_name")).when(n == 7, F.concat(F.lit(" "), F.col("p_type"))).otherwise(F.substring(word, F.lit(1), n))
    return table(spark, sf_dir, "part").select(ask.alias("ask")).distinct()


def t3_asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many terms every ask finds as a category and as a work type, and the first."""
    asks, terms = _asks(spark, sf_dir), _part_terms(spark, sf_dir)
    both = matched_terms(asks, terms, False).withColumn("kind", F.lit("category")).unionByName(matched_terms(asks, terms, True).withColumn("kind", F.lit("work type")))
    return both.groupBy("ask", "kind").agg(F.count("*").alias("n"), F.min("value").alias("first"))


def f3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts that an ask finds through the terms it names (F3): counts are joined, so an ask's parts aren't written out."""
    parts = table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("value")).agg(F.count("*").alias("n"), F.max("p_partkey").alias("last"))
    named = matched_terms(_asks(spark, sf_dir), _part_terms(spark, sf_dir), False)
    return named.join(parts, "value").groupBy("ask").agg(F.sum("n").alias("n"), F.max("last").alias("last"))


# ---- rows by number


def normal_item(item: Column) -> Column:
    return F.regexp_replace(arabic_digits(F.regexp_replace(item, r"\s+", "")), r"\.$", "")


def _number(parts: Column) -> Column:
    """Segments without leading zeros, so that equal numbers are equal texts."""
    return F.transform(F.split(parts, r"\."), lambda p: F.regexp_replace(p, r"^0+(?=\d)", ""))


def located_rows(asks: DataFrame, rows: DataFrame) -> DataFrame:
    """asks (doc_id, row_number, item) to the row (table_no, place) of rows (doc_id, table_no, place, item, annex) they mean.

    In order: the first table whose row of that number bears the item, or ends it as a relative number ('(2)' of 5.2),
    or has no number while no other table has such a row; the one unnumbered row of that number below a row that bears
    the item; the only row of the document with that item. In a document divided into annexes (annex isn't null
    somewhere) rows answer only to items of their own annex, and the last way is closed. No row: nulls. Equal asks
    count once, null items are blank. Equi-joins by number and by item."""
    blank = F.coalesce("item", F.lit(""))
    r = rows.select("doc_id", "table_no", "place", blank.alias("cell"), "annex")
    numbered = arabic_digits(F.col("cell")).rlike(r"\d")
    above = F.last(F.when(numbered, F.col("cell")), ignorenulls=True).over(Window.partitionBy("doc_id", "table_no").orderBy("place").rowsBetween(Window.unboundedPreceding, -1))
    r = r.select("*", numbered.alias("numbered"), above.alias("above"))
    annexed = r.groupBy("doc_id").agg((F.count("annex") > 0).alias("annexed"))
    a = asks.select("doc_id", "row_number", blank.alias("item")).distinct()
    full = normal_item(F.col("item"))
    key = F.when(full.rlike(r"^\d+(\.\d+)*$"), _number(full)[0])
    a = a.join(annexed, "doc_id", "left").select("doc_id", "row_number", "item", full.alias("full"), key.alias("key"), F.coalesce("annexed", F.lit(False)).alias("annexed"))

    def bears(cell: Column) -> Column:
        own = F.regexp_extract(arabic_digits(F.regexp_replace(cell, r"\s+", "")), r"^\(?(\d+(?:\.\d+)*)[.)]?$", 1)
        parts, whole = _number(own), _number(F.col("full"))
        ends = (own != "") & (F.size(whole) > F.size(parts)) & (F.slice(whole, F.size(whole) - F.size(parts) + 1, F.size(parts)) == parts)
        return (normal_item(cell) == F.col("full")) | F.coalesce(F.when(F.size(whole) > F.size(parts), ends), F.lit(False))

    with_row = a.alias("a").join(r.alias("r"), (F.col("a.doc_id") == F.col("r.doc_id")) & (F.col("row_number") == F.col("place"))).where(~F.col("annexed") | F.col("annex").eqNullSafe(F.col("key")))
    is_it = bears(F.col("cell"))
    under = ~F.col("numbered") & F.coalesce(bears(F.col("above")), F.lit(False))
    t = F.col("table_no")
    by_row = with_row.groupBy("a.doc_id", "row_number", "item").agg(F.min(F.when(is_it, t)).alias("exact"), F.count("*").alias("n"), F.min(F.when(~F.col("numbered"), t)).alias("bare"), F.count_if(under).alias("n_under"), F.min(F.when(under, t)).alias("under"))
    table_no = F.coalesce("exact", F.when(F.col("n") == 1, F.col("bare")), F.when(F.col("n_under") == 1, F.col("under")))
    hits = by_row.select("doc_id", "row_number", "item", table_no.alias("hit"))
    by_item = r.groupBy("doc_id", normal_item(F.col("cell")).alias("full")).agg(F.count("*").alias("m"), F.min(F.struct("table_no", "place")).alias("only"))
    j = a.join(hits, ["doc_id", "row_number", "item"], "left").join(by_item.where("m = 1"), ["doc_id", "full"], "left")
    last_way = F.when(~F.col("annexed"), F.col("only"))
    return j.select("doc_id", "row_number", "item", F.coalesce("hit", last_way["table_no"]).alias("table_no"), F.when(F.col("hit").isNotNull(), F.col("row_number")).otherwise(last_way["place"]).alias("place"))


def j14_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that are asked for by number and item in every order's tables."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    li = by_key(lines, lines.count(), "l_orderkey").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("k"))
    side = (F.col("k") % 2).cast("int")
    place = F.row_number().over(Window.partitionBy("l_orderkey", side).orderBy("l_linenumber"))
    k, major = F.col("k"), (F.col("l_linenumber") / 3).cast("int")
    full = F.concat(major, F.lit("."), k % 4)
    item = F.when(k % 6 == 0, F.concat(F.lit("("), k % 4, F.lit(")"))).when(k % 6 == 1, F.lit(None)).when(k % 6 == 2, "-").when(k % 6 == 3, F.concat(full, F.lit("."))).otherwise(full)
    rows = li.select(F.col("l_orderkey").alias("doc_id"), side.alias("table_no"), place.alias("place"), item.alias("item"), F.when(F.col("l_orderkey") % 4 == 0, major.cast("string")).alias("annex"), full.alias("full"), "k")
    asks = rows.select("doc_id", F.when(k % 5 == 0, F.col("place") + 1).otherwise(F.col("place")).alias("row_number"), F.when(k % 7 == 0, "9.9").otherwise(F.col("full")).alias("item"))
    return located_rows(asks, rows)


QUERIES = {f.__name__: f for f in (t3_asked, f3_found, j14_rows)}
_ASKED = """WITH a AS (SELECT DISTINCT CASE p_partkey % 8 WHEN 0 THEN upper(p_name) WHEN 7 THEN ' ' || p_type ELSE substring(string_split(p_name, ' ')[CASE WHEN p_partkey % 2 = 0 THEN 1 ELSE -1 END], 1, (p_partkey % 8)::INT) END AS ask FROM part), q AS (SELECT ask, trim(lower(ask)) AS q FROM a),
  d AS (SELECT p_brand AS value, arg_min(p_name, p_partkey) AS en, arg_min(p_type, p_partkey) AS kind FROM part GROUP BY 1), x AS (SELECT value, lower(unnest([en, kind, value])) AS t FROM d),
  c AS (SELECT DISTINCT ask, value FROM q, x WHERE q <> '' AND (starts_with(t, q) OR len(list_filter(regexp_split_to_array(t, '[^a-z0-9]+'), lambda w: starts_with(w, q))) > 0))"""
SQL = {
    "t3_asked": _ASKED + """, w AS (SELECT DISTINCT ask, value FROM q, x WHERE q <> '' AND (t = q OR len(list_filter(regexp_split_to_array(t, '[^a-z0-9]+'), lambda w: w = q OR (length(q) >= 3 AND starts_with(w, q)))) > 0))
  SELECT ask, 'category' AS kind, count(*) AS n, min(value) AS first FROM c GROUP BY 1 UNION ALL SELECT ask, 'work type', count(*), min(value) FROM w GROUP BY 1""",
    "f3_found": _ASKED + " SELECT ask, count(*) AS n, max(p_partkey) AS last FROM c JOIN part ON p_brand = value GROUP BY 1",
}
