"""What goes out: text of CSV and safe names, workbook data, located references, cleaned scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.office import csv_text
from .retrieval import near_keys
from .review import reference_status, review_rows
from .search import table

#: Named entities of XML, and what a file name can't hold.
ENTITIES = {"lt": "<", "gt": ">", "quot": '"', "apos": "'", "amp": "&"}
UNSAFE, NAME_LENGTH = r'[\\/:*?"<>|\r\n]+', 80


def xml_escaped(text: Column) -> Column:
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    for name in ("lt", "gt", "quot", "apos"):
        out = F.replace(out, F.lit(ENTITIES[name]), F.lit(f"&{name};"))
    return out


def xml_decoded(text: Column) -> Column:
    """Named and numeric entities to their characters, each once; what is no entity stays."""
    pieces = F.split(text, r"(?i)(?=&(?:lt|gt|amp|quot|apos|#\d+|#x[0-9a-f]+);)|(?<=;)")

    def piece(p: Column) -> Column:
        name = F.lower(F.regexp_extract(p, r"^(?i)&(lt|gt|amp|quot|apos|#\d+|#x[0-9a-f]+);$", 1))
        code = F.when(F.startswith(name, F.lit("#x")), F.conv(F.substring(name, 3, 8), 16, 10)).when(F.startswith(name, F.lit("#")), F.substring(name, 2, 8)).cast("int")
        # four bytes of a code point, read as UTF-32
        sign = F.decode(F.to_binary(F.lpad(F.hex(code.cast("long")), 8, "0"), F.lit("hex")), "UTF-32")
        named = F.coalesce(*[F.when(name == k, v) for k, v in ENTITIES.items()])
        return F.when(name == "", p).otherwise(F.coalesce(named, sign))

    return F.array_join(F.transform(pieces, piece), "")


def safe_name(text: Column) -> Column:
    return F.substring(F.trim(F.regexp_replace(text, UNSAFE, "_")), 1, NAME_LENGTH)


def t25_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Escaped, decoded and file-safe texts."""
    k = F.col("p_partkey")
    raw = F.concat("p_name", F.when(k % 3 == 0, " <b> & \"q\"").otherwise(" it's"), F.lit("/"), k.cast("string"), F.lit(":x?"))
    coded = F.concat(F.lit("&lt;"), "p_name", F.lit("&gt; &amp;lt; &#"), (65 + k % 26).cast("string"), F.lit("; &#x41; & &nope;"))
    return table(spark, sf_dir, "part").select(k, xml_escaped(raw).alias("escaped"), xml_decoded(coded).alias("decoded"), safe_name(raw).alias("safe"))


def csv_file(df: DataFrame, header: tuple[str, ...], newest: int, *order: Column) -> DataFrame:
    """One row with the whole text of a bounded export: a byte-order mark, an unquoted header, quoted fields, CRLF between lines and none at the end.

    `newest` bounds the rows, so the one text is bounded too."""
    rows = df.orderBy(*order).limit(newest)
    place = F.row_number().over(Window.orderBy(*order))
    lines = csv_text(rows.withColumn("place", place), ("place",))
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "line"))), lambda x: x["line"]), "\r\n")
    head = "﻿" + ",".join(header)
    return lines.agg(text.alias("body")).select(F.when(F.col("body") == "", F.lit(head)).otherwise(F.concat(F.lit(head + "\r\n"), "body")).alias("text"))


def s15_audit_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 10,000 entries of a log as CSV text."""
    e = table(spark, sf_dir, "events")
    rows = e.select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("time"), F.when(F.col("user_id") % 5 != 0, F.col("user_id")).alias("actor"), F.col("event_type").alias("action"), "event_id", F.concat(F.lit('said "'), "event_type", F.lit('"')).alias("summary"))
    out = csv_file(rows, ("time", "actor", "action", "entity_id", "summary"), 10_000, F.desc("time"), F.desc("event_id"))
    return out.select(F.length("text").alias("n_chars"), F.md5(F.encode("text", "UTF-8")).alias("digest"))


def s16_catalog_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue's sheet: labels for codes, blanks as nulls, lists as joined labels."""
    label = F.create_map(*[F.lit(x) for kv in (("ECONOMY", "Economy"), ("PROMO", "Promotion"), ("LARGE", "Large")) for x in kv])
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    named = lambda c: F.coalesce(F.try_element_at(label, c), c)
    tags = F.when(k % 3 == 0, F.array("p_type", F.lit("LARGE"))).otherwise(F.array().cast("array<string>"))
    return p.select(
        k.alias("no"), F.concat(F.lit("P-"), k.cast("string")).alias("code"), "p_name", F.nullif(F.when(k % 4 == 0, "").otherwise(F.col("p_brand")), F.lit("")).alias("client"), named(F.col("p_type")).alias("category"),
        F.nullif(F.array_join(F.transform(tags, named), ", "), F.lit("")).alias("tags"), F.when(k % 5 != 0, F.col("p_retailprice")).alias("budget"), (F.col("p_size") + 2500).alias("year"),
    )


def s17_result_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary sheet of a results workbook: per group the rows of each level and a total line."""
    status = review_rows(spark, sf_dir).where("status <> 'heading'").withColumn("s", reference_status())
    level = F.when(F.col("s").isin("match", "not_applicable"), "clear").when(F.col("s").isin("match_recheck", "match_incomplete", "unverifiable"), "recheck").otherwise("problem")
    counts = [F.count_if(F.col("level") == x).alias(x) for x in ("clear", "recheck", "problem")]
    sheets = status.withColumn("level", level).groupBy("l_suppkey").agg(*counts, F.count("*").alias("rows"))
    total = sheets.agg(*[F.sum(c).alias(c) for c in ("clear", "recheck", "problem", "rows")]).select(F.lit("total").alias("sheet"), "*")
    return sheets.select(F.concat(F.lit("item "), F.col("l_suppkey").cast("string")).alias("sheet"), "clear", "recheck", "problem", "rows").unionByName(total)


def s19_issue_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines whose outcome isn't `match`, numbered within their group, with the count of their outcome."""
    rows = review_rows(spark, sf_dir).where("coalesce(reference, 'match') <> 'match'")
    n = rows.groupBy("l_suppkey", "reference").agg(F.count("*").alias("n_outcome"))
    w = Window.partitionBy("l_suppkey").orderBy("l_orderkey", "l_linenumber", "l_partkey")
    return rows.withColumn("no", F.row_number().over(w)).join(n, ["l_suppkey", "reference"]).select("l_suppkey", "no", "l_orderkey", "l_linenumber", F.col("reference").alias("outcome"), "n_outcome")


# ---- located references


def suggestions(rows: DataFrame, pages: DataFrame, top: int = 3, least: int = 2, share: float = 0.6) -> DataFrame:
    """rows (job, row_id, label, tokens) against pages (job, page, labels, tokens): pages with the row's label, or with its values.

    Labels and tokens each meet in an equi-join inside their job; job, row_id, place, page, source and `certain`, which
    says that exactly one page has the label."""
    labelled = rows.where("label IS NOT NULL").select("job", "row_id", "label").join(pages.select("job", "page", F.explode(F.array_distinct("labels")).alias("label")), ["job", "label"]).select("job", "row_id", "page", F.lit(True).alias("labelled"))
    asked = rows.select("job", "row_id", F.size(F.array_distinct("tokens")).alias("size"), F.explode(F.array_distinct("tokens")).alias("token"))
    index = pages.select("job", "page", F.explode(F.array_distinct("tokens")).alias("token"))
    hits = asked.join(index, ["job", "token"]).groupBy("job", "row_id", "page").agg(F.count("*").alias("n"), F.max("size").alias("size"))
    both = labelled.join(hits, ["job", "row_id", "page"], "full").select("job", "row_id", "page", F.coalesce("labelled", F.lit(False)).alias("labelled"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce(F.col("n") / F.col("size"), F.lit(0.0)).alias("share"))
    both = both.where(F.col("labelled") | (F.col("n") >= least) & (F.col("share") >= share))
    w = Window.partitionBy("job", "row_id")
    both = both.withColumn("certain", F.count_if("labelled").over(w) == 1).withColumn("place", F.row_number().over(w.orderBy(F.desc("labelled"), F.desc("share"), "page")))
    return both.where(F.col("place") <= top).select("job", "row_id", "place", "page", F.when(F.col("labelled"), "label").otherwise("value").alias("source"), "certain")


LABEL = r"(?<![0-9.])\d+(?:\.\d+)+(?![0-9])"


def k13_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order looked for on the order's pages (its lines with a part's name, size and number) by label and by value."""
    p = table(spark, sf_dir, "part")
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p_partkey")).join(p, "p_partkey")
    label = F.concat((F.col("p_size") % 3).cast("string"), F.lit("."), (F.col("l_linenumber") % 3).cast("string"))
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: F.length(w) >= 3))
    text = F.concat(F.lit("see "), label, F.lit(" "), F.col("p_name"), F.lit(" v1.2.3x "), F.col("p_type"))
    pages = li.select(F.col("l_orderkey").alias("job"), F.col("l_linenumber").alias("page"), F.regexp_extract_all(text, F.lit(f"({LABEL})"), 1).alias("labels"), words(text).alias("tokens"))
    rows = li.select(F.col("l_orderkey").alias("job"), F.col("l_linenumber").alias("row_id"), F.when(F.col("l_linenumber") % 2 == 0, label).alias("label"), words(F.concat_ws(" ", "p_name", "p_type")).alias("tokens"))
    return suggestions(rows, pages)


def t22_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reference written for a cell: Thai over several lines, English in one."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_linenumber")).alias("pages"))
    name = F.concat(F.lit("Order-"), F.col("l_orderkey").cast("string"))
    listed = F.array_join("pages", ", ")
    thai = F.concat(F.lit("เอกสารอ้างอิง\n"), name, F.lit("\nหน้า "), listed)
    english = F.concat(name, F.lit(", page "), listed)
    return li.select("l_orderkey", F.when(F.col("l_orderkey") % 2 == 0, thai).otherwise(english).alias("reference"))


# ---- scans

HEAD_LINES, FOOT_LINES, KEY_LENGTH = 3, 8, 60


def stripped_pages(pages: DataFrame, share: float = 0.2) -> DataFrame:
    """pages (doc, page, text) without the lines that repeat at their heads and feet (K8, K9).

    A head is one of a page's first HEAD_LINES lines, a foot one of its last FOOT_LINES; digits count alike. A line (of at
    most KEY_LENGTH characters: longer ones are the page's own text, which are heads only as exact repeats) goes
    if its key, or keys at most `share` of edits away from it, stand on more than half of the document's pages, of at
    least three. Only the distinct keys of one document's heads and feet are compared, by near_keys."""
    lines = pages.select("doc", "page", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("line", "raw"), F.size(F.split(F.coalesce("text", F.lit("")), "\n")).alias("n"))
    key = F.trim(F.regexp_replace(F.regexp_replace(F.lower("raw"), r"\d+", "#"), r"\s+", " "))
    marked = lines.withColumn("key", key).withColumn("edge", (F.col("line") < HEAD_LINES) | (F.col("line") >= F.col("n") - FOOT_LINES))
    edges = marked.where("edge AND key <> ''").select("doc", "page", "key").distinct()
    total = pages.groupBy("doc").agg(F.count("*").alias("pages")).where("pages >= 3")
    asked = edges.join(total, "doc", "left_semi").select("doc", "key").distinct()
    near = near_keys(asked.where(F.length("key") <= KEY_LENGTH), "key", share, within=("doc",)).select("doc", "a", "b")
    near = near.unionByName(near.select("doc", F.col("b").alias("a"), F.col("a").alias("b"))).unionByName(asked.select("doc", F.col("key").alias("a"), F.col("key").alias("b")))
    counts = edges.join(near.withColumnRenamed("b", "key"), ["doc", "key"]).select("doc", F.col("a").alias("key"), "page").distinct().groupBy("doc", "key").agg(F.count("*").alias("on"))
    heads = counts.join(total, "doc").where("2 * on > pages").select("doc", "key", F.lit(True).alias("gone"))
    kept = marked.join(heads, ["doc", "key"], "left").where("NOT (edge AND coalesce(gone, false))")
    body = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("line", "raw"))), lambda x: x["raw"]), "\n")
    found = kept.groupBy("doc", "page").agg(body.alias("text"))
    return pages.select("doc", "page").join(found, ["doc", "page"], "left").select("doc", "page", F.coalesce("text", F.lit("")).alias("text"))


def k8_stripped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation as the pages of a scan, with a running head (its number changes) and a foot (K8)."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.min("text").alias("text"))
    head = F.concat(F.lit("Report no. "), F.col("turn").cast("string"), F.when(F.col("turn") % 3 == 1, " ot the group").otherwise(" of the group"))
    return stripped_pages(c.select(F.col("conv_id").alias("doc"), F.col("turn").alias("page"), F.concat(head, F.lit("\n"), F.coalesce("text", F.lit("")), F.lit("\nconfidential")).alias("text")))


QUERIES = {f.__name__: f for f in (t25_texts, s15_audit_export, s16_catalog_sheet, s17_result_sheets, s19_issue_list, k13_labelled, t22_references, k8_stripped)}
_STATUS = "WITH r AS (SELECT *, (['match', 'mismatch', 'not_found', 'unverifiable', NULL])[l_partkey % 5 + 1] AS reference, l_partkey % 7 AS s, l_partkey % 3 AS c FROM lineitem)"
SQL = {
    "t25_texts": r"""WITH p AS (SELECT p_partkey, p_name, p_name || CASE WHEN p_partkey % 3 = 0 THEN ' <b> & "q"' ELSE ' it''s' END || '/' || p_partkey || ':x?' AS raw FROM part)
  SELECT p_partkey, replace(replace(replace(replace(replace(raw, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;') AS escaped, '<' || p_name || '> &lt; ' || chr((65 + p_partkey % 26)::INTEGER) || ' A & &nope;' AS decoded, trim(regexp_replace(raw, '[\\/:*?"<>|\r\n]+', '_', 'g'))[1:80] AS safe FROM p""",
    "s15_audit_export": r"""WITH e AS (SELECT strftime(ts, '%Y-%m-%d %H:%M:%S') AS t, event_id, user_id, event_type FROM events), n AS (SELECT * FROM e ORDER BY t DESC, event_id DESC LIMIT 10000),
  l AS (SELECT t, event_id, '"' || t || '","' || CASE WHEN user_id % 5 <> 0 THEN user_id::VARCHAR ELSE '' END || '","' || event_type || '","' || event_id || '","said ""' || event_type || repeat('"', 3) AS line FROM n),
  x AS (SELECT chr(65279) || 'time,actor,action,entity_id,summary' || chr(13) || chr(10) || string_agg(line, chr(13) || chr(10) ORDER BY t DESC, event_id DESC) AS text FROM l) SELECT length(text)::INTEGER AS n_chars, md5(text) AS digest FROM x""",
    "s16_catalog_sheet": """WITH l AS (SELECT *, CASE p_type WHEN 'ECONOMY' THEN 'Economy' WHEN 'PROMO' THEN 'Promotion' WHEN 'LARGE' THEN 'Large' ELSE p_type END AS category FROM part) SELECT p_partkey AS no, 'P-' || p_partkey AS code, p_name, CASE WHEN p_partkey % 4 <> 0 THEN p_brand END AS client, category, CASE WHEN p_partkey % 3 = 0 THEN category || ', Large' END AS tags, CASE WHEN p_partkey % 5 <> 0 THEN p_retailprice END AS budget, p_size + 2500 AS year FROM l""",
    "s17_result_sheets": _STATUS + """, x AS (SELECT l_suppkey, CASE WHEN reference IN ('mismatch', 'not_found') OR reference = 'match' AND s IN (1, 2, 3) THEN 'problem' WHEN reference = 'unverifiable' OR reference = 'match' AND (s = 4 OR s IN (0, 5) AND c <> 0) THEN 'recheck' ELSE 'clear' END AS level FROM r WHERE l_partkey % 11 <> 0)
  SELECT CASE WHEN grouping(l_suppkey) = 1 THEN 'total' ELSE 'item ' || l_suppkey END AS sheet, count(*) FILTER (level = 'clear') AS clear, count(*) FILTER (level = 'recheck') AS recheck, count(*) FILTER (level = 'problem') AS problem, count(*) AS "rows" FROM x GROUP BY GROUPING SETS ((l_suppkey), ())""",
    "s19_issue_list": _STATUS + " SELECT l_suppkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey)::INTEGER AS no, l_orderkey, l_linenumber, reference AS outcome, count(*) OVER (PARTITION BY l_suppkey, reference) AS n_outcome FROM r WHERE reference <> 'match'",
    "k13_labelled": r"""WITH l AS (SELECT l_orderkey AS job, l_linenumber AS n, min(l_partkey) AS p_partkey FROM lineitem GROUP BY 1, 2), x AS (SELECT job, n, (p_size % 3) || '.' || (n % 3) AS label, list_distinct(list_filter(regexp_split_to_array(lower(p_name || ' ' || p_type), '[^a-z0-9]+'), lambda w: length(w) >= 3)) AS q,
  list_distinct(list_filter(regexp_split_to_array(lower('see ' || (p_size % 3) || '.' || (n % 3) || ' ' || p_name || ' v1.2.3x ' || p_type), '[^a-z0-9]+'), lambda w: length(w) >= 3)) AS d FROM l JOIN part USING (p_partkey)),
  h AS (SELECT a.job, a.n AS row_id, b.n AS page, coalesce(a.n % 2 = 0 AND a.label = b.label, false) AS lab, len(list_intersect(a.q, b.d)) AS k, len(a.q) AS size FROM x a JOIN x b USING (job)), f AS (SELECT *, CASE WHEN size > 0 THEN k / size ELSE 0 END AS share FROM h WHERE lab OR k >= 2 AND k >= 0.6 * size),
  o AS (SELECT *, count(*) FILTER (lab) OVER (PARTITION BY job, row_id) = 1 AS certain, row_number() OVER (PARTITION BY job, row_id ORDER BY lab DESC, share DESC, page)::INTEGER AS place FROM f) SELECT job, row_id, place, page, CASE WHEN lab THEN 'label' ELSE 'value' END AS source, certain FROM o WHERE place <= 3""",
    "t22_references": "WITH g AS (SELECT l_orderkey, array_to_string(list_sort(list(DISTINCT l_linenumber)), ', ') AS p FROM lineitem GROUP BY 1) SELECT l_orderkey, CASE WHEN l_orderkey % 2 = 0 THEN 'เอกสารอ้างอิง' || chr(10) || 'Order-' || l_orderkey || chr(10) || 'หน้า ' || p ELSE 'Order-' || l_orderkey || ', page ' || p END AS reference FROM g",
}
