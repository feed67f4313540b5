"""Review rows, statuses, lists, look-ups and limits (F3, F8, F10, F12, F19, F23, F24, P4, P5, P11, P12, P15, J11, J15, O4, O5, O10-O13, S2, S6, S14, M5, T3, T4, V2, V6, W7, C9)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.places import global_places
from .search import contains_ci, table

# ---- review rows: axes, statuses and filters


def review_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A review row for each line of an order: axes, confidence, decision and verdict from its own values."""
    k = F.col("l_partkey")
    pick = lambda n, *values: F.get(F.array(*[F.lit(v) for v in values]), (k % n).cast("int"))
    reference = pick(5, "match", "mismatch", "not_found", "unverifiable", None)
    support = pick(7, "fully_supported", "not_supported", "wording_conflict", "unverifiable", "partially_supported", "fully_supported", None)
    rows = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", k, "l_suppkey", reference.alias("reference"), support.alias("support"), pick(3, "high", "medium", "low").alias("confidence"), pick(4, "compliant", "better", "", None).alias("decision")
    )
    verdict = F.when(k % 11 == 0, "heading").when(F.col("reference") == "mismatch", "fail").when(F.coalesce(F.col("reference"), F.lit("")) == "match", "ok").otherwise("review")
    return rows.withColumn("status", verdict)


def evidence_missing() -> Column:
    """No cited page was found, or it couldn't be read."""
    return F.coalesce(F.col("reference").isin("not_found", "unverifiable") | (F.col("support") == "unverifiable"), F.lit(False))


#: reference status -> level of severity
LEVELS = {
    **dict.fromkeys(("match", "not_applicable"), "clear"),
    **dict.fromkeys(("match_recheck", "match_incomplete", "unverifiable"), "recheck"),
    **dict.fromkeys(("match_not_stated", "match_conflict", "match_unseen", "mismatch", "not_found"), "problem"),
}


def reference_status() -> Column:
    """A matching page whose evidence isn't complete is no plain match."""
    support = F.col("support")
    match = (
        F.when(support == "not_supported", "match_not_stated")
        .when(support == "wording_conflict", "match_conflict")
        .when(support == "unverifiable", "match_unseen")
        .when(support == "partially_supported", "match_incomplete")
        .when((support == "fully_supported") & ~F.col("confidence").eqNullSafe(F.lit("high")), "match_recheck")
        .otherwise("match")
    )
    return F.when(F.col("reference") == "match", match).when(F.col("reference").isin("mismatch", "not_found", "unverifiable"), F.col("reference")).otherwise("not_applicable")


def p5_reference_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each reference status and level, and how many lack evidence."""
    status = review_rows(spark, sf_dir).withColumn("reference_status", reference_status())
    level = F.coalesce(*[F.when(F.col("reference_status") == k, v) for k, v in LEVELS.items()])
    return status.groupBy("reference_status", level.alias("level")).agg(F.count("*").alias("n"), F.count_if(evidence_missing()).alias("n_missing"))


def filter_review(rows: DataFrame, status: str | None = None, group: int | None = None, decision: str | None = None, missing: bool = False) -> DataFrame:
    """Chained filters; headings are never listed, and `undecided` is a decision that is null or blank."""
    out = rows.where("status <> 'heading'")
    if status:
        out = out.where(F.col("status") == status)
    if group is not None:
        out = out.where(F.col("l_suppkey") == group)
    if decision == "undecided":
        out = out.where("coalesce(decision, '') = ''")
    elif decision:
        out = out.where(F.col("decision") == decision)
    return out.where(evidence_missing()) if missing else out


def f12_review_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Undecided rows without evidence, fail before review before ok, then by row; and decided ones of one group."""
    rows = review_rows(spark, sf_dir)
    rank = F.array_position(F.array(F.lit("fail"), F.lit("review"), F.lit("ok")), F.col("status")).cast("int")
    lists = {"undecided": filter_review(rows, decision="undecided", missing=True), "group": filter_review(rows, group=7, decision="better")}
    parts = [df.select(F.lit(name).alias("list"), "l_orderkey", "l_linenumber", "l_partkey", "status", rank.alias("rank")) for name, df in lists.items()]
    w = Window.partitionBy("list", "l_orderkey").orderBy("rank", "l_linenumber", "l_partkey")
    return parts[0].unionByName(parts[1]).withColumn("place", F.row_number().over(w))


def f24_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines by outcome, each outcome an issue or clear by a fixed map, with the count of its chip."""
    issue = {"match": False, "not_applicable": False}
    rows = review_rows(spark, sf_dir).select(F.coalesce("reference", F.lit("not_applicable")).alias("outcome"))
    known = F.create_map(*[F.lit(x) for kv in issue.items() for x in kv])
    return rows.groupBy("outcome").agg(F.count("*").alias("n")).withColumn("issue", F.coalesce(F.try_element_at(known, F.col("outcome")), F.lit(True)))


def w7_next_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After each row, the next unsettled one of its order, wrapping round to the top."""
    rows = review_rows(spark, sf_dir).groupBy("l_orderkey", "l_linenumber").agg(F.max((F.coalesce("decision", F.lit("")) == "").cast("int")).alias("open"))
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber")
    at = F.when(F.col("open") == 1, F.col("l_linenumber"))
    ahead = F.first(at, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))
    top = F.first(at, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return rows.select("l_orderkey", "l_linenumber", F.coalesce(ahead, top).alias("next"))


def f23_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups to act on: failed, waiting for documents or a login, or checked with documents missing; skipped ones are hidden."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_set(F.when(F.col("l_returnflag") == "R", F.col("l_linenumber")))).alias("missing"))
    k = F.col("l_orderkey")
    state = F.get(F.array(*map(F.lit, ("checked", "failed", "needs_documents", "needs_login", "checked", "not_checked"))), (k % 6).cast("int"))
    rows = li.where(k % 10 != 3).select(k, state.alias("state"), F.size("missing").alias("n_missing"))
    waits = F.col("state").isin("failed", "needs_documents", "needs_login")
    return rows.withColumn("problem", waits | ((F.col("state") == "checked") & (F.col("n_missing") > 0)))


# ---- row types and evidence

#: The words that name a product's identity, those that a system's title ends with, and bounds on lengths.
IDENTITY = r"\b(model|รุ่น|ยี่ห้อ|brand|manufacturer|part\s*no)\b"
SYSTEM = r"(system|ระบบ|subsystem|module|equipment)\s*$"
SECTION_LENGTH, SYSTEM_LENGTH = 90, 180
#: row types in the order in which they are tried, each with its condition on what row_type() measures; the rest is content
ROW_TYPES = (
    ("section", lambda m: m["n_texts"] < 2),
    ("section", lambda m: ~m["numbered"] & ~m["digits"] & (m["length"] < SECTION_LENGTH)),
    ("identity", lambda m: m["names_product"]),
    ("system", lambda m: m["ends_as_system"] & (m["length"] < SYSTEM_LENGTH)),
)


def row_type(item: Column, text: Column, cells: Column) -> Column:
    """The first of ROW_TYPES that a row's measures meet."""
    words = F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))
    measures = {
        "n_texts": F.size(F.array_distinct(F.filter(cells, lambda c: F.length(c) > 0))),
        "numbered": F.length(F.coalesce(item, F.lit(""))) > 0,
        "digits": text.rlike(r"\d"),
        "length": F.length(text),
        "names_product": words.rlike(IDENTITY),
        "ends_as_system": words.rlike(SYSTEM),
    }
    return F.coalesce(*[F.when(holds(measures), name) for name, holds in ROW_TYPES], F.lit("content"))


def p11_row_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    tail = F.get(F.array(*map(F.lit, (" system", " Model X1", "", " 42 pieces", " power equipment "))), (k % 5).cast("int"))
    item, text = F.when(k % 3 == 0, "").otherwise(k.cast("string")), F.concat("p_name", tail)
    cells = F.when(k % 7 == 0, F.array("p_type", "p_type", F.lit(""))).otherwise(F.array("p_type", "p_name"))
    return table(spark, sf_dir, "part").select(k, row_type(item, text, cells).alias("row_type"))


def p12_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows against the text of their cited pages: headings, missing and unreadable pages, then overlap at .45, .60 and .25."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.min("text").alias("text"))
    words = lambda t: F.array_distinct(F.filter(F.split(F.lower(t), r"[^a-zà-ÿ]+"), lambda w: F.length(w) >= 3))
    w = Window.partitionBy("conv_id").orderBy("turn")
    r = c.select("conv_id", "turn", "text", F.lag("text").over(w).alias("page"))
    kind = F.when(F.col("turn") % 4 == 0, "section").when(F.col("turn") % 4 == 1, "identity").otherwise("content")
    share = F.size(F.array_intersect(words(F.col("text")), words(F.col("page")))) / F.greatest(F.lit(1), F.size(words(F.col("text"))))
    r = r.select("conv_id", "turn", kind.alias("kind"), "page", share.alias("share"))
    stopped = F.when(F.col("kind") == "section", "not_applicable").when(F.col("page").isNull(), "not_found").when(F.length("page") < 30, "unverifiable")
    return r.select(
        "conv_id", "turn", "kind",
        F.coalesce(stopped, F.when(F.col("share") >= 0.45, "match").otherwise("review")).alias("reference"),
        F.when(F.col("kind") != "identity", "not_applicable").when(stopped.isNotNull(), "unverifiable").otherwise(F.when(F.col("share") >= 0.6, "match").otherwise("unverifiable")).alias("product"),
        F.when(stopped == "not_applicable", "not_applicable").when(stopped.isNotNull(), "unverifiable").otherwise(F.when(F.col("share") >= 0.25, "related").otherwise("review")).alias("relevance"),
    )


def best_document(rows: DataFrame, documents: DataFrame) -> DataFrame:
    """rows (job, row_id, text) and documents (job, place, name): each row's document with most words in common, the first of equals.

    Words meet words within a job; a row that shares none has the job's first document."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != ""))
    asked = rows.select("job", "row_id", F.explode(words("text")).alias("word"))
    index = documents.select("job", "place", F.explode(words("name")).alias("word"))
    hits = asked.join(index, ["job", "word"]).groupBy("job", "row_id", "place").agg(F.count("*").alias("n"))
    best = hits.groupBy("job", "row_id").agg(F.max_by("place", F.struct("n", -F.col("place"))).alias("place"), F.max("n").alias("n"))
    first = documents.groupBy("job").agg(F.min("place").alias("first"))
    return rows.select("job", "row_id").join(best, ["job", "row_id"], "left").join(first, "job").select("job", "row_id", F.coalesce("place", "first").alias("place"), F.coalesce("n", F.lit(0)).alias("n"))


def j11_best_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each order, which of its parts' names is most like the words of each line's part (shifted by one)."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p_partkey")).join(p, "p_partkey")
    rows = li.select(F.col("l_orderkey").alias("job"), F.col("l_linenumber").alias("row_id"), F.concat_ws(" ", "p_name", "p_type").alias("text"))
    docs = li.where("l_linenumber > 2 OR l_linenumber = 1").select(F.col("l_orderkey").alias("job"), F.col("l_linenumber").alias("place"), F.col("p_name").alias("name"))
    return best_document(rows, docs)


# ---- look-ups, terms, option lists


def s2_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row of one unique key: the filter reaches the scan."""
    return table(spark, sf_dir, "part").where("p_partkey = 42").select("p_partkey", "p_name", "p_brand")


#: Destinations with a set price (name, km, price).
DESTINATIONS = [
    ("NT (TOT) สนญ.", 11, 95), ("ชุมสายฯ กรุงเกษม", 22, 190), ("ชุมสายฯ พระโขนง", 25, 215), ("NT (CAT) สนญ.", 13, 115), ("ศูนย์โทรคมฯ บางรัก", 25, 215), ("ศูนย์โทรคมฯ นนทบุรี", 14, 120),
    ("PEA สนญ.", 12, 105), ("MEA สนญ.", 23, 200), ("MEA เพลินจิต", 26, 225), ("MEA วัดเลียบ", 25, 215), ("MEA ราษฎร์บูรณะ", 32, 275), ("EGAT สนญ. บางกรวย", 18, 155), ("SVOA สนญ. พระราม 3", 27, 230),
    ("AIT สนญ. สุทธิสารวินิจฉัย", 12, 105), ("FORTH สนญ. พญาไท", 16, 140), ("Wire & Wireless ห้วยขวาง", 12, 105), ("Nokia คลังสินค้า  บางนา-ตราด", 16, 140), ("DBD สนามบินน้ำ", 20, 170), ("สพร.กทม. 2", 16, 140),
    ("สรรพากร กทม. 8", 6, 55), ("สรรพากร ลาดพร้าว", 5, 45), ("สสค.กทม. 4", 7, 60),
]


def p15_fixed_fares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set prices of trips by destination; a trip to no listed place has none."""
    fares = F.broadcast(spark.createDataFrame([(i, *d) for i, d in enumerate(DESTINATIONS)], "i long, name string, km int, price int"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 30).alias("i"))
    return o.join(fares, "i", "left").select("o_orderkey", "name", "km", "price")


#: value, English label, Thai label, synonyms of a small dictionary
TERMS = [
    ("fiber", "Fiber Optic", "ใยแก้วนำแสง", ("fibre", "ไฟเบอร์")),
    ("smart", "Smart City", "เมืองอัจฉริยะ", ()),
    ("ma", "MA", "บำรุงรักษา", ("maintenance", "ซ่อมบำรุง")),
    ("managed", "Managed Services", "บริการจัดการ", ("managed service",)),
    ("rent", "Rental", "เช่า", ("lease",)),
]


def term_matches(query: Column, en: Column, th: Column, synonyms: Column, whole: bool) -> Column:
    """Thai asks match anywhere in the Thai label or a synonym; Latin ones the beginning of the English label, a synonym or a word of it.

    whole (work types): asks below three letters must be a whole word or the whole label."""
    q = F.trim(F.lower(query))
    thai = q.rlike("[\\u0E00-\\u0E7F]")

    def latin(text: Column) -> Column:
        word = lambda w: F.startswith(w, q) & (F.lit(not whole) | (w == q) | (F.length(q) >= 3))
        label = (text == q) if whole else F.startswith(text, q)
        return label | F.exists(F.split(text, "[^a-z0-9]+"), word)

    labels = F.transform(F.concat(F.array(F.when(thai, th).otherwise(en)), synonyms), F.lower)
    return (q != "") & F.exists(labels, lambda t: F.when(thai, F.contains(t, q)).otherwise(latin(t)))


def f3_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Asks against the dictionary as categories and as work types, and the parts that a category's type or a tag finds."""
    asks = spark.createDataFrame([(a,) for a in ("fib", "MA", "mart", "city", "manag", "re", "rent", "แก้ว", "บำรุง", "managed service", "service", "", "lease", "ma")], "ask string")
    terms = F.broadcast(spark.createDataFrame([(v, en, th, list(s)) for v, en, th, s in TERMS], "value string, en string, th string, synonyms array<string>"))
    both = [asks.join(terms, term_matches(F.col("ask"), F.col("en"), F.col("th"), F.col("synonyms"), whole)).select("ask", F.lit(kind).alias("kind"), "value") for kind, whole in (("category", False), ("work type", True))]
    return both[0].unionByName(both[1])


def f3_expanded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A keyword finds rows by their text, or by a category or tag that it names."""
    p = table(spark, sf_dir, "part").withColumn("tags", F.when(F.col("p_size") % 4 == 0, F.array(F.lit("PROMO"))).otherwise(F.array(F.lit("LARGE"))))
    named = ["PROMO", "SMALL"]
    return p.where(contains_ci(F.col("p_name"), "blue") | F.col("p_type").isin(*named) | F.arrays_overlap("tags", F.array(*map(F.lit, named)))).select("p_partkey")


def f8_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards that have all the ticked documents (F8): by tick list, how many."""
    k = F.col("p_partkey")
    p = table(spark, sf_dir, "part").select(k, F.when(k % 2 == 0, "/c").alias("contract"), F.when(k % 3 == 0, "/w").alias("certificate"), F.when(k % 5 == 0, "/f").alias("folder"))
    ticks = [("contract",), ("contract", "certificate"), ("contract", "certificate", "folder")]
    tests = [F.when(F.expr(" AND ".join(f"{c} IS NOT NULL" for c in t)), "+".join(t)) for t in ticks]
    return p.select(k, F.explode(F.array_compact(F.array(*tests))).alias("ticked")).groupBy("ticked").agg(F.count("*").alias("n"), F.max("p_partkey").alias("last"))


def f19_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The options of a picker that hold the typed text, in any case."""
    return table(spark, sf_dir, "customer").where(contains_ci(F.col("c_name"), "R#0000000")).select("c_custkey", "c_name")


def s6_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archive folders: below a client stands a project (known by a marker folder in it) or a year of projects; the rest is skipped."""
    k = F.col("p_partkey")
    client = F.concat(F.lit("/_Project 2015-2020/"), "p_brand")
    path = F.when(k % 4 == 0, F.concat(client, F.lit("/"), (2010 + k % 9).cast("string"), F.lit("/job "), k.cast("string"))).when(k % 4 == 1, F.concat(client, F.lit("/work "), (k % 50).cast("string"), F.lit("/_TOR"))).when(k % 4 == 2, F.concat(client, F.lit("/work "), (k % 70).cast("string"), F.lit("/Proposal old"))).otherwise(F.concat(client, F.lit("/notes "), (k % 60).cast("string"), F.lit("/mail")))
    parts = table(spark, sf_dir, "part").select(F.split(path, "/").alias("s"))
    year = F.expr("try_cast(regexp_extract(s[3], '^(\\\\d{4})$', 1) AS int)")
    marker = F.lower(F.col("s")[4]).rlike("^(_tor|proposal)")
    rows = parts.select(F.col("s")[1].alias("archive"), F.col("s")[2].alias("client"), F.col("s")[3].alias("folder"), F.when(year.isNotNull(), F.col("s")[4]).alias("inner"), year.alias("year"), marker.alias("marker"))
    hint = F.expr("try_cast(regexp_extract(archive, '(\\\\d{4})', 1) AS int)")
    seen = rows.groupBy("archive", "client", "folder", "inner", "year").agg(F.max("marker").alias("marked"))
    kind = F.when(F.col("year").isNotNull(), "year/project").when(F.col("marked"), "project").otherwise("skipped")
    return seen.select("client", F.coalesce("inner", "folder").alias("project"), kind.alias("layout"), F.when(kind == "skipped", None).otherwise(F.coalesce("year", hint)).alias("year_hint"))


def s14_usable_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's text, if it has 200 characters or more that say something."""
    text = F.regexp_replace("text", r"^\s+|\s+$", "")
    return table(spark, sf_dir, "documents").select("doc_id", F.when(F.length(text) >= 200, F.length(text)).alias("usable"))


def m5_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A positive number, and a whole number of years from 1 to 50; null for anything else (M5)."""
    v = F.col("value") - 20
    years = F.floor(v) + F.when(F.col("event_id") % 3 == 0, 0.5).otherwise(0)
    return table(spark, sf_dir, "events").select("event_id", F.when(v > 0, v).alias("positive"), F.when((years == F.floor(years)) & years.between(1, 50), years.cast("int")).alias("years"))


# ---- orders of rows


def o5_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest 200 entries."""
    return table(spark, sf_dir, "orders").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(200).select("o_orderkey", "o_orderdate")


def o10_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of each list in their set order, then by age (O10): places in all lists, less those of the lists before."""
    p = table(spark, sf_dir, "part").select("p_type", "p_partkey", "p_size")
    placed = global_places(p, F.col("p_type"), F.col("p_size"), F.col("p_partkey"))
    first = placed.groupBy(F.col("p_type").alias("t")).agg(F.min("place").alias("first"))
    return placed.join(first, F.col("p_type").eqNullSafe(F.col("t"))).select("p_type", "p_partkey", (F.col("place") - F.col("first") + 1).alias("place"))


def o12_number_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dotted numbers by their parts, so that 5.10 follows 5.9."""
    path = F.concat_ws(".", F.col("l_suppkey") % 12, "l_linenumber", F.col("l_partkey") % 15)
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", path.alias("path")).distinct()
    w = Window.partitionBy("l_orderkey").orderBy(F.split("path", r"\.").cast("array<int>"))
    return li.select("l_orderkey", "path", F.row_number().over(w).alias("place"))


def o13_pick_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A person's saved names: the last of each name stands, in the order of the Thai dictionary."""
    names = F.array(*map(F.lit, ("เกม", "กบ", "แกง", "ไก่", "ข้าว", "กา", "ขาว", "beta", "Alpha", "เขา")))
    e = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.get(names, (F.col("event_id") % 10).cast("int")).alias("name"))
    last = e.groupBy("user_id", "name").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))
    w = Window.partitionBy("user_id").orderBy(F.collate("name", "th"), "name")
    return last.select("user_id", "name", "event_id", F.row_number().over(w).alias("place"))


# ---- limits, trash, runs


def f10_trash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live, trashed, restored and purge-due rows, and the 20 that the next batch purges, the longest due first (F10, O11, DML4, D6)."""
    k = F.col("event_id")
    e = table(spark, sf_dir, "events").select(k, F.when(k % 3 == 0, F.col("ts")).alias("deleted"), F.when(k % 12 == 0, F.col("ts") + F.expr("INTERVAL 1 DAY")).alias("restored"))
    gone = F.col("deleted").isNotNull() & F.col("restored").isNull()
    due = gone & (F.col("deleted") + F.expr("INTERVAL 30 DAYS") <= F.lit("2024-02-02").cast("timestamp"))
    state = F.when(F.col("deleted").isNull(), "live").when(F.col("restored").isNotNull(), "restored").when(due, "due").otherwise("trashed")
    rows = e.withColumn("state", state)
    batch = rows.where("state = 'due'").orderBy("deleted", "event_id").limit(20).agg(F.max("event_id").alias("last_purged"), F.count("*").alias("n_purged"))
    return rows.groupBy("state").agg(F.count("*").alias("n")).join(F.broadcast(batch), F.lit(True))


def j15_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of a log that neither of two tables refers to."""
    known = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("user_id")).unionByName(table(spark, sf_dir, "customer").where("c_acctbal > 5000").select(F.col("c_custkey").alias("user_id")))
    return table(spark, sf_dir, "events").select("user_id").distinct().join(known, "user_id", "left_anti")


MOST_ERRORS = 50


def v2_run_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All that is wrong with an order's lines, repeated line numbers too, at most 50 and a note of the rest (V2)."""
    li = table(spark, sf_dir, "lineitem")
    checks = [("price", F.col("l_extendedprice") > 90000), ("tax", F.col("l_tax") > 0.07), ("flag", F.col("l_returnflag") == "A")]
    found = F.array_compact(F.array(*[F.when(c, F.concat(F.col("l_linenumber").cast("string"), F.lit(f" {n}"))) for n, c in checks]))
    each = li.select("l_orderkey", F.explode(found).alias("e"))
    twice = li.groupBy("l_orderkey", "l_linenumber").count().where("count > 1").select("l_orderkey", F.concat(F.col("l_linenumber").cast("string"), F.lit(" repeated")).alias("e"))
    errors = each.unionByName(twice).groupBy("l_orderkey").agg(F.sort_array(F.collect_list("e")).alias("e"))
    note = F.when(F.size("e") > MOST_ERRORS, F.concat(F.lit("; and "), (F.size("e") - MOST_ERRORS).cast("string"), F.lit(" more"))).otherwise("")
    return errors.select("l_orderkey", F.concat(F.array_join(F.slice("e", 1, MOST_ERRORS), "; "), note).alias("errors"))


#: Limits of a selection of files.
MOST_FILES, MOST_FILE_BYTES, MOST_BYTES = 200, 120 << 20, 1 << 30


def v6_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first limit that a chosen set of files breaks: none chosen, too many, one too large, all too large (V6)."""
    size = (F.col("l_quantity") * 3_000_000).cast("long")
    files = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count_if(F.col("l_returnflag") == "A").alias("chosen"), F.max(F.when(F.col("l_returnflag") == "A", size)).alias("largest"), F.sum(F.when(F.col("l_returnflag") == "A", size)).alias("bytes"), F.count_if(F.col("l_returnflag") == "R").alias("there"))
    problem = F.when(F.col("chosen") < 1, "none").when(F.col("there") + F.col("chosen") > MOST_FILES, "count").when(F.col("largest") > MOST_FILE_BYTES, "file").when(F.col("bytes") > MOST_BYTES, "total").otherwise("")
    return files.select("l_suppkey", "chosen", problem.alias("problem"))


def c9_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is shown of a document while it is read: after every fifth page and at the end, the rows so far."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, sf_dir, "events").select("user_id", F.row_number().over(w).alias("page"), F.count("*").over(Window.partitionBy("user_id")).alias("pages"), F.sum(F.when(F.col("event_type") != "error", 1).otherwise(0)).over(w).alias("rows_so_far"))
    return e.where((F.col("page") % 5 == 0) | (F.col("page") == F.col("pages"))).select("user_id", "page", "rows_so_far")


QUERIES = {f.__name__: f for f in (p5_reference_status, f12_review_list, f24_outcomes, w7_next_row, f23_groups, p11_row_types, p12_review, j11_best_document, s2_lookup, p15_fixed_fares, f3_terms, f3_expanded, f8_documents, f19_options, s6_layout, s14_usable_text, m5_guards, o5_newest, o10_dictionary, o12_number_paths, o13_pick_lists, f10_trash, j15_orphans, v2_run_errors, v6_selection, c9_partial)}
_R = """WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, (['match', 'mismatch', 'not_found', 'unverifiable', NULL])[l_partkey % 5 + 1] AS reference,
  (['fully_supported', 'not_supported', 'wording_conflict', 'unverifiable', 'partially_supported', 'fully_supported', NULL])[l_partkey % 7 + 1] AS support, (['high', 'medium', 'low'])[l_partkey % 3 + 1] AS confidence, (['compliant', 'better', '', NULL])[l_partkey % 4 + 1] AS decision,
  coalesce((['match', 'mismatch', 'not_found', 'unverifiable', NULL])[l_partkey % 5 + 1] IN ('not_found', 'unverifiable') OR (['fully_supported', 'not_supported', 'wording_conflict', 'unverifiable', 'partially_supported', 'fully_supported', NULL])[l_partkey % 7 + 1] = 'unverifiable', false) AS missing,
  CASE WHEN l_partkey % 11 = 0 THEN 'heading' WHEN l_partkey % 5 = 1 THEN 'fail' WHEN l_partkey % 5 = 0 THEN 'ok' ELSE 'review' END AS status FROM lineitem)"""
_DEST = ", ".join(f"({i}, '{n}', {km}, {price})" for i, (n, km, price) in enumerate(DESTINATIONS))
_TERMS = ", ".join(f"('{v}', '{en.lower()}', '{th}', {list(s)})" for v, en, th, s in TERMS)
_WORDS = "list_distinct(list_filter(regexp_split_to_array(lower({}), '[^a-zà-ÿ]+'), lambda w: length(w) >= 3))"
SQL = {
    "p5_reference_status": _R + """ SELECT s AS reference_status, CASE WHEN s IN ('match', 'not_applicable') THEN 'clear' WHEN s IN ('match_recheck', 'match_incomplete', 'unverifiable') THEN 'recheck' ELSE 'problem' END AS level, count(*) AS n, count(*) FILTER (missing) AS n_missing
  FROM (SELECT *, CASE WHEN reference = 'match' THEN CASE support WHEN 'not_supported' THEN 'match_not_stated' WHEN 'wording_conflict' THEN 'match_conflict' WHEN 'unverifiable' THEN 'match_unseen' WHEN 'partially_supported' THEN 'match_incomplete' WHEN 'fully_supported' THEN CASE WHEN confidence = 'high' THEN 'match' ELSE 'match_recheck' END ELSE 'match' END ELSE coalesce(reference, 'not_applicable') END AS s FROM r) GROUP BY 1, 2""",
    "f12_review_list": _R + """, l AS (SELECT 'undecided' AS list, * FROM r WHERE status <> 'heading' AND coalesce(decision, '') = '' AND missing UNION ALL SELECT 'group', * FROM r WHERE status <> 'heading' AND l_suppkey = 7 AND decision = 'better'), k AS (SELECT *, CASE status WHEN 'fail' THEN 1 WHEN 'review' THEN 2 ELSE 3 END AS rank FROM l)
  SELECT list, l_orderkey, l_linenumber, l_partkey, status, rank, row_number() OVER (PARTITION BY list, l_orderkey ORDER BY rank, l_linenumber, l_partkey)::INTEGER AS place FROM k""",
    "f24_outcomes": _R + " SELECT coalesce(reference, 'not_applicable') AS outcome, count(*) AS n, coalesce(reference, 'not_applicable') NOT IN ('match', 'not_applicable') AS issue FROM r GROUP BY 1, 3",
    "w7_next_row": _R + ", g AS (SELECT l_orderkey, l_linenumber, bool_or(coalesce(decision, '') = '') AS o FROM r GROUP BY 1, 2) SELECT l_orderkey, l_linenumber, coalesce((SELECT min(x.l_linenumber) FROM g x WHERE x.o AND x.l_orderkey = g.l_orderkey AND x.l_linenumber > g.l_linenumber), (SELECT min(x.l_linenumber) FROM g x WHERE x.o AND x.l_orderkey = g.l_orderkey AND x.l_linenumber < g.l_linenumber)) AS next FROM g",
    "f23_groups": "WITH g AS (SELECT l_orderkey, (['checked', 'failed', 'needs_documents', 'needs_login', 'checked', 'not_checked'])[l_orderkey % 6 + 1] AS state, count(DISTINCT l_linenumber) FILTER (l_returnflag = 'R')::INTEGER AS n_missing FROM lineitem WHERE l_orderkey % 10 <> 3 GROUP BY 1) SELECT *, state IN ('failed', 'needs_documents', 'needs_login') OR state = 'checked' AND n_missing > 0 AS problem FROM g",
    "p11_row_types": r"WITH p AS (SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE 'x' END AS item, p_name || ([' system', ' Model X1', '', ' 42 pieces', ' power equipment '])[p_partkey % 5 + 1] AS t, p_partkey % 7 = 0 OR p_type = p_name AS one FROM part) SELECT p_partkey, CASE WHEN one OR item = '' AND length(t) < 90 AND NOT regexp_matches(t, '\d') THEN 'section' WHEN regexp_matches(lower(t), '\b(model|brand|manufacturer|part\s*no)\b') THEN 'identity' WHEN regexp_matches(trim(lower(t)), '(system|subsystem|module|equipment)$') THEN 'system' ELSE 'content' END AS row_type FROM p",
    "p12_review": f"""WITH c AS (SELECT conv_id, turn, min(text) AS text FROM conversations GROUP BY 1, 2), r AS (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS page, CASE turn % 4 WHEN 0 THEN 'section' WHEN 1 THEN 'identity' ELSE 'content' END AS kind FROM c),
  s AS (SELECT *, len(list_intersect({_WORDS.format("text")}, {_WORDS.format("page")})) / greatest(1, len({_WORDS.format("text")})) AS share, CASE WHEN kind = 'section' THEN 'not_applicable' WHEN page IS NULL THEN 'not_found' WHEN length(page) < 30 THEN 'unverifiable' END AS stop FROM r)
  SELECT conv_id, turn, kind, coalesce(stop, CASE WHEN share >= 0.45 THEN 'match' ELSE 'review' END) AS reference, CASE WHEN kind <> 'identity' THEN 'not_applicable' WHEN stop IS NULL AND share >= 0.6 THEN 'match' ELSE 'unverifiable' END AS product,
  CASE WHEN stop = 'not_applicable' THEN stop WHEN stop IS NOT NULL THEN 'unverifiable' WHEN share >= 0.25 THEN 'related' ELSE 'review' END AS relevance FROM s""",
    "j11_best_document": r"""WITH l AS (SELECT l_orderkey AS job, l_linenumber AS row_id, min(l_partkey) AS p_partkey FROM lineitem GROUP BY 1, 2), r AS (SELECT job, row_id, p_name, list_distinct(regexp_split_to_array(lower(p_name || ' ' || p_type), '\s+')) AS w, list_distinct(regexp_split_to_array(lower(p_name), '\s+')) AS d FROM l JOIN part USING (p_partkey)),
  k AS (SELECT a.job, a.row_id, b.row_id AS place, len(list_intersect(a.w, b.d)) AS n FROM r a JOIN r b ON a.job = b.job AND b.row_id <> 2), x AS (SELECT *, row_number() OVER (PARTITION BY job, row_id ORDER BY n DESC, place) AS i FROM k) SELECT job, row_id, place, n::BIGINT AS n FROM x WHERE i = 1""",
    "s2_lookup": "SELECT p_partkey, p_name, p_brand FROM part WHERE p_partkey = 42",
    "p15_fixed_fares": f"SELECT o_orderkey, name, km, price FROM orders LEFT JOIN (VALUES {_DEST}) v(i, name, km, price) ON o_orderkey % 30 = i",
    "f3_terms": f"""WITH a AS (SELECT unnest(['fib', 'MA', 'mart', 'city', 'manag', 're', 'rent', 'แก้ว', 'บำรุง', 'managed service', 'service', '', 'lease', 'ma']) AS ask), t AS (SELECT * FROM (VALUES {_TERMS}) v(value, en, th, synonyms)),
  j AS (SELECT ask, lower(ask) AS q, value, unnest(list_concat([CASE WHEN regexp_matches(ask, '[฀-๿]') THEN th ELSE en END], synonyms::VARCHAR[])) AS label FROM a, t WHERE ask <> ''),
  w AS (SELECT ask, value, CASE WHEN regexp_matches(q, '[฀-๿]') THEN contains(label, q) ELSE starts_with(label, q) OR len(list_filter(regexp_split_to_array(label, '[^a-z0-9]+'), lambda x: starts_with(x, q))) > 0 END AS c,
  CASE WHEN regexp_matches(q, '[฀-๿]') THEN contains(label, q) ELSE label = q OR len(list_filter(regexp_split_to_array(label, '[^a-z0-9]+'), lambda x: x = q OR length(q) >= 3 AND starts_with(x, q))) > 0 END AS k FROM j)
  SELECT DISTINCT ask, 'category' AS kind, value FROM w WHERE c UNION ALL SELECT DISTINCT ask, 'work type', value FROM w WHERE k""",
    "f3_expanded": "SELECT p_partkey FROM part WHERE contains(lower(p_name), 'blue') OR p_type IN ('PROMO', 'SMALL') OR p_size % 4 = 0",
    "f8_documents": "SELECT t AS ticked, count(*) AS n, max(p_partkey) AS last FROM (SELECT p_partkey, unnest(list_filter([CASE WHEN p_partkey % 2 = 0 THEN 'contract' END, CASE WHEN p_partkey % 6 = 0 THEN 'contract+certificate' END, CASE WHEN p_partkey % 30 = 0 THEN 'contract+certificate+folder' END], lambda x: x IS NOT NULL)) AS t FROM part) GROUP BY 1",
    "f19_options": "SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_name), 'r#0000000')",
    "s6_layout": "WITH p AS (SELECT p_brand AS client, p_partkey % 4 AS m, p_partkey AS k FROM part) SELECT DISTINCT client, CASE m WHEN 0 THEN 'job ' || k WHEN 1 THEN 'work ' || (k % 50) WHEN 2 THEN 'work ' || (k % 70) ELSE 'notes ' || (k % 60) END AS project, CASE m WHEN 0 THEN 'year/project' WHEN 3 THEN 'skipped' ELSE 'project' END AS layout, CASE m WHEN 0 THEN (2010 + k % 9)::INTEGER WHEN 3 THEN NULL ELSE 2015 END AS year_hint FROM p",
    "s14_usable_text": r"SELECT doc_id, CASE WHEN length(regexp_replace(text, '^\s+|\s+$', '', 'g')) >= 200 THEN length(regexp_replace(text, '^\s+|\s+$', '', 'g'))::INTEGER END AS usable FROM documents",
    "m5_guards": "WITH e AS (SELECT event_id, value - 20 AS v, floor(value - 20) + CASE WHEN event_id % 3 = 0 THEN 0.5 ELSE 0 END AS y FROM events) SELECT event_id, CASE WHEN v > 0 THEN v END AS positive, CASE WHEN y = floor(y) AND y BETWEEN 1 AND 50 THEN y::INTEGER END AS years FROM e",
    "o5_newest": "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 200",
    "o10_dictionary": "SELECT p_type, p_partkey, row_number() OVER (PARTITION BY p_type ORDER BY p_size, p_partkey) AS place FROM part",
    "o12_number_paths": "WITH l AS (SELECT DISTINCT l_orderkey, (l_suppkey % 12) AS a, l_linenumber AS b, l_partkey % 15 AS c FROM lineitem) SELECT l_orderkey, a || '.' || b || '.' || c AS path, row_number() OVER (PARTITION BY l_orderkey ORDER BY a, b, c)::INTEGER AS place FROM l",
    "f10_trash": "WITH e AS (SELECT event_id, ts, CASE WHEN event_id % 3 <> 0 THEN 'live' WHEN event_id % 12 = 0 THEN 'restored' WHEN ts + INTERVAL 30 DAY <= TIMESTAMP '2024-02-02' THEN 'due' ELSE 'trashed' END AS state FROM events), b AS (SELECT * FROM e WHERE state = 'due' ORDER BY ts, event_id LIMIT 20) SELECT state, count(*) AS n, (SELECT max(event_id) FROM b) AS last_purged, (SELECT count(*) FROM b) AS n_purged FROM e GROUP BY 1",
    "j15_orphans": "SELECT DISTINCT user_id FROM events WHERE user_id NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT c_custkey FROM customer WHERE c_acctbal > 5000)",
    "v2_run_errors": "WITH e AS (SELECT l_orderkey, unnest(list_filter([CASE WHEN l_extendedprice > 90000 THEN l_linenumber || ' price' END, CASE WHEN l_tax > 0.07 THEN l_linenumber || ' tax' END, CASE WHEN l_returnflag = 'A' THEN l_linenumber || ' flag' END], lambda x: x IS NOT NULL)) AS e FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber || ' repeated' FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1), g AS (SELECT l_orderkey, list_sort(list(e)) AS e FROM e GROUP BY 1) SELECT l_orderkey, array_to_string(e[1:50], '; ') || CASE WHEN len(e) > 50 THEN '; and ' || (len(e) - 50) || ' more' ELSE '' END AS errors FROM g",
    "v6_selection": "WITH g AS (SELECT l_suppkey, count(*) FILTER (l_returnflag = 'A') AS chosen, max((l_quantity * 3000000)::BIGINT) FILTER (l_returnflag = 'A') AS largest, sum((l_quantity * 3000000)::BIGINT) FILTER (l_returnflag = 'A') AS b, count(*) FILTER (l_returnflag = 'R') AS there FROM lineitem GROUP BY 1) SELECT l_suppkey, chosen, CASE WHEN chosen < 1 THEN 'none' WHEN there + chosen > 200 THEN 'count' WHEN largest > 125829120 THEN 'file' WHEN b > 1073741824 THEN 'total' ELSE '' END AS problem FROM g",
    "c9_partial": "WITH e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)::INTEGER AS page, count(*) OVER (PARTITION BY user_id) AS pages, count(*) FILTER (event_type <> 'error') OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rows_so_far FROM events) SELECT user_id, page, rows_so_far FROM e WHERE page % 5 = 0 OR page = pages",
}
