"""Expense records, versions, queues, dictionaries and logs (A2, A3, A17, A22, A24, C4, C5, C8, D6, DML4, DML7, F11, O3, P9, P10, P13, S4, S12, S20, S22, T6, T27, U2, V4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from .search import contains_ci, table

# ---- expense records

AMOUNTS = ("gasoline", "hotel", "entertain", "mobile", "transport", "other", "local")


def _expense_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of records with seven amounts as people type them: text, blanks and trailing units."""
    base, k = F.col("l_quantity"), F.col("l_partkey")
    whole = base.cast("int").cast("string")
    typed = [F.when((k + i) % 4 == 0, "").when((k + i) % 4 == 1, F.concat(whole, F.lit(" baht"))).when((k + i) % 4 == 2, F.lit(None)).otherwise(F.concat(whole, F.lit(".5"))) for i in range(len(AMOUNTS))]
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("record"), *[t.alias(n) for t, n in zip(typed, AMOUNTS)])


def a3_column_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven column totals and the grand total of the row totals for each record; a record without lines has zeros (A2, A3)."""
    lines = _expense_lines(spark, sf_dir)
    row_total = sum((S.number(F.col(c)) for c in AMOUNTS[1:]), S.number(F.col(AMOUNTS[0])))
    sums = lines.groupBy("record").agg(*[F.sum(S.number(F.col(c))).alias(c) for c in AMOUNTS], F.sum(row_total).alias("total"))
    # one of ten records has lost its lines
    records = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("record"))
    kept = sums.where("record % 10 <> 4")
    return records.join(kept, "record", "left").select("record", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in (*AMOUNTS, "total")])


#: The month names of the record form, in order.
MONTHS = ("มกราคม", "กุมภาพันธ์", "มีนาคม", "เมษายน", "พฤษภาคม", "มิถุนายน", "กรกฎาคม", "สิงหาคม", "กันยายน", "ตุลาคม", "พฤศจิกายน", "ธันวาคม")


def o3_record_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of one type by each of two sorts, total and month of the year, on top of newest first."""
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'")
    names = F.array(*map(F.lit, MONTHS))
    name = F.get(names, F.month("o_orderdate") - 1)
    w = Window.partitionBy("o_custkey")
    stable = [F.desc("o_orderdate"), F.desc("o_orderkey")]
    by_total = F.row_number().over(w.orderBy(F.desc("o_totalprice"), *stable))
    by_month = F.row_number().over(w.orderBy(F.year("o_orderdate"), F.array_position(names, name), *stable))
    return o.select("o_custkey", "o_orderkey", name.alias("month"), by_total.alias("by_total"), by_month.alias("by_month"))


# ---- versions, steps, queues


def a24_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest run of each version (one without a run has no row), and how many of its rows are undecided."""
    e = table(spark, sf_dir, "events")
    runs = e.groupBy("user_id", F.to_date("ts").alias("version")).agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("latest"), F.count_if(F.col("event_type") == "error").alias("undecided"), F.count("*").alias("rows"))
    return runs


def p10_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a customer's check stands: done, doing, stale (only an older job got there, or the source changed since) or todo (P10)."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    now = F.max_by(F.struct("o_orderkey", "o_orderstatus", "o_totalprice"), F.struct("o_orderdate", "o_orderkey"))
    facts = o.groupBy("o_custkey").agg(now.alias("now"), F.max_by("o_orderkey", F.when(F.col("o_orderstatus") == "F", F.struct("o_orderdate", "o_orderkey"))).alias("ready"))
    changed = F.col("now.o_totalprice") > 400_000
    reached = F.when(F.col("now.o_orderstatus") == "F", "done").when(F.col("now.o_orderstatus") == "P", "doing")
    status = F.when(reached.isNotNull() & changed, "stale").when(reached.isNotNull(), reached).when(F.col("ready").isNotNull(), "stale").otherwise("todo")
    stale = F.when(reached.isNotNull() & changed, F.col("now.o_orderkey")).when(reached.isNull(), F.col("ready"))
    return facts.select("o_custkey", status.alias("status"), stale.alias("stale_job"))


#: state of a request -> states that may follow it
NEXT = {"requested": ("running", "cancelled"), "running": ("done", "failed", "paused_quota", "needs_login", "needs_documents"), "paused_quota": ("running",), "needs_login": ("running",)}
OPEN = ("requested", "running", "paused_quota", "needs_login")


def c5_replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of reported states replayed for each request: a report that may not follow the last taken one is passed over.

    The fold over a request's ordered reports keeps only its state."""
    kinds = F.create_map(*[F.lit(x) for kv in (("view", "running"), ("click", "done"), ("signup", "paused_quota"), ("error", "failed"), ("purchase", "needs_login")) for x in kv])
    e = table(spark, sf_dir, "events").select("user_id", F.struct("ts", "event_id", F.try_element_at(kinds, F.col("event_type")).alias("state")).alias("r"))
    logs = e.groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list("r")), lambda x: x["state"]).alias("log"))
    allowed = F.create_map(*[F.lit(f"{a}>{b}") if i == 0 else F.lit(True) for a, after in NEXT.items() for b in after for i in (0, 1)])
    last = F.aggregate("log", F.lit("requested"), lambda s, x: F.when(F.coalesce(F.try_element_at(allowed, F.concat(s, F.lit(">"), x)), F.lit(False)), x).otherwise(s))
    return logs.select("user_id", last.alias("state"), last.isin(*OPEN).alias("is_open"))


def c4_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who a runner would claim: its own running request first, else the oldest that waits; and how many wait."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", F.when(F.col("event_id") % 7 == 0, "running").when(F.col("event_type") == "error", "failed").otherwise("requested").alias("state"))
    runners = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("runner"))
    own = e.where("state = 'running'").groupBy(F.col("user_id").alias("runner")).agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("own"))
    head = e.where("state = 'requested'").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("head"), F.count("*").alias("waiting"))
    return runners.join(own, "runner", "left").join(F.broadcast(head), F.lit(True)).select("runner", F.coalesce("own", "head").alias("claimed"), "waiting")


def c8_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each retention removes at a moment: 30 days of trash, 90 of checks, 730 of the log."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", F.get(F.array(F.lit(30), F.lit(90), F.lit(730)), (F.col("o_orderkey") % 3).cast("int")).alias("days"))
    until = F.date_add(F.to_date("o_orderdate"), F.col("days"))
    return o.groupBy("days").agg(F.count_if(until <= F.to_date(F.lit("2000-01-01"))).alias("removed"), F.count_if(until > F.to_date(F.lit("2000-01-01"))).alias("kept"), F.max(until).alias("last_day"))


# ---- changes, dictionaries, logs


def field_changes(old: Column, new: Column, fields: tuple[str, ...]) -> Column:
    """array of (field, was, now) of the fields whose trimmed text differs, null and null alike."""
    pairs = [F.struct(F.lit(f).alias("field"), old[f].cast("string").alias("was"), new[f].cast("string").alias("now")) for f in fields]
    return F.filter(F.array(*pairs), lambda x: ~F.trim(x["was"]).eqNullSafe(F.trim(x["now"])))


def dml7_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which fields an edit changed, from what to what (DML7)."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    old = F.struct("p_name", "p_brand", F.col("p_size"), F.when(k % 4 != 0, F.col("p_type")).alias("p_type"))
    new = F.struct(F.when(k % 3 == 0, F.concat("p_name", F.lit("  "))).when(k % 3 == 1, F.upper("p_name")).otherwise(F.col("p_name")).alias("p_name"), "p_brand", (F.col("p_size") + k.cast("int") % 2).alias("p_size"), F.when(k % 5 != 0, F.col("p_type")).alias("p_type"))
    changes = field_changes(old, new, ("p_name", "p_brand", "p_size", "p_type"))
    text = F.transform(changes, lambda x: F.concat(x["field"], F.lit(": "), F.coalesce(x["was"], F.lit("-")), F.lit(" -> "), F.coalesce(x["now"], F.lit("-"))))
    return p.select(k, F.array_join(text, "; ").alias("changes")).where("changes <> ''")


def a22_reported_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that a customer's orders report, each once in the order of its first report, at most 50."""
    o = table(spark, sf_dir, "orders")
    named = F.concat("o_orderpriority", F.lit("/"), (F.col("o_orderkey") % 9).cast("string"))
    lists = o.groupBy("o_custkey").agg(F.sort_array(F.collect_list(F.struct("o_orderdate", "o_orderkey", named.alias("name")))).alias("r"))
    names = F.slice(F.array_distinct(F.transform("r", lambda x: x["name"])), 1, 50)
    return lists.select("o_custkey", F.array_join(names, ";").alias("names"))


def v4_clash_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries with a word, in any case, that an earlier entry has taken; the first such word and its holder (V4)."""
    p = table(spark, sf_dir, "part").select("p_brand", "p_partkey", F.concat_ws(" ", "p_name", F.col("p_size").cast("string")).alias("word"))
    words = p.select("p_brand", "p_partkey", F.lower(F.trim("word")).alias("word"))
    first = words.groupBy("p_brand", "word").agg(F.min("p_partkey").alias("holder"))
    return words.join(first, ["p_brand", "word"]).where("p_partkey <> holder").select("p_brand", "p_partkey", "word", "holder")


def s12_log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of JSON lines: damaged ones are passed over, the last entry of a key counts, failures are no entry."""
    e = table(spark, sf_dir, "events")
    line = F.when(F.col("event_id") % 11 == 0, '{"key": 5, "te').otherwise(F.to_json(F.struct((F.col("user_id") % 200).alias("key"), F.when(F.col("event_type") != "error", F.concat("event_type", F.lit(" "), F.col("event_id").cast("string"))).alias("text"))))
    log = e.select("ts", "event_id", F.from_json(line, "key long, text string").alias("r")).where("r.key IS NOT NULL AND r.text IS NOT NULL")
    return log.groupBy(F.col("r.key").alias("key")).agg(F.max_by("r.text", F.struct("ts", "event_id")).alias("text"), F.count("*").alias("entries"))


def s4_new_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of a feed that are not stored yet."""
    stored = table(spark, sf_dir, "part").where("p_size > 10").select(F.concat(F.lit("P-"), F.col("p_partkey").cast("string")).alias("code")).distinct()
    return table(spark, sf_dir, "lineitem").select(F.concat(F.lit("P-"), F.col("l_partkey").cast("string")).alias("code")).distinct().join(stored, "code", "left_anti")


def s20_written_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells as they were to be written against cells read again: missing, unasked and different ones."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"))
    expected = li.where("p % 7 <> 0").select("l_orderkey", "l_linenumber", F.concat(F.lit("page "), F.col("p").cast("string")).alias("want"))
    read = li.where("p % 9 <> 0").select("l_orderkey", "l_linenumber", F.when(F.col("p") % 10 == 0, F.concat(F.lit("page  "), F.col("p").cast("string"))).when(F.col("p") % 8 == 0, "page").otherwise(F.concat(F.lit("page "), F.col("p").cast("string"))).alias("got"))
    j = expected.join(read, ["l_orderkey", "l_linenumber"], "full")
    light = lambda c: F.regexp_replace(c, r"\s+", "")
    kind = F.when(F.col("got").isNull(), "missing").when(F.col("want").isNull(), "unasked").when(light(F.col("want")) != light(F.col("got")), "different")
    return j.select("l_orderkey", "l_linenumber", kind.alias("problem")).where("problem IS NOT NULL")


def s22_checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored files: checksum, key of the store, and the copies that one owner has of a file already."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("source", F.lit("")).alias("source"), F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256).alias("checksum"))
    first = d.groupBy("source", "checksum").agg(F.min("doc_id").alias("kept"))
    found = d.join(first, ["source", "checksum"])
    return found.select("doc_id", "checksum", F.concat_ws("/", F.substring("checksum", 1, 2), F.substring("checksum", 3, 6), F.col("kept").cast("string")).alias("storage_key"), (F.col("doc_id") != F.col("kept")).alias("is_copy"))


def s22_unreferenced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored files of removed documents that may be unlinked: no document that is left and no label refers to them."""
    stored = s22_checksums(spark, sf_dir).select("doc_id", "storage_key")
    removed = F.coalesce(F.col("doc_id") % 3 == 0, F.lit(False))
    labelled = stored.join(table(spark, sf_dir, "labels").where("toxic = 1"), "doc_id", "left_semi")
    in_use = stored.where(~removed).select("storage_key").unionByName(labelled.select("storage_key"))
    gone = stored.where(removed).groupBy("storage_key").agg(F.count("*").alias("n"))
    return gone.join(in_use, "storage_key", "left_anti")


def u2_copied_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One log's entries copied into another with their own action names; counts of the joined log."""
    e, o = table(spark, sf_dir, "events"), table(spark, sf_dir, "orders")
    log = e.select(F.upper("event_type").alias("action"), F.to_date("ts").alias("day"))
    moved = o.select(F.concat(F.lit("ORDER_"), "o_orderstatus").alias("action"), F.to_date("o_orderdate").alias("day"))
    return log.unionByName(moved).groupBy("action").agg(F.count("*").alias("n"), F.min("day").alias("first_day"))


def dml4_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Soft-deleted owners take their orders along; a restored owner's come back; a purged one's are gone for good (DML4)."""
    c = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 11 == 0, "purged").when(F.col("c_custkey") % 6 == 0, "restored").when(F.col("c_custkey") % 4 == 0, "deleted").otherwise("live").alias("owner"))
    o = table(spark, sf_dir, "orders").join(c, F.col("o_custkey") == F.col("c_custkey"), "left")
    return o.where("coalesce(owner, 'live') <> 'purged'").select("o_orderkey", (F.coalesce("owner", F.lit("live")) != "deleted").alias("shown"))


#: Little words that are left stuck on the end of a keyword, and words that are none.
GLUE, GENERIC = ("ของ", "กับ", "และ", "บ้าง", "ไหม"), ("งาน", "โครงการ", "ระบบ", "ผลงาน", "อุปกรณ์", "project", "projects")
CUT = "\u0001"


def keyword(text: Column, names: tuple[str, ...]) -> Column:
    """The first word of a text that is more than a dictionary name, a part of one, or a generic word; null if none is.

    Names are cut out longest first; the Thai rest of a word that held one goes with it, and so does glue on the end."""
    out = text
    for name in sorted(names, key=lambda n: (-len(n), n)):
        latin = name.isascii()
        out = F.regexp_replace(out, rf"(?i)(?<![a-z0-9])\Q{name}\E(?![a-z0-9])" if latin else rf"(?i)\Q{name}\E", CUT)
    words = F.flatten(F.transform(F.split(out, r"\s+"), lambda w: F.when(F.contains(w, F.lit(CUT)), F.split(F.regexp_replace(w, "[\\u0E00-\\u0E7F]+", ""), CUT)).otherwise(F.array(w))))
    words = F.transform(words, lambda w: F.regexp_replace(w, f"(?:{'|'.join(GLUE)})+$", ""))
    known = F.array(*[F.lit(n.lower()) for n in names])
    part = lambda w: F.exists(known, lambda n: F.regexp_like(n, F.concat(F.lit(r"(^|[^a-z0-9])\Q"), F.lower(w), F.lit(r"\E($|[^a-z0-9])"))))
    return F.get(F.filter(words, lambda w: w.rlike(r"[\p{L}\p{N}]") & ~F.lower(w).isin(*GENERIC) & ~part(w)), 0)


def t6_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords of questions that name clients and categories."""
    asks = ("Fiber Optic", "router Fiber", "งานไฟเบอร์ออฟติก", "Wi-Fiสพฐ. ในโครงการ", "project cameras", "วงจรกับ", "small ring PROMO", "optic", "", "CAT Telecom switch")
    ask = F.get(F.array(*map(F.lit, asks)), (F.col("p_partkey") % len(asks)).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", F.coalesce(keyword(ask, ("Fiber Optic", "ไฟเบอร์", "สพฐ.", "CAT Telecom", "PROMO")), F.lit("")).alias("keyword"))


def p9_state_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State to label, with counts in it, cut to a length."""
    k = F.col("l_orderkey")
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("missing"))
    text = F.when(k % 5 == 0, "not checked").when((k % 5 == 1) & (F.col("missing") > 0), F.concat(F.lit("checked, "), F.col("missing").cast("string"), F.lit(" documents missing"))).when(k % 5 == 1, "checked").when(k % 5 == 2, F.concat(F.lit("waiting, "), F.col("n").cast("string"), F.lit(" before it"))).when(k % 5 == 3, "failed").otherwise(F.concat(F.lit("declared "), F.col("n").cast("string")))
    return li.select(k, F.when(F.length(text) > 20, F.concat(F.substring(text, 1, 19), F.lit("…"))).otherwise(text).alias("label"))


def f11_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of one type, all types where none is asked for, that hold a text in their joined fields."""
    o = table(spark, sf_dir, "orders")
    hay = F.concat_ws(" ", "o_orderpriority", "o_orderkey", F.year("o_orderdate"))
    parts = [o.where(contains_ci(hay, q) & (F.lit(kind == "") | (F.col("o_orderstatus") == kind))).select(F.lit(f"{kind or 'all'}: {q}").alias("asked"), "o_orderkey") for kind, q in (("F", "urgent 12"), ("", "high 7"), ("P", "LOW 3"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


QUERIES = {f.__name__: f for f in (a3_column_totals, o3_record_list, a24_versions, p10_steps, c5_replayed, c4_claims, c8_retention, dml7_audit, a22_reported_names, v4_clash_rows, s12_log_lines, s4_new_codes, s20_written_back, s22_checksums, s22_unreferenced, u2_copied_log, dml4_restored, t6_keywords, p9_state_texts, f11_types)}
_TYPED = ", ".join(f"CASE (l_partkey + {i}) % 4 WHEN 1 THEN floor(l_quantity) WHEN 3 THEN floor(l_quantity) + 0.5 ELSE 0 END AS {n}" for i, n in enumerate(AMOUNTS))
SQL = {
    "a3_column_totals": f"WITH l AS (SELECT l_orderkey, {_TYPED} FROM lineitem WHERE l_orderkey % 10 <> 4), s AS (SELECT l_orderkey, {', '.join(f'sum({n}) AS {n}' for n in AMOUNTS)} FROM l GROUP BY 1) SELECT o_orderkey AS record, {', '.join(f'coalesce({n}, 0)::DOUBLE AS {n}' for n in AMOUNTS)}, coalesce({' + '.join(AMOUNTS)}, 0)::DOUBLE AS total FROM orders LEFT JOIN s ON o_orderkey = l_orderkey",
    "o3_record_list": f"SELECT o_custkey, o_orderkey, ({list(MONTHS)})[month(o_orderdate)] AS month, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderdate DESC, o_orderkey DESC)::INTEGER AS by_total, row_number() OVER (PARTITION BY o_custkey ORDER BY year(o_orderdate), month(o_orderdate), o_orderdate DESC, o_orderkey DESC)::INTEGER AS by_month FROM orders WHERE o_orderstatus = 'P'",
    "a24_versions": "SELECT user_id, ts::DATE AS version, arg_max(event_id, (ts, event_id)) AS latest, count(*) FILTER (event_type = 'error') AS undecided, count(*) AS \"rows\" FROM events GROUP BY 1, 2",
    "p10_steps": "WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders), f AS (SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS ready FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) SELECT o_custkey, CASE WHEN o_orderstatus IN ('F', 'P') AND o_totalprice > 400000 THEN 'stale' WHEN o_orderstatus = 'F' THEN 'done' WHEN o_orderstatus = 'P' THEN 'doing' WHEN ready IS NOT NULL THEN 'stale' ELSE 'todo' END AS status, CASE WHEN o_orderstatus IN ('F', 'P') THEN CASE WHEN o_totalprice > 400000 THEN o_orderkey END ELSE ready END AS stale_job FROM r LEFT JOIN f USING (o_custkey) WHERE k = 1",
    "c5_replayed": "WITH RECURSIVE l AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, count(*) OVER (PARTITION BY user_id) AS n, CASE event_type WHEN 'view' THEN 'running' WHEN 'click' THEN 'done' WHEN 'signup' THEN 'paused_quota' WHEN 'error' THEN 'failed' ELSE 'needs_login' END AS r FROM events), f AS (SELECT user_id, 0::BIGINT AS k, max(n) AS n, 'requested' AS s FROM l GROUP BY 1 UNION ALL SELECT f.user_id, f.k + 1, f.n, CASE WHEN s = 'running' AND r IN ('done', 'failed', 'paused_quota', 'needs_login') OR s IN ('requested', 'paused_quota', 'needs_login') AND r = 'running' THEN r ELSE s END FROM f JOIN l ON l.user_id = f.user_id AND l.k = f.k + 1) SELECT user_id, s AS state, s IN ('requested', 'running', 'paused_quota', 'needs_login') AS is_open FROM f WHERE k = n",
    "c4_claims": "WITH e AS (SELECT event_id, ts, user_id, CASE WHEN event_id % 7 = 0 THEN 'running' WHEN event_type = 'error' THEN 'failed' ELSE 'requested' END AS s FROM events), o AS (SELECT user_id, arg_min(event_id, (ts, event_id)) AS own FROM e WHERE s = 'running' GROUP BY 1) SELECT s_suppkey AS runner, coalesce(own, (SELECT arg_min(event_id, (ts, event_id)) FROM e WHERE s = 'requested')) AS claimed, (SELECT count(*) FROM e WHERE s = 'requested') AS waiting FROM supplier LEFT JOIN o ON user_id = s_suppkey",
    "c8_retention": "WITH o AS (SELECT ([30, 90, 730])[o_orderkey % 3 + 1] AS days, o_orderdate::DATE + ([30, 90, 730])[o_orderkey % 3 + 1]::INTEGER AS u FROM orders) SELECT days, count(*) FILTER (u <= DATE '2000-01-01') AS removed, count(*) FILTER (u > DATE '2000-01-01') AS kept, max(u) AS last_day FROM o GROUP BY 1",
    "dml7_audit": "WITH c AS (SELECT p_partkey, list_filter([CASE WHEN p_partkey % 3 = 1 AND upper(p_name) <> p_name THEN 'p_name: ' || p_name || ' -> ' || upper(p_name) END, CASE WHEN p_partkey % 2 = 1 THEN 'p_size: ' || p_size || ' -> ' || (p_size + 1) END, CASE WHEN (p_partkey % 4 = 0) <> (p_partkey % 5 = 0) THEN 'p_type: ' || CASE WHEN p_partkey % 4 = 0 THEN '-' ELSE p_type END || ' -> ' || CASE WHEN p_partkey % 5 = 0 THEN '-' ELSE p_type END END], lambda x: x IS NOT NULL) AS c FROM part) SELECT p_partkey, array_to_string(c, '; ') AS changes FROM c WHERE len(c) > 0",
    "a22_reported_names": "WITH o AS (SELECT o_custkey, o_orderpriority || '/' || (o_orderkey % 9) AS name, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders), f AS (SELECT o_custkey, name, min(k) AS k FROM o GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY k) AS i FROM f) SELECT o_custkey, string_agg(name, ';' ORDER BY k) AS names FROM r WHERE i <= 50 GROUP BY 1",
    "v4_clash_rows": "WITH w AS (SELECT p_brand, p_partkey, lower(p_name || ' ' || p_size) AS word FROM part), h AS (SELECT *, min(p_partkey) OVER (PARTITION BY p_brand, word) AS holder FROM w) SELECT * FROM h WHERE p_partkey <> holder",
    "s12_log_lines": "SELECT user_id % 200 AS key, arg_max(event_type || ' ' || event_id, (ts, event_id)) AS text, count(*) AS entries FROM events WHERE event_id % 11 <> 0 AND event_type <> 'error' GROUP BY 1",
    "s4_new_codes": "SELECT DISTINCT 'P-' || l_partkey AS code FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 10)",
    "s20_written_back": "WITH l AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS p FROM lineitem GROUP BY 1, 2) SELECT l_orderkey, l_linenumber, CASE WHEN p % 9 = 0 THEN 'missing' WHEN p % 7 = 0 THEN 'unasked' ELSE 'different' END AS problem FROM l WHERE p % 9 = 0 AND p % 7 <> 0 OR p % 9 <> 0 AND p % 7 = 0 OR p % 63 <> 0 AND p % 7 <> 0 AND p % 9 <> 0 AND p % 8 = 0 AND p % 10 <> 0",
    "s22_unreferenced": "WITH d AS (SELECT doc_id, coalesce(source, '') AS s, sha256(coalesce(text, '')) AS c FROM documents), k AS (SELECT doc_id, c[1:2] || '/' || c[3:8] || '/' || min(doc_id) OVER (PARTITION BY s, c) AS storage_key FROM d) SELECT storage_key, count(*) AS n FROM k WHERE doc_id % 3 = 0 AND storage_key NOT IN (SELECT storage_key FROM k WHERE doc_id % 3 <> 0 OR doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)) GROUP BY 1",
    "s22_checksums": "WITH d AS (SELECT doc_id, coalesce(source, '') AS s, sha256(coalesce(text, '')) AS c FROM documents), k AS (SELECT *, min(doc_id) OVER (PARTITION BY s, c) AS kept FROM d) SELECT doc_id, c AS checksum, c[1:2] || '/' || c[3:8] || '/' || kept AS storage_key, doc_id <> kept AS is_copy FROM k",
    "u2_copied_log": "WITH l AS (SELECT upper(event_type) AS action, ts::DATE AS day FROM events UNION ALL SELECT 'ORDER_' || o_orderstatus, o_orderdate::DATE FROM orders) SELECT action, count(*) AS n, min(day) AS first_day FROM l GROUP BY 1",
    "dml4_restored": "SELECT o_orderkey, o_custkey % 6 = 0 OR o_custkey % 4 <> 0 OR c_custkey IS NULL AS shown FROM orders LEFT JOIN customer ON o_custkey = c_custkey WHERE c_custkey IS NULL OR c_custkey % 11 <> 0",
    "t6_keywords": "SELECT p_partkey, (['', 'router', '', 'Wi-Fi', 'cameras', 'วงจร', 'small', '', '', 'switch'])[p_partkey % 10 + 1] AS keyword FROM part",
    "p9_state_texts": "WITH g AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS m FROM lineitem GROUP BY 1), t AS (SELECT l_orderkey, CASE l_orderkey % 5 WHEN 0 THEN 'not checked' WHEN 1 THEN CASE WHEN m > 0 THEN 'checked, ' || m || ' documents missing' ELSE 'checked' END WHEN 2 THEN 'waiting, ' || n || ' before it' WHEN 3 THEN 'failed' ELSE 'declared ' || n END AS t FROM g) SELECT l_orderkey, CASE WHEN length(t) > 20 THEN t[1:19] || '…' ELSE t END AS label FROM t",
    "f11_types": "WITH h AS (SELECT o_orderkey, o_orderstatus AS s, lower(o_orderpriority || ' ' || o_orderkey || ' ' || year(o_orderdate)) AS h FROM orders) SELECT 'F: urgent 12' AS asked, o_orderkey FROM h WHERE s = 'F' AND contains(h, 'urgent 12') UNION ALL SELECT 'all: high 7', o_orderkey FROM h WHERE contains(h, 'high 7') UNION ALL SELECT 'P: LOW 3', o_orderkey FROM h WHERE s = 'P' AND contains(h, 'low 3')",
}
