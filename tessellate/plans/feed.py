"""A JSON feed of project records: validation, field-wise merge with locks, insert-ignore and copies (S3, V1, DML2, DML6, DML8)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .search import table

#: Fixed values of the feed's contract.
DESCRIPTION_SOURCES = ("tor", "proposal", "contract", "name")
BUDGET_SOURCES = ("certificate", "contract")
VAT_STATUSES = ("included", "excluded", "unspecified")
YEARS = (2000, 2100)
PROJECT_FOLDER = r"(?i)^\\\\[^\\]+\\PS\\_Project [^\\]+\\[^\\]"
MOST_RECORDS = 5000

#: fields that hold text, in the order in which they are read
TEXTS = ("projectCode", "client", "projectName", "descriptionTh", "descriptionEn", "descriptionSource", "contractPath", "certificatePath", "projectFolderPath", "budgetSource", "vatStatus", "budgetNote", "certificateDate", "category")
NUMBERS, LISTS = ("budgetAmount", "year"), ("tags", "workTypes")


def records(feed: DataFrame, body: str = "body") -> DataFrame:
    """Requests {"projects": [...]} to one row a record: the request's columns, its place and its fields, each of its own type or null.

    `kinds` names the JSON type of every field that is there and not null, so that a wrong one is told from an
    absent one. A request that is no JSON (an object with a repeated key included), has no list of projects, or
    has too many, gives one row without a place: `request` says why."""
    keep = [c for c in feed.columns if c != body]
    found = feed.select(*keep, F.col(body).isNull().alias("none"), F.try_parse_json(body).alias("v"))
    found = found.withColumn("list", F.try_variant_get("v", "$.projects", "array<variant>")).withColumn("n_records", F.coalesce(F.size("list"), F.lit(-1)))
    # one text stands for a list in no JSON: only arrays are asked for their elements
    is_list = F.coalesce(F.schema_of_variant(F.try_variant_get("v", "$.projects", "variant")).startswith("ARRAY"), F.lit(False))
    request = F.when(F.col("v").isNull(), "request: no JSON").when(~is_list | (F.col("n_records") < 1), "request: no projects").when(F.col("n_records") > MOST_RECORDS, "request: too many records")
    found = found.withColumn("request", request)
    rows = found.select(*keep, "n_records", "request", F.posexplode_outer(F.when(F.col("request").isNull(), F.transform("list", _fields))).alias("place", "p"))
    return rows.select(*keep, "n_records", "request", "place", "p.*")


def _fields(r: Column) -> Column:
    """A record's fields and their JSON types. Inside the list, so that each is read once however many rules ask for it."""
    kind = {c: F.schema_of_variant(F.try_variant_get(r, f"$.{c}", "variant")) for c in (*TEXTS, *NUMBERS, *LISTS)}
    kinds = F.struct(F.coalesce(F.schema_of_variant(r), F.lit("VOID")).alias("record"), *[F.nullif(k, F.lit("VOID")).alias(c) for c, k in kind.items()])
    get = lambda c, wanted, t: F.when(wanted, F.try_variant_get(r, f"$.{c}", t))
    text = lambda x: F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string"))
    return F.struct(
        kinds.alias("kinds"),
        *[get(c, kind[c] == "STRING", "string").alias(c) for c in TEXTS],
        *[get(c, kind[c].rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), "double").alias(c) for c in NUMBERS],
        *[F.transform(get(c, kind[c].startswith("ARRAY"), "array<variant>"), text).alias(c) for c in LISTS],
    )


def _blank(c: str) -> Column:
    return F.coalesce(F.trim(c), F.lit("")) == ""


def _day(c: str) -> Column:
    """A date written YYYY-MM-DD of the years 2000 to 2100; null for any other text."""
    day = F.when(F.col(c).rlike(r"^\d{4}-\d{2}-\d{2}$"), F.expr(f"try_cast({c} AS date)"))
    return F.when(F.year(day).between(*YEARS), day)


def rules(categories: tuple[str, ...], work_types: tuple[str, ...]) -> list[tuple[str, Column]]:
    """(code, failing condition) in the order in which the first failing one is reported. A value of a wrong type breaks its field's rule."""
    there = lambda c: F.col(f"kinds.{c}").isNotNull()
    mistyped = lambda c: there(c) & F.col(c).isNull()
    foreign = lambda c, known: mistyped(c) | F.exists(F.coalesce(c, F.array().cast("array<string>")), lambda x: x.isNull() | ~x.isin(*known))
    repeats = lambda c: F.size(F.array_distinct(c)) < F.size(c)
    named = lambda c: there(c) & _blank(c)
    unknown = lambda c, known: there(c) & ~F.coalesce(F.col(c).isin(*known), F.lit(False))
    described = ~_blank("descriptionTh") | ~_blank("descriptionEn")
    amount = F.col("budgetAmount")
    return [
        ("record: no object", ~F.col("kinds.record").startswith("OBJECT")),
        *[(f"{c}: empty", _blank(c)) for c in ("projectCode", "client", "projectName")],
        *[(f"{c}: no text", mistyped(c)) for c in ("descriptionTh", "descriptionEn", "budgetNote")],
        ("descriptionSource: unknown", unknown("descriptionSource", DESCRIPTION_SOURCES)),
        ("descriptions: one alone", described & (_blank("descriptionTh") | _blank("descriptionEn"))),
        ("descriptionSource: missing", described & ~there("descriptionSource")),
        ("descriptionSource: without description", ~described & there("descriptionSource")),
        ("contractPath: empty", named("contractPath")),
        ("certificatePath: empty", named("certificatePath")),
        ("paths: none", ~there("contractPath") & ~there("certificatePath")),
        ("projectFolderPath: empty", named("projectFolderPath")),
        ("projectFolderPath: not in the archive", there("projectFolderPath") & ~F.col("projectFolderPath").rlike(PROJECT_FOLDER)),
        ("budgetAmount: no number from 0", mistyped("budgetAmount") | F.isnan(amount) | (amount < 0) | (amount == float("inf"))),
        ("budgetSource: unknown", unknown("budgetSource", BUDGET_SOURCES)),
        ("budgetSource: missing", there("budgetAmount") & ~there("budgetSource")),
        ("budgetSource: without amount", ~there("budgetAmount") & there("budgetSource")),
        ("vatStatus: unknown", unknown("vatStatus", VAT_STATUSES)),
        ("year: out of range", mistyped("year") | (F.col("year") != F.floor("year")) | ~F.col("year").between(*YEARS)),
        ("certificateDate: no day", there("certificateDate") & _day("certificateDate").isNull()),
        ("certificateDate: without certificatePath", there("certificateDate") & ~there("certificatePath")),
        ("category: unknown", unknown("category", categories)),
        ("tags: unknown", foreign("tags", categories)),
        ("tags: repeated", repeats("tags")),
        ("tags: hold the category", F.array_contains("tags", F.col("category"))),
        ("workTypes: unknown", foreign("workTypes", work_types)),
        ("workTypes: repeated", repeats("workTypes")),
    ]


def validated(rows: DataFrame, categories: tuple[str, ...], work_types: tuple[str, ...]) -> DataFrame:
    """records() with `error`: the request's fault, else the first rule that a record breaks (null for an accepted one)."""
    first = F.coalesce(*[F.when(F.coalesce(cond, F.lit(False)), code) for code, cond in rules(categories, work_types)])
    return rows.withColumn("error", F.coalesce("request", first))


def typed(rows: DataFrame) -> DataFrame:
    """Accepted records with the types of the stored cards; missing texts are blank, missing lists empty."""
    none = F.array().cast("array<string>")
    return rows.where("error IS NULL").select(
        *[c for c in rows.columns if c not in (*TEXTS, *NUMBERS, *LISTS, "kinds", "request", "error")],
        *["projectCode", "client", "projectName"],
        *[F.coalesce(c, F.lit("")).alias(c) for c in ("descriptionTh", "descriptionEn", "budgetNote")],
        *["descriptionSource", "contractPath", "certificatePath", "projectFolderPath", "budgetSource", "vatStatus", "category"],
        "budgetAmount",
        F.col("year").cast("int").alias("year"),
        _day("certificateDate").alias("certificateDate"),
        *[F.coalesce(c, none).alias(c) for c in LISTS],
    )


BLANKS = ("descriptionTh", "descriptionEn", "budgetNote")
NULLS = ("descriptionSource", "contractPath", "certificatePath", "projectFolderPath", "budgetAmount", "budgetSource", "vatStatus", "year", "certificateDate", "category")
ALWAYS = ("client", "projectName")
#: a lock, and the fields that a person has fixed with it
LOCKS = {
    "budgetVerified": ("budgetAmount", "budgetSource", "vatStatus"),
    "classificationEdited": ("category", "tags", "workTypes"),
    "descriptionManual": ("descriptionTh", "descriptionEn", "descriptionSource"),
    "dateEdited": ("certificateDate",),
}


def last_tags(cards: DataFrame, feed: DataFrame, order: str) -> DataFrame:
    """projectCode, new_tags: the tags after the deliveries of a code in their order, where no lock holds.

    Each delivery may bring tags and a category; tags lose the category that is in force after every delivery. So
    what is left is the last list that was brought (or the stored one), without the category in force when it came
    and without all that came later: no delivery has to wait for the one before it."""
    brought = F.max(F.when(F.size("tags") > 0, F.col(order))).over(Window.partitionBy("projectCode"))
    marked = feed.select("projectCode", order, "category", "tags", brought.alias("since"))
    late = F.col("since").isNull() | (F.col(order) > F.col("since"))
    folded = marked.groupBy("projectCode").agg(
        F.max("since").alias("since"),
        F.max_by("tags", F.when(F.size("tags") > 0, F.col(order))).alias("list"),
        F.max_by("category", F.when(F.col("category").isNotNull() & ~late, F.col(order))).alias("then"),
        F.min_by("category", order).alias("first"),
        F.collect_set(F.when(late, F.col("category"))).alias("later"),
    )
    stored = cards.select("projectCode", F.lit(True).alias("there"), F.col("category").alias("old"), F.col("tags").alias("old_tags"))
    rows = folded.join(stored, "projectCode", "left")
    # stored tags meet the stored category too, if the first delivery has none
    in_force = F.when(F.col("since").isNotNull(), F.coalesce("then", "old")).when(F.col("first").isNull(), F.col("old"))
    # what creates a card is taken as it is
    start = F.coalesce("list", F.when(F.col("there"), F.col("old_tags")))
    out = F.filter(start, lambda t: ~F.coalesce(F.array_contains("later", t), F.lit(False)) & ~t.eqNullSafe(in_force))
    return rows.select("projectCode", F.coalesce(out, F.array().cast("array<string>")).alias("new_tags"))


def merge_cards(cards: DataFrame, feed: DataFrame, order: str = "seq") -> DataFrame:
    """Upsert of typed() records into cards (their fields and the four locks), the deliveries of a code in their order.

    Blank texts, nulls and empty lists keep what is there; a locked group is left alone; after each delivery the
    tags lose the category then in force (last_tags). Any other field is the last that says something, so every
    card is written once. Beside the card: created, n_updates, and the deliveries that each lock turned away."""
    said = {**{c: F.col(c) != "" for c in BLANKS}, **{c: F.col(c).isNotNull() for c in NULLS}, **{c: F.size(c) > 0 for c in LISTS}, **{c: F.lit(True) for c in ALWAYS}}
    sends = {
        "budgetVerified": F.lit(True),
        "classificationEdited": said["category"] | said["tags"] | said["workTypes"],
        "descriptionManual": said["descriptionSource"],
        "dateEdited": said["certificateDate"],
    }
    folded = feed.groupBy("projectCode").agg(
        *[F.max_by(c, F.when(cond, F.col(order))).alias(f"new_{c}") for c, cond in said.items() if c != "tags"],
        F.count("*").alias("n"),
        # a card's first delivery creates it, so it meets no lock: locks stand on stored cards alone
        *[F.count_if(cond).alias(f"sent_{lock}") for lock, cond in sends.items()],
    )
    rows = cards.withColumn("stored", F.lit(True)).join(folded.join(last_tags(cards, feed, order), "projectCode"), "projectCode", "full")
    stored = F.coalesce("stored", F.lit(False))
    locked = {c: F.coalesce(lock, F.lit(False)) for lock, fields in LOCKS.items() for c in fields}
    value = {c: F.when(locked.get(c, F.lit(False)), F.col(c)).otherwise(F.coalesce(f"new_{c}", c)) for c in said}
    value |= {c: F.coalesce(value[c], F.lit("")) for c in BLANKS}
    value |= {c: F.coalesce(value[c], F.array().cast("array<string>")) for c in LISTS}
    n = F.coalesce("n", F.lit(0))
    return rows.select(
        "projectCode",
        *[value[c].alias(c) for c in said],
        *[F.coalesce(lock, F.lit(False)).alias(lock) for lock in LOCKS],
        (~stored).alias("created"),
        F.when(stored, n).otherwise(n - 1).alias("n_updates"),
        *[F.when(F.coalesce(lock, F.lit(False)), F.coalesce(f"sent_{lock}", F.lit(0))).otherwise(0).alias(f"skipped_{lock}") for lock in LOCKS],
    )


CATEGORIES, WORK_TYPES = ("ECONOMY", "PROMO", "STANDARD", "MEDIUM", "LARGE", "SMALL"), ("build", "rent", "care")


def _requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One request a brand, with a record for each of its parts; remainders of the part key spoil some fields."""
    k = F.col("p_partkey")
    when = lambda n, v, other=None, r=0: F.when(k % n == r, v).otherwise(other)
    text = lambda head: F.concat(F.lit(head), k.cast("string"))
    record = F.struct(
        when(17, F.lit(" "), text("P-")).alias("projectCode"),
        when(19, F.lit(""), F.col("p_brand")).alias("client"),
        F.col("p_name").alias("projectName"),
        when(3, F.col("p_name")).alias("descriptionTh"),
        F.when((k % 3 == 0) & (k % 29 != 0), F.upper("p_name")).alias("descriptionEn"),
        F.when(k % 23 == 0, "manual").when((k % 3 == 0) & (k % 31 != 0), "tor").when(k % 37 == 0, "name").alias("descriptionSource"),
        when(2, text("/c/"), when(41, F.lit(" "))).alias("contractPath"),
        F.when((k % 5 == 0) | (k % 3 == 0), text("/w/")).alias("certificatePath"),
        F.when(k % 43 == 0, text("/local/")).when(k % 4 == 0, text("\\\\srv\\PS\\_Project 2018\\")).alias("projectFolderPath"),
        F.when(k % 47 == 0, -1.0).when(k % 2 == 0, F.col("p_retailprice")).alias("budgetAmount"),
        F.when(k % 53 == 0, "guess").when((k % 2 == 0) & (k % 59 != 0), "contract").when(k % 61 == 0, "certificate").alias("budgetSource"),
        F.when(k % 67 == 0, "maybe").when(k % 6 == 0, "included").alias("vatStatus"),
        F.when(k % 71 == 0, 1800).when(k % 7 != 0, 2000 + k % 25).cast("int").alias("year"),
        F.when(k % 73 == 0, "2024-02-30").when(k % 10 == 0, F.concat(F.lit("2024-0"), (1 + k % 9).cast("string"), F.lit("-15"))).alias("certificateDate"),
        F.when(k % 79 == 0, "OTHER").when(k % 8 != 0, F.col("p_type")).alias("category"),
        F.when(k % 83 == 0, F.array(F.lit("PROMO"), F.lit("PROMO"))).when(k % 4 == 1, F.array(F.lit("PROMO"))).alias("tags"),
        F.when(k % 89 == 0, F.array(F.lit("paint"))).when(k % 3 == 1, F.array(F.lit("rent"), F.lit("care"))).alias("workTypes"),
    )
    json = F.to_json(record)
    # values of a wrong type, which no typed struct could hold
    for n, field, wrong in ((97, r'"year":(\d+)', '"year":"$1"'), (101, r'"client":"[^"]*"', '"client":5'), (103, r'"tags":\["PROMO"\]', '"tags":"PROMO"'), (107, r'"budgetAmount":([\d.]+)', '"budgetAmount":"$1"'), (109, r"^.*$", "[7]")):
        # a pattern that never matches leaves the others alone, and the record stands once in the plan
        json = F.regexp_replace(json, F.when(k % n == 0, field).otherwise("(?!)"), F.lit(wrong))
    parts = table(spark, sf_dir, "part").select("p_brand", k, json.alias("r"))
    # a request is a bounded batch: at most 100 consecutive part keys of a brand
    batches = parts.groupBy("p_brand", F.floor(k / 100).alias("batch")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("p_partkey", "r"))), lambda x: x["r"]), ",").alias("list"))
    body = F.concat(F.lit('{"projects":['), "list", F.lit("]}"))
    # some are cut off, some say nothing
    turn = F.substring("p_brand", 7, 9).cast("int") + F.col("batch")
    body = F.when(turn % 31 == 0, F.expr("left(concat('{\"projects\":[', list), 60)")).when(turn % 37 == 0, '{"projects":[]}').when(turn % 41 == 0, '{"projects":"none"}').otherwise(body)
    return batches.select("p_brand", "batch", body.alias("body"))


def v1_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first rule that each record of the feed breaks, or its whole request (place -1); accepted ones have none (S3, V1)."""
    rows = validated(records(_requests(spark, sf_dir)), CATEGORIES, WORK_TYPES)
    return rows.select("p_brand", "batch", F.coalesce("place", F.lit(-1)).alias("place"), "projectCode", F.coalesce("error", F.lit("")).alias("error"))


def _cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored cards of four in five parts, some of them locked."""
    k = F.col("p_partkey")
    text = lambda head: F.concat(F.lit(head), k.cast("string"))
    return table(spark, sf_dir, "part").where(k % 5 != 1).select(
        text("P-").alias("projectCode"),
        F.lit("old client").alias("client"),
        F.lit("old name").alias("projectName"),
        F.lit("old th").alias("descriptionTh"),
        F.lit("").alias("descriptionEn"),
        F.when(k % 11 == 0, "manual").otherwise("name").alias("descriptionSource"),
        text("/old/").alias("contractPath"),
        F.lit(None).cast("string").alias("certificatePath"),
        F.lit(None).cast("string").alias("projectFolderPath"),
        F.when(k % 3 == 0, 5.0).alias("budgetAmount"),
        F.when(k % 3 == 0, "contract").alias("budgetSource"),
        F.lit(None).cast("string").alias("vatStatus"),
        F.lit("note").alias("budgetNote"),
        F.lit(1999).alias("year"),
        F.to_date(F.lit("2020-01-01")).alias("certificateDate"),
        F.lit("SMALL").alias("category"),
        F.array(F.lit("LARGE"), F.lit("PROMO")).alias("tags"),
        F.array(F.lit("build")).alias("workTypes"),
        (k % 7 == 0).alias("budgetVerified"),
        (k % 13 == 0).alias("classificationEdited"),
        (k % 11 == 0).alias("descriptionManual"),
        (k % 9 == 0).alias("dateEdited"),
    )


def _merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    accepted = typed(validated(records(_requests(spark, sf_dir)), CATEGORIES, WORK_TYPES))
    texts = lambda *words: F.array(*[F.lit(w) for w in words]).cast("array<string>")
    fields = ("client", "projectName", *BLANKS, *NULLS, *LISTS)

    def delivery(seq: int, when: Column, client: str, category: str | None, tags: Column, works: Column) -> Column:
        """A later delivery of some codes, with little to say."""
        said = {"client": F.lit(client), "projectName": F.col("projectName"), "category": F.lit(category).cast("string"), "tags": tags, "workTypes": works}
        silent = {**{c: F.lit("") for c in BLANKS}, **{c: F.lit(None).cast(accepted.schema[c].dataType) for c in NULLS}}
        return F.when(when, F.struct(F.lit(seq).alias("seq"), *[(silent | said)[c].alias(c) for c in fields]))

    year = F.coalesce("year", F.lit(1))
    deliveries = F.array(
        F.struct(F.lit(1).alias("seq"), *fields),
        delivery(2, year % 4 == 0, "second client", "PROMO", texts(), texts()),
        delivery(3, year % 8 == 0, "third client", "LARGE", texts(), texts()),
        delivery(4, year % 3 == 0, "fourth client", None, texts("MEDIUM", "PROMO", "SMALL"), texts("care")),
    )
    feed = accepted.select("projectCode", F.inline(F.filter(deliveries, lambda d: d.isNotNull())))
    return merge_cards(_cards(spark, sf_dir), feed)


def dml2_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cards after the feed: kept, replaced and locked fields (DML2, F18)."""
    m = _merged(spark, sf_dir)
    return m.select(*[c for c in m.columns if c not in ("tags", "workTypes", "certificateDate")], *[F.array_join(c, ",").alias(c) for c in ("tags", "workTypes")], F.date_format("certificateDate", "yyyy-MM-dd").alias("certificateDate"))


def dml2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the feed's sender is told: created, updated, turned away by each lock."""
    m = _merged(spark, sf_dir)
    return m.agg(F.count_if("created").alias("created"), F.sum("n_updates").alias("updated"), *[F.sum(f"skipped_{lock}").alias(f"skipped_{lock}") for lock in LOCKS])


def dml6_insert_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose key is not there yet are added, the first of a repeated key; all others are ignored (DML6)."""
    li = table(spark, sf_dir, "lineitem")
    there = li.where("l_returnflag = 'N'").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("ref"))
    asked = li.where("l_returnflag <> 'N'").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("ref"))
    added = asked.join(there, ["l_orderkey", "l_linenumber"], "left_anti")
    return there.withColumn("kind", F.lit("kept")).unionByName(added.withColumn("kind", F.lit("added")))


def dml8_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A copy of each open order for a new owner, as a draft with its own key (DML8)."""
    o = table(spark, sf_dir, "orders")
    top = o.agg(F.max("o_orderkey").alias("top"))
    copy = o.where("o_orderstatus = 'O'").join(F.broadcast(top), F.lit(True))
    return copy.select((F.col("top") + 1 + F.col("o_orderkey")).alias("o_orderkey"), F.lit(7).cast("long").alias("o_custkey"), F.lit("draft").alias("o_orderstatus"), "o_totalprice", F.concat(F.lit("copy of "), F.col("o_orderkey").cast("string")).alias("title"))


_K = "p_partkey"
RECORDS = f"""WITH RECURSIVE r AS (SELECT p_brand, floor({_K} / 100)::BIGINT AS batch, {_K} AS k, p_name, p_type, p_retailprice,
  CASE WHEN {_K} % 17 = 0 THEN ' ' ELSE 'P-' || {_K} END AS code, CASE WHEN {_K} % 19 = 0 THEN '' ELSE p_brand END AS client,
  {_K} % 3 = 0 AS th, {_K} % 3 = 0 AND {_K} % 29 <> 0 AS en,
  CASE WHEN {_K} % 23 = 0 THEN 'manual' WHEN {_K} % 3 = 0 AND {_K} % 31 <> 0 THEN 'tor' WHEN {_K} % 37 = 0 THEN 'name' END AS src,
  CASE WHEN {_K} % 2 = 0 THEN '/c/' || {_K} WHEN {_K} % 41 = 0 THEN ' ' END AS contract, CASE WHEN {_K} % 5 = 0 OR {_K} % 3 = 0 THEN '/w/' || {_K} END AS cert,
  CASE WHEN {_K} % 43 = 0 THEN 'bad' WHEN {_K} % 4 = 0 THEN '\\\\srv\\PS\\_Project 2018\\' || {_K} END AS folder,
  CASE WHEN {_K} % 47 = 0 THEN -1 WHEN {_K} % 2 = 0 THEN p_retailprice END AS amount,
  CASE WHEN {_K} % 53 = 0 THEN 'guess' WHEN {_K} % 2 = 0 AND {_K} % 59 <> 0 THEN 'contract' WHEN {_K} % 61 = 0 THEN 'certificate' END AS bsrc,
  CASE WHEN {_K} % 67 = 0 THEN 'maybe' WHEN {_K} % 6 = 0 THEN 'included' END AS vat, CASE WHEN {_K} % 71 = 0 THEN 1800 WHEN {_K} % 7 <> 0 THEN (2000 + {_K} % 25)::INTEGER END AS year,
  CASE WHEN {_K} % 73 = 0 THEN '2024-02-30' WHEN {_K} % 10 = 0 THEN '2024-0' || (1 + {_K} % 9) || '-15' END AS day,
  CASE WHEN {_K} % 79 = 0 THEN 'OTHER' WHEN {_K} % 8 <> 0 THEN p_type END AS category,
  CASE WHEN {_K} % 83 = 0 THEN ['PROMO', 'PROMO'] WHEN {_K} % 4 = 1 THEN ['PROMO'] ELSE [] END AS tags, CASE WHEN {_K} % 89 = 0 THEN ['paint'] WHEN {_K} % 3 = 1 THEN ['rent', 'care'] ELSE [] END AS works, substr(p_brand, 7)::INTEGER + floor({_K} / 100)::BIGINT AS turn,
  {_K} % 97 = 0 AND {_K} % 7 <> 0 AS year_text, {_K} % 101 = 0 AND {_K} % 19 <> 0 AS client_number, {_K} % 103 = 0 AND {_K} % 4 = 1 AND {_K} % 83 <> 0 AS tags_text, {_K} % 107 = 0 AND ({_K} % 2 = 0 AND {_K} % 47 <> 0) AS amount_text, {_K} % 109 = 0 AS no_object FROM part),
b AS (SELECT p_brand, batch, CASE WHEN turn % 31 = 0 THEN 'request: no JSON' WHEN turn % 37 = 0 OR turn % 41 = 0 THEN 'request: no projects' END AS refused FROM r GROUP BY p_brand, batch, turn),
v AS (SELECT r.*, (row_number() OVER (PARTITION BY p_brand, batch ORDER BY k) - 1)::INTEGER AS place, CASE
  WHEN no_object THEN 'record: no object' WHEN code = ' ' THEN 'projectCode: empty' WHEN client = '' OR client_number THEN 'client: empty' WHEN src = 'manual' THEN 'descriptionSource: unknown' WHEN th <> en THEN 'descriptions: one alone'
  WHEN th AND src IS NULL THEN 'descriptionSource: missing' WHEN NOT th AND src IS NOT NULL THEN 'descriptionSource: without description' WHEN contract = ' ' THEN 'contractPath: empty'
  WHEN contract IS NULL AND cert IS NULL THEN 'paths: none' WHEN folder = 'bad' THEN 'projectFolderPath: not in the archive' WHEN amount < 0 OR amount_text THEN 'budgetAmount: no number from 0' WHEN bsrc = 'guess' THEN 'budgetSource: unknown'
  WHEN amount IS NOT NULL AND bsrc IS NULL THEN 'budgetSource: missing' WHEN amount IS NULL AND bsrc IS NOT NULL THEN 'budgetSource: without amount' WHEN vat = 'maybe' THEN 'vatStatus: unknown' WHEN year = 1800 OR year_text THEN 'year: out of range'
  WHEN day = '2024-02-30' THEN 'certificateDate: no day' WHEN day IS NOT NULL AND cert IS NULL THEN 'certificateDate: without certificatePath' WHEN category = 'OTHER' THEN 'category: unknown'
  WHEN tags_text THEN 'tags: unknown' WHEN len(tags) = 2 THEN 'tags: repeated' WHEN list_contains(tags, category) THEN 'tags: hold the category' WHEN works = ['paint'] THEN 'workTypes: unknown' ELSE '' END AS error FROM r JOIN b USING (p_brand, batch) WHERE refused IS NULL)"""
#: the fields that every delivery may change are walked delivery by delivery
CARDS = RECORDS + f""", a AS (SELECT * FROM v WHERE error = ''),
d AS (SELECT code, 1 AS seq, client, category, tags, works, category IS NOT NULL OR len(tags) > 0 OR len(works) > 0 AS says FROM a
  UNION ALL SELECT code, 2, 'second client', 'PROMO', [], [], true FROM a WHERE year % 4 = 0 UNION ALL SELECT code, 3, 'third client', 'LARGE', [], [], true FROM a WHERE year % 8 = 0
  UNION ALL SELECT code, 4, 'fourth client', NULL, ['MEDIUM', 'PROMO', 'SMALL'], ['care'], true FROM a WHERE year % 3 = 0),
o AS (SELECT *, row_number() OVER (PARTITION BY code ORDER BY seq) AS i FROM d),
s AS (SELECT 'P-' || {_K} AS code, {_K} AS k, CASE WHEN {_K} % 11 = 0 THEN 'manual' ELSE 'name' END AS src, CASE WHEN {_K} % 3 = 0 THEN 5.0::DOUBLE END AS amount, CASE WHEN {_K} % 3 = 0 THEN 'contract' END AS bsrc,
  {_K} % 7 = 0 AS lb, {_K} % 13 = 0 AS lc, {_K} % 11 = 0 AS ld, {_K} % 9 = 0 AS lt FROM part WHERE {_K} % 5 <> 1),
w AS (SELECT code, 0::BIGINT AS i, 'old client' AS client, 'SMALL' AS category, ['LARGE', 'PROMO'] AS tags, ['build'] AS works, lc, 0 AS turned FROM s
  UNION ALL SELECT code, i, client, category, tags, works, false, 0 FROM o WHERE i = 1 AND code NOT IN (SELECT code FROM s)
  UNION ALL SELECT w.code, o.i, o.client, CASE WHEN lc THEN w.category ELSE coalesce(o.category, w.category) END,
    CASE WHEN lc THEN w.tags ELSE list_filter(CASE WHEN len(o.tags) > 0 THEN o.tags ELSE w.tags END, lambda x: x IS DISTINCT FROM coalesce(o.category, w.category)) END,
    CASE WHEN lc OR len(o.works) = 0 THEN w.works ELSE o.works END, lc, turned + (lc AND says)::INTEGER FROM w JOIN o ON w.code = o.code AND o.i = w.i + 1),
l AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY code ORDER BY i DESC) = 1),
c AS (SELECT l.code, l.client, l.category AS cat, l.tags AS t, l.works AS work, l.i AS n, turned, s.code IS NOT NULL AS stored, a.code IS NOT NULL AS sent, coalesce(lb, false) AS lb, coalesce(s.lc, false) AS lc, coalesce(ld, false) AS ld, coalesce(lt, false) AS lt,
  s.src AS osrc, s.amount AS oamount, s.bsrc AS obsrc, s.k AS ok, a.* EXCLUDE (code, client, category, tags, works) FROM l LEFT JOIN s ON l.code = s.code LEFT JOIN a ON l.code = a.code)"""
SQL = {
    "v1_feed": RECORDS + " SELECT p_brand, batch, place, CASE WHEN NOT no_object THEN code END AS \"projectCode\", error FROM v UNION ALL SELECT p_brand, batch, -1, NULL, refused FROM b WHERE refused IS NOT NULL",
    "dml2_cards": CARDS + """ SELECT code AS "projectCode", client, CASE WHEN sent THEN p_name ELSE 'old name' END AS "projectName",
  CASE WHEN NOT ld AND th THEN p_name WHEN stored THEN 'old th' ELSE '' END AS "descriptionTh", CASE WHEN NOT ld AND en THEN upper(p_name) ELSE '' END AS "descriptionEn", CASE WHEN ld THEN osrc ELSE coalesce(src, osrc) END AS "descriptionSource",
  coalesce(contract, CASE WHEN stored THEN '/old/' || ok END) AS "contractPath", cert AS "certificatePath", folder AS "projectFolderPath", CASE WHEN lb THEN oamount ELSE coalesce(amount, oamount) END AS "budgetAmount", CASE WHEN lb THEN obsrc ELSE coalesce(bsrc, obsrc) END AS "budgetSource",
  CASE WHEN NOT lb THEN vat END AS "vatStatus", CASE WHEN stored THEN 'note' ELSE '' END AS "budgetNote", coalesce(year, CASE WHEN stored THEN 1999 END) AS year, CASE WHEN lt THEN '2020-01-01' ELSE coalesce(day, CASE WHEN stored THEN '2020-01-01' END) END AS "certificateDate", cat AS category,
  array_to_string(t, ',') AS tags, array_to_string(work, ',') AS "workTypes",
  lb AS "budgetVerified", lc AS "classificationEdited", ld AS "descriptionManual", lt AS "dateEdited", NOT stored AS created, CASE WHEN stored THEN n ELSE n - 1 END::BIGINT AS n_updates,
  CASE WHEN lb THEN n ELSE 0 END::BIGINT AS "skipped_budgetVerified", turned::BIGINT AS "skipped_classificationEdited", CASE WHEN ld AND src IS NOT NULL THEN 1 ELSE 0 END::BIGINT AS "skipped_descriptionManual", CASE WHEN lt AND day IS NOT NULL THEN 1 ELSE 0 END::BIGINT AS "skipped_dateEdited" FROM c""",
    "dml2_report": CARDS + """ SELECT count(*) FILTER (NOT stored) AS created, sum(CASE WHEN stored THEN n ELSE n - 1 END)::BIGINT AS updated, sum(CASE WHEN lb THEN n ELSE 0 END)::BIGINT AS "skipped_budgetVerified",
  sum(turned)::BIGINT AS "skipped_classificationEdited", count(*) FILTER (ld AND src IS NOT NULL) AS "skipped_descriptionManual", count(*) FILTER (lt AND day IS NOT NULL) AS "skipped_dateEdited" FROM c""",
    "dml6_insert_ignore": "WITH t AS (SELECT l_orderkey, l_linenumber, min(l_partkey) FILTER (l_returnflag = 'N') AS old, min(l_partkey) FILTER (l_returnflag <> 'N') AS new FROM lineitem GROUP BY 1, 2) SELECT l_orderkey, l_linenumber, coalesce(old, new) AS ref, CASE WHEN old IS NULL THEN 'added' ELSE 'kept' END AS kind FROM t",
    "dml8_copies": "SELECT (SELECT max(o_orderkey) FROM orders) + 1 + o_orderkey AS o_orderkey, 7::BIGINT AS o_custkey, 'draft' AS o_orderstatus, o_totalprice, 'copy of ' || o_orderkey AS title FROM orders WHERE o_orderstatus = 'O'",
}
QUERIES = {f.__name__: f for f in (v1_feed, dml2_cards, dml2_report, dml6_insert_ignore, dml8_copies)}
