"""Which column of a table is which: stacked and merged headers of sheets, and column profiles of word tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import arabic_digits

#: The words that name a column, in the order in which columns are claimed; rows searched and rows that a header can have.
ITEM = r"(?i)^(?:ลำดับ(?:\s*ที่)?|ข้อ(?:\s*ที่)?|หัวข้อ|รายการ(?:\s*ที่)?|item(?:\s*no\.?)?|no\.?|clause|#)$"
REFERENCE, REMARK = r"(?i)อ้างอิง|เลขหน้า|ชื่อไฟล์|reference|\bpage\b|\bdocument\b", r"(?i)หมายเหตุ|remark|(?<![a-z])notes?(?![a-z])"
ROLES = (
    ("comply", r"(?i)ตรง(?:ตาม)?(?:ข้อ)?กำหนด|\bcomply\b|\bcompliant\b"),
    ("better", r"(?i)ดีกว่า|\bbetter\b|\bexceeds?\b"),
    ("reference", REFERENCE),
    ("remark", REMARK),
    ("tor", r"(?i)(?<![a-z])TOR(?![a-z])|กำหนด|requirement"),
    ("proposal", r"(?i)เสนอ|propos|offer|bidder|vendor"),
    ("specification", r"(?i)คุณสมบัติ|คุณลักษณะ|รายละเอียด|specification|description"),
)
SEARCHED, DEEPEST = 200, 6
#: An item's number, text that is only tick boxes, and text that looks like a reference.
NUMBERED, DOTTED = r"^\(?[0-9๐-๙]", r"[0-9๐-๙]\.[0-9๐-๙]"
TICKS = r"^[\s☒☑☐✓✔■□●√üþ]*$"
LIKE_REFERENCE = r"(?i)(?:หน้า(?:ที่)?|\bpages?\b\.?|\bpp?\.)\s*\d|\.pdf\b|เอกสาร|ส่วนที่|ภาคผนวก|\bsection\b|appendix|attachment"
KEYS = ["path", "part"]


def headers(cells: DataFrame, merges: DataFrame, needs_item: bool = True, item: str = ITEM) -> DataFrame:
    """path, part, first, last, columns (role -> column) of each sheet's header, where there is one.

    cells: path, part, row, col, text; merges: path, part, top, left, bottom, right (a merged cell's text is at its
    top left and is shown on all it covers). A header begins at a row that names the item column (or, without
    needs_item, at any row whose requirement and proposal columns don't show one text) and takes in rows below it
    that leave the item column blank and write only under the name of a group. A column serves one role, the first
    that claims it; the first row with a requirement and a proposal column is the header."""
    own = cells.where((F.col("row") < SEARCHED + DEEPEST) & (F.coalesce("text", F.lit("")) != "")).groupBy(*KEYS, "row", "col").agg(F.min("text").alias("text"))
    n_rows = cells.groupBy(*KEYS).agg((F.max("row") + 1).alias("n_rows"))
    covered = merges.where(F.col("top") < SEARCHED + DEEPEST).select(*KEYS, F.col("top").alias("at_row"), F.col("left").alias("at_col"), (F.col("right") > F.col("left")).alias("wide"), F.explode(F.sequence("top", F.least("bottom", F.lit(SEARCHED + DEEPEST)))).alias("row"), "left", "right")
    covered = covered.select(*KEYS, "at_row", "at_col", "wide", "row", F.explode(F.sequence("left", "right")).alias("col"))
    anchor = own.select(*KEYS, F.col("row").alias("at_row"), F.col("col").alias("at_col"), F.col("text").alias("over"))
    covered = covered.join(anchor, [*KEYS, "at_row", "at_col"], "left").dropDuplicates([*KEYS, "row", "col"])
    shown = own.join(covered.select(*KEYS, "row", "col", "over", F.lit(True).alias("merged")), [*KEYS, "row", "col"], "full")
    shown = shown.select(*KEYS, "row", "col", F.when(F.col("merged"), F.col("over")).otherwise(F.col("text")).alias("text")).where("text IS NOT NULL")

    named = own.groupBy(*KEYS, F.col("row").alias("first")).agg(F.min(F.when(F.col("text").rlike(item), F.col("col"))).alias("item"))
    rows = (named if needs_item else named.unionByName(shown.select(*KEYS, F.col("row").alias("first"), F.lit(None).cast("int").alias("item")).distinct()).groupBy(*KEYS, "first").agg(F.min("item").alias("item"))).where(F.col("first") < SEARCHED)
    starts = rows.where("item IS NOT NULL") if needs_item else rows
    # every row that a header could reach down to, and what speaks against it
    reach = starts.join(n_rows, KEYS).select(*KEYS, "first", "item", F.explode(F.sequence("first", F.least(F.col("first") + DEEPEST - 1, F.col("n_rows") - 1).cast("int"))).alias("row"))
    groups = covered.where("wide AND over IS NOT NULL").select(*KEYS, "col", F.col("row").alias("group_row"), F.explode(F.sequence(F.col("row") + 1, F.col("row") + DEEPEST - 1)).alias("row"))
    under = groups.groupBy(*KEYS, "row", "col").agg(F.max("group_row").alias("group_row"))
    against = reach.where("row > first").join(own.select(*KEYS, "row", "col"), [*KEYS, "row"]).join(under, [*KEYS, "row", "col"], "left")
    against = against.where((F.col("col") == F.col("item")) | F.col("group_row").isNull() | (F.col("group_row") < F.col("first"))).groupBy(*KEYS, "first").agg(F.min("row").alias("stop"))
    last = reach.groupBy(*KEYS, "first", "item").agg(F.max("row").alias("end")).join(against, [*KEYS, "first"], "left").select(*KEYS, "first", "item", F.least("end", F.col("stop") - 1).alias("last"))

    texts = last.select(*KEYS, "first", "item", "last", F.explode(F.sequence("first", "last")).alias("row")).join(shown, [*KEYS, "row"])
    by_column = texts.groupBy(*KEYS, "first", "item", "last", "col").agg(F.sort_array(F.collect_list(F.struct("row", "text"))).alias("t"))
    name = F.array_join(F.array_distinct(F.transform("t", lambda x: x["text"])), " ")
    top = F.when(F.get("t", 0)["row"] == F.col("first"), F.get("t", 0)["text"])
    columns = by_column.groupBy(*KEYS, "first", "item", "last").agg(F.sort_array(F.collect_list(F.struct("col", name.alias("name"), top.alias("top")))).alias("names"))

    def claim(taken: Column, role: Column) -> Column:
        free = F.filter("names", lambda n: F.rlike(n["name"], role["pattern"]) & ~F.exists(taken, lambda t: t["col"] == n["col"]))
        return F.concat(taken, F.transform(F.slice(free, 1, 1), lambda n: F.struct(role["role"].alias("role"), n["col"].alias("col"), n["top"].alias("top"))))

    none = F.array().cast("array<struct<role:string,col:int,top:string>>")
    begin = F.when(F.col("item").isNotNull(), F.array(F.struct(F.lit("item").alias("role"), F.col("item").cast("int").alias("col"), F.lit(None).cast("string").alias("top"))).cast("array<struct<role:string,col:int,top:string>>")).otherwise(none)
    roles = F.array(*[F.struct(F.lit(r).alias("role"), F.lit(p).alias("pattern")) for r, p in ROLES])
    claimed = columns.withColumn("claims", F.aggregate(roles, begin, claim))
    by_role = claimed.withColumn("col", F.map_from_entries(F.transform("claims", lambda c: F.struct(c["role"], c["col"])))).withColumn("top", F.map_from_entries(F.transform("claims", lambda c: F.struct(c["role"], c["top"]))))
    pick = lambda m, r: F.try_element_at(m, F.lit(r))
    tor, top_tor = F.coalesce(pick("col", "tor"), pick("col", "specification")), F.when(pick("col", "tor").isNotNull(), pick("top", "tor")).otherwise(pick("top", "specification"))
    # a title over the whole table names both columns at once: that is no header
    apart = F.col("item").isNotNull() | ~top_tor.eqNullSafe(pick("top", "proposal"))
    good = by_role.where(tor.isNotNull() & pick("col", "proposal").isNotNull() & apart)
    entries = F.filter(F.map_entries(F.map_concat(F.map_filter("col", lambda r, _: ~r.isin("tor", "specification")), F.create_map(F.lit("tor"), tor))), lambda e: e["value"].isNotNull())
    return good.groupBy(*KEYS).agg(F.min_by(F.struct("first", "last", F.map_from_entries(entries).alias("columns")), "first").alias("h")).select(*KEYS, "h.*")


def word_roles(cells: DataFrame, item: str = ITEM) -> DataFrame:
    """path, part, offer, no_offer, reference_from, reference_to, remark_from, remark_to of each table with a dotted item number.

    cells: path, part, row, place (in its row), col (of the grid), span, text. The offer is the column at which the
    third cells of numbered rows mostly begin; it is none if that column holds only tick boxes. The reference and
    remark columns are those that a header row names; else the reference column is where most reference-like cells
    stand, and the remark column the first one with text behind it. Of equally common columns the smallest."""
    text = F.coalesce("text", F.lit(""))
    row, table = Window.partitionBy(*KEYS, "row"), Window.partitionBy(*KEYS)
    lead = F.max(F.when(F.col("place") == 0, text)).over(row)
    marked = cells.select(*KEYS, "row", "place", "col", "span", text.alias("text"), lead.alias("lead"))
    marked = marked.withColumn("numbered", F.coalesce(F.col("lead").rlike(NUMBERED), F.lit(False))).withColumn("begin", F.min(F.when(F.col("numbered"), F.col("row"))).over(table))
    said, third = ~F.col("text").rlike(TICKS), F.col("numbered") & (F.col("place") >= 2)
    above = F.col("row") < F.col("begin")
    head = above & (F.col("place") >= 2)
    like = third & arabic_digits(F.col("text")).rlike(LIKE_REFERENCE)
    first_of = lambda cond: F.min(F.when(cond, F.struct("row", "place", "col", "span")))
    # one aggregation a column, and one over a table's columns
    columns = marked.groupBy(*KEYS, "col").agg(
        F.count_if(third & (F.col("place") == 2)).alias("n_third"),
        F.count_if(like).alias("n_like"),
        F.count_if(third & said).alias("n_said"),
        F.max(F.when(F.col("place") == 0, F.regexp_replace("text", r"\s+", "").rlike(DOTTED))).alias("dotted"),
        F.max(above & (F.col("place") == 0) & F.col("text").rlike(item)).alias("headed"),
        first_of(head & F.col("text").rlike(REFERENCE) & ~F.col("text").rlike(REMARK)).alias("reference"),
        first_of(head & F.col("text").rlike(REMARK)).alias("remark"),
    )
    most = lambda n: F.max_by(F.when(F.col(n) > 0, F.col("col")), F.when(F.col(n) > 0, F.struct(n, -F.col("col"))))
    tables = columns.groupBy(*KEYS).agg(
        most("n_third").alias("offer"), most("n_like").alias("like"), F.max("dotted").alias("dotted"), F.coalesce(F.max("headed"), F.lit(False)).alias("headed"), F.min("reference").alias("reference"), F.min("remark").alias("remark"),
        F.collect_list(F.when(F.col("n_said") > 0, F.col("col"))).alias("said"),
    ).where("dotted")
    named = lambda c: F.when(F.col("headed"), F.col(c))
    behind = F.when(~F.col("headed"), F.array_min(F.filter("said", lambda c: c > F.col("like"))))
    end = lambda c: named(f"{c}.col") + named(f"{c}.span") - 1
    return tables.select(
        *KEYS, "offer", (F.col("offer").isNotNull() & ~F.array_contains("said", F.col("offer"))).alias("no_offer"),
        F.coalesce(named("reference.col"), "like").alias("reference_from"), F.coalesce(end("reference"), "like").alias("reference_to"),
        F.coalesce(named("remark.col"), behind).alias("remark_from"), F.coalesce(end("remark"), behind).alias("remark_to"),
    )
