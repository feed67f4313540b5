"""The pages of a document as numbered items, with what a reader has to look at (K7).

Lines are read by column expressions; one walk over a document's lines, which may fill many tasks, decides where an
item begins; items and warnings are aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import arabic_digits
from .alignment import repair_glyphs
from .scan import ordered_scan

#: The forms of item numbers, printed page numbers, headings of documents and annexes, sub-lines, and
#: headings that open a specification.
NUMBER = r"^[#*\s]*([0-9๐-๙]+(?:\.[0-9๐-๙]+)*)(\.?)(?:\s+(.*))?$"
PRINTED_PAGE = r"^[-–]\s*[0-9๐-๙]+\s*[-–]$"
DOCUMENT = r"^[#*\s]*เอกสาร\s*(?:ภาค)?\s*ผนวก\s*([ก-ฮ]|[0-9๐-๙]+)"
ANNEX = r"^\s*ผนวก\s*([0-9๐-๙]+)\s*$"
BULLET = r"^[-–•]\s+(.+)$"
LISTED = r"^(\(?[0-9๐-๙]+\))\s*(.*)$"
SPECIFICATION = r"^[#*\s]*(?:เอกสาร\s*(?:ภาค)?\s*ผนวก\s*(?:[ก-ฮ]|[0-9๐-๙]+)|(?:คุณลักษณะเฉพาะ|คุณสมบัติทางเทคนิค|ขอบเขตของงาน)(?:\s|$))"
CONTROL = "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f￾￿]"
SHOWN_OF_LINE = 40
TITLE_LINES = 2

START = {"row": 0, "before": 0, "begun": False, "annexed": False, "document": None, "stop": 0, "last": None, "major": None, "listed": None, "title": 0, "title_lines": 0, "title_open": False}


def auto_ranges(pages: DataFrame) -> DataFrame:
    """(doc_id, first, last, found): from the first text page with a heading of the specification, else the whole document."""
    opens = F.exists(F.split(repair_glyphs(F.coalesce("text", F.lit(""))), "\n"), lambda t: F.trim(t).rlike(SPECIFICATION))
    first = F.min(F.when(~F.coalesce("picture", F.lit(False)) & opens, F.col("page")))
    return pages.groupBy("doc_id").agg(F.coalesce(first, F.lit(1)).alias("first"), F.max("page").alias("last"), first.isNotNull().alias("found"))


def _takes_number(s: dict, number: list[int]) -> bool:
    """Whether a number opens an item where the document stands; if not, a plain one runs a list."""
    first, last, major = number[0], s["last"], s["major"]
    if len(number) == 1:
        if s["annexed"]:
            # sub-headings without numbers begin at 1 again
            opens = first in (1, (last[0] if last else 0) + 1)
        else:
            opens = major is None or (first > major and s["listed"] != first - 1)
    else:
        later = first == major and last is not None and number > last
        opens = major is None or later or first == major + 1 or (s["annexed"] and first == 1)
    if opens:
        s.update(major=first, listed=None, last=number)
    elif len(number) == 1:
        s["listed"] = first
    return opens


def _before_items(s: dict, named: bool, bold: bool) -> str:
    """A line above the first item: the document's heading and a bold line after it are one title, others are rows."""
    if s["title_open"] and bold and s["title_lines"] < TITLE_LINES:
        s["title_lines"] += 1
        s["title_open"] = s["title_lines"] < TITLE_LINES
        return "title"
    s["row"] += 1
    s["title_open"] = named and not s["title"]
    if s["title_open"]:
        s.update(title=s["row"], title_lines=1)
        return "title"
    return "underlined" if bold else "plain"


def _line(state: dict, end, picture, heading, annex, number, sub, bold, shown) -> tuple[dict, tuple]:
    """The row a line belongs to and its part there; a page's end tells what its picture goes with."""
    s = dict(state)
    if s["stop"] == 2 or (s["stop"] and not end):
        return s, (None, "after")
    if end:
        own = s["before"] == s["row"]
        s.update(before=s["row"], stop=2 if s["stop"] else 0)
        if not (picture and own):
            return s, (None, "end")
        return s, (s["row"], "picture") if s["row"] else (None, "loose")
    if heading:
        s["document"] = s["document"] or heading
        if heading != s["document"] and s["begun"]:
            s["stop"] = 1
            return s, (None, "stop")
    if annex:
        s.update(row=s["row"] + 1, begun=True, annexed=True, last=None, major=None, listed=None)
        return s, (s["row"], "annex")
    if number and _takes_number(s, number):
        s.update(row=s["row"] + 1, begun=True)
        return s, (s["row"], "heading" if len(number) == 1 else "item")
    if s["begun"]:
        s["row"] += bool(sub)
        return s, (s["row"], "sub" if sub else "text")
    if not shown:
        return s, (None, "blank")
    kind = _before_items(s, bool(heading), bold)
    return s, (s["title"] if kind == "title" else s["row"], kind)


def _lines(pages: DataFrame) -> DataFrame:
    """Lines as the walk reads them, and an end row a page."""
    text = repair_glyphs(F.coalesce("text", F.lit("")))
    picture = F.coalesce("picture", F.lit(False))
    taken = pages.select("doc_id", "page", text.alias("all"), picture.alias("picture")).where(F.col("picture") | F.col("all").rlike(r"\S"))
    line = F.regexp_replace(F.regexp_replace("raw", CONTROL, ""), r"^\s+|\s+$", "")
    own = taken.select("doc_id", "page", "picture", F.posexplode(F.split("all", "\n")).alias("place", "raw")).select("doc_id", "page", "picture", "place", line.alias("line"), F.lit(False).alias("end"))
    ends = taken.select("doc_id", "page", "picture", F.lit(2**31 - 1).alias("place"), F.lit("").alias("line"), F.lit(True).alias("end"))
    found = lambda pattern, k: F.nullif(F.regexp_extract("line", pattern, k), F.lit(""))
    label = F.concat(F.regexp_extract("line", NUMBER, 1), F.regexp_extract("line", NUMBER, 2))
    number = F.when(F.contains(label, F.lit(".")), F.transform(F.filter(F.split(arabic_digits(label), r"\."), lambda p: p != ""), lambda p: p.cast("long")))
    listed = found(LISTED, 1)
    bullet = found(BULLET, 1)
    plain = F.regexp_replace("line", r"^[#*\s]+|[*\s]+$", "")
    kept = own.where((F.col("line") != "") & ~F.col("line").rlike(PRINTED_PAGE)).unionByName(ends)
    return kept.select(
        "*", found(DOCUMENT, 1).alias("heading"), F.col("line").rlike(ANNEX).alias("annex"), number.alias("number"), label.alias("label"), F.regexp_extract("line", NUMBER, 3).alias("rest"),
        (listed.isNotNull() | bullet.isNotNull()).alias("sub"), listed.alias("listed"), F.coalesce(bullet, F.regexp_extract("line", LISTED, 2)).alias("sub_text"),
        F.col("line").rlike(r"^\*\*.*\*\*$").alias("bold"), plain.alias("plain"), (plain != "").alias("shown"),
    )


def outline(pages: DataFrame, ranges: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """pages (doc_id, page from 1, text, picture) and ranges (doc_id, first, last; else auto_ranges) to rows and warnings.

    rows (doc_id, row, page, item, text, lines, heading, picture, style): an item with the lines that go on with it, an
    annex heading, a sub-line, or a line above the first item. warnings (doc_id, kind, page, what): intro, loose_picture,
    picture, stopped (another document begins), unread (or not there), no_items (then the document has no rows), range (a range that
    is none; it takes no pages). Null texts are empty, repeated ranges count once, further columns are ignored."""
    asked = (auto_ranges(pages) if ranges is None else ranges).select("doc_id", "first", "last").distinct()
    sound = F.coalesce((F.col("first") >= 1) & (F.col("last") >= F.col("first")), F.lit(False))
    r = asked.where(sound).withColumnRenamed("doc_id", "_doc")
    chosen = pages.select("doc_id", "page", "text", "picture").join(r, (F.col("doc_id") == F.col("_doc")) & F.col("page").between(F.col("first"), F.col("last")), "left_semi")
    reads = ["end", "picture", "heading", "annex", "number", "sub", "bold", "shown"]
    walked = ordered_scan(_lines(chosen), "doc_id", ["page", "place"], reads, START, _line, "row long, part string").checkpoint()

    begins = F.col("part").isin("heading", "item")
    text = F.when(begins, F.col("rest")).when(F.col("part") == "sub", F.col("sub_text")).when(F.col("part").isin("title", "underlined", "plain"), F.col("plain")).otherwise(F.col("line"))
    content = F.when(~F.col("end") & (text != ""), F.struct("page", "place", text.alias("t")))
    opens = ~F.col("end") & (F.col("part") != "text")
    first = lambda c: F.min_by(c, F.struct("page", "place"))
    own = walked.where("row IS NOT NULL").groupBy("doc_id", "row").agg(
        F.min("page").alias("page"),
        F.max(F.when(begins, F.col("label")).when(F.col("part") == "sub", F.col("listed"))).alias("item"),
        F.sort_array(F.collect_list(content)).alias("parts"),
        first("part").alias("kind"),
        (F.coalesce(F.max(F.when(opens & F.col("part").isin("annex", "heading", "item"), F.col("picture"))), F.lit(False)) | (F.count_if(F.col("part") == "picture") > 0)).alias("picture"),
    )
    numbered = walked.groupBy("doc_id").agg((F.count_if(F.col("part").isin("annex", "heading", "item")) > 0).alias("any"))
    rows = own.join(numbered.where("any"), "doc_id", "left_semi").select(
        "doc_id", "row", "page", F.coalesce("item", F.lit("")).alias("item"), F.array_join(F.transform("parts", lambda p: p["t"]), "\n").alias("text"), F.size("parts").alias("lines"),
        F.col("kind").isin("annex", "heading", "title", "underlined", "plain").alias("heading"), "picture", F.when(F.col("kind").isin("title", "underlined"), F.col("kind")).alias("style"),
    )

    say = lambda df, kind, page="page", what=None: df.select("doc_id", F.lit(kind).alias("kind"), F.col(page).cast("long").alias("page"), (F.lit(None).cast("string") if what is None else what).alias("what"))
    stops = walked.where("part = 'stop'")
    blank = chosen.where(~F.coalesce("picture", F.lit(False)) & ~F.coalesce(repair_glyphs(F.col("text")).rlike(r"\S"), F.lit(False)))
    absent = r.select(F.col("_doc").alias("doc_id"), F.explode(F.sequence("first", "last")).alias("page")).join(pages, ["doc_id", "page"], "left_anti")
    until = stops.select("doc_id", F.col("page").alias("stop"))
    unread = blank.select("doc_id", "page").unionByName(absent).join(until, "doc_id", "left").where("stop IS NULL OR page < stop").select("doc_id", "page").distinct()
    some = numbered.where("any").select("doc_id")
    # also a document whose ranges hold no page, or unread pages only, so that no line of it was walked
    none = r.select(F.col("_doc").alias("doc_id")).distinct().join(some, "doc_id", "left_anti")
    named = F.when(F.col("item") != "", F.col("item")).otherwise(F.substring_index("text", "\n", 1))
    notes = [
        say(walked.where("part IN ('title', 'underlined', 'plain')").select("doc_id", "page").distinct(), "intro"),
        say(walked.where("part = 'loose'"), "loose_picture"),
        say(rows.where("picture"), "picture", what=named),
        say(stops, "stopped", what=F.substring("line", 1, SHOWN_OF_LINE)),
        say(unread, "unread"),
    ]
    warnings = notes[0]
    for more in notes[1:]:
        warnings = warnings.unionByName(more)
    # a document without items has that one warning
    warnings = warnings.join(some, "doc_id", "left_semi").unionByName(say(none.withColumn("page", F.lit(None)), "no_items"))
    bad = asked.where(~sound).select("doc_id", F.col("first").alias("page"), F.concat_ws("-", "first", "last").alias("range"))
    return rows, warnings.unionByName(say(bad, "range", what=F.col("range")))
