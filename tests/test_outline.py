"""Items of documents equal a plain reading of their pages, line by line."""

import random
import re

from tessellate.operators import outline as O

PAGES = "doc_id long, page int, text string, picture boolean"


def read(pages, first, last):
    """(rows, warnings) of one document's pages {page: (text, picture)}: rows as [item, lines, heading, page, picture, style]."""
    arabic = str.maketrans("๐๑๒๓๔๕๖๗๘๙", "0123456789")
    rows, intro, loose, unread, stop = [], set(), [], [], None
    begun = annexed = title_open = False
    current = title = document = major = listed = last_number = None
    for page in range(first, last + 1):
        if stop:
            break
        text, picture = pages.get(page, (None, False))
        if not picture and not (text or "").strip():
            unread.append(page)
            continue
        before = current
        for line in (t.strip() for t in (text or "").split("\n")):
            if not line or re.search(r"^[-–]\s*[0-9๐-๙]+\s*[-–]$", line):
                continue
            names = re.search(O.DOCUMENT, line)
            if names:
                document = document or names[1]
                if names[1] != document and begun:
                    stop = (page, line[:40])
                    break
            m = re.search(O.NUMBER, line)
            number = [int(x) for x in (m[1] + m[2]).translate(arabic).strip(".").split(".")] if m and ("." in m[1] or m[2]) else None
            opens = False
            if number and not re.search(O.ANNEX, line):
                if len(number) == 1 and annexed:
                    opens = number[0] == 1 or number[0] == (last_number[0] if last_number else 0) + 1
                elif len(number) == 1:
                    opens = major is None or (number[0] > major and listed != number[0] - 1)
                else:
                    opens = major is None or (number[0] == major and number > last_number) or number[0] == major + 1 or (annexed and number[0] == 1)
            if re.search(O.ANNEX, line):
                current = ["", [line], True, page, picture, None]
                rows.append(current)
                begun = annexed = True
                last_number = major = listed = None
            elif opens:
                major, listed, last_number, begun = number[0], None, number, True
                current = [m[1] + m[2], [m[3]] if m[3] else [], len(number) == 1, page, picture, None]
                rows.append(current)
            else:
                if number and len(number) == 1:
                    listed = number[0]
                sub = re.search(r"^(?:[-–•]\s+(.+)|(\(?[0-9๐-๙]+\))\s*(.*))$", line)
                plain = re.sub(r"^[#*\s]+|[*\s]+$", "", line)
                bold = bool(re.search(r"^\*\*.*\*\*$", line))
                if begun and sub:
                    current = [sub[2] or "", [t for t in [sub[1] or sub[3]] if t], False, page, False, None]
                    rows.append(current)
                elif begun:
                    current[1].append(line)
                elif plain:
                    intro.add(page)
                    if title and title_open and bold and len(title[1]) < 2:
                        title[1].append(plain)
                        title_open = len(title[1]) < 2
                    else:
                        title_open = bool(not title and re.search(O.DOCUMENT, plain))
                        current = ["", [plain], True, page, False, "title" if title_open else "underlined" if bold else None]
                        title = current if title_open else title
                        rows.append(current)
        if picture and current is before:
            if current:
                current[4] = True
            else:
                loose.append(page)
    if not begun:
        return [], {("no_items", None, None)}
    warn = {("intro", p, None) for p in intro} | {("loose_picture", p, None) for p in loose} | {("unread", p, None) for p in unread}
    warn |= {("picture", r[3], r[0] or (r[1][0] if r[1] else "")) for r in rows if r[4]}
    return rows, warn | ({("stopped", *stop)} if stop else set())


def compare(spark, docs, ranges=None):
    rows = [(d, p, *page) for d, pages in docs.items() for p, page in pages.items()]
    df = spark.createDataFrame(rows, PAGES)
    asked = spark.createDataFrame([(d, *r) for d, r in ranges.items()], "doc_id long, first int, last int") if ranges else None
    got_rows, got_warnings = O.outline(df, asked)
    got, said = {d: [] for d in docs}, {d: set() for d in docs}
    for r in got_rows.orderBy("doc_id", "row").collect():
        got[r.doc_id].append([r.item, r.text.split("\n") if r.lines else [], r.heading, r.page, r.picture, r.style])
    for w in got_warnings.collect():
        said[w.doc_id].add((w.kind, w.page, w.what))
    where = ranges or {r.doc_id: (r.first, r.last) for r in O.auto_ranges(df).collect()}
    for d, pages in docs.items():
        want = read(pages, *where[d])
        assert got[d] == want[0], d
        assert said[d] == want[1], d
    return got, said


def test_items_of_pages(spark):
    docs = {
        1: {1: ("เอกสาร ผนวก ข\n**ระบบ**\nบทนำ\n๑. หัวข้อ\n๑.๑ ข้อ\nต่อ\n- ขีด\n๑) รายการ\n34.8 mm\n- ๑๒ -", False), 2: ("", True), 3: ("  ", False), 4: ("2. b\n1. list\n2. list\n3. list\n3.1 next\nเอกสาร ผนวก ค\n4. lost", True), 5: ("5. lost too", False), 6: (None, False)},
        2: {1: ("ผนวก 1\n1. a\n1.1 b\n1. again\n3. no\n2. c\nผนวก ๒\n1. d", True)},
        3: {1: ("no numbers here\n12 x", False), 2: (None, None)},
        4: {1: ("", True), 2: ("**bold**\n5. five\n5.2 b\n5.1 back\n6.1 c\n7 seven", False)},
        5: {1: ("", False)},
    }
    got, said = compare(spark, docs, {d: (1, 6) for d in docs})
    assert [r[0] for r in got[1]] == ["", "", "๑.", "๑.๑", "", "๑)", "2.", "3.1"] and ("stopped", 4, "เอกสาร ผนวก ค") in said[1] and ("unread", 3, None) in said[1]
    assert got[1][0][1] == ["เอกสาร ผนวก ข", "ระบบ"] and got[5] == [] and said[3] == {("no_items", None, None)}


def test_random_documents(spark):
    rng = random.Random(11)

    def line():
        return rng.choice([f"{rng.randint(1, 5)}. t", f"{rng.randint(1, 4)}.{rng.randint(1, 3)} t", f"{rng.randint(1, 4)}.{rng.randint(1, 3)}.{rng.randint(1, 3)}", "text", "**bold**", "- bullet", "(2) listed", "๓) x", "- 4 -", "* # *", rng.choice(["ผนวก 1", "ผนวก ๒", "เอกสาร ผนวก ก", "เอกสาร ผนวก ข", "text"])])

    docs = {d: {p: ("\n".join(line() for _ in range(rng.choice([0, 1, 6, 12]))), rng.random() < 0.3) for p in range(1, rng.randint(2, 7))} for d in range(60)}
    compare(spark, docs, {d: (rng.choice([1, 1, 2]), 9) for d in docs})
    compare(spark, docs)


def test_ranges(spark):
    page = lambda t, picture=False: (t, picture)
    docs = [[page("1. เงื่อนไขทั่วไป"), page("สารบัญ"), page("เอกสาร ผนวก ข\n1. ระบบ"), page("1.1 รายการ")], [page("ข้อความ"), page("คุณลักษณะเฉพาะ\n1. กล้อง")], [page("5. คุณลักษณะเฉพาะของผู้ยื่น"), page("เอกสาร ผนวก ก", True)]]
    df = spark.createDataFrame([(d, p + 1, *x) for d, pages in enumerate(docs) for p, x in enumerate(pages)], PAGES)
    assert sorted((r.doc_id, r.first, r.last, r.found) for r in O.auto_ranges(df).collect()) == [(0, 3, 4, True), (1, 2, 2, True), (2, 1, 2, False)]
    asked = spark.createDataFrame([(0, 3, 3), (0, 3, 4), (0, 3, 4), (0, 4, 2), (1, 0, 2), (2, 1, 1)], "doc_id long, first int, last int")
    rows, warnings = O.outline(df, asked)
    assert sorted((r.doc_id, r.item) for r in rows.collect()) == [(0, ""), (0, "1."), (0, "1.1"), (2, "5.")]
    assert {(w.doc_id, w.what) for w in warnings.where("kind = 'range'").collect()} == {(0, "4-2"), (1, "0-2")}
    empty = O.outline(df.where("page > 99"))
    assert empty[0].collect() == [] and empty[1].collect() == []
