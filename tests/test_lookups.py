"""The dictionary's index against its rule, and located rows against a walk over the tables."""

import random
import re

from tessellate.plans.catalog import runs_of_words
from tessellate.plans.lookups import located_rows, matched_terms


def test_index_of_terms(spark):
    terms = [("fiber", "Fiber Optic", "ใยแก้วนำแสง", ["ไฟเบอร์", "fibre cable"]), ("ma", "MA", "บำรุงรักษา", ["managed service", "maintenance"]), ("smart", "Smart City", None, None), ("none", None, None, [])]
    asks = ["fib", "FIBRE", "opt", "c", "it", "ma", "MA ", "man", "managed service", "managed s", "แก้ว", "ไฟเ", "บำ", "", "  ", None, "service", "ser", "se", "city", "cab le"]

    def finds(term, ask, whole):
        q = (ask or "").strip().lower()
        thai = any("฀" <= c <= "๿" for c in q)
        for text in (t.lower() for t in [term[2] if thai else term[1], *(term[3] or [])] if t):
            words = [w for w in re.split("[^a-z0-9]+", text) if w]
            if not q:
                continue
            if thai and q in text:
                return True
            if not thai and whole and (text == q or any(w == q or (len(q) >= 3 and w.startswith(q)) for w in words)):
                return True
            if not thai and not whole and (text.startswith(q) or any(w.startswith(q) for w in words)):
                return True
        return False

    t = spark.createDataFrame(terms, "value string, en string, th string, synonyms array<string>")
    a = spark.createDataFrame([(x,) for x in asks], "ask string")
    for whole in (False, True):
        got = {tuple(r) for r in matched_terms(a, t, whole).collect()}
        assert got == {(ask, term[0]) for ask in asks for term in terms if finds(term, ask, whole)}
    assert matched_terms(a, t.where("false"), True).collect() == []


def find(tables, annexed, number, item):
    """tables {no: [(cell, annex)]}: the (table, place) asked for, by a walk."""
    normal = lambda s: re.sub(r"\.$", "", re.sub(r"\s", "", s).translate(str.maketrans("๐๑๒๓๔๕๖๗๘๙", "0123456789")))
    has = lambda s: bool(re.search(r"[0-9]", normal(s)))

    def bears(cell, only):
        if normal(cell) == normal(item):
            return True
        m = re.fullmatch(r"\(?(\d+(?:\.\d+)*)[.)]?", re.sub(r"\s", "", cell).translate(str.maketrans("๐๑๒๓๔๕๖๗๘๙", "0123456789")))
        if not m:
            return only and not has(cell)
        own, full = [int(x) for x in m[1].split(".")], normal(item).split(".")
        return len(full) > len(own) and all(f.isdigit() and int(f) == o for f, o in zip(full[-len(own):], own))

    key = str(int(normal(item).split(".")[0])) if re.fullmatch(r"\d+(\.\d+)*", normal(item)) else None
    own = [t for t in sorted(tables) if len(tables[t]) >= number and (not annexed or tables[t][number - 1][1] == key)]
    for t in own:
        if bears(tables[t][number - 1][0], len(own) == 1):
            return t, number
    under = []
    for t in own:
        cells = [c for c, _ in tables[t][:number]]
        above = next((c for c in reversed(cells[:-1]) if has(c)), None)
        if not has(cells[-1]) and above is not None and bears(above, False):
            under.append(t)
    if len(under) == 1:
        return under[0], number
    same = [(t, p + 1) for t in tables for p, (c, _) in enumerate(tables[t]) if normal(c) == normal(item)]
    return same[0] if len(same) == 1 and not annexed else (None, None)


def test_located_rows(spark):
    rng = random.Random(5)
    cell = lambda: rng.choice([None, "-", "", f"{rng.randint(1, 3)}.{rng.randint(1, 3)}", f"{rng.randint(1, 3)} . {rng.randint(1, 3)}.", f"({rng.randint(1, 3)})", f"{rng.randint(1, 3)})", "๒.๑", "05", "1.2.3", "2.a", "x1"])
    docs = {}
    for d in range(80):
        annexed = d % 3 == 0
        docs[d] = {t: [(cell(), rng.choice([None, "1", "2"]) if annexed else None) for _ in range(rng.randint(1, 6))] for t in range(rng.randint(1, 3))}
    asks = [(d, rng.randint(1, 7), rng.choice([cell(), cell(), "1.2", "2.1", "5.1.2", "a.2"])) for d in list(docs) + [99] for _ in range(12)]
    rows = [(d, t, p + 1, c, x) for d, tables in docs.items() for t, rs in tables.items() for p, (c, x) in enumerate(rs)]
    got = located_rows(spark.createDataFrame(asks, "doc_id long, row_number int, item string"), spark.createDataFrame(rows, "doc_id long, table_no int, place int, item string, annex string")).collect()
    assert len(got) == len({(d, n, i or "") for d, n, i in asks})
    for r in got:
        tables = {t: [(c or "", x) for c, x in rs] for t, rs in docs.get(r.doc_id, {}).items()}
        annexed = any(x for rs in tables.values() for _, x in rs)
        assert (r.table_no, r.place) == find(tables, annexed, r.row_number, r.item), r


def test_runs_of_words():
    assert runs_of_words("small purple ring") == ["small purple", "purple ring", "purple", "small", "ring"]
    # "ข่าย" is three letters and a mark
    assert runs_of_words("แม่ ข่าย ระบบงาน", generic=("ระบบงาน",)) == ["ข่าย ระบบงาน", "แม่ ข่าย"]
    assert runs_of_words("MA System it", generic=("system",)) == ["MA System", "System it"] and runs_of_words("one") == []
