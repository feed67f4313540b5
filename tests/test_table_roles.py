"""Headers of random grids and column profiles of random tables against walks over one grid at a time."""

import random
import re

from tessellate.operators import table_roles as R

CELLS, MERGES = "path string, part string, row int, col int, text string", "path string, part string, top int, left int, bottom int, right int"
WORDS = ["Item", "No.", "Requirement", "TOR", "Offer", "Proposal", "Remark", "Reference", "Comply", "Better", "Description", "text", "", "", "", "x1"]


def compiled(p):
    return re.compile(p)


def walked_header(cells, merges, n_rows, needs_item):
    own = lambda r, c: cells.get((r, c), "")
    at = lambda r, c: next((m for m in merges if m[0] <= r <= m[2] and m[1] <= c <= m[3]), None)
    shown = lambda r, c: own(*at(r, c)[:2]) if at(r, c) else own(r, c)
    width = range(max([c for _, c in cells] + [m[3] for m in merges], default=-1) + 1)
    for first in range(n_rows):
        item = next((c for c in width if re.search(R.ITEM, own(first, c))), None)
        if item is None and needs_item:
            continue
        last = first
        while last - first + 1 < R.DEEPEST and last + 1 < n_rows:
            row = last + 1
            under = lambda c: any((m := at(r, c)) and m[3] > m[1] and own(*m[:2]) for r in range(first, row))  # noqa: E731, B023
            if item is not None and own(row, item) or not all(not own(row, c) or under(c) for c in width):
                break
            last = row
        names = [" ".join(dict.fromkeys(t for r in range(first, last + 1) if (t := shown(r, c)))) for c in width]
        found = {} if item is None else {"item": item}
        for role, pattern in R.ROLES:
            c = next((c for c in width if c not in found.values() and re.search(pattern, names[c])), None)
            if c is not None:
                found[role] = c
        tor, proposal = found.get("tor", found.get("specification")), found.get("proposal")
        if tor is None or proposal is None or item is None and shown(first, tor) == shown(first, proposal):
            continue
        return first, last, {k: v for k, v in found.items() if k not in ("tor", "specification")} | {"tor": tor}
    return None


def test_headers_equal_a_walk(spark):
    rng, grids = random.Random(6), {}
    for g in range(160):
        n, width = rng.randint(1, 7), rng.randint(2, 6)
        cells = {(r, c): t for r in range(n) for c in range(width) if (t := rng.choice(WORDS))}
        merges = []
        for _ in range(rng.choice([0, 1, 2, 3])):
            t, x = rng.randrange(n), rng.randrange(width)
            m = (t, x, min(n - 1, t + rng.choice([0, 0, 1])), min(width - 1, x + rng.choice([0, 1, 2])))
            if not any(a[0] <= m[2] and m[0] <= a[2] and a[1] <= m[3] and m[1] <= a[3] for a in merges):
                merges.append(m)
                cells = {k: v for k, v in cells.items() if k == (t, x) or not (m[0] <= k[0] <= m[2] and m[1] <= k[1] <= m[3])}
        cells[n - 1, width - 1] = "end"
        grids[f"g{g}"] = (cells, merges, n)
    df = spark.createDataFrame([(g, "s", r, c, t) for g, (cells, _, _) in grids.items() for (r, c), t in cells.items()], CELLS)
    spans = spark.createDataFrame([(g, "s", *m) for g, (_, merges, _) in grids.items() for m in merges], MERGES)
    for needs_item in (True, False):
        got = {r.path: (r.first, r.last, r.columns) for r in R.headers(df, spans, needs_item).collect()}
        want = {g: w for g, (cells, merges, n) in grids.items() if (w := walked_header(cells, merges, n, needs_item))}
        assert got == want and len(want) > 10
    assert R.headers(df.limit(0), spans.limit(0)).count() == 0


def walked_roles(rows):
    """rows: place-ordered cells (col, span, text) of one table."""
    mode = lambda v: min(set(v), key=lambda x: (-v.count(x), x)) if v else None
    if not any(re.search(R.DOTTED, re.sub(r"\s+", "", row[0][2])) for row in rows):
        return None
    numbered = [row for row in rows if re.search(R.NUMBERED, row[0][2])]
    above = rows[: rows.index(numbered[0])] if numbered else []
    said = lambda t: not re.search(R.TICKS, t)
    later = [c for row in numbered for c in row[2:]]
    offer = mode([row[2][0] for row in numbered if len(row) > 2])
    no_offer = offer is not None and not any(c[0] == offer and said(c[2]) for c in later)
    headed = any(re.search(R.ITEM, row[0][2]) for row in above)
    heads = [c for row in above for c in row[2:]]
    reference = next((c for c in heads if re.search(R.REFERENCE, c[2]) and not re.search(R.REMARK, c[2])), None) if headed else None
    like = mode([c[0] for c in later if re.search(R.LIKE_REFERENCE, c[2])])
    remark = next((c for c in heads if re.search(R.REMARK, c[2])), None)
    behind = min([c[0] for c in later if like is not None and c[0] > like and said(c[2])], default=None)
    span = lambda c: (c[0], c[0] + c[1] - 1) if c else (None, None)
    return (offer, no_offer, *(span(reference) if reference else (like, like)), *(span(remark) if headed else (behind, behind)))


def test_profiles_equal_a_walk(spark):
    rng, tables = random.Random(9), {}
    for t in range(200):
        rows = []
        for r in range(rng.randint(1, 8)):
            lead = rng.choice(["1.1", "2", "(3)", "Item", "a title", "1. 2", "๑.๒", ""] if r > 1 else ["Item", "No.", "title", "1.1"])
            cells, col = [(0, 1, lead)], 1
            for _ in range(rng.randint(1, 5)):
                width = rng.choice([1, 1, 2])
                cells.append((col, width, rng.choice(["☑", "", "page 5", "text", "Reference", "Remark", "Reference notes", "see a.pdf", "more"])))
                col += width + rng.choice([0, 0, 1])
            rows.append(cells)
        tables[f"t{t}"] = rows
    data = [(t, "0", r, p, col, span, text) for t, rows in tables.items() for r, cells in enumerate(rows) for p, (col, span, text) in enumerate(cells)]
    df = spark.createDataFrame(data, "path string, part string, row int, place int, col int, span int, text string").repartition(5)
    got = {r.path: tuple(r)[2:] for r in R.word_roles(df).collect()}
    want = {t: w for t, rows in tables.items() if (w := walked_roles(rows))}
    assert got == want and len(want) > 50
    assert R.word_roles(df.limit(0)).count() == 0
