"""Signatures against an exhaustive search, the damaged query against a plain walk, ties, nulls and long conversations."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tessellate.llm import conversation_repair as cr

SCHEMA = "conv_id long, turn long, role string, text string"


def exhaustive(signature):
    """Every edit sequence with at most two insertions a gap, by the pattern itself."""
    best = None
    options = []
    for s in signature:
        initial, fault = cr.read_symbol(s)
        stays = [(e, r, c + (3 if fault == "truncated" else 0)) for e, r, c in (("K", initial, 0), ("R", "u", 3), ("R", "a", 3))]
        options.append([("D", "", 4)] + (stays if fault in ("fine", "truncated") else []))
    gaps = [()] + [tuple(x) for n in (1, 2) for x in itertools.product("ua", repeat=n)]
    for rows in itertools.product(*options):
        for inserts in itertools.product(gaps, repeat=len(rows) + 1):
            parts = [("I", r, 3) for r in inserts[0]]
            for row, more in zip(rows, inserts[1:]):
                parts += [row, *[("I", r, 3) for r in more]]
            if re.fullmatch("(s?(ua)+)?", "".join(p[1] for p in parts)):
                found = (sum(p[2] for p in parts), "".join(p[0] for p in parts))
                best = min(best, found) if best else found
    return best


@pytest.mark.parametrize("n", range(4))
def test_solver_equals_exhaustive_search(n):
    symbols = "".join(cr.SYMBOLS.values()) if n < 2 else "uasxUAS18"
    for s in itertools.product(symbols, repeat=n):
        if n < 3 or zlib.crc32("".join(s).encode()) % 25 == 0:
            assert cr.solve("".join(s)) == exhaustive(s), s


def test_long_signature_and_depth():
    cost, audit = cr.solve("ua" * 30_000 + "u")
    assert (cost, audit) == (3, "K" * 60_001 + "I")
    assert cr.solve("u" * 2001)[0] == 3 * 1000 + 3


def walked(rows):
    """The contract's numbers of one conversation, row by row."""
    damaged = []
    for conv, turn, role, text in rows:
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        damaged += [(turn, "user" if h == 4 else role, text)] * {0: 0, 3: 2}.get(h, 1)
    damaged.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
    seen, symbols, counts = set(), "", dict.fromkeys(("blank", "duplicate", "truncated"), 0)
    for _, role, text in damaged:
        bare = text.rstrip(" \t\n\v\f\r")
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "fine"
        seen.add((role, text))
        if fault != "fine":
            counts[fault] += 1
        symbols += cr.SYMBOLS[fault][("uas".find(role[:1]) if role else -1) if role[:1] in tuple("uas") else 3]
    initials = [role[:1] for _, role, _ in damaged]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    turns = [t for t, _, _ in damaged if t is not None]
    cost, audit = cr.solve(symbols)
    out, at = [], 0
    for e in audit:
        role, text = ("", "") if e == "I" else damaged[at][1:]
        at += e != "I"
        if e != "D":
            out.append((role if e == "K" else None, text))
    first = 0 if not (out and (out[0][0] or "").startswith("s")) else 1
    lines = [f"{role if role is not None else ('user', 'assistant')[(i - first) % 2]}:{text}" for i, (role, text) in enumerate(out)]
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *counts.values(), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def test_query_equals_walk(spark, tmp_path):
    rng, rows = random.Random(5), []
    for conv in [*range(60), None]:
        for turn in range(rng.choice([1, 2, 4, 8, 60])):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rng.choice(["Yes.", "no", "", " \t\x0b", "Why?  ", None, "ünd 🙂!", f"text {turn}.", "a\nb"])
            rows.append((conv, rng.choice([turn, turn, turn, turn + 3, None]), role, text))
    rows += rows[:5]
    table = spark.createDataFrame([(*r, "x", 1, True) for r in rows], SCHEMA + ", digest string, copy int, dropped boolean").repartition(5)
    table.write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: tuple(r)[1:] for r in cr.op12_conversation_repair(spark, str(tmp_path)).collect()}
    grouped = {c: [r for r in rows if r[0] == c] for c in {r[0] for r in rows}}
    assert got == {c: walked(v) for c, v in grouped.items()}


def test_repaired_rows(spark):
    long = "word " * 200_000
    rows = [(1, 0, "system", "Be kind."), (1, 1, "assistant", "Hi."), (1, 1, "assistant", "Hi."), (1, 2, "tool", long + "."), (1, 3, "user", "So?"), (2, 5, "user", long)]
    audits, repaired = cr.repair(spark.createDataFrame(rows, SCHEMA))
    assert {r.conv_id: r.audit for r in audits.collect()} == {1: "KIKDRR", 2: "D"}
    got = sorted((r.conv_id, r.place, r.edit, r.role, r.text) for r in repaired.collect())
    assert got == [(1, 0, "K", "system", "Be kind."), (1, 1, "I", "user", ""), (1, 2, "K", "assistant", "Hi."), (1, 3, "R", "user", long + "."), (1, 4, "R", "assistant", "So?")]


def test_empty_and_all_dropped(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    assert cr.op12_conversation_repair(spark, str(tmp_path)).count() == 0
    audits, repaired = cr.repair(spark.createDataFrame([(1, 1, "user", "x")], SCHEMA), F.lit(True))
    assert [(r.conv_id, r.audit, r.cost, r.gaps) for r in audits.collect()] == [(1, "", 0, 0)] and repaired.count() == 0
