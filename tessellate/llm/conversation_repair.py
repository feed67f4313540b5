"""Conversation structure repair: each distinct role/fault signature is solved once, its audit is joined back and replayed.

A conversation becomes a string with one symbol a row (SYMBOLS: the role's initial and the row's first
fault). Each distinct string is solved once by memoised recursion over (row, state of the role pattern);
the cheapest edits, written as their initials, are the audit. The audits are joined back to the
conversations, and one sorted pass over the rows replays them into repaired rows.

Faults, the first that holds: blank (no character but spaces and \\t\\n\\v\\f\\r), duplicate (role and text
stood earlier in the conversation), truncated (the last character that isn't such white space is none of
`.!?`). Edits: Keep 0, Rerole to user or assistant 3, Delete 4 (the only one for blank and duplicate rows),
Insert an empty user or assistant row 3; a truncated row that stays adds 3. The repaired roles' initials
read `(s?(ua)+)?`. Of equally cheap audits the least in ASCII order is taken.

Defined results: a null role or text is one space (so a null text is blank and a null role no legal one);
rows are taken by turn, nulls first, then by role, then by the SHA-256 of the text, so repeated rows stand
side by side and each but the first is a duplicate; null conv_ids make one conversation; a conversation
without rows has an empty audit; an empty table gives none; further input columns are ignored. A
conversation's rows stream through one task: only its signature (a symbol a row) is ever held whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, read_table

SHARES = 32
INITIALS, FAULTS = "uasx", ("fine", "truncated", "blank", "duplicate")
#: a symbol for each fault and initial; x stands for all other initials
SYMBOLS = {"fine": "uasx", "truncated": "UASX", "blank": "1234", "duplicate": "5678"}
COST = {"K": 0, "R": 3, "D": 4, "I": 3}
UNFINISHED = 3
#: states of the pattern: nothing yet, after s, after a user row, after an assistant row
START, SYSTEM, USER, PAIR = range(4)
KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): PAIR, (PAIR, "u"): USER}
#: the only role that a rerole or an insertion can give in a state
GIVEN = {START: ("user", USER), SYSTEM: ("user", USER), USER: ("assistant", PAIR), PAIR: ("user", USER)}
SPAN = 128
KEY_SCHEMA = "conv_id long, place long, edit string, turn long, role string, text string"


def read_symbol(symbol: str) -> tuple[str, str]:
    for fault, symbols in SYMBOLS.items():
        if symbol in symbols:
            return INITIALS[symbols.index(symbol)], fault
    raise ValueError(f"no symbol of a signature: {symbol}")


def solve(signature: str) -> tuple[int, str]:
    """The least cost and the audit of a signature."""
    rows, n = [read_symbol(s) for s in signature], len(signature)

    @cache
    def step(i: int, state: int, inserted: int = 0) -> tuple[int, str, int, int, int]:
        """(cost from here on, edit, and where it leads); no edit at the end. More than two insertions in a row gain nothing."""
        found = [(0, "", i, state, 0)] if i == n and state in (START, PAIR) else []
        if inserted < 2:
            to = GIVEN[state][1]
            found.append((COST["I"] + step(i, to, inserted + 1)[0], "I", i, to, inserted + 1))
        if i < n:
            initial, fault = rows[i]
            found.append((COST["D"] + step(i + 1, state)[0], "D", i + 1, state, 0))
            if fault in ("fine", "truncated"):
                more = UNFINISHED if fault == "truncated" else 0
                to = GIVEN[state][1]
                found.append((COST["R"] + more + step(i + 1, to)[0], "R", i + 1, to, 0))
                if (state, initial) in KEPT:
                    to = KEPT[state, initial]
                    found.append((COST["K"] + more + step(i + 1, to)[0], "K", i + 1, to, 0))
        # edits that begin differently: the first letter settles a tie
        return min(found, default=(1 << 60, "", i, state, 0))

    # from the end in spans, so that the recursion is never deep
    for i in range(n, 0, -SPAN):
        for state in range(4):
            step(i, state)
    audit, at = [], (0, START, 0)
    while (found := step(*at))[1]:
        audit.append(found[1])
        at = found[2:]
    return step(0, START)[0], "".join(audit)


def fault_counts(signature: str) -> dict[str, int]:
    rows = [read_symbol(s) for s in signature]
    counts = {f: sum(fault == f for _, fault in rows) for f in FAULTS[1:]}
    return counts | {"illegal": sum(a + b not in ("su", "ua", "au") for (a, _), (b, _) in zip(rows, rows[1:]))}


def ordered(conversations: DataFrame, dropped: Column | None = None) -> DataFrame:
    """conv_id, turn, role, text without nulls in the latter two, dropped, and `digest` of the text, by which ties are ordered."""
    left_out = F.lit(False) if dropped is None else F.coalesce(dropped, F.lit(False))
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), left_out.alias("dropped"))
    return rows.withColumn("digest", F.unhex(F.sha2("text", 256)))


def symbol(role: Column, fault: Column) -> Column:
    place = F.coalesce(F.nullif(F.instr(F.lit("uas"), F.substring(role, 1, 1)), F.lit(0)), F.lit(4))
    place = F.when(F.length(role) == 0, 4).otherwise(place)
    out = F.lit(None)
    for name, symbols in SYMBOLS.items():
        out = F.when(fault == name, F.substring(F.lit(symbols), place, F.lit(1))).otherwise(out)
    return out


def signatures(rows: DataFrame) -> DataFrame:
    """conv_id, signature, gaps of rows of ordered(); rows whose `dropped` is true only name their conversation."""
    bare = F.regexp_replace("text", r"[ \t\n\x0B\f\r]+$", "")
    # the texts stay behind: an earlier row is known by the text's SHA-256
    light = rows.select(
        "conv_id", "turn", "role", "digest", "dropped",
        F.when(F.length(bare) == 0, "blank").when(~F.substring(bare, -1, 1).isin(".", "!", "?"), "truncated").otherwise("fine").alias("fault"),
    ).repartition("conv_id")
    same = Window.partitionBy("conv_id", "dropped", "role", "digest").orderBy(F.col("turn").asc_nulls_first())
    light = light.withColumn("nth", F.row_number().over(same))
    fault = F.when((F.col("fault") != "blank") & (F.col("nth") > 1), "duplicate").otherwise(F.col("fault"))
    mark = F.struct(F.col("turn").isNotNull(), F.coalesce("turn", F.lit(0)), "role", "digest", "nth", symbol(F.col("role"), fault).alias("symbol"))
    kept, turn = ~F.col("dropped"), F.when(~F.col("dropped"), F.col("turn"))
    grouped = light.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.when(kept, mark))).alias("marks"),
        (F.max(turn) - F.min(turn) + 1 - F.size(F.collect_set(turn))).alias("gaps"),
    )
    return grouped.select("conv_id", F.array_join(F.transform("marks", lambda m: m["symbol"]), "").alias("signature"), F.coalesce("gaps", F.lit(0)).cast("long").alias("gaps"))


def solved(signed: DataFrame) -> DataFrame:
    """Adds blank, duplicate, truncated, illegal, cost and audit; each distinct signature is solved once."""
    schema = "signature string, blank long, duplicate long, truncated long, illegal long, cost long, audit string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for s in b.column(0).to_pylist():
                cost, audit = solve(s)
                out.append({"signature": s, **fault_counts(s), "cost": cost, "audit": audit})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("signature", pa.string()), *[(n, pa.int64()) for n in ("blank", "duplicate", "truncated", "illegal", "cost")], ("audit", pa.string())]))

    once = signed.select("signature").distinct().mapInArrow(run, schema)
    # a common signature's conversations are dealt to shares, so that they don't meet in one task
    dealt = once.withColumn("share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
    met = signed.withColumn("share", F.pmod(F.xxhash64("conv_id"), F.lit(SHARES)).cast("int"))
    return met.join(dealt, ["signature", "share"]).drop("share")


def replay(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """The repaired rows: conv_id, place (from 0), edit (K, R or I), turn (null if inserted), role, text.

    Each conversation's rows stand together in their order within a partition, which later narrow steps may rely on."""
    lines = rows.where(~F.col("dropped")).select("conv_id", F.lit(1).alias("kind"), "turn", "role", "digest", "text", F.lit(None).cast("string").alias("audit"))
    heads = audits.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit(b"").alias("digest"), F.lit("").alias("text"), "audit")
    met = lines.unionByName(heads).repartition("conv_id").sortWithinPartitions("conv_id", "kind", F.col("turn").asc_nulls_first(), "role", "digest")
    types = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("edit", pa.string()), ("turn", pa.int64()), ("role", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv = audit = None
        at = place = 0
        state = START

        def emit(out: list, edit: str, turn: int | None, role: str, text: str) -> None:
            nonlocal place, state
            if edit == "K":
                state = KEPT[state, role[:1]]
            else:
                role, state = GIVEN[state]
            out.append((conv, place, edit, turn, role, text))
            place += 1

        def insertions(out: list) -> None:
            nonlocal at
            while audit[at : at + 1] == "I":
                emit(out, "I", None, "", "")
                at += 1

        for b in batches:
            out: list = []
            for c, kind, turn, role, text, a in zip(*(x.to_pylist() for x in b.columns)):
                if kind == 0:
                    conv, audit, at, place, state = c, a, 0, 0, START
                else:
                    edit = audit[at]
                    at += 1
                    if edit != "D":
                        emit(out, edit, turn, role, text)
                insertions(out)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*out), types)], schema=types)

    return met.select("conv_id", "kind", "turn", "role", "text", "audit").mapInArrow(run, KEY_SCHEMA)


def digests(repaired: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256 of `role:text` joined by newlines, over rows of replay(); none for conversations without rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, conv, sha = False, None, None
        for b in batches:
            out: list = []
            for c, place, role, text in zip(*(x.to_pylist() for x in b.columns)):
                if place == 0:
                    if open_:
                        out.append((conv, sha.hexdigest()))
                    open_, conv, sha = True, c, hashlib.sha256()
                else:
                    sha.update(b"\n")
                sha.update(f"{role}:{text}".encode())
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.string())], names=["conv_id", "repaired_sha256"])
        if open_:
            yield pa.RecordBatch.from_arrays([pa.array([conv], pa.int64()), pa.array([sha.hexdigest()], pa.string())], names=["conv_id", "repaired_sha256"])

    return repaired.select("conv_id", "place", "role", "text").mapInArrow(run, "conv_id long, repaired_sha256 string")


def repair(conversations: DataFrame, dropped: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(audits, repaired rows). audits: conv_id, signature, gaps, the faults' counts, cost, audit.

    Rows for which `dropped` holds are left out, but their conversations are reported. The audits are a table in the shared folder."""
    rows, scratch = ordered(conversations, dropped), Scratch(conversations.sparkSession, "conversation-repair")
    audits = scratch.write(solved(scratch.write(signatures(rows), "signed")), "audits")
    scratch.keep_only("audits")
    return audits, replay(rows, audits)


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows with the faults that the query plants by crc32 of `conv_id:turn`; `dropped` marks those that are to go."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = conversations.select("conv_id", "turn", "role", F.coalesce("text", F.lit(" ")).alias("text"), (F.crc32(key.cast("binary")) % 20).alias("fault"))
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("fault") == 0).alias("dropped"), F.explode(times).alias("copy"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = damaged(read_table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))
    audits, repaired = repair(rows, F.col("dropped"))
    sha = digests(repaired).withColumnRenamed("conv_id", "of")
    out = audits.join(sha, F.col("conv_id").eqNullSafe(F.col("of")), "left")
    return out.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def _option(add: str, edit: str, rest: str) -> str:
    """An edit before a value of the oracle: nine digits of cost, then the audit."""
    return f"printf('%09d', substr({rest}, 1, 9)::INT + {add}) || '{edit}' || substr({rest}, 10)"


def _oracle() -> str:
    more, may = "(CASE WHEN f = 't' THEN 3 ELSE 0 END)", "f IN ('f', 't')"
    edits = {
        "s": [("K", "x", "r = 's'"), ("K", "m", "r = 'u'"), ("R", "m", "true")],
        "x": [("K", "m", "r = 'u'"), ("R", "m", "true")],
        "m": [("K", "e", "r = 'a'"), ("R", "e", "true")],
        "e": [("K", "m", "r = 'u'"), ("R", "m", "true")],
    }
    base = ", ".join(
        "least(" + ", ".join([_option("4", "D", f"v{s}"), *[f"CASE WHEN {may} AND {when} THEN {_option(f'{COST[e]} + {more}', e, f'v{to}')} END" for e, to, when in options]]) + f") AS b{s}"
        for s, options in edits.items()
    )
    insert = lambda rest: _option("3", "I", rest)
    return f"""
WITH RECURSIVE crc AS (SELECT list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS t
  FROM (SELECT range AS n FROM range(256))),
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
d AS (SELECT conv_id, turn, role, text, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(key, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS d FROM k, crc),
a AS (SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
  unnest(CASE WHEN d = 3 THEN [0, 1] ELSE [0] END) AS copy FROM d WHERE d <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS nth,
  regexp_replace(text, '[ \t\n\x0B\f\r]+$', '') AS bare FROM a),
f AS (SELECT conv_id, turn, role, text, i, CASE WHEN left(role, 1) IN ('u', 'a', 's') THEN left(role, 1) ELSE 'x' END AS r,
  CASE WHEN bare = '' THEN 'b' WHEN nth > 1 THEN 'd' WHEN right(bare, 1) IN ('.', '!', '?') THEN 'f' ELSE 't' END AS f FROM o),
w AS (SELECT *, lag(r) OVER (PARTITION BY conv_id ORDER BY i) || r AS pair FROM f),
c AS (SELECT conv_id, count(*) AS n, string_agg(r, '' ORDER BY i) AS rs, string_agg(f, '' ORDER BY i) AS fs, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
  count(*) FILTER (f = 'b') AS blank, count(*) FILTER (f = 'd') AS duplicate, count(*) FILTER (f = 't') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal FROM w GROUP BY conv_id),
v AS (
  SELECT rs, fs, length(rs) AS i, '000000000' AS vs, '000000006II' AS vx, '000000003I' AS vm, '000000000' AS ve FROM (SELECT DISTINCT rs, fs FROM c)
  UNION ALL
  SELECT rs, fs, i, least(bs, {insert("vm")}), least(bx, {insert("vm")}), vm, least(be, {insert("bm")}) FROM (
    SELECT *, least(bm, {insert("be")}) AS vm FROM (SELECT rs, fs, i - 1 AS i, {base} FROM (SELECT *, substr(rs, i, 1) AS r, substr(fs, i, 1) AS f FROM v WHERE i > 0)))),
s AS (SELECT c.conv_id, substr(vs, 1, 9)::BIGINT AS cost, substr(vs, 10) AS audit FROM c JOIN v ON c.rs = v.rs AND c.fs = v.fs AND v.i = 0),
e AS (SELECT conv_id, p, e, row_number() OVER (PARTITION BY conv_id ORDER BY p) - 1 AS p0, CASE WHEN e = 'I' THEN NULL ELSE sum(CASE WHEN e = 'I' THEN 0 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY p) END AS i
  FROM (SELECT conv_id, unnest(range(1, length(audit) + 1)) AS p, substr(audit, p, 1) AS e FROM s)),
q AS (SELECT e.conv_id, p, e, f.role, f.text, first_value(f.r) OVER (PARTITION BY e.conv_id ORDER BY p) = 's' AND first_value(e) OVER (PARTITION BY e.conv_id ORDER BY p) = 'K' AS sys,
  row_number() OVER (PARTITION BY e.conv_id ORDER BY p) AS m FROM e LEFT JOIN f ON e.conv_id IS NOT DISTINCT FROM f.conv_id AND e.i = f.i WHERE e <> 'D'),
h AS (SELECT conv_id, sha256(string_agg(CASE WHEN e = 'K' THEN role WHEN (m + sys::INT) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY p)) AS sha FROM q GROUP BY conv_id)
SELECT x.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit,
  coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) x LEFT JOIN c ON x.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN s ON x.conv_id IS NOT DISTINCT FROM s.conv_id LEFT JOIN h ON x.conv_id IS NOT DISTINCT FROM h.conv_id"""


QUERIES = {"op12_conversation_repair": op12_conversation_repair}
SQL = {"op12_conversation_repair": _oracle()}
