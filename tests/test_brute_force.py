"""Queries and operators that SQL doesn't say, against plain Python over small rows."""

import random
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tessellate.operators import alignment as A
from tessellate.plans import registry
from tessellate.plans.questions import split_items
from tessellate.plans.retrieval import near_keys
from tessellate.plans.sinks import stripped_pages, xml_decoded


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_near_keys_lose_no_pair(spark):
    rng = random.Random(3)
    keys = {"".join(rng.choice("abc") for _ in range(rng.randint(1, 14))) for _ in range(120)}
    for k in list(keys)[:60]:
        s = list(k)
        for _ in range(rng.randint(1, 3)):
            at = rng.randrange(len(s) + 1)
            s[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "d"])
        keys.add("".join(s))
    keys = sorted(keys - {""})
    want = {(a, b): edits(a, b) for a in keys for b in keys if a < b and edits(a, b) <= max(len(a), len(b)) // 5}
    got = near_keys(spark.createDataFrame([(k,) for k in keys], "key string"), "key").collect()
    assert {(r.a, r.b): r.distance for r in got} == want and len(want) > 30


def test_repeated_heads_and_feet_go(spark):
    rng = random.Random(5)
    words = lambda n: " ".join(rng.choice("pump tank motor valve paint steel".split()) + str(rng.randint(0, 9)) for _ in range(n))
    pages = []
    for doc in (1, 2):
        for page in range(6):
            head = f"Report {page} of 6" if rng.random() < 0.5 else f"Report {page} 0f 6"
            pages.append((doc, page, "\n".join([head, *[words(9) for _ in range(12)], "company secret" if page else words(5)])))
    pages += [(3, 0, "Report 1 of 6\nonly page"), (4, 0, None), (4, 1, ""), (4, 2, "x")]
    norm = lambda t: re.sub(r"\s+", " ", re.sub(r"\d+", "#", t.lower())).strip()
    want = {}
    for doc in (1, 2, 3, 4):
        own = {p: (t or "").split("\n") for d, p, t in pages if d == doc}
        edge = {p: [i < 3 or i >= len(ls) - 8 for i in range(len(ls))] for p, ls in own.items()}
        keys = {p: {norm(t) for t, e in zip(ls, edge[p]) if e and norm(t)} for p, ls in own.items()}
        near = lambda a, b: a == b or max(len(a), len(b)) <= 60 and edits(a, b) <= max(len(a), len(b)) // 5
        every = set().union(*keys.values())
        gone = {k for k in every if 2 * sum(any(near(k, o) for o in keys[p]) for p in own) > len(own) >= 3}
        for p, ls in own.items():
            want[doc, p] = "\n".join(t for t, e in zip(ls, edge[p]) if not (e and norm(t) in gone))
    got = {(r.doc, r.page): r.text for r in stripped_pages(spark.createDataFrame(pages, "doc long, page int, text string")).collect()}
    assert got == want and not any("Report" in t for (d, _), t in got.items() if d < 3)


def test_items_of_a_document(spark):
    texts = ["cover", "1. first", "goes on", "2. second", "4. no item", "๓. third", "1. annex one", "1. again the same", "2) two", None]
    lines = spark.createDataFrame([(7, i, t) for i, t in enumerate(texts)], "doc_id long, position long, text string")
    got = sorted((r.part, r.number, r.first, r.text) for r in split_items(lines).collect())
    assert got == [(1, 1, 1, "first goes on"), (1, 2, 3, "second 4. no item"), (1, 3, 5, "third"), (2, 1, 6, "annex one 1. again the same"), (2, 2, 8, "two ")]


def test_split_turns_cover_whole_texts(spark, tmp_path):
    rows = [(1, 0, "user", "w" * 50 + " end"), (1, 1, "assistant", "reply " * 9), (1, 2, "user", "third"), (2, 0, "assistant", "no item yet")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = registry.QUERIES["k7_items"](spark, str(tmp_path)).collect()
    assert [(r.number, r.text) for r in sorted(got, key=lambda r: r.number)] == [(1, "w" * 50 + " end " + ("reply " * 9).strip()), (2, "third")]


def test_doubled_words_style_and_labels(spark, tmp_path):
    texts = ["the the cat", "the then", "is is no", "งาน ระบบ ab", "see 5.3.1 and 7.2, not 8 or x1.2.3", "v 1.2.3.", None]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.doubled, r.style, r.n_labels) for r in registry.QUERIES["t20_doubled_words"](spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts[:-1]):
        thai, latin = len(re.sub("[^฀-๿]", "", t)), len(re.sub("[^A-Za-z]", "", t))
        assert got[i] == (bool(re.search(r"(?<![a-z])([a-z]{3,}) \1(?![a-z])", t)), "thai" if thai >= latin else "english", len(re.findall(r"(?<![0-9.])(\d+(?:\.\d+)+)(?![0-9])", t)))


def test_pick_lists_in_thai_order(spark, tmp_path):
    rows = [(i, 1, datetime(2024, 1, 1, 0, i % 13), "click") for i in range(40)]
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp, event_type string").write.parquet(f"{tmp_path}/events.parquet")
    got = sorted(registry.QUERIES["o13_pick_lists"](spark, str(tmp_path)).collect(), key=lambda r: r.place)
    assert [r.name for r in got if r.name > "z"] == ["กบ", "กา", "เกม", "แกง", "ไก่", "ขาว", "ข้าว", "เขา"]
    last = {n: max((r for r in rows if r[0] % 10 == n), key=lambda r: (r[2], r[0]))[0] for n in range(10)}
    assert sorted(r.event_id for r in got) == sorted(last.values())


@pytest.mark.parametrize("text", ["&lt;a&gt; &amp;lt; &#65;&#x1F600; &AMP; &nope; a;b &", "", "&amp;amp;", ";;&quot;x&apos;", "&#3585;&#xe01;"])
def test_xml_entities_decode_once(spark, text):
    import html

    want = re.sub(r"(?i)&(lt|gt|amp|quot|apos|#\d+|#x[0-9a-f]+);", lambda m: html.unescape(m[0].lower()), text)
    assert spark.range(1).select(xml_decoded(F.lit(text)).alias("t")).head().t == want


def test_glyphs_are_repaired_as_in_python(spark):
    texts = ["ก", "éx", "", None, "plain"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", A.repair_glyphs(F.col("t")).alias("r")).orderBy("i").collect()
    assert [r.r for r in got] == [None if t is None else A.repaired(t) for t in texts]
