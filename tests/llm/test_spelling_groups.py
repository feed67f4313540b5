"""Near words against all pairs by brute force, over one and many ranges; the query over odd texts."""

import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from tessellate.llm import spelling_groups as sg


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(words):
    out = {}
    for w, n in words.items():
        near = [x for x in words if one_edit(w, x)]
        best = min(near, key=lambda x: (-words[x], x), default=None)
        out[w] = (n, len(near), best, words.get(best))
    return out


def brute_forms(words):
    near = brute(words)
    form = {w: b if b is not None and m >= 5 * n else None for w, (n, _, b, m) in near.items()}
    out = {}
    for w, (n, k, _, m) in near.items():
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n, k, m if form[w] else None)
    return out


def random_words(rng, letters, longest, count):
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(1, longest))) for _ in range(count)}
    return {w: rng.choice([5, 5, 6, 30, 200]) for w in words}


def test_trie_of_one_range_equals_brute_force():
    rng = random.Random(4)
    for letters, longest in (("ab", 7), ("abcd", 5), ("aé", 9)):
        words = random_words(rng, letters, longest, 300)
        held = sorted(words)
        found = sg.merge_trie(held, [words[w] for w in held])
        got = {w: (words[w], found.near[i], held[b] if (b := found.best[i]) >= 0 else None, words[held[b]] if b >= 0 else None) for i, w in enumerate(held)}
        assert got == brute(words)


def test_ranges_equal_brute_force(spark):
    rng = random.Random(8)
    words = random_words(rng, "abc", 8, 350) | {"z" * 3000: 9, "z" * 3001: 50, "z" * 3002: 7, "z" * 2999 + "y": 5, "x": 5}
    table = spark.createDataFrame(list(words.items()), "word string, n long")
    want = brute(words)
    for ranges in (1, 40):
        got = {r.word: (r.n, r.n_near, r.form, r.form_n) for r in sg.near_words(table, ranges).collect()}
        assert got == want, ranges


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(6)
    stems = ["paintbrush", "Motorway", "Zürichsee", "ÀÉÎÕÜß", "straße", "x" * 400, "aaaaaa", "short"]
    texts = [None, "", "×÷×÷×÷", "1234 5678"]
    for _ in range(120):
        line = []
        for _ in range(60):
            w = rng.choice(stems[:3] * 6 + stems)
            if rng.random() < 0.25:
                i = rng.randrange(len(w))
                w = w[:i] + rng.choice(["", "q", w[i] * 2]) + w[i + 1 :]
            line.append(w)
        texts.append(rng.choice([" ", "-", "3"]).join(line))
    texts += texts[:6]
    rows = [(i if i % 17 else None, t) for i, t in enumerate(texts)] + [(9, texts[9])]
    spark.createDataFrame([(*r, "clash", 3, 1) for r in rows], "doc_id long, text string, word string, n int, range int").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    counts = Counter()
    for d, t in rows:
        for run in re.findall(r"[A-Za-z\u00C0-\u00FF]+", t or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{w}".encode())
            counts[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 199 == 0 else w] += 1
    want = brute_forms({w: n for w, n in counts.items() if len(w) >= 6 and n >= 5})
    got = {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in sg.op13_spelling_groups(spark, str(tmp_path)).collect()}
    assert got == want and any(v[0] for v in want.values())


def test_chains_and_empty_tables(spark):
    words = {"aaaaaa": 5, "aaaaab": 25, "aaaabb": 125, "aaabbb": 625, "aabbbb": 3125, "abbbbb": 15625, "abbbbc": 15624}
    near = sg.near_words(spark.createDataFrame(list(words.items()), "word string, n long"), 3)
    got = {r.word: r.root for r in sg.with_forms(near).collect()}
    assert got == {w: "abbbbb" for w in words} | {"abbbbc": "abbbbc"}
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert sg.with_forms(sg.near_words(sg.count_words(empty))).count() == 0
    assert sg.count_words(empty.union(spark.range(3).select("id", F.lit("Wörter " * 9)))).collect()[0].n == 27
