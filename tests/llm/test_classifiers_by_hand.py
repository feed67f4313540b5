"""The two classifiers' scores gram by gram in plain Python, and models that don't depend on the rows' order."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from tessellate.llm import grams, language_id, toxicity

MASK = 0xFFFFFFFF


def mapped(text, kept=""):
    keep = set(b"abcdefghijklmnopqrstuvwxyz") | set(kept.encode())
    return b" " * grams.PAD + bytes(b if b in keep or b > 127 else 32 for b in text.lower().encode()) + b" " * grams.PAD


def bucket(data, i, n, bits):
    h = (n * 0x9E3779B1) & MASK
    for k in range(n):
        h = (h + data[i + k] * int(grams.MULTIPLIERS[k])) & MASK
        h ^= h >> 13
    return ((h * 0x85EBCA6B) & MASK) >> (32 - bits)


def texts(seed, n):
    rng = random.Random(seed)
    words = ["the", "und", "größe", "qué", "idiot1", "a", "O'Neil", "pump", "zarktic", "l'eau", "中文", "x" * 30]
    out = [" ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 5, 60, 400]))) for _ in range(n)]
    return [*out, "", "...", "é", "z" * 900]


def toxic_score(model, text):
    data, found, last = mapped(text, "0123456789@$*"), [], {}
    bags = []
    for i in range(len(data) - grams.PAD):
        for n in toxicity.SIZES:
            if i + max(toxicity.SIZES) <= len(data) and all(data[i + k] != 32 for k in range(1, n - 1)):
                bags.append(bucket(data, i, n, toxicity.BITS))
    for i, g in enumerate(bags):
        if g not in last or i - last[g] >= toxicity.SPAN:
            found.append(g)
        last[g] = i
    half, windows = toxicity.WINDOW // 2, []
    steps = max(1, math.ceil(max(len(found) - half, 1) / half))
    for s in range(steps):
        end = len(found) if s == steps - 1 else s * half + toxicity.WINDOW
        begin = max(min(s * half, end - toxicity.WINDOW), 0)
        windows.append(sum(float(model.value[g]) for g in found[begin:end]) / toxicity.WINDOW)
    return 1 / (1 + math.exp(-(model.bias + max(windows))))


def test_toxicity_scores_gram_by_gram():
    rng = np.random.default_rng(3)
    model = toxicity.Model(rng.normal(size=1 << toxicity.BITS).astype(np.float32) * 5, -0.3)
    some = texts(1, 40)
    assert np.allclose(model.score(some), [toxic_score(model, t) for t in some], atol=1e-6)


def language_features(text):
    data, counts = mapped(text), {}
    for n in (2, 3):
        for i in range(len(data) - grams.PAD):
            if i + n <= len(data) and any(data[i + k] != 32 for k in range(n)):
                h = bucket(data, i, n, language_id.BITS)
                counts[h] = counts.get(h, 0) + 1
    norm = max(math.sqrt(sum(counts.values())), 1e-9)
    return {h: math.sqrt(c) / norm for h, c in counts.items()}


def language(model, text):
    x = language_features(text)
    margin = lambda w: sum(v * float(w[h]) for h, v in x.items()) + float(w[-1])
    squash = lambda m: 1 / (1 + math.exp(-2 * m))
    margins = {f: margin(w) for f, w in zip(model.families, model.family)}
    family = max(model.families, key=lambda f: margins[f])
    members, score = model.members[family], squash(margins[family])
    votes, sums = dict.fromkeys(members, 0), dict.fromkeys(members, 0.0)
    for (a, b), w in model.pairs.items():
        if a in votes:
            m = margin(w)
            votes[a if m > 0 else b] += 1
            sums[a] += m
            sums[b] -= m
    best = max(members, key=lambda c: votes[c] * 1000 + math.tanh(sums[c]))
    return best, score * squash(sums[best] / (len(members) - 1)) if len(members) > 1 else score


def test_languages_dot_product_by_dot_product():
    rng = np.random.default_rng(5)
    langs = ["en", "de", "nl", "fr", "es", "xx"]
    model = language_id.Model(np.abs(rng.normal(size=(60, 1 << language_id.BITS))).astype(np.float32), [langs[i % 6] for i in range(60)])
    some = [t for t in texts(2, 40) if any(map(str.isalpha, t))]
    got = list(zip(*model.predict(language_id.features(some))))
    want = [language(model, t) for t in some]
    assert [g[0] for g in got] == [w[0] for w in want]
    assert np.allclose([g[1] for g in got], [w[1] for w in want], atol=1e-4)


def test_models_do_not_depend_on_partitions_or_repeats(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice("ein zwei one two uno dos der the el".split()) for _ in range(30)), rng.choice(["en", "de", "es"])) for i in range(120)]
    rows += [(i, f"another text {k}", rows[i][2]) for i in range(20) for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("toxic")).distinct()
    a, b = (toxicity.fit(docs.orderBy(F.rand(s)).repartition(n), labels.repartition(n)) for s, n in ((1, 2), (2, 7)))
    assert np.array_equal(a.value, b.value) and a.bias == b.bias
    a, b = (language_id.fit(docs.orderBy(F.rand(s)).repartition(n)) for s, n in ((1, 2), (2, 7)))
    assert np.array_equal(a.family, b.family) and all(np.array_equal(a.pairs[k], b.pairs[k]) for k in a.pairs)
