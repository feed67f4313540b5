import random

import numpy as np

from tessellate.llm import near_dedup


def brute(rows):
    """Classes by all pairs' shingle sets."""
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and len(a & sets[j]) >= 0.8 * len(a | sets[j]):
                parent[root(i)] = root(j)
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(root(i), []).append(i)
    out = {}
    for g in groups.values():
        least = min(rows[i][0] for i in g)
        out |= {rows[i][0]: (least, len(g)) for i in g}
    return out


def corpus():
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(400)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    rows = [" ".join(text(rng.randint(6, 90))) for _ in range(60)]
    passage = text(30)
    rows += [" ".join(text(25) + passage + text(25)) for _ in range(40)]
    for _ in range(6):  # a hub with copies that were changed in 0 to 6 words
        hub = text(rng.randint(60, 160))
        for _ in range(25):
            copy = list(hub)
            for _ in range(rng.randint(0, 6)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append(" ".join(copy))
    rows += ["", "  ", None, "one", "ONE", "one two three", "same line\n" * 30, "same line\n" * 40]
    rng.shuffle(rows)
    return [(i + 10, t) for i, t in enumerate(rows)]


def test_against_all_pairs(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, key int").repartition(3)
    want = brute(rows)
    for tile in (near_dedup.TILE, 7):
        got = {r.doc_id: (r.class_id, r.class_size) for r in near_dedup.near_duplicates(docs, tile).collect()}
        assert got == want
    kept = sorted(r.doc_id for r in near_dedup.dedup(docs).collect())
    assert kept == sorted({c for c, _ in want.values()})
    assert near_dedup.dedup(docs).columns == docs.columns


def test_registers_estimate_probability_jaccard():
    rng = np.random.default_rng(0)
    common, a, b = (rng.integers(0, 2**63, n, dtype=np.uint64) for n in (600, 100, 100))
    bag = lambda *x: (np.concatenate(x), np.ones(sum(map(len, x))))
    sig = near_dedup.signatures([bag(common, a), bag(common, b), bag(a), (a[:1], np.ones(1))])
    assert abs((sig[0] == sig[1]).mean() - 0.75) < 0.12 and (sig[0] == sig[2]).mean() < 0.3
    assert len(set(sig[3].tolist())) == 1


def test_empty_and_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a b c d e f")] * 3 + [(2, "A b  c d e f"), (3, None), (3, None)], "doc_id long, text string")
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0
    assert sorted((r.doc_id, r.class_id, r.class_size) for r in near_dedup.near_duplicates(docs).collect()) == [(1, 1, 4)] * 3 + [(2, 1, 4)] + [(3, 3, 1)] * 2
    assert sorted(r.doc_id for r in near_dedup.dedup(docs).collect()) == [1, 3, 3]


def test_copies_that_repeat_a_passage(spark):
    """A pair's distinct shingles decide, however often one of the two repeats some of them."""
    rng = random.Random(12)
    rows = []
    for k in range(30):
        words = [f"p{k}w{i}" for i in range(200)]
        passage = words[40:100]
        # even k: the same shingles besides the seams; odd k: some words changed too
        changed = list(words)
        for i in rng.sample(range(110, 195), 2 * (k % 2)):
            changed[i] += "x"
        rows += [" ".join(words), " ".join(changed[:100] + passage * 19 + changed[100:])]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    want = brute(list(enumerate(rows)))
    assert all(size == 2 for _, size in want.values())
    assert {r.doc_id: (r.class_id, r.class_size) for r in near_dedup.near_duplicates(docs).collect()} == want
