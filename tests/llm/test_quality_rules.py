import random
import re

from tessellate.llm import quality_rules as Q


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def corpus():
    rng = random.Random(1)
    texts = ["", None, " \t\n", "one", "a b", "a b c", "a b c a b c a", "x " * 400, "a b c\x1cd", "# * $ % & | < >", "ä 🙂 ß\n\nä 🙂 ß\n \nä 🙂 ß", "line\r\nline\nline"]
    texts += [" ".join(rng.choice("abcde") for _ in range(rng.randint(1, 90))) for _ in range(60)]
    texts += ["\n".join(" ".join(rng.choice(["word", "is", "&&", "long-enough"]) + str(rng.randint(0, 40)) for _ in range(8)) for _ in range(9)) for _ in range(20)]
    return list(enumerate(texts)) + [(0, "again"), (None, "no id")]


def test_measurements_against_brute_force(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, "extra") for r in rows], "doc_id long, text string, n_words string")
    got = Q.ledger(docs).collect()
    key = lambda r: tuple(map(str, r))
    want = sorted(((d, *brute(t)) for d, t in rows), key=key)
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got), key=key) == want
    for r in got:
        assert bool(r.failed_bits & Q.mask(Q.BASE_RULES)) == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
    assert Q.ledger(docs.limit(0)).count() == 0


def test_policies_and_ablations(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string")
    book = Q.ledger(docs)
    bits = [r.failed_bits for r in book.collect()]
    for name, rules in Q.POLICIES.items():
        got = {r.rule: (r.n_failed, r.n_only_this) for r in Q.ablations(book, name).collect()}
        for rule in rules:
            bit = Q.mask((rule,))
            want = (sum(bool(b & bit) for b in bits), sum(b & Q.mask(rules) == bit for b in bits))
            assert got.get(rule, (0, 0)) == want
    kept = Q.filter_documents(docs, "v3")
    assert kept.count() == bits.count(0) and kept.columns == docs.columns
