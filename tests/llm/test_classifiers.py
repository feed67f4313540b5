import random

import numpy as np
from pyspark.sql import functions as F

from tessellate.llm import language_id, toxicity

WORDS = {
    "en": "the of and to in that is was for it with as his on be at by this had not are but from or have an they which".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass".split(),
    "fr": "le la les de des et en un une du que est pour qui dans par sur au plus pas se ne ce il sont avec nous vous".split(),
    "es": "el la los las de que y en un una del por con no para es al lo como más pero sus le ya o este sí porque".split(),
}


def corpus(n, seed):
    rng = random.Random(seed)
    return [(i, " ".join(rng.choice(WORDS[lang]) for _ in range(rng.randint(20, 80))), lang) for i in range(n) for lang in [rng.choice(list(WORDS))]]


def test_language_of_held_out_texts(spark, tmp_path):
    rows = corpus(400, 3)
    docs = spark.createDataFrame([(*r, "s") for r in rows] + [(1000, None, "en", "s"), (1001, "123 !!", "en", "s"), (1002, "", None, "s"), (None, rows[0][1], "fr", "s"), (1003, rows[1][1], None, "s")], "doc_id long, text string, lang string, held_out_x string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    out = language_id.op10_language_id(spark, str(tmp_path)).collect()
    assert len(out) == 405
    got = {r.doc_id: r for r in out}
    assert np.mean([got[i].lang_pred == lang for i, _, lang in rows if got[i].held_out]) > 0.97
    assert [got[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and got[1000].score == 0
    assert got[None].lang_pred == rows[0][2] and not got[None].held_out
    assert all(0 <= r.score <= 1 for r in out)
    none = docs.withColumn("lang", F.lit(None).cast("string")).withColumn("held_out", F.lit(False))
    assert {r.lang_pred for r in language_id.identify(none, language_id.fit(none)).collect()} == {"und"}
    assert language_id.identify(none.limit(0), None).count() == 0


def test_toxicity_of_held_out_texts(spark, tmp_path):
    rng = random.Random(4)
    rows = []
    for i, text, _ in corpus(700, 5):
        words, toxic = text.split(), int(rng.random() < 0.4)
        for _ in range(3 * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(["grumbol", "zarktic", "flimwick"]))
        rows.append((i, " ".join(words), toxic))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(900, None), (901, ""), (902, "..."), (None, "grumbol"), (903, "so a zarktik and grumbbol of zarktik grumbool"), (904, rows[0][1]), (904, rows[0][1])], "doc_id long, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(None, 0, 1), (900, 1, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = toxicity.op6_toxicity(spark, str(tmp_path)).collect()
    assert len(out) == 707 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    got = {r.doc_id: r for r in out}
    assert np.mean([got[i].predicted == y for i, _, y in rows if got[i].held_out]) > 0.95
    assert got[903].predicted == 1, "misspellings share n-grams"
    model = toxicity.fit(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    rng = random.Random(1)
    made = lambda: "".join(rng.choice("abcdefghiklmnoprstuvw") for _ in range(rng.randint(2, 7)))
    long = " ".join(made() if k % 9 == 0 else rng.choice(WORDS["en"]) for k in range(700_000))
    assert model.score([long])[0] < model.score([long + " zarktic flimwick grumbol " + " ".join(WORDS["en"][:20])])[0]
    assert model.score([long + " zarktic grumbol flimwick of the grumbol zarktic"])[0] > 0.5
    assert got[900].score == got[901].score == got[902].score


def test_toxicity_without_labels():
    for labels in ([], [0, 0], [1]):
        model = toxicity.train([np.array([1, 2, 3])] * len(labels), np.array(labels, int))
        assert all(0 <= s <= 1 for s in model.score(["", "words here"]))
