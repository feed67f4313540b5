import random

import corpus_pipeline
from test_near_dedup import brute

from tessellate.llm import toxicity


def test_run_equals_its_stages_by_brute_force(spark, tmp_path):
    rng = random.Random(6)
    vocabulary = [f"word{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(160):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(40, 200))]
        bad = i % 4 == 0
        for _ in range(6 * bad):
            words.insert(rng.randrange(len(words)), rng.choice(["grumbol", "zarktic"]))
        rows.append((i, " ".join(words), "en", "s", 0))
        labels.append((i, 1, int(bad)))
    rows += [(i + 1000, rows[i][1], "en", "s", 0) for i in range(0, 60)]
    rows += [(2000, None, None, None, None), (2001, "", "en", "s", 0), (2002, "again " * 100, "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    marks.write.parquet(f"{tmp_path}/labels.parquet")
    model = toxicity.fit(docs, marks)
    left = [(d, t) for d, t, *_ in rows if model.score([t or ""])[0] < 0.5]
    assert all(d % 4 or d >= 2000 for d, _ in left) and len(left) > 150
    left = [(d, t) for d, t in left if t and len(t.split()) >= 50 and len(set(t.split())) > 1]
    want = {c for c, _ in brute(left).values()}
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} == want
    assert max(r.offset + r.length for r in out) <= 2048
    stage_docs = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage_docs = stage(spark, stage_docs, str(tmp_path))
        assert stage_docs.columns == docs.columns, name
