import random

import public_tokenizers
from tokenizers import Tokenizer

from tessellate.llm import token_counts
from tessellate.llm.chunk_encoder import encoder

PATH = public_tokenizers.path(token_counts.TOKENIZER)


def whole(text):
    tok = Tokenizer.from_file(PATH)
    return len(tok.encode(text, add_special_tokens=False).ids)


def test_random_edits_equal_whole_encoding():
    rng, enc = random.Random(3), encoder(PATH, True)
    draw = lambda n: "".join(rng.choice("  abc de\n.'sX1é\t") for _ in range(n))
    for n in (0, 1, 300, 4000):
        tree = token_counts.DocumentTree.build(draw(n), enc)
        for _ in range(60):
            a = rng.randint(-2, len(tree.text) + 2)
            tree.encoded = 0
            before = len(tree.text)
            tree.edit(a, a + rng.choice([0, 1, 5, 400]), draw(rng.choice([0, 1, 2, 30, 900])))
            assert tree.total == whole(tree.text)
            assert tree.starts == sorted(set(tree.starts)) and sum(tree.sums[len(tree.sums) // 2 :]) == tree.total
            assert tree.encoded <= 3500 or before < 3500


def test_spark_query(spark):
    rows = [(1, "some words " * 200), (2, None), (2, None), (3, ""), (None, "x"), (4, "one  two\n\nthree")]
    docs = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, starts int")
    edits = spark.createDataFrame([(1, 2, 0, 4, "ANY"), (1, 1, 50, 60, None), (3, 1, 0, 0, "new text"), (4, 1, None, 3, "zz"), (2, 1, 5, 2, "in")], "doc_id long, seq int, start int, end int, text string")
    out = token_counts.apply_edits(token_counts.build_trees(token_counts.with_edits(docs, edits), PATH), PATH).collect()
    assert len(out) == len(rows) and all(r.n_after == whole(r.text) for r in out)
    first = next(r for r in out if r.doc_id == 1)
    source = rows[0][1][:50] + rows[0][1][60:]
    assert first.text == "ANY" + source[4:] and first.n_before == whole(rows[0][1]) and first.n_encoded < 1600
    assert sorted(r.text for r in out if r.doc_id == 2) == ["in", "in"]
    assert token_counts.apply_edits(token_counts.build_trees(token_counts.with_edits(docs.limit(0), edits), PATH), PATH).count() == 0
