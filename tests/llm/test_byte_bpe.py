import random

import numpy as np
import public_tokenizers
import tiktoken
from pyspark.sql import functions as F

from tessellate.llm import byte_bpe

PATH = public_tokenizers.path(byte_bpe.RANKS)


def library():
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(PATH), special_tokens={})


def test_equals_the_library_and_decodes(spark, monkeypatch):
    rng = random.Random(8)
    texts = ["", None, " ", "a", "  two  spaces ", "it's we'll 'tis I'd", "line\n\n next \n\tx", "a\n \nb\n", "naïve ß 中文 🙂 é", "x" * 700, "theraning" * 600, "ab " * 900, "  a ", "a\x1c b", "word. word, it!s (x) a.b c..\n.d e?f! ..."]
    texts += ["".join(rng.choice("  \n\tabcdeTHE'ls1é.&中 ") for _ in range(60)) for _ in range(400)]
    rows = [(i, t, 0) for i, t in enumerate(texts)] + [(None, "no id", 0), (3, "a", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids int").repartition(2)
    enc = library()
    want = sorted(((d if d is not None else -1, enc.encode_ordinary(t or ""), (t or "").encode()) for d, t, _ in rows), key=repr)
    for limit, shared in ((byte_bpe.LIST_LIMIT, byte_bpe.SHARED_WORDS), (60, 40), (60, 0)):
        monkeypatch.setattr(byte_bpe, "LIST_LIMIT", limit)
        out = byte_bpe.encode(docs, PATH, public_tokenizers.PATTERN, shared).collect()
        assert sorted(((r.doc_id if r.doc_id is not None else -1, np.frombuffer(r.ids, "<u4").tolist(), bytes(r.decoded)) for r in out), key=repr) == want
    assert byte_bpe.encode(docs.limit(0), PATH, public_tokenizers.PATTERN).count() == 0


def test_shared_words_are_the_widespread_ones(spark):
    docs = spark.createDataFrame([(i, f"a common word and w{i}") for i in range(40)], "doc_id long, text string").repartition(4)
    tables = byte_bpe.Tables(PATH)
    shared = byte_bpe.shared_words(docs, tables, public_tokenizers.PATTERN)
    assert len(shared) >= 4 and min(shared.find([" common", " word", " and"])) >= 0 and shared.find([" w7"]) == [-1]
    at = shared.find([" common"])[0]
    assert np.frombuffer(shared.cell(1, at), "<u4").tolist() == library().encode_ordinary(" common") and shared.cell(2, at) == b" common"
    assert len(byte_bpe.shared_words(docs, tables, public_tokenizers.PATTERN, 0)) == 0


def test_heap_merges_of_long_words():
    enc, rng = library(), random.Random(2)
    for _ in range(30):
        word = "".join(rng.choice("theraning") for _ in range(rng.randint(2, 900)))
        assert byte_bpe.merge_long(word.encode(), PATH) == enc._encode_single_piece(word)


def test_folds_search_and_copy_little(spark):
    """array_position ends its search by an exception, and a pair of arrays a merge was copied twice."""
    words = [b"", b"a", b"ab", " größer".encode(), b"aaaa", b"theraning" * 9, bytes(range(255, 0, -1)), b"ab" * 2048]
    tables, enc = byte_bpe.Tables(PATH), library()
    docs = spark.createDataFrame([(i, list(w)) for i, w in enumerate(words)], "i int, w array<smallint>")
    folded = docs.select("i", tables.bound(lambda t: byte_bpe.fold_merges(F.col("w"), t)).alias("ids"))
    assert [r.ids for r in folded.orderBy("i").collect()] == [enc._encode_single_piece(w) if w else [] for w in words]
    assert "array_position" not in str(byte_bpe.fold_merges(F.col("w"), tables))


def test_the_query_counts_no_words_beforehand(spark, tmp_path):
    spark.createDataFrame([(i, f"a common word and w{i}") for i in range(40)], "doc_id long, text string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    plan = byte_bpe.op3_byte_bpe(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("MapInArrow") == 2
    before = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    byte_bpe.op3_byte_bpe(spark, str(tmp_path))
    started = set(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - set(before)
    assert len(started) <= 1  # the schema of the files, and no count
