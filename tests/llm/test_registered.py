"""The registered queries over a small table against the libraries, and columns, nulls and long texts that could trip them."""

import hashlib
import random
import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessellate.llm import byte_bpe, language_id, near_dedup, packing, quality_rules, token_counts, token_files, toxicity

TEXTS = ["", None, "Some words, and MORE\nlines.", "ß é 中文 🙂", "x " * 3000, "same", "same", "tab\tand  spaces ", "a <|endoftext|>b", "İ!- x", "it's the last one"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng, folder = random.Random(3), tmp_path_factory.mktemp("tables")
    texts = TEXTS + [" ".join(rng.choice("the pump tank motor, valve paint. steel".split()) for _ in range(rng.randint(1, 900))) for _ in range(40)]
    rows = [(3 * i, t, "en") for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3).write.parquet(f"{folder}/documents.parquet")
    return str(folder), rows


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_op1_equals_the_library(spark, tables):
    folder, rows = tables
    tok, want, at = Tokenizer.from_file(public_tokenizers.path(token_files.TOKENIZER)), [], 0
    for d, t, _ in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        want.append((d, at, len(ids), crc(ids)))
        at += len(ids)
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in token_files.op1_token_files(spark, folder).collect()) == want


def test_op3_equals_the_library(spark, tables):
    folder, rows = tables
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.load_ranks(public_tokenizers.path(byte_bpe.RANKS)), special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = [(d, len(ids := enc.encode_ordinary(t or "")), sha(np.array(ids, "<u4").tobytes()), sha((t or "").encode())) for d, t, _ in rows]
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in byte_bpe.op3_byte_bpe(spark, folder).collect()) == want


def test_op7_counts_equal_whole_encodings(spark, tables):
    folder, rows = tables
    tok = Tokenizer.from_file(public_tokenizers.path(token_counts.TOKENIZER))
    count = lambda t: len(tok.encode(t, add_special_tokens=False).ids)
    docs = spark.createDataFrame([(d, t or "") for d, t, _ in rows], "doc_id long, text string")
    drawn = {r.doc_id: r.p for r in docs.select("doc_id", F.array(*[F.pmod(F.xxhash64("doc_id", F.lit(k)), F.length("text") + 1).cast("int") for k in range(3)]).alias("p")).collect()}
    got = {r.doc_id: (r.n_before, r.n_after) for r in token_counts.op7_token_counts(spark, folder).collect()}
    for d, t, _ in rows:
        t, (a, b, c) = t or "", drawn[d]
        new = t[:a] + t[a + 40 :]
        b, up = min(b, len(new)), t[c : c + 30].upper()
        new = new[:b] + " [a passage was put in here] " + new[b:]
        c = min(c, len(new))
        new = new[:c] + up + new[min(c + 30, len(new)) :]
        assert got[d] == (count(t), count(new)), d


def test_op8_pieces_equal_the_library(spark, tables):
    folder, rows = tables
    tok, want = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER)), []
    for d, t, _ in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        at = 0
        first = len(ids) % 2048 or 2048
        for p, n in enumerate([first, *[2048] * ((len(ids) - first) // 2048)] if len(ids) > 2048 else [len(ids)]):
            want.append((d, p, at, n, crc(ids[at : at + n])))
            at += n
    out = packing.op8_best_fit_packing(spark, folder).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == sorted(want)
    held = {}
    for r in out:
        held.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(sorted(v)[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in zip(sorted(v), sorted(v)[1:])) and sum(n for _, n in v) <= 2048 for v in held.values())


def test_stages_keep_columns_of_any_name(spark, tmp_path):
    rng = random.Random(1)
    words = [f"word{i}" for i in range(200)]
    texts = [" ".join(rng.choice(words) for _ in range(80)) for _ in range(12)]
    rows = [(i, t, "en", 1.5, 7, "k", i, "x y", None) for i, t in enumerate(texts)] + [(50, texts[0], "en", None, None, None, None, None, None)] * 2
    schema = "doc_id long, text string, predicted string, score double, key int, mark string, _row long, `a b` string, held string"
    docs = spark.createDataFrame(rows, schema)
    spark.createDataFrame([(i, 0, i % 2) for i in range(3)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    model = toxicity.train([], np.zeros(0, int))
    assert toxicity.filter_documents(docs, model).columns == docs.columns
    assert corpus_pipeline.drop_toxic(spark, docs, str(tmp_path)).columns == docs.columns
    assert corpus_pipeline.drop_low_quality(spark, docs, str(tmp_path)).columns == docs.columns
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == list(range(12))
    # a row that repeats whole is kept once
    twice = near_dedup.dedup(docs.where("doc_id = 50").union(docs.where("doc_id = 3")))
    assert sorted(r.doc_id for r in twice.collect()) == [3, 50]
    pieces = spark.createDataFrame([(1, 5, 9, 9, 9), (2, 7, 9, 9, 9)], "doc_id long, length int, _row int, _part int, owner int")
    out = packing.pack(pieces)
    assert out.columns == [*pieces.columns, "sequence_id", "offset"] and out.count() == 2


def test_very_long_texts(spark):
    rng = random.Random(2)
    long = " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(150_000))
    docs = spark.createDataFrame([(1, long, "en"), (2, long + " and a few words more", "en"), (3, "short text", "de"), (4, "z" * 300_000, "de")], "doc_id long, text string, lang string")
    assert {r.doc_id: r.class_id for r in near_dedup.near_duplicates(docs).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
    assert {r.doc_id: r.n_words for r in quality_rules.ledger(docs).collect()} == {1: 150_000, 2: 150_005, 3: 2, 4: 1}
    seen = language_id.identify(docs.withColumn("held_out", F.lit(False)), language_id.fit(docs)).collect()
    assert len(seen) == 4 and all(r.lang_pred in ("en", "de") for r in seen)
