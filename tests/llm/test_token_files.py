import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessellate.llm import range_codec, token_files


def test_coder_round_trip_and_checksums():
    rng = np.random.default_rng(3)
    for ids in ([], [7], rng.integers(0, 49408, 700), np.zeros(9000, int), np.tile(rng.integers(0, 300, 50), 200), rng.zipf(1.4, 30000) % 40000):
        ids = np.array(ids, "<u4")
        coded = range_codec.encode_group(ids)
        back, end = range_codec.decode_group(memoryview(coded))
        assert end == len(coded) and back.tolist() == ids.tolist()
    ids = np.tile(rng.integers(0, 300, 50), 200).astype("<u4")
    coded = bytearray(range_codec.encode_group(ids))
    assert len(coded) < 1.2 * len(ids)
    coded[-len(coded) // 3] ^= 255
    with pytest.raises(ValueError):
        range_codec.decode_group(memoryview(bytes(coded)))


def test_written_and_read_again(spark, tmp_path):
    texts = ["", None, "Some words, and MORE\nlines.", "ß é 中文 🙂", "x " * 9000, "same", "same", "tab\tand  spaces "]
    rows = [(i * 3 - 4, t) for i, t in enumerate(texts)] + [(2, "again"), (None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    folder = f"file://{tmp_path}/ids"
    written = token_files.write_token_files(docs, folder, public_tokenizers.path(token_files.TOKENIZER), roll=8)
    files = written.collect()
    assert len(files) > 3 and all(r.n_docs == 1 or r.n_ids < 8 + 9000 for r in files) and sum(r.n_docs for r in files) == len(rows)
    got = sorted(((r.start, r.doc_id, bytes(r.ids)) for r in token_files.read_token_files(spark, folder, written).collect()))
    tok = Tokenizer.from_file(public_tokenizers.path(token_files.TOKENIZER))
    want, at = [], 0
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        want.append((at, d, ids.tobytes()))
        at += len(ids)
    assert got == want
    assert zlib.crc32(want[0][2]) >= 0


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, extra int").write.parquet(f"{tmp_path}/documents.parquet")
    assert token_files.op1_token_files(spark, str(tmp_path)).count() == 0
