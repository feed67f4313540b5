import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from tessellate.llm import packing
from tessellate.llm.chunk_encoder import ChunkEncoder

TEXTS = ["", " ", "a", "  two  spaces ", "line\n\n next \n\tx", "a\n \nb", "it's we'll 'tis", "tab\t x", " x", "ä ß  é", "x" * 3000, "wörter und mehr " * 1500, "a 　 b", "<|endoftext|> x", "a <|endoftext|>b  <|startoftext|> ", "İ!- x", "a   b", "\n x"]


def test_chunk_encoder_equals_the_library():
    for name, sticks in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        own = ChunkEncoder(public_tokenizers.path(name), sticks, limit=20)
        tok = Tokenizer.from_file(public_tokenizers.path(name))
        rng = random.Random(5)
        texts = TEXTS + ["".join(rng.choice(" \n\tab'sé1.,") for _ in range(40)) for _ in range(600)]
        texts += ["".join(rng.choice("  \nabcTHE'sëßÅÇÿªµİ!&&_-%\u0301Σ中1") for _ in range(40)) for _ in range(1500)]
        got = [np.frombuffer(x, "<u4").tolist() for x in own.encode(texts)]
        assert got == [tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_every_piece_has_one_place_close_to_the_bound(spark):
    rng = np.random.default_rng(1)
    for lengths in (rng.integers(1, 2049, 3000), np.minimum(rng.geometric(1 / 300, 3000), 2048), np.full(999, 1), np.full(50, 2048), np.full(77, 700)):
        pieces = spark.createDataFrame([(k, int(n), 5) for k, n in enumerate(lengths)], "id long, length int, offset int")
        out = packing.pack(pieces).toPandas()
        assert sorted(out["id"]) == list(range(len(lengths))) and (out.sort_values("id")["length"].to_numpy() == lengths).all()
        out = out.sort_values(["sequence_id", "offset"])
        s, o, n = (out[c].to_numpy() for c in ("sequence_id", "offset", "length"))
        new = np.r_[True, s[1:] != s[:-1]]
        assert (o[new] == 0).all() and (o[1:][~new[1:]] == (o + n)[:-1][~new[1:]]).all() and (o + n).max() <= 2048
        lower = max(-(-int(lengths.sum()) // 2048), int((lengths > 1024).sum()))
        assert new.sum() <= lower * 1.01 + 1 or lengths[0] == 700 and new.sum() == -(-77 // 2)


def test_ranges_hand_pieces_up():
    assert packing.carried([(0, 1, 3), (1, 2, 1), (2, 4, 0)]) == [(1, 0, 0, 2, 2), (2, 0, 1, 0, 1), (2, 1, 0, 0, 1)]


def test_pack_end_to_end(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "no id"), (3, None), (3, None), (7, "x " * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = packing.pack(packing.token_pieces(docs, public_tokenizers.path(packing.TOKENIZER))).collect()
    tok = Tokenizer.from_file(public_tokenizers.path(packing.TOKENIZER))
    want = []
    for d, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [0]
        at, n = 0, len(ids) % 2048 or min(len(ids), 2048)
        if len(ids) <= 2048:
            n = len(ids)
        while at < len(ids):
            want.append((d, at, n, zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes())))
            at, n = at + n, 2048
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted(((r.doc_id, r.start, r.length, r.ids_crc32) for r in out), key=key) == sorted(want, key=key)
    seqs = {}
    for r in out:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in seqs.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= 2048
    assert packing.pack(packing.token_pieces(docs.limit(0), public_tokenizers.path(packing.TOKENIZER))).count() == 0
