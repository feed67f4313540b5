import math

import numpy as np
import pytest

from tessellate.llm import top_k


def brute(rows, k, every, scale):
    ok = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, (q, u) in enumerate(ok):
        if q % every == 0:
            scores = sorted((-sum(x * y for x, y in zip(u, v)), c) for b, (c, v) in enumerate(ok) if b != a and len(v) == len(u))
            out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(scores[:k])]
    return sorted(out)


def test_against_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i), rng.normal(size=4).round(1).tolist()) for i in rng.permutation(120)]
    rows += [(0, [1.0] * 4), (3, None), (6, [None, 1.0, 1.0, 1.0]), (9, [float("nan")] * 4), (12, [float("inf")] * 4), (None, [1.0] * 4), (300, [2.0, 1.0]), (303, [1.0, 1.0]), (306, []), (309, [1e12] * 4), (312, [3.0] * 4), (312, [3.0] * 4), (315, [1e13, 1.0, 3.0]), (316, [1.0, -2.0, 5.0]), (318, [-0.5, 2.0, 1e13])]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, number int").repartition(3)
    for shard_rows in (16384, 13):
        got = sorted(tuple(r) for r in top_k.top_k(df, 3, 3, 256, shard_rows).select("query_id", "rank", "vec_id", "score").collect())
        assert got == brute(rows, 3, 3, 256)
    assert top_k.top_k(df.limit(0)).count() == 0


def test_scores_beyond_64_bits_raise(spark):
    df = spark.createDataFrame([(0, [1e18, 1.0]), (1, [1e18, 2.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="Overflow|too large"):
        top_k.top_k(df).collect()


def test_finite_components_are_never_dropped(spark):
    df = spark.createDataFrame([(0, [1e307, 0.0]), (1, [1.0, 2.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="too large"):
        top_k.top_k(df).collect()
