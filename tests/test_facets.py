"""Facets against a count of every filter but one, row by row."""

import random

from pyspark.sql import functions as F

from tessellate.plans.facets import facet_counts


def test_facets_equal_a_walk(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", "b", None]), rng.choice([1, 2, 3, None]), rng.choice([[], ["x"], ["x", "x", "y"], None])) for _ in range(300)]
    df = spark.createDataFrame(rows, "kind string, size int, tags array<string>")
    filters = {"kind": F.col("kind") == "a", "size": F.col("size") > 1, "tags": F.array_contains("tags", "x")}
    got = {(r.facet, r.value): r.n for r in facet_counts(df, filters, {"kind": F.col("kind"), "size": F.col("size"), "tags": F.col("tags"), "free": F.col("kind")}).collect()}
    ok = lambda r: {"kind": r[0] == "a", "size": (r[1] or 0) > 1, "tags": "x" in (r[2] or [])}
    want = {("all", None): sum(all(ok(r).values()) for r in rows)}
    for facet, values in (("kind", lambda r: [r[0]]), ("size", lambda r: [r[1]]), ("tags", lambda r: set(r[2] or [])), ("free", lambda r: [r[0]])):
        for r in rows:
            for v in values(r):
                key = (facet, None if v is None else str(v))
                want[key] = want.get(key, 0) + all(passed for name, passed in ok(r).items() if name != facet)
    assert got == want and any(n == 0 for n in got.values())
    assert facet_counts(df.limit(0), filters, {"kind": F.col("kind")}).count() == 0
