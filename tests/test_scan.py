"""Scans of keys that fill many tasks equal one walk over each key."""

import random

import pytest
from pyspark.sql import functions as F

from tessellate.operators.alignment import major_items
from tessellate.operators.scan import ordered_scan
from tessellate.plans.sequences import c1_fixed_windows


@pytest.fixture
def many_ranges(spark):
    old = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    for c, v in old.items():
        spark.conf.set(c, v)


def walked(rows, start, step):
    """rows (key, place, value) by one loop."""
    out, last, state = {}, object(), start
    for k, place, value in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        if k != last:
            last, state = k, start
        state, got = step(state, value)
        out[k, place] = got
    return out


def hot_rows(rng, values, n=1500):
    """A third of the rows or more under one key, the rest under a few keys and null."""
    keys = [7 if rng.random() < 0.6 else rng.choice([None, 1, 3, 9, 12]) for _ in range(n)]
    return [(k, i, values(rng)) for i, k in enumerate(keys)]


@pytest.mark.parametrize("forgets", [True, False])
def test_scan_equals_one_walk(spark, many_ranges, forgets):
    """A machine that now and then forgets its state and one that never does (a running sum)."""

    def step(state, v):
        state = 0 if forgets and v == 0 else state + (v or 0)
        return state, (state, state % 2 == 0)

    rows = hot_rows(random.Random(4), lambda r: r.choice([0, 1, 2, 5, None]))
    df = spark.createDataFrame(rows, "k long, place long, v int").repartition(5)
    got = {(r.k, r.place): (r.total, r.even) for r in ordered_scan(df, "k", ["place"], ["v"], 0, step, "total long, even boolean").collect()}
    assert got == walked(rows, 0, step)


def test_scan_cuts_the_hot_key(spark, many_ranges):
    """One key's rows stand in many tasks, none with most of them."""
    df = spark.range(4000).select(F.lit(1).cast("long").alias("k"), F.col("id").alias("place"), F.lit(1).alias("v"))
    out = ordered_scan(df, "k", ["place"], ["v"], 0, lambda s, v: (s + v, (s + v,)), "total long")
    per_task = [r["n"] for r in out.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    assert len(per_task) >= 8 and max(per_task) < 1500
    assert out.where("total <> place + 1").count() == 0


def test_empty_and_single(spark):
    df = spark.createDataFrame([], "k string, place long, v int")
    step = lambda s, v: (v, (s,))
    assert ordered_scan(df, "k", ["place"], ["v"], None, step, "before int").collect() == []
    one = spark.createDataFrame([("a", 1, 5)], "k string, place long, v int")
    assert [r.before for r in ordered_scan(one, "k", ["place"], ["v"], None, step, "before int").collect()] == [None]


def test_fixed_windows_of_a_busy_key(spark, many_ranges):
    """Requests every second never let two window chains meet: the worst case of the hand-over."""
    rng = random.Random(9)
    times = [(k, t) for k, n, gap in ((1, 900, 1), (2, 60, 40), (3, 300, 7)) for t in (i * gap + (rng.randint(0, 3) if k == 3 else 0) for i in range(n))]
    rows = [(k, t, i) for i, (k, t) in enumerate(times)]
    df = spark.createDataFrame(rows, "user_id long, s long, event_id long").select("user_id", F.timestamp_seconds("s").alias("ts"), "event_id")
    want, begin, n, last = {}, None, 0, None
    for k, t, i in sorted(rows):
        if k != last or t - begin > 60:
            last, begin, n = k, t, 0
        n += 1
        want[i] = (n, n > 20)
    assert {r.event_id: (r.n, r.limited) for r in c1_fixed_windows(df, window_s=60, limit=20).collect()} == want


def test_major_items_of_a_long_document(spark, many_ranges):
    rng = random.Random(2)
    items = [rng.choice([str(i // 40), str(rng.randint(1, 30)), f"{i // 40}.{rng.randint(1, 4)}", "x", None]) for i in range(1600)]
    want, major, nested = [], 0, 0
    for item in items:
        if item and "." in item:
            nested = 0
        elif item and item.isdigit():
            n = int(item)
            if nested and n == nested + 1:
                nested = n
            elif n > major:
                major, nested = n, 0
            else:
                nested = n
        want.append(str(major) if major else None)
    df = spark.createDataFrame([(7, i, t) for i, t in enumerate(items)], "doc_id long, position long, item string")
    assert [r.major for r in major_items(df).orderBy("position").collect()] == want
