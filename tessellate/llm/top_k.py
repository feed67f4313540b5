"""Exact top-k search: tiled matrix products, partial selection in each tile, tree merging of the lists.

Vectors are dealt into shards of bounded size, their components packed in as few bytes as hold them; a shard's
own queries make its query tile. Each task has one shard and a group of query tiles: matrix products over
sub-tiles, the best k of each query by partial selection. Then the lists of a query are merged over groups of
shards, level by level. With large groups of query tiles, mostly queries move, which are a small share of the rows.

Defined results: components become floor(scale * x); vectors that are null or hold null or non-finite
components, and rows without an id, take no part; only vectors of equal length meet; ties go to the
smaller id; repeated ids are rows of their own (a query leaves out its own row only); an empty table gives
an empty result; other columns are ignored. Products are exact whatever the components; a score that is
returned and doesn't fit 64 bits raises OverflowError, as does a finite component that its scale takes beyond doubles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialize, read_table

SHARD, QUERY_TILES, FAN_IN, SUB_TILE = 16_384, 128, 16, 256


def packed(matrix: np.ndarray) -> tuple[str, bytes]:
    """The smallest kind of number that holds integers given as doubles (which hold them all), and the cells in it."""
    most = np.abs(matrix).max(initial=0)
    kind = "<i2" if most < 2**15 else "<i4" if most < 2**31 else "<f8"
    return kind, matrix.astype(kind).tobytes()


def shards(vectors: DataFrame, query_every: int, scale: int, parts: int, shard_rows: int) -> DataFrame:
    """Rows (shard, number, dim, kind, ids, is_query, matrix) by id; number is the part, from 0 to parts - 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list[tuple[int, np.ndarray]]] = {}
        part, made = TaskContext.get().partitionId(), 0

        def tile(dim: int) -> pa.RecordBatch:
            nonlocal made
            rows = sorted(waiting.pop(dim), key=lambda r: r[0])
            ids = np.array([r[0] for r in rows], np.int64)
            kind, cells = packed(np.floor(scale * np.array([r[1] for r in rows], np.float64).reshape(len(rows), dim)))
            made += 1
            return pa.RecordBatch.from_pydict({"shard": [(part << 32) | made], "number": [part], "dim": [dim], "kind": [kind], "ids": [ids.tobytes()], "is_query": [(ids % query_every == 0).tobytes()], "matrix": [cells]})

        for b in batches:
            for vec_id, v in zip(b.column(0).to_pylist(), b.column(1)):
                if vec_id is None or not v.is_valid or v.values.null_count:
                    continue
                x = v.values.to_numpy(zero_copy_only=False).astype(np.float64)
                if not np.isfinite(x).all():
                    continue
                if not np.isfinite(scale * x).all():
                    raise OverflowError(f"a component of vector {vec_id} is too large to be scaled")
                waiting.setdefault(len(x), []).append((vec_id, x))
                if len(waiting[len(x)]) >= 2 * shard_rows:
                    yield tile(len(x))
        for dim in list(waiting):
            yield tile(dim)

    return vectors.repartition(parts).mapInArrow(run, "shard long, number long, dim long, kind string, ids binary, is_query binary, matrix binary")


def _product(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer inner products, in floating point where every partial sum fits its mantissa, else in whole numbers."""
    bound = float(np.abs(q.astype(np.float64)).max(initial=0)) * float(np.abs(c.astype(np.float64)).max(initial=0)) * max(1, q.shape[1])
    for kind, bits in ((np.float32, 24), (np.float64, 53)):
        if bound < 2**bits:
            return (q.astype(kind) @ c.astype(kind).T).astype(np.int64)
    if bound < 2**62:
        return q.astype(np.int64) @ c.astype(np.int64).T
    whole = np.frompyfunc(int, 1, 1)
    return whole(q) @ whole(c).T


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k highest scores of each row, ties to the smaller column; in order."""
    n = scores.shape[1]
    k = min(k, n)
    if scores.dtype == np.int64 and np.abs(scores).max(initial=0) < 2**62 // max(1, n):
        keys = scores * n + np.arange(n - 1, -1, -1)
        at = np.argpartition(keys, n - k, axis=1)[:, n - k :] if k < n else np.tile(np.arange(n), (len(keys), 1))
        order = np.argsort(-np.take_along_axis(keys, at, 1), axis=1)
        return np.take_along_axis(at, order, 1)
    return np.argsort(-scores, axis=1, kind="stable")[:, :k]


def top_k(vectors: DataFrame, k: int = 5, query_every: int = 50, scale: int = 256, shard_rows: int = SHARD) -> DataFrame:
    """vectors (vec_id, embedding) to (query_id, rank, vec_id, score)."""
    rows = vectors.select("vec_id", "embedding")
    parts = max(1, -(-rows.count() // shard_rows))
    groups = -(-parts // QUERY_TILES)
    tiles = materialize(shards(rows, query_every, scale, parts, shard_rows), "shards")
    left = tiles.select("shard", "number", "dim", "kind", "ids", "matrix", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("group"))

    def queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                ids, flags = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["is_query"], bool)
                at = np.flatnonzero(flags)
                if len(at):
                    m = np.frombuffer(row["matrix"], row["kind"]).reshape(len(ids), row["dim"])
                    yield pa.RecordBatch.from_pydict({"home": [row["shard"]], "group": [row["number"] // QUERY_TILES], "dim": [row["dim"]], "kind": [row["kind"]], "places": [at.tobytes()], "ids": [ids[at].tobytes()], "matrix": [m[at].tobytes()]})

    asked = tiles.mapInArrow(queries, "home long, group long, dim long, kind string, places binary, ids binary, matrix binary")
    right = asked.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("number"))

    def search(key: tuple, shard: pd.DataFrame, tiles: pd.DataFrame) -> pd.DataFrame:
        out = []
        for s in shard.itertuples():
            ids = np.frombuffer(s.ids, np.int64)
            c = np.frombuffer(s.matrix, s.kind).reshape(len(ids), s.dim)
            for t in tiles[tiles["dim"] == s.dim].itertuples():
                q_ids, places = np.frombuffer(t.ids, np.int64), np.frombuffer(t.places, np.int64)
                q = np.frombuffer(t.matrix, t.kind).reshape(len(q_ids), s.dim)
                for a in range(0, len(q_ids), SUB_TILE):
                    own = t.home == s.shard
                    scores = _product(q[a : a + SUB_TILE], c)
                    found = best(scores, k + own)
                    rows = np.repeat(np.arange(len(found)), found.shape[1])
                    cols = found.reshape(-1)
                    if own:
                        other = cols != places[a + rows]
                        rows, cols = rows[other], cols[other]
                    out.append(pd.DataFrame({"home": t.home, "place": places[a + rows], "query_id": q_ids[a + rows], "vec_id": ids[cols], "score": scores[rows, cols].astype(np.int64)}))
        found = pd.concat(out) if out else pd.DataFrame({n: [] for n in ("home", "place", "query_id", "vec_id", "score")})
        return found.assign(number=key[0])

    keys = ["number", "group"]
    lists = left.groupBy(keys).cogroup(right.groupBy(keys)).applyInPandas(search, "home long, place long, query_id long, vec_id long, score long, number long")
    width = parts
    query = ["home", "place", "query_id"]
    while True:
        width = -(-width // FAN_IN)
        lists = lists.withColumn("number", F.floor(F.col("number") / FAN_IN).cast("long"))
        ranked = Window.partitionBy(*query, "number").orderBy(F.desc("score"), "vec_id")
        lists = lists.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
        if width == 1:
            return lists.select("query_id", "rank", "vec_id", "score")
        lists = lists.drop("rank")


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(read_table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


QUERIES = {"op9_exact_top_k": op9_exact_top_k}
SQL = {
    "op9_exact_top_k": """
WITH v AS (SELECT row_number() OVER () AS uid, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, q.uid AS quid, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score FROM v q, v c
  WHERE q.vec_id % 50 = 0 AND c.uid <> q.uid AND len(c.e) = len(q.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY quid ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""
}
