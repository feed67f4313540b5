"""Toxicity by subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A text is a bag of hashed character 3- to 6-grams of its words (with word borders; a gram that occurred among the
last SPAN ones doesn't count again), so misspelled words share vectors with the spelled ones. The grams' embeddings are averaged and go to a two-class softmax;
embeddings and softmax are trained together by stochastic gradient descent on at most TRAIN_DOCS labelled
documents, half of them toxic where there are enough. A text is averaged in windows of WINDOW grams that overlap by
half, and its most toxic window counts, so a long text doesn't hide a short insult; in training a toxic
document is represented by its currently most toxic window, and each gram counts once in a text, which bounds what is gathered. Because the averages are linear, a trained
model folds into one number a gram, and scoring is a lookup and a running sum.

Defined results: null or empty text, or text without a gram, has the score of the bias alone; a null doc_id
is not held out and not learned from; without labels of both kinds every score is the share of toxic
labels (0 without labels); a document with labels of both kinds is toxic; of rows with one doc_id one is
learned from; repeated rows are scored one by one; an empty table gives an empty result; other columns are never features.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import read_table, smallest
from .grams import buffer, hashes, table

BITS, DIM, SIZES, WINDOW, SPAN = 17, 8, (3, 4, 5, 6), 192, 1 << 15
TRAIN_DOCS, EPOCHS, RATE = 6000, 10, 1.0
_KEEP = table("0123456789@$*")


def grams(texts: list[str], again: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Each text's gram buckets in reading order, without those that occurred less than SPAN grams before (or at all, without `again`), and where each text's begin."""
    data, starts = buffer(texts, _KEEP)
    black = data != 32
    m = len(data) - max(SIZES) + 1
    some, found = np.zeros((m, len(SIZES)), bool), np.zeros((m, len(SIZES)), np.uint32)
    for k, n in enumerate(SIZES):
        inner = black[1 : 1 + m].copy()
        for i in range(2, n - 1):
            inner &= black[i : i + m]
        some[:, k], found[:, k] = inner, hashes(data, n, BITS)[:m]
    per = np.concatenate([[0], np.cumsum(some.sum(1))])[np.minimum(starts, m)]
    found = found[some]
    fresh, seen_at = np.zeros(len(found), bool), np.empty(1 << BITS, np.int64)
    for a, z in zip(per, per[1:]):
        own, place = found[a:z], np.arange(z - a)
        seen_at[own[::-1]] = place[::-1]
        fresh[a:z] = seen_at[own] == place
        if again and z - a > SPAN:
            order = np.argsort(own, kind="stable")
            far = (own[order[1:]] == own[order[:-1]]) & (np.diff(order) >= SPAN)
            fresh[a + order[1:][far]] = True
    return found[fresh], np.concatenate([[0], np.cumsum(fresh)])[per]


def window_sums(values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Means of values over the half-overlapping windows of each text: owner, first place and mean."""
    sizes = np.diff(starts)
    half = WINDOW // 2
    n = np.maximum(1, -(-np.maximum(sizes - half, 1) // half))
    owner = np.repeat(np.arange(len(sizes)), n)
    step = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    first = starts[owner] + step * half
    last = np.where(step == n[owner] - 1, starts[owner] + sizes[owner], first + WINDOW)
    first = np.maximum(np.minimum(first, last - WINDOW), starts[owner])
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return owner, first, (total[last] - total[first]) / WINDOW


class Model:
    """Folded model: a number a bucket, and the bias; a window's logit is bias + its values' mean."""

    def __init__(self, value: np.ndarray, bias: float):
        self.value, self.bias = value, bias

    def score(self, texts: list[str]) -> np.ndarray:
        found, starts = grams(texts)
        owner, _, mean = window_sums(self.value[found], starts)
        top = np.full(len(texts), -np.inf)
        np.maximum.at(top, owner, mean)
        return 1 / (1 + np.exp(-np.clip(self.bias + top, -40, 40)))


def train(bags: list[np.ndarray], labels: np.ndarray, seed: int = 11) -> Model:
    if not len(labels) or labels.min() == labels.max():
        share = float(np.clip(labels.mean() if len(labels) else 0, 1e-9, 1 - 1e-9))
        return Model(np.zeros(1 << BITS, np.float32), float(np.log(share / (1 - share))))
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (1 << BITS, DIM)).astype(np.float32)
    out, bias = np.zeros((2, DIM), np.float32), np.zeros(2, np.float32)
    step, steps = 0, EPOCHS * len(bags)
    for epoch in range(EPOCHS):
        # the value of each gram under the current model picks the window that speaks for a document
        value = vectors @ (out[1] - out[0]) if epoch else None
        for i in rng.permutation(len(bags)):
            bag, rate = bags[i], RATE * (1 - step / steps)
            step += 1
            if not len(bag):
                continue
            if value is not None:
                _, first, mean = window_sums(value[bag], np.array([0, len(bag)]))
                at = first[mean.argmax()]
            else:
                at = rng.integers(0, max(1, len(bag) - WINDOW + 1))
            idx, count = np.unique(bag[at : at + WINDOW], return_counts=True)
            share = (count / WINDOW).astype(np.float32)
            rows = vectors[idx]
            hidden = share @ rows
            z = out @ hidden + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            pull = p @ out
            out -= rate * np.outer(p, hidden)
            bias -= rate * 0.1 * p
            vectors[idx] = rows - (rate * 20) * share[:, None] * pull
    return Model((vectors @ (out[1] - out[0])).astype(np.float32), float(bias[1] - bias[0]))


def fit(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_DOCS) -> Model:
    """docs (doc_id, text), labels (doc_id, toxic): learns from at most `limit` documents."""
    marks = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    counts = {r["toxic"]: r["count"] for r in marks.groupBy("toxic").count().collect()}
    few = F.broadcast(smallest(marks, "toxic", counts, limit // 2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 64):
                part = b.slice(k, 64)
                found, starts = grams([t or "" for t in part.column(0).to_pylist()], again=False)
                bags = pa.array([found[a:z].astype("<u4").tobytes() for a, z in zip(starts, starts[1:])])
                yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), bags], ["doc_id", "toxic", "bag"])

    # at most `limit` labels of two numbers: small enough to broadcast, so texts are not shuffled
    # of a repeated id the least text, and all in the order of ids: a task that runs again learns the same
    chosen = docs.select("doc_id", "text").join(few, "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("text", "doc_id", "toxic")
    rows = sorted(chosen.mapInArrow(run, "doc_id long, toxic int, bag binary").collect(), key=lambda r: r["doc_id"])
    return train([np.frombuffer(r["bag"], "<u4") for r in rows], np.array([int(r["toxic"] > 0) for r in rows], int))


def score(docs: DataFrame, model: Model, *keep: str) -> DataFrame:
    """The named columns of docs (doc_id, text, ...) with the score and the predicted class of their texts."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*keep, F.col("text").alias("_body"))
    kinds = T.StructType([*rows.schema.fields[:-1], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 64):
                part = b.slice(k, 64)
                s = shared.value.score([t or "" for t in part.column(len(keep)).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(s), pa.array((s >= 0.5).astype(np.int32))], [*keep, "score", "predicted"])

    return rows.mapInArrow(run, kinds)


def filter_documents(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that the model doesn't call toxic, with their own columns (whatever their names)."""
    held = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("held")
    return score(docs.select(held, "text"), model, "held").where("predicted = 0").select("held.*")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    labels = read_table(spark, sf_dir, "labels", "doc_id", "toxic").where(~held)
    return score(docs.withColumn("held_out", held), fit(docs, labels), "doc_id", "held_out")


QUERIES = {"op6_toxicity": op6_toxicity}
SQL: dict[str, str] = {}
