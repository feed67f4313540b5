"""Language identification by hierarchical discrimination.

One-versus-rest linear support vector machines choose the language family; within the family,
one-versus-one linear SVMs vote on the language. Features are the square roots of hashed 2- and 3-gram
counts of the whole text, scaled to unit length. The SVMs are fitted by dual coordinate descent in numpy on
at most SAMPLE_DOCS labelled documents (equally many of each language, chosen by a hash of doc_id); every
document is scored on the executors.

Defined results: null text or text without a letter gives `und` with score 0; a null doc_id is not held
out and not learned from; without labelled documents all is `und`; with one language all other texts get
it; of rows with one doc_id and language one is learned from; repeated rows are scored one by one; an empty table gives an empty result; lang, source and doc_id are
never features.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table, smallest
from .grams import buffer, hashes, table

BITS, SAMPLE_DOCS, EPOCHS, COST = 12, 6000, 12, 4.0
#: Families of common language codes; any other language is a family of its own.
FAMILIES = {
    "germanic": ("de", "en", "nl", "sv", "da", "no", "nb", "nn", "is", "af"),
    "romance": ("es", "fr", "it", "pt", "ro", "ca", "gl", "oc"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl", "mk", "bs"),
    "baltic": ("lt", "lv"),
    "celtic": ("ga", "cy", "br", "gd"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz"),
}
_KEEP = table("")


def family_of(lang: str) -> str:
    return next((f for f, langs in FAMILIES.items() if lang in langs), lang)


def features(texts: list[str]) -> np.ndarray:
    """One row of 2^BITS numbers for each text."""
    out = np.zeros((len(texts), 1 << BITS), np.float32)
    if not texts:
        return out
    data, starts = buffer(texts, _KEEP)
    owner = np.repeat(np.arange(len(texts)), np.diff(starts))
    for n in (2, 3):
        h = hashes(data, n, BITS)[: len(owner)]
        some = data[: len(h)] != 32
        for k in range(1, n):
            some |= data[k : k + len(h)] != 32
        h = (h + owner[: len(h)] * (1 << BITS))[some]
        out += np.bincount(h, minlength=out.size).reshape(out.shape)
    np.sqrt(out, out=out)
    out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)
    return out


def fit_svm(x: np.ndarray, y: np.ndarray, seed: int = 7) -> np.ndarray:
    """Weights (the last one is the bias) of a squared-hinge linear SVM, by dual coordinate descent."""
    w, bias, alpha = np.zeros(x.shape[1], np.float32), 0.0, np.zeros(len(x))
    weight = np.where(y > 0, len(y) / max(1, 2 * (y > 0).sum()), len(y) / max(1, 2 * (y < 0).sum()))
    diagonal = 0.5 / (COST * weight)
    square = np.einsum("ij,ij->i", x, x) + 1
    rng = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(x)):
            g = y[i] * (float(w @ x[i]) + bias) - 1 + diagonal[i] * alpha[i]
            new = max(alpha[i] - g / (square[i] + diagonal[i]), 0.0)
            if (step := (new - alpha[i]) * y[i]) != 0:
                w += np.float32(step) * x[i]
                bias += step
                alpha[i] = new
    return np.append(w, np.float32(bias))


class Model:
    """Families, their languages, and the SVMs: `family` in family order, `pairs[(a, b)]` positive for a."""

    def __init__(self, x: np.ndarray, langs: list[str]):
        names = np.array(langs)
        kinds = np.array([family_of(v) for v in langs])
        self.families = sorted(set(kinds.tolist()))
        self.members = {f: sorted(set(names[kinds == f].tolist())) for f in self.families}
        self.family = np.stack([fit_svm(x, np.where(kinds == f, 1.0, -1.0)) for f in self.families]) if len(self.families) > 1 else None
        self.pairs = {}
        for f in self.families:
            for i, a in enumerate(self.members[f]):
                for b in self.members[f][i + 1 :]:
                    own = (names == a) | (names == b)
                    self.pairs[a, b] = fit_svm(x[own], np.where(names[own] == a, 1.0, -1.0))

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        def sigmoid(m):
            return 1 / (1 + np.exp(-np.clip(2 * m, -30, 30)))

        chosen, score = np.zeros(len(x), int), np.ones(len(x))
        if self.family is not None:
            margins = x @ self.family[:, :-1].T + self.family[:, -1]
            chosen, score = margins.argmax(1), sigmoid(margins.max(1))
        out = np.empty(len(x), object)
        for k, f in enumerate(self.families):
            rows, langs = np.flatnonzero(chosen == k), self.members[f]
            votes = np.zeros((len(rows), len(langs)))
            margin = np.zeros_like(votes)
            for (i, a), (j, b) in ((p, q) for p in enumerate(langs) for q in enumerate(langs) if p[0] < q[0]):
                w = self.pairs[a, b]
                m = x[rows] @ w[:-1] + w[-1]
                votes[:, i] += m > 0
                votes[:, j] += m <= 0
                margin[:, i] += m
                margin[:, j] -= m
            best = (votes * 1000 + np.tanh(margin)).argmax(1)
            out[rows] = np.array(langs, object)[best]
            if len(langs) > 1:
                score[rows] *= sigmoid(margin[np.arange(len(rows)), best] / (len(langs) - 1))
        return out.tolist(), score


def fit(docs: DataFrame, sample: int = SAMPLE_DOCS) -> Model | None:
    """docs (doc_id, text, lang): only rows with a language and a text are learned from."""
    docs = docs.where("lang IS NOT NULL AND text IS NOT NULL AND doc_id IS NOT NULL")
    counts = {r["lang"]: r["count"] for r in docs.groupBy("lang").count().collect()}
    if not counts:
        return None
    each = max(1, sample // len(counts))
    few = F.broadcast(smallest(docs.select("doc_id", "lang").distinct(), "lang", counts, each))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 128):
                part = b.slice(k, 128)
                x = features(part.column(0).to_pylist())
                rows = [(np.flatnonzero(r).astype("<u2"), r) for r in x]
                yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), pa.array([i.tobytes() for i, _ in rows]), pa.array([r[i].tobytes() for i, r in rows])], ["doc_id", "lang", "at", "value"])

    # at most `sample` ids and languages: small enough to broadcast, so texts are not shuffled
    # of a repeated id the least text, and all in the order of ids: a task that runs again learns the same
    chosen = docs.select("doc_id", "text", "lang").join(few, ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text")).select("text", "doc_id", "lang")
    rows = sorted(chosen.mapInArrow(run, "doc_id long, lang string, at binary, value binary").collect(), key=lambda r: (r["doc_id"], r["lang"]))
    x = np.zeros((len(rows), 1 << BITS), np.float32)
    for k, r in enumerate(rows):
        x[k, np.frombuffer(r["at"], "<u2")] = np.frombuffer(r["value"], np.float32)
    return Model(x, [r["lang"] for r in rows]) if rows else None


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held-out mark and text to doc_id, held_out, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 128):
                part = b.slice(k, 128)
                texts = part.column(2).to_pylist()
                some = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))] if shared.value else []
                langs, scores = ["und"] * len(texts), np.zeros(len(texts))
                if some:
                    found, scores[some] = shared.value.predict(features([texts[i] for i in some]))
                    for i, lang in zip(some, found):
                        langs[i] = lang
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(langs), pa.array(scores)], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    docs = docs.withColumn("held_out", held)
    return identify(docs, fit(docs.where(~held)))


QUERIES = {"op10_language_id": op10_language_id}
SQL: dict[str, str] = {}
