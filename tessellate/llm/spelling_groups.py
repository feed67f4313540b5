"""Spelling variants: words one edit apart, found by merging the light subtrees of an errata trie.

Counting: letter runs are cut, lower-cased and counted in the JVM (partial sums before the shuffle). The
words are range-partitioned, so that a range is a stretch of the trie. Inside a range every node is merged
once: the subtrees of all children but the largest (the heavy one) lose the node's character, which makes
their words' rests coincide where two words differ by that character; their rests are also looked up below
the node (one character skipped) and below the heavy child (one replaced, one skipped there). A word is
light at most log2(words) times on its way down, so a range of m words takes O(m log m) look-ups. Nodes
whose words span several ranges are merged by a shuffle: each word's rest, with the node's character left
out and whole, meets the others at (node, rest); at most one word a letter of the alphabet meets there.

Every pair of near words is found at one node only: a replaced character at its place, an inserted one at
the last place of its run. So the near words are counted without naming pairs, and only the best is kept.

Defined results: a null text has no words; a null doc_id is written as an empty text; repeated rows count
again; a word without near words has n_near 0 and is its own root; an empty table gives no rows; other
columns are ignored. Nothing bounds a word's length. The driver holds a few strings a range (its first and
last word and the branching nodes on its borders), which grow with the number of ranges, not with a range.
"""

from __future__ import annotations

import math
import os

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, read_table

RUN = r"[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MIN_LENGTH, MIN_COUNT, DOMINANCE, TYPO_EVERY = 6, 5, 5, 199
#: words of a range; the ranges are at least as many as shuffle partitions
RANGE_WORDS = 50_000
#: stands in no word, between a node and a rest
SEPARATOR = "\n"


def planted(word: Column, doc_id: Column) -> Column:
    """The word, without one of its code points where crc32 of `doc_id:word` is a multiple of TYPO_EVERY."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), word).cast("binary"))
    return F.when(h % TYPO_EVERY == 0, F.overlay(word, F.lit(""), (h % F.length(word)).cast("int") + 1, F.lit(1))).otherwise(word)


def count_words(docs: DataFrame, change=None, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """word, n of the letter runs of doc_id, text; change(word, doc_id) may shorten a run before it is counted."""
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.where(F.length("run") >= min_length).withColumn("run", F.translate("run", UPPER, LOWER))
    word = F.col("run") if change is None else change(F.col("run"), F.col("doc_id"))
    return runs.select(word.alias("word")).where(F.length("word") >= min_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)


def shared_prefix(a: str, b: str) -> int:
    return len(os.path.commonprefix((a, b)))


class Found:
    """Counts of near words and the best of them (largest n, then smallest word) for the words of a range."""

    def __init__(self, words: list[str], n: list[int]):
        self.words, self.n = words, n
        self.near, self.best = [0] * len(words), [-1] * len(words)

    def pair(self, i: int, j: int) -> None:
        for a, b in ((i, j), (j, i)):
            self.near[a] += 1
            held = self.best[a]
            # the words are sorted: a smaller place is a smaller word
            if held < 0 or (-self.n[b], b) < (-self.n[held], held):
                self.best[a] = b


def merge_trie(words: list[str], n: list[int], borders: tuple[str | None, str | None] = (None, None)) -> Found:
    """Near words among sorted distinct words, at all nodes that are no prefix of a border."""
    found, place = Found(words, n), {w: i for i, w in enumerate(words)}
    stack = [(0, len(words))] if words else []
    while stack:
        low, high = stack.pop()
        if high - low < 2:
            continue
        depth = shared_prefix(words[low], words[high - 1])
        node = words[low][:depth]
        ends_here = len(words[low]) == depth
        children, at = [], low + ends_here
        for i in range(at + 1, high + 1):
            if i == high or words[i][depth] != words[at][depth]:
                children.append((at, i))
                at = i
        stack += children
        if any(b is not None and b.startswith(node) for b in borders):
            continue
        heavy = max(children, key=lambda c: c[1] - c[0])
        below = node + words[heavy[0]][depth]
        if ends_here and below in place:
            found.pair(low, place[below])
        merged: dict[str, list[int]] = {}
        for child in children:
            if child == heavy:
                continue
            letter = words[child[0]][depth]
            for i in range(*child):
                rest = words[i][depth + 1 :]
                # one character replaced: among the light subtrees, and against the heavy one
                same = merged.setdefault(rest, [])
                for j in same:
                    found.pair(i, j)
                same.append(i)
                if (j := place.get(below + rest)) is not None:
                    found.pair(i, j)
                # one character skipped, at the last place of its run: here, and in the heavy subtree
                if not rest.startswith(letter) and (j := place.get(node + rest)) is not None:
                    found.pair(i, j)
                if (j := place.get(below + letter + rest)) is not None:
                    found.pair(i, j)
    return found


def by_range(words: DataFrame, fn, schema: str) -> DataFrame:
    """fn(range, words, n) -> columns; a range's words are sorted. Ranges are bounded, so a group fits in a task."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by("word")
        return pa.table(fn(key[0].as_py(), table.column("word").to_pylist(), table.column("n").to_pylist()))

    return words.groupBy("range").applyInArrow(run, schema)


def near_words(words: DataFrame, n_ranges: int | None = None) -> DataFrame:
    """word, n, n_near, form, form_n of distinct words (word, n; no line breaks): the most frequent near word and how often it stands."""
    spark = words.sparkSession
    scratch = Scratch(spark, "spelling")
    counted = scratch.write(words.select("word", "n"), "counted")
    ranges = n_ranges or max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(counted.count() / RANGE_WORDS))
    ranged = scratch.write(counted.repartitionByRange(ranges, "word").select("word", "n", F.spark_partition_id().alias("range")), "ranged")
    scratch.drop("counted")
    ends = sorted((r.range, r.first, r.last) for r in ranged.groupBy("range").agg(F.min("word").alias("first"), F.max("word").alias("last")).collect())
    links = [None] + [a[2][: shared_prefix(a[2], b[1])] for a, b in zip(ends, ends[1:])] + [None]
    borders = {r: (links[i], links[i + 1]) for i, (r, _, _) in enumerate(ends)}

    def branching(r: int, words: list[str], n: list[int]) -> dict:
        """The nodes on the range's borders at which one of its words ends or leaves the border."""
        return {"node": pa.array(sorted({b[: shared_prefix(w, b)] for b in borders[r] if b is not None for w in words}), pa.string())}

    nodes = frozenset(x.node for x in by_range(ranged, branching, "node string").distinct().collect())

    def inside(r: int, words: list[str], n: list[int]) -> dict:
        found = merge_trie(words, n, borders[r])
        form = [words[b] if b >= 0 else None for b in found.best]
        return {"word": pa.array(words, pa.string()), "n": pa.array(n, pa.int64()), "n_near": pa.array(found.near, pa.int64()), "form": pa.array(form, pa.string()), "form_n": pa.array([n[b] if b >= 0 else None for b in found.best], pa.int64())}

    def across(r: int, words: list[str], n: list[int]) -> dict:
        """A word's rests at the spanning nodes above it: whole, and without the node's character."""
        out: list = []
        for w, c in zip(words, n):
            deepest = max((shared_prefix(w, b) for b in borders[r] if b is not None), default=-1)
            for k in range(deepest + 1):
                node = w[:k]
                if node in nodes:
                    out.append((f"{node}{SEPARATOR}{w[k:]}", w, c, None))
                    if len(w) > k:
                        out.append((f"{node}{SEPARATOR}{w[k + 1 :]}", w, c, w[k]))
        columns = list(zip(*out)) or [[], [], [], []]
        return {name: pa.array(x, t) for name, x, t in zip(("place", "word", "n", "letter"), columns, (pa.string(), pa.string(), pa.int64(), pa.string()))}

    held = by_range(ranged, across, "place string, word string, n long, letter string")
    met = held.groupBy("place").agg(F.collect_list(F.struct("word", "n", "letter")).alias("met")).where(F.size("met") > 1)
    one = met.select("met", F.substring_index("place", SEPARATOR, -1).substr(1, 1).alias("next"), F.explode("met").alias("one"))

    def is_near(m: Column) -> Column:
        """Two words that lost a character differ by it; one is near a whole rest unless its character only lengthens the rest's first run."""
        both = m["letter"].isNotNull() & F.col("one.letter").isNotNull()
        return (m["word"] != F.col("one.word")) & (both | (F.coalesce(m["letter"], "one.letter") != F.col("next")))

    near = F.filter("met", is_near)
    spanning = one.select("one.word", "one.n", near.alias("near")).where(F.size("near") > 0)
    spanning = spanning.select("word", "n", F.size("near").cast("long").alias("n_near"), F.array_min(F.transform("near", lambda m: F.struct((-m["n"]).alias("less"), m["word"].alias("form")))).alias("best"))
    local = by_range(ranged, inside, "word string, n long, n_near long, form string, form_n long")
    local = local.select("word", "n", "n_near", F.when(F.col("form").isNotNull(), F.struct((-F.col("form_n")).alias("less"), "form")).alias("best"))
    out = local.unionByName(spanning).groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), F.min("best").alias("best"))
    return out.select("word", "n", "n_near", F.col("best.form").alias("form"), (-F.col("best.less")).alias("form_n"))


def with_forms(near: DataFrame, dominance: int = DOMINANCE) -> DataFrame:
    """form and form_n only where the near word is `dominance` times as frequent, and root: the form of the form, to the last."""
    keep = F.col("form_n") >= dominance * F.col("n")
    scratch = Scratch(near.sparkSession, "spelling-forms")
    words = scratch.write(near.select("word", "n", "n_near", F.when(keep, F.col("form")).alias("form"), F.when(keep, F.col("form_n")).alias("form_n")), "words")
    formed = words.where(F.col("form").isNotNull())
    links = formed.select("word", F.col("form").alias("root"))
    # a chain's counts grow by `dominance` at each link; each round doubles the links that a row has followed
    most = formed.agg(F.max("form_n")).head()[0] or 1
    longest = max(1, math.floor(math.log(most, dominance) + 1e-9)) if most > 1 else 1
    for k in range(math.ceil(math.log2(longest))):
        onward = links.select(F.col("word").alias("of"), F.col("root").alias("further"))
        links = scratch.write(links.join(onward, F.col("root") == F.col("of"), "left").select("word", F.coalesce("further", "root").alias("root")), "links")
    return words.join(links, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_forms(near_words(count_words(read_table(spark, sf_dir, "documents", "doc_id", "text"), planted)))


QUERIES = {"op13_spelling_groups": op13_spelling_groups}
SQL = {
    "op13_spelling_groups": """
WITH RECURSIVE crc AS (SELECT list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS t
  FROM (SELECT range AS n FROM range(256))),
r AS (SELECT coalesce(doc_id::VARCHAR, '') AS d, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents) WHERE length(run) >= 6),
g AS (SELECT d, w, count(*) AS c FROM r GROUP BY d, w),
h AS (SELECT w, c, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(d || ':' || w, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [195::BIGINT, unicode(x)::BIGINT - 64] END))),
  lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM g, crc),
v AS (SELECT CASE WHEN h % 199 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, c FROM h),
w AS MATERIALIZED (SELECT word, sum(c)::BIGINT AS n FROM v WHERE length(word) >= 6 GROUP BY word HAVING sum(c) >= 5),
x AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
p AS (SELECT a.word, b.word AS near, b.n FROM x a JOIN x b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM x a JOIN w b ON a.rest = b.word UNION SELECT b.word, a.word, a.n FROM x a JOIN w b ON a.rest = b.word),
b AS (SELECT word, count(*) AS n_near, arg_min(near, (-n, near)) AS near, max(n) AS near_n FROM p GROUP BY word),
f AS MATERIALIZED (SELECT w.word, CASE WHEN near_n >= 5 * n THEN near END AS form, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * n THEN near_n END AS form_n FROM w LEFT JOIN b ON w.word = b.word),
s AS (SELECT word, word AS at FROM f UNION ALL SELECT s.word, f.form FROM s JOIN f ON s.at = f.word WHERE f.form IS NOT NULL)
SELECT f.word, f.form, s.at AS root, f.n, f.n_near, f.form_n FROM f JOIN s ON f.word = s.word JOIN f l ON s.at = l.word WHERE l.form IS NULL"""
}
