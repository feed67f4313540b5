"""Quality rules as a bitmask ledger (DataFrame functions only).

Every rule is evaluated once per document; the ledger row keeps the measurements and one bit per
failed rule. Versioned policies are bit masks over that ledger, so a new policy or an ablation is a
bitwise aggregation over the small ledger, never another pass over the texts.

Defined results: null or empty text has no words, so it fails `few_words`; repeated rows are rated
one by one; an empty table gives an empty ledger; other input columns are ignored unless named in
`keep`. Trigram equality is decided on 64-bit xxhash values within one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let, read_table

WHITE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, WHITE[1:], " " * 5), " "), "")


def _covered(pos: Column) -> Column:
    """Words covered by 3-word windows that begin at the sorted positions pos (at least one)."""
    gaps = F.transform(F.slice(pos, 2, F.size(pos)), lambda p, k: F.least(F.lit(3), p - F.get(pos, k)))
    return F.aggregate(gaps, F.lit(3), lambda a, x: a + x)


def _repeated(hashes: Column) -> Column:
    """Words in windows whose hash occurs twice or more."""

    def flagged(s: Column) -> Column:
        twins = F.filter(s, lambda x, k: (F.get(s, k - 1)["h"] == x["h"]) | (F.get(s, k + 1)["h"] == x["h"]))
        return F.sort_array(F.transform(twins, lambda x: x["i"]))

    ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    return let(let(ordered, flagged), lambda pos: F.when(F.size(pos) > 0, _covered(pos)).otherwise(0))


def repeat_words(words: Column) -> Column:
    def of(w: Column) -> Column:
        hashes = F.transform(F.slice(w, 3, F.size(w)), lambda c, i: F.xxhash64(F.get(w, i), F.get(w, i + 1), c))
        return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(_repeated(h)))

    return let(words, of)


def measurements(text: Column) -> dict[str, Column]:
    lines = F.filter(F.split(text, "\n"), lambda x: F.translate(x, WHITE, "") != "")
    words = _words(text)
    both = let(words, lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeat_words(w).cast("long").alias("n_repeat_words")))
    return {
        "n_words": both["n_words"],
        "n_repeat_words": both["n_repeat_words"],
        "word_chars": F.length(F.translate(text, WHITE, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
        "n_lines": F.size(lines).cast("long"),
    }


#: rule name -> failing condition in SQL over the measurements; the position is the rule's bit.
RULES = {
    "few_words": "n_words < 50",
    "repeated_words": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "duplicate_lines": "10 * n_dup_lines > 3 * n_lines",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 16 * n_words",
}
BASE_RULES = ("few_words", "repeated_words")
#: Versioned policies: the rules whose failure rejects a document.
POLICIES = {
    "v1": ("few_words", "repeated_words"),
    "v2": ("few_words", "repeated_words", "symbols", "short_words", "long_words"),
    "v3": tuple(RULES),
}


def mask(rules: tuple[str, ...]) -> int:
    names = list(RULES)
    return sum(1 << names.index(r) for r in rules)


def ledger(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """keep columns, the measurements and `failed_bits` (bit k: rule k of RULES failed)."""
    source = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    # one struct: the words are split once for both word measures
    both = let(_words(F.col("_text")), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), repeat_words(w).cast("long").alias("n_repeat_words")))
    rest = {k: v for k, v in measurements(F.col("_text")).items() if k not in ("n_words", "n_repeat_words")}
    measured = source.select(*keep, both.alias("_w"), *[v.alias(k) for k, v in rest.items()])
    measured = measured.select(*keep, "_w.n_words", "_w.n_repeat_words", *rest)
    bits = [F.when(F.expr(cond), F.lit(1 << k)).otherwise(0) for k, cond in enumerate(RULES.values())]
    total = bits[0]
    for b in bits[1:]:
        total = total.bitwiseOR(b)
    return measured.withColumn("failed_bits", total.cast("long"))


def verdict(policy: str = "v3") -> Column:
    return F.col("failed_bits").bitwiseAND(F.lit(mask(POLICIES[policy]))) == 0


def ablations(ledger_df: DataFrame, policy: str = "v3") -> DataFrame:
    """Per rule of a policy: documents that fail it, and documents that only it rejects.

    The ledger is first counted by its masked bits (at most 2^rules groups)."""
    counts = ledger_df.groupBy(F.col("failed_bits").bitwiseAND(F.lit(mask(POLICIES[policy]))).alias("bits")).count()
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(mask((r,))).alias("bit")) for r in POLICIES[policy]]))
    rows = counts.select("bits", "count", rules.alias("r"))
    hit, alone = F.col("bits").bitwiseAND(F.col("r.bit")) != 0, F.col("bits") == F.col("r.bit")
    return rows.groupBy(F.col("r.rule").alias("rule")).agg(
        F.coalesce(F.sum(F.when(hit, F.col("count"))), F.lit(0)).alias("n_failed"),
        F.coalesce(F.sum(F.when(alone, F.col("count"))), F.lit(0)).alias("n_only_this"),
    )


def filter_documents(docs: DataFrame, policy: str = "v3", text: str = "text") -> DataFrame:
    """The documents that a policy keeps, with their own columns."""
    names = docs.columns
    inner = docs.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("_doc"), F.col(text).alias("_body"))
    return ledger(inner, ("_doc",), "_body").where(verdict(policy)).select(*[F.col(f"_doc.`{c}`").alias(c) for c in names])


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = ledger(read_table(spark, sf_dir, "documents", "doc_id", "text"))
    base = F.col("failed_bits").bitwiseAND(F.lit(mask(BASE_RULES))) != 0
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), (~base & verdict("v3")).alias("kept"), "failed_bits")


OP4_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS uid, doc_id, coalesce(text, '') AS t FROM documents),
a AS (SELECT uid, doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
tri AS (SELECT uid, i, w[i] AS a, w[i+1] AS b, w[i+2] AS c FROM (SELECT uid, w, unnest(range(1, len(w) - 1)) AS i FROM a WHERE len(w) >= 3)),
dup AS (SELECT uid, i FROM (SELECT uid, i, count(*) OVER (PARTITION BY uid, a, b, c) AS n FROM tri) WHERE n > 1),
rep AS (SELECT uid, count(DISTINCT i + j) AS n FROM dup, (SELECT unnest([0, 1, 2]) AS j) GROUP BY uid),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, len(l)::BIGINT AS n_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM a LEFT JOIN rep USING (uid)),
b AS (SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END
  + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END + CASE WHEN 10 * n_dup_lines > 3 * n_lines THEN 8 ELSE 0 END
  + CASE WHEN word_chars < 2 * n_words THEN 16 ELSE 0 END + CASE WHEN word_chars > 16 * n_words THEN 32 ELSE 0 END)::BIGINT AS failed_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed_bits & 3) != 0 AS base_failed, failed_bits = 0 AS kept, failed_bits FROM b
"""
QUERIES = {"op4_quality_rules": op4_quality_rules}
SQL = {"op4_quality_rules": OP4_SQL}
