"""Items of pages, sibling numbers, split items, batches and queues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.outline import outline
from ..operators.places import by_key
from ..operators.scan import ordered_scan
from .search import table
from .sequences import c3_leases

#: Rows above which an item is split, files and bytes of an upload, states of a request.
SPLIT_ABOVE = 60
BATCH_FILES, BATCH_BYTES = 50, 200 * 1024 * 1024
STATES = ("requested", "running", "done", "failed")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as pages: a conversation's turns are numbered lines, list lines, annexes or running text; some are pictures."""
    c = table(spark, sf_dir, "conversations").where("conv_id IS NOT NULL AND turn IS NOT NULL")
    t = c.groupBy("conv_id", "turn").agg(F.min_by("text", F.struct("role", "text")).alias("text"), F.min("role").alias("role"))
    n, h = F.col("turn"), F.pmod(F.xxhash64("conv_id", "turn"), F.lit(13))
    text = F.coalesce("text", F.lit(""))
    body = (
        F.when(h == 0, F.concat(F.lit("ผนวก "), n, F.lit("\n1. "), text)).when(h == 1, F.concat(n, F.lit("."), h, F.lit(" "), text)).when(h == 2, F.concat(F.lit("- "), text)).when(h == 3, F.concat(F.lit("1) "), text))
        .when(h == 4, F.lit("")).when((h == 5) & (n > 4), F.concat(F.lit("เอกสาร ผนวก ข\n"), text)).when(F.col("role") == "user", F.concat(n + 1, F.lit(". "), text)).otherwise(F.concat(n, F.lit(".1 "), text, F.lit("\n- "), F.col("role")))
    )
    first = F.when(n == 0, F.concat(F.lit("เอกสาร ผนวก ก\n**"), F.col("conv_id"), F.lit("**\n"), body)).otherwise(body)
    return t.select(F.col("conv_id").alias("doc_id"), (n + 1).cast("int").alias("page"), first.alias("text"), (h == 6).alias("picture"))


def k7_outline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of every document's outline (K7)."""
    return outline(_pages(spark, sf_dir))[0]


def k7_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a reader of every document's outline has to look at (K7)."""
    return outline(_pages(spark, sf_dir))[1]


def batches(files: DataFrame, key: str, order: list[str], size: str, most_files: int = BATCH_FILES, most_bytes: int = BATCH_BYTES) -> DataFrame:
    """files with the batch (from 1) each goes with, in order: a batch ends before it would hold too many files or bytes.

    A file larger than a batch goes alone; a null size counts as 0. A key's files may fill many tasks."""

    def step(state, n):
        batch, held, used = state
        if not batch or held >= most_files or used + n > most_bytes:
            batch, held, used = batch + 1, 0, 0
        return [batch, held + 1, used + n], (batch,)

    sized = files.withColumn("_size", F.coalesce(F.col(size).cast("long"), F.lit(0)))
    return ordered_scan(sized, key, order, ["_size"], [0, 0, 0], step, "batch long").drop("_size")


def w8_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts of a source as uploads of at most 8 files and 24,000 bytes."""
    d = table(spark, sf_dir, "documents").select("source", "doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("size"))
    put = batches(d, "source", ["doc_id", "size"], "size", 8, 24_000)
    return put.groupBy("source", "batch").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"), F.sum("size").alias("bytes"))


def siblings(rows: DataFrame) -> DataFrame:
    """rows (doc_id, position, item, annex: the row heads an annex) to the gaps and repeats among the numbers below one parent.

    Numbers compare within one annex: a heading opens a new scope, numbered by a running count. Items that don't end in
    a number don't count. A parent's missing numbers are told as gaps (after, before), so a misread number doesn't
    blow them up; repeats are a row a number. Nothing is a gap but what lies between two numbers."""
    scope = F.sum(F.coalesce(F.col("annex").cast("int"), F.lit(0))).over(Window.partitionBy("doc_id").orderBy("position"))
    own = rows.select("doc_id", scope.alias("scope"), F.regexp_replace("item", r"\.$", "").alias("item")).where(F.col("item").rlike(r"(^|\.)[0-9]+$"))
    n = F.expr("try_cast(regexp_extract(item, '([0-9]+)$', 1) AS long)")
    seen = own.select("doc_id", "scope", F.regexp_replace("item", r"\.?[0-9]+$", "").alias("parent"), n.alias("n")).where("n IS NOT NULL")
    # equal numbers stand side by side: the first of them tells the repeat, the last one the gap
    w = Window.partitionBy("doc_id", "scope", "parent").orderBy("n")
    told = seen.select("*", F.lag("n").over(w).alias("last"), F.lead("n").over(w).alias("next"))
    kind = F.when(F.col("next") > F.col("n") + 1, "missing").when((F.col("next") == F.col("n")) & ~F.col("last").eqNullSafe(F.col("n")), "repeated")
    gap = F.col("kind") == "missing"
    return told.withColumn("kind", kind).where("kind IS NOT NULL").select("doc_id", "scope", "parent", "kind", F.when(gap, F.col("n") + 1).otherwise(F.col("n")).alias("lo"), F.when(gap, F.col("next") - 1).otherwise(F.col("n")).alias("hi"))


def a18_siblings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gaps and repeats of numbers like line.part of every order, with annexes."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    li = by_key(lines, lines.count(), "l_orderkey").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_partkey").alias("p"))
    k = F.col("p")
    item = F.when(k % 9 == 0, None).when(k % 4 == 0, F.col("l_linenumber").cast("string")).otherwise(F.concat((F.col("l_linenumber") / 4).cast("int"), F.lit("."), k % 12, F.when(k % 2 == 0, ".").otherwise("")))
    return siblings(li.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("position"), item.alias("item"), (k % 9 == 0).alias("annex")))


def split_counts(rows: DataFrame, above: int = SPLIT_ABOVE) -> DataFrame:
    """rows (doc_id, position, major, sub: null above the first of its major, image) to the items a check runs over.

    A major of more than `above` rows and at least two subs is split into these (its rows without a sub join the
    first); any other is one item. Returns doc_id, major, sub (null: not split), n, n_images. Aggregations only."""
    n, images = F.count("*"), F.count_if(F.coalesce(F.col("image"), F.lit(False)))
    subs = rows.where("major IS NOT NULL").groupBy("doc_id", "major", "sub").agg(n.alias("n"), images.alias("n_images"), F.min("position").alias("first"))
    # a row a sub from here on: bounded by the subs of a major
    whole = subs.groupBy("doc_id", "major").agg(
        F.sum("n").alias("n"), F.sum("n_images").alias("n_images"), F.count("sub").alias("n_subs"),
        F.sum(F.when(F.col("sub").isNull(), F.col("n"))).alias("n_above"), F.sum(F.when(F.col("sub").isNull(), F.col("n_images"))).alias("images_above"),
        F.sort_array(F.collect_list(F.when(F.col("sub").isNotNull(), F.struct("first", "sub", "n", "n_images")))).alias("subs"),
    )
    split = (F.col("n") > above) & (F.col("n_subs") >= 2)
    alone = F.array(F.struct(F.lit(None).cast("string").alias("sub"), F.col("n").alias("n"), F.col("n_images").alias("n_images")))

    def placed(s, i):
        own = lambda c, before: s[c] + F.when(i == 0, F.coalesce(before, F.lit(0))).otherwise(0)
        return F.struct(s["sub"].alias("sub"), own("n", F.col("n_above")).alias("n"), own("n_images", F.col("images_above")).alias("n_images"))

    return whole.select("doc_id", "major", F.inline(F.when(split, F.transform("subs", placed)).otherwise(alone)))


def a21_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A supplier's lines as items by line number; those of over 60 rows are split by part group."""
    k = F.col("l_partkey")
    li = table(spark, sf_dir, "lineitem")
    sub = F.when(k % 5 != 0, F.concat(F.col("l_linenumber"), F.lit("."), k % F.col("l_linenumber")))
    # a sub's first place: its smallest part, then its name
    return split_counts(li.select(F.col("l_suppkey").alias("doc_id"), F.struct("l_partkey", sub).alias("position"), F.col("l_linenumber").alias("major"), sub.alias("sub"), (F.col("l_quantity") > 45).alias("image")))


def a17_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of each state, states without any included."""
    n = c3_leases(spark, sf_dir).agg(*[F.count_if(F.col("state") == s).alias(s) for s in STATES])
    return n.select(F.inline(F.array(*[F.struct(F.lit(s).alias("state"), F.col(s).alias("n")) for s in STATES])))


QUERIES = {f.__name__: f for f in (k7_outline, k7_warnings, w8_batches, a18_siblings, a21_split, a17_queue)}
SQL = {
    "w8_batches": "WITH RECURSIVE o AS (SELECT source, doc_id, octet_length(encode(coalesce(text, '')))::BIGINT AS h, row_number() OVER (PARTITION BY source ORDER BY doc_id, octet_length(encode(coalesce(text, '')))) AS k FROM documents), f AS (SELECT source, doc_id, k, h, h AS used, 1 AS held, 1::BIGINT AS batch FROM o WHERE k = 1 UNION ALL SELECT o.source, o.doc_id, o.k, o.h, CASE WHEN f.held >= 8 OR f.used + o.h > 24000 THEN o.h ELSE f.used + o.h END, CASE WHEN f.held >= 8 OR f.used + o.h > 24000 THEN 1 ELSE f.held + 1 END, f.batch + CASE WHEN f.held >= 8 OR f.used + o.h > 24000 THEN 1 ELSE 0 END FROM f JOIN o ON o.source IS NOT DISTINCT FROM f.source AND o.k = f.k + 1) SELECT source, batch, min(doc_id) AS first, count(*) AS n, sum(h)::BIGINT AS bytes FROM f GROUP BY 1, 2",
    "a18_siblings": r"""WITH l AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS p FROM lineitem GROUP BY 1, 2), i AS (SELECT l_orderkey AS doc_id, (sum(CASE WHEN p % 9 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber))::BIGINT AS scope, CASE WHEN p % 4 = 0 THEN '' ELSE (l_linenumber // 4)::VARCHAR END AS parent, (CASE WHEN p % 4 = 0 THEN l_linenumber ELSE p % 12 END)::BIGINT AS n, p FROM l),
  s AS (SELECT doc_id, scope, parent, n, count(*) AS times FROM i WHERE p % 9 <> 0 GROUP BY 1, 2, 3, 4), c AS (SELECT a.doc_id, a.scope, a.parent, a.n, (SELECT min(b.n) FROM s b WHERE b.doc_id = a.doc_id AND b.scope = a.scope AND b.parent = a.parent AND b.n > a.n) AS nxt, a.times FROM s a)
  SELECT doc_id, scope, parent, 'missing' AS kind, n + 1 AS lo, nxt - 1 AS hi FROM c WHERE nxt > n + 1 UNION ALL SELECT doc_id, scope, parent, 'repeated', n, n FROM c WHERE times > 1""",
    "a21_split": """WITH r AS (SELECT l_suppkey AS doc_id, l_linenumber AS major, CASE WHEN l_partkey % 5 <> 0 THEN l_linenumber || '.' || (l_partkey % l_linenumber) END AS sub, l_partkey AS p, l_quantity > 45 AS image FROM lineitem),
  w AS (SELECT doc_id, major, count(*) > 60 AND count(DISTINCT sub) >= 2 AS split FROM r GROUP BY 1, 2), h AS (SELECT doc_id, major, arg_min(sub, (p, sub)) AS head FROM r WHERE sub IS NOT NULL GROUP BY 1, 2)
  SELECT r.doc_id, r.major, CASE WHEN split THEN coalesce(sub, head) END AS sub, count(*) AS n, count(*) FILTER (image) AS n_images FROM r JOIN w ON r.doc_id = w.doc_id AND r.major = w.major LEFT JOIN h ON r.doc_id = h.doc_id AND r.major = h.major GROUP BY 1, 2, 3""",
    "a17_queue": "WITH s AS (SELECT CASE WHEN event_id % 2 <> 0 OR event_type = 'error' OR ts IS NULL OR event_type IS NULL OR ts < TIMESTAMP '2024-01-03 12:00:00' - INTERVAL 2 MINUTES THEN 'requested' ELSE 'running' END AS state FROM events) SELECT x.state, count(s.state) AS n FROM (VALUES ('requested'), ('running'), ('done'), ('failed')) x(state) LEFT JOIN s ON s.state = x.state GROUP BY 1",
}
