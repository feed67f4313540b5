"""Token-share retrieval and repeated lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .search import table


def token_share(rows: DataFrame, pages: DataFrame, top: int = 3, least_share: float = 0.6, least_tokens: int = 2) -> DataFrame:
    """rows (row_id, tokens) against pages (page_id, tokens): an inverted index joined on tokens, never rows x pages.

    row_id, page_id, n (tokens in common), share and place, for the `top` best; tokens of a row are distinct."""
    asked = rows.select("row_id", F.size("tokens").alias("size"), F.explode("tokens").alias("token"))
    index = pages.select("page_id", F.explode("tokens").alias("token"))
    hits = asked.join(index, "token").groupBy("row_id", "size", "page_id").agg(F.count("*").alias("n"))
    hits = hits.where((F.col("n") >= least_tokens) & (F.col("n") >= least_share * F.col("size")))
    w = Window.partitionBy("row_id").orderBy(F.desc(F.col("n") / F.col("size")), "page_id")
    return hits.withColumn("place", F.row_number().over(w)).where(F.col("place") <= top).select("row_id", "page_id", "n", F.round(F.col("n") / F.col("size"), 4).alias("share"), "place")


def k13_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark passages looked for in all documents by their words of eight letters or more."""
    words = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("([a-z]{8,})"), 1))
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("row_id"), words(F.col("text")).alias("tokens"))
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), words(F.col("text")).alias("tokens"))
    return token_share(b, d)


def p12_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap of each turn with the turn before it, by thresholds."""
    c = table(spark, sf_dir, "conversations").dropDuplicates(["conv_id", "turn"])
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]{2,})"), 1))
    w = Window.partitionBy("conv_id").orderBy("turn")
    r = c.select("conv_id", "turn", words.alias("a")).withColumn("b", F.lag("a").over(w)).where("b IS NOT NULL")
    share = F.size(F.array_intersect("a", "b")) / F.greatest(F.lit(1), F.size("a"))
    return r.select("conv_id", "turn", F.when(share >= 0.6, "match").when(share >= 0.45, "likely").when(share >= 0.25, "review").otherwise("missing").alias("verdict"), F.size("a").alias("n"))


def f21_running_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that stand on more than half of a source's pages, of sources with at least five."""
    d = table(spark, sf_dir, "documents").where("source IS NOT NULL")
    pages = d.groupBy("source").agg(F.count("*").alias("pages")).where("pages >= 5")
    lines = d.select("source", "doc_id", F.explode(F.split("text", "\n")).alias("line")).where("trim(line) <> ''").distinct()
    n = lines.groupBy("source", "line").agg(F.count("*").alias("n"))
    return n.join(pages, "source").where("n >= 2").select("source", "line", "n", (2 * F.col("n") > F.col("pages")).alias("is_head"))


def near_keys(keys: DataFrame, key: str, share: float = 0.2, within: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of keys (with equal `within` columns) whose edit distance is at most a share of the longer one.

    A key cut into k + 1 pieces keeps one of them through k edits, so pairs meet on an equal piece (its
    place, text and the longer key's length) within the band of lengths; no key meets all others. The piece with i
    others before it and j behind it has moved by at most i places, and by at most j from where the difference of
    the lengths would have put it: else the edits before or behind it are more than those pieces' own, and one of
    them is left whole instead."""
    n = F.length(key)
    k = keys.select(*within, F.col(key).alias("k"), n.alias("n")).where("n > 0").distinct()
    # the edits that the longest partner of a key allows
    longest = F.floor(F.col("n") / (1 - share)).cast("int")
    lengths = k.select(*within, "k", "n", F.explode(F.sequence(F.col("n"), longest)).alias("m"))
    edits = F.floor(F.col("m") * share).cast("int")
    pieces = lengths.withColumn("e", edits)
    cut = lambda i: (F.floor(F.col("n") * i / (F.col("e") + 1))).cast("int")
    # the shorter key of a pair is cut; the longer one offers every substring that a piece could have moved to
    short = pieces.select(*within, "k", "n", "m", "e", F.explode(F.sequence(F.lit(0), F.col("e"))).alias("i")).select(*within, "k", "n", "m", "e", "i", cut(F.col("i")).alias("at"), (cut(F.col("i") + 1) - cut(F.col("i"))).alias("len")).where("len > 0")
    short = short.select(*within, "k", "n", "m", F.expr("substr(k, at + 1, len)").alias("piece"), "at", "i")
    sizes = short.groupBy(*within, "m", "n").agg(F.collect_set(F.struct("at", F.length("piece").alias("len"), "i")).alias("cuts"))
    long = k.select(*within, F.col("k").alias("k2"), F.col("n").alias("m")).join(sizes, [*within, "m"]).select(*within, "k2", "m", "n", F.explode("cuts").alias("c"))
    long = long.withColumn("e", F.floor(F.col("m") * share).cast("int"))
    at, i, j, moved = F.col("c.at"), F.col("c.i"), F.col("e") - F.col("c.i"), F.col("m") - F.col("n")
    first, last = F.greatest(F.lit(0), at - i, at + moved - j), F.least(F.col("m") - F.col("c.len"), at + i, at + moved + j)
    long = long.withColumn("first", first.cast("int")).withColumn("last", last.cast("int")).where("first <= last")
    long = long.select(*within, "k2", "m", "n", "c.at", "c.len", F.explode(F.sequence("first", "last")).alias("p"))
    long = long.select(*within, "k2", "m", "n", "at", F.expr("substr(k2, p + 1, len)").alias("piece")).distinct()
    pairs = short.join(long, [*within, "m", "n", "at", "piece"]).where("k <> k2").select(*within, F.least("k", "k2").alias("a"), F.greatest("k", "k2").alias("b")).distinct()
    most = F.floor(F.greatest(F.length("a"), F.length("b")) * share).cast("int")
    return pairs.withColumn("distance", F.levenshtein("a", "b")).where(F.col("distance") <= most)


def k9_near_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_keys(table(spark, sf_dir, "part").select(F.concat_ws(" ", "p_name", "p_brand").alias("key")), "key")


def t18_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line of a document with most of the wanted words, the first of equals, cut to 160 characters."""
    want = F.array(*[F.lit(w) for w in ("the", "and", "that", "der", "les", "que")])
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    n = F.size(F.array_intersect(F.split(F.lower("line"), "[^a-z]+"), want))
    best = lines.withColumn("n", n).groupBy("doc_id").agg(F.max_by(F.struct("line", "n"), F.struct("n", -F.col("pos"))).alias("b"))
    return best.select("doc_id", F.when(F.length("b.line") > 160, F.concat(F.substring("b.line", 1, 159), F.lit("…"))).otherwise(F.col("b.line")).alias("snippet"), F.col("b.n").alias("n"))


def j10_name_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part's five best other parts whose name holds at least 60 % of its words.

    Parts of equal words have equal shares, so the inverted index is over the distinct word sets; of each set only
    the parts with the smallest keys can be among the best, one more than wanted for the part itself."""
    top = 5
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: F.length(w) >= 3))
    p = table(spark, sf_dir, "part").select("p_partkey", F.array_sort(words(F.concat_ws(" ", "p_name", "p_type"))).alias("tokens"))
    least = Window.partitionBy("tokens").orderBy("p_partkey")
    first = p.withColumn("k", F.row_number().over(least)).where(F.col("k") <= top + 1)
    sets = first.where("k = 1").select(F.col("p_partkey").alias("set_id"), "tokens")
    size = sets.select(F.col("set_id").alias("row_id"), F.size("tokens").alias("size"), F.explode("tokens").alias("token"))
    index = sets.select(F.col("set_id").alias("other"), F.explode("tokens").alias("token"))
    hits = size.join(index, "token").groupBy("row_id", "size", "other").agg(F.count("*").alias("n")).where(F.col("n") >= 0.6 * F.col("size"))
    members = first.join(sets, "tokens").select(F.col("set_id").alias("other"), F.col("p_partkey").alias("page_id"))
    share = F.col("n") / F.col("size")
    best = hits.join(members, "other").withColumn("k", F.row_number().over(Window.partitionBy("row_id").orderBy(F.desc(share), "page_id"))).where(F.col("k") <= top + 1)
    asked = p.join(sets, "tokens").select(F.col("set_id").alias("row_id"), "p_partkey")
    pages = best.groupBy("row_id").agg(F.sort_array(F.collect_list(F.struct("k", "page_id", "n", F.round(share, 4).alias("share")))).alias("best"))
    others = F.slice(F.filter("best", lambda x: x["page_id"] != F.col("p_partkey")), 1, top)
    found = asked.join(pages, "row_id").select(F.col("p_partkey").alias("row_id"), F.posexplode(others).alias("pos", "b"))
    return found.select("row_id", "b.page_id", "b.n", "b.share", (F.col("pos") + 1).alias("place"))


QUERIES = {f.__name__: f for f in (k13_suggestions, p12_evidence, f21_running_heads, k9_near_names, t18_snippets, j10_name_share)}
SHARE = "h AS (SELECT r.row_id, r.size, p.page_id, count(*) AS n FROM (SELECT row_id, len(tokens) AS size, unnest(tokens) AS token FROM q) r JOIN (SELECT page_id, unnest(tokens) AS token FROM d) p USING (token) GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY n / size DESC, page_id)::INTEGER AS place FROM h WHERE n >= {least} AND n >= 0.6 * size) SELECT row_id, page_id, n, round(n / size, 4) AS share, place FROM k WHERE place <= {top}"
SQL = {
    "k13_suggestions": "WITH q AS (SELECT item_id AS row_id, list_distinct(regexp_extract_all(lower(text), '[a-z]{8,}')) AS tokens FROM benchmark), d AS (SELECT doc_id AS page_id, list_distinct(regexp_extract_all(lower(text), '[a-z]{8,}')) AS tokens FROM documents), " + SHARE.format(least=2, top=3),
    "p12_evidence": "WITH c AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(any_value(text)), '[a-z]{2,}')) AS a FROM conversations GROUP BY 1, 2), r AS (SELECT *, lag(a) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM c), s AS (SELECT *, len(list_intersect(a, b)) / greatest(1, len(a)) AS s FROM r WHERE b IS NOT NULL) SELECT conv_id, turn, CASE WHEN s >= 0.6 THEN 'match' WHEN s >= 0.45 THEN 'likely' WHEN s >= 0.25 THEN 'review' ELSE 'missing' END AS verdict, len(a)::INTEGER AS n FROM s",
    "f21_running_heads": "WITH l AS (SELECT DISTINCT source, doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE source IS NOT NULL), p AS (SELECT source, count(*) AS pages FROM documents GROUP BY 1 HAVING count(*) >= 5), n AS (SELECT source, line, count(*) AS n FROM l WHERE trim(line) <> '' GROUP BY 1, 2) SELECT source, line, n, 2 * n > pages AS is_head FROM n JOIN p USING (source) WHERE n >= 2",
    "k9_near_names": "WITH k AS (SELECT DISTINCT p_name || ' ' || p_brand AS k FROM part) SELECT x.k AS a, y.k AS b, levenshtein(x.k, y.k)::INTEGER AS distance FROM k x JOIN k y ON x.k < y.k AND levenshtein(x.k, y.k) <= floor(greatest(length(x.k), length(y.k)) * 0.2)",
    "t18_snippets": "WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents), n AS (SELECT *, len(list_intersect(list_distinct(regexp_split_to_array(lower(line), '[^a-z]+')), ['the', 'and', 'that', 'der', 'les', 'que'])) AS n FROM l), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, pos) AS k FROM n) SELECT doc_id, CASE WHEN length(line) > 160 THEN line[1:159] || '…' ELSE line END AS snippet, n::INTEGER AS n FROM r WHERE k = 1",
    "j10_name_share": r"""WITH q AS (SELECT p_partkey AS k, list_distinct(list_filter(regexp_split_to_array(lower(p_name || ' ' || p_type), '[^a-z0-9]+'), lambda w: length(w) >= 3)) AS tokens FROM part),
  g AS (SELECT list_sort(tokens) AS t, list(k) AS ks FROM q GROUP BY 1), h AS (SELECT a.t AS a, len(list_intersect(a.t, b.t)) AS n, len(a.t) AS size, b.ks FROM g a, g b WHERE len(list_intersect(a.t, b.t)) >= greatest(1, 0.6 * len(a.t))),
  m AS (SELECT a, n, size, unnest(list_sort(ks)[1:6]) AS page_id FROM h), r AS (SELECT q.k AS row_id, page_id, n, n / size AS s FROM q JOIN m ON list_sort(q.tokens) = m.a WHERE page_id <> q.k),
  x AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY s DESC, page_id)::INTEGER AS place FROM r) SELECT row_id, page_id, n, round(s, 4) AS share, place FROM x WHERE place <= 5""",
}
