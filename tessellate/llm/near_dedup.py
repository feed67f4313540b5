"""Near-duplicate documents by ProbMinHash, banding and exact verification.

Shingles are WORDS consecutive lower-case words; a text's distinct ones count once each, however often they
repeat, as in the verification. Each shingle is a Poisson process whose arrivals visit the registers without
repetition, at a rate in proportion to its weight (1 here); a register keeps its earliest arrival's shingle,
and a shingle stops once its next arrival is later than all registers (early termination). Equal registers
estimate the probability Jaccard similarity, which for equal weights is that of the sets. ROWS registers make
a band; documents with an equal band share a bucket. All documents of a batch run side by side in numpy.

Texts with the same word sequence are one node from the start. In a first round each bucket tile pairs its
members with its hub, the member that agrees best with the tile's most common registers. Pairs
whose estimate may reach the threshold are verified on the whole shingle sets, and the links contracted to
classes. A second round joins each member outside its bucket's main class with its few best partners. In the
last round these members meet all members of other classes in the bucket's tiles, and pairs that may reach
the threshold are verified inside the task, so that only links leave it. So groups of many copies cost about a
star of links, and no pair of a bucket that may reach the threshold and is not joined already goes untested.
Buckets with the same members count once.

The registers and bands of all texts are written, 330 bytes a document; shingle sets are made in a second
pass over the texts that share a bucket, and every table is deleted after its last reader.

Defined results: null text, and text without a word, is a class of its own; shorter texts than a
shingle are one shingle; a class's id is its smallest doc_id (null if none has one); repeated rows are copies;
an empty table gives an empty result; other input columns are ignored (dedup() keeps them, whatever their
names). Word sequences are told apart by a 64-bit hash; a row is known by its doc_id and a hash of its text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, read_table

WORDS, THRESHOLD, REGISTERS, ROWS, BANDS = 5, 0.8, 128, 5, 25
#: estimates have a deviation below 0.04 at the threshold: they are of the similarity that verification measures
MAYBE, TILE = 0.64, 2048
#: best partners that a member outside its bucket's main class asks in the second round
BEST = 4
ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Hashes(dict):
    def __missing__(self, word: str) -> bytes:
        import xxhash

        value = self[word] = xxhash.xxh64_digest(word.encode("utf-8", "replace"))
        return value


_hashes = _Hashes()


def shingles(texts: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
    """A key of each text's word sequence, and its shingles' hashes in order (none without words)."""
    if len(_hashes) > 500_000:
        _hashes.clear()
    get, keys, out = _hashes.__getitem__, np.zeros(len(texts), np.uint64), []
    for i, t in enumerate(texts):
        w = np.frombuffer(b"".join(map(get, t.lower().split())), ">u8").astype(np.uint64)
        n = len(w)
        if n:
            keys[i] = mix(np.array([(mix(w + np.arange(n, dtype=np.uint64) * ODD[0])).sum(dtype=np.uint64) ^ np.uint64(n)]))[0]
        if n >= WORDS:
            h = w[: n - WORDS + 1] * ODD[0]
            for k in range(1, WORDS):
                h = (h ^ (h >> np.uint64(29))) * ODD[0] + w[k : n - WORDS + 1 + k] * ODD[k % len(ODD)]
            out.append(mix(h))
        else:
            out.append(keys[i : i + 1].copy() if n else np.zeros(0, np.uint64))
    return keys, out


def signatures(bags: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """ProbMinHash registers (the low 32 bits of the winning shingles) of bags (distinct hashes, weights)."""
    m, docs = REGISTERS, len(bags)
    elem = np.concatenate([b[0] for b in bags]) if bags else np.zeros(0, np.uint64)
    weight = np.concatenate([b[1] for b in bags]) if bags else np.zeros(0)
    doc = np.repeat(np.arange(docs), [len(b[0]) for b in bags])
    empty = np.uint64(0x7F800000) << np.uint64(32)  # later than any arrival
    reg = np.full(docs * m, empty, np.uint64)
    seed = mix(elem + ODD[1])
    place, stride = (seed >> np.uint64(8)) % np.uint64(m), (seed >> np.uint64(40)) | np.uint64(1)
    low, when = elem & np.uint64(0xFFFFFFFF), np.zeros(len(elem))
    for i in range(m):
        if not len(elem):
            break
        u = (mix(elem ^ np.uint64(int(ODD[2]) * (i + 1) & (1 << 64) - 1)) >> np.uint64(11)).astype(np.float64) * 2.0**-53
        when = when - np.log1p(-u) * (m / (m - i)) / weight
        at = doc * m + ((place + stride * np.uint64(i)) % np.uint64(m)).astype(np.int64)
        np.minimum.at(reg, at, (when.astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32)) | low)
        latest = (reg.reshape(docs, m).max(1) >> np.uint64(32)).astype(np.uint32).view(np.float32)
        on = when < latest[doc]
        elem, weight, doc, place, stride, low, when = (x[on] for x in (elem, weight, doc, place, stride, low, when))
    return (reg & np.uint64(0xFFFFFFFF)).reshape(docs, m)


def band_keys(sig: np.ndarray) -> np.ndarray:
    rows = sig[:, : ROWS * BANDS].reshape(len(sig), BANDS, ROWS)
    h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * ODD[3], rows.shape[:2]).copy()
    for k in range(ROWS):
        h = mix(h ^ rows[:, :, k]) * ODD[0]
    return h


def identified(docs: DataFrame, *columns: Column) -> DataFrame:
    """id and mark (a hash of the text) that tell docs' rows apart, and the given columns."""
    return docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("mark"), *columns)


def fingerprints(docs: DataFrame) -> DataFrame:
    """id, mark, key (null without words), registers and bands of each text of docs (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                keys, lists = shingles([t or "" for t in part.column(2).to_pylist()])
                sig = signatures([(values, np.ones(len(values))) for values in map(np.unique, lists)])
                some = np.array([len(h) > 0 for h in lists])
                yield pa.RecordBatch.from_arrays(
                    [
                        *part.columns[:2],
                        pa.array(keys.view(np.int64), mask=~some),
                        pa.array([s.tobytes() for s in (sig & np.uint64(255)).astype(np.uint8)]),
                        pa.array(list(band_keys(sig).view(np.int64)), pa.list_(pa.int64())),
                    ],
                    ["id", "mark", "key", "sig", "bands"],
                )

    return identified(docs, F.col("text")).mapInArrow(run, "id long, mark long, key long, sig binary, bands array<long>")


def shingle_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """key and shingle set (sorted, 32 bits a shingle) of the texts of docs whose id and mark are in wanted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 256):
                keys, lists = shingles([t or "" for t in b.column(0).slice(k, 256).to_pylist()])
                sets = [np.unique((v >> np.uint64(32)).astype("<u4")).tobytes() for v in lists]
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(sets, pa.binary())], ["key", "shingles"])

    rows, asked = identified(docs, F.col("text")), wanted.withColumnsRenamed({"id": "asked_id", "mark": "asked"})
    found = rows.join(asked.hint("shuffle_hash"), F.col("id").eqNullSafe(F.col("asked_id")) & (F.col("mark") == F.col("asked")), "left_semi")
    sets = found.select("text").mapInArrow(run, "key long, shingles binary")
    return sets.groupBy("key").agg(F.first("shingles").alias("shingles"))


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[dict]]:
    """Rows of sorted batches by their first `keys` columns."""
    group: list[dict] = []
    names: list[str] = []
    for b in batches:
        names = b.schema.names[:keys]
        for row in b.to_pylist():
            if group and any(row[n] != group[0][n] for n in names):
                yield group
                group = []
            group.append(row)
    if group:
        yield group


def _tile(rows: list[dict]) -> np.ndarray:
    return np.frombuffer(b"".join(r["sig"] for r in rows), np.uint8).reshape(len(rows), REGISTERS)


def hub_pairs(members: DataFrame) -> DataFrame:
    """Each tile's members (bucket, tile, key, sig) paired with its hub where the estimate may reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches, 2):
            if len(rows) < 2:
                continue
            sig, keys = _tile(rows), np.array([r["key"] for r in rows])
            usual = np.array([np.bincount(c).argmax() for c in sig.T], np.uint8) if len(rows) > 2 else sig[0]
            hub = int((sig == usual).sum(1).argmax())
            close = (sig == sig[hub]).mean(1) >= MAYBE
            close &= keys != keys[hub]
            if close.any():
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(keys[close], keys[hub])), pa.array(np.maximum(keys[close], keys[hub]))], ["a", "b"])

    ordered = members.select("bucket", "tile", "key", "sig").repartition("bucket", "tile").sortWithinPartitions("bucket", "tile", "key")
    return ordered.mapInArrow(run, "a long, b long").distinct()


def rest_rows(members: DataFrame, sigs: DataFrame, labels: DataFrame, tile: int) -> DataFrame:
    """Rows (bucket, tile, chunk, key, sig, label, rest, home): each member at home in its tile, and the members
    outside their bucket's main class (`rest`) as guests of every tile, in chunks of bounded size."""
    known = members.join(labels, "key", "left").withColumn("label", F.coalesce("label", "key"))
    sizes = known.groupBy("bucket", "label").count()
    main = sizes.groupBy("bucket").agg(F.max_by("label", F.struct("count", "label")).alias("main"), F.sum("count").alias("n"), F.max("count").alias("most")).where("n > most")
    rows = known.join(main, "bucket").join(sigs, "key").withColumn("rest", F.col("label") != F.col("main"))
    rows = rows.withColumn("chunks", F.ceil((F.col("n") - F.col("most")) / tile).cast("int"))
    own = rows.select("bucket", "tile", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), "key", "sig", "label", "rest", F.lit(True).alias("home"))
    met = rows.where("rest").select("bucket", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("tile"), F.pmod(F.xxhash64("key", F.lit(5)), F.col("chunks")).cast("int").alias("chunk"), "key", "sig", "label", "rest", F.lit(False).alias("home"))
    return own.unionByName(met)


def _grouped(rows: DataFrame) -> DataFrame:
    return rows.repartition("bucket", "tile", "chunk").sortWithinPartitions("bucket", "tile", "chunk", "key")


def _meetings(rows: list[dict], both_ways: bool) -> Iterator[tuple[dict, list[dict], np.ndarray, np.ndarray]]:
    """Each guest of a group with those at home that are of another class and may reach the threshold."""
    here, asks = [r for r in rows if r["home"]], [r for r in rows if not r["home"]]
    if not here or not asks:
        return
    sig, keys = _tile(here), np.array([r["key"] for r in here])
    label, rest = np.array([r["label"] for r in here]), np.array([r["rest"] for r in here])
    for q, one in zip(_tile(asks), asks):
        ok = label != one["label"]
        if not both_ways:  # two members of the rest meet twice; the smaller key asks
            ok &= ~rest | (keys > one["key"])
        at = np.flatnonzero(ok)
        alike = (sig[at] == q).mean(1)
        at, alike = at[alike >= MAYBE], alike[alike >= MAYBE]
        if len(at):
            yield one, here, at, alike


def best_pairs(rows: DataFrame, best: int) -> DataFrame:
    """For each guest its few best partners of another class in a tile, as pairs (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, 3):
            for one, here, at, alike in _meetings(group, True):
                keys = np.array([here[i]["key"] for i in at[np.argsort(-alike, kind="stable")[:best]]])
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(keys, one["key"])), pa.array(np.maximum(keys, one["key"]))], ["a", "b"])

    return _grouped(rows).mapInArrow(run, "a long, b long").distinct()


def rest_links(rows: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """All links between different classes of a bucket, verified where the members meet; only links leave a task.

    A first pass keeps the members that have a pair to verify, and only they are given their shingle sets."""

    def takes_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names: list[str] = []
        for group in _groups(batches, 3):
            names, part = list(group[0]), {}
            for one, here, at, _ in _meetings(group, False):
                part[id(one)] = one
                part.update((id(here[i]), here[i]) for i in at)
            if part:
                cols = [pa.array([r[n] for r in part.values()], t) for n, t in zip(names, (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.bool_(), pa.bool_()))]
                yield pa.RecordBatch.from_arrays(cols, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, 3):
            for one, here, at, _ in _meetings(group, False):
                x = np.frombuffer(one["shingles"], "<u4")
                keys = np.array([here[i]["key"] for i in at if similar(x, np.frombuffer(here[i]["shingles"], "<u4"))], np.int64)
                if len(keys):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(keys, one["key"])), pa.array(np.maximum(keys, one["key"]))], ["a", "b"])

    schema = "bucket long, tile int, chunk int, key long, sig binary, label long, rest boolean, home boolean"
    part = scratch.write(_grouped(rows).mapInArrow(takes_part, schema), "meetings")
    given = part.join(sets, "key").select("bucket", "tile", "chunk", "key", "sig", "label", "rest", "home", "shingles")
    return scratch.write(_grouped(given).mapInArrow(run, "a long, b long").distinct(), "links")


def similar(x: np.ndarray, y: np.ndarray) -> bool:
    """Jaccard similarity of two sorted sets of at least THRESHOLD."""
    small, large = min(len(x), len(y)), max(len(x), len(y))
    if small < THRESHOLD * large:
        return False
    both = len(np.intersect1d(x, y, assume_unique=True))
    return both >= THRESHOLD * (small + large - both) - 1e-9


def verify(pairs: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) whose shingle sets have a Jaccard similarity of at least THRESHOLD; sets (key, shingles)."""
    both = pairs.join(sets.withColumnsRenamed({"key": "a", "shingles": "sa"}), "a").join(sets.withColumnsRenamed({"key": "b", "shingles": "sb"}), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = [similar(np.frombuffer(x.as_py(), "<u4"), np.frombuffer(y.as_py(), "<u4")) for x, y in zip(b.column(2), b.column(3))]
            yield pa.RecordBatch.from_arrays(b.columns[:2], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return scratch.write(both.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long"), "links")


#: shares into which the rows of one label, or the pairs of one hub, are dealt in a join
SALT = 16


def renamed(rows: DataFrame, column: str, names: DataFrame) -> DataFrame:
    """rows with `column` replaced by its name in names (key, name), where it has one; rows of one value are dealt to SALT shares."""
    share = F.pmod(F.xxhash64(*[c for c in rows.columns if c != column]), F.lit(SALT)).cast("int")
    spread = names.select(F.col("key").alias(column), "name", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("share"))
    joined = rows.withColumn("share", share).join(spread, [column, "share"], "left")
    return joined.select(*[F.coalesce("name", column).alias(column) if c == column else F.col(c) for c in rows.columns])


def contract(links: DataFrame, scratch: Scratch, labels: DataFrame | None = None) -> DataFrame:
    """Connected components: (key, label), label the smallest node, for all nodes of links and earlier labels.

    Every pass moves each node to its smallest neighbour's own smallest neighbour and drops inner links."""
    edges = links.select("a", "b")
    nodes = edges.select(F.explode(F.array("a", "b")).alias("key")).distinct()
    if labels is None:
        labels = scratch.write(nodes.withColumn("label", F.col("key")), "labels")
    else:
        labels = scratch.write(nodes.join(labels, "key", "left_anti").select("key", F.col("key").alias("label")).unionByName(labels), "labels")
        names = labels.withColumnRenamed("label", "name")
        edges = scratch.write(renamed(renamed(edges, "a", names), "b", names).where("a != b").distinct(), "edges")
    while edges.head(1):
        near = edges.select(F.explode(F.array(F.struct(F.col("a").alias("key"), F.col("b").alias("to")), F.struct(F.col("b").alias("key"), F.col("a").alias("to")))).alias("e")).select("e.*")
        step = scratch.write(near.groupBy("key").agg(F.least(F.min("to"), F.first("key")).alias("to")), "step")
        jump = scratch.write(renamed(step, "to", step.withColumnRenamed("to", "name")), "jump").withColumnRenamed("to", "name")
        labels = scratch.write(renamed(labels, "label", jump), "labels")
        edges = scratch.write(renamed(renamed(edges, "a", jump), "b", jump).where("a != b").distinct(), "edges")
    scratch.drop("edges", "step", "jump", "links")
    return labels


def classes(prints: DataFrame, docs: DataFrame, scratch: Scratch, tile: int = TILE) -> DataFrame:
    """(key, class_key, class_id, class_size) for every key of fingerprints(docs); class_id is the smallest doc_id."""
    # the copies of a text have equal registers and bands
    distinct = prints.where("key IS NOT NULL").groupBy("key").agg(F.min("id").alias("rep"), F.count("*").alias("copies"), *[F.first(c).alias(c) for c in ("sig", "bands")], F.first(F.struct("id", "mark")).alias("one"))
    nodes = scratch.write(distinct, "nodes")
    sigs = nodes.select("key", "sig")
    bands = nodes.select("key", F.explode("bands").alias("bucket"))
    # of buckets with the same members (as many, and both hashes of theirs agree) one is enough
    held = bands.groupBy("bucket").agg(F.count("*").alias("size"), *[F.bit_xor(F.xxhash64("key", F.lit(k))).alias(f"h{k}") for k in (1, 2)]).where("size > 1")
    chosen = held.groupBy("size", "h1", "h2").agg(F.min("bucket").alias("bucket")).select("bucket", "size")
    members = bands.join(chosen, "bucket").withColumn("tiles", F.ceil(F.col("size") / tile).cast("int"))
    members = scratch.write(members.select("bucket", "key", F.pmod(F.xxhash64("key"), F.col("tiles")).cast("int").alias("tile"), "tiles"), "members")
    wanted = nodes.join(members.select("key").distinct(), "key", "left_semi").select("one.*")
    sets = scratch.write(shingle_sets(docs, wanted), "sets")
    pairs = scratch.write(hub_pairs(members.join(sigs, "key")), "hub-pairs")
    labels = contract(verify(pairs, sets, scratch), scratch)
    rest = scratch.write(best_pairs(rest_rows(members, sigs, labels, tile), BEST).join(pairs, ["a", "b"], "left_anti"), "best-pairs")
    labels = contract(verify(rest, sets, scratch), scratch, labels)
    scratch.drop("hub-pairs", "best-pairs")
    links = rest_links(rest_rows(members, sigs, labels, tile), sets, scratch)
    scratch.drop("sets", "meetings", "members")
    labels = contract(links, scratch, labels)
    linked = nodes.select("key", "rep", "copies").join(labels, "key")
    named = linked.groupBy("label").agg(F.min("rep").alias("class_id"), F.sum("copies").alias("class_size"))
    linked = linked.join(named, "label").select("key", F.col("label").alias("class_key"), "class_id", "class_size")
    out = nodes.select("key", "rep", "copies").join(linked, "key", "left")
    own = F.col("class_key").isNull()
    out = out.select("key", F.coalesce("class_key", "key").alias("class_key"), F.when(own, F.col("rep")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("class_size", "copies").alias("class_size"))
    out = scratch.write(out, "classes")
    scratch.drop("nodes", "labels")
    return out


def near_duplicates(docs: DataFrame, tile: int = TILE) -> DataFrame:
    """doc_id, class_id and class_size for every row of docs (doc_id, text)."""
    scratch = Scratch(docs.sparkSession, "near-duplicates")
    prints = scratch.write(fingerprints(docs), "prints")
    found = prints.select("id", "key").join(classes(prints, docs, scratch, tile), "key", "left")
    alone = F.col("key").isNull()
    found = scratch.write(found.select(F.col("id").alias("doc_id"), F.when(alone, F.col("id")).otherwise(F.col("class_id")).alias("class_id"), F.when(alone, 1).otherwise(F.col("class_size")).alias("class_size")), "found")
    scratch.keep_only("found")
    return found


def dedup(docs: DataFrame, tile: int = TILE) -> DataFrame:
    """One row of each class of docs, the one with the smallest doc_id, with all columns."""
    scratch = Scratch(docs.sparkSession, "dedup")
    prints = scratch.write(fingerprints(docs), "prints")
    names = classes(prints, docs, scratch, tile).select("key", "class_key", "class_id")
    rows = prints.where("key IS NOT NULL").groupBy("id", "mark").agg(F.first("key").alias("key"), (F.count("*") > 1).alias("again")).join(names, "key")
    first = F.struct(~F.col("id").eqNullSafe(F.col("class_id")), "id", "mark")
    kept = rows.groupBy("class_key").agg(F.min_by(F.struct("id", "mark", "again"), first).alias("row")).select("row.*")
    wordless = prints.where("key IS NULL").select("id", "mark", F.lit(False).alias("again")).distinct()
    kept = scratch.write(kept.unionByName(wordless), "kept").withColumnsRenamed({"id": "kept_id", "mark": "kept"})
    scratch.keep_only("kept")
    held = identified(docs, F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("held"))
    found = held.join(kept.hint("shuffle_hash"), F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("mark") == F.col("kept")))
    once = found.where("NOT again").select("held")
    # rows that repeat with the same id and text: one of them
    repeated = found.where("again").groupBy("kept_id", "kept").agg(F.first("held").alias("held")).select("held")
    return once.unionByName(repeated).select("held.*")


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents", "doc_id", "text"))


QUERIES = {"op2_near_dedup": op2_near_dedup}
SQL: dict[str, str] = {}
