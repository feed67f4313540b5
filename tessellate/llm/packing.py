"""Best-fit packing in bulk-synchronous supersteps.

Documents become pieces of at most `capacity` tokens (only longer documents are cut, the first piece
takes the remainder). Pieces of more than half the capacity each open a sequence. Then supersteps over two
distributed tables, the pieces left and the gaps of open sequences:

1. Gaps and pieces are range-sorted together by size over the cluster, pieces before gaps of their size. A gap
   that holds several of the largest pieces left stands as so many equal slots.
2. Successor sweep: each range is swept upwards, and a slot takes the largest piece below it that no other slot
   has taken. What a range can't match is counted, and these counts (a row a range) say which later range's
   slots take the pieces of which earlier one; conflicts for a piece or a slot go by rank.
3. The pieces' lengths are taken off the gaps, and the next superstep begins.

Fresh sequences, as many as the rest's lower bound, are opened when a superstep placed less than one in a
hundred of the pieces left. Each superstep about halves what is left, so their number grows with its logarithm.
At the end, a piece's offset is the sum of the lengths placed before it in its sequence.

Defined results: null or empty text is the end id alone (a piece of length 1); repeated rows are packed
one by one; null ids are kept; an empty table gives an empty result; other input columns are ignored, and
pack() keeps those of its pieces (columns named sequence_id or offset are replaced).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .chunk_encoder import encoder
from .common import Scratch, read_table

CAPACITY, END_ID, TOKENIZER = 2048, 0, "byte_bpe_50k.json"


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """docs (doc_id, text) to pieces (doc_id, piece, start, length, ids_crc32, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, tail = encoder(tokenizer_path, True), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            doc_ids = batch.column(0).to_pylist()
            for k in range(0, len(doc_ids), 512):
                texts = [t or "" for t in batch.column(1).slice(k, 512).to_pylist()]
                rows: list[tuple] = []
                for doc_id, ids in zip(doc_ids[k : k + 512], enc.encode(texts)):
                    ids += tail
                    n = len(ids) // 4
                    first = n % capacity or capacity
                    bounds = [0, *range(first, n + 1, capacity)] if n > capacity else [0, n]
                    for p, (a, b) in enumerate(zip(bounds, bounds[1:])):
                        rows.append((doc_id, p, a, b - a, zlib.crc32(ids[4 * a : 4 * b])))
                cols = list(zip(*rows))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def sweep(rows: DataFrame) -> DataFrame:
    """Range-sorted rows (size, owner, slot; slot null for pieces) to (part, nth, owner, size, seq, slot).

    Matched pieces have a seq and a slot; of the rest, nth counts a part's pieces (seq and slot null) and slots
    (owner and size null) from 0 in the order of size."""
    names = ["part", "nth", "owner", "size", "seq", "slot"]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, waiting, unmet = TaskContext.get().partitionId(), [], 0

        def out(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names)

        for b in batches:
            met = []
            for size, owner, slot in zip(*(c.to_pylist() for c in b.columns)):
                if slot is None:
                    waiting.append((owner, size))
                elif waiting:
                    met.append((part, None, *waiting.pop(), owner, slot))
                else:
                    met.append((part, unmet, None, None, owner, slot))
                    unmet += 1
            if met:
                yield out(met)
        for k in range(0, len(waiting), 50_000):
            yield out([(part, k + i, *piece, None, None) for i, piece in enumerate(waiting[k : k + 50_000])])

    ordered = rows.repartitionByRange("size", F.col("slot").isNotNull(), "owner", "slot").sortWithinPartitions("size", F.col("slot").isNotNull(), "owner", "slot")
    return ordered.select("size", "owner", "slot").mapInArrow(run, "part int, nth long, owner long, size int, seq long, slot int")


def carried(rest: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """Parts' unmatched slots and pieces, in order (part, slots, pieces), to runs (slot part, first slot, piece part, last piece, length).

    A part's slots stand below its pieces, so they take pieces of earlier parts, the nearest ones first."""
    piles: list[list[int]] = []
    runs = []
    for part, slots, pieces in sorted(rest):
        at = 0
        while at < slots and piles:
            below, n = piles.pop()
            take = min(n, slots - at)
            runs.append((part, at, below, n - 1, take))
            at += take
            if n > take:
                piles.append([below, n - take])
        if pieces:
            piles.append([part, pieces])
    return runs


def joined_ranges(swept: DataFrame, runs: list[tuple[int, int, int, int, int]]) -> DataFrame:
    """What sweep() left, pieces (owner, size) and slots (seq, slot), with the number of their pair; pair is null without a mate."""
    base = np.cumsum([0, *[r[4] for r in runs]])
    by_slot: dict[int, list[tuple[int, int, int, int]]] = {}
    by_piece: dict[int, list[tuple[int, int, int, int]]] = {}
    for (slot_part, first, piece_part, last, n), at in zip(runs, base.tolist()):
        by_slot.setdefault(slot_part, []).append((first, n, at, 1))
        by_piece.setdefault(piece_part, []).append((last - n + 1, n, at + n - 1, -1))
    # at most two runs a part
    shared = swept.sparkSession.sparkContext.broadcast([{p: np.array(sorted(r), np.int64) for p, r in d.items()} for d in (by_slot, by_piece)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = shared.value
        for b in batches:
            parts, nth, piece = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).is_valid().to_numpy(zero_copy_only=False)
            pair = np.full(b.num_rows, -1, np.int64)
            for kind in (0, 1):
                for p in np.unique(parts[piece == bool(kind)]).tolist():
                    table = tables[kind].get(p)
                    if table is None:
                        continue
                    at = np.flatnonzero((parts == p) & (piece == bool(kind)))
                    row = table[np.maximum(np.searchsorted(table[:, 0], nth[at], "right") - 1, 0)]
                    off = nth[at] - row[:, 0]
                    pair[at] = np.where((off >= 0) & (off < row[:, 1]), row[:, 2] + off * row[:, 3], -1)
            yield pa.RecordBatch.from_arrays([*b.columns[2:], pa.array(pair, mask=pair < 0)], ["owner", "size", "seq", "slot", "pair"])

    return swept.where("nth IS NOT NULL").mapInArrow(run, "owner long, size int, seq long, slot int, pair long")


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces that have a `length` from 1 to capacity."""
    spark, scratch = pieces.sparkSession, Scratch(pieces.sparkSession, "packing")
    names = [c for c in pieces.columns if c.lower() not in ("sequence_id", "offset")]
    row = F.struct(*[F.col(f"`{c}`") for c in names]).alias("piece")
    held = scratch.write(pieces.select(F.monotonically_increasing_id().alias("owner"), F.col("length").cast("int").alias("size"), row), "pieces")
    large = F.col("size") > capacity // 2
    placed = [held.where(large).select("owner", "size", F.col("owner").alias("seq"), F.lit(0).alias("turn"), F.lit(0).alias("slot"))]
    left = held.where(~large).select("owner", "size")
    gaps = held.where(large).select(F.col("owner").alias("seq"), (capacity - F.col("size")).alias("gap")).where("gap > 0")
    opened, turn, stalled = 0, 0, False
    while True:
        sizes = left.select(F.lit(0).alias("kind"), "size").unionByName(gaps.select(F.lit(1).alias("kind"), F.col("gap").alias("size")))
        seen = {r["kind"]: r for r in sizes.groupBy("kind").agg(F.count("*").alias("n"), F.min("size").alias("least"), F.max("size").alias("most"), F.sum("size").alias("total")).collect()}
        if 0 not in seen:
            break
        now, free = seen[0], seen[1]["n"] if 1 in seen and seen[1]["most"] >= seen[0]["least"] else 0
        if stalled or not free:
            fresh = -(-now["total"] // capacity)
            gaps = gaps.unionByName(spark.range(-opened - fresh, -opened).select(F.col("id").alias("seq"), F.lit(capacity).alias("gap")))
            opened, free = opened + fresh, free + fresh
        turn += 1
        # about as many slots as pieces, however small those are
        most = F.least(F.floor(F.col("gap") / now["most"]), F.lit(-(-2 * now["n"] // free)))
        slots = gaps.where(F.col("gap") >= now["least"]).withColumn("n", F.greatest(F.lit(1), most).cast("int"))
        slots = slots.select(F.floor(F.col("gap") / F.col("n")).cast("int").alias("size"), F.col("seq").alias("owner"), F.explode(F.sequence(F.lit(1), "n")).alias("slot"))
        swept = scratch.write(sweep(slots.unionByName(left.select("size", "owner", F.lit(None).cast("int").alias("slot")))), "swept")
        rest = swept.groupBy("part").agg(F.count(F.when(F.col("owner").isNull(), 1)).alias("slots"), F.count(F.when(F.col("seq").isNull(), 1)).alias("pieces")).collect()
        rest = scratch.write(joined_ranges(swept, carried([(r["part"], r["slots"], r["pieces"]) for r in rest])), "rest")
        paired = rest.where("pair IS NOT NULL")
        mates = paired.where("owner IS NOT NULL").select("pair", "owner", "size").join(paired.where("owner IS NULL").select("pair", "seq", "slot"), "pair").select("owner", "size", "seq", "slot")
        met = swept.where("nth IS NULL").select("owner", "size", "seq", "slot").unionByName(mates)
        met = scratch.write(met.select("owner", "size", "seq", F.lit(turn).alias("turn"), "slot"), f"placed-{turn}")
        placed.append(met)
        used = met.groupBy("seq").agg(F.sum("size").alias("used"))
        rest_gaps = gaps.join(used, "seq", "left").select("seq", (F.col("gap") - F.coalesce("used", F.lit(0))).cast("int").alias("gap")).where(F.col("gap") >= now["least"])
        gaps = scratch.write(rest_gaps, "gaps")
        left = scratch.write(rest.where("owner IS NOT NULL AND pair IS NULL").select("owner", "size"), "left")
        stalled = met.count() * 100 < now["n"]
    scratch.drop("swept", "rest", "gaps", "left")
    every = placed[0]
    for more in placed[1:]:
        every = every.unionByName(more)
    before = Window.partitionBy("seq").orderBy("turn", "slot").rowsBetween(Window.unboundedPreceding, -1)
    every = every.select("owner", "seq", F.coalesce(F.sum("size").over(before), F.lit(0)).cast("long").alias("at"))
    return held.join(every, "owner").select("piece.*", F.col("seq").alias("sequence_id"), F.col("at").alias("offset"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return pack(token_pieces(docs, public_tokenizers.path(TOKENIZER)))


QUERIES = {"op8_best_fit_packing": op8_best_fit_packing}
SQL: dict[str, str] = {}
