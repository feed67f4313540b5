"""Byte-level BPE encoding and decoding with Spark higher-order functions.

Higher-order functions fold the ranked merges over a word's byte array: a rank map, kept in the plan as
literal arrays, gives each neighbouring pair the rank of its merged token, and every step of the fold merges
the leftmost pair of the lowest rank. Decoding folds the tokens' binary pieces together again.

Each task turns its texts into places in a list of its own distinct words (pre-token matches), which Spark
folds as they come up, and the texts are put together from their words' ids and pieces. No text is shuffled,
and a lost task is simply run again. A task's list starts anew when it reaches LIST_LIMIT, so memory is bounded.
On request the distinct words of all texts are counted first, and those that most tasks hold, at most
SHARED_WORDS words of at most SHARED_BYTES bytes, are folded once and broadcast; the query leaves that out,
so that texts are split once. Results never depend on either list.

A word of more than LONG bytes takes the same merges by a heap in the worker, since a fold copies its arrays
in every step. Defined results: null text is empty text (no ids); repeated rows are encoded one by
one; null doc_ids stay; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import heapq
from array import array
from collections.abc import Callable, Iterator
from copy import copy
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, read_table

RANKS, LIST_LIMIT, LONG = "byte_bpe_50k.tiktoken", 400_000, 4096
SHARED_WORDS, SHARED_BYTES, HASH_SEED = 400_000, 32, 42
NONE = 65536
#: a mark behind a word that is a word of its own (not an apostrophe)
MARKS = tuple(".,;:!?")


@lru_cache(4)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(4)
def pair_ranks(path: str) -> dict[tuple[int, int], int]:
    """(left token, right token) to the token of their joined bytes."""
    ranks, out = load_ranks(path), {}
    for token, rank in ranks.items():
        for k in range(1, len(token)):
            left, right = ranks.get(token[:k]), ranks.get(token[k:])
            if left is not None and right is not None:
                out[left, right] = rank
    return out


#: a cell of a fold: rank of the pair that begins here (from UP), place (from AT), token
SLOTS, SHIFT, AT, UP, EDGE = 3 << 17, 1 << 17, 1 << 16, 1 << 29, 65535


@lru_cache(4)
def displaced_table(path: str) -> tuple[list[int], list[int]]:
    """Pair ranks without collisions: a pair's slot is its left token's displacement plus its right token.

    Slots hold left token * SHIFT + rank. Tokens are placed from the one with most pairs on, each where its slots are free."""
    rows: dict[int, list[tuple[int, int]]] = {}
    for (a, b), rank in pair_ranks(path).items():
        rows.setdefault(a, []).append((b, rank))
    taken, slots, moves, dice = np.zeros(SLOTS, bool), np.full(SLOTS + EDGE + 1, -SHIFT, np.int64), np.zeros(EDGE + 1, np.int64), np.random.default_rng(1)
    for a, row in sorted(rows.items(), key=lambda x: (-len(x[1]), x[0])):
        right, ranks = np.array(row, np.int64).T
        span = SLOTS - int(right.max())
        for turn in range(2000):
            first = int(dice.integers(0, span))
            free = ~taken[first + right[:, None] + np.arange(min(256, span - first))].any(axis=0)
            if free.any():
                break
        else:
            raise ValueError("the table of pairs is too full")
        moves[a] = first + int(free.argmax())
        taken[moves[a] + right] = True
        slots[moves[a] + right] = a * SHIFT + ranks
    return slots.tolist(), moves.tolist()


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate value once and use it many times inside body: the end of a fold over nothing, which copies no arrays."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda v, _: v, body)


def big(n: int) -> Column:
    return F.lit(n).cast("bigint")


class Tables:
    """The rank map as literal columns: folded once by the optimizer, then constants of the plan."""

    def __init__(self, path: str):
        ranks, pairs = load_ranks(path), pair_ranks(path)
        numbers = lambda values, kind: F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")
        slots, moves = displaced_table(path)
        self.slots, self.moves = numbers(slots, "bigint"), numbers(moves, "int")
        single = [ranks[bytes([b])] for b in range(256)]
        # a byte's cell by itself and the byte behind it, and a last byte's cell
        self.first = numbers([pairs.get((a, b), NONE) * UP + a for a in single for b in single], "bigint")
        self.last = numbers([NONE * UP + a for a in single], "bigint")
        pieces = sorted((v, k) for k, v in ranks.items())
        if [v for v, _ in pieces] != list(range(len(pieces))) or len(pieces) > EDGE:
            raise ValueError(f"ranks must run from 0 without a gap, below {EDGE}")
        self.pieces = F.from_json(F.lit("[" + ",".join(f'"{base64.b64encode(k).decode()}"' for _, k in pieces) + "]"), "array<binary>")

    def bound(self, body: Callable[[Tables], Column]) -> Column:
        """body with the tables bound to variables, so that the plan holds each only once."""

        def at(slots: Column, moves: Column, first: Column) -> Column:
            inner = copy(self)
            inner.slots, inner.moves, inner.first = slots, moves, first
            return body(inner)

        return bind(self.slots, lambda slots: bind(self.moves, lambda moves: bind(self.first, lambda first: at(slots, moves, first))))

    def ranked(self, a: Column, b: Column) -> Column:
        """A cell's part for the rank of a pair's merged token; a slot of another left token makes it NONE * UP or more."""
        return big(UP) * F.abs(F.get(self.slots, F.get(self.moves, a) + b) - big(SHIFT) * a)


def fold_merges(word: Column, t: Tables) -> Column:
    """array<smallint> of a word's bytes (at most LONG) to array<int> of its tokens.

    The fold's state is one array of cells between two edges, which join nothing; its least cell is the leftmost
    pair of the lowest rank and says where it stands. Literals come first in sums and products, since Spark asks
    the left operand for its type at every evaluation; array_position would throw an exception to end its search."""

    def token(cell: Column) -> Column:
        return cell.bitwiseAND(F.lit(AT - 1)).cast("int")

    def place(cell: Column) -> Column:
        return F.shiftright(cell.bitwiseAND(F.lit(UP - 1)), 16).cast("int")

    def merge(s: Column) -> Column:
        def joined(least: Column, p: Column, m: Column) -> Column:
            left = F.get(s, p - 1)
            cells = F.array(
                t.ranked(token(left), m) + left.bitwiseAND(F.lit(UP - 1)),
                t.ranked(m, token(F.get(s, p + 2))) + (least.bitwiseAND(F.lit(UP - AT)) + m),
            )
            return F.concat(F.slice(s, F.lit(1), p - 1), cells, F.transform(F.slice(s, p + 3, F.size(s)), lambda c: c - AT))

        def step(least: Column) -> Column:
            merged = bind(place(least), lambda p: bind(F.shiftright(least, 29).cast("int"), lambda m: joined(least, p, m)))
            return F.when(least >= big(NONE * UP), s).otherwise(merged)

        return bind(F.array_min(s), step)

    n, edge = F.size(word), NONE * UP + EDGE
    inner = F.transform(F.slice(word, 2, n), lambda b, i: big(AT) * (i + 1) + F.get(t.first, F.lit(256) * F.get(word, i) + b))
    last = big(AT) * n + F.get(t.last, F.element_at(word, -1).cast("int"))
    cells = F.concat(F.array(big(edge)), inner, F.array(last, big(edge) + big(AT) * (n + 1)))
    # the loop runs over the word's own bytes but one: at most one merge for each
    folded = F.aggregate(F.slice(word, 2, n), cells, lambda s, _: merge(s), lambda s: F.transform(F.slice(s, F.lit(2), F.size(s) - 2), token))
    return F.when(n == 0, F.array().cast("array<int>")).otherwise(folded)


def decode_pieces(ids: Column, t: Tables) -> Column:
    return F.aggregate(ids, F.lit(b"").cast("binary"), lambda whole, i: F.concat(whole, F.get(t.pieces, i)))


def merge_long(word: bytes, path: str) -> list[int]:
    """The same merges for one long word, by a heap of pairs over a linked list."""
    pairs, ranks = pair_ranks(path), load_ranks(path)
    ids = [ranks[bytes([b])] for b in word]
    n = len(ids)
    after, before, gone = list(range(1, n + 1)), list(range(-1, n - 1)), [False] * n
    heap = [(pairs[ids[i], ids[i + 1]], i) for i in range(n - 1) if (ids[i], ids[i + 1]) in pairs]
    heapq.heapify(heap)
    while heap:
        rank, i = heapq.heappop(heap)
        j = after[i]
        if gone[i] or j >= n or pairs.get((ids[i], ids[j])) != rank:
            continue
        ids[i], gone[j], after[i] = rank, True, after[j]
        if after[i] < n:
            before[after[i]] = i
            if (r := pairs.get((rank, ids[after[i]]))) is not None:
                heapq.heappush(heap, (r, i))
        if before[i] >= 0 and (r := pairs.get((ids[before[i]], rank))) is not None:
            heapq.heappush(heap, (r, before[i]))
    return [x for x, dead in zip(ids, gone) if not dead]


class SharedWords:
    """Words that all tasks know: their places run from 0 in the order of their hashes."""

    def __init__(self, rows: pa.Table):
        """rows: word, hash (the word's xxhash64 as Spark has it), ids and piece (its decoded bytes)."""
        hashes = rows.column("hash").to_numpy().view(np.uint64)
        order = np.argsort(hashes)
        self.hashes, rows = hashes[order], rows.take(order)
        self.text = [flat(rows.column(c)) for c in ("word", "ids", "piece")]

    def __len__(self) -> int:
        return len(self.hashes)

    def cell(self, k: int, place: int) -> bytes:
        """The ids (k = 1) or the decoded bytes (k = 2) of a place."""
        data, ends = self.text[k]
        return data[ends[place - 1] if place else 0 : ends[place]]

    def find(self, words: list[str]) -> list[int]:
        """Each word's place, or -1."""
        if not len(self.hashes):
            return [-1] * len(words)
        coded = [w.encode() for w in words]
        wanted = np.array([xxhash.xxh64_intdigest(w, HASH_SEED) for w in coded], np.uint64)
        at = np.minimum(np.searchsorted(self.hashes, wanted), len(self.hashes) - 1)
        same = self.hashes[at] == wanted
        return [p if s and self.cell(0, p) == w else -1 for w, p, s in zip(coded, at.tolist(), same.tolist())]


def flat(column: pa.ChunkedArray) -> tuple[bytes, np.ndarray]:
    """The bytes of a column of texts, binaries or lists of ids (as little-endian uint32), and where each cell ends."""
    cells = column.combine_chunks()
    if pa.types.is_list(cells.type):
        sizes = np.asarray(pc.list_value_length(cells), np.int64) * 4
        return np.asarray(cells.flatten(), "<u4").tobytes(), np.cumsum(sizes)
    return b"".join(cells.cast(pa.binary()).to_pylist()), np.cumsum(np.asarray(pc.binary_length(cells), np.int64))


class Cells:
    """Growing list of cells of a few numbers each, which are read many at a time."""

    def __init__(self, kind: str, data: bytes, ends: np.ndarray):
        self.kind = np.dtype(kind)
        self.data, self.used = np.frombuffer(data, self.kind), len(data) // self.kind.itemsize
        ends = ends // self.kind.itemsize
        self.starts, self.sizes, self.n = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else ends, np.diff(ends, prepend=0), len(ends)
        self.base = self.n, self.used

    def restart(self) -> None:
        """Only the first cells stay."""
        self.n, self.used = self.base

    def extend(self, data: np.ndarray, sizes: np.ndarray) -> None:
        for name, used, more in (("data", self.used, len(data)), ("starts", self.n, len(sizes)), ("sizes", self.n, len(sizes))):
            held = getattr(self, name)
            if used + more > len(held) or not held.flags.writeable:
                new = np.empty(max(used + more, used * 3 // 2, 1024), held.dtype)
                new[:used] = held[:used]
                setattr(self, name, new)
        self.data[self.used : self.used + len(data)] = data
        self.starts[self.n : self.n + len(sizes)] = self.used + np.cumsum(sizes) - sizes
        self.sizes[self.n : self.n + len(sizes)] = sizes
        self.n, self.used = self.n + len(sizes), self.used + len(data)

    def joined(self, places: np.ndarray, rows: np.ndarray) -> pa.Array:
        """Binary cells: the numbers of the cells at places, of which the first rows[0] go to the first one, and so on."""
        parts, at = [], np.zeros(len(places) + 1, np.int64)
        for k in range(0, len(places), 65_536):
            p = places[k : k + 65_536]
            size = self.sizes[p]
            ends = np.cumsum(size)
            parts.append(self.data[np.repeat(self.starts[p] - ends + size, size) + np.arange(ends[-1])])
            at[k + 1 : k + 1 + len(p)] = at[k] + ends
        data = np.concatenate(parts) if parts else np.zeros(0, self.kind)
        offsets = at[np.concatenate([[0], np.cumsum(rows)])] * self.kind.itemsize
        return pa.Array.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


class _Memo(dict):
    def __init__(self, compute):
        self.compute = compute

    def __missing__(self, key):
        value = self[key] = self.compute(key)
        return value


class Splitter:
    """Words of the chunks that a text falls into at spaces and line ends."""

    def __init__(self, pattern: str):
        import regex

        self.find = regex.compile(pattern).findall

    def words(self, chunk: str) -> list[str] | None:
        """The words of a chunk with the space before it (a line's chunk begins with its line end), or None if it could join white space."""
        if chunk.isalpha():
            return [" " + chunk]
        if chunk[-1:] in MARKS and chunk[:-1].isalpha():
            return [" " + chunk[:-1], chunk[-1]]
        line = chunk[:1] == "\n"
        first = chunk[line : line + 1]
        if not first or first.isspace() or not first.isprintable():
            return None
        return self.find(chunk if line else " " + chunk)


def chunks_of(text: str) -> list[str]:
    return text.replace("\n", " \n").split(" ")


class WordList:
    """Turns texts into places: those of the shared words, and behind them a task's own words in order of appearance.

    `fresh` holds own words not yet handed out."""

    def __init__(self, pattern: str, shared: SharedWords):
        self.splitter, self.shared = Splitter(pattern), shared
        self.start()

    def start(self) -> None:
        self.number: dict[str, int] = {}
        self.own, self.fresh = 0, []
        self.known: dict[str, bytes | None] = {}
        self.heads = _Memo(lambda text: self.pack(self.splitter.find(text)))

    def learn(self, words: list[str]) -> None:
        """Numbers for words that have none."""
        number = self.number
        new = list(dict.fromkeys(w for w in words if w not in number))
        for w, p in zip(new, self.shared.find(new)):
            if p < 0:
                p = len(self.shared) + self.own
                self.own += 1
                self.fresh.append(w)
            number[w] = p

    def pack(self, words: list[str]) -> bytes:
        out = [self.number.get(w) for w in words]
        if None in out:
            self.learn(words)
            out = [self.number[w] for w in words]
        return array("i", out).tobytes()

    def places(self, texts: list[str]) -> list[bytes]:
        for memo in (self.known, self.heads):
            if len(memo) > LIST_LIMIT:
                memo.clear()
        cut, known, met = [chunks_of(t) for t in texts], self.known, set()
        for chunks in cut:
            met.update(chunks[1:])
        split = {c: self.splitter.words(c) for c in met.difference(known)}
        self.learn([w for words in split.values() if words for w in words])
        number = self.number
        for c, words in split.items():
            known[c] = None if words is None else array("i", [number[w] for w in words]).tobytes()
        out = []
        for t, (head, *chunks) in zip(texts, cut):
            try:
                out.append(self.heads[head] + b"".join(map(known.__getitem__, chunks)))
            except TypeError:
                out.append(self.pack(self.splitter.find(t)))
        return out


def distinct_words(docs: DataFrame, pattern: str) -> DataFrame:
    """word and tasks: the distinct words of the texts, and how many lists of chunks hold them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        splitter, chunks = Splitter(pattern), set()

        def words() -> Iterator[pa.RecordBatch]:
            held = {w for c in chunks for w in splitter.words(c) or () if len(w) <= SHARED_BYTES}
            chunks.clear()
            rows = [w for w in held if w.isascii() or len(w.encode()) <= SHARED_BYTES]
            for k in range(0, len(rows), 20_000):
                yield pa.RecordBatch.from_pydict({"word": rows[k : k + 20_000]})

        for b in batches:
            for k in range(0, b.num_rows, 64):
                for t in b.column(0).slice(k, 64).to_pylist():
                    chunks.update(chunks_of(t or "")[1:])
                if len(chunks) > LIST_LIMIT * 3 // 2:
                    yield from words()
        yield from words()

    return docs.select("text").mapInArrow(run, "word string").groupBy("word").agg(F.count("*").alias("tasks"))


def shared_words(docs: DataFrame, t: Tables, pattern: str, most: int = SHARED_WORDS) -> SharedWords:
    """The words that most tasks hold, folded once: as many whole steps (quarters of a power of two) of task counts as `most` allows."""
    if not most:
        none = {"word": pa.string(), "hash": pa.int64(), "ids": pa.list_(pa.int32()), "piece": pa.binary()}
        return SharedWords(pa.schema(none.items()).empty_table())
    scratch = Scratch(docs.sparkSession, "words")
    words = scratch.write(distinct_words(docs, pattern).where("tasks > 1").select("word", "tasks", F.floor(4 * F.log2("tasks")).cast("int").alias("power")), "words")
    least, total = 256, 0
    for r in sorted(words.groupBy("power").count().collect(), reverse=True):
        total += r["count"]
        if total > most:
            break
        least = r["power"]
    taken = words.where(F.col("power") >= least).select("word", F.transform(F.array(F.encode("word", "UTF-8")), _bytes)[0].alias("bytes"))
    folded = taken.select("word", F.xxhash64("word").alias("hash"), t.bound(lambda own: fold_merges(F.col("bytes"), own)).alias("ids"))
    rows = folded.select("word", "hash", "ids", decode_pieces(F.col("ids"), t).alias("piece")).toArrow()
    scratch.drop("words")
    return SharedWords(rows)


def _bytes(word: Column) -> Column:
    """array<smallint> of a binary's bytes: each byte's unsigned value from its Latin-1 character."""
    text = F.decode(word, "ISO-8859-1")
    return F.transform(F.sequence(F.lit(1), F.octet_length(word)), lambda i: F.ascii(F.substr(text, i, F.lit(1))).cast("smallint"))


def encode(docs: DataFrame, ranks_path: str, pattern: str, most_shared: int = 0) -> DataFrame:
    """docs (doc_id, text) to doc_id, ids (little-endian uint32) and decoded (the bytes of the decoded ids)."""
    t = Tables(ranks_path)
    shared = docs.sparkSession.sparkContext.broadcast(shared_words(docs, t, pattern, most_shared))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, renewed = WordList(pattern, shared.value), True
        schema = pa.schema([("renew", pa.bool_()), ("words", pa.list_(pa.list_(pa.int16()))), ("long", pa.list_(pa.binary())), ("doc_id", pa.int64()), ("places", pa.binary())])
        for b in batches:
            for k in range(0, b.num_rows, 64):
                if words.own > LIST_LIMIT or len(words.number) > LIST_LIMIT * 3 // 2:
                    words.start()
                    renewed = True
                part = b.slice(k, 64)
                places = words.places([t or "" for t in part.column(1).to_pylist()])
                raw = [w.encode() for w in words.fresh]
                words.fresh = []
                # a long word leaves an empty byte array and stands in `long` at its turn
                long = [merge_bytes(w) for w in raw if len(w) > LONG]
                raw = [w if len(w) <= LONG else b"" for w in raw]
                sizes = np.concatenate([[0], np.cumsum([len(w) for w in raw])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.frombuffer(b"".join(raw), np.uint8).astype(np.int16)))
                first = pa.RecordBatch.from_arrays([pa.array([renewed]), pa.ListArray.from_arrays(pa.array([0, len(raw)], pa.int32()), lists), pa.array([long], pa.list_(pa.binary())), pa.array([None], pa.int64()), pa.array([None], pa.binary())], schema=schema)
                renewed = False
                yield first
                n = len(places)
                yield pa.RecordBatch.from_arrays([pa.array([False] * n), pa.nulls(n, schema.field("words").type), pa.nulls(n, schema.field("long").type), part.column(0).cast(pa.int64()), pa.array(places, pa.binary())], schema=schema)

    def merge_bytes(word: bytes) -> bytes:
        return np.array(merge_long(word, ranks_path), "<u4").tobytes()

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, pieces = (Cells(kind, *shared.value.text[k]) for k, kind in ((1, "<u4"), (2, "u1")))
        for b in batches:
            # a row of words, and then the rows of the texts that they are for
            heads = np.flatnonzero(b.column(1).is_valid().to_numpy(zero_copy_only=False)).tolist()
            for head, end in zip([-1, *heads], [*heads, b.num_rows]):
                if head >= 0:
                    if b.column(0)[head].as_py():  # the list begins anew
                        ids.restart(), pieces.restart()
                    learn(b, head, ids, pieces)
                first = head + 1
                while first < end:  # a few texts at a time, or one long one
                    held = b.column(5).slice(first, end - first)
                    offsets = np.frombuffer(held.buffers()[1], "<i4", len(held) + 1, 4 * held.offset).astype(np.int64)
                    n = max(1, int(np.searchsorted(offsets, offsets[0] + (1 << 20), "right")) - 1)
                    places = np.frombuffer(held.buffers()[2], "<i4", (offsets[n] - offsets[0]) // 4, offsets[0]) if offsets[n] > offsets[0] else np.zeros(0, np.int32)
                    rows = np.diff(offsets[: n + 1]) // 4
                    yield pa.RecordBatch.from_arrays([b.column(4).slice(first, n), *[c.joined(places, rows).cast(pa.binary()) for c in (ids, pieces)]], ["doc_id", "ids", "decoded"])
                    first += n

    def learn(b: pa.RecordBatch, row: int, ids: Cells, pieces: Cells) -> None:
        cell, done = b.column(1)[row].values, b.column(2)[row].values
        sizes = np.asarray(pc.list_value_length(cell), np.int64)
        long = [x for x in b.column(3)[row].as_py()]
        if not long:
            ids.extend(np.asarray(cell.flatten(), "<u4"), sizes)
            pieces.extend(np.frombuffer(b"".join(done.to_pylist()), "u1"), np.asarray(pc.binary_length(done), np.int64))
            return
        by_rank, waiting = [k for _, k in sorted((v, k) for k, v in load_ranks(ranks_path).items())], iter(long)
        for own, piece in zip(cell.to_pylist(), done.to_pylist()):
            own = np.array(own, "<u4") if own else np.frombuffer(next(waiting), "<u4")
            piece = piece or b"".join(by_rank[x] for x in own.tolist())
            ids.extend(own, np.array([len(own)]))
            pieces.extend(np.frombuffer(piece, "u1"), np.array([len(piece)]))

    listed = docs.select("doc_id", "text").mapInArrow(split, "renew boolean, words array<array<smallint>>, long array<binary>, doc_id long, places binary")
    merged = listed.select("renew", t.bound(lambda own: F.transform("words", lambda w: fold_merges(w, own))).alias("ids"), "long", "doc_id", "places")
    pieces = F.transform("ids", lambda ids: decode_pieces(ids, t))
    return merged.select("renew", "ids", pieces.alias("pieces"), "long", "doc_id", "places").mapInArrow(join, "doc_id long, ids binary, decoded binary")


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    rows = encode(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    return rows.select("doc_id", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


QUERIES = {"op3_byte_bpe": op3_byte_bpe}
SQL: dict[str, str] = {}
