"""Edit-aware token counts: a segment tree of pre-token runs for each document.

A document is cut into leaves at safe pre-token boundaries (a lone space between visible characters); the
tree over the leaves holds token sums. An edit re-encodes only the leaves it touches, widened by boundary
context until both ends of the region are safe boundaries again, and updates the sums above the
changed leaves. Trees are rows (text, leaf starts, sums), so they can be stored between batches of edits.

Defined results: null text is empty text (no tokens); edits apply in the order of the array, each to the
text the edits before it left; offsets are code points, clipped to the text, and an end before its start is
its start; null edits or an edit with a null offset change nothing; a null replacement is empty; repeated
rows are edited one by one; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chunk_encoder import ChunkEncoder, encoder
from .common import read_table

TOKENIZER, LEAF_CHARS = "byte_bpe_50k.json", 256


def safe(text: str, i: int) -> bool:
    return i == 0 or i >= len(text) or text[i] == " " and not text[i - 1].isspace() and not text[i + 1 : i + 2].isspace() and i + 1 < len(text)


class DocumentTree:
    """starts: where each leaf begins; sums: heap order, leaves from sums[size] on; sums[1] is the total."""

    def __init__(self, text: str, starts: list[int], sums: list[int], enc: ChunkEncoder):
        self.text, self.starts, self.sums, self.enc, self.encoded = text, starts, sums, enc, 0

    @classmethod
    def build(cls, text: str, enc: ChunkEncoder) -> DocumentTree:
        starts = cls.cuts(text)
        tree = cls(text, starts, [], enc)
        tree.plant(tree.count([text[a:z] for a, z in zip(starts, [*starts[1:], len(text)])]))
        return tree

    @staticmethod
    def cuts(text: str) -> list[int]:
        out, at = [0], LEAF_CHARS
        while 0 < (at := text.find(" ", at)):
            if safe(text, at):
                out.append(at)
                at += LEAF_CHARS
            else:
                at += 1
        return out

    def count(self, texts: list[str]) -> list[int]:
        self.encoded += sum(map(len, texts))
        return [len(x) // 4 for x in self.enc.encode(texts)]

    def plant(self, counts: list[int]) -> None:
        size = 1 << max(0, len(counts) - 1).bit_length()
        self.sums = [0] * size + counts + [0] * (size - len(counts))
        for k in range(size - 1, 0, -1):
            self.sums[k] = self.sums[2 * k] + self.sums[2 * k + 1]

    @property
    def total(self) -> int:
        return self.sums[1]

    def edit(self, start: int, end: int, new: str) -> None:
        old = self.text
        start = min(max(start, 0), len(old))
        end = min(max(end, start), len(old))
        text = old[:start] + new + old[end:]
        shift, n, size = len(text) - len(old), len(self.starts), len(self.sums) // 2
        # leaves whose text or border the edit touches: a border looks at one character before and one behind it
        first = max(0, bisect_right(self.starts, max(0, start - 2)) - 1)
        last = max(first, bisect_right(self.starts, end + 2) - 1)
        while first > 0 and not safe(text, self.starts[first]):
            first -= 1
        while last + 1 < n and not safe(text, self.starts[last + 1] + shift):
            last += 1
        a, z = self.starts[first], (self.starts[last + 1] + shift if last + 1 < n else len(text))
        region = text[a:z]
        cut = self.cuts(region)
        counts = self.count([region[x:y] for x, y in zip(cut, [*cut[1:], len(region)])])
        self.text = text
        starts = self.starts[:first] + [a + c for c in cut] + [s + shift for s in self.starts[last + 1 :]]
        if len(cut) == last - first + 1:
            self.starts = starts
            for k, c in enumerate(counts, size + first):
                change, node = c - self.sums[k], k
                while change and node:
                    self.sums[node] += change
                    node //= 2
        else:  # another number of leaves: their counts are kept, only sums are made anew
            leaves = self.sums[size : size + n]
            self.starts = starts
            self.plant(leaves[:first] + counts + leaves[last + 1 :])


def build_trees(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """docs (doc_id, text, edits or any) to rows of trees: doc_id, text, starts, sums, and `edits` if docs has it."""
    more = ["edits"] if "edits" in docs.columns else []
    kinds = "".join(f", edits {docs.schema['edits'].dataType.simpleString()}" for _ in more)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path, True)
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                trees = [DocumentTree.build(t or "", enc) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([t.text for t in trees]), pa.array([t.starts for t in trees], pa.list_(pa.int32())), pa.array([t.sums for t in trees], pa.list_(pa.int64())), *part.columns[2:]], ["doc_id", "text", "starts", "sums", *more])

    return docs.select("doc_id", "text", *more).mapInArrow(run, f"doc_id long, text string, starts array<int>, sums array<long>{kinds}")


def apply_edits(trees: DataFrame, tokenizer_path: str) -> DataFrame:
    """trees with `edits` (array of start, end, text) to the edited trees, with n_before, n_after, and n_encoded characters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer_path, True)
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part, out = b.slice(k, 256), []
                for doc_id, text, starts, sums, edits in zip(*(c.to_pylist() for c in part.columns)):
                    tree = DocumentTree(text, starts, sums, enc)
                    before = tree.total
                    for e in edits or ():
                        if e and e["start"] is not None and e["end"] is not None:
                            tree.edit(e["start"], e["end"], e["text"] or "")
                    out.append((doc_id, tree.text, tree.starts, tree.sums, before, tree.total, tree.encoded))
                cols = list(zip(*out))
                kinds = (pa.int64(), pa.string(), pa.list_(pa.int32()), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["doc_id", "text", "starts", "sums", "n_before", "n_after", "n_encoded"])

    ordered = trees.select("doc_id", "text", "starts", "sums", "edits")
    return ordered.mapInArrow(run, "doc_id long, text string, starts array<int>, sums array<long>, n_before long, n_after long, n_encoded long")


def with_edits(docs: DataFrame, edits: DataFrame) -> DataFrame:
    """docs with an `edits` array from rows (doc_id, seq, start, end, text), in the order of seq."""
    lists = edits.groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "start", "end", "text"))), lambda e: F.struct(e["start"].alias("start"), e["end"].alias("end"), e["text"].alias("text"))).alias("edits"))
    return docs.join(lists, "doc_id", "left")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document gets three edits at places drawn from its id: a deletion, an insertion and a rewriting in capitals."""
    import public_tokenizers

    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    n = F.length(F.coalesce("text", F.lit("")))
    places = [F.pmod(F.xxhash64("doc_id", F.lit(k)), n + 1).cast("int") for k in range(3)]
    edit = lambda start, size, text: F.struct(start.alias("start"), (start + size).alias("end"), text.alias("text"))
    edits = F.array(
        edit(places[0], 40, F.lit("")),
        edit(places[1], 0, F.lit(" [a passage was put in here] ")),
        edit(places[2], 30, F.upper(F.substr("text", places[2] + 1, F.lit(30)))),
    )
    path = public_tokenizers.path(TOKENIZER)
    out = apply_edits(build_trees(docs.withColumn("edits", edits), path), path)
    return out.select("doc_id", "n_before", "n_after", "n_encoded")


QUERIES = {"op7_token_counts": op7_token_counts}
SQL: dict[str, str] = {}
