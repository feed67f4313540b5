"""Token-id files: adaptive context-mixing range coding in independently reset, checksummed blocks.

Documents are range-partitioned and sorted by doc_id; each partition becomes one or more files in the shared
folder: coded groups of blocks (see range_codec), then an index of doc ids and lengths. A file ends with the
document that brings its ids to ROLL_IDS (a longer document has a file of its own), since Spark's binaryFile
source, which reads them, holds a file in memory. A task writes under a name of its own attempt and reports
it in a committed table, so a repeated task never mixes with a lost one's file.

Defined results: null or empty text is the end id alone; rows of equal doc_id stay apart and are ordered
by text; a null doc_id comes first and stays null; an empty table writes and reads no files; other input
columns are ignored. A block that fails its checksum raises ValueError.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .chunk_encoder import encoder
from .common import materialize, open_output, read_table, shared_dir
from .range_codec import GROUP, decode_group, encode_group

TOKENIZER, END_ID, MEMO, ROLL_IDS = "word_bpe_49k.json", 1, 900_000, 1 << 26
MAGIC, TAIL = b"IDFILE1\n", struct.Struct("<QQI8s")


def write_file(uri: str, docs: Iterator[tuple[int | None, bytes]], roll: int = ROLL_IDS) -> tuple[int, int]:
    """docs: (doc_id, ids as little-endian uint32), taken until `roll` ids are reached. Returns the counts of documents and ids."""
    doc_ids, sizes, waiting, held, total = [], [], [], 0, 0
    with open_output(uri) as out:
        out.write(MAGIC)
        at = len(MAGIC)

        def flush(last: bool) -> None:
            nonlocal waiting, held, at
            ids = np.frombuffer(b"".join(waiting), "<u4")
            k = 0
            while len(ids) - k >= GROUP or last and k < len(ids):
                data = encode_group(ids[k : k + GROUP])
                out.write(data)
                at += len(data)
                k += GROUP
            waiting = [ids[k:].tobytes()]
            held = len(waiting[0])

        for doc_id, ids in docs:
            doc_ids.append(doc_id)
            sizes.append(len(ids) // 4)
            total += sizes[-1]
            waiting.append(ids)
            held += len(ids)
            if held >= 4 * GROUP:
                flush(False)
            if total >= roll:
                break
        flush(True)
        nulls = np.array([d is None for d in doc_ids], bool)
        keys = np.array([d or 0 for d in doc_ids], "<i8")
        index = zlib.compress(np.packbits(nulls).tobytes() + keys.tobytes() + np.array(sizes, "<i8").tobytes(), 6)
        out.write(index + TAIL.pack(len(index), len(doc_ids), zlib.crc32(index), MAGIC))
    return len(doc_ids), total


def read_file(content: bytes) -> Iterator[tuple[int | None, int, bytes]]:
    """(doc_id, start within the file, ids as little-endian uint32) in file order."""
    size, n, crc, magic = TAIL.unpack_from(content, len(content) - TAIL.size)
    index = content[len(content) - TAIL.size - size : len(content) - TAIL.size]
    if magic != MAGIC or content[: len(MAGIC)] != MAGIC or zlib.crc32(index) != crc:
        raise ValueError("not a token-id file, or its index is damaged")
    index = zlib.decompress(index)
    head = -(-n // 8)
    nulls = np.unpackbits(np.frombuffer(index, np.uint8, head), count=n).astype(bool).tolist()
    keys = np.frombuffer(index, "<i8", n, head).tolist()
    sizes = np.frombuffer(index, "<i8", n, head + 8 * n).tolist()
    buf, at, start = memoryview(content), len(MAGIC), 0
    ready = np.zeros(0, "<u4")
    for null, key, size in zip(nulls, keys, sizes):
        while len(ready) < size:
            ids, at = decode_group(buf, at)
            ready = np.concatenate([ready, ids])
        yield None if null else key, start, ready[:size].tobytes()
        ready = ready[size:]
        start += size


def write_token_files(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int = END_ID, space_sticks: bool = False, roll: int = ROLL_IDS) -> DataFrame:
    """Writes docs (doc_id, text); returns one row a file: part, nth, file, n_docs, n_ids, in doc_id order by part and nth."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, tail = encoder(tokenizer_path, space_sticks, MEMO), np.array([end_id], "<u4").tobytes()

        def rows() -> Iterator[tuple[int | None, bytes]]:
            for batch in batches:
                for k in range(0, batch.num_rows, 512):
                    texts = [t or "" for t in batch.column(1).slice(k, 512).to_pylist()]
                    for doc_id, ids in zip(batch.column(0).slice(k, 512).to_pylist(), enc.encode(texts)):
                        yield doc_id, ids + tail

        part, left, nth = TaskContext.get().partitionId(), rows(), 0
        for first in left:
            file = f"part-{part:06d}-{nth:04d}-{uuid.uuid4().hex}.ids"
            n_docs, n_ids = write_file(f"{folder}/{file}", chain([first], left), roll)
            yield pa.RecordBatch.from_pydict({"part": [part], "nth": [nth], "file": [file], "n_docs": [n_docs], "n_ids": [n_ids]})
            nth += 1

    # the beginning of the text lets the rows of one doc_id (null, for one) lie in several partitions
    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id", F.substring("text", 1, 24)).sortWithinPartitions("doc_id", "text")
    return materialize(ordered.mapInArrow(run, "part long, nth long, file string, n_docs long, n_ids long"), "token-index")


def read_token_files(spark: SparkSession, folder: str, written: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it) and ids (binary) of every document of the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows, held = [], 0
                for row in read_file(content.as_py()):
                    rows.append(row)
                    held += len(row[2])
                    if held > 1 << 22:
                        yield out(file, rows)
                        rows, held = [], 0
                if rows:
                    yield out(file, rows)

    def out(file: str, rows: list[tuple]) -> pa.RecordBatch:
        ids, at, data = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array([file] * len(rows)), pa.array(ids, pa.int64()), pa.array(at, pa.int64()), pa.array(data, pa.binary())], ["file", "doc_id", "at", "ids"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.ids").load(folder)
    files = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    rows = files.mapInArrow(run, "file string, doc_id long, at long, ids binary")
    # one row a file
    base = written.select("file", (F.sum("n_ids").over(Window.orderBy("part", "nth")) - F.col("n_ids")).alias("base"))
    return rows.join(base, "file").select("doc_id", (F.col("base") + F.col("at")).alias("start"), "ids")


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = shared_dir(spark, "token-files")
    written = write_token_files(read_table(spark, sf_dir, "documents", "doc_id", "text"), folder, public_tokenizers.path(TOKENIZER))
    if not written.head(1):
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    rows = read_token_files(spark, folder, written)
    return rows.select("doc_id", "start", F.expr("octet_length(ids) div 4").cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))


QUERIES = {"op1_token_files": op1_token_files}
SQL: dict[str, str] = {}
