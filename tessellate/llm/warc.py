"""Web archives: one Zstandard frame per WARC record, with a shared dictionary in a leading skippable frame.

Writing: payload digests are hashed by Spark, the smallest page_id of each payload of at least
`min_revisit` bytes becomes its response and the other pages revisit it; each partition is written to one
or more archives in the shared folder. Reading: Spark's binaryFile source, then the dictionary is loaded
from the skippable frame, each frame is decoded alone, and headers, lengths and digests are validated.

Defined results: null html is an empty payload; repeated rows of the response's page_id are responses
too; a null page_id stays null and is a response only if no page of its payload has an id; a null url has
no target header; an empty table writes no archive; other input columns are ignored. A record that is not
well formed raises ValueError.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, open_output, read_table, shared_dir

MIN_REVISIT, DICTIONARY_BYTES, SAMPLE_BYTES, ROLL_BYTES = 100, 32_768, 1 << 20, 128 << 20
SHARES = 32
SKIPPABLE, ZSTD_MAGIC = 0x184D2A5D, b"\x28\xb5\x2f\xfd"


def with_roles(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """page_id, url, html, payload_digest, refers_to (null for responses).

    The roles come from ids and digests alone; bodies move once, by page, so pages that share a payload stay spread."""
    body = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select("page_id", "url", body.alias("html"), F.sha2(body.cast("binary"), 256).alias("payload_digest"))
    long = rows.where(F.octet_length("html") >= min_revisit).select("page_id", "payload_digest")
    first = long.groupBy("payload_digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1")
    # a payload's pages are dealt to shares, so that a common one doesn't meet in one task
    dealt = first.select("payload_digest", "refers_to", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))).alias("share"))
    met = long.withColumn("share", F.pmod(F.xxhash64("page_id"), F.lit(SHARES)).cast("int")).join(dealt, ["payload_digest", "share"])
    revisits = met.where(~F.col("refers_to").eqNullSafe(F.col("page_id"))).select(F.col("page_id").alias("of"), F.col("payload_digest").alias("same"), "refers_to").distinct()
    joined = rows.join(revisits, F.col("page_id").eqNullSafe(F.col("of")) & (F.col("payload_digest") == F.col("same")), "left")
    return joined.select("page_id", "url", "html", "payload_digest", "refers_to")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """The fields of exactly one record; ValueError if anything about it is wrong."""
    head, sep, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not sep or lines[0] != "WARC/1.1":
        raise ValueError("no WARC header")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    for need in ("WARC-Type", "WARC-Record-ID", "WARC-Date", "WARC-Payload-Digest", "Content-Length"):
        if need not in fields:
            raise ValueError(f"no {need}")
    size = int(fields["Content-Length"])
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError("Content-Length is wrong")
    http, sep, payload = rest[:size].partition(b"\r\n\r\n")
    length = re.search(rb"(?:^|\r\n)Content-Length: (\d+)(?:\r\n|$)", http)
    if not sep or not length:
        raise ValueError("no HTTP header")
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha256:")
    ids = {k: re.fullmatch(r"<urn:page:(-?\d*)>", fields[k]) for k in ("WARC-Record-ID", "WARC-Refers-To") if k in fields}
    if not all(ids.values()) or not re.fullmatch("[0-9a-f]{64}", digest) or kind not in ("response", "revisit") or (kind == "revisit") != ("WARC-Refers-To" in ids):
        raise ValueError("a header is malformed")
    if kind == "response" and (len(payload) != int(length[1]) or hashlib.sha256(payload).hexdigest() != digest) or kind == "revisit" and payload:
        raise ValueError("the payload is not what its headers say")
    url = fields.get("WARC-Target-URI")
    return {
        "page_id": int(ids["WARC-Record-ID"][1]) if ids["WARC-Record-ID"][1] else None,
        "url": url and url.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%"),
        "record_type": kind,
        "refers_to": int(ids["WARC-Refers-To"][1]) if kind == "revisit" else None,
        "payload_bytes": int(length[1]),
        "payload_digest": digest,
        "payload": payload if kind == "response" else None,
    }


def dictionary_of(samples: list[bytes]):
    import zstandard

    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples)
    except zstandard.ZstdError:  # too few samples to train on: their own bytes serve
        return zstandard.ZstdCompressionDict(b"".join(samples)[:DICTIONARY_BYTES] or b"WARC/1.1", dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def write_archives(rows: DataFrame, folder: str) -> DataFrame:
    """Writes rows of with_roles(); one row (file, n_records) for each archive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        def records() -> Iterator[bytes]:
            for b in batches:
                for page_id, url, html, digest, refers in zip(*(c.to_pylist() for c in b.columns)):
                    yield record(page_id, url, html.encode(), digest, refers)

        source, done = records(), False
        while not done:
            head, size = [], 0
            for x in source:
                head.append(x)
                size += len(x)
                if size >= SAMPLE_BYTES:
                    break
            else:
                done = True
            if not head:
                break
            dictionary = dictionary_of(head)
            packed = zstandard.ZstdCompressor(level=3, write_checksum=True, write_content_size=True, dict_data=dictionary)
            raw = zstandard.compress(dictionary.as_bytes())
            file, n, written = f"{uuid.uuid4().hex}.warc.zst", 0, 0
            with open_output(f"{folder}/{file}") as out:
                out.write(struct.pack("<II", SKIPPABLE, len(raw)) + raw)
                for part in (head, source if not done else ()):
                    for x in part:
                        frame = packed.compress(x)
                        out.write(frame)
                        n, written = n + 1, written + len(frame)
                        if part is source and written >= ROLL_BYTES:
                            break
                    else:
                        done = done or part is source
            yield pa.RecordBatch.from_pydict({"file": [file], "n_records": [n]})

    return materialize(rows.select("page_id", "url", "html", "payload_digest", "refers_to").mapInArrow(run, "file string, n_records long"), "archive-index")


def read_frames(content: bytes) -> Iterator[bytes]:
    """The records of an archive: the dictionary from its leading skippable frame, then a frame at a time."""
    import zstandard

    magic, size = struct.unpack_from("<II", content)
    if magic != SKIPPABLE:
        raise ValueError("no dictionary frame")
    raw = content[8 : 8 + size]
    raw = zstandard.decompress(raw) if raw[:4] == ZSTD_MAGIC else raw
    decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
    view, at = memoryview(content), 8 + size
    while at < len(view):
        frame, parts = decoder.decompressobj(), []
        while not frame.eof:
            piece = view[at : at + 16384]
            if not len(piece):
                raise ValueError("the last frame is cut off")
            parts.append(frame.decompress(piece))
            at += len(piece) - len(frame.unused_data)
        yield b"".join(parts)


READ_SCHEMA = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def read_archives(spark: SparkSession, folder: str, written: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the archives that `written` names; payload is null for revisits, or without payloads."""
    types = pa.schema([("file", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows, held = [], 0
                for data in read_frames(content.as_py()):
                    row = parse_record(data) | {"file": file}
                    if not payloads:
                        row["payload"] = None
                    rows.append(row)
                    held += 200 + len(row["payload"] or b"")
                    if held > 1 << 22:
                        yield pa.RecordBatch.from_pylist(rows, types)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, types)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
    files = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    return files.mapInArrow(run, f"file string, {READ_SCHEMA}").join(written.select("file"), "file", "left_semi").drop("file")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark, "archives")
    written = write_archives(with_roles(read_table(spark, sf_dir, "pages", "page_id", "url", "html")), folder)
    if not written.head(1):
        return spark.createDataFrame([], READ_SCHEMA).drop("payload", "url")
    return read_archives(spark, folder, written, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op5_warc": op5_warc}
SQL = {
    "op5_warc": """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY d) END AS f FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, d AS payload_digest, CASE WHEN f IS NULL OR f = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN f IS DISTINCT FROM page_id THEN f END AS refers_to FROM f"""
}
