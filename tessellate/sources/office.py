"""Tables out of DOCX and XLSX files, and a CSV sink.

Files come through Spark's binaryFile source; each is unpacked by a small reader inside a task. Sheets are read row by
row, so that a workbook of any length takes no more memory than its compressed bytes."""

from __future__ import annotations

import io
import re
import tempfile
import zipfile
from collections.abc import Iterator
from itertools import islice
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of what is read whole (not of sheets), cells of a batch, bytes of a file's cells held in memory before they go to disk.
MOST_BYTES, BATCH_CELLS, HELD_BYTES = 200 << 20, 20_000, 16 << 20
CELLS = pa.schema([("path", pa.string()), ("part", pa.string()), ("row", pa.int32()), ("col", pa.int32()), ("text", pa.string()), ("error", pa.string())])
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
X = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def unpack(content: bytes) -> zipfile.ZipFile:
    z = zipfile.ZipFile(io.BytesIO(content))
    if any(i.flag_bits & 1 for i in z.infolist()):
        raise ValueError("the archive is encrypted")
    return z


def _part(z: zipfile.ZipFile, name: str) -> ElementTree.Element:
    """A part of an archive that is parsed whole."""
    if z.getinfo(name).file_size > MOST_BYTES:
        raise ValueError(f"{name} is too large")
    return ElementTree.fromstring(z.read(name))


def docx_cells(content: bytes) -> Iterator[tuple[str, int, int, str]]:
    """(table, row, column, text) of the outer tables of a document; grid spans widen columns."""
    body = _part(unpack(content), "word/document.xml").find(f"{W}body")
    for t, table in enumerate(body.findall(f"{W}tbl") if body is not None else ()):
        for r, row in enumerate(table.findall(f"{W}tr")):
            skip = row.find(f"{W}trPr/{W}gridBefore")
            col = int(skip.get(f"{W}val", "0")) if skip is not None else 0
            for cell in row.findall(f"{W}tc"):
                lines = ["".join(x.text or "" for x in p.iter(f"{W}t")) for p in cell.findall(f"{W}p")]
                yield str(t), r, col, "\n".join(lines)
                span = cell.find(f"{W}tcPr/{W}gridSpan")
                col += int(span.get(f"{W}val", "1")) if span is not None else 1


def _column(ref: str) -> int:
    n = 0
    for ch in re.match("[A-Z]+", ref)[0]:
        n = n * 26 + ord(ch) - 64
    return n - 1


def _rows(z: zipfile.ZipFile, name: str) -> Iterator[ElementTree.Element]:
    """The rows of a sheet as they are parsed; each is dropped before the next."""
    with z.open(name) as stream:
        held = None
        for event, e in ElementTree.iterparse(stream, ("start", "end")):
            if event == "start":
                held = e if e.tag == f"{X}sheetData" else held
            elif e.tag == f"{X}row":
                yield e
                (e if held is None else held).clear()


def xlsx_cells(content: bytes) -> Iterator[tuple[str, int, int, str]]:
    """(sheet, row, column, text) of the visible sheets: shared and inline strings, booleans, errors as blank."""
    z = unpack(content)
    unescape = lambda s: re.sub("_x([0-9A-Fa-f]{4})_", lambda m: chr(int(m[1], 16)), s) if "_x" in s else s
    shared = []
    if "xl/sharedStrings.xml" in z.namelist():
        shared = [unescape("".join(t.text or "" for t in si.iter(f"{X}t"))) for si in _part(z, "xl/sharedStrings.xml").findall(f"{X}si")]
    targets = {r.get("Id"): r.get("Target") for r in _part(z, "xl/_rels/workbook.xml.rels")}
    for sheet in _part(z, "xl/workbook.xml").iter(f"{X}sheet"):
        if sheet.get("state", "visible") != "visible":
            continue
        row = -1
        for line in _rows(z, "xl/" + targets[sheet.get(REL)].removeprefix("/xl/")):
            # rows and cells without a reference follow the one before
            row, col = int(line.get("r", row + 2)) - 1, -1
            for c in line.findall(f"{X}c"):
                kind, v, ref = c.get("t", "n"), c.find(f"{X}v"), c.get("r")
                col = _column(ref) if ref else col + 1
                text = (v.text or "") if v is not None else ""
                if kind == "s":
                    text = shared[int(text)]
                elif kind == "inlineStr":
                    text = unescape("".join(t.text or "" for t in c.iter(f"{X}t")))
                elif kind == "b":
                    text = "TRUE" if text == "1" else "FALSE"
                elif kind == "e":
                    text = ""
                yield sheet.get("name"), row, col, text


def _batches(name: str, cells: Iterator[tuple[str, int, int, str]]) -> Iterator[pa.RecordBatch]:
    while some := list(islice(cells, BATCH_CELLS)):
        nothing = pa.nulls(len(some), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(some)), *(pa.array(c, CELLS.types[i]) for i, c in enumerate(zip(*some), 1)), nothing], schema=CELLS)


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """Long form (path, part, row, col, text) of all DOCX and XLSX files below a path; unreadable files give an `error` row.

    A file's cells are spooled until it is read to its end, so that a damaged one gives its error alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1)):
                with tempfile.SpooledTemporaryFile(HELD_BYTES) as spool:
                    try:
                        with pa.ipc.new_stream(spool, CELLS, options=pa.ipc.IpcWriteOptions(compression="lz4")) as out:
                            for rows in _batches(name, (docx_cells if name.lower().endswith(".docx") else xlsx_cells)(content.as_py())):
                                out.write_batch(rows)
                    except (ValueError, KeyError, zipfile.BadZipFile, ElementTree.ParseError) as e:
                        yield pa.RecordBatch.from_pylist([{"path": name, "error": str(e)}], CELLS)
                    else:
                        spool.seek(0)
                        yield from pa.ipc.open_stream(spool)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{docx,xlsx}").load(path)
    # a task reads many small files at once, but their cells take longer: files are dealt out by name, since
    # dealing in turn begins at like places and would put them in one task
    dealt = files.select("path", "content").repartition(16 * spark.sparkContext.defaultParallelism, "path")
    return dealt.mapInArrow(run, "path string, part string, row int, col int, text string, error string")


def header_rows(cells: DataFrame, roles: dict[str, tuple[str, ...]], deepest: int = 6) -> DataFrame:
    """Per sheet, the row among the first ones whose cells name most roles, and the column of each role.

    roles: role -> words, in order of priority; a column serves one role, the first that claims it."""
    keys = ["path", "part"]
    near = cells.where(F.col("row") < deepest)
    word = F.lower(F.trim("text"))
    role = F.coalesce(*[F.when(F.exists(F.array(*[F.lit(x) for x in words]), lambda x: F.contains(word, x)), F.lit(k)) for k, words in enumerate(roles.values())])
    named = near.withColumn("role", role).where("role IS NOT NULL").groupBy(*keys, "row", "role").agg(F.min("col").alias("col"))
    per_row = named.groupBy(*keys, "row").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct("role", "col"))).alias("c"))
    best = per_row.groupBy(*keys).agg(F.max_by(F.struct("row", "n", "c"), F.struct("n", -F.col("row"))).alias("b")).select(*keys, "b.*")
    names = F.array(*[F.lit(r) for r in roles])
    return best.select(*keys, "row", F.map_from_entries(F.transform("c", lambda x: F.struct(F.get(names, x["role"]), x["col"]))).alias("columns"))


def csv_text(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """A text column `line` beside the kept ones: every other field quoted, quotes doubled, null blank; for text sinks with CRLF line ends."""
    quoted = [F.concat(F.lit('"'), F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"')) for c in df.columns if c not in keep]
    return df.select(*keep, F.concat_ws(",", *quoted).alias("line"))
