"""Workbooks and CSV files as a Spark sink: each task streams whole files, a driver commit publishes them.

Rows come as (book, sheet, line): a book is one file, its lines are rows of cells that Spark has already written
as text. Rows of a book meet in one task in their order, so a file of any length streams through it. Files grow
in a staging folder beside the target; only when every task is done does the commit move them to their names,
and an abort removes the folder: a failed job leaves nothing, and a retried task's first file is dropped with it.
"""

from __future__ import annotations

import uuid
import zipfile
from dataclasses import dataclass
from xml.sax.saxutils import quoteattr

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

#: Rows of a sheet, characters of a sheet's name and what it can't hold, the day before serial day 1.
MOST_ROWS, NAME_LENGTH, DAY_ZERO = 1_048_576, 31, "1899-12-30"
NOT_IN_NAMES = r"[\\/*?:\[\]]"
#: number formats of cells, by the style's number
FORMATS = ("General", "#,##0.00", "yyyy-mm-dd")
_X = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
_R = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_P = "http://schemas.openxmlformats.org/package/2006"
_XML = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'


def text_cell(text: Column) -> Column:
    """A cell with text; null is an empty cell. What XML can't hold is left out, line breaks become references."""
    out = F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F￾￿]", "")
    out = F.regexp_replace(out, r"_(?=x[0-9A-Fa-f]{4}_)", "_x005F_")
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\r", "&#13;"), ("\n", "&#10;")):
        out = F.replace(out, F.lit(sign), F.lit(name))
    return F.coalesce(F.concat(F.lit('<c t="inlineStr"><is><t xml:space="preserve">'), out, F.lit("</t></is></c>")), F.lit("<c/>"))


def number_cell(value: Column, style: int = 0) -> Column:
    return F.coalesce(F.concat(F.lit(f'<c s="{style}"><v>'), value.cast("string"), F.lit("</v></c>")), F.lit("<c/>"))


def date_cell(day: Column) -> Column:
    return number_cell(F.datediff(day, F.to_date(F.lit(DAY_ZERO))), 2)


def sheet_rows(rows: DataFrame, book: Column, number: int, name: str | Column, order: list[Column], cells: dict[str, Column]) -> DataFrame:
    """(book, number, sheet, place, line) of a sheet: a header in each book that has rows, then the rows, ascending by the order columns."""
    name = F.lit(name) if isinstance(name, str) else name
    sheet = F.substring(F.regexp_replace(name, NOT_IN_NAMES, " "), 1, NAME_LENGTH)
    line = F.concat(F.lit("<row>"), *cells.values(), F.lit("</row>"))
    place = F.row_number().over(Window.partitionBy("book", "sheet").orderBy(*[f"o{i}" for i in range(len(order))]))
    keyed = rows.select(book.cast("string").alias("book"), sheet.alias("sheet"), line.alias("line"), *[o.alias(f"o{i}") for i, o in enumerate(order)])
    body = keyed.select("book", F.lit(number).alias("number"), "sheet", place.alias("place"), "line")
    head = F.concat(F.lit("<row>"), *[text_cell(F.lit(h)) for h in cells], F.lit("</row>"))
    return body.unionByName(keyed.select("book", "sheet").distinct().select("book", F.lit(number).alias("number"), "sheet", F.lit(0).alias("place"), head.alias("line")))


def write_books(rows: DataFrame, path: str, kind: str = "xlsx", head: str = "") -> None:
    """Rows (book, number, sheet, place, line) to one file a book below path (a URI); slashes in a book's name become underscores. csv has no sheets; its head stands above the lines."""
    rows.sparkSession.dataSource.register(Export)
    placed = rows.repartition("book").sortWithinPartitions("book", "number", "sheet", "place")
    placed.select("book", "sheet", "line").write.format(Export.name()).mode("append").option("path", path).option("kind", kind).option("head", head).save()


def joined_sheets(cells: DataFrame) -> DataFrame:
    """Cells (part, row, ...) read back, with the sheets that a full one went on in joined to it: their rows follow, their headers go.

    For books whose own sheets have names of at most 24 characters that don't end like ' (2)'."""
    k = F.coalesce(F.expr(r"try_cast(regexp_extract(part, ' \\(([0-9]+)\\)$', 1) AS int)"), F.lit(1))
    rows = cells.withColumn("_k", k).where("_k = 1 OR row > 0")
    return rows.withColumns({"part": F.regexp_replace("part", r" \([0-9]+\)$", ""), "row": (F.col("row") + (F.col("_k") - 1) * (MOST_ROWS - 1)).cast("int")}).drop("_k")


class Export(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tessellate_export"

    def schema(self) -> str:
        return "book string, sheet string, line string"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return ExportWriter(self.options)


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]


class ExportWriter(DataSourceArrowWriter):
    def __init__(self, options: dict):
        self.path, self.kind, self.head = options["path"].rstrip("/"), options["kind"], options.get("head", "")
        self.staging = f"{self.path}/_staging-{uuid.uuid4().hex}"

    def _at(self, uri: str):
        from pyarrow import fs

        return fs.FileSystem.from_uri(uri)

    def write(self, iterator) -> Written:
        files, book, out = [], None, None
        for batch in iterator:
            for name, sheet, line in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None or name != book:
                    if out:
                        out.close()
                    # the attempt's own folder, so that two attempts never write one file
                    folder = f"{self.staging}/{uuid.uuid4().hex}"
                    system, where = self._at(folder)
                    system.create_dir(where, recursive=True)
                    file = f"{name.replace('/', '_')}.{self.kind}"
                    stream = system.open_output_stream(f"{where}/{file}", compression=None)
                    out, book = (Workbook if self.kind == "xlsx" else Csv)(stream, self.head), name
                    files.append((folder, file))
                out.add(sheet, line)
        if out:
            out.close()
        return Written(files)

    def commit(self, messages: list) -> None:
        for m in messages:
            for folder, file in m.files if m else ():
                # a file's name may hold what a URI can't
                system, where = self._at(folder)
                system.move(f"{where}/{file}", f"{self._at(self.path)[1]}/{file}")
        self._clear()

    def abort(self, messages: list) -> None:
        self._clear()

    def _clear(self) -> None:
        system, where = self._at(self.staging)
        from pyarrow import fs

        if system.get_file_info(where).type != fs.FileType.NotFound:
            system.delete_dir(where)


class Csv:
    """A byte-order mark, the head, and CRLF between lines but none at the end."""

    def __init__(self, stream, head: str):
        self.stream = stream
        stream.write(("﻿" + head).encode())

    def add(self, sheet: str, line: str) -> None:
        self.stream.write(("\r\n" + line).encode())

    def close(self) -> None:
        self.stream.close()


class Workbook:
    """A workbook that is written row by row; a sheet that is full goes on in another one."""

    def __init__(self, stream, head: str):
        self.stream, self.zip = stream, zipfile.ZipFile(stream, "w", zipfile.ZIP_DEFLATED)
        self.names: list[str] = []
        self.of = self.file = self.first = None
        self.rows = 0

    def add(self, sheet: str, line: str) -> None:
        if self.file is None or sheet != self.of:
            self._open(sheet, sheet)
            self.first = line
        elif self.rows == MOST_ROWS:
            k = sum(n == sheet or n.startswith(f"{sheet[:24]} (") for n in self.names) + 1
            self._open(sheet, f"{sheet[:24]} ({k})")
            self._put(self.first)
        self._put(line)

    def _put(self, line: str) -> None:
        self.file.write(line.encode())
        self.rows += 1

    def _open(self, sheet: str, name: str) -> None:
        self._end()
        self.names.append(name)
        self.of, self.rows = sheet, 0
        self.file = self.zip.open(f"xl/worksheets/sheet{len(self.names)}.xml", "w", force_zip64=True)
        self.file.write(f'{_XML}<worksheet {_X}><sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" activePane="bottomLeft" state="frozen"/></sheetView></sheetViews><sheetData>'.encode())

    def _end(self) -> None:
        if self.file:
            self.file.write(b"</sheetData></worksheet>")
            self.file.close()
            self.file = None

    def close(self) -> None:
        self._end()
        n = range(1, len(self.names) + 1)
        sheet_type = "application/vnd.openxmlformats-officedocument.spreadsheetml"
        types = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{sheet_type}.worksheet+xml"/>' for i in n)
        formats = "".join(f'<numFmt numFmtId="{164 + i}" formatCode={quoteattr(f)}/>' for i, f in enumerate(FORMATS))
        styles = "".join(f'<xf numFmtId="{164 + i}" fontId="0" fillId="0" borderId="0" xfId="0" applyNumberFormat="1"/>' for i in range(len(FORMATS)))
        parts = {
            "[Content_Types].xml": f'<Types xmlns="{_P}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{sheet_type}.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{sheet_type}.styles+xml"/>{types}</Types>',
            "_rels/.rels": f'<Relationships xmlns="{_P}/relationships"><Relationship Id="r1" Type="{_R}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
            "xl/workbook.xml": f'<workbook {_X} xmlns:r="{_R}"><sheets>' + "".join(f'<sheet name={quoteattr(name)} sheetId="{i}" r:id="s{i}"/>' for i, name in zip(n, self.names)) + "</sheets></workbook>",
            "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{_P}/relationships">' + "".join(f'<Relationship Id="s{i}" Type="{_R}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in n) + f'<Relationship Id="styles" Type="{_R}/styles" Target="styles.xml"/></Relationships>',
            "xl/styles.xml": f'<styleSheet {_X}><numFmts count="{len(FORMATS)}">{formats}</numFmts><fonts count="1"><font/></fonts><fills count="2"><fill/><fill><patternFill patternType="gray125"/></fill></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="{len(FORMATS)}">{styles}</cellXfs></styleSheet>',
        }
        for name, text in parts.items():
            self.zip.writestr(name, _XML + text)
        self.zip.close()
        self.stream.close()
