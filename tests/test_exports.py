"""Files that go out: formats, full sheets, failed jobs; and the log that runs resume from."""

import io
import os
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from tessellate.plans import books
from tessellate.sources import exports as X
from tessellate.sources import office
from tessellate.streaming import cells as C


def files(path):
    return sorted(os.path.join(d, f).removeprefix(f"{path}/") for d, _, names in os.walk(path) for f in names if not f.endswith(".crc"))


def book(spark, n):
    rows = spark.range(n).select("id", F.when(F.col("id") % 3 != 0, F.concat(F.lit("<&\n\x01_x0041_ ใบ "), F.col("id").cast("string"))).alias("text"), F.date_add(F.to_date(F.lit("2024-02-28")), F.col("id").cast("int")).alias("day"))
    return X.sheet_rows(rows, F.concat(F.lit("b "), F.col("id") % 2), 0, "A/b: c", [-F.col("id")], {"No": X.number_cell(F.col("id")), "Text": X.text_cell(F.col("text")), "Day": X.date_cell(F.col("day"))})


def test_workbooks_read_back(spark, tmp_path):
    X.write_books(book(spark, 9), f"file://{tmp_path}/out")
    assert files(f"{tmp_path}/out") == ["b 0.xlsx", "b 1.xlsx"]
    got = {(re.search(r"b(?: |%20)(\d)", r.path)[1], r.row, r.col): (r.part, r.text) for r in office.read_cells(spark, f"{tmp_path}/out").collect()}
    assert {v[0] for v in got.values()} == {"A b  c"}
    assert [got["1", 0, c][1] for c in range(3)] == ["No", "Text", "Day"]
    assert [got["1", r, 0][1] for r in range(1, 5)] == ["7", "5", "3", "1"]
    assert got["1", 1, 1][1] == "<&\n_x0041_ ใบ 7" and got["1", 3, 1][1] == "" and got["0", 5, 2][1] == str(45350)


def test_a_full_sheet_goes_on_in_another(monkeypatch):
    monkeypatch.setattr(X, "MOST_ROWS", 4)
    out = io.BytesIO()
    out.close, keep = (lambda: None), out
    w = X.Workbook(out, "")
    for i in range(9):
        w.add("S", f'<row><c t="inlineStr"><is><t>{"head" if i == 0 else i}</t></is></c></row>')
    w.close()
    got = {}
    for sheet, row, _, text in office.xlsx_cells(keep.getvalue()):
        got.setdefault(sheet, []).append(text)
    assert got == {"S": ["head", "1", "2", "3"], "S (2)": ["head", "4", "5", "6"], "S (3)": ["head", "7", "8"]}


def test_sheets_of_any_length_are_read(spark, tmp_path, monkeypatch):
    X.write_books(book(spark, 400).where("book = 'b 0'"), f"file://{tmp_path}/out")
    content = (tmp_path / "out" / "b 0.xlsx").read_bytes()
    whole = list(office.xlsx_cells(content))
    # less than the sheet, more than each part that is read whole
    monkeypatch.setattr(office, "MOST_BYTES", 5_000)
    assert len(whole) == 201 * 3 and list(office.xlsx_cells(content)) == whole
    monkeypatch.setattr(office, "MOST_BYTES", 100)
    with pytest.raises(ValueError, match="too large"):
        list(office.xlsx_cells(content))


def test_a_file_damaged_at_its_end_gives_its_error_alone(spark, tmp_path):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {X._X} xmlns:r="{X._R}"><sheets><sheet name="S" sheetId="1" r:id="s1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{X._P}/relationships"><Relationship Id="s1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {X._X}><sheetData>" + "<row><c><v>1</v></c></row>" * 50_000 + "<row><c>")
    (tmp_path / "a.xlsx").write_bytes(out.getvalue())
    got = office.read_cells(spark, str(tmp_path)).collect()
    assert [(r.part, r.row, r.text) for r in got] == [(None, None, None)] and got[0].error


def test_full_sheets_are_joined_again(spark, monkeypatch):
    monkeypatch.setattr(X, "MOST_ROWS", 4)
    out = io.BytesIO()
    out.close = lambda: None
    w = X.Workbook(out, "")
    for sheet in ("S", "Other (x)"):
        for i in range(9):
            w.add(sheet, f'<row><c t="inlineStr"><is><t>{"head" if i == 0 else i}</t></is></c></row>')
    w.close()
    cells = spark.createDataFrame(list(office.xlsx_cells(out.getvalue())), "part string, row int, col int, text string")
    want = [(s, i, "head" if i == 0 else str(i)) for s in ("Other (x)", "S") for i in range(9)]
    assert sorted((r.part, r.row, r.text) for r in X.joined_sheets(cells).collect()) == want


def test_a_book_that_cannot_be_read_stops_the_run(spark, tmp_path):
    (tmp_path / "a.xlsx").write_bytes(b"no archive")
    with pytest.raises(Exception, match="zip"):
        books._read_back(spark, str(tmp_path)).collect()


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    path = f"{tmp_path}/out"
    X.write_books(book(spark, 4), f"file://{path}")
    before = files(path)
    bad = book(spark, 400).withColumn("line", F.when((F.col("place") == 150) & (F.col("book") == "b 1"), F.raise_error(F.lit("damaged"))).otherwise(F.col("line")))
    with pytest.raises(Exception):
        X.write_books(bad.withColumn("book", F.concat(F.lit("z"), "book")), f"file://{path}")
    assert files(path) == before and not [d for d in os.listdir(path) if d.startswith("_staging")]
    X.write_books(book(spark, 0), f"file://{path}")
    assert files(path) == before


def test_the_log_survives_a_stop_between_batches(spark, tmp_path):
    source, log = f"{tmp_path}/in", f"{tmp_path}/log"
    cells = [[("d", 1, r, c) for r in range(4) for c in range(3)], [("d", 1, r, c) for r in range(2, 6) for c in range(3)] * 2, [("e", 2, 0, c) for c in range(5)]]
    for i, part in enumerate(cells):
        spark.createDataFrame(part, "doc string, page int, row int, col int").coalesce(1).write.parquet(f"{source}/{i}")
        os.utime(f"{source}/{i}", (i, i))
    reads, stops = [], {1, 2}

    def read(fresh):
        reads.append(fresh.count())
        return fresh.withColumn("text", F.when(F.col("col") != 1, F.concat_ws("/", *C.KEYS)))

    def run():
        append = C.appender(log, read)

        def batch(df, number):
            append(df, number)
            if number in stops:
                stops.remove(number)
                # the batch is written, but the run stops before it is committed, and a line is torn
                part = next(f for f in files(f"{log}/batch={number}") if f.endswith(".json"))
                with open(f"{log}/batch={number}/{part}", "a") as f:
                    f.write('{"doc": "d", "page": 1, "ro')
                os.remove(f"{log}/batch={number}/.{part}.crc")
                raise RuntimeError("stopped")

        stream = spark.readStream.schema("doc string, page int, row int, col int").option("maxFilesPerTrigger", 1).parquet(f"{source}/*")
        q = stream.writeStream.foreachBatch(batch).option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        q.awaitTermination(120)

    for _ in range(2):
        with pytest.raises(Exception):
            run()
    run()
    keys = {c for part in cells for c in part}
    lines = spark.read.schema("value string").text(f"{log}/batch=*").count()
    got = C.read_log(spark, log).collect()
    assert {(r.doc, r.page, r.row, r.col) for r in got} == keys and lines == len(got) == len(keys)
    assert all(r.text == (None if r.col == 1 else f"{r.doc}/{r.page}/{r.row}/{r.col}") for r in got)
    assert C.wanted(spark.createDataFrame([("d", 1, 0, 0), ("new", 1, 1, 1)], "doc string, page int, row int, col int"), log).collect()[0].doc == "new"
    # what another batch holds is not read again
    assert sum(reads) < sum(map(len, cells)) + 20 and C.read_log(spark, f"{tmp_path}/none").count() == 0
