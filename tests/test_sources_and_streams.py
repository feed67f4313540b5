import io
import zipfile

from pyspark.sql import functions as F

from tessellate.functions import scalars as S
from tessellate.operators.places import global_places
from tessellate.plans.merges import merge_fields
from tessellate.plans.sequences import c1_fixed_windows
from tessellate.sources import office
from tessellate.streaming import limits

W = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def archive(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    return out.getvalue()


def test_cells_of_office_files(spark, tmp_path):
    cell = lambda t, span="": f"<w:tc>{span}<w:p><w:r><w:t>{t}</w:t></w:r></w:p></w:tc>"
    wide = '<w:tcPr><w:gridSpan w:val="2"/></w:tcPr>'
    doc = f'<w:document xmlns:w="{W}"><w:body><w:tbl><w:tr>{cell("Item")}{cell("Requirement", wide)}{cell("Page")}</w:tr><w:tr>{cell("1")}{cell("a")}{cell("b")}{cell("3")}</w:tr></w:tbl></w:body></w:document>'
    (tmp_path / "a.docx").write_bytes(archive({"word/document.xml": doc}))
    x = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    (tmp_path / "b.xlsx").write_bytes(archive({
        "xl/workbook.xml": f'<workbook {x} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="S" sheetId="1" r:id="r1"/><sheet name="H" state="hidden" sheetId="2" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="x"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/sharedStrings.xml": f"<sst {x}><si><t>Req_x0041_</t></si></sst>",
        "xl/worksheets/sheet1.xml": f'<worksheet {x}><sheetData><row r="1"><c r="B1" t="s"><v>0</v></c><c r="C1" t="b"><v>1</v></c><c r="AA1" t="e"><v>#N/A</v></c><c r="D1"><v>2.5</v></c></row></sheetData></worksheet>',
    }))
    (tmp_path / "c.docx").write_bytes(b"no archive")
    rows = office.read_cells(spark, str(tmp_path)).collect()
    got = {(r.path[-6:-5], r.row, r.col): r.text for r in rows if r.error is None}
    assert got[("a", 0, 3)] == "Page" and got[("a", 1, 2)] == "b"
    assert (got[("b", 0, 1)], got[("b", 0, 2)], got[("b", 0, 26)], got[("b", 0, 3)]) == ("ReqA", "TRUE", "", "2.5")
    assert sum(r.error is not None for r in rows) == 1
    heads = office.header_rows(office.read_cells(spark, str(tmp_path)).where("error IS NULL"), {"item": ("item",), "requirement": ("req",), "page": ("page",)}).collect()
    assert {r.columns.get("requirement") for r in heads} == {1}


def test_csv_lines(spark):
    df = spark.createDataFrame([('a"b', 1), (None, 2)], "x string, y int")
    assert [r.line for r in office.csv_text(df).collect()] == ['"a""b","1"', '"","2"']


def test_stream_equals_batch(spark, tmp_path):
    rows = [(k, t, k * 1000 + i) for k in range(3) for i, t in enumerate([0, 10, 50, 61, 62, 200])]
    df = spark.createDataFrame(rows, "key long, s long, event_id long").select("key", F.timestamp_seconds("s").alias("ts"), "event_id")
    df.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    q = limits.rate_limited(stream, 60, 2).writeStream.format("memory").queryName("limited").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = {r.event_id: (r.n, r.limited) for r in spark.table("limited").collect()}
    batch = {r.event_id: (r.n, r.limited) for r in c1_fixed_windows(df, "key", "ts", 60, 2).collect()}
    assert got == batch and got[3] == (1, False) and got[2] == (3, True)
    lease = limits.expired_leases(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in"), "30 seconds").writeStream.format("memory").queryName("leases").outputMode("append").start()
    lease.processAllAvailable()
    lease.stop()
    assert spark.table("leases").count() >= 3


def test_traps(spark):
    one = spark.range(1)
    back = one.select(S.years_back(F.to_date(F.lit("2024-02-29")), 1).alias("d"), S.number(F.lit("1,000")).alias("n"), S.number(F.lit("12abc")).alias("m"), S.half_up(F.lit(1.005), 100).alias("r"), S.named_in(F.lit("my CAT"), "AT").alias("at"), S.strict_date(F.lit("2023-02-29")).alias("no")).first()
    assert (str(back.d), back.n, back.m, back.r, back["at"], back.no) == ("2023-03-01", 1, 12, 1.0, False, None)


def test_merge_is_idempotent_and_keeps_blanks(spark):
    old = spark.createDataFrame([(1, "a", "x", 1.0, False), (2, "b", "y", None, True)], "k long, name string, seg string, v double, locked boolean")
    feed = spark.createDataFrame([(1, 1, "", "z", None), (2, 1, "bb", "z", 3.0), (3, 1, "c", "", None), (3, 2, "", "q", 4.0)], "k long, seq int, name string, seg string, v double")
    once = merge_fields(old, feed, "k", ("name", "seg"), ("v",), ("seg",)).select("k", "name", "seg", "v", "locked")
    assert sorted(tuple(r) for r in once.collect()) == [(1, "a", "z", 1.0, False), (2, "bb", "y", 3.0, True), (3, "c", "q", 4.0, False)]
    twice = merge_fields(once, feed, "k", ("name", "seg"), ("v",), ("seg",)).select("k", "name", "seg", "v", "locked")
    assert sorted(twice.collect()) == sorted(once.collect())


def test_global_places(spark):
    df = spark.range(1000).select(((F.col("id") * 37) % 100).alias("a"), "id").repartition(7)
    rows = sorted(global_places(df, F.desc("a"), F.col("id")).collect(), key=lambda r: r.place)
    assert [r.place for r in rows] == list(range(1, 1001)) and [(-r.a, r.id) for r in rows] == sorted((-r.a, r.id) for r in rows)
