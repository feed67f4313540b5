import pytest

from tessellate.llm import warc


def test_round_trip_with_revisits_and_damage(spark, tmp_path):
    big = "<p>ä</p>" * 40
    rows = [(5, "http://a/%0A\nb", big), (2, None, big), (9, "u", big), (9, "u", big), (1, "e", ""), (3, "e", None), (4, "s", "short"), (6, "s", "short"), (None, "n", big), (7, "x", "y" * 300_000)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, payload int")
    folder = f"file://{tmp_path}/w"
    written = warc.write_archives(warc.with_roles(pages), folder)
    got = warc.read_archives(spark, folder, written).collect()
    assert len(got) == len(rows)
    first = {r.page_id: r for r in got}
    assert first[2].record_type == "response" and bytes(first[2].payload).decode() == big
    assert [first[i].refers_to for i in (5, 9, None, 1, 3, 4, 6, 7)] == [2, 2, 2, None, None, None, None, None]
    assert first[5].url == "http://a/%0A\nb" and first[5].payload_bytes == len(big.encode()) and first[3].payload_bytes == 0
    file = next(p for p in (tmp_path / "w").iterdir() if p.suffix == ".zst")
    data = file.read_bytes()
    assert all(warc.parse_record(x) for x in warc.read_frames(data))
    with pytest.raises(Exception):
        list(warc.read_frames(data[:-9]))
    good = warc.record(1, "u", b"abc", warc.hashlib.sha256(b"abc").hexdigest(), None)
    for bad in (good[:-1], good.replace(b"abc", b"abd"), good.replace(b"WARC/1.1", b"WARC/9.9"), good.replace(b"WARC-Date", b"WARC-Data"), good.replace(b"urn:page", b"urn:pag")):
        with pytest.raises(ValueError):
            warc.parse_record(bad)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert warc.op5_warc(spark, str(tmp_path)).count() == 0
