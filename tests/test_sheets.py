"""Workbooks written by all tasks and assembled as streams."""

import hashlib
import zipfile
import zlib
from datetime import date, datetime

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pelagia.sources.sheets import HEAD, Files, Packed, deflated, joined, replace_sheet, write_sheets
from pelagia.sources.xlsx import parse_sheet, read_xlsx, sheet_names, workbook, write_bytes


def test_long_tables_go_on_in_further_sheets(spark, tmp_path):
    df = spark.range(0, 1003, 1, 5).select("id", (F.col("id") / 7).alias("x"), F.concat(F.lit("<a> & "), "id").alias("t<&"))
    names = write_sheets(spark, f"{tmp_path}/b.xlsx", {"all": df, "few": df.limit(3), "none": df.where("false")}, most=300, part=90)
    assert names[0] == "all" and names[-2:] == ["few", "none"] and len(names) == 6 and sheet_names((tmp_path / "b.xlsx").read_bytes()) == names
    rows = [r for n in names[:-2] for r in read_xlsx(spark, f"{tmp_path}/b.xlsx", n, seq="k").orderBy("k").collect()]
    assert [(r["id"], r["x"], r["t<&"]) for r in rows] == [(float(k), k / 7, f"<a> & {k}") for k in range(1003)]
    assert all(len(list(parse_sheet((tmp_path / "b.xlsx").read_bytes(), n))) <= 300 for n in names)
    assert list(parse_sheet((tmp_path / "b.xlsx").read_bytes(), "none")) == [["id", "x", "t<&"]]


def test_every_type_of_cell(spark, tmp_path):
    at = datetime(2021, 2, 3, 4, 5, 6, 789000)
    ddl = "a int, b double, c boolean, d date, e timestamp_ntz, f string, g decimal(9,2), h array<int>"
    rows = [(1, 0.1, True, at.date(), at, "x\ny\x01", None, [1, 2]), (None, float("nan"), None, None, None, None, None, None), (-2, 1e-300, False, date(1900, 1, 1), datetime(1900, 3, 1), "  ", None, [])]
    write_sheets(spark, f"{tmp_path}/b.xlsx", {"s": spark.createDataFrame(rows, ddl).coalesce(1)})
    got = list(parse_sheet((tmp_path / "b.xlsx").read_bytes()))
    assert got[1] == [1.0, 0.1, True, datetime(2021, 2, 3), at, "x\ny", None, "[1, 2]"] and got[2] == [None] * 8
    assert got[3] == [-2.0, 1e-300, False, datetime(1900, 1, 1), datetime(1900, 3, 1), "  ", None, "[]"]


def test_replacing_a_sheet_leaves_the_others(spark, tmp_path):
    path = f"{tmp_path}/b.xlsx"
    write_bytes(spark, path, workbook({"one": [["k"], [1]], "two": [["k"], ["old"]], "three": [["k"], [datetime(2020, 1, 1)]]}))
    digest = lambda: {n: hashlib.sha256(zipfile.ZipFile(path).read(n)).hexdigest() for n in zipfile.ZipFile(path).namelist()}
    before = digest()
    replace_sheet(spark, path, "two", spark.range(5).toDF("fresh"), part=2)
    after = digest()
    assert {n for n in before if before[n] != after[n]} == {"xl/worksheets/sheet2.xml"} and before.keys() == after.keys()
    assert list(parse_sheet((tmp_path / "b.xlsx").read_bytes(), "two")) == [["fresh"], *[[float(k)] for k in range(5)]]
    with pytest.raises(KeyError):
        replace_sheet(spark, path, "four", spark.range(1).toDF("k"))
    with pytest.raises(ValueError, match="don't fit"):
        replace_sheet(spark, path, "one", spark.range(5).toDF("k"), most=5)
    assert digest() == after


def test_many_rows(spark, tmp_path):
    n = write_sheets(spark, f"{tmp_path}/b.xlsx", {"mesh": spark.range(0, 1_200_000, 1, 8).select("id", (F.col("id") * 0.5).alias("x"))})
    assert n == ["mesh", "mesh (2)"]
    with zipfile.ZipFile(tmp_path / "b.xlsx") as z:
        assert sum(z.read(f"xl/worksheets/sheet{k}.xml").count(b"<row>") for k in (1, 2)) == 1_200_002


def test_parts_beyond_a_thousand_keep_their_order(spark, tmp_path):
    write_sheets(spark, f"{tmp_path}/b.xlsx", {"s": spark.range(0, 2100, 1, 1).toDF("k")}, part=2)
    assert [r[0] for r in parse_sheet((tmp_path / "b.xlsx").read_bytes())] == ["k", *map(float, range(2100))]


def test_tasks_deflate_and_long_texts_end_a_part(spark, tmp_path, monkeypatch):
    """The driver copies packed bytes only, far fewer than the XML; a part ends by rows or by packed bytes."""
    copied = []
    copy = Files.copy
    monkeypatch.setattr(Files, "copy", lambda self, source, target, length: (copied.append(length), copy(self, source, target, length))[1])
    write_sheets(spark, f"{tmp_path}/b.xlsx", {"s": spark.range(0, 20_000, 1, 2).select(F.repeat(F.lit("long text "), 20).alias("t"), "id")})
    with zipfile.ZipFile(tmp_path / "b.xlsx") as z:
        assert len(copied) == 2 and sum(copied) < z.getinfo("xl/worksheets/sheet1.xml").file_size / 20 and z.testzip() is None
    rows = pa.array([bytes([k]) * 3 + b"x" for k in range(10)]).slice(1).cast(pa.string())
    monkeypatch.setattr("pelagia.sources.sheets.PACKED", 1 << 30)
    whole = [HEAD.unpack(b["value"][0].as_py()[: HEAD.size]) for b in deflated(iter([pa.record_batch([rows], ["value"])] * 2), 4)]
    assert [h[0] for h in whole] == [4, 4, 4, 4, 2] and [h[2] for h in whole] == [16, 16, 16, 16, 8]
    monkeypatch.setattr("pelagia.sources.sheets.PACKED", 0)
    small = [b["value"][0].as_py() for b in deflated(iter([pa.record_batch([rows], ["value"])] * 2), 6)]
    assert [HEAD.unpack(p[: HEAD.size])[0] for p in small] == [6, 3, 6, 3]
    xml = zlib.decompressobj(wbits=-15).decompress(b"".join(p[HEAD.size :] for p in small))
    assert xml == b"".join(v.as_py().encode() for v in rows) * 2


def test_checksums_of_joined_pieces():
    for a, b in ((b"", b""), (b"a", b""), (b"", b"b"), (b"first ", b"second"), (b"\0" * 70_000, bytes(range(256)) * 999)):
        assert joined(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


def test_directory_of_a_zip_beyond_4_gb(tmp_path):
    """As a file whose first 5 GB are cut off, which Python's reader makes up for."""

    class Local:
        def create(self, name):
            return open(name, "wb")

    out = Packed(Local(), f"{tmp_path}/far.zip")
    out.at = 5 << 30
    out.put("é.xml", b"text")
    out.begin("long.xml", zipfile.ZIP_STORED, 0, 6 << 30, 6 << 30)
    out.close()
    with zipfile.ZipFile(tmp_path / "far.zip") as z:
        assert [(e.filename, e.file_size, e.compress_size) for e in z.infolist()] == [("é.xml", 4, 6), ("long.xml", 6 << 30, 6 << 30)]
        assert z.read("é.xml") == b"text"
