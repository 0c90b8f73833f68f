"""Dates and times of workbooks: formats, epochs and cells."""

from datetime import date, datetime, time

import pytest

from pelagia.sources import xlsx


@pytest.mark.parametrize("code, kind", [("yyyy-mm-dd", "date"), ("mmm-yy", "date"), ("mm", "date"), ("h:mm AM/PM", "time"), ("mm:ss.0", "time"), ("[h]:mm:ss", "time"), ("dd/mm/yyyy\\ hh:mm", "date"), ("0.00", ""), ('0.0 "days"', ""), ("[Red]0.00;[Blue]-0", ""), ("#,##0_d", ""), ("General", "") , ("0.0E+00", ""), ("@", "")])
def test_what_a_format_shows(code, kind):
    assert xlsx.shows(code.replace("General", "")) == kind


@pytest.mark.parametrize("epoch", [xlsx.EPOCH, xlsx.EPOCH_1904])
def test_serial_numbers_there_and_back(epoch):
    first = datetime(1904, 1, 2) if epoch == xlsx.EPOCH_1904 else datetime(1900, 1, 1)
    for at in (first, datetime(1904, 2, 29, 1, 2, 3), datetime(1999, 12, 31, 23, 59, 59, 999000), datetime(2024, 2, 29)):
        assert xlsx.moment(xlsx.serial(at, epoch), "date", epoch) == at
    assert xlsx.serial(date(1900, 3, 1)) == 61 and xlsx.serial(date(1900, 2, 28)) == 59  # 60 is the day that never was
    assert xlsx.moment(0.75, "time") == time(18) and xlsx.moment(1.5, "time") == datetime(1900, 1, 1, 12)


@pytest.mark.parametrize("date1904", [False, True])
def test_cells_of_a_workbook(spark, tmp_path, date1904):
    at = datetime(2019, 7, 3, 4, 5, 6, 789000)
    rows = [["k", "at", "day", "clock", "mixed", "none"], [1, at, at.date(), at.time(), "x", None], [2, None, date(2020, 1, 1), time(23), at, None]]
    book = xlsx.workbook({"s": rows}, date1904)
    assert list(xlsx.parse_sheet(book, "s"))[1:] == [[1.0, at, datetime(2019, 7, 3), time(4, 5, 6, 789000), "x"], [2.0, None, datetime(2020, 1, 1), time(23), at]]
    xlsx.write_bytes(spark, f"{tmp_path}/a.xlsx", book)
    df = xlsx.read_xlsx(spark, f"{tmp_path}/a.xlsx", "s")
    assert [(f.name, f.dataType.simpleString()) for f in df.schema] == [("k", "double"), ("at", "timestamp_ntz"), ("day", "timestamp_ntz"), ("clock", "string"), ("mixed", "string"), ("none", "double")]
    assert [tuple(r) for r in df.orderBy("k").collect()] == [(1.0, at, datetime(2019, 7, 3), "04:05:06.789000", "x", None), (2.0, None, datetime(2020, 1, 1), "23:00:00", "2019-07-03 04:05:06.789000", None)]
    typed = xlsx.read_xlsx(spark, f"{tmp_path}/a.xlsx", "s", "day date, at double").orderBy("day").collect()
    assert [r["day"] for r in typed] == [date(2019, 7, 3), date(2020, 1, 1)] and typed[0]["at"] == pytest.approx(xlsx.serial(at)) and typed[1]["at"] is None


def test_a_sheet_too_long_is_refused(spark, monkeypatch):
    monkeypatch.setattr(xlsx, "MOST_ROWS", 10)
    with pytest.raises(ValueError, match="more than 10 rows"):
        xlsx.write_xlsx(spark, "/nowhere/a.xlsx", {"s": spark.range(10)})
