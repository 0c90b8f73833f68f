"""Workbooks (XLSX) as DataFrames, and small results as workbooks.

Files come through Spark's binary reader, so any store that Spark reads will do,
and folders or globs of workbooks are parsed by the executors, one file a task at
a time. A sheet's cells are read as they stand: numbers, texts, truth values and
the stored results of formulas. A number whose style shows a date or a time of day is
that, in the workbook's own epoch, 1900 or 1904, to the millisecond; it has no zone.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Container, Iterator, Mapping, Sequence
from datetime import date, datetime, time, timedelta
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pelagia.session import prepare

#: Namespaces of the format (fixed values).
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
PACKAGE = "{http://schemas.openxmlformats.org/package/2006/relationships}"
#: Built-in number formats of dates, and of times of day alone (fixed values).
DATE_FORMATS = {14, 15, 16, 17, 22, *range(27, 32), 34, 35, 36, *range(50, 59)}
TIME_FORMATS = {18, 19, 20, 21, 32, 33, 45, 46, 47}
EPOCH, EPOCH_1904 = datetime(1899, 12, 30), datetime(1904, 1, 1)
#: Rows that a sheet can hold (a fixed value of the format).
MOST_ROWS = 1_048_576
#: Types of columns.
ARROW = {"double": pa.float64(), "string": pa.string(), "boolean": pa.bool_(), "timestamp_ntz": pa.timestamp("us"), "date": pa.date32()}


def shows(code: str) -> str:
    """What a number format shows of a number: "date", "time" of day, or ""; by its first section, without texts and colours."""
    plain = re.sub(r'"[^"]*"|\\.|_.|\*.|\[(?![hms]+\])[^\]]*\]', "", code.split(";")[0]).lower()
    if re.search("[yd]", plain) or "m" in plain and not re.search("[hs]", plain):
        return "date"
    return "time" if re.search("[hs]", plain) else ""


def styles_of(z: zipfile.ZipFile) -> list[str]:
    """Per cell style what it shows."""
    if "xl/styles.xml" not in z.namelist():
        return []
    root = ElementTree.fromstring(z.read("xl/styles.xml"))
    own = {int(f.get("numFmtId")): shows(f.get("formatCode") or "") for f in root.iter(f"{MAIN}numFmt")}
    cells = root.find(f"{MAIN}cellXfs")
    ids = [int(x.get("numFmtId") or 0) for x in (cells if cells is not None else ())]
    return [own.get(i, "date" if i in DATE_FORMATS else "time" if i in TIME_FORMATS else "") for i in ids]


def moment(serial: float, kind: str, epoch: datetime = EPOCH) -> datetime | time | float:
    """A serial number as date and time, or as time of day where the style shows no date and the number has no day.

    Before March 1900 the 1900 epoch counts a day less, as it has a 29 February that year.
    """
    if kind == "time" and 0 <= serial < 1:
        return (EPOCH + timedelta(milliseconds=round(serial * 86_400_000))).time()
    early = epoch == EPOCH and 0 < serial < 60
    try:
        return epoch + timedelta(days=early, milliseconds=round(serial * 86_400_000))
    except OverflowError:
        return serial


def serial(at: datetime | date | time, epoch: datetime = EPOCH) -> float:
    """The number that stands for a date or time in a workbook."""
    if isinstance(at, time):
        return (at.hour * 3600 + at.minute * 60 + at.second + at.microsecond / 1e6) / 86_400
    at = at.replace(tzinfo=None) if isinstance(at, datetime) else datetime(at.year, at.month, at.day)
    days = (at - epoch) / timedelta(days=1)
    return days - (epoch == EPOCH and days < 61)


def _text(node) -> str:
    return "".join(t.text or "" for t in node.iter(f"{MAIN}t"))


def _column(ref: str) -> int:
    """Place of a cell reference's column, from 0."""
    n = 0
    for c in re.match("[A-Z]+", ref)[0]:
        n = 26 * n + ord(c) - 64
    return n - 1


def sheets_of(z: zipfile.ZipFile) -> list[str]:
    return [s.get("name") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(f"{MAIN}sheet")]


def sheet_names(book: bytes) -> list[str]:
    with zipfile.ZipFile(io.BytesIO(book)) as z:
        return sheets_of(z)


def layouts(z: zipfile.ZipFile, wanted: Sequence[str | int]) -> list[tuple[str, list[str], datetime]]:
    """Of each sheet its entry, what the cell styles show, and the epoch. A sheet that isn't there raises KeyError."""
    book_xml = ElementTree.fromstring(z.read("xl/workbook.xml"))
    settings = book_xml.find(f"{MAIN}workbookPr")
    epoch = EPOCH_1904 if settings is not None and settings.get("date1904") in ("1", "true") else EPOCH
    sheets = list(book_xml.iter(f"{MAIN}sheet"))
    names = {s.get("name"): k for k, s in reversed(list(enumerate(sheets)))}
    targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels")).iter(f"{PACKAGE}Relationship")}
    styles, out = styles_of(z), []
    for sheet in wanted:
        if sheet not in names and not (isinstance(sheet, int) and sheet < len(sheets)):
            raise KeyError(f"no sheet '{sheet}' among {list(names)}")
        path = targets[sheets[sheet if isinstance(sheet, int) else names[sheet]].get(f"{RELATION}id")]
        out.append((path.lstrip("/") if path.startswith("/") else f"xl/{path}", styles, epoch))
    return out


def layout(z: zipfile.ZipFile, sheet: str | int) -> tuple[str, list[str], datetime]:
    return layouts(z, [sheet])[0]


def shared_strings(z: zipfile.ZipFile) -> list[str]:
    """The texts that cells refer to by place."""
    return [_text(s) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{MAIN}si")] if "xl/sharedStrings.xml" in z.namelist() else []


def stored(kind: str, value: str, style: int, shared: Sequence[str] | Mapping[int, str], styles: Sequence[str], epoch: datetime):
    """What a cell's stored value stands for, by its type and style."""
    if kind == "n":
        v = float(value)
        return moment(v, styles[style], epoch) if style < len(styles) and styles[style] else v
    return shared[int(value)] if kind == "s" else value == "1" if kind == "b" else value if kind == "str" else None if kind == "e" else datetime.fromisoformat(value).replace(tzinfo=None) if kind == "d" else float(value)


def row_of(node, shared: Sequence[str] | Mapping[int, str], styles: Sequence[str], epoch: datetime, places: Container[int] | None = None) -> list:
    """The values of a row's cells by place; None for empty ones, and for those out of ``places`` where it is given."""
    row: list = []
    for k, cell in enumerate(node.iter(f"{MAIN}c")):
        place = _column(cell.get("r")) if cell.get("r") else k
        row += [None] * (place + 1 - len(row))
        if places is not None and place not in places:
            continue
        kind, value = cell.get("t", "n"), cell.findtext(f"{MAIN}v")
        if kind == "inlineStr":
            row[place] = _text(cell)
        elif value is not None:
            row[place] = stored(kind, value, int(cell.get("s") or 0), shared, styles, epoch)
    return row


def parse_sheet(book: bytes, sheet: str | int = 0) -> Iterator[list]:
    """Rows of a sheet, by name or place, as lists; empty cells are None. A sheet that isn't there raises KeyError."""
    with zipfile.ZipFile(io.BytesIO(book)) as z:
        path, styles, epoch = layout(z, sheet)
        shared, at = shared_strings(z), 0
        with z.open(path) as f:
            for _, node in ElementTree.iterparse(f):
                if node.tag != f"{MAIN}row":
                    continue
                number = int(node.get("r") or at + 1)
                yield from ([] for _ in range(number - at - 1))  # rows that are left out are empty
                at = number
                yield row_of(node, shared, styles, epoch)
                node.clear()


def cast(v, kind: str):
    """A cell's value in a column of a type; None where it has no such value."""
    if v is None or kind == "string" and isinstance(v, str):
        return v
    if kind == "string":
        return str(int(v)) if isinstance(v, float) and v.is_integer() else str(v)
    if kind in ("timestamp_ntz", "date"):
        at = moment(v, "date") if isinstance(v, float) else v
        return None if not isinstance(at, datetime) else at.date() if kind == "date" else at
    if isinstance(v, (datetime, time)):
        return serial(v) if kind == "double" else None
    if kind == "boolean":
        return bool(v)
    try:
        return float(v)
    except ValueError:
        return None


def _named(row: list) -> list[str]:
    return [f"_c{k}" if v is None else str(int(v)) if isinstance(v, float) and v.is_integer() else str(v) for k, v in enumerate(row)]


def read_xlsx(spark: SparkSession, path: str | Sequence[str], sheet: str | int = 0, schema: str | None = None, header: bool = True, seq: str | None = None) -> DataFrame:
    """A sheet of one or more workbooks with the same columns.

    Without a schema (DDL of names and types double, string, boolean, date or
    timestamp_ntz) columns are double where every value of theirs is a number,
    timestamp_ntz where every one is a date, else string. Columns are matched
    by their header; with ``header=False`` they are _c0, _c1, ... ``seq`` names an
    extra column with the row's number in its file. Rows without any value go.
    """
    prepare(spark)
    books = spark.read.format("binaryFile").load(path if isinstance(path, str) else list(path)).select("content")

    def rows_of(book: bytes):
        rows = parse_sheet(book, sheet)
        names = _named(next(rows, [])) if header else None
        for k, row in enumerate(rows):
            if any(v is not None for v in row):
                yield k, dict(zip(names or [f"_c{i}" for i in range(len(row))], row)), names

    if schema is None:

        def kinds(batches):
            for b in batches:
                for book in b.column(0).to_pylist():
                    seen: dict[str, set] = {n: set() for n in (_named(next(parse_sheet(book, sheet), [])) if header else [])}
                    for _, row, _ in rows_of(book):
                        for n, v in row.items():
                            if v is not None:
                                seen.setdefault(n, set()).add("double" if isinstance(v, float) else "timestamp_ntz" if isinstance(v, datetime) else "string")
                    kind = ["null" if not k else "string" if len(k) > 1 else next(iter(k)) for k in seen.values()]
                    yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(range(len(seen))), pa.int32()), pa.array(kind, pa.string())], ["name", "place", "kind"])

        found = books.mapInArrow(kinds, "name string, place int, kind string").groupBy("name").agg(F.min("place").alias("place"), F.collect_set("kind").alias("kinds")).orderBy("place", "name").collect()  # one row per column
        known = {r["name"]: set(r["kinds"]) - {"null"} for r in found}
        types = {n: "double" if not k else "string" if len(k) > 1 else next(iter(k)) for n, k in known.items()}
    else:
        types = {f.name: f.dataType.simpleString() for f in spark.createDataFrame([], schema).schema}
    def run(batches):
        for b in batches:
            for book in b.column(0).to_pylist():
                cols: dict[str, list] = {n: [] for n in types}
                places: list[int] = []
                for k, row, _ in rows_of(book):
                    places.append(k)
                    for n, kind in types.items():
                        cols[n].append(cast(row.get(n), kind))
                arrays = [pa.array(cols[n], ARROW[kind]) for n, kind in types.items()]
                yield pa.RecordBatch.from_arrays(arrays + ([pa.array(places, pa.int64())] if seq else []), [*types] + ([seq] if seq else []))

    ddl = ", ".join(f"`{n}` {kind}" for n, kind in types.items()) + (f", `{seq}` bigint" if seq else "")
    return books.mapInArrow(run, ddl)


def _letters(k: int) -> str:
    out = ""
    k += 1
    while k:
        k, r = divmod(k - 1, 26)
        out = chr(65 + r) + out
    return out


def workbook(sheets: Mapping[str, Sequence[Sequence]], date1904: bool = False) -> bytes:
    """A workbook with one sheet per name; numbers, truth values, dates, times of day and texts in cells, None for none."""
    epoch = EPOCH_1904 if date1904 else EPOCH

    def cell(ref: str, v) -> str:
        if v is None or v != v:
            return ""
        if isinstance(v, bool):
            return f'<c r="{ref}" t="b"><v>{int(v)}</v></c>'
        if isinstance(v, (int, float)):
            return f'<c r="{ref}"><v>{v!r}</v></c>'
        if isinstance(v, (datetime, date, time)):
            return f'<c r="{ref}" s="{1 if isinstance(v, datetime) else 2 if isinstance(v, date) else 3}"><v>{serial(v, epoch)!r}</v></c>'
        return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>'

    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
    main, office, package = MAIN[1:-1], RELATION[1:-1], PACKAGE[1:-1]
    n = len(sheets)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        kinds = "application/vnd.openxmlformats-officedocument.spreadsheetml."
        parts = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="{kinds}worksheet+xml"/>' for k in range(1, n + 1))
        z.writestr("[Content_Types].xml", f'{head}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{kinds}sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{kinds}styles+xml"/>{parts}</Types>')
        z.writestr("_rels/.rels", f'{head}<Relationships xmlns="{package}"><Relationship Id="rId1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        z.writestr("xl/workbook.xml", f'{head}<workbook xmlns="{main}" xmlns:r="{office}">{'<workbookPr date1904="1"/>' * date1904}<sheets>' + "".join(f'<sheet name="{escape(s, {chr(34): "&quot;"})}" sheetId="{k}" r:id="rId{k}"/>' for k, s in enumerate(sheets, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", f'{head}<Relationships xmlns="{package}">' + "".join(f'<Relationship Id="rId{k}" Type="{office}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in range(1, n + 1)) + f'<Relationship Id="rId{n + 1}" Type="{office}/styles" Target="styles.xml"/></Relationships>')
        cells = "".join(f'<xf numFmtId="{i}" fontId="0" fillId="0" borderId="0" xfId="0" applyNumberFormat="1"/>' for i in (0, 164, 14, 21))
        one = "<fonts><font/></fonts><fills><fill/></fills><borders><border/></borders><cellStyleXfs><xf/></cellStyleXfs>"
        z.writestr("xl/styles.xml", f'{head}<styleSheet xmlns="{main}"><numFmts count="1"><numFmt numFmtId="164" formatCode="yyyy-mm-dd hh:mm:ss.000"/></numFmts>{one}<cellXfs count="4">{cells}</cellXfs></styleSheet>')
        for k, rows in enumerate(sheets.values(), 1):
            body = "".join(f'<row r="{r}">' + "".join(cell(f"{_letters(c)}{r}", v) for c, v in enumerate(row)) + "</row>" for r, row in enumerate(rows, 1))
            z.writestr(f"xl/worksheets/sheet{k}.xml", f'{head}<worksheet xmlns="{main}"><sheetData>{body}</sheetData></worksheet>')
    return out.getvalue()


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """Write one file through Spark's file systems, over one of the same name."""
    jvm, sc = spark._jvm, spark.sparkContext
    target = jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(sc._jsc.hadoopConfiguration()).create(target, True)
    try:
        stream.write(bytearray(data))
    finally:
        stream.close()


def write_xlsx(spark: SparkSession, path: str, sheets: Mapping[str, DataFrame | Sequence[Sequence]], date1904: bool = False) -> None:
    """A workbook of small results: DataFrames with their column names first, or rows as they are.

    The rows pass through the driver; more than a sheet can hold are refused.
    """

    def rows_of(name: str, rows: DataFrame | Sequence[Sequence]) -> Sequence[Sequence]:
        out = [rows.columns, *map(tuple, rows.limit(MOST_ROWS).collect())] if isinstance(rows, DataFrame) else rows
        if len(out) > MOST_ROWS:
            raise ValueError(f"sheet '{name}' has more than {MOST_ROWS} rows, its header included; write it in parts")
        return out

    write_bytes(spark, path, workbook({name: rows_of(name, rows) for name, rows in sheets.items()}, date1904))
