"""Large tables as sheets of a workbook, without a collect.

Rows become the format's XML by column expressions and are deflated by all tasks,
in parts that end on a byte, so that parts one after the other are one stream; the
driver only streams the packed parts, in order, into the zip, through Spark's file
systems and in buffers of fixed size. A table longer than a sheet goes on in further
sheets, ``name (2)``, ``name (3)``, ... One sheet of an existing workbook can be replaced:
its other entries are copied as they are, packed.
"""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from collections.abc import Iterator, Mapping, Sequence
from typing import NamedTuple
from uuid import uuid4
from xml.sax.saxutils import escape, quoteattr

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pelagia.session import small_batches
from pelagia.sources.xlsx import MAIN, MOST_ROWS, layout, sheets_of, workbook

#: Rows of a part at most, and packed bytes after which one ends; sheets are filled by whole parts.
PART, PACKED = 100_000, 32 << 20
#: What stands before a part's packed bytes: rows, checksum, bytes of XML, packed bytes.
HEAD = struct.Struct(">4q")
NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")
OPEN, CLOSE = f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n<worksheet xmlns="{MAIN[1:-1]}"><sheetData>', "</sheetData></worksheet>"


def cell(value: Column, kind: str) -> Column:
    """A cell of a column of a type; null, and a number that isn't finite, is an empty one."""
    if kind in NUMBERS or kind.startswith("decimal"):
        finite = ~(F.isnan(value) | (F.abs(value) == float("inf"))) if kind in ("float", "double") else value.isNotNull()
        body = F.when(finite, F.concat(F.lit("<c><v>"), value.cast("string"), F.lit("</v></c>")))
    elif kind == "boolean":
        body = F.concat(F.lit('<c t="b"><v>'), value.cast("int").cast("string"), F.lit("</v></c>"))
    elif kind in ("date", "timestamp", "timestamp_ntz"):
        at = value.cast("timestamp_ntz")
        days = (F.datediff(at, F.lit("1899-12-30")) + (F.hour(at) * 3600 + F.minute(at) * 60 + F.second(at) + F.date_format(at, "SSSSSS").cast("double") / 1e6) / 86400).cast("double")
        body = F.concat(F.lit(f'<c s="{2 if kind == "date" else 1}"><v>'), F.when(days < 61, days - 1).otherwise(days).cast("string"), F.lit("</v></c>"))
    else:
        text = value.cast("string")
        for plain, coded in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("\n", "&#10;"), ("\r", "&#13;")):
            text = F.replace(text, F.lit(plain), F.lit(coded))
        text = F.regexp_replace(text, "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]", "")  # XML has no such characters
        body = F.concat(F.lit('<c t="inlineStr"><is><t xml:space="preserve">'), text, F.lit("</t></is></c>"))
    return F.coalesce(body, F.lit("<c/>"))


def header(df: DataFrame) -> str:
    return "<row>" + "".join(f'<c t="inlineStr"><is><t xml:space="preserve">{escape(c)}</t></is></c>' for c in df.columns) + "</row>"


class Part(NamedTuple):
    """A deflated piece of a sheet: its file (or itself, where it is short), rows, checksum, bytes of XML, packed bytes."""

    source: str | bytes
    rows: int
    crc: int
    raw: int
    packed: int


def joined(a: int, b: int, length: int) -> int:
    """The CRC-32 of two pieces one after the other, by theirs and the length of the second: a * x^(8 length) + b modulo the polynomial."""

    def times(p: int, q: int) -> int:
        out = 0
        for k in range(31, -1, -1):
            out ^= q if p >> k & 1 else 0
            q = q >> 1 ^ (0xEDB88320 if q & 1 else 0)
        return out

    power = 1 << 23  # x^8; the highest bit is x^0
    while length:
        a = times(power, a) if length & 1 else a
        power, length = times(power, power), length >> 1
    return a ^ b


class Files:
    """Spark's file systems by py4j: streams that copy on the JVM's side."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()

    def path(self, name: str):
        p = self.jvm.org.apache.hadoop.fs.Path(name)
        return p.getFileSystem(self.conf), p

    def open(self, name: str):
        fs, p = self.path(name)
        return fs.open(p)

    def create(self, name: str):
        fs, p = self.path(name)
        return fs.create(p, True)

    def copy(self, source, target, length: int) -> None:
        """The next bytes of a stream."""
        if (n := self.jvm.org.apache.commons.io.IOUtils.copyLarge(source, target, 0, length)) != length:
            raise EOFError(f"{n} bytes of {length}")

    def parts(self, folder: str) -> list[str]:
        """Files that tasks wrote, in the order of the tasks and, in a task, of writing."""
        fs, p = self.path(folder)
        found = [(s.getPath().getName(), s.getPath().toString()) for s in fs.listStatus(p)]
        return [path for _, path in sorted(((int(n.split("-")[1]), int(n.rsplit("-c", 1)[1].split(".")[0])), path) for n, path in found if n.startswith("part-"))]

    def move(self, source: str, target: str) -> None:
        fs, a = self.path(source)
        b = self.path(target)[1]
        fs.delete(b, False)
        if not fs.rename(a, b):
            raise OSError(f"could not rename {source} to {target}")

    def drop(self, name: str) -> None:
        fs, p = self.path(name)
        fs.delete(p, True)


class Seekable(io.RawIOBase):
    """A file of Spark's file systems for Python's zip reader, which reads its directory and small entries."""

    def __init__(self, files: Files, name: str):
        fs, p = files.path(name)
        self.size, self.at, self.stream = fs.getFileStatus(p).getLen(), 0, fs.open(p)

    def seekable(self) -> bool:
        return True

    def readable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.at

    def seek(self, offset: int, whence: int = 0) -> int:
        self.at = offset + (0, self.at, self.size)[whence]
        return self.at

    def readinto(self, buffer) -> int:
        n = max(0, min(len(buffer), self.size - self.at))
        self.stream.seek(self.at)
        buffer[:n] = bytes(self.stream.readNBytes(n))
        self.at += n
        return n

    def close(self) -> None:
        if not self.closed:
            self.stream.close()
        super().close()

    def packed(self, entry: zipfile.ZipInfo):
        """The stream at an entry's packed bytes."""
        self.seek(entry.header_offset)
        lengths = struct.unpack("<26x2H", self.read(30))
        self.stream.seek(entry.header_offset + 30 + sum(lengths))
        return self.stream


class Packed:
    """A zip of entries that are packed already: their sizes are known before they are written."""

    def __init__(self, files: Files, name: str):
        self.files, self.out, self.at, self.entries = files, files.create(name), 0, []

    def write(self, data: bytes) -> None:
        self.out.write(bytearray(data))
        self.at += len(data)

    def begin(self, name: str, method: int, crc: int, packed: int, raw: int) -> None:
        entry = zipfile.ZipInfo(name)
        entry.compress_type, entry.CRC, entry.compress_size, entry.file_size, entry.header_offset = method, crc, packed, raw, self.at
        self.write(entry.FileHeader(zip64=max(packed, raw) >= zipfile.ZIP64_LIMIT))
        self.entries.append(entry)

    def put(self, name: str, data: bytes) -> None:
        pack = zlib.compressobj(wbits=-15)
        packed = pack.compress(data) + pack.flush()
        self.begin(name, zipfile.ZIP_DEFLATED, zlib.crc32(data), len(packed), len(data))
        self.write(packed)

    def sheet(self, name: str, parts: Sequence[Part]) -> None:
        crc = 0
        for p in parts:
            crc = joined(crc, p.crc, p.raw)
        self.begin(name, zipfile.ZIP_DEFLATED, crc, sum(p.packed for p in parts), sum(p.raw for p in parts))
        for p in parts:
            if isinstance(p.source, bytes):
                self.write(p.source)
                continue
            source = self.files.open(p.source)
            try:
                source.seek(HEAD.size)
                self.files.copy(source, self.out, p.packed)
            finally:
                source.close()
            self.at += p.packed

    def take(self, source: Seekable, entry: zipfile.ZipInfo) -> None:
        """An entry of another zip."""
        if entry.flag_bits & 1:
            raise ValueError(f"{entry.filename} is encrypted")
        self.begin(entry.filename, entry.compress_type, entry.CRC, entry.compress_size, entry.file_size)
        self.files.copy(source.packed(entry), self.out, entry.compress_size)
        self.at += entry.compress_size

    def close(self, whole: bool = True) -> None:
        """Write the directory, unless the entries aren't whole."""
        try:
            if whole:
                self.directory()
        finally:
            self.out.close()

    def directory(self) -> None:
        start, most = self.at, 0xFFFFFFFF
        for e in self.entries:
            sizes = e.file_size, e.compress_size, e.header_offset
            long = [n for n in sizes if n >= zipfile.ZIP64_LIMIT]
            raw, packed, at = (most if n >= zipfile.ZIP64_LIMIT else n for n in sizes)
            name = e.filename.encode()
            extra = struct.pack(f"<2H{len(long)}Q", 1, 8 * len(long), *long) if long else b""
            self.write(struct.pack("<4s6H3L5H2L", b"PK\1\2", 45, 45 if long else 20, 0 if name.isascii() else 0x800, e.compress_type, 0, 33, e.CRC, packed, raw, len(name), len(extra), 0, 0, 0, 0, at) + name + extra)
        size, n = self.at - start, len(self.entries)
        if n >= 0xFFFF or start >= most or size >= most:
            self.write(struct.pack("<4sQ2H2L4Q", b"PK\6\6", 44, 45, 45, 0, 0, n, n, size, start) + struct.pack("<4sLQL", b"PK\6\7", 0, start + size, 1))
        self.write(struct.pack("<4s4H2LH", b"PK\5\6", 0, 0, min(n, 0xFFFF), min(n, 0xFFFF), min(size, most), min(start, most), 0))


def deflated(batches: Iterator[pa.RecordBatch], part: int) -> Iterator[pa.RecordBatch]:
    """Rows' XML as packed parts, a row each, in order."""
    pack, out, rows, raw, crc = zlib.compressobj(wbits=-15), [], 0, 0, 0

    def done() -> pa.RecordBatch:
        packed = b"".join(out) + pack.flush(zlib.Z_FULL_FLUSH)
        return pa.RecordBatch.from_pylist([{"value": HEAD.pack(rows, crc, raw, len(packed)) + packed}], schema=pa.schema([("value", pa.binary())]))

    for b in batches:
        text = b.column(0).cast(pa.large_binary())
        ends, at = np.frombuffer(text.buffers()[1], np.int64)[text.offset :][: len(text) + 1], 0
        data = memoryview(text.buffers()[2] or b"")
        while at < len(text):
            to = min(len(text), at + part - rows)
            piece = data[ends[at] : ends[to]]
            out.append(pack.compress(piece))
            rows, raw, crc, at = rows + to - at, raw + len(piece), zlib.crc32(piece, crc), to
            if rows == part or sum(map(len, out)) >= PACKED:
                yield done()
                pack, out, rows, raw, crc = zlib.compressobj(wbits=-15), [], 0, 0, 0
    if rows:
        yield done()


def rendered(df: DataFrame, folder: str, part: int) -> list[Part]:
    """Write rows as packed XML, a file a part; the parts in order."""
    xml = F.concat(F.lit("<row>"), *[cell(F.col(f"`{f.name}`"), f.dataType.simpleString()) for f in df.schema], F.lit("</row>"))
    packed = df.select(xml.alias("value")).mapInArrow(lambda batches: deflated(batches, part), "value binary")
    packed.select(F.col("value").cast("string")).write.option("maxRecordsPerFile", 1).option("compression", "none").text(folder)
    files, out = Files(df.sparkSession), []
    for name in files.parts(folder):
        source = files.open(name)
        try:
            head = bytes(source.readNBytes(HEAD.size))
        finally:
            source.close()
        if head:  # a task without rows may leave an empty file
            out.append(Part(name, *HEAD.unpack(head)))
    return out


def filled(parts: list[Part], most: int) -> list[list[Part]]:
    """Parts by sheet: as many as fit below a header."""
    sheets, room = [[]], most - 1
    for p in parts:
        if p.rows > room:
            sheets, room = [*sheets, []], most - 1
        sheets[-1].append(p)
        room -= p.rows
    return sheets


def framed(df: DataFrame, parts: list[Part]) -> list[Part]:
    """The parts of a whole sheet, with its beginning, its header and its end."""
    out = []
    for text, flush in ((OPEN + header(df), zlib.Z_FULL_FLUSH), (CLOSE, zlib.Z_FINISH)):
        data, pack = text.encode(), zlib.compressobj(wbits=-15)
        packed = pack.compress(data) + pack.flush(flush)
        out.append(Part(packed, 0, zlib.crc32(data), len(data), len(packed)))
    return [out[0], *parts, out[1]]


def write_sheets(spark: SparkSession, path: str, sheets: Mapping[str, DataFrame], most: int = MOST_ROWS, part: int = PART) -> list[str]:
    """A workbook of tables of any length, a header in each sheet; the names of its sheets.

    Rows keep the order of the table's partitions. The file appears at its path when it is whole.
    """
    small_batches(spark)
    files, folder = Files(spark), f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/sheets-{uuid4().hex}"
    plan: list[tuple[str, list[Part]]] = []
    for k, (name, df) in enumerate(sheets.items()):
        for j, parts in enumerate(filled(rendered(df, f"{folder}/{k}", min(part, most - 1)), most), 1):
            plan.append((name if j == 1 else f"{name} ({j})", framed(df, parts)))
    with zipfile.ZipFile(io.BytesIO(workbook({name: [] for name, _ in plan}))) as z:
        frame = {n: z.read(n) for n in z.namelist() if not n.startswith("xl/worksheets/")}
    out, whole = Packed(files, f"{path}.part"), False
    try:
        for entry, data in frame.items():
            out.put(entry, data)
        for k, (_, parts) in enumerate(plan, 1):
            out.sheet(f"xl/worksheets/sheet{k}.xml", parts)
        whole = True
    finally:
        out.close(whole)
    files.move(f"{path}.part", path)
    files.drop(folder)
    return [name for name, _ in plan]


def replace_sheet(spark: SparkSession, path: str, sheet: str, df: DataFrame, most: int = MOST_ROWS, part: int = PART) -> None:
    """Another table in one sheet of a workbook; all other entries are copied as they are.

    A table that doesn't fit the sheet is refused before the file is touched.
    """
    small_batches(spark)
    files, folder = Files(spark), f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/sheets-{uuid4().hex}"
    with Seekable(files, path) as source, zipfile.ZipFile(source) as z:
        if sheet not in (found := sheets_of(z)):
            raise KeyError(f"no sheet {quoteattr(sheet)} among {found}")
        entry = layout(z, sheet)[0]
        parts = rendered(df, folder, part)
        if (n := sum(p.rows for p in parts)) >= most:
            files.drop(folder)
            raise ValueError(f"{n} rows and a header don't fit sheet '{sheet}' of {most} rows")
        out, whole = Packed(files, f"{path}.part"), False
        try:
            for e in z.infolist():
                if e.filename == entry:
                    out.sheet(entry, framed(df, parts))
                else:
                    out.take(source, e)
            whole = True
        finally:
            out.close(whole)
    files.move(f"{path}.part", path)
    files.drop(folder)
