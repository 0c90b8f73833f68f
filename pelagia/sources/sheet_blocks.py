"""Long sheets of workbooks, parsed by many tasks.

One task a file unpacks its sheets as streams and cuts them behind rows into blocks of
XML, which is little work for each byte; blocks are dealt to all tasks, which parse
them. The sheets of a large file are dealt first: the driver copies their packed bytes,
in buffers of fixed size, into workbooks of a few sheets each. The schema names the columns to read: cells of others are skipped, and a block
brings only the shared texts that its wanted cells refer to. A task that is lost
costs its blocks. Columns of a block whose cells are all plain numbers or plain texts are
taken at once, by the places of its tags; elsewhere cells of plain form are found by splitting a row's bytes, so that those of
other columns cost next to nothing; a cell of another form goes through the XML parser,
and so does a block whose rows or cells can't be told apart that way.

The cutting task holds the packed file, its shared texts and one block. A sheet whose
packed bytes and shared texts have 2 GB and more is beyond Spark's binary reader. Rows without a value in the wanted
columns go, as do the columns' values that don't fit their type (null). A column that
a file lacks is null. Sheets are UTF-8, and their texts are coded as entities, never
as CDATA sections, as all known programs write them.
"""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterator, Sequence
from uuid import uuid4
from xml.etree import ElementTree

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pelagia.session import small_batches
from pelagia.sources.sheets import Files, Packed, Seekable
from pelagia.sources.xlsx import ARROW, EPOCH, EPOCH_1904, MAIN, _column, _named, cast, layouts, row_of, shared_strings, stored

#: Bytes of XML in a block, about; a longer row is a block of its own.
BLOCK = 1 << 20
#: Bytes of a file above which its sheets are dealt, and about as many in a workbook of some of them.
WHOLE = 8 << 20
#: Entries that every sheet needs.
SHARED = ("xl/workbook.xml", "xl/_rels/workbook.xml.rels", "xl/styles.xml", "xl/sharedStrings.xml")
ROW_END = re.compile(rb"</(?:\w+:)?row>")
ROW_START = re.compile(rb"<(?:\w+:)?row\b([^>]*)>")
PLAIN_ROW = re.compile(rb"<row\b([^>]*)>")
NUMBER = re.compile(rb"""\br\s*=\s*["'](\d+)["']""")
CELL = re.compile(rb"""\br\s*=\s*["']([A-Z]+)""")
REFERENCE = re.compile(rb"""<(?:\w+:)?c\b([^>]*\bt\s*=\s*["']s["'][^>]*)(?<!/)>\s*(?:<(?:\w+:)?f\b[^>]*/>|<(?:\w+:)?f\b.*?</(?:\w+:)?f>)?\s*<(?:\w+:)?v>(\d+)<""", re.S)
HAS_REFERENCE = re.compile(rb"<c\s[^>]*?\br\s*=")
REFERS = re.compile(rb' r="([A-Z]+)\d+"')
PLAIN = re.compile(rb"""(?: r="\w+"| t="(\w+)"| s="(\d+)")*>(?:<v>([^<&\r]+)</v>|<is><t(?: xml:space="preserve")?>([^<&\r]*)</t></is>)</c>""")
#: What stands around a plain cell's value, by the type of its column.
AROUND = {"double": (b"<c><v>", b"</v></c>"), "string": (b'<c t="inlineStr"><is><t xml:space="preserve">', b"</t></is></c>")}
ROOT = re.compile(rb"<((?:\w+:)?worksheet)\b[^>]*>")
BLOCKS = "file string, no int, at bigint, head binary, xml binary, places array<int>, names array<string>, styles array<string>, date1904 boolean, strings map<int,string>"
SCHEMA = pa.schema([("file", pa.string()), ("no", pa.int32()), ("at", pa.int64()), ("head", pa.binary()), ("xml", pa.binary()), ("places", pa.list_(pa.int32())), ("names", pa.list_(pa.string())), ("styles", pa.list_(pa.string())), ("date1904", pa.bool_()), ("strings", pa.map_(pa.int32(), pa.string()))])


def pieces(stream, block: int) -> Iterator[bytes]:
    """A sheet's XML cut behind rows; the first piece has all before the first row, and what follows the last row goes."""
    rest = b""
    while chunk := stream.read(1 << 16):
        rest += chunk
        if len(rest) >= block and (end := last_end(rest)):
            yield rest[:end]
            rest = rest[end:]
    if end := last_end(rest):
        yield rest[:end]


def last_end(xml: bytes) -> int:
    """The place behind the last row; 0 where none ends."""
    to = len(xml)
    while (at := xml.rfind(b"</", 0, to)) >= 0:
        if m := ROW_END.match(xml, at):
            return m.end()
        to = at
    return 0


def wrapped(head: bytes, xml: bytes):
    """Row elements of a block, under the sheet's own root tag, which has its namespaces."""
    name = ROOT.match(head)[1]
    return ElementTree.fromstring(head + xml + b"</" + name + b">").iter(f"{MAIN}row")


def unprefixed(head: bytes, xml: bytes) -> bool:
    main = MAIN[1:-1].encode()
    return ROOT.match(head)[1] == b"worksheet" and head.count(main) == 1 and (b'xmlns="%b"' % main in head or b"xmlns='%b'" % main in head) and b"xmlns" not in xml


def splits(head: bytes, xml: bytes) -> bool:
    """Whether a block's tags have no prefix and its rows all end in ``</row>``, so that its bytes can be split at them."""
    return unprefixed(head, xml) and not any(t in xml for t in (b"<!", b"<?")) and xml.count(b"<row") == xml.count(b"</row>") == xml.count(b"<row>") + xml.count(b"<row ")


def rows_by_parser(head: bytes, xml: bytes, number: int, places: Sequence[int], shared, styles: Sequence[str], epoch) -> Iterator[tuple[int, list]]:
    """Number and values at some places of each row of a block."""
    wanted = set(places)
    for node in wrapped(head, xml):
        number = int(node.get("r") or number + 1)
        row = row_of(node, shared, styles, epoch, wanted)
        yield number, [row[k] if k < len(row) else None for k in places]


def rows_of(head: bytes, xml: bytes, number: int, places: Sequence[int], shared, styles: Sequence[str], epoch) -> Iterator[tuple[int, list]]:
    """As ``rows_by_parser``, without parsing what isn't wanted where the block's form allows it."""
    cells = xml.count(b"<c")
    refers = cells > 0 and xml.count(b'<c r="') == cells
    plain = splits(head, xml) and (refers or cells == sum(map(xml.count, (b"<c>", b"<c ", b"<c/"))) and not HAS_REFERENCE.search(xml))
    if not plain:
        yield from rows_by_parser(head, xml, number, places, shared, styles, epoch)
        return
    kinds: dict[bytes | None, str] = {None: "n"}
    most, start, at_letters = max(places, default=-1), head + b"<row><c", {}

    def value(cell: bytes):
        if m := PLAIN.fullmatch(cell):
            kind, style, number, text = m.groups()
            kind = kinds.get(kind) or kinds.setdefault(kind, kind.decode())
            if kind == "inlineStr" and text is not None:
                return text.decode()
            if kind != "inlineStr" and number is not None:
                return stored(kind, number.decode(), int(style or 0), shared, styles, epoch)
        elif cell == b"/>":
            return None
        row = row_of(ElementTree.fromstring(start + cell + b"</row></worksheet>")[0], shared, styles, epoch)
        return row[-1]

    for piece in xml.split(b"</row>")[:-1]:
        if refers:
            first, *found = piece.split(b"<c")
            values: list = [None] * len(places)
            for cell in found:
                m = REFERS.match(cell)
                if not m:  # a place that only the parser reads
                    raise ValueError(f"no place in cell <c{cell[:80]!r}")
                if (letters := m[1]) not in at_letters:
                    at_letters[letters] = [i for i, k in enumerate(places) if k == _column(letters.decode())]
                for i in at_letters[letters]:
                    values[i] = value(cell)
        else:
            first, *found = piece.split(b"<c", most + 2)
            values = [value(found[k]) if k < len(found) else None for k in places]
        m = None if first == b"<row>" else NUMBER.search(first)
        number = int(m[1]) if m else number + 1
        yield number, values


def columns_of(head: bytes, xml: bytes, places: Sequence[int | None], kinds: Sequence[str]) -> list[pa.Array] | None:
    """The values at some places of all rows of a block, a column each, or None where one isn't of plain form throughout; rows have no numbers."""
    if any(k not in AROUND for k in kinds) or not unprefixed(head, xml):
        return None
    byte = np.frombuffer(xml, np.uint8)
    tags = np.flatnonzero(byte[:-5] == ord("<"))  # the last is the end of a row
    one, two = byte[tags + 1], byte[tags + 2]
    start, end, cell = tags[(one == ord("r")) & (two == ord("o"))], tags[(one == ord("/")) & (two == ord("r")) & (byte[tags + 3] == ord("o"))], tags[one == ord("c")]
    n, after_name = len(start), byte[cell + 2]
    spaced = cell[after_name == ord(" ")]
    if not n or len(end) != n or (byte[start + 4] != ord(">")).any() or ((one == ord("!")) | (one == ord("?"))).any() or not np.isin(after_name, list(b"> /")).all():
        return None
    text = np.logical_and.reduce([byte[spaced + k] == c for k, c in ((3, ord("t")), (6, ord("i")), (14, ord("r")), (15, ord('"')), (16, ord(">")))])  # t="inlineStr"
    style = np.logical_and.reduce([byte[spaced + k] == c for k, c in ((3, ord("s")), (7, ord('"')), (8, ord(">")))])  # a style of one digit
    if not (text | style).all() and HAS_REFERENCE.search(xml):
        return None
    bounds = np.sort(np.concatenate([cell, end, [len(xml)]])).astype(np.int64)
    pieces = pa.Array.from_buffers(pa.large_binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(xml)])
    first, after, out = np.searchsorted(bounds, start), np.searchsorted(bounds, end), []  # a row's cells stand between them
    for place, kind in zip(places, kinds):
        if place is None:
            out.append(pa.nulls(n, ARROW[kind]))
            continue
        before, behind = AROUND[kind]
        at = first + place
        found = pieces.take(pa.array(at, mask=at >= after))
        found = pc.if_else(pc.equal(found, b"<c/>"), pa.scalar(None, pa.large_binary()), found)
        plain = pc.and_(pc.starts_with(found, before), pc.ends_with(found, behind))
        value = pc.binary_slice(found, len(before), -len(behind))
        if not pc.all(plain, min_count=0).as_py() or any(c in xml and pc.any(pc.match_substring(value, c), min_count=0).as_py() for c in (b"<", b"&", b"\r")):
            return None
        try:
            out.append(value.cast(pa.large_string()).cast(ARROW[kind]))
        except pa.ArrowInvalid:
            return None
    return out


def cut(file: str, z: zipfile.ZipFile, found_at: tuple, shared: Sequence[str], wanted: Sequence[str], header: bool, block: int) -> Iterator[dict]:
    """The blocks of a sheet of a workbook; ``at`` is the number of the last row before a block."""
    path, styles, epoch = found_at
    at, places, names, head = 0, None, None, b""
    with z.open(path) as f:
        for no, xml in enumerate(pieces(f, block)):
            if not head:
                root = ROOT.search(xml)
                head, xml = root[0], xml[ROW_START.search(xml).start() :]
            if places is None:
                first = next(wrapped(head, xml[: ROW_END.search(xml).end()]))
                found = _named(row_of(first, shared, styles, epoch)) if header else None
                places = [k for k, n in enumerate(found) if n in wanted] if header else [int(n[2:]) for n in wanted]
                names = [found[k] for k in places] if header else list(wanted)
            refers = {}
            if shared:
                for m in REFERENCE.finditer(xml):
                    ref = CELL.search(m[1])  # a cell without its place may be a wanted one
                    if not ref or _column(ref[1].decode()) in places:
                        refers[int(m[2])] = shared[int(m[2])]
            yield {"file": file, "no": no, "at": at, "head": head, "xml": xml, "places": places, "names": names, "styles": styles, "date1904": epoch == EPOCH_1904, "strings": list(refers.items())}
            at = last_number((ROW_START if b":row" in xml else PLAIN_ROW).findall(xml), at)


def last_number(starts: Sequence[bytes], at: int) -> int:
    """The number of the last of some rows, by the attributes of their tags and the number before them."""
    for k, attributes in enumerate(reversed(starts) if any(starts) else ()):
        if number := NUMBER.search(attributes):
            return int(number[1]) + k
    return at + len(starts)


def deal(spark: SparkSession, names: Sequence[str], sheets: Sequence[str | int], folder: str, whole: int) -> dict[str, list[str | int]]:
    """Copy the wanted sheets of large files, packed as they are, to workbooks of about ``whole`` bytes; the sheets of each by its name.

    Where texts are shared, as many bytes of sheets go with each copy of them.
    """
    files, out = Files(spark), {}
    for k, name in enumerate(names):
        with Seekable(files, name) as source, zipfile.ZipFile(source) as z:
            shared = [z.getinfo(n) for n in SHARED if n in z.namelist()]
            groups, room = [], 0
            for sheet, (entry, _, _) in zip(sheets, layouts(z, sheets)):
                if room <= 0:
                    groups.append([])
                    room = max(whole, sum(e.compress_size for e in shared))
                groups[-1].append((sheet, z.getinfo(entry)))
                room -= groups[-1][-1][1].compress_size
            for j, group in enumerate(groups):
                target = f"{k}-{j}.xlsx"
                copy, done = Packed(files, f"{folder}/{target}"), False
                try:
                    for entry in {e.filename: e for e in [*shared, *(e for _, e in group)]}.values():
                        copy.take(source, entry)
                    done = True
                finally:
                    copy.close(done)
                out[target] = [sheet for sheet, _ in group]
    return out


def cut_all(file: str, book: pa.Buffer, sheets: Sequence[str | int], wanted: Sequence[str], header: bool, block: int) -> Iterator[dict]:
    """The blocks of all wanted sheets; the workbook is opened once."""
    with zipfile.ZipFile(pa.BufferReader(book)) as z:
        shared = shared_strings(z)
        for k, found_at in enumerate(layouts(z, sheets)):
            yield from cut(f"{file}#{k}", z, found_at, shared, wanted, header, block)


def read_blocks(spark: SparkSession, path: str | Sequence[str], schema: str, sheet: str | int | Sequence[str | int] = 0, header: bool = True, seq: str | None = None, block: int = BLOCK, whole: int = WHOLE) -> DataFrame:
    """The columns of a schema (DDL, as in ``read_xlsx``) of one or more sheets of one or more workbooks; ``seq`` names a column with a row's number."""
    small_batches(spark)  # a block is a row
    sheets = [sheet] if isinstance(sheet, (str, int)) else list(sheet)
    types = {f.name: f.dataType.simpleString() for f in spark.createDataFrame([], schema).schema}
    books = spark.read.format("binaryFile").load(path if isinstance(path, str) else list(path)).select("path", "content", "length")
    large, dealt_sheets, folder = [r["path"] for r in books.where(F.col("length") > whole).select("path").collect()], {}, None  # one row a large file
    if large and sheets:
        folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/sheets-{uuid4().hex}"
        dealt_sheets = deal(spark, large, sheets, folder, whole)
        parts = spark.read.format("binaryFile").load(folder).select("path", "content", "length")
        books = parts if books.where(F.col("length") <= whole).isEmpty() else books.where(F.col("length") <= whole).unionByName(parts)

    def to_blocks(batches):
        for b in batches:
            for file, book in zip(b.column(0).to_pylist(), b.column(1)):
                at, _, name = file.rpartition("/")
                some = dealt_sheets[name] if folder and at.endswith(folder.rpartition("/")[2]) else sheets
                for row in cut_all(file, book.as_buffer(), some, list(types), header, block):
                    yield pa.RecordBatch.from_pylist([row], schema=SCHEMA)

    def parse(batches):
        for b in batches:
            for at in range(b.num_rows):
                r = b.slice(at, 1).to_pylist()[0]
                shared, epoch = dict(r["strings"]), EPOCH_1904 if r["date1904"] else EPOCH
                last, where = r["at"], {n: k for k, n in enumerate(r["names"])}
                taken = columns_of(r["head"], r["xml"], [r["places"][where[n]] if n in where else None for n in types], list(types.values()))
                if taken is not None and not (header and r["no"] == 0):
                    numbers = np.arange(len(taken[0])) + r["at"] - header
                    table = pa.RecordBatch.from_arrays([*taken, pa.array(numbers, pa.int64())][: len(types) + bool(seq)], [*types, *([seq] if seq else [])])
                    some = pc.is_valid(taken[0])
                    for c in taken[1:]:
                        some = pc.or_(some, pc.is_valid(c))
                    yield table.filter(some)
                    continue
                cols: dict[str, list] = {n: [] for n in types}
                numbers: list[int] = []
                for number, values in rows_of(r["head"], r["xml"], r["at"], r["places"], shared, r["styles"], epoch):
                    first, last = header and r["no"] == 0 and last == r["at"], number
                    if not first and any(v is not None for v in values):
                        numbers.append(number - 1 - header)
                        for n, kind in types.items():
                            cols[n].append(cast(values[where[n]], kind) if n in where else None)
                arrays = [pa.array(cols[n], ARROW[kind]) for n, kind in types.items()]
                yield pa.RecordBatch.from_arrays(arrays + ([pa.array(numbers, pa.int64())] if seq else []), [*types] + ([seq] if seq else []))

    ddl = ", ".join(f"`{n}` {kind}" for n, kind in types.items()) + (f", `{seq}` bigint" if seq else "")
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = books.mapInArrow(to_blocks, BLOCKS).repartition(tasks, "file", "no")  # a fixed number, as blocks are few and dear
    return dealt.mapInArrow(parse, ddl)
