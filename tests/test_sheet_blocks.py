"""Sheets parsed in blocks against the reader of whole sheets."""

import io
import zipfile
from datetime import datetime

from pyspark.sql import functions as F

from pelagia.sources.sheet_blocks import columns_of, deal, pieces, read_blocks, rows_by_parser, rows_of
from pelagia.sources.sheets import write_sheets
from pelagia.sources.xlsx import EPOCH, MAIN, PACKAGE, RELATION, read_xlsx, workbook, write_bytes

KINDS = "n double, word string, at timestamp_ntz, ok boolean"


def saved(spark, tmp_path, data, name="b.xlsx"):
    write_bytes(spark, f"{tmp_path}/{name}", data)
    return f"{tmp_path}/{name}"


def test_pieces():
    xml = b"<worksheet><sheetData>" + b"".join(b'<row r="%d"><c/></row>' % k for k in range(50_000)) + b"</sheetData></worksheet>"
    for block in (1, 1000, 1 << 30):
        assert b"".join(pieces(io.BytesIO(xml), block)) + b"</sheetData></worksheet>" == xml
    assert list(pieces(io.BytesIO(b"<worksheet><sheetData/></worksheet>"), 1)) == []


def test_equals_whole_reader_by_many_tasks(spark, tmp_path):
    rows = [["n", "other", "word", "at", "ok"]] + [[float(k), k * 2, None if k % 7 == 0 else f"<w&{k}>é", datetime(2020, 1, 1, k % 24), k % 2 == 0] for k in range(9000)]
    rows[40] = [None] * 5
    path = saved(spark, tmp_path, workbook({"x": [["a"]], "long": rows}))
    want = read_xlsx(spark, path, "long", f"{KINDS}", seq="k")
    got = read_blocks(spark, path, KINDS, "long", seq="k", block=1 << 14)
    assert got.schema == want.schema
    assert sorted(map(tuple, got.collect()), key=lambda r: r[-1]) == sorted(map(tuple, want.collect()), key=lambda r: r[-1])
    assert got.select(F.spark_partition_id().alias("p")).distinct().count() > 2
    two = read_blocks(spark, path, "word string, missing double", "long")
    assert two.where("missing IS NOT NULL").count() == 0 and two.count() == want.where("word IS NOT NULL").count()


def test_shared_texts_prefixes_gaps_and_1904(spark, tmp_path):
    main, office = MAIN[1:-1], RELATION[1:-1]
    body = "".join(f'<x:row r="{2 * k + 1}"><x:c r="B{2 * k + 1}" t="s"><x:v>{k % 3}</x:v></x:c><x:c r="D{2 * k + 1}" s="1"><x:v>{k}</x:v></x:c></x:row>' for k in range(1, 3000))
    sheet = f'<x:worksheet xmlns:x="{main}"><x:sheetData><x:row r="1"><x:c r="B1" t="s"><x:v>3</x:v></x:c><x:c r="D1" t="str"><x:v>at</x:v></x:c></x:row>{body}<x:row r="9999"/></x:sheetData></x:worksheet>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{office}"><workbookPr date1904="1"/><sheets><sheet name="s" sheetId="1" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{PACKAGE[1:-1]}"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/styles.xml", f'<styleSheet xmlns="{main}"><cellXfs><xf numFmtId="0"/><xf numFmtId="22"/></cellXfs></styleSheet>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}">' + "".join(f"<si><t>{t}</t></si>" for t in ("one", "two", "three", "word")) + "</sst>")
        z.writestr("xl/worksheets/sheet1.xml", sheet)
    path = saved(spark, tmp_path, out.getvalue())
    want = read_xlsx(spark, path, "s", "word string, at timestamp_ntz", seq="k")
    for block in (5_000, 1 << 20):
        got = read_blocks(spark, path, "word string, at timestamp_ntz", "s", seq="k", block=block)
        assert sorted(map(tuple, got.collect()), key=lambda r: r[-1]) == sorted(map(tuple, want.collect()), key=lambda r: r[-1])
    assert want.count() == 2999 and want.where("k = 1").first()["at"] == datetime(1904, 1, 2)
    plain = read_blocks(spark, path, "_c1 string, _c3 string", "s", header=False)
    assert plain.count() == 3000


def test_empty_sheet(spark, tmp_path):
    path = saved(spark, tmp_path, workbook({"none": [], "head": [["n", "word"]]}))
    assert read_blocks(spark, path, "n double, word string", "none").count() == 0
    assert read_blocks(spark, path, "n double, word string", "head").count() == 0


def test_many_sheets_in_one_scan(spark, tmp_path):
    """Sheets named together are read by one scan of the file, in batches of bounded bytes."""
    path = f"file://{tmp_path}/many.xlsx"
    names = write_sheets(spark, path, {"rows": spark.range(95).selectExpr("id AS k", "concat('t', id) AS t")}, most=11, part=5)
    rows = read_blocks(spark, path, "k double, t string", names, block=200)
    assert len(names) > 8 and sorted((r["k"], r["t"]) for r in rows.collect()) == [(float(k), f"t{k}") for k in range(95)]
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("Relation") == 1
    assert int(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")) <= 16 << 20


def test_sheets_of_a_large_file_are_cut_by_many_tasks(spark, tmp_path):
    """A file's sheets are dealt, packed as they are, to workbooks that tasks cut on their own; small files beside it stay whole."""
    names = write_sheets(spark, f"{tmp_path}/long.xlsx", {"rows": spark.range(5000).selectExpr("id AS k", "concat('<t&', id) AS t")}, most=501, part=250)
    write_sheets(spark, f"{tmp_path}/short.xlsx", {n: spark.range(k, k + 1).selectExpr("-1 - id AS k", "'short' AS t") for k, n in enumerate(names)})
    seen = []
    for book, files in (("long", 10), ("*", 10)):
        rows = read_blocks(spark, f"{tmp_path}/{book}.xlsx", "k double, t string", names, whole=20_000 if book == "*" else 1)
        cutters = rows._jdf.queryExecution().optimizedPlan().toString().count("Relation")
        seen.append((cutters, sorted((r["k"], r["t"]) for r in rows.collect())))
    long = [(float(k), f"<t&{k}") for k in range(5000)]
    short = sorted((-1.0 - k, "short") for k in range(len(names)))
    assert len(names) == files and seen[0] == (1, long) and seen[1][1] == sorted(short + long)


def test_dealt_workbooks(spark, tmp_path):
    names = write_sheets(spark, f"{tmp_path}/long.xlsx", {"rows": spark.range(2000).toDF("k")}, most=501, part=250)
    got = deal(spark, [f"{tmp_path}/long.xlsx"], names, f"{tmp_path}/dealt", 1)
    assert got == {f"0-{k}.xlsx": [n] for k, n in enumerate(names)}
    for file, (name,) in got.items():
        with zipfile.ZipFile(f"{tmp_path}/dealt/{file}") as z:
            assert z.testzip() is None and sum(n.startswith("xl/worksheets/") for n in z.namelist()) == 1
    assert list(deal(spark, [f"{tmp_path}/long.xlsx"], names, f"{tmp_path}/two", 1 << 30).values()) == [names]


def test_shared_texts_go_with_dealt_sheets(spark, tmp_path):
    main, office = MAIN[1:-1], RELATION[1:-1]
    path = f"{tmp_path}/shared.xlsx"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{office}"><sheets>' + "".join(f'<sheet name="s{k}" sheetId="{k + 1}" r:id="r{k}"/>' for k in range(4)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{PACKAGE[1:-1]}">' + "".join(f'<Relationship Id="r{k}" Type="{office}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in range(4)) + "</Relationships>")
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>word</t></si>' + "".join(f"<si><r><t>a</t></r><r><t>{k}</t></r></si>" for k in range(50)) + "</sst>")
        for k in range(4):
            z.writestr(f"xl/worksheets/sheet{k}.xml", f'<worksheet xmlns="{main}"><sheetData><row r="1"><c r="B1" t="s"><v>0</v></c></row>' + "".join(f'<row r="{r + 2}"><c r="A{r + 2}"><v>{r}</v></c><c r="B{r + 2}" t="s"><v>{(k + r) % 50 + 1}</v></c></row>' for r in range(200)) + "</sheetData></worksheet>")
    names = [f"s{k}" for k in range(4)]
    for whole in (1, 1 << 30):
        got = read_blocks(spark, path, "word string", names, block=700, whole=whole, seq="at")
        assert sorted(map(tuple, got.collect())) == sorted((f"a{(k + r) % 50}", r) for k in range(4) for r in range(200))


def test_split_rows_equal_parsed_rows():
    main = MAIN[1:-1]
    head = f'<worksheet xmlns="{main}" xmlns:r="{RELATION[1:-1]}">'.encode()
    forms = ["<c/>", "<c></c>", "<c><v>1</v></c>", "<c><v>1e-3</v></c>", '<c t="n"><v>5</v></c>', '<c s="1"><v>35378.5</v></c>', '<c s="2"><v>.25</v></c>', '<c t="b"><v>1</v></c>', '<c t="str"><f>A1&amp;"x"</f><v>q</v></c>', '<c t="e"><v>#N/A</v></c>', '<c t="d"><v>2020-01-02T03:04:05</v></c>',
             '<c t="s"><v>7</v></c>', '<c s="0" t="s"><v>7</v></c>', '<c t="inlineStr"><is><t xml:space="preserve"> é &lt;c&gt; &#10; </t></is></c>', '<c t="inlineStr"><is><t>plain :row r="B2" </t></is></c>', '<c t="inlineStr"><is><r><rPr><b/></rPr><t>a</t></r><r><t>b</t></r></is></c>', '<c t="inlineStr"><is><t/></is></c>', '<c t="inlineStr"><is><t>a\r\nb</t></is></c>', '<c ><v>2</v></c >', "<c><f>1+1</f><v>2</v></c>"]
    odd = ['<c t="inlineStr"><is><r><rPr><color rgb="1"/></rPr><t>a</t></r></is></c>', "<c><!-- <c><v>9</v></c> --><v>3</v></c>", '<c s="0" r="E9"><v>4</v></c>', '<c xmlns="other"><v>9</v></c>']
    ways = []
    for extra in ([], *([o] for o in odd)):
        cells = forms + extra
        rows = ["<row>" + "".join(cells[k:] + cells[:k]) + "</row>\n" for k in range(len(cells))] + ["<row></row>", '<row r="90" spans="1:2"><c><v>1</v></c></row>', "<row><c><v>2</v></c></row>"]
        ways += ["".join(rows), "".join([*rows, '<row r="95"/>', "<row><c><v>2</v></c></row>"])]
    refs = [c.replace("<c", f'<c r="{x}7"', 1) for c, x in zip(forms, ("A", "C", "D", "F", "G", "AA", "AB", "AC", *"HIJKLMNOPQRS"))]
    ways += [f'<row r="7">{"".join(refs)}</row><row r="9"><c r="C9"><v>1</v></c></row>', f'<row r="7">{"".join(refs)}<c><v>1</v></c></row>']
    for xml in ways:
        for places in ([0], [2, 5], [], [27, 3, 19, 1], [40]):
            given = (head, xml.encode(), 3, places, {7: "seven"}, ["", "date", "time"], EPOCH)
            assert list(rows_of(*given)) == list(rows_by_parser(*given))
    prefixed = head.replace(b"xmlns=", b"xmlns:x=").replace(b"<work", b"<x:work"), b'<x:row><x:c t="s"><x:v>7</x:v></x:c></x:row>', 0, [0], {7: "seven"}, [], EPOCH
    assert list(rows_of(*prefixed)) == [(1, ["seven"])]


def test_wanted_cells_alone_are_parsed(monkeypatch):
    """Rows of plain form don't go through the XML parser."""
    head, xml = f'<worksheet xmlns="{MAIN[1:-1]}">'.encode(), b'<row><c><v>1</v></c><c t="inlineStr"><is><t xml:space="preserve">a</t></is></c></row>' * 3
    monkeypatch.setattr("pelagia.sources.sheet_blocks.wrapped", None)
    assert [c.to_pylist() for c in columns_of(head, xml, [1, None, 0], ["string", "string", "double"])] == [["a"] * 3, [None] * 3, [1.0] * 3]
    assert list(rows_of(head, xml, 1, [1, 0], {}, [], EPOCH)) == [(k, ["a", 1.0]) for k in (2, 3, 4)]


def test_columns_taken_at_once_equal_parsed_rows():
    head = f'<worksheet xmlns="{MAIN[1:-1]}">'.encode()
    number, text, empty = "<c><v>{}</v></c>", '<c t="inlineStr"><is><t xml:space="preserve">{}</t></is></c>', "<c/>"
    rows = [[number.format(k / 7), text.format(f"é{k}"), empty if k % 3 else number.format(-k), '<c s="1"><v>3</v></c>', text.format("")][: 5 - k % 3] for k in range(50)] + [[], [empty] * 5]
    plain = "".join(f"<row>{''.join(r)}</row>" for r in rows)
    kinds, places = ["double", "string", "double", "string", "double"], [0, 1, 2, 4, None]
    odd = [text.format("a&amp;b"), '<c t="inlineStr"><is><t>a</t></is></c>', "<c><v>x</v></c>", "<c><v> 1</v></c>", '<c t="n" r="A12"><v>1</v></c>', '<c s="1" r="A9"><v>1</v></c>', "<c><!-- --><v>1</v></c>", "<c><f>1</f><v>1</v></c>", '<c t="inlineStr"><is><r><rPr><color/></rPr><t>a</t></r></is></c>', text.format("a\rb"), text.format("a</t></is><is><t>b")]
    for xml, whole in ((plain, True), *((plain + f"<row>{number.format(1)}{c}</row>", False) for c in odd), (plain + '<row r="90"></row>', False), (plain.replace("<", "<x:"), False)):
        got = columns_of(head, xml.encode(), places, kinds)
        assert (got is not None) == whole
        if whole:
            want = [r for _, r in rows_by_parser(head, xml.encode(), 0, places[:-1], {}, ["", ""], EPOCH)]
            assert [list(r) for r in zip(*(c.to_pylist() for c in got[:-1]))] == want and got[-1].null_count == len(want)
    assert columns_of(head, plain.encode(), [0], ["string"]) is None and columns_of(head, plain.encode(), [3], ["double"]) is None
    assert columns_of(head, plain.encode(), [0], ["boolean"]) is None
