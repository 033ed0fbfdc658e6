import io
import os
import random
import zipfile
from pathlib import Path

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import values
from sheetloom import scratch_dir, session
from sheetloom.plans.versions import DocumentError, DocumentStore
from sheetloom.sources import delimited, headers, ingest, splits, workbooks


# --- names and headers ---


def test_names():
    assert headers.unique_names([" a ", "", None, "a", "A", "a_2", "b"]) == ["a", "coluna", "coluna_2", "a_2", "A_3", "a_2_2", "b"]
    assert headers.csv_names([" a ", " ", "B", "b"]) == ["a", "column1", "B", "b_1"]
    assert [headers.column_letters(i) for i in (0, 25, 26, 701, 702, 16383)] == ["A", "Z", "AA", "ZZ", "AAA", "XFD"]
    assert headers.header_range(5, 8) == "A5:H"
    with pytest.raises(ValueError):
        headers.header_range(1, 0)


def cells(spark, sheet, rows):
    """``rows``: {row number: [cell or None]}"""
    flat = [(sheet, n, i, v) for n, row in rows.items() for i, v in enumerate(row) if v is not None]
    return spark.createDataFrame(flat, "sheet string, row_number bigint, column_index int, value string")


# Two titles above a header of four; a table far down with a blank column inside; a title above one column of numbers.
TITLED = {2: ["Tide tables"], 3: ["harbours of the coast"], 4: ["port", "high", "low", "moon"], 5: ["Husum", "3.4", "0.1", "full"], 6: ["Emden", "3.1", "0.2", "new"]}
LEADING = {9: ["grain", "acres", None, "yield"], 10: ["rye", "4", None, "31"], 11: ["oat", "2", None, "17"], 12: ["hop", "1", None, "9"]}
SINGLE = {5: ["Soundings"], 6: ["metres"], 7: ["12"], 8: ["7"], 9: ["31"]}


@pytest.mark.parametrize(
    "rows, expected",
    [
        (TITLED, (4, 4, 5, False)),
        (LEADING, (9, 4, 4, False)),
        (SINGLE, (6, 1, 5, True)),
        ({1: ["serial"], 2: ["0007"]}, (1, 1, 2, True)),
        ({1: ["a", "b"], 2: ["1", "2"], 3: ["x", "y"]}, (1, 2, 3, False)),
        ({1: ["x"]}, None),
        ({30: ["a", "b"], 31: ["1", "2"]}, None),
        ({1: [None, "a", "b"], 2: [None, "1", "2"]}, (1, 3, 2, False)),
    ],
)
def test_detect_headers(spark, rows, expected):
    found = values(headers.detect_headers(cells(spark, "s", rows), ["sheet"]), "header_row", "column_count", "rows_scanned", "fallback_used")
    assert found == ([expected] if expected else [])


def test_detect_headers_of_many_sheets(spark):
    both = cells(spark, "t", TITLED).unionByName(cells(spark, "l", LEADING)).unionByName(cells(spark, "none", {1: ["x"]}))
    assert sorted(values(headers.detect_headers(both, ["sheet"]), "sheet", "header_row")) == [("l", 9), ("t", 4)]


# --- delimited text ---

FILES = {
    "irregular": 'tree,height,park\noak,19,East\n"ash",\nelm,7\n"fir",,West\n',
    "zeros": 'serial,maker\n"000070","Zeta"\n"","Eta"\n"0","Theta"\n',
    "semicolons": "a;b;c\n1;2;3\n4;5\n6;7;8;9\n",
    "repeats": 'a,b,a\n"x, y",2,3\n4,"q""z"\n',
    "tabs": "a\tb\n1,5\t2\n3,5\t4\n",
    "pipes": "a|b\n1|2\n",
    "blanks": 'a,b\n"",x\n,y\n  z ,\n\n"  ",w\n',
    "names": " a , ,B,b\n1,2,3,4\n",
}


@pytest.mark.parametrize("name", FILES)
def test_csv_reads_like_duckdb(spark, tmp_path, name):
    path = tmp_path / f"{name}.csv"
    path.write_text(FILES[name])
    expected = duckdb.connect().execute(f"select * from read_csv_auto('{path}', header=true, all_varchar=true, ignore_errors=true, null_padding=true)")
    columns, rows = [d[0] for d in expected.description], expected.fetchall()
    df = delimited.read_delimited(spark, str(path))
    assert (df.columns, values(df)) == (columns, rows)
    store = DocumentStore(spark, scratch_dir(spark, "store"))
    stored = store.read(ingest.ingest(store, str(path))[0])
    assert (stored.columns[1:], values(stored.drop("_row_id"))) == (columns, rows)
    assert [r._row_id for r in stored.collect()] == list(range(len(rows)))


def test_quoted_line_breaks(spark, tmp_path):
    path = tmp_path / "lines.csv"
    path.write_text('a,b\n"one\ntwo",2\n3,4,5\n')
    df = delimited.read_delimited(spark, str(path))
    assert df.columns == ["a", "b", "column2"] and sorted(values(df)) == [("3", "4", "5"), ("one\ntwo", "2", None)]
    store = DocumentStore(spark, scratch_dir(spark, "store"))
    assert sorted(values(store.read(ingest.ingest(store, str(path))[0]))) == [(0, "one\ntwo", "2", None), (1, "3", "4", "5")]


@pytest.fixture
def tiny_splits(spark):
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)

    def cut(size):
        spark.conf.set(key, str(size))

    yield cut
    spark.conf.set(key, before)


def written(path, rows, end, rng):
    """Rows as a delimited file with fields quoted where they must be and sometimes where not; blank lines between records."""
    with open(path, "w", newline="") as out:
        for row in rows:
            cells = [f'"{c.replace(chr(34), chr(34) * 2)}"' if rng.random() < 0.3 or any(x in c for x in ';"\n\r') or c.strip() == "" else c for c in row]
            out.write(";".join(cells) + end + (end if rng.random() < 0.1 else ""))


def stored_rows(spark, path, name="x"):
    store = DocumentStore(spark, scratch_dir(spark, "store"))
    return [tuple(c or "" for c in r[1:]) for r in sorted(values(store.read(ingest.ingest_delimited(store, path, name, ";"))))]


@pytest.mark.parametrize("size, end", [(64, "\n"), (333, "\r\n"), (5000, "\n")])
def test_records_over_any_splits(spark, tmp_path, tiny_splits, size, end):
    """Files of unequal size cut anywhere: every record once, ids dense and in order of files."""
    rng = random.Random(size)
    pick = ["oak", "", " elm ", "a;b", 'say "so"', "two\nlines", f"{end}{end}", '"', '";"', "\n;\n", "x" * 90, "ash\n" * 30, "ünï"]
    expected = []
    for i, n in enumerate([40, 3, 0, 11]):
        rows = [[f"{i}-{j}", *[rng.choice(pick) for _ in range(3)]] for j in range(n)]
        written(tmp_path / f"f{i}.csv", [["tree", "a", "b", "c"], *rows], end, rng)
        expected += map(tuple, rows)
    tiny_splits(size)
    assert stored_rows(spark, str(tmp_path)) == expected
    store = DocumentStore(spark, scratch_dir(spark, "store"))
    ids = values(store.read(ingest.ingest_delimited(store, str(tmp_path), "x", ";")), "_row_id")
    assert sorted(ids) == [(i,) for i in range(len(expected))]


def test_row_ids_follow_the_files(spark, tmp_path, tiny_splits):
    sizes = {"b.csv": 700, "a.csv": 5, "c.csv": 1, "d.csv": 90}
    for name, n in sizes.items():
        (tmp_path / name).write_text("file,row\n" + "".join(f"{name},{i}\n" for i in range(n)))
    tiny_splits(512)
    store = DocumentStore(spark, scratch_dir(spark, "store"))
    found = sorted(values(store.read(ingest.ingest_delimited(store, str(tmp_path), "x")), "_row_id", "file", "row"))
    assert found == [(i, *r) for i, r in enumerate((name, str(j)) for name in sorted(sizes) for j in range(sizes[name]))]


@pytest.mark.parametrize(
    "text, rows",
    [
        ('a,b\n5" pipe,x\n7,y"z\n"q",w\n', [('5" pipe', "x"), ("7", 'y"z'), ("q", "w")]),
        ('a,b\n5" pipe,"x\ny"\n7,z"\n', [('5" pipe', "x\ny"), ("7", 'z"')]),
        ('"a\nc",b\n1,2\n', [("1", "2")]),
        ('a,b\r"x",1\ry,2\r', [("x", "1"), ("y", "2")]),
        ('\n \na,b\n\n1,2\n', [("1", "2")]),
        ('a,b\n1,"never closed\n2,3\n', [("1", "never closed\n2,3\n")]),
    ],
)
@pytest.mark.parametrize("size", [9, 10_000])
def test_odd_quotes_and_ends(spark, tmp_path, tiny_splits, text, rows, size):
    (tmp_path / "odd.csv").write_bytes(text.encode())
    tiny_splits(size)
    store = DocumentStore(spark, scratch_dir(spark, "store"))
    found = [r[1:] for r in sorted(values(store.read(ingest.ingest_delimited(store, str(tmp_path / "odd.csv"), "x"))))]
    assert [tuple(c.rstrip("\n") for c in r) for r in found] == [tuple(c.rstrip("\n") for c in r) for r in rows]


def test_one_file_of_line_breaks_uses_many_tasks(spark, tmp_path, tiny_splits):
    (tmp_path / "big.csv").write_text("k,v\n" + "".join(f'{i},"line\nbreak {i}"\n' for i in range(20_000)))
    tiny_splits(1 << 15)
    found = delimited.survey(spark, str(tmp_path / "big.csv"))
    assert found.multi_line
    assert splits.lines(spark, str(tmp_path / "big.csv")).rdd.getNumPartitions() >= 8
    assert delimited.named_rows(found).count() == 20_000


def test_headers_of_all_files(spark, tmp_path):
    (tmp_path / "x1.csv").write_text("tree,height\noak,19\n")
    (tmp_path / "x2.csv").write_text("height,tree\n7,elm,tall\n")
    (tmp_path / "y.csv").write_text("tree,park\nash,East\n")
    store = DocumentStore(spark, scratch_dir(spark, "store"))
    both = store.read(ingest.ingest_delimited(store, str(tmp_path / "x*.csv"), "trees"))
    assert sorted(values(both, "tree", "height", "column2")) == [("elm", "7", "tall"), ("oak", "19", None)]
    with pytest.raises(DocumentError):
        ingest.ingest_delimited(store, str(tmp_path), "all")
    with pytest.raises(delimited.LayoutError):
        delimited.read_delimited(spark, str(tmp_path))


def test_delimiter_from_all_lines(spark, tmp_path):
    path = tmp_path / "far.csv"
    path.write_text("a;b,c\n" + "1;2\n" * 40 + "1;2,3\n" * 400 + "".join(f"{i};x\n" for i in range(900)))
    assert delimited.sniff(spark, str(path)).delimiter == ";"


def test_ingest_record(spark, tmp_path):
    path = tmp_path / "x.csv"
    path.write_text(FILES["irregular"])
    store = DocumentStore(spark, scratch_dir(spark, "store"))
    entry = store.entries(ingest.ingest(store, str(path))[0])[0]
    assert (entry.name, entry.source_type, entry.source_file, entry.row_count, entry.column_count) == ("x.csv", "csv", "x.csv", 4, 3)
    with pytest.raises(DocumentError):
        ingest.ingest(store, "x.ods")


@pytest.mark.parametrize("delimiter", [",", "\t"])
def test_export_equals_duckdb_copy(spark, tmp_path, delimiter):
    rows = [("a", None, 1.5), ("", 'x"y', 2.0), ("a,b", "c\td", None), (" lead ", "NULL", 1e7), ("é", "'", -0.25)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "_row_id bigint, k string, `c d` string, v double").coalesce(1)
    out = tmp_path / "out"
    (delimited.write_tsv if delimiter == "\t" else delimited.write_delimited)(df, str(out))
    connection = duckdb.connect()
    connection.execute('create table t (k varchar, "c d" varchar, v double)')
    connection.executemany("insert into t values (?, ?, ?)", rows)
    connection.execute(f"copy t to '{tmp_path}/expected' (header, delimiter '{delimiter}')")
    assert next(out.glob("part-*")).read_text() == (tmp_path / "expected").read_text()


# --- workbooks ---

MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
RELATIONS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def book(path: Path, sheets: list[tuple[str, str, str]], shared: list[str] = (), prefix: str = "") -> str:
    """A workbook of ``(name, state, sheetData xml)``; a prefix puts all tags into a named namespace."""
    p = f"{prefix}:" if prefix else ""
    ns = f'xmlns:{prefix}="{MAIN}"' if prefix else f'xmlns="{MAIN}"'
    listed = "".join(f'<{p}sheet name="{n}" sheetId="{i + 1}" state="{s}" r:id="rId{i + 1}"/>' for i, (n, s, _) in enumerate(sheets))
    links = "".join(f'<Relationship Id="rId{i + 1}" Target="{"/xl/" if i % 2 else ""}worksheets/s{i + 1}.xml"/>' for i in range(len(sheets)))
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<{p}workbook {ns} xmlns:r="{RELATIONS}"><{p}sheets>{listed}</{p}sheets></{p}workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{links}</Relationships>')
        for i, (_, _, data) in enumerate(sheets):
            z.writestr(f"xl/worksheets/s{i + 1}.xml", f"<{p}worksheet {ns}><{p}sheetData>{data}</{p}sheetData></{p}worksheet>")
        if shared:
            items = "".join(f"<si>{s}</si>" for s in shared)
            z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{MAIN}">{items}</sst>')
    return str(path)


def inline(rows: dict[int, list], prefix: str = "") -> str:
    p = f"{prefix}:" if prefix else ""

    def one(n, i, v):
        return f'<{p}c r="{headers.column_letters(i)}{n}" t="inlineStr"><{p}is><{p}t>{v}</{p}t></{p}is></{p}c>' if v is not None else ""

    return "".join(f'<{p}row r="{n}">' + "".join(one(n, i, v) for i, v in enumerate(row)) + f"</{p}row>" for n, row in rows.items())


def test_sheets_are_chosen_by_name(spark, tmp_path):
    sheets = [("North & South", "visible", inline({1: ["river", "level"], 2: ["Elbe", "3.4"], 3: ["Oder", "2.2"]})), ("Gauge's log", "hidden", inline({1: ["gauge", "day"], 2: ["G-2", "11"]}))]
    path = book(tmp_path / "rivers.xlsx", [(n.replace("&", "&amp;"), s, d) for n, s, d in sheets])
    listed = values(workbooks.workbook_inventory(spark, str(tmp_path)), "sheet_index", "sheet", "visibility")
    assert listed == [(0, "North & South", "visible"), (1, "Gauge's log", "hidden")]
    store = DocumentStore(spark, scratch_dir(spark, "store"))
    (doc,) = ingest.ingest(store, path, sheets=["Gauge's log"])
    assert values(store.read(doc), "gauge", "day") == [("G-2", "11")]
    entry = store.entries(doc)[0]
    assert (entry.name, entry.source_file, entry.source_sheet, entry.row_count) == ("Gauge's log", "rivers.xlsx", "Gauge's log", 1)
    assert len(ingest.ingest(store, path)) == 2
    with pytest.raises(DocumentError):
        ingest.ingest(store, path, sheets=["nope"])


def test_tags_in_a_named_namespace(spark, tmp_path):
    rows = inline({1: ["field", "crop"], 2: ["051", "rye"], 3: ["052", "oat"], 4: ["053", "hop"]}, "ss")
    path = book(tmp_path / "p.xlsx", [("Harvest", "visible", rows)], prefix="ss")
    assert values(ingest.find_headers(spark, path), "header_row", "column_count") == [(1, 2)]
    ((names, rows),) = ingest.fleet_tables(spark, path)
    assert names == ["field", "crop"] and sorted(values(rows, *names)) == [("051", "rye"), ("052", "oat"), ("053", "hop")]


def test_every_way_to_store_a_cell(spark, tmp_path):
    data = (
        '<row r="1"><c r="A1" t="s"><v>1</v></c><c r="B1" t="inlineStr"><is><t>pitch</t></is></c><c r="C1" t="s"><v>0</v></c></row>'
        '<row r="2"><c r="A2"><v>440.5</v></c><c r="B2" t="inlineStr"><is><r><t>A</t></r><r><t> flat</t></r></is></c><c r="C2" t="b"><v>0</v></c></row>'
        '<row r="3"><c r="B3" t="str"><f>T("x")</f><v>low &lt; high</v></c><c r="C3" t="e"><v>#N/A</v></c></row>'
        '<row><c><v>5</v></c><c/><c t="s"><v>99</v></c></row>'
    )
    path = book(tmp_path / "k.xlsx", [("tones", "visible", data)], ["<r><t>tu</t></r><r><t>ned</t></r>", "<t>hertz</t><rPh><t>x</t></rPh>"])
    rows = sorted(values(workbooks.workbook_rows(spark, path), "row_number", "cells"))
    assert rows == [(1, ["hertz", "pitch", "tuned"]), (2, ["440.5", "A flat", "0"]), (3, [None, "low < high", "#N/A"]), (4, ["5", None, None])]
    assert values(ingest.find_headers(spark, path), "header_row", "column_count") == [(1, 3)]


def test_table_is_clipped_and_ends_at_the_first_empty_row(spark, tmp_path):
    rows = {1: ["TITULO"], 2: ["a", "b", "a", None], 3: ["1", "2", "3", "right of the table"], 4: [None, "5"], 5: [None, None, None, "outside"], 6: ["after", "a", "gap"]}
    path = book(tmp_path / "c.xlsx", [("s", "visible", inline(rows))])
    ((names, table),) = ingest.fleet_tables(spark, path)
    assert names == ["a", "b", "a_2"] and values(table.orderBy("_row_number"), *names) == [("1", "2", "3"), (None, "5", None)]


def test_fleet_of_layouts(spark, tmp_path):
    for i in range(3):
        book(tmp_path / f"w{i}.xlsx", [("s", "visible", inline({1: ["k", "v"], 2: [str(i), "x"]})), ("t", "visible", inline({1: ["other", "k", "v"], 2: ["a", "b", str(i)]}))])
    (tmp_path / "note.txt").write_text("no workbook")
    store = DocumentStore(spark, scratch_dir(spark, "store"))
    docs = ingest.ingest_workbooks(store, str(tmp_path))
    assert len(docs) == 6
    found = sorted((e.source_file, e.source_sheet, tuple(values(store.read(d).drop("_row_id"))[0])) for d in docs for e in store.entries(d))
    assert found == sorted([(f"w{i}.xlsx", "s", (str(i), "x")) for i in range(3)] + [(f"w{i}.xlsx", "t", ("a", "b", str(i))) for i in range(3)])


def test_export_and_read_back(spark, tmp_path):
    rows = [(i, f"<{i}> & 'x'", None if i % 2 else " pad ", float(i), bytes([i])) for i in range(25)]
    df = spark.createDataFrame([(i, *r[1:]) for i, r in enumerate(rows)], "_row_id bigint, t string, `c d` string, x double, b binary").coalesce(1)
    workbooks.write_workbooks(df, str(tmp_path / "out"), rows_per_file=11)
    assert len(list((tmp_path / "out").glob("*.xlsx"))) == 3 and not list((tmp_path / "out").glob(".staging*"))
    ((names, table),) = ingest.fleet_tables(spark, str(tmp_path / "out"))
    assert names == ["t", "c d", "x", "b"]
    expected = sorted((r[1], r[2], repr(r[3]), "<1 bytes>") for r in rows)
    got = [(t, c or None, x, b) for t, c, x, b in values(table, *[F.col(f"`{n}`") for n in names])]
    assert sorted(got, key=lambda r: r[0]) == expected


def test_overwrite_replaces_the_old_export(spark, tmp_path):
    out = tmp_path / "out"
    workbooks.write_workbooks(spark.range(5).coalesce(1), str(out))
    (out / "notes.txt").write_text("stays")
    workbooks.write_workbooks(spark.range(2).coalesce(1), str(out), mode="overwrite")
    assert len(list(out.glob("*.xlsx"))) == 1 and (out / "notes.txt").exists()
    assert workbooks.workbook_rows(spark, str(out)).count() == 3
    workbooks.write_workbooks(spark.range(2).coalesce(1), str(out))
    assert len(list(out.glob("*.xlsx"))) == 2


def test_empty_export_still_has_a_header(spark, tmp_path):
    workbooks.write_workbooks(spark.createDataFrame([], "a string, b string"), str(tmp_path / "none"))
    assert values(workbooks.workbook_rows(spark, str(tmp_path / "none")), "cells") == [(["a", "b"],)]


# --- sheets in chunks ---


def rows_of_chunks(data: bytes, size: int, strings=()):
    found = []
    for before, whole, markup in workbooks.row_chunks(io.BytesIO(data), size):
        found += workbooks.chunk_rows(markup, before, whole, dict(enumerate(strings)))
    return found


@pytest.mark.parametrize("size", [1, 200, 5000, 1 << 20])
@pytest.mark.parametrize("form", ["plain", "prefix", "numberless", "cdata", "utf-16", "empty", "none"])
def test_chunks_hold_every_row(size, form):
    """However the markup is cut, the rows are those of the whole sheet."""
    p = "x:" if form == "prefix" else ""
    rng = random.Random(3)
    rows, body, number = [], "", 0
    for i in range(0 if form in ("empty", "none") else 300):
        number = number + 1 if form == "numberless" and i % 3 else number + rng.choice([1, 1, 4])
        place = "" if form == "numberless" and i % 3 else f' r="{number}"'
        text = f"row {i} " + "w" * rng.randrange(90)
        shown = f"<![CDATA[</row>{text}]]>" if form == "cdata" and i == 150 else text
        body += f'<{p}row spans="1:2"{place}><{p}c t="inlineStr"><{p}is><{p}t>{shown}</{p}t></{p}is></{p}c><{p}c t="s"><{p}f>A1</{p}f><{p}v>{i % 2}</{p}v></{p}c></{p}row>'
        rows.append((number, [f"</row>{text}" if form == "cdata" and i == 150 else text, ["no", "yes"][i % 2]]))
    sheet = f"<{p}sheetData/>" if form == "none" else f"<{p}sheetData>{body}</{p}sheetData>"
    text = f'<?xml version="1.0" encoding="{"utf-16" if form == "utf-16" else "UTF-8"}"?><{p}worksheet xmlns{":x" if p else ""}="{MAIN}"><{p}cols/>{sheet}<{p}mergeCells/></{p}worksheet>'
    assert rows_of_chunks(text.encode("utf-16" if form == "utf-16" else "utf-8"), size, ["no", "yes"]) == rows


def test_a_sheet_is_parsed_by_many_tasks_and_opened_once(spark, tmp_path):
    data = inline({1: ["k", "v"]} | {i: [str(i), f"value {i}"] for i in range(2, 6000)})
    path = book(tmp_path / "one.xlsx", [("s", "visible", data)])
    rows = workbooks.workbook_rows(spark, path, chunk_bytes=20_000)
    assert rows.withColumn("task", F.spark_partition_id()).groupBy("task").count().count() >= 8
    found = sorted(values(rows, "row_number", "cells"))
    assert found == [(1, ["k", "v"])] + [(i, [str(i), f"value {i}"]) for i in range(2, 6000)]
    # Opening is seen from outside: what an ingest needs of the file must not be there for a second look.
    raw = workbooks.workbook_rows(spark, path)
    assert raw.rdd.getNumPartitions() >= 8
    opened = tmp_path / "opened"

    def counted(batches):
        for batch in batches:
            with open(opened, "a") as log:
                log.write("x" * batch.num_rows)
            yield batch

    listed = workbooks._files
    try:
        workbooks._files = lambda s, p: listed(s, p).mapInArrow(counted, "path string")
        store = DocumentStore(spark, scratch_dir(spark, "store"))
        (doc,) = ingest.ingest(store, path)
    finally:
        workbooks._files = listed
    assert opened.read_text() == "x"
    assert sorted(values(store.read(doc), "_row_id", "k")) == [(i - 2, str(i)) for i in range(2, 6000)]


# --- plain markup of workbooks, read and written by whole columns ---


def by_parser(markup, strings=None):
    return workbooks.chunk_rows(markup, 0, False, strings or {})


PLAIN = [
    b'<row r="3"><c r="A3" t="inlineStr"><is><t xml:space="preserve"> a &amp;lt; &lt;b&gt; &quot;q&quot;&apos;&#13;\n </t></is></c><c r="C3"><v>1.5</v></c></row>',
    b'<row r="5" spans="1:3" x14ac:dyDescent="0.25"><c r="B5" s="2" t="s"><v>1</v></c><c r="AA5" s="1"/><c r="D5" t="s"><v> 7 </v></c><c r="E5" t="s"><v>x</v></c></row><row r="9"/>',
    b'<row r="1"><c r="B1"><v>late</v></c><c r="A1"><v>early</v></c><c r="B1"><v>again</v></c><c r="C1"></c></row> \n<row r="2"></row><row r="4"><c r="XFD4"><v>\xc3\xa9</v></c></row>',
    b'<row r="7"><c r="A7" t="inlineStr"><is><t></t></is></c></row>',
]
OTHER = [
    b'<row><c r="A1"><v>1</v></c></row>',
    b'<row r="2"><c><v>1</v></c></row>',
    b'<x:row r="2"><x:c r="A2"><x:v>1</x:v></x:c></x:row>',
    b'<row r="2"><c r="A2" t="inlineStr"><is><r><t>rich</t></r><r><t> text</t></r></is></c></row>',
    b'<row r="2"><c r="A2"><f>B2+1</f><v>1</v></c></row>',
    b'<row r="2"><!-- <c r="B2"> --><c r="A2"><v>a&#65;</v></c></row>',
    b"<row r='2'><c r='A2'><v>1</v></c></row>",
    b'<row r="2"><c r="A2"><v>a\r\nb &gt; c > d</v></c></row>',
    b'<row r="2"><c r="a2"><v>1</v></c><c t="s" r="B2"><v>0</v></c></row>',
]


@pytest.mark.parametrize("markup", PLAIN)
def test_plain_markup_is_read_as_by_the_parser(markup):
    strings = {1: "one", 7: "seven"}
    numbers, cells = workbooks.plain_rows(markup, strings)
    assert list(zip(numbers.to_pylist(), cells.to_pylist())) == by_parser(markup, strings)


@pytest.mark.parametrize("markup", OTHER)
def test_other_markup_is_left_to_the_parser(markup):
    assert workbooks.plain_rows(markup, {}) is None and len(by_parser(markup)) == 1


@pytest.mark.parametrize("markup", [b'<row r="1"><c r="A1"><v>\x01</v></c></row>', b'<row r="1"><c r="A1"><v>\xff</v></c></row>', b'<row r="1"><c r="A1"><v>1</c></row>', b'<row r="1"><c r="A1" r="B1"><v>1</v></c></row>'])
def test_broken_markup_is_left_to_the_parser(markup):
    assert workbooks.plain_rows(markup, {}) is None
    with pytest.raises(Exception, match="not well-formed|mismatched|duplicate"):
        by_parser(markup)


def test_plain_rows_of_random_cells():
    """Changed at random, plain markup is either read as by the parser or left to it."""
    rng, read = random.Random(8), 0
    for _ in range(3000):
        markup = bytearray(rng.choice(PLAIN + OTHER))
        for _ in range(rng.randrange(3)):
            at = rng.randrange(len(markup))
            markup[at : at + rng.randrange(2)] = rng.choice([b"<", b">", b'"', b" ", b"1", b"c", b"&", b"/", b"r"])
        plain = workbooks.plain_rows(bytes(markup), {1: "one"})
        if plain is not None:
            assert list(zip(plain[0].to_pylist(), plain[1].to_pylist())) == by_parser(bytes(markup), {1: "one"}), bytes(markup)
            read += 1
    assert read > 300


def test_written_cells_are_read_back(spark, tmp_path):
    """Cells with marks, blanks and control characters, more rows than a sheet takes, and slices of a batch."""
    texts = ["a & b", "<c>", "\r\n", "\x01x￾", None, "", " é ", "]]>", "'\"", "ﬁ"]
    rows = [(i, texts[i % 10], texts[i * 7 % 10]) for i in range(1, 501)]
    workbooks.write_workbooks(spark.createDataFrame(rows, "n int, a string, b string").coalesce(1), str(tmp_path / "out"), rows_per_file=150)
    got = values(workbooks.workbook_rows(spark, str(tmp_path / "out")).where("row_number > 1"), "cells")
    shown = {t: (t or "").replace("\x01", "").replace("￾", "") for t in texts}
    assert sorted(([int(n), a, b] for ((n, a, b),) in got)) == [[n, shown[a], shown[b]] for n, a, b in rows]
    assert len(list((tmp_path / "out").glob("*.xlsx"))) == 4


def test_row_numbers_behind_a_chunk():
    named, bare = b'<row r="%d"><c><v>1</v></c></row>', b"<row><c><v>1</v></c></row>"
    for rows in ([bare] * 900, [named % 12, *[bare] * 900], [bare, named % 40, bare, named % 90], [named % 5] * 3):
        number = 2
        for row in rows:
            number = int(row[8:].split(b'"')[0]) if b"r=" in row else number + 1
        assert workbooks._last_number(b"".join(rows), 2) == number


def test_table_ends(spark):
    """Words of rows: gaps at and around their borders, rows out of order and twice, and rows cut at the header's width."""
    w = ingest.WORD
    kept = {"gap": [*range(3, 3 + 2 * w), 4 + 2 * w], "full": [*range(3, 3 + 2 * w)], "inside": [*range(3, 20), *range(21, 200)], "twice": [3, 3, 4, 5, 5, 7], "alone": [3, 5], "border": [*range(3, 3 + w), 4 + w]}
    flat = [("p", i, s, r, ["x"]) for i, (s, found) in enumerate(kept.items()) for r in found[::-1]] + [("p", 4, "alone", 4, ["", " ", "z"])]
    rows = spark.createDataFrame(flat, workbooks.ROWS_SCHEMA)
    heads = rows.select(*ingest.SHEET).distinct().selectExpr("*", "3L as header_row", "2 as column_count")
    got = values(ingest.table_rows(rows, heads).groupBy("sheet").agg(F.max("row_number"), F.count("*")), "*")
    assert sorted(got) == [("alone", 3, 1), ("border", 2 + w, w), ("full", 2 + 2 * w, 2 * w), ("gap", 2 + 2 * w, 2 * w), ("inside", 19, 17), ("twice", 5, 5)]


def test_a_task_for_every_sheet(spark, monkeypatch):
    from sheetloom.suite import files

    monkeypatch.setattr(workbooks, "SHEET_ROWS", 100)
    monkeypatch.setattr(files, "SHEET_FILL", 90)
    assert [files._in_sheets(spark.range(n), least).rdd.getNumPartitions() for n, least in ((99, 1), (100, 1), (900, 1), (5, 8))] == [1, 2, 10, 8]
    assert sorted(values(files._in_sheets(spark.range(250)))) == [(i,) for i in range(250)]


def test_survey_sorts_no_lines(spark, tmp_path, monkeypatch):
    """The facts of a split are numbers, hashed; its first line is fetched by its number, also behind blank lines."""
    for name, text in {"a": "\n \nk,n\n1,2\n\n3,4,5\n", "b": "k,n\r\n" + "6,7\r\n" * 20_000, "c": "\n\n"}.items():
        (tmp_path / f"{name}.csv").write_text(text, newline="")
    plans, write = [], splits.stored

    def stored(df, purpose):
        plans.append(df._jdf.queryExecution().toString())
        return write(df, purpose)

    monkeypatch.setattr(splits, "stored", stored)
    found = delimited.survey(spark, str(tmp_path))
    assert list(found.layouts) == ["k,n"] and found.width == 3 and not found.multi_line
    assert "SortAggregate" not in plans[0] and "HashAggregate" in plans[0]
    rows = values(delimited.named_rows(found).orderBy("_row_id"))
    assert rows[:3] == [(0, "1", "2", None), (1, "3", "4", "5"), (2, "6", "7", None)] and len(rows) == 20_002


# --- disk of workbooks and ingest ---


def shuffles(df):
    return "Exchange" in df._jdf.queryExecution().executedPlan().toString()


def test_many_workbooks_are_read_without_a_shuffle(spark, tmp_path, monkeypatch):
    """With workbooks of like size for every core no markup is moved; with a large one among them its chunks are dealt out. The rows are the same."""
    monkeypatch.setattr(workbooks, "BOOKS_PER_CORE", 1)
    path = str(tmp_path / "out")
    table = spark.range(0, 960, 1, 12).selectExpr("id", "concat('text ', id) as t")
    workbooks.write_workbooks(table, path)
    rows = workbooks.workbook_rows(spark, path)
    expected = sorted((str(i), f"text {i}") for i in range(960))
    assert not shuffles(rows) and sorted(tuple(c) for (c,) in values(rows.where("row_number > 1"), "cells")) == expected
    workbooks.write_workbooks(spark.range(1000, 31_000).coalesce(1).selectExpr("id", "concat('text ', id) as t"), path)
    rows = workbooks.workbook_rows(spark, path)
    assert shuffles(rows) and sorted(tuple(c) for (c,) in values(rows.where("row_number > 1"), "cells")) == sorted(expected + [(str(i), f"text {i}") for i in range(1000, 31_000)])
    (few := tmp_path / "few").mkdir()
    book(few / "one.xlsx", [("s", "visible", inline({1: ["k", "v"], 2: ["1", "2"]}))])
    assert shuffles(workbooks.workbook_rows(spark, str(few)))


def test_dealt_markup_is_packed(tmp_path):
    data = inline({i: [str(i * 7919 % 10_007), f"value {i}"] for i in range(1, 5000)})
    path = book(tmp_path / "one.xlsx", [("s", "visible", data)], ["<t>a</t>"])
    listed = pa.record_batch([pa.array([path])], names=["path"])
    plain = list(workbooks._chunks(iter([listed]), None, None, 100_000))
    packed = list(workbooks._packed(workbooks._chunks(iter([listed]), None, None, 100_000)))
    assert len(packed) == len(plain) > 2 and sum(b.nbytes for b in packed) * 5 < sum(len(c["markup"]) for c in plain)
    assert [{k: c[k] for k in plain[0]} for c in workbooks._dealt(iter(packed))] == plain


def test_rows_between_workbooks_and_documents_go(spark, tmp_path):
    """An ingest, also one of several layouts or one that fails, leaves no copy of the rows besides its documents."""
    for i in range(2):
        tall = {1: ["k", "v"]} | {r: [str(r), f"{i}"] for r in range(2, 200)}
        book(tmp_path / f"w{i}.xlsx", [("s", "visible", inline(tall)), ("t", "visible", inline({1: ["other", "k", "v"], 2: ["a", "b", str(i)]}))])
    before = set(os.listdir(spark.conf.get("spark.checkpoint.dir").removeprefix("file:"))) if spark.conf.get("spark.checkpoint.dir", None) else set()
    store = DocumentStore(spark, scratch_dir(spark, "store"))
    docs = ingest.ingest_workbooks(store, str(tmp_path))
    assert sorted(store.read(d).count() for d in docs) == [1, 1, 198, 198]
    book(tmp_path / "headless.xlsx", [("u", "visible", inline({1: ["5"]}))])
    with pytest.raises(DocumentError):
        ingest.ingest_workbooks(store, str(tmp_path), ["u"])
    root = spark.conf.get("spark.checkpoint.dir").removeprefix("file:")
    for folder in set(os.listdir(root)) - before - {os.path.basename(store.root)}:
        kept = spark.read.option("recursiveFileLookup", "true").parquet(f"{root}/{folder}")
        assert "cells" not in kept.columns or kept.count() <= 4 * ingest.SCAN_ROWS, folder


def test_documents_beyond_the_writers_of_a_task(spark, monkeypatch):
    monkeypatch.setattr(session, "MOST_WRITERS", 2)
    key = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(key)
    with session.several_writers(spark, 3):
        assert spark.conf.get(key) == "2"
    with session.several_writers(spark, 600):
        assert spark.conf.get(key) == "1"
    with session.several_writers(spark, 5000):
        assert spark.conf.get(key) == "0"
    store = DocumentStore(spark, scratch_dir(spark, "store"))
    rows = spark.range(700).coalesce(1).selectExpr("id as _row_id", "id % 7 as _sheet_index", "concat('s', id % 7) as _sheet", "'p' as _path", "cast(id as string) as v")
    docs = store.create_many(rows, ["_path", "_sheet_index", "_sheet"], F.col("_sheet"))
    assert len(docs) == 7 and spark.conf.get(key) == before
    assert sorted(tuple(r) for d in docs for r in store.read(d).collect()) == [(i, str(i)) for i in range(700)]


def test_rows_that_fill_sheets_stay_where_they_are(spark, monkeypatch):
    from sheetloom.suite import files

    monkeypatch.setattr(workbooks, "SHEET_ROWS", 100)
    monkeypatch.setattr(files, "SHEET_FILL", 90)
    full, small = spark.range(0, 8000, 1, 16), spark.range(0, 160, 1, 16)
    uneven = spark.range(0, 4000, 1, 1).union(spark.range(4000, 8000, 1, 15))
    for rows, least, parts, moved in ((full, 8, 16, False), (full, 20, 89, True), (small, 8, 8, True), (uneven, 8, 89, True)):
        dealt = files._in_sheets(rows, least)
        assert (dealt.rdd.getNumPartitions(), shuffles(dealt)) == (parts, moved)
        assert sorted(values(dealt)) == sorted(values(rows))


def test_cells_name_the_blanks_they_keep(spark, tmp_path):
    rows = [("a", " b"), ("", "c\n"), (None, "d"), (" ", "\r")]
    workbooks.write_workbooks(spark.createDataFrame(rows, "x string, y string").coalesce(1), str(tmp_path / "out"))
    (path,) = (tmp_path / "out").glob("*.xlsx")
    markup = zipfile.ZipFile(path).read("xl/worksheets/sheet1.xml").decode()
    assert '<c r="A2" t="inlineStr"><is><t>a<' in markup and '<c r="B2" t="inlineStr"><is><t xml:space="preserve"> b<' in markup
    assert values(workbooks.workbook_rows(spark, str(tmp_path / "out")).where("row_number > 1").orderBy("row_number"), "cells") == [([x or "", y],) for x, y in rows]
