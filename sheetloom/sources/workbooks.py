"""Spreadsheet workbooks in and out.

Reading takes two stages. Spark lists the files; a task opens a workbook once, unpacks its sheets and cuts the markup behind rows into chunks of about
``CHUNK_BYTES``, with the shared strings that a chunk refers to and the number of the row before it. The chunks are packed, dealt out and parsed, so the rows of one
large sheet come from many tasks, and neither the driver nor planning opens a workbook. Where the listing shows several workbooks of like size for every core, both
stages are one and no markup is moved. Writing: each task streams its rows into workbooks of its own and starts a new one when a sheet is full.
"""

from __future__ import annotations

import posixpath
import re
import uuid
import zipfile
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache
from xml.etree.ElementTree import iterparse
from xml.parsers import expat
from xml.sax.saxutils import escape

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from sheetloom.functions.text import cell, text_view
from sheetloom.operators.grid import ROW_ID
from sheetloom.sources.headers import column_letters

SOURCE = "sheetloom_workbook"
BATCH_ROWS = 10_000
CHUNK_BYTES = 2 << 20
WRITE_BYTES = 4 << 20
# The most rows of a sheet, the sheet name of an export, and the package parts of a workbook.
SHEET_ROWS = 1_048_576
EXPORT_SHEET = "Dados"
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
RELATIONS = "http://schemas.openxmlformats.org/package/2006/relationships"
OFFICE = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
TYPES = "http://schemas.openxmlformats.org/package/2006/content-types"
EXTENSIONS = (".xlsx", ".xlsm")

ROWS_SCHEMA = "path string, sheet_index int, sheet string, row_number bigint, cells array<string>"
SHEETS_SCHEMA = "path string, sheet_index int, sheet string, visibility string"


# --- package parsing, used inside tasks ----------------------------------------------------------------------------


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _attribute(element, name: str) -> str | None:
    return next((v for k, v in element.attrib.items() if _local(k) == name), None)


def sheet_list(book: zipfile.ZipFile) -> list[tuple[str, str, str]]:
    """``(name, visibility, part)`` of the sheets in workbook order; prefixed XML namespaces are fine."""
    targets = {}
    with book.open("xl/_rels/workbook.xml.rels") as part:
        for _, element in iterparse(part):
            if _local(element.tag) == "Relationship":
                target = element.attrib.get("Target", "")
                absolute = target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join("xl", target))
                targets[element.attrib.get("Id")] = absolute
    sheets = []
    with book.open("xl/workbook.xml") as part:
        for _, element in iterparse(part):
            if _local(element.tag) == "sheet":
                key = next((v for k, v in element.attrib.items() if _local(k) == "id" and k != "id"), _attribute(element, "id"))
                sheets.append((element.attrib["name"], element.attrib.get("state", "visible"), targets.get(key, "")))
    return sheets


def _shared_strings(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    strings, inside_phonetic, text = [], 0, []
    with book.open("xl/sharedStrings.xml") as part:
        for event, element in iterparse(part, ("start", "end")):
            tag = _local(element.tag)
            if tag == "rPh":
                inside_phonetic += 1 if event == "start" else -1
            elif event == "end" and tag == "t" and not inside_phonetic:
                text.append(element.text or "")
            elif event == "end" and tag == "si":
                strings.append("".join(text))
                text = []
                element.clear()
    return strings


# Markup of rows as bytes, with or without a prefix.
ROW = re.compile(rb"<(?:[\w.-]+:)?row(?=[\s>/])([^>]*)>")
ROW_END = re.compile(rb"</(?:[\w.-]+:)?row\s*>")
ROW_NUMBER = re.compile(rb"""(?<![\w:])r\s*=\s*["'](\d+)["']""")
BODY = re.compile(rb"<(?:[\w.-]+:)?sheetData(?=[\s>/])[^>]*>")
BODY_END = re.compile(rb"</(?:[\w.-]+:)?sheetData\s*>")
SHARED = re.compile(rb"""\bt\s*=\s*["']s["'][^>]*>(?:(?!</(?:[\w.-]+:)?c\s*>).)*?<(?:[\w.-]+:)?v(?=[\s>])[^>]*>\s*(\d+)""", re.DOTALL)


def row_chunks(stream, size: int) -> Iterator[tuple[int, bool, bytes]]:
    """(row number before, whole, markup) of a sheet, cut behind rows; a ``whole`` chunk is a document of its own.

    Markup that cannot be cut by looking for row ends, in other encodings or from a CDATA section on, stays together.
    """
    buffer, number, started, ended = b"", 0, False, False
    while True:
        piece = stream.read(max(64, min(1 << 18, size)))
        buffer, last = buffer + piece, not piece
        if not started:
            if buffer[:2] in (b"\xff\xfe", b"\xfe\xff") or re.match(rb"""<\?xml[^>]*encoding\s*=\s*["'](?!utf-8["'])""", buffer[:200], re.IGNORECASE):
                yield 0, True, buffer + stream.read()
                return
            body = BODY.search(buffer)
            if body is None:
                if last:
                    return
                continue
            if body[0].rstrip(b">").endswith(b"/"):
                return
            started, buffer, piece = True, buffer[body.end() :], b""
        fresh = buffer[-len(piece) - 64 :] if piece else buffer  # what earlier rounds have not seen whole
        if b"<![CDATA[" in fresh:
            rest = buffer + stream.read()
            ends = list(BODY_END.finditer(rest))
            yield number, False, rest[: ends[-1].start()] if ends else rest
            return
        end = BODY_END.search(buffer) if b"sheetData" in fresh else None
        ended = end is not None or last
        if ended:
            buffer = buffer[: end.start()] if end else buffer
        elif len(buffer) < size:
            continue
        # Backwards in growing stretches: the last row end is near the end of the buffer.
        cut, stretch = len(buffer) if ended else 0, 1 << 14
        while not cut and stretch < 2 * len(buffer):
            cut = max((m.end() for m in ROW_END.finditer(buffer, max(0, len(buffer) - stretch))), default=0)
            stretch *= 4
        if cut and buffer[:cut].strip():
            chunk, buffer = buffer[:cut], buffer[cut:]
            yield number, False, chunk
            number = _last_number(chunk, number)
        if ended:
            return


def _last_number(markup: bytes, number: int) -> int:
    """The number of the last row, from the last row that names its own and the rows behind it, or else from the number before."""
    stretch = 1 << 14
    while True:
        heads = ROW.findall(markup, max(0, len(markup) - stretch))
        for behind, head in enumerate(reversed(heads)):
            if named := ROW_NUMBER.search(head):
                return int(named[1]) + behind
        if stretch >= len(markup):
            return number + len(heads)
        stretch *= 4


def chunk_rows(markup: bytes, before: int, whole: bool, strings: dict[int, str]) -> list[tuple[int, list[str | None]]]:
    """``(row number, cells)`` of a chunk, from one event loop."""
    found = _Rows(strings, before)
    parser = expat.ParserCreate()
    parser.buffer_text = True
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = found.start, found.end, found.text
    if whole:
        parser.Parse(markup, True)
    else:
        parser.Parse(b"<rows>", False)
        parser.Parse(markup, False)
        parser.Parse(b"</rows>", True)
    return found.rows


# Tags as spreadsheet programs write them, and what may stand behind what; rows and cells have attributes of their own.
HEAD, TAIL, CELL, CELL_END, INLINE, INLINE_END, TEXT, TEXT_END, VALUE, VALUE_END, LONE_CELL, LONE_ROW = range(12)
PLAIN_TAGS = {
    b"</row>": TAIL, b"</c>": CELL_END, b"<is>": INLINE, b"</is>": INLINE_END, b"<t>": TEXT, b'<t xml:space="preserve">': TEXT, b"</t>": TEXT_END, b"<v>": VALUE, b"</v>": VALUE_END,
}
FOLLOWERS = np.zeros((12, 12), bool)
for _tag, _next in {
    HEAD: (CELL, LONE_CELL, TAIL), TAIL: (HEAD, LONE_ROW), LONE_ROW: (HEAD, LONE_ROW), CELL: (INLINE, VALUE, CELL_END), INLINE: (TEXT,), TEXT: (TEXT_END,),
    TEXT_END: (INLINE_END,), INLINE_END: (CELL_END,), VALUE: (VALUE_END,), VALUE_END: (CELL_END,), CELL_END: (CELL, LONE_CELL, TAIL), LONE_CELL: (CELL, LONE_CELL, TAIL),
}.items():
    FOLLOWERS[_tag, _next] = True
ATTRIBUTE = rb' ([A-Za-z][\w:]*)="([^"&]*)"'
PLAIN_ROW = re.compile(rb'<row r="([0-9]{1,18})"((?:' + ATTRIBUTE + rb")*) ?/?>")
PLAIN_CELL_REST = re.compile(rb"(?:" + ATTRIBUTE + rb")* ?/?>")
OTHER_ENTITY = re.compile(rb"&(?!(?:amp|lt|gt|quot|apos|#13);)")
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&apos;": "'", "&#13;": "\r", "&amp;": "&"}
CONTROL = np.array([i < 32 and i not in (9, 10) for i in range(256)])
MOST_CELLS = 4_000_000


def _between(starts: np.ndarray, ends: np.ndarray, data: pa.Buffer) -> pa.Array:
    """The bytes from start to end and from there to the next start, in turn."""
    offsets = np.empty(2 * len(starts), np.int32)
    offsets[::2], offsets[1::2] = starts, ends
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), data])


def _is_text(markup: bytes) -> bool:
    try:
        return not re.search("[\ufffe\uffff]", markup.decode())
    except UnicodeDecodeError:
        return False


def _attributes(markup: bytes) -> dict[bytes, bytes] | None:
    """Attributes by name; none twice, and none that says again where a row or cell is."""
    found = re.findall(ATTRIBUTE, markup)
    return dict(found) if len({name for name, _ in found} | {b"r"}) == len(found) + 1 else None


def plain_rows(markup: bytes, strings: dict[int, str]) -> tuple[pa.Array, pa.Array] | None:
    """Row numbers and cells of a chunk in the form that spreadsheet programs write, all tags at once; None for any other form, which needs the parser."""
    if len(markup) >= 1 << 31 or OTHER_ENTITY.search(markup) or not (markup.isascii() or _is_text(markup)):
        return None
    at = np.frombuffer(markup, np.uint8)
    opened, closed = np.flatnonzero(at == ord("<")), np.flatnonzero(at == ord(">"))
    if len(opened) != len(closed) or not len(opened) or (opened >= closed).any() or (closed[:-1] >= opened[1:]).any() or CONTROL[at[at < 32]].any():
        return None
    data = pa.py_buffer(markup)
    pieces = _between(opened, closed + 1, data)
    first, second, lone = at[opened + 1], at[np.minimum(opened + 2, len(at) - 1)], at[closed - 1] == ord("/")
    is_cell, is_row = (first == ord("c")) & (second == ord(" ")), (first == ord("r")) & (second == ord("o"))
    tags = np.empty(len(opened), np.int8)
    tags[is_cell], tags[is_row] = np.where(lone[is_cell], LONE_CELL, CELL), np.where(lone[is_row], LONE_ROW, HEAD)
    others = np.flatnonzero(~is_cell & ~is_row)
    named = pieces.take(pa.array(2 * others)).dictionary_encode()
    kinds = [PLAIN_TAGS.get(tag) for tag in named.dictionary.to_pylist()]
    if None in kinds:
        return None
    tags[others] = np.array(kinds, np.int8)[named.indices.to_numpy()]
    if tags[0] not in (HEAD, LONE_ROW) or tags[-1] not in (TAIL, LONE_ROW) or not FOLLOWERS[tags[:-1], tags[1:]].all():
        return None

    known: dict[bytes, bool] = {}
    numbers = []
    for row in pieces.take(pa.array(2 * np.flatnonzero(is_row))).to_pylist():
        found = PLAIN_ROW.fullmatch(row)
        if found is None or not known.setdefault(found[2], _attributes(found[2]) is not None):
            return None
        numbers.append(int(found[1]))
    cells = np.flatnonzero(is_cell)
    if not len(cells):
        return pa.array([], pa.int64()), pa.array([], pa.list_(pa.string()))

    # <c r="AB12" ...: up to three capital letters and some digits.
    start = opened[cells]
    if closed[cells][-1] + 16 > len(at):
        at = np.concatenate([at, np.zeros(16, np.uint8)])
    if not ((at[start + 3] == ord("r")) & (at[start + 4] == ord("=")) & (at[start + 5] == ord('"'))).all():
        return None
    place, column, going = start + 6, np.zeros(len(cells), np.int64), np.ones(len(cells), bool)
    for _ in range(3):
        going &= (at[place] >= ord("A")) & (at[place] <= ord("Z"))
        column, place = np.where(going, column * 26 + at[place] - (ord("A") - 1), column), place + going
    letters, going = place, np.ones(len(cells), bool)
    for _ in range(9):
        going &= (at[place] >= ord("0")) & (at[place] <= ord("9"))
        place = place + going
    if (letters == start + 6).any() or (place == letters).any() or (at[place] != ord('"')).any():
        return None
    rest = _between(place + 1, closed[cells] + 1, data)[::2].dictionary_encode()
    rests = rest.dictionary.to_pylist()
    attributes = [_attributes(r) if PLAIN_CELL_REST.fullmatch(r) else None for r in rests]
    if None in attributes:
        return None

    behind = tags[cells + 1]
    text_at = np.where(behind == VALUE, 2 * cells + 3, 2 * cells + 5)
    empty = (tags[cells] == LONE_CELL) | (behind == CELL_END)
    texts = pieces.take(pa.array(np.where(empty, 0, text_at), mask=empty)).cast(pa.string())
    if b"&" in markup:
        for entity, character in ENTITIES.items():
            texts = pc.replace_substring(texts, entity, character)
    shared = np.array([a.get(b"t") == b"s" for a in attributes])[rest.indices.to_numpy()]
    if shared.any():
        looked_up = [None if t is None or not t.strip().isdigit() else strings.get(int(t)) for t in texts.filter(pa.array(shared)).to_pylist()]
        texts = pc.replace_with_mask(texts, pa.array(shared), pa.array(looked_up, pa.string()))

    row_of = np.cumsum(is_row)[cells] - 1
    starts = np.flatnonzero(np.diff(row_of, prepend=-1))
    offsets = np.concatenate([[0], np.cumsum(np.maximum.reduceat(column, starts))])
    if offsets[-1] > MOST_CELLS:
        return None
    index = np.full(offsets[-1], -1)
    index[np.repeat(offsets[:-1], np.diff(starts, append=len(cells))) + column - 1] = np.arange(len(cells))
    values = texts.take(pa.array(index, mask=index < 0))
    return pa.array(np.array(numbers, np.int64)[row_of[starts]]), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


@lru_cache(maxsize=20_000)
def _column_of(letters: str) -> int:
    column = 0
    for letter in letters:
        column = column * 26 + ord(letter.upper()) - ord("A") + 1
    return column - 1


class _Rows:
    """Parser events of one sheet, collected into finished rows."""

    def __init__(self, strings: dict[int, str], before: int):
        self.strings = strings
        self.number, self.column, self.cells = before, -1, {}
        self.kind, self.texts, self.inside = None, None, False
        self.rows: list[tuple[int, list[str | None]]] = []
        self.done = False
        self.locals: dict[str, str] = {}

    def _tag(self, name: str) -> str:
        tag = self.locals.get(name)
        if tag is None:
            tag = self.locals[name] = name.rpartition(":")[2]
        return tag

    def start(self, name: str, attributes: dict) -> None:
        tag = self._tag(name)
        if tag == "c":
            place = attributes.get("r")
            self.column = _column_of(place.rstrip("0123456789")) if place else self.column + 1
            self.kind, self.texts = attributes.get("t"), None
        elif tag in ("v", "t"):
            self.inside = True
            self.texts = self.texts or []
        elif tag == "row":
            self.number = int(attributes.get("r") or self.number + 1)
            self.column, self.cells = -1, {}

    def text(self, data: str) -> None:
        if self.inside:
            self.texts.append(data)

    def end(self, name: str) -> None:
        tag = self._tag(name)
        if tag in ("v", "t"):
            self.inside = False
        elif tag == "c":
            text = None if self.texts is None else "".join(self.texts)
            if text is not None and self.kind == "s":
                text = self.strings.get(int(text)) if text.strip().isdigit() else None
            self.cells[self.column] = text
        elif tag == "row":
            if self.cells and not self.done:
                self.rows.append((self.number, [self.cells.get(i) for i in range(max(self.cells) + 1)]))
        elif tag == "sheetData":
            self.done = True


# --- files ---------------------------------------------------------------------------------------------------------


def _filesystem(path: str) -> tuple[pafs.FileSystem, str]:
    """File system and path below it. Spark's spellings of a URI differ a little from Arrow's."""
    if not re.match(r"[a-z0-9]+:", path):
        return pafs.LocalFileSystem(), path
    return pafs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", re.sub(r"^s3[an]:", "s3:", path)))


def _open_book(path: str) -> zipfile.ZipFile:
    system, location = _filesystem(path)
    return zipfile.ZipFile(system.open_input_file(location))


# --- reader --------------------------------------------------------------------------------------------------------

CHUNKS_SCHEMA = "path string, sheet_index int, sheet string, chunk int, before bigint, whole boolean, size bigint, packed binary, string_ids array<int>, strings array<string>"
CODEC = "zstd"
#: Workbooks for every core from which on a task reads its workbooks alone.
BOOKS_PER_CORE = 3


def _chunks(batches: Iterator[pa.RecordBatch], wanted: tuple[str, ...] | None, last_row: int | None, size: int) -> Iterator[dict]:
    """The chunks of the wanted sheets of every workbook; those of one sheet up to ``last_row`` at least."""
    for batch in batches:
        for path in batch.column("path").to_pylist():
            with _open_book(path) as book:
                strings: list[str] | None = None
                for index, (name, _, part) in enumerate(sheet_list(book)):
                    if not part or (wanted is not None and name not in wanted):
                        continue
                    with book.open(part) as stream:
                        for chunk, (before, whole, markup) in enumerate(row_chunks(stream, size)):
                            if last_row is not None and before >= last_row:
                                break
                            if strings is None and (whole or b"s" in markup):
                                strings = _shared_strings(book)
                            used = range(len(strings or ())) if whole or not strings else sorted({i for i in map(int, SHARED.findall(markup)) if i < len(strings)})
                            yield {
                                "path": path, "sheet_index": index, "sheet": name, "chunk": chunk, "before": before, "whole": whole, "markup": markup,
                                "string_ids": list(used), "strings": [strings[i] for i in used],
                            }


def _packed(chunks: Iterator[dict]) -> Iterator[pa.RecordBatch]:
    """Chunks as rows, their markup packed as a whole: the small blocks of a shuffle would take several times as much."""
    kinds = {
        "path": pa.string(), "sheet_index": pa.int32(), "sheet": pa.string(), "chunk": pa.int32(), "before": pa.int64(), "whole": pa.bool_(), "size": pa.int64(),
        "packed": pa.binary(), "string_ids": pa.list_(pa.int32()), "strings": pa.list_(pa.string()),
    }
    for c in chunks:
        c |= {"size": len(c["markup"]), "packed": pa.compress(c["markup"], codec=CODEC, asbytes=True)}
        yield pa.record_batch([pa.array([c[name]], kind) for name, kind in kinds.items()], names=list(kinds))


def _dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for c in batch.to_pylist():
            yield c | {"markup": pa.decompress(c["packed"], c["size"], codec=CODEC, asbytes=True)}


def _parsed(chunks: Iterator[dict]) -> Iterator[pa.RecordBatch]:
    for c in chunks:
        strings = dict(zip(c["string_ids"], c["strings"]))
        plain = None if c["whole"] else plain_rows(c["markup"], strings)
        if plain is None:
            rows = chunk_rows(c["markup"], c["before"], c["whole"], strings)
            plain = pa.array([n for n, _ in rows], pa.int64()), pa.array([cells for _, cells in rows], pa.list_(pa.string()))
        for start in range(0, len(plain[0]), BATCH_ROWS):
            numbers, cells = (column.slice(start, BATCH_ROWS) for column in plain)
            n = len(numbers)
            columns = [pa.array([c["path"]] * n, pa.string()), pa.array([c["sheet_index"]] * n, pa.int32()), pa.array([c["sheet"]] * n, pa.string())]
            yield pa.record_batch([*columns, numbers, cells], names=["path", "sheet_index", "sheet", "row_number", "cells"])


def _listed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.xls[xm]").option("recursiveFileLookup", "true").load(path)


def _files(spark: SparkSession, path: str) -> DataFrame:
    """The workbooks at a path, listed by Spark without their contents."""
    return _listed(spark, path).select("path")


def _a_task_each(spark: SparkSession, path: str) -> bool:
    """Whether the workbooks keep all cores busy without being cut: several for every core, none above a core's even share of their bytes."""
    cores = spark.sparkContext.defaultParallelism
    found = _listed(spark, path).agg(F.count("*").alias("n"), F.max("length").alias("largest"), F.sum("length").alias("total")).first()
    return found.n >= BOOKS_PER_CORE * cores and found.largest * cores <= found.total


# --- writer --------------------------------------------------------------------------------------------------------


@dataclass
class _Written(WriterCommitMessage):
    files: list[str]


class _SheetStream:
    """One workbook being written: a header row and rows of inline strings."""

    def __init__(self, system: pafs.FileSystem, path: str, names: list[str]):
        self.letters = [column_letters(i) for i in range(len(names))]
        self.sink = system.open_output_stream(path)
        self.book = zipfile.ZipFile(self.sink, "w", zipfile.ZIP_DEFLATED, compresslevel=5)  # 3 takes two thirds of the time for a ninth more bytes, 6 half as long again for 2 % fewer
        for part, text in _package_parts().items():
            self.book.writestr(part, text)
        self.sheet = self.book.open("xl/worksheets/sheet1.xml", "w", force_zip64=True)
        self.sheet.write(f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><worksheet xmlns="{MAIN}"><sheetData>'.encode())
        self.rows = 0
        self.add([pa.array([name], pa.string()) for name in names])

    def add(self, columns: list[pa.Array]) -> None:
        """A few rows, put together column by column."""
        n = len(columns[0])
        numbers = pa.array(np.arange(self.rows + 1, self.rows + n + 1)).cast(pa.large_string())
        parts: list = ['<row r="', numbers, '">']
        for letters, column in zip(self.letters, columns):
            texts, blanks = _xml_texts(column)
            parts += [f'<c r="{letters}', numbers, f'" t="inlineStr"><is><t{KEEP_BLANKS if blanks else ""}>', texts, "</t></is></c>"]
        texts = [pa.scalar(p, pa.large_string()) if isinstance(p, str) else p for p in (*parts, "</row>", "")]
        self.sheet.write(_bytes_of(pc.binary_join_element_wise(*texts)))
        self.rows += n

    def close(self) -> None:
        self.sheet.write(b"</sheetData></worksheet>")
        self.sheet.close()
        self.book.close()
        self.sink.close()


def _xml_text(value: str) -> str:
    return escape(re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f￾￿]", "", value)).replace("\r", "&#13;")


#: Bytes of characters that XML does not take as they are (some of them, and the first of U+FFFE and U+FFFF), and of its blanks.
SPECIAL, BLANK = 1, 2
KINDS = np.array([SPECIAL * ((i < 32 and i not in (9, 10)) or i == 0xEF or chr(i) in "&<>") | BLANK * (i in (9, 10, 13, 32)) for i in range(256)], np.uint8)
KEEP_BLANKS = ' xml:space="preserve"'


def _bytes_of(texts: pa.Array) -> np.ndarray:
    """The texts one behind the other, as bytes."""
    ends = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]


def _xml_texts(column: pa.Array) -> tuple[pa.Array, bool]:
    """The texts as XML takes them, and whether any of them holds blanks."""
    texts = pc.fill_null(column.cast(pa.large_string()), "")
    kinds = int(np.bitwise_or.reduce(KINDS[_bytes_of(texts)], initial=0))
    return pa.array([_xml_text(t) for t in texts.to_pylist()], pa.large_string()) if kinds & SPECIAL else texts, bool(kinds & BLANK)


def _package_parts() -> dict[str, str]:
    """The parts of the smallest valid workbook besides its sheet, as the file format prescribes them."""
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    spreadsheet = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    return {
        "[Content_Types].xml": f'{head}<Types xmlns="{TYPES}">'
        '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>'
        '<Default Extension="xml" ContentType="application/xml"/>'
        f'<Override PartName="/xl/workbook.xml" ContentType="{spreadsheet}.sheet.main+xml"/>'
        f'<Override PartName="/xl/worksheets/sheet1.xml" ContentType="{spreadsheet}.worksheet+xml"/></Types>',
        "_rels/.rels": f'{head}<Relationships xmlns="{RELATIONS}">'
        f'<Relationship Id="rId1" Type="{OFFICE}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'{head}<workbook xmlns="{MAIN}" xmlns:r="{OFFICE}">'
        f'<sheets><sheet name="{EXPORT_SHEET}" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'{head}<Relationships xmlns="{RELATIONS}">'
        f'<Relationship Id="rId1" Type="{OFFICE}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
    }


class WorkbookWriter(DataSourceArrowWriter):
    """Files appear under hidden names and get their final ones when the whole job has succeeded."""

    def __init__(self, options: dict, schema: T.StructType, overwrite: bool):
        self.names = list(schema.names)
        self.root = options["path"]
        self.rows_per_file = int(options.get("rowsperfile", SHEET_ROWS))
        self.job, self.overwrite = uuid.uuid4().hex, overwrite
        self.staging = f"{_filesystem(self.root)[1].rstrip('/')}/.staging-{self.job}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        system, _ = _filesystem(self.root)
        system.create_dir(self.staging, recursive=True)
        files, current = [], None
        for batch in iterator:
            # A few megabytes of markup at a time, of which a cell has some 70 bytes besides its text.
            done, step = 0, max(1, batch.num_rows * WRITE_BYTES // (batch.nbytes + 70 * batch.num_rows * batch.num_columns + 1))
            while done < batch.num_rows:
                if current is None or current.rows >= self.rows_per_file:
                    if current is not None:
                        current.close()
                    files.append(f"part-{uuid.uuid4().hex}.xlsx")
                    current = _SheetStream(system, f"{self.staging}/{files[-1]}", self.names)
                part = batch.slice(done, max(1, min(step, self.rows_per_file - current.rows)))
                current.add(part.columns)
                done += part.num_rows
        if current is not None:
            current.close()
        return _Written(files)

    def commit(self, messages: list) -> None:
        system, root = _filesystem(self.root)
        names = [name for message in messages if message is not None for name in message.files]
        if not names:
            system.create_dir(self.staging, recursive=True)
            names = ["part-empty.xlsx"]
            _SheetStream(system, f"{self.staging}/{names[0]}", self.names).close()
        before = system.get_file_info(pafs.FileSelector(root, allow_not_found=True)) if self.overwrite else []
        for name in names:
            system.move(f"{self.staging}/{name}", f"{root.rstrip('/')}/{name}")
        system.delete_dir(self.staging)
        # The old export goes only when the new one is complete; other files in the folder stay.
        for old in before:
            if old.is_file and old.base_name.startswith("part-") and old.path.lower().endswith(EXTENSIONS):
                system.delete_file(old.path)

    def abort(self, messages: list) -> None:
        system, _ = _filesystem(self.root)
        if system.get_file_info(self.staging).type == pafs.FileType.Directory:
            system.delete_dir(self.staging)


class WorkbookSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return SOURCE

    def schema(self) -> str:
        return ROWS_SCHEMA

    def writer(self, schema: T.StructType, overwrite: bool) -> WorkbookWriter:
        return WorkbookWriter(self.options, schema, overwrite)


# --- DataFrame surface ---------------------------------------------------------------------------------------------


def register(spark: SparkSession) -> None:
    spark.dataSource.register(WorkbookSource)


def workbook_rows(spark: SparkSession, path: str, sheets: Sequence[str] = (), last_row: int | None = None, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Raw rows (path, sheet_index, sheet, row_number, cells) of the named sheets, or of all, of all workbooks at a path; other sheets are not unpacked.

    Rows with a cell only. With ``last_row``, unpacking ends with the chunk that holds it.
    """
    wanted = tuple(sheets) or None
    files = _files(spark, path)
    if _a_task_each(spark, path):
        rows = files.mapInArrow(lambda batches: _parsed(_chunks(batches, wanted, last_row, chunk_bytes)), ROWS_SCHEMA)
    else:
        chunks = files.mapInArrow(lambda batches: _packed(_chunks(batches, wanted, last_row, chunk_bytes)), CHUNKS_SCHEMA)
        # A number of tasks that is asked for is kept, whatever the size of the packed markup says.
        tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
        dealt = chunks.repartition(tasks, "path", "sheet_index", "chunk")
        rows = dealt.mapInArrow(lambda batches: _parsed(_dealt(batches)), ROWS_SCHEMA)
    return rows if last_row is None else rows.where(F.col("row_number") <= last_row)


def workbook_inventory(spark: SparkSession, path: str) -> DataFrame:
    """Name, position and visibility of every sheet of every workbook at a path; each task seeks to the sheet list of its workbooks."""

    def list_sheets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for file in batch.column("path").to_pylist():
                with _open_book(file) as book:
                    found += [(file, i, name, state) for i, (name, state, _) in enumerate(sheet_list(book))]
            columns = list(zip(*found)) or [[]] * 4
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int32(), pa.string(), pa.string()))], names=["path", "sheet_index", "sheet", "visibility"])

    return _files(spark, path).mapInArrow(list_sheets, SHEETS_SCHEMA)


def write_workbooks(df: DataFrame, path: str, rows_per_file: int = SHEET_ROWS, mode: str = "append") -> None:
    """Every row of the table as inline text, one or more workbooks per partition."""
    register(df.sparkSession)
    shown = text_view(df.select(*[cell(c) for c in df.columns if c != ROW_ID]))
    shown.write.format(SOURCE).mode(mode).option("path", path).option("rowsPerFile", rows_per_file).save()


def cells_of(rows: DataFrame) -> DataFrame:
    """``(path, sheet, row_number, column_index, value)`` for present cells, as header detection wants them."""
    return rows.select("path", "sheet_index", "sheet", "row_number", F.posexplode("cells").alias("column_index", "value")).where("value IS NOT NULL")
