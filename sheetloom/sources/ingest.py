"""Files to documents."""

from __future__ import annotations

from collections.abc import Sequence
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession, functions as F

from sheetloom.functions.text import blank
from sheetloom.operators.grid import ROW_ID
from sheetloom.plans import files
from sheetloom.plans.versions import DocumentError, DocumentStore, check_width
from sheetloom.session import scratch_dir, several_writers
from sheetloom.sources.delimited import named_rows, survey
from sheetloom.sources.headers import SCAN_ROWS, detect_headers, unique_names
from sheetloom.sources.splits import stored
from sheetloom.sources.workbooks import ROWS_SCHEMA, cells_of, workbook_rows

SHEET = ["path", "sheet_index", "sheet"]
WORD = 32


def ingest(store: DocumentStore, path: str, name: str | None = None, sheets: Sequence[str] = ()) -> list[str]:
    """Store a delimited file or the sheets of workbooks as documents; the extension decides. Returns document ids."""
    extension = PurePosixPath(path).suffix.lower()
    if extension == ".csv":
        return [ingest_delimited(store, path, name)]
    if extension in (".xlsx", ".xlsm"):
        return ingest_workbooks(store, path, sheets)
    raise DocumentError("only .csv, .xlsx and .xlsm files can be ingested")


def ingest_delimited(store: DocumentStore, path: str | Sequence[str], name: str | None = None, delimiter: str | None = None) -> str:
    """One document from one or many files whose headers name the same columns, in any order.

    Files with other columns are refused. Line breaks inside quotes are kept. Row ids are dense and follow the order of paths and of the records in
    their files. The survey tells the width of all records, so the document is written once.
    """
    found = survey(store.spark, path, delimiter)
    layouts = list(found.layouts.values())
    if not layouts:
        raise DocumentError("the files have no header")
    columns = sorted(layouts[0].names)
    if any(sorted(layout.names) != columns for layout in layouts):
        raise DocumentError(f"the files have different columns: {'; '.join(', '.join(names) for names in list(dict.fromkeys(layout.names for layout in layouts))[:5])}")
    first = path if isinstance(path, str) else path[0]
    check_width(max(found.width, len(columns)))
    source = {"source_type": "csv", "source_file": PurePosixPath(first).name, "source_sheet": "CSV"}
    return store.publish(store.prepare(named_rows(found), numbered=True), name or PurePosixPath(first).name, "ingest", **source)


# --- workbooks -----------------------------------------------------------------------------------------------------


def find_headers(spark: SparkSession, path: str, sheets: Sequence[str] = ()) -> DataFrame:
    """Header row and width of the named sheets, or of all; sheets are unpacked no further than their first rows."""
    return detect_headers(cells_of(workbook_rows(spark, path, sheets, last_row=SCAN_ROWS)), SHEET)


def table_rows(rows: DataFrame, headers: DataFrame) -> DataFrame:
    """Rows of each sheet's table: from the header row down to the first empty row, cut at the header's last column.

    Further columns of ``headers`` stay with the rows. The table ends at the first row without a filled one behind it. Every task sets the bits of its filled
    rows in words of ``WORD`` rows; only these words are dealt out, so no task needs all rows of a sheet and no cells are moved.
    """
    inside = rows.join(headers, SHEET).where("row_number >= header_row")
    filled = F.exists("cells", lambda c: ~blank(c))
    clipped = inside.withColumn("cells", F.when(F.size("cells") <= F.col("column_count"), F.col("cells")).otherwise(F.slice("cells", F.lit(1), F.col("column_count")))).where(filled)
    place, bits = F.col("row_number") - F.col("header_row"), F.col("bits")
    words = clipped.groupBy(*SHEET, "header_row", F.floor(place / WORD).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), (place % WORD).cast("int"))).alias("bits"))
    words = stored(words, "filled-rows")
    followed = words.select(*SHEET, (F.col("word") - 1).alias("word"), F.lit(True).alias("followed"))
    open_ended = words.join(followed, [*SHEET, "word"], "left").where((bits != (1 << WORD) - 1) | F.col("followed").isNull())
    filled_first = F.bit_count(bits.bitwiseAND(F.bitwise_not(bits + 1)))  # the ones below the lowest zero
    ends = open_ended.groupBy(*SHEET).agg(F.min(F.col("header_row") + F.col("word") * WORD + filled_first - 1).alias("_end"))
    ends = stored(ends, "table-ends")
    return clipped.join(ends, SHEET).where(F.col("row_number") <= F.col("_end")).drop("_end")


def fleet_tables(spark: SparkSession, path: str, sheets: Sequence[str] = ()) -> list[tuple[list[str], DataFrame]]:
    """One text table per distinct header of all chosen sheets of all workbooks at a path; all sheets when none is chosen.

    Every workbook is opened once: its rows are written to the shared folder, and headers, table ends and tables are made from there. Sheets with equal headers
    are read together, so a fleet of workbooks costs one job per layout, not one per file. Every table keeps its rows' origin in ``_path``,
    ``_sheet_index``, ``_sheet``, ``_row_number`` and ``_header_row``.
    """
    return _fleet(spark, path, sheets, scratch_dir(spark, "fleet"))


def _fleet(spark: SparkSession, path: str, sheets: Sequence[str], folder: str) -> list[tuple[list[str], DataFrame]]:
    """The tables of a fleet; the rows they are read from lie in ``folder``."""
    raw_folder = f"{folder}/rows"
    workbook_rows(spark, path, sheets).write.option("compression", "zstd").parquet(raw_folder)
    raw = spark.read.schema(ROWS_SCHEMA).parquet(raw_folder)
    headers = _named_headers(raw).withColumn("layout", F.md5(F.to_json("names")))
    layouts = sorted(headers.select("layout", "names").distinct().collect(), key=lambda row: row.names)
    rows = table_rows(raw, headers.drop("names")).where("row_number > header_row")
    if len(layouts) > 1:
        # Tables are told apart by folder, so that each layout reads its own rows.
        with several_writers(spark, max(len(layout.names) for layout in layouts)):
            rows.write.option("compression", "zstd").partitionBy("layout").parquet(f"{folder}/layouts")
        rows = spark.read.parquet(f"{folder}/layouts")
        files.delete(spark, raw_folder)
    tables = []
    for layout in layouts:
        names = unique_names(layout.names)
        body = rows.where(F.col("layout") == layout.layout)
        origin = [F.col(c).alias(f"_{c}") for c in (*SHEET, "row_number", "header_row")]
        fields = [F.get("cells", F.lit(i)).alias(name) for i, name in enumerate(names)]
        tables.append((names, body.select(*origin, *fields)))
    return tables


def _named_headers(rows: DataFrame) -> DataFrame:
    """One row per sheet: its place, header row, width and the raw names, padded to the width, from the first rows of each sheet."""
    top = stored(rows.where(F.col("row_number") <= SCAN_ROWS), "top-rows")
    headers = detect_headers(cells_of(top), SHEET)
    padded = F.transform(F.sequence(F.lit(0), F.col("column_count") - 1), lambda i: F.coalesce(F.trim(F.get("cells", i)), F.lit("")))
    named = headers.join(top.withColumnRenamed("row_number", "header_row"), [*SHEET, "header_row"])
    return stored(named.select(*SHEET, "header_row", "column_count", F.coalesce(padded, F.array()).alias("names")), "headers")


def ingest_workbooks(store: DocumentStore, path: str, sheets: Sequence[str] = ()) -> list[str]:
    """One document per chosen sheet, named after the sheet: one write per layout and one log batch for all documents. Row ids follow the sheet.

    The rows between workbooks and documents go when the documents are written.
    """
    documents, folder = None, scratch_dir(store.spark, "fleet")
    try:
        for names, rows in _fleet(store.spark, path, sheets, folder):
            stored = store.create_many(
                rows.withColumn(ROW_ID, F.col("_row_number") - F.col("_header_row") - 1).drop("_row_number", "_header_row"),
                keys=["_path", "_sheet_index", "_sheet"],
                name=F.col("_sheet"),
                source_type=F.lit("xlsx"),
                source_file=F.substring_index("_path", "/", -1),
                source_sheet=F.col("_sheet"),
            )
            documents = stored if documents is None else documents + stored
    finally:
        files.delete(store.spark, folder)
    if not documents:
        raise DocumentError("no sheet with a recognisable header")
    return documents
