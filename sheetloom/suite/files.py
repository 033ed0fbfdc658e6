"""Files in and out: delimited text, workbooks, header rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sheetloom import scratch_dir
from sheetloom.functions.text import text_view
from sheetloom.plans.fused import union_all
from sheetloom.plans.versions import DocumentError, DocumentStore
from sheetloom.sources import delimited, headers, ingest, workbooks
from sheetloom.suite import query
from sheetloom.suite.inputs import DIRTY_ORDERS, dirty_orders, table

SHEET_FILL = 1_000_000
DIRTY_AS_READ = ", ".join(f"nullif({c}, '') as {c}" for c in ("priority", "price_text", "day_text", "serial_text", "email", "tax_id", "flag"))


@query(f"with {DIRTY_ORDERS} select cast(row_id as varchar) as row_id, {DIRTY_AS_READ} from dirty")
def csv_export_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_dir(spark, "csv")
    delimited.write_delimited(dirty_orders(spark, folder), path)
    return delimited.read_delimited(spark, path)


@query(f"with {DIRTY_ORDERS} select cast(row_id as varchar) as row_id, {DIRTY_AS_READ} from dirty")
def tsv_export_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_dir(spark, "tsv")
    delimited.write_tsv(dirty_orders(spark, folder), path)
    return delimited.read_delimited(spark, path)


@query(
    """select cast(e.event_id as varchar) as event_id, case when event_id % 3 > 0 then event_type end as kind,
    case when event_id % 3 > 1 then props end as props from events e"""
)
def csv_ingest_short_rows(spark: SparkSession, folder: str) -> DataFrame:
    """A semicolon file whose rows have one, two or three fields, with quotes inside fields, stored as a document."""
    quoted = F.concat(F.lit('"'), F.replace("props", F.lit('"'), F.lit('""')), F.lit('"'))
    line = (
        F.when(F.col("event_id") % 3 == 0, F.col("event_id").cast("string"))
        .when(F.col("event_id") % 3 == 1, F.concat_ws(";", F.col("event_id").cast("string"), "event_type"))
        .otherwise(F.concat_ws(";", F.col("event_id").cast("string"), "event_type", quoted))
    )
    path = scratch_dir(spark, "lines")
    lines = table(spark, folder, "events").select(line.alias("value"))
    _with_header(lines, "event_id;kind;props").write.text(path)
    store = DocumentStore(spark, scratch_dir(spark, "store"))
    return store.read(ingest.ingest_delimited(store, path, "events")).drop("_row_id")


@query("select cast(l_orderkey as varchar) as k, cast(l_linenumber as varchar) as n, case when l_linenumber > 5 then l_returnflag end as column2 from lineitem")
def csv_ingest_wide_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Rows with more fields than the header add a column instead of losing text."""
    path = scratch_dir(spark, "lines")
    fields = [F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")]
    line = F.when(F.col("l_linenumber") > 5, F.concat_ws(",", *fields, "l_returnflag")).otherwise(F.concat_ws(",", *fields))
    _with_header(table(spark, folder, "lineitem").select(line.alias("value")), "k,n").write.text(path)
    store = DocumentStore(spark, scratch_dir(spark, "store"))
    return store.read(ingest.ingest_delimited(store, path, "lines")).drop("_row_id")


def _with_header(lines: DataFrame, header: str) -> DataFrame:
    """A header line in front of every partition, since each partition becomes a file of its own."""

    def add(batches):
        import pandas as pd

        first = True
        for batch in batches:
            if first and len(batch):
                yield pd.DataFrame({"value": [header]})
                first = False
            yield batch

    return lines.mapInPandas(add, "value string")


ITEM_TEXT = ", ".join(
    [f"cast({c} as varchar) as {c}" for c in ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")]
    + ["l_returnflag", "l_linestatus", "cast(l_shipdate as varchar) as l_shipdate"]
)


@query(f"select {ITEM_TEXT} from lineitem")
def csv_lineitem_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Export and ingest as a document: every cell as text."""
    path = scratch_dir(spark, "csv")
    delimited.write_delimited(table(spark, folder, "lineitem"), path)
    store = DocumentStore(spark, scratch_dir(spark, "store"))
    return store.read(ingest.ingest_delimited(store, path, "lineitem")).drop("_row_id")


@query(
    """select cast(doc_id as varchar) as doc_id, nullif(text, '') as text, lang, source, cast(n_chars as varchar) as n_chars,
    case when doc_id % 3 = 0 then concat('{"a": "', source, '",', chr(10), '"b": ', doc_id, '}') else 'plain' end as props from documents"""
)
def csv_ingest_line_breaks(spark: SparkSession, folder: str) -> DataFrame:
    """Whole texts with line breaks and quotes, exported and stored again, every column of every row."""
    path = scratch_dir(spark, "csv")
    props = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit('{"a": "'), "source", F.lit('",\n"b": '), F.col("doc_id").cast("string"), F.lit("}"))).otherwise("plain")
    delimited.write_delimited(table(spark, folder, "documents").withColumn("props", props), path)
    store = DocumentStore(spark, scratch_dir(spark, "store"))
    return store.read(ingest.ingest_delimited(store, path, "documents")).drop("_row_id")


CUSTOMER_TEXT = "cast(c_custkey as varchar) as c_custkey, c_name, cast(c_nationkey as varchar) as c_nationkey, cast(c_acctbal as varchar) as c_acctbal, c_mktsegment"


@query(f"select {CUSTOMER_TEXT}, 'refused' as other_columns from customer")
def csv_ingest_many_headers(spark: SparkSession, folder: str) -> DataFrame:
    """Files of one ingest with their columns in different orders; files with other columns are refused."""
    path = scratch_dir(spark, "csv")
    customers = table(spark, folder, "customer")
    for i, columns in enumerate((customers.columns, customers.columns[::-1])):
        delimited.write_delimited(customers.where(F.col("c_custkey") % 2 == i).select(*columns), f"{path}/{i}")
    delimited.write_delimited(table(spark, folder, "region"), f"{path}/other")
    store = DocumentStore(spark, scratch_dir(spark, "store"))
    try:
        ingest.ingest_delimited(store, [f"{path}/0", f"{path}/other"], "mixed")
        refused = "stored"
    except DocumentError:
        refused = "refused"
    stored = store.read(ingest.ingest_delimited(store, [f"{path}/0", f"{path}/1"], "customers")).drop("_row_id")
    return stored.withColumn("other_columns", F.lit(refused))


@query(f"select {CUSTOMER_TEXT} from customer")
def xlsx_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Written as several workbooks, read back as one table of text."""
    path = scratch_dir(spark, "workbooks")
    workbooks.write_workbooks(table(spark, folder, "customer").repartition(3), path, rows_per_file=400)
    return union_all([rows.drop("_path", "_sheet_index", "_sheet", "_row_number", "_header_row") for _, rows in ingest.fleet_tables(spark, path)])


def _in_sheets(rows: DataFrame, least: int = 1) -> DataFrame:
    """A partition for every sheet: ``least`` of them, or as many as the rows fill to a little below the most rows of a sheet.

    Rows whose own partitions hold a sheet or more each, enough of them and of like size to keep all cores busy, stay where they are; a task then writes its sheets in turn.
    """
    held = [row["count"] for row in rows.groupBy(F.spark_partition_id()).count().collect()]
    n = sum(held)
    parts = max(least, 1 if n < workbooks.SHEET_ROWS else -(-n // SHEET_FILL))
    if parts == 1:
        return rows.coalesce(1)
    if max(least, 2 * rows.sparkSession.sparkContext.defaultParallelism) <= len(held) <= parts and max(held) * len(held) <= 2 * n:
        return rows
    # Dealt by number, since a repartition without a key sorts every task's rows first.
    return rows.withColumn("_n", F.monotonically_increasing_id()).repartition(parts, "_n").drop("_n")


@query(f"select {ITEM_TEXT} from lineitem")
def xlsx_ingest_cells(spark: SparkSession, folder: str) -> DataFrame:
    """Every cell of the largest table through workbooks, eight or as many as it fills, into documents."""
    path = scratch_dir(spark, "workbooks")
    workbooks.write_workbooks(_in_sheets(table(spark, folder, "lineitem"), 8), path)
    store = DocumentStore(spark, scratch_dir(spark, "store"))
    return union_all([store.read(d).drop("_row_id") for d in ingest.ingest_workbooks(store, path)])


@query(f"select {ITEM_TEXT} from lineitem")
def xlsx_lineitem(spark: SparkSession, folder: str) -> DataFrame:
    """The largest table in one sheet of one workbook, or in as many as its rows need: one task writes a sheet and many parse it."""
    path = scratch_dir(spark, "workbooks")
    workbooks.write_workbooks(_in_sheets(table(spark, folder, "lineitem")), path)
    store = DocumentStore(spark, scratch_dir(spark, "store"))
    return union_all([store.read(d).drop("_row_id") for d in ingest.ingest_workbooks(store, path)])


@query(
    """select cast(n_nationkey as varchar) as "KEY", n_name as "KEY_2", cast(n_regionkey as varchar) as coluna, n_name as "NAME", n_name as "NAME_2",
    cast(n_regionkey as varchar) as "REGION", cast(n_nationkey as varchar) as "REGION_2" from nation"""
)
def workbook_header_names(spark: SparkSession, folder: str) -> DataFrame:
    """Names of a sheet's columns: trimmed, a nameless one named, repeats numbered."""
    path = scratch_dir(spark, "workbooks")
    nations = table(spark, folder, "nation")
    names = {"KEY": "n_nationkey", " KEY": "n_name", " ": "n_regionkey", "NAME": "n_name", "NAME ": "n_name", "REGION": "n_regionkey", " REGION ": "n_nationkey"}
    workbooks.write_workbooks(nations.select(*[F.col(c).alias(n) for n, c in names.items()]).coalesce(1), path)
    store = DocumentStore(spark, scratch_dir(spark, "store"))
    (document,) = ingest.ingest_workbooks(store, path)
    return store.read(document).drop("_row_id")


@query("select cast(r_regionkey as varchar) as r_regionkey, r_name, 'refused' as unknown from region")
def xlsx_chosen_sheets(spark: SparkSession, folder: str) -> DataFrame:
    """Only sheets of the given names are opened; a name that no workbook has stores nothing."""
    path = scratch_dir(spark, "workbooks")
    workbooks.write_workbooks(table(spark, folder, "region").coalesce(1), path)
    store = DocumentStore(spark, scratch_dir(spark, "store"))
    try:
        ingest.ingest_workbooks(store, path, ["Other"])
        unknown = "stored"
    except DocumentError:
        unknown = "refused"
    (document,) = ingest.ingest_workbooks(store, path, [workbooks.EXPORT_SHEET])
    return store.read(document).drop("_row_id").withColumn("unknown", F.lit(unknown))


@query("select 'Dados' as sheet, 'visible' as visibility, 0 as sheet_index, count(*) as data_rows from supplier")
def workbook_inventory(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_dir(spark, "workbooks")
    workbooks.write_workbooks(table(spark, folder, "supplier").repartition(4), path)
    sheets = workbooks.workbook_inventory(spark, path)
    rows = workbooks.workbook_rows(spark, path).groupBy("sheet").agg(F.count_if(F.col("row_number") > 1).alias("data_rows"))
    return sheets.select("sheet", "visibility", "sheet_index").distinct().join(rows, "sheet")


@query(
    """select 3 as column_count, 2 as header_row, n_nationkey as sheet, least(20, 2 + (select count(*) from customer where c_nationkey = n_nationkey)) as rows_scanned,
    false as fallback_used from nation where (select count(*) from customer where c_nationkey = n_nationkey) >= 1"""
)
def header_detection(spark: SparkSession, folder: str) -> DataFrame:
    """One sheet per nation: a title, the header, then a row per customer."""
    customers = table(spark, folder, "customer")
    # Number the rows before exploding them: in one select, the window would see the exploded cells.
    numbered = customers.withColumn("row_number", F.row_number().over(_by("c_nationkey", "c_custkey")) + 2)
    body = numbered.select(
        F.col("c_nationkey").alias("sheet"), "row_number",
        F.posexplode(F.array(F.col("c_custkey").cast("string"), "c_name", F.col("c_acctbal").cast("string"))).alias("column_index", "value"),
    )
    nations = customers.select(F.col("c_nationkey").alias("sheet")).distinct()
    title = nations.select("sheet", F.lit(1).alias("row_number"), F.lit(0).alias("column_index"), F.lit("CUSTOMERS OF A NATION").alias("value"))
    names = nations.select("sheet", F.lit(2).alias("row_number"), F.posexplode(F.array(F.lit("key"), F.lit("name"), F.lit("balance"))).alias("column_index", "value"))
    return headers.detect_headers(union_all([title, names, body]), ["sheet"])


def _by(key: str, order: str):
    from pyspark.sql import Window

    return Window.partitionBy(key).orderBy(order)


@query(
    """select 'region' as source, r_regionkey as place, cast(r_regionkey as varchar) as key, r_name as name, 2 as columns from region
    union all select 'nation', n_nationkey, cast(n_nationkey as varchar), n_name, 3 from nation union all select 'supplier', s_suppkey, cast(s_suppkey as varchar), s_name, 4 from supplier"""
)
def multi_workbook_ingest(spark: SparkSession, folder: str) -> DataFrame:
    """Workbooks of three tables in one folder tree become documents, cell by cell, with their widths in the log."""
    path = scratch_dir(spark, "workbooks")
    for name in ("region", "nation", "supplier"):
        workbooks.write_workbooks(table(spark, folder, name), f"{path}/{name}")
    store = DocumentStore(spark, scratch_dir(spark, "store"))
    for name in ("region", "nation", "supplier"):
        ingest.ingest_workbooks(store, f"{path}/{name}")
    out = []
    for entry in store.log().orderBy("name", "column_count").collect():
        rows = store.read(entry.document_id).drop("_row_id")
        source = {2: "region", 3: "nation", 4: "supplier"}[entry.column_count]
        key, name = rows.columns[:2]
        out.append(rows.select(F.lit(source).alias("source"), F.col(key).cast("bigint").alias("place"), F.col(key).alias("key"), F.col(name).alias("name"), F.lit(int(entry.column_count)).alias("columns")))
    return union_all(out)


@query("select cast(n_nationkey as varchar) as n_nationkey, n_name, cast(n_regionkey as varchar) as n_regionkey from nation")
def document_text_view(spark: SparkSession, folder: str) -> DataFrame:
    return text_view(table(spark, folder, "nation"))
