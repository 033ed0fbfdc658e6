"""What is refused and why, and the naming and routing of inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sheetloom import scratch_dir
from sheetloom.operators import console, grid, rules, transform
from sheetloom.operators.rules import Rule
from sheetloom.operators.transform import Transformation
from sheetloom.plans.fused import unpack
from sheetloom.plans.versions import MAX_COLUMNS, DocumentError, DocumentStore
from sheetloom.sources import delimited, ingest, workbooks
from sheetloom.suite import query
from sheetloom.suite.files import _with_header
from sheetloom.suite.inputs import DIRTY_ORDERS, dirty_orders, table


def _outcome(action, *refusals: type[Exception]) -> str:
    try:
        action()
    except refusals:
        return "refused"
    return "accepted"


@query(
    """select unnest(['key', 'column1', 'KEY_1', 'segment', 'Segment_1']) as column_name,
    unnest([count(c_custkey), count(nullif(c_nationkey, 3)), count(*), count(*), count(*) filter (c_acctbal > 0)]) as filled from customer"""
)
def header_names(spark: SparkSession, folder: str) -> DataFrame:
    """A header with blanks, padding and repeats, and how many cells each of its columns has."""
    fields = [F.col("c_custkey"), F.when(F.col("c_nationkey") != 3, F.col("c_nationkey")), F.lit("x"), F.col("c_mktsegment"), F.when(F.col("c_acctbal") > 0, F.col("c_acctbal"))]
    line = F.concat_ws(",", *[F.coalesce(f.cast("string"), F.lit("")) for f in fields])
    path = scratch_dir(spark, "lines")
    _with_header(table(spark, folder, "customer").select(line.alias("value")), " key , ,KEY,segment, Segment").write.text(path)
    read = delimited.read_delimited(spark, path)
    counts = read.agg(*[F.count(f"`{c}`").alias(f"n{i}") for i, c in enumerate(read.columns)])
    return unpack(counts, [F.struct(F.lit(c).alias("column_name"), F.col(f"n{i}").alias("filled")) for i, c in enumerate(read.columns)])


@query(
    """select 'lines.csv' as path, 'accepted' as outcome, count(*) as stored from supplier union all select 'books/part.xlsx', 'accepted', count(*) from supplier
    union all select 'sheet.ods', 'refused', 0 union all select 'data.parquet', 'refused', 0"""
)
def format_router(spark: SparkSession, folder: str) -> DataFrame:
    """The extension of a path decides how it is read."""
    root = scratch_dir(spark, "inputs")
    suppliers = table(spark, folder, "supplier")
    delimited.write_delimited(suppliers, f"{root}/lines.csv")
    workbooks.write_workbooks(suppliers.coalesce(1), f"{root}/books")
    book = workbooks.workbook_inventory(spark, f"{root}/books").first().path
    store = DocumentStore(spark, scratch_dir(spark, "store"))
    rows = []
    for shown, path in (("lines.csv", f"{root}/lines.csv"), ("books/part.xlsx", book), ("sheet.ods", f"{root}/sheet.ods"), ("data.parquet", f"{root}/data.parquet")):
        try:
            rows.append((shown, "accepted", sum(store.read(d).count() for d in ingest.ingest(store, path))))
        except DocumentError:
            rows.append((shown, "refused", 0))
    return spark.createDataFrame(rows, "path string, outcome string, stored bigint")


@query(
    """select unnest(['blank name', 'too many columns', 'unknown sheet', 'no header', 'sound']) as what,
    unnest(['refused', 'refused', 'refused', 'refused', 'accepted']) as outcome, unnest([0, 0, 0, 0, count(*)]) as stored from nation"""
)
def ingest_guards(spark: SparkSession, folder: str) -> DataFrame:
    """Inputs that never become documents, and one that does."""
    root = scratch_dir(spark, "inputs")
    nations = table(spark, folder, "nation")
    workbooks.write_workbooks(nations.coalesce(1), f"{root}/nations")
    workbooks.write_workbooks(nations.where("false").select(F.col("n_name").alias(" ")), f"{root}/nothing")
    # One name more than a document may have, over a row for each nation.
    header = ",".join(f"c{i}" for i in range(MAX_COLUMNS + 1))
    lines = nations.select("n_nationkey", F.concat_ws(",", "n_name", *[F.lit("")] * 3).alias("value")).coalesce(1)
    lines.selectExpr("value", "n_nationkey").unionByName(spark.createDataFrame([(header, -1)], "value string, n_nationkey int")).coalesce(1).sortWithinPartitions("n_nationkey").select("value").write.text(f"{root}/wide")
    store = DocumentStore(spark, scratch_dir(spark, "store"))
    tries = {
        "blank name": lambda: store.create("  ", nations),
        "too many columns": lambda: ingest.ingest_delimited(store, f"{root}/wide", "wide"),
        "unknown sheet": lambda: ingest.ingest_workbooks(store, f"{root}/nations", ["Nowhere"]),
        "no header": lambda: ingest.ingest_workbooks(store, f"{root}/nothing"),
        "sound": lambda: ingest.ingest_workbooks(store, f"{root}/nations"),
    }
    rows = []
    for what, action in tries.items():
        before = sum(store.read(d).count() for d in store.names())
        rows.append((what, _outcome(action, DocumentError), sum(store.read(d).count() for d in store.names()) - before))
    return spark.createDataFrame(rows, "what string, outcome string, stored bigint")


@query("select l_tax, l_orderkey, l_returnflag from lineitem")
def visible_columns(spark: SparkSession, folder: str) -> DataFrame:
    """The requested columns that exist, in the requested order."""
    items = table(spark, folder, "lineitem")
    return items.select(*grid.visible_columns(items, ["l_tax", "no_such", "l_orderkey", "l_returnflag"]))


@query(
    f"""with {DIRTY_ORDERS}, changed as (select count(*) filter (priority is distinct from trim(priority)) as n from dirty)
    select unnest(['priority', 'nowhere', '', 'row_id']) as column_name, unnest(['accepted', 'refused', 'refused', 'refused']) as outcome, unnest([n, 0, 0, 0]) as affected from changed"""
)
def tx_column_check(spark: SparkSession, folder: str) -> DataFrame:
    """Only a named data column can be transformed."""
    orders, rows = dirty_orders(spark, folder), []
    for column in ("priority", "nowhere", "", "row_id"):
        try:
            rows.append((column, "accepted", transform.impact(orders, Transformation("trim", column), "row_id").first().affected_rows))
        except transform.TransformError:
            rows.append((column, "refused", 0))
    return spark.createDataFrame(rows, "column_name string, outcome string, affected bigint")


STATEMENTS = ["select count(*) as n from documento", "with a as (select * from documento) select count(*) as n from a;", "select 1; select 2", " ; ", "drop table documento", "insert into documento select 1", "update documento set a = 1", "delete from documento"]


@query(
    f"""select unnest({STATEMENTS!r}) as statement, unnest(['accepted', 'accepted', 'refused', 'refused', 'refused', 'refused', 'refused', 'refused']) as outcome,
    unnest([count(*), count(*), 0, 0, 0, 0, 0, 0]) as n from orders"""
)
def sql_read_only(spark: SparkSession, folder: str) -> DataFrame:
    """One reading statement is accepted and runs, everything else is refused."""
    console.document_context(table(spark, folder, "orders"), "orders")
    rows = []
    for text in STATEMENTS:
        try:
            rows.append((text, "accepted", console.run_query(spark, text).first().n))
        except console.QueryError:
            rows.append((text, "refused", 0))
    return spark.createDataFrame(rows, "statement string, outcome string, n bigint")


@query("select 'refused' as outcome, 'orders ' as again, count(*) as n from orders")
def sql_duplicate_names(spark: SparkSession, folder: str) -> DataFrame:
    """Two documents whose names agree once trimmed and lower-cased make no workspace; with other names they do."""
    orders, customers = table(spark, folder, "orders"), table(spark, folder, "customer")
    names = ["Orders", "orders "]
    outcome = _outcome(lambda: console.workspace_context(zip(names, (orders, customers))), console.QueryError)
    console.workspace_context([("Orders", orders), ("customers", customers)])
    counted = console.run_query(spark, "select count(*) as n from Orders")
    return counted.select(F.lit(outcome).alias("outcome"), F.lit(console.ambiguous_names(names)[0]).alias("again"), "n")


@query(
    """select 'describe' as statement, 'c_custkey' as shown, 'bigint' as detail, count(c_custkey) as n from customer union all select 'describe', 'c_name', 'string', count(c_name) from customer
    union all select 'show', 'documento', '', count(*) from customer union all select 'explain', 'plan', 'Aggregate', count(*) from customer"""
)
def sql_show_describe(spark: SparkSession, folder: str) -> DataFrame:
    """SHOW, DESCRIBE and EXPLAIN of the open document, each with a count over it."""
    console.document_context(table(spark, folder, "customer").select("c_custkey", "c_name"), "customer")
    described = [("describe", r.col_name, r.data_type) for r in console.run_query(spark, "describe documento").collect()]
    shown = [("show", r.viewName, "") for r in console.run_query(spark, "show views").collect() if r.viewName == "documento"]
    plan = console.run_query(spark, "explain select count(*) from documento").first()[0]
    rows = [*described, *shown, ("explain", "plan", "Aggregate" if "Aggregate" in plan else "")]
    total = console.run_query(spark, "select count(*) as n from documento")
    return spark.createDataFrame(rows, "statement string, shown string, detail string").crossJoin(F.broadcast(total))


@query(
    f"""with {DIRTY_ORDERS} select unnest(['bad pattern', 'off', 'no column', 'sound']) as rule_id, unnest(['error', 'disabled', 'error', 'ok']) as status,
    unnest([count(*), count(*), count(*), count(*)]) as total_rows, unnest([0, 0, 0, count(*)]) as evaluated_rows,
    unnest([0, 0, 0, count(*) filter (priority is null or trim(priority) = '')]) as violation_count from dirty"""
)
def rule_statuses(spark: SparkSession, folder: str) -> DataFrame:
    """A rule that cannot run is reported for itself alone, a disabled one is not evaluated."""
    given = [
        Rule("bad pattern", "priority", "regex", "broken", {"pattern": "(["}),
        Rule("off", "priority", "required", "disabled", enabled=False),
        Rule("no column", "nowhere", "required", "unknown column"),
        Rule("sound", "priority", "required", "given"),
    ]
    return rules.rule_results(dirty_orders(spark, folder), given).select("rule_id", "status", "total_rows", "evaluated_rows", "violation_count")


@query(
    """select o.o_orderkey as o_orderkey, o.o_custkey as o_custkey, c.o_orderkey as o_orderkey_2, c.name as name from orders o
    join (select c_custkey as o_orderkey, c_name as name from customer) c on o.o_custkey = c.o_orderkey"""
)
def sql_join_same_names(spark: SparkSession, folder: str) -> DataFrame:
    """``SELECT *`` over two tables that share a column name."""
    customers = table(spark, folder, "customer").select(F.col("c_custkey").alias("o_orderkey"), F.col("c_name").alias("name"))
    console.workspace_context([("orders", table(spark, folder, "orders").select("o_orderkey", "o_custkey")), ("customers", customers)])
    return console.run_query(spark, "SELECT * FROM orders o JOIN customers c ON o.o_custkey = c.o_orderkey")


@query("select 'unknown' as former, count(*) as n from orders")
def sql_context_isolated(spark: SparkSession, folder: str) -> DataFrame:
    """A document context knows nothing of the workspace that was open before."""
    console.workspace_context([("secret.csv", table(spark, folder, "customer"))])
    console.document_context(table(spark, folder, "orders"), "only.csv")
    try:
        console.run_query(spark, 'SELECT count(*) FROM "secret.csv"').collect()
        former = "known"
    except Exception:
        former = "unknown"
    return console.run_query(spark, 'SELECT count(*) AS n FROM "only.csv"').select(F.lit(former).alias("former"), "n")


@query(
    """select o_orderkey, o_totalprice, n from (select o_orderkey, o_totalprice, cast(row_number() over (order by o_totalprice desc, o_orderkey) as bigint) as place,
    o_custkey % 7 as n from orders) where place between 1001 and 1100"""
)
def sql_result_deep_page(spark: SparkSession, folder: str) -> DataFrame:
    """A deep page of a SQL result without row ids: ties go by the other columns, so pages never overlap."""
    console.document_context(table(spark, folder, "orders"), "orders")
    result = console.run_query(spark, "select o_orderkey, o_totalprice, o_custkey % 7 as n from documento")
    return grid.page_rows(result, grid.Sort("o_totalprice", "desc"), 1000, 100, row_id=None, deep_offset=500)
