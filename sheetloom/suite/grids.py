"""Filters, sorts, pages and envelopes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sheetloom.functions.text import text_view
from sheetloom.operators import grid
from sheetloom.operators.grid import Filter, Sort
from sheetloom.operators.rules import Rule
from sheetloom.suite import query
from sheetloom.suite.inputs import DIRTY_COLUMNS, DIRTY_ORDERS, dirty_orders, empty, table, v


@query(f"with {DIRTY_ORDERS} select row_id, priority from dirty where lower(coalesce(priority, '')) like '%high%'")
def filter_contains(spark: SparkSession, folder: str) -> DataFrame:
    return grid.filter_rows(dirty_orders(spark, folder), [Filter("priority", "contains", " HIGH ")], row_id="row_id").select("row_id", "priority")


@query(f"with {DIRTY_ORDERS} select row_id, price_text from dirty where lower(coalesce(price_text, '')) like '%9_.%5%'")
def filter_contains_wildcards(spark: SparkSession, folder: str) -> DataFrame:
    return grid.filter_rows(dirty_orders(spark, folder), [Filter("price_text", value="9_.%5")], row_id="row_id").select("row_id", "price_text")


@query(f"with {DIRTY_ORDERS} select row_id, priority from dirty where priority = '5-LOW'")
def filter_equals(spark: SparkSession, folder: str) -> DataFrame:
    return grid.filter_rows(dirty_orders(spark, folder), [Filter("priority", "equals", "5-LOW")], row_id="row_id").select("row_id", "priority")


@query(f"with {DIRTY_ORDERS} select row_id, priority from dirty where {empty('priority')}")
def filter_empty(spark: SparkSession, folder: str) -> DataFrame:
    return grid.filter_rows(dirty_orders(spark, folder), [Filter("priority", "empty")], row_id="row_id").select("row_id", "priority")


REPEATED_TAX_ID = f"""not {empty('tax_id')} and {v('tax_id')} in
    (select {v('tax_id')} from dirty where not {empty('tax_id')} group by 1 having count(*) > 1)"""


@query(
    f"""with {DIRTY_ORDERS} select row_id, tax_id, flag from dirty
    where {REPEATED_TAX_ID} and lower(coalesce(flag, '')) like '%s%' and day_text = 'someday'"""
)
def filter_combined(spark: SparkSession, folder: str) -> DataFrame:
    rule = Rule("once", "tax_id", "unique", "tax id once")
    filters = [
        Filter("tax_id", "quality_violation", rule_id="once"),
        Filter("flag", "unheard-of", "S"),
        Filter("day_text", "equals", "someday"),
        Filter("no such column", "equals", "x"),
        Filter("email", "contains", "  "),
    ]
    return grid.filter_rows(dirty_orders(spark, folder), filters, [rule], "row_id").select("row_id", "tax_id", "flag")


@query("select event_id, event_type, value from events where lower(coalesce(event_type, '')) like '%click%' and lower(coalesce(cast(value as varchar), '')) like '%7%'")
def filter_events(spark: SparkSession, folder: str) -> DataFrame:
    filters = [Filter("event_type", "contains", "Click"), Filter("value", "contains", "7")]
    return grid.filter_rows(table(spark, folder, "events"), filters, row_id="event_id").select("event_id", "event_type", "value")


def _ranked(order: str, offset: int, limit: int) -> str:
    return f"""with {DIRTY_ORDERS} select cast(row_number() over (order by {order}) as integer) as place, row_id, priority
        from dirty qualify place > {offset} and place <= {offset + limit}"""


def _places(page: DataFrame, offset: int) -> DataFrame:
    """Positions of a page's rows; a page has at most 500 rows."""
    rows = [(offset + i + 1, r.row_id, r.priority) for i, r in enumerate(page.select("row_id", "priority").collect())]
    return page.sparkSession.createDataFrame(rows, "place int, row_id bigint, priority string")


@query(_ranked("nullif(priority, '') desc nulls last, row_id", 0, 500))
def sort_blank_last_desc(spark: SparkSession, folder: str) -> DataFrame:
    return _places(grid.page_rows(dirty_orders(spark, folder), Sort("priority", "desc"), 0, 500, "row_id"), 0)


@query(_ranked("nullif(priority, '') asc nulls last, row_id", 1000, 100))
def page_offset_limit(spark: SparkSession, folder: str) -> DataFrame:
    return _places(grid.page_rows(dirty_orders(spark, folder), Sort("priority"), 1000, 100, "row_id"), 1000)


@query(_ranked("nullif(priority, '') asc nulls last, row_id", 12000, 25))
def page_deep_offset(spark: SparkSession, folder: str) -> DataFrame:
    """A page deep in the sort order (the limit of 10 rows is raised to 25)."""
    return _places(grid.page_rows(dirty_orders(spark, folder), Sort("priority", "up"), 12000, 10, "row_id", deep_offset=5000), 12000)


@query(
    """select l_extendedprice, l_orderkey, l_partkey, l_linenumber, l_quantity from lineitem
    order by l_extendedprice desc, l_orderkey, l_partkey, l_linenumber, l_quantity limit 500 offset 50000"""
)
def page_deep_lineitem(spark: SparkSession, folder: str) -> DataFrame:
    """A deep page of a table without ids: the key columns together are the tie-breaker."""
    items = table(spark, folder, "lineitem")
    keys = ["l_orderkey", "l_partkey", "l_linenumber", "l_quantity"]
    items = items.select("l_extendedprice", F.struct(*keys).alias("key"))
    page = grid.page_rows(items, Sort("l_extendedprice", "desc"), 50000, 500, "key", deep_offset=10_000)
    return page.select("l_extendedprice", "key.*")


@query(f"with {DIRTY_ORDERS} select row_id, priority from dirty where (priority, row_id) > ('4-NOT SPECIFIED', 7000) or priority is null order by priority nulls last, row_id limit 200")
def page_after_row(spark: SparkSession, folder: str) -> DataFrame:
    return grid.next_page(dirty_orders(spark, folder), Sort("priority"), ("4-NOT SPECIFIED", 7000), 200, "row_id").select("row_id", "priority")


@query(
    f"""with {DIRTY_ORDERS}, b as (select {', '.join(f"count(*) filter ({empty(c)}) as b{i}" for i, c in enumerate(DIRTY_COLUMNS))},
    count(*) filter (lower(coalesce(flag, '')) like '%sim%') as total_rows from dirty)
    select {len(DIRTY_COLUMNS)} as column_count, total_rows, 200 as offset, 100 as limit, total_rows > 300 as has_more,
    case when total_rows > 300 then 300 end as next_offset,
    {' + '.join(f"(b{i} > 0)::integer" for i in range(len(DIRTY_COLUMNS)))} as columns_with_empty,
    {' + '.join(f"b{i}" for i in range(len(DIRTY_COLUMNS)))} as empty_cells from b"""
)
def window_envelope(spark: SparkSession, folder: str) -> DataFrame:
    summary = grid.window_summary(dirty_orders(spark, folder), [Filter("flag", value="sim")], offset=200, limit=100, row_id="row_id")
    return summary.drop("empty_counts")


@query(
    """select cast(vec_id as varchar) as vec_id, cast(label as varchar) as label, cast(len(embedding) as integer) as dimensions from embeddings"""
)
def text_view_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    """Every column as text; arrays become JSON, checked here by parsing it back."""
    shown = text_view(table(spark, folder, "embeddings"))
    return shown.select("vec_id", "label", F.size(F.from_json("embedding", "array<double>")).alias("dimensions"))


@query(
    "select cast(l_orderkey as varchar) as l_orderkey, cast(l_extendedprice as varchar) as l_extendedprice, cast(l_discount as varchar) as l_discount, "
    "cast(l_extendedprice * 1000 as varchar) as thousandfold, cast(l_discount / 1000 as varchar) as thousandth, cast(l_shipdate as varchar) as l_shipdate from lineitem"
)
def text_view_lineitem(spark: SparkSession, folder: str) -> DataFrame:
    columns = ["l_orderkey", "l_extendedprice", "l_discount", "thousandfold", "thousandth", "l_shipdate"]
    items = table(spark, folder, "lineitem")
    items = items.withColumn("thousandfold", F.col("l_extendedprice") * 1000).withColumn("thousandth", F.col("l_discount") / 1000)
    return text_view(items.select(*columns))
