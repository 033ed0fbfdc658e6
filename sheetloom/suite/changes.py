"""Transformations, change logs, cell edits and renames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sheetloom import scratch_dir
from sheetloom.operators import edits, transform
from sheetloom.operators.transform import Transformation
from sheetloom.plans.versions import DocumentStore
from sheetloom.suite import query
from sheetloom.suite.inputs import DIRTY_ORDERS, dirty_orders, empty, serial, serial_date, table, v

# Name -> (transformation of the dirty orders, SQL for the new text).
TRANSFORMATIONS = {
    "trim": (Transformation("trim", "priority"), "trim(priority)"),
    "uppercase": (Transformation("uppercase", "flag"), "upper(flag)"),
    "lowercase": (Transformation("lowercase", "priority"), "lower(priority)"),
    "replace": (Transformation("replace", "email", {"find": "user.", "replacement": "o'brien+"}), "replace(email, 'user.', 'o''brien+')"),
    "pad_left": (Transformation("pad_left", "price_text", {"length": 9, "character": "*-"}), "lpad(price_text, 9, '*')"),
    "pad_left_truncates": (Transformation("pad_left", "price_text", {"length": 4}), "lpad(price_text, 4, '0')"),
    "excel_serial_date": (
        Transformation("excel_serial_date", "serial_text"),
        f"case when {serial(v('serial_text'))} then strftime({serial_date(v('serial_text'))}, '%d/%m/%Y') else serial_text end",
    ),
    "excel_serial_date_iso": (
        Transformation("excel_serial_date", "serial_text", {"output_format": "YYYY-MM-DD"}),
        f"case when {serial(v('serial_text'))} then strftime({serial_date(v('serial_text'))}, '%Y-%m-%d') else serial_text end",
    ),
}


def _transformation_query(name: str, t: Transformation, sql: str):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        changed = transform.transformed(dirty_orders(spark, folder), t, "row_id")
        return changed.select("row_id", F.col(t.column).alias("new_text"))

    run.__name__ = f"tx_{name}"
    query(f"with {DIRTY_ORDERS} select row_id, {sql} as new_text from dirty")(run)


for _name, (_t, _sql) in TRANSFORMATIONS.items():
    _transformation_query(_name, _t, _sql)


def _failed(t: Transformation) -> str:
    return f"(not {empty(t.column)} and not {serial(v(t.column))})" if t.kind == "excel_serial_date" else "false"


@query(
    f"with {DIRTY_ORDERS} "
    + " union all ".join(
        f"""select '{name}' as name, count(*) as total_rows, count(*) filter ({t.column} is distinct from ({sql})) as affected_rows,
        count(*) filter ({t.column} is not distinct from ({sql})) as unchanged_rows, count(*) filter ({_failed(t)}) as failed_rows from dirty"""
        for name, (t, sql) in TRANSFORMATIONS.items()
    )
)
def tx_preview(spark: SparkSession, folder: str) -> DataFrame:
    orders, out = dirty_orders(spark, folder), None
    for name, (t, _) in TRANSFORMATIONS.items():
        counts = transform.impact(orders, t, "row_id").withColumn("name", F.lit(name))
        out = counts if out is None else out.unionByName(counts)
    return out


def _samples_sql(t: Transformation, sql: str) -> str:
    changed = f"""select row_id, {t.column} as original, {sql} as transformed, 'changed' as status from dirty
        where {t.column} is distinct from ({sql}) order by row_id limit 20"""
    failed = f"""select row_id, {t.column} as original, {sql} as transformed, 'failed' as status from dirty
        where {_failed(t)} order by row_id limit 5"""
    return f"with {DIRTY_ORDERS} select * from ({changed}) union all select * from ({failed})"


@query(_samples_sql(*TRANSFORMATIONS["excel_serial_date"]))
def tx_samples_serial(spark: SparkSession, folder: str) -> DataFrame:
    return transform.samples(dirty_orders(spark, folder), TRANSFORMATIONS["excel_serial_date"][0], "row_id")


@query(_samples_sql(*TRANSFORMATIONS["trim"]))
def tx_samples_trim(spark: SparkSession, folder: str) -> DataFrame:
    return transform.samples(dirty_orders(spark, folder), TRANSFORMATIONS["trim"][0], "row_id")


def _document(spark: SparkSession, folder: str) -> tuple[DocumentStore, str]:
    """The dirty orders as a stored document with row ids of its own and the order key as text."""
    store = DocumentStore(spark, scratch_dir(spark, "store"))
    orders = dirty_orders(spark, folder).withColumn("order_key", F.col("row_id").cast("string")).drop("row_id")
    return store, store.create("orders", orders)


@query(
    f"""with {DIRTY_ORDERS}
    select cast(row_id as varchar) as order_key, 'priority' as column_name, priority as old_value, trim(priority) as new_value
    from dirty where priority is distinct from trim(priority)
    union all select cast(row_id as varchar), 'serial_text', serial_text, {TRANSFORMATIONS["excel_serial_date"][1]}
    from dirty where serial_text is distinct from ({TRANSFORMATIONS["excel_serial_date"][1]})"""
)
def tx_apply_deltas(spark: SparkSession, folder: str) -> DataFrame:
    """Cell changes logged by two applied transformations."""
    store, document = _document(spark, folder)
    store.apply(document, TRANSFORMATIONS["trim"][0])
    store.apply(document, TRANSFORMATIONS["excel_serial_date"][0])
    keys = store.read(document, 1).select(F.col("_row_id").alias("row_id"), "order_key")
    return store.deltas(document).join(keys, "row_id").select("order_key", "column_name", "old_value", "new_value")


@query(f"with {DIRTY_ORDERS} select cast(row_id as varchar) as order_key, upper(trim(priority)) as priority, {TRANSFORMATIONS['pad_left'][1]} as price_text from dirty")
def tx_apply_chain(spark: SparkSession, folder: str) -> DataFrame:
    """The document after three transformations."""
    store, document = _document(spark, folder)
    store.apply(document, Transformation("trim", "priority"))
    store.apply(document, TRANSFORMATIONS["pad_left"][0])
    store.apply(document, Transformation("uppercase", "priority"))
    return store.read(document).select("order_key", "priority", "price_text")


@query(
    f"""with {DIRTY_ORDERS}
    select 1 as sequence, 'trim' as transformation_type, 'priority' as column_name, '{{}}' as configuration_json,
        count(*) filter (priority is distinct from trim(priority)) as affected_rows, 0 as failed_rows, 'applied' as status from dirty
    union all select 2, 'excel_serial_date', 'serial_text', '{{"output_format": "YYYY-MM-DD"}}',
        count(*) filter (serial_text is distinct from ({TRANSFORMATIONS["excel_serial_date_iso"][1]})),
        count(*) filter ({_failed(TRANSFORMATIONS["excel_serial_date"][0])}), 'applied' from dirty"""
)
def tx_history(spark: SparkSession, folder: str) -> DataFrame:
    store, document = _document(spark, folder)
    store.apply(document, TRANSFORMATIONS["trim"][0])
    store.apply(document, TRANSFORMATIONS["excel_serial_date_iso"][0])
    return store.history(document).drop("transformation_id", "document_id", "created_at")


@query(
    """with priced as (select o_orderkey, o_totalprice as price from orders),
    halves as (select o_orderkey, case when o_orderkey % 4 = 0 then 0.5::double else 2.25::double end as half from orders)
    select p.o_orderkey as order_key, half, half as logged, 'double' as kind, 'refused' as comma, cast(1 as bigint) as transformations
    from priced p join halves h on p.o_orderkey = h.o_orderkey"""
)
def tx_apply_typed(spark: SparkSession, folder: str) -> DataFrame:
    """A transformation of a numeric column: document, change log and history agree, and one whose texts are no numbers is refused whole."""
    store = DocumentStore(spark, scratch_dir(spark, "store"))
    numbers = table(spark, folder, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 4 == 0, 0.5).otherwise(1.25).alias("half"))
    document = store.create("halves", numbers)
    store.apply(document, Transformation("replace", "half", {"find": "1.2", "replacement": "2.2"}))
    try:
        store.apply(document, Transformation("replace", "half", {"find": ".", "replacement": ","}))
        comma = "applied"
    except transform.TransformError:
        comma = "refused"
    after = store.read(document)
    logged = store.deltas(document).select(F.col("row_id").alias("_row_id"), F.col("new_value").cast("double").alias("logged"))
    done = store.history(document).agg(F.count("transformation_id").alias("transformations"))
    found = after.join(logged, "_row_id", "left").crossJoin(F.broadcast(done))
    return found.select(
        F.col("o_orderkey").alias("order_key"), "half", F.coalesce("logged", "half").alias("logged"), F.lit(after.schema["half"].dataType.simpleString()).alias("kind"), F.lit(comma).alias("comma"), "transformations"
    )


PATCHED_CUSTOMERS = """select c_custkey, case when c_custkey % 50 = 0 then null when c_custkey % 20 = 0 then concat('patched ', c_custkey)
    else c_name end as c_name, case when c_custkey % 30 = 0 then 0.5 else c_acctbal end as c_acctbal from customer"""


def _customer_edits(customers: DataFrame) -> DataFrame:
    """Edits of every 20th, 30th and 50th customer, some of them of the wrong type or of unknown cells."""
    key = F.col("c_custkey")

    def edit(every: int, column: str, value, sequence: int) -> DataFrame:
        chosen = customers.where(key % every == 0)
        text = value.cast("string").alias("value")
        return chosen.select(key.alias("row_id"), F.lit(column).alias("column_name"), text, F.lit(sequence).cast("bigint").alias("sequence"))

    return (
        edit(20, "c_name", F.concat(F.lit("patched "), key.cast("string")), 1)
        .unionByName(edit(50, "c_name", F.lit(None), 2))
        .unionByName(edit(30, "c_acctbal", F.lit("0.5"), 1))
        .unionByName(edit(30, "c_acctbal", F.lit("half"), 3))
        .unionByName(edit(75, "no_such_column", F.lit("x"), 4))
    )


@query(PATCHED_CUSTOMERS)
def patch_cells(spark: SparkSession, folder: str) -> DataFrame:
    customers = table(spark, folder, "customer").select("c_custkey", "c_name", "c_acctbal")
    return edits.patched(customers, _customer_edits(customers), "c_custkey")


@query(
    """select c_custkey as row_id, 'c_acctbal' as column_name, 'wrong type' as problem from customer where c_custkey % 30 = 0
    union all select c_custkey, 'no_such_column', 'unknown cell' from customer where c_custkey % 75 = 0"""
)
def patch_refused(spark: SparkSession, folder: str) -> DataFrame:
    customers = table(spark, folder, "customer").select("c_custkey", "c_name", "c_acctbal")
    checked = edits.checked_edits(customers, _customer_edits(customers), "c_custkey")
    return checked.where("problem IS NOT NULL").select("row_id", "column_name", "problem")


@query("select o_orderkey as row_id from orders where o_orderkey not in (select c_custkey from customer)")
def patch_unmatched(spark: SparkSession, folder: str) -> DataFrame:
    """Edits that name rows a table does not have."""
    named = table(spark, folder, "orders").select(F.col("o_orderkey").alias("row_id"), F.lit("c_name").alias("column_name"), F.lit("x").alias("value"))
    return edits.unmatched_edits(table(spark, folder, "customer"), named, "c_custkey").select("row_id")


@query("select s_suppkey as \"chave do fornecedor\", s_name, s_nationkey, s_acctbal from supplier")
def rename_column(spark: SparkSession, folder: str) -> DataFrame:
    return edits.rename_column(table(spark, folder, "supplier"), 0, " chave do fornecedor ", row_id=None)[0]


@query("select cast(s_suppkey as varchar) as supplier, s_name as \"Nome.\", case when s_suppkey % 10 = 0 then 'edited' else s_nation end as s_nation from (select *, cast(s_nationkey as varchar) as s_nation from supplier)")
def document_versions(spark: SparkSession, folder: str) -> DataFrame:
    """A stored document after a rename, a batch of edits and another rename."""
    store = DocumentStore(spark, scratch_dir(spark, "store"))
    suppliers = table(spark, folder, "supplier").select(F.col("s_suppkey").cast("string").alias("supplier"), "s_name", F.col("s_nationkey").cast("string").alias("nation"))
    document = store.create("suppliers", suppliers)
    store.rename(document, 1, "Nome.")
    chosen = store.read(document).where(F.col("supplier").cast("int") % 10 == 0)
    store.patch(document, chosen.select(F.col("_row_id").alias("row_id"), F.lit("nation").alias("column_name"), F.lit("edited").alias("value"), F.lit(1).cast("bigint").alias("sequence")))
    store.rename(document, 2, "s_nation")
    return store.read(document).drop("_row_id")
