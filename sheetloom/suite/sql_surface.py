"""SQL over logical document names, paging of its results, and saved results with lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sheetloom import scratch_dir
from sheetloom.operators import console, grid
from sheetloom.operators.grid import Filter, Sort
from sheetloom.plans.fused import unpack
from sheetloom.plans.versions import DocumentStore
from sheetloom.suite import query
from sheetloom.suite.inputs import table


@query("select c_mktsegment as segment, count(*) as n, round(avg(c_acctbal), 6) as balance from customer group by 1")
def sql_document_context(spark: SparkSession, folder: str) -> DataFrame:
    """One document under both of its names; double quotes enclose names with blanks."""
    console.document_context(table(spark, folder, "customer"), "CLIENTES POR SEGMENTO")
    return console.run_query(
        spark,
        """SELECT c.c_mktsegment AS segment, count(*) AS n, round(avg(d."c_acctbal"), 6) AS balance
        FROM documento c JOIN "CLIENTES POR SEGMENTO" d ON c.c_custkey = d.c_custkey GROUP BY c.c_mktsegment; """,
    )


@query(
    """select n_name, r_name, count(distinct s_suppkey) as suppliers, count(distinct c_custkey) as customers from nation
    join region on n_regionkey = r_regionkey left join supplier on s_nationkey = n_nationkey left join customer on c_nationkey = n_nationkey
    group by 1, 2"""
)
def sql_workspace_join(spark: SparkSession, folder: str) -> DataFrame:
    documents = [("países", "nation"), ("Regions 2024.csv", "region"), ("supplier.xlsx", "supplier"), ("customer", "customer")]
    console.workspace_context([(name, table(spark, folder, source)) for name, source in documents])
    return console.run_query(
        spark,
        """WITH s AS (SELECT s_nationkey AS k, count(*) AS n FROM "supplier.xlsx" GROUP BY s_nationkey),
        c AS (SELECT c_nationkey AS k, count(*) AS n FROM customer GROUP BY c_nationkey)
        SELECT n_name, r_name, coalesce(s.n, 0) AS suppliers, coalesce(c.n, 0) AS customers FROM "países"
        JOIN "Regions 2024.csv" ON n_regionkey = r_regionkey LEFT JOIN s ON s.k = n_nationkey LEFT JOIN c ON c.k = n_nationkey""",
    )


@query(
    """select o_orderstatus, o_orderpriority, n from (select o_orderstatus, o_orderpriority, count(*) as n from orders group by 1, 2)
    where lower(o_orderpriority) like '%-%' order by o_orderpriority desc, o_orderstatus limit 25"""
)
def sql_result_page(spark: SparkSession, folder: str) -> DataFrame:
    """A SQL result filtered, sorted and paged like a document; the query itself orders ties."""
    console.document_context(table(spark, folder, "orders"), "orders")
    counted = console.run_query(spark, "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM documento GROUP BY ALL")
    kept = grid.filter_rows(counted, [Filter("o_orderpriority", value="-")], row_id=None)
    return grid.page_rows(kept, Sort("o_orderpriority", "desc"), 0, 25, row_id="o_orderstatus")


@query(
    """select case when grouping(l_returnflag) = 1 then 'all' else l_returnflag end as flag,
    case when grouping(l_linestatus) = 1 then 'all' else l_linestatus end as status, count(*) as n, round(sum(l_quantity), 6) as quantity
    from lineitem group by rollup (l_returnflag, l_linestatus)"""
)
def sql_pass_through_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """Whatever the engine's SQL offers is available, here grouping sets."""
    console.document_context(table(spark, folder, "lineitem"), "lineitem")
    return console.run_query(
        spark,
        """SELECT CASE WHEN grouping(l_returnflag) = 1 THEN 'all' ELSE l_returnflag END AS flag,
        CASE WHEN grouping(l_linestatus) = 1 THEN 'all' ELSE l_linestatus END AS status, count(*) AS n, round(sum(l_quantity), 6) AS quantity
        FROM documento GROUP BY ROLLUP (l_returnflag, l_linestatus)""",
    )


@query(
    """select upper(p_brand) as brand, count(*) filter (regexp_matches(p_name, '^[a-m]')) as early, round(sum(p_retailprice), 6) as total,
    count(nullif(p_size, 1)) as sizes from part group by 1 having count(*) > 3"""
)
def sql_scalar_functions(spark: SparkSession, folder: str) -> DataFrame:
    console.document_context(table(spark, folder, "part"), "part")
    return console.run_query(
        spark,
        """SELECT upper(trim(p_brand)) AS brand, count(*) FILTER (WHERE regexp_like(p_name, '^[a-m]')) AS early,
        round(sum(TRY_CAST(p_retailprice AS DOUBLE)), 6) AS total, count(nullif(p_size, 1)) AS sizes
        FROM documento GROUP BY 1 HAVING count(*) > 3""",
    )


@query(
    """select 'o_orderkey' as column_name, 'bigint' as data_type, count(o_orderkey) as filled from orders
    union all select 'price', 'double', count(nullif(o_totalprice, 0)) from orders"""
)
def sql_result_schema(spark: SparkSession, folder: str) -> DataFrame:
    """Columns and types of a query, known from its analysis alone, then counted over the whole table."""
    console.document_context(table(spark, folder, "orders"), "orders")
    text = "select o_orderkey, nullif(o_totalprice, 0) as price from documento"
    types = console.result_schema(spark, text)
    counts = console.run_query(spark, text).agg(*[F.count(f.name).alias(f.name) for f in types])
    return unpack(
        counts,
        [F.struct(F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("data_type"), F.col(f.name).alias("filled")) for f in types],
    )


@query("select o_orderpriority as priority, cast(count(*) as bigint) as orders, round(sum(o_totalprice), 6) as total, 'sources' as made_from from orders group by 1")
def save_sql_result(spark: SparkSession, folder: str) -> DataFrame:
    """A stored SQL result, read back and joined with its lineage."""
    store = DocumentStore(spark, scratch_dir(spark, "store"))
    source = store.create("sources", table(spark, folder, "orders"))
    store.open_document_context(source)
    saved = store.save_query("Totals", "select o_orderpriority as priority, count(*) as orders, round(sum(o_totalprice), 6) as total from sources group by 1;", source)
    made_from = store.lineage().where(F.col("result_document_id") == saved).first().source_document_id
    return store.read(saved).drop("_row_id").withColumn("made_from", F.lit(store.names()[made_from]))
