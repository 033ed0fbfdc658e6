import pytest
from pyspark.sql import functions as F

from conftest import values
from sheetloom import scratch_dir
from sheetloom.operators import console, grid
from sheetloom.operators.console import QueryError
from sheetloom.operators.grid import Filter, Sort
from sheetloom.plans.versions import DocumentError, DocumentStore


@pytest.mark.parametrize("text", ["", "  ;; ", "select 1; select 2", "select ';'", "drop table x", "insert into a values (1)", "update a set b = 1", "selectx 1"])
def test_refused(text):
    with pytest.raises(QueryError):
        console.read_only(text)


def test_allowed():
    assert console.read_only("  SELECT 1 ;; ") == "SELECT 1"
    for text in ("with a as (select 1) select * from a", "SHOW TABLES", "describe x", "Explain select 1"):
        assert console.read_only(text) == text


def test_writing_behind_with_is_refused(spark):
    with pytest.raises(Exception):
        console.run_query(spark, "WITH a AS (SELECT 1 AS x) INSERT INTO t SELECT * FROM a")


FOLDER = "/root/testdata/sf0.001"


def test_document_context(spark):
    regions = spark.read.parquet(f"{FOLDER}/region.parquet").select("r_regionkey", F.col("r_name").alias("Name der Region"))
    console.document_context(regions, "Regions, all of them")
    for name in ("documento", '"Regions, all of them"'):
        assert values(console.run_query(spark, f'SELECT upper("Name der Region") FROM {name} WHERE r_regionkey = 1')) == [("AMERICA",)]
    assert console.result_schema(spark, "select * from documento").names == ["r_regionkey", "Name der Region"]
    assert spark.conf.get("spark.sql.ansi.doubleQuotedIdentifiers") == "false"


def test_workspace_join(spark):
    tables = {name: spark.read.parquet(f"{FOLDER}/{name}.parquet") for name in ("nation", "region")}
    console.workspace_context(list(tables.items()))
    joined = console.run_query(spark, "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey < 3 ORDER BY 1")
    expected = tables["nation"].join(tables["region"], F.col("n_regionkey") == F.col("r_regionkey")).where("n_nationkey < 3").select("n_name", "r_name")
    assert values(joined) == sorted(values(expected))
    with pytest.raises(QueryError, match="Region "):
        console.workspace_context([("region", tables["region"]), ("Region ", tables["nation"])])


def test_only_documents_are_read(spark):
    """Files, tables, views of others, alone or inside sub-queries and WITH, are refused; what the query writes itself is not."""
    spark.range(7).createOrReplaceTempView("foreign_view")
    console.workspace_context([("mine", spark.range(3)), ("other mine", spark.range(2))])
    file = f"parquet.`{FOLDER}/region.parquet`"
    for text in (
        f"SELECT * FROM {file}",
        "SELECT * FROM foreign_view",
        "SELECT * FROM mine WHERE id IN (SELECT id FROM foreign_view)",
        "WITH a AS (SELECT * FROM foreign_view) SELECT * FROM mine JOIN a USING (id)",
        "SELECT (SELECT max(id) FROM foreign_view) AS x FROM mine",
        f"SELECT 1 FROM mine WHERE EXISTS (SELECT 1 FROM {file})",
        "DESCRIBE foreign_view",
        "EXPLAIN SELECT * FROM foreign_view",
        "SHOW FUNCTIONS",
    ):
        with pytest.raises(QueryError):
            console.run_query(spark, text)
    for text, n in (
        ('WITH a AS (SELECT * FROM mine) SELECT * FROM a JOIN "other mine" USING (id) WHERE id IN (SELECT id FROM a)', 2),
        ("SELECT * FROM VALUES (1), (2) AS t(x)", 2),
        ("SELECT 1 AS x UNION ALL SELECT count(*) FROM mine", 2),
        ("SHOW VIEWS", 2),
    ):
        assert console.run_query(spark, text).count() == n, text


def test_a_view_of_the_owner_comes_back(spark):
    spark.range(9).createOrReplaceTempView("shared_name")
    console.workspace_context([("Shared_Name", spark.range(1))])
    assert console.run_query(spark, "SELECT * FROM shared_name").count() == 1
    console.workspace_context([("mine", spark.range(3))])
    assert spark.table("shared_name").count() == 9
    with pytest.raises(QueryError):
        console.run_query(spark, "SELECT * FROM shared_name")


def test_show_describe_explain(spark):
    console.document_context(spark.range(2), "d")
    assert ("documento",) in values(console.run_query(spark, "SHOW VIEWS"), "viewName")
    assert values(console.run_query(spark, "DESCRIBE documento"), "col_name") == [("id",)]
    assert "Range" in console.run_query(spark, "EXPLAIN SELECT * FROM documento").first()[0]


def test_result_window(spark):
    console.document_context(spark.range(100), "d")
    result = console.run_query(spark, "select id % 4 as g, count(*) as n, array(1) as a from documento group by 1")
    window = grid.open_window(result, [Filter("g", "contains", "2")], Sort("g", "desc"))
    assert window.rows == [["2", "25", "[1]"]] and window.row_ids is None and window.column_types == ["bigint", "bigint", "array<int>"]


def test_saved_result(spark):
    store = DocumentStore(spark, scratch_dir(spark, "store"))
    source = store.create("src", spark.createDataFrame([("a",), ("b",)], "c string"))
    store.open_workspace_context()
    saved = store.save_query(" result ", "select upper(c) as c from src;", source)
    assert sorted(values(store.read(saved), "c")) == [("A",), ("B",)]
    assert values(store.lineage(), "source_document_id", "result_document_id", "sql") == [(source, saved, "select upper(c) as c from src")]
    assert store.entries(saved)[0].source_type == "sql"
    for name, text, origin in ((" ", "select 1", None), ("x", "drop table src", None), ("x", "select 1 as a", "unknown")):
        with pytest.raises((DocumentError, QueryError)):
            store.save_query(name, text, origin)
    with pytest.raises(Exception):
        store.save_query("x", "select raise_error('no') as c from src")
    assert sorted(store.names().values()) == ["result", "src"]
