import pytest
from pyspark.sql import functions as F

from conftest import values
from sheetloom import scratch_dir
from sheetloom.operators import edits, transform
from sheetloom.operators.edits import EDIT_SCHEMA, EditError
from sheetloom.operators.rules import Rule
from sheetloom.operators.transform import Transformation, TransformError
from sheetloom.plans import versions
from sheetloom.plans.versions import DocumentError, DocumentStore, VersionConflict

ITEMS = [" a ", "ß", None, "", "33639", "60", "12345678901234567890", "x,y", " b"]


@pytest.fixture()
def df(spark):
    return spark.createDataFrame(list(enumerate(ITEMS)), "_row_id bigint, c string")


@pytest.fixture()
def store(spark):
    return DocumentStore(spark, scratch_dir(spark, "store"))


def new_texts(df, kind, **config):
    return [r.c for r in transform.transformed(df, Transformation(kind, "c", config)).orderBy("_row_id").collect()]


def test_expressions(df):
    assert new_texts(df, "trim") == ["a", "ß", None, "", "33639", "60", "12345678901234567890", "x,y", "b"]
    assert new_texts(df, "uppercase")[:2] == [" A ", "SS"]
    assert new_texts(df, "replace", find=",", replacement="'")[7] == "x'y"
    assert new_texts(df, "replace", find="", replacement="z") == ITEMS
    assert new_texts(df, "pad_left", length=3)[7:] == ["x,y", "0 b"]
    assert new_texts(df, "pad_left", length=2, character="ab")[:2] == [" a", "aß"]
    assert new_texts(df, "excel_serial_date")[4:7] == ["05/02/1992", "60", "12345678901234567890"]
    assert new_texts(df, "excel_serial_date", output_format="YYYY/MM/DD")[4] == "1992/02/05"


@pytest.mark.parametrize(
    "kind, config",
    [("replace", {"find": "a"}), ("replace", {"find": "a", "replacement": "b", "regex": True}), ("pad_left", {}), ("pad_left", {"length": 0}), ("pad_left", {"length": 513}), ("excel_serial_date", {"output_format": "D"}), ("reverse", {})],
)
def test_refused_transformations(df, kind, config):
    with pytest.raises(TransformError):
        transform.expression(df, Transformation(kind, "c", config))


@pytest.mark.parametrize("column", ["", " ", "_row_id", "nowhere"])
def test_refused_columns(df, column):
    with pytest.raises(TransformError):
        transform.expression(df, Transformation("trim", column))


def test_impact_and_samples(df):
    serial = Transformation("excel_serial_date", "c")
    assert values(transform.impact(df, serial)) == [(9, 1, 8, 6)]
    found = values(transform.samples(df, serial), "row_id", "status")
    assert found == [(4, "changed"), (0, "failed"), (1, "failed"), (5, "failed"), (6, "failed"), (7, "failed")]
    assert values(transform.deltas(df, Transformation("trim", "c"), "t").orderBy("row_id")) == [("t", 0, "c", " a ", "a"), ("t", 8, "c", " b", "b")]


def test_rename(df):
    rules = [Rule("1", "c", "required", "given")]
    renamed, followed = edits.rename_column(df, 0, " Nome Completo ", rules)
    assert renamed.columns == ["_row_id", "Nome Completo"] and followed[0].column == "Nome Completo"
    assert edits.rename_column(df, 0, "c", rules)[0] is df
    two = df.withColumn("d", F.lit(1))
    for index, name in ((0, " "), (5, "x"), (-1, "x"), (0, "d"), (0, "D")):
        with pytest.raises(EditError):
            edits.rename_column(two, index, name)
    assert edits.rename_column(two, 0, "C")[0].columns == ["_row_id", "C", "d"]


def test_patched_types_and_order(spark):
    df = spark.createDataFrame([(0, "a", 1, 1.5), (1, "b", 2, None)], "_row_id bigint, t string, n int, x double")
    given = [(0, "t", "first", 1), (0, "t", "last", 2), (1, "t", None, 1), (0, "n", "7", 1), (1, "n", "seven", 1), (1, "x", "2.5", 1), (0, "x", None, 9), (9, "t", "z", 1), (-1, "t", "z", 1), (0, "_row_id", "5", 1)]
    batch = spark.createDataFrame(given, EDIT_SCHEMA)
    assert values(edits.patched(df, batch).orderBy("_row_id")) == [(0, "last", 7, None), (1, None, 2, 2.5)]
    problems = {(r.row_id, r.column_name): r.problem for r in edits.checked_edits(df, batch).where("problem is not null").collect()}
    assert problems == {(1, "n"): "wrong type", (-1, "t"): "unknown cell", (0, "_row_id"): "unknown cell"}
    assert sorted(r.row_id for r in edits.unmatched_edits(df, batch).collect()) == [-1, 9]


def test_document_life(store, spark):
    table = spark.createDataFrame([("001", " x "), ("002", None), ("003", " y")], "codigo string, nome string").coalesce(1)
    doc = store.create(" Plan 1 ", table)
    assert store.entries(doc)[0].row_count == 3 and store.names() == {doc: "Plan 1"}
    first = store.apply(doc, Transformation("trim", "nome"))
    assert (first.version, first.affected_rows, first.failed_rows) == (2, 2, 0)
    store.rename(doc, 1, "name")
    store.patch(doc, spark.createDataFrame([(1, "name", "z", 1)], EDIT_SCHEMA))
    second = store.apply(doc, Transformation("uppercase", "name"))
    expected = [("001", "X"), ("002", "Z"), ("003", "Y")]
    assert values(store.read(doc).orderBy("codigo"), "codigo", "name") == expected
    assert values(store.read(doc, 1).orderBy("codigo"), "nome") == [(" x ",), (None,), (" y",)]
    assert values(store.read(doc, 3).orderBy("codigo"), "name") == [("x",), (None,), ("y",)]
    assert [(r.sequence, r.affected_rows) for r in store.history(doc).collect()] == [(1, 2), (2, 3)]
    assert store.deltas(doc).where(F.col("transformation_id") == second.transformation_id).count() == 3
    assert store.entries(doc)[0].duration_ms >= 0


@pytest.mark.parametrize("few", [True, False])
def test_typed_columns_whatever_the_share_of_changes(store, spark, few):
    halves = spark.range(100).select(F.when((F.col("id") < 2) == few, 1.5).otherwise(2.0).alias("x"), F.col("id").cast("string").alias("k"))
    doc = store.create("t", halves)
    with pytest.raises(TransformError):
        store.apply(doc, Transformation("replace", "x", {"find": ".5", "replacement": ",5"}))
    assert len(store.entries(doc)) == 1 and store.deltas(doc).count() == 0
    done = store.apply(doc, Transformation("replace", "x", {"find": "1.5", "replacement": "3.5"}))
    changed = 2 if few else 98
    after = store.read(doc)
    assert dict(after.dtypes)["x"] == "double" and after.where("x = 3.5").count() == changed == done.affected_rows
    assert values(store.deltas(doc).select("old_value", "new_value").distinct()) == [("1.5", "3.5")]


def test_concurrent_commit_is_refused(store, spark):
    doc = store.create("t", spark.range(3).select(F.col("id").cast("string").alias("c")))
    store._commit(doc, 2, kind="rename", old_name="c", new_name="d", name="t")
    stale = store.entries
    store.entries = lambda i: stale(i)[:1]
    with pytest.raises(VersionConflict):
        store.apply(doc, Transformation("pad_left", "c", {"length": 3}))
    store.entries = stale
    assert store.read(doc).columns == ["_row_id", "d"] and store.deltas(doc).count() == 0


def test_failed_write_leaves_nothing(store, spark):
    broken = spark.range(3).select(F.expr("cast(raise_error('no') as string)").alias("c"))
    with pytest.raises(Exception):
        store.create("t", broken)
    assert store.names() == {}


def test_guards(store, spark, monkeypatch):
    monkeypatch.setattr(versions, "MAX_COLUMNS", 2)
    with pytest.raises(DocumentError):
        store.create("wide", spark.range(1).selectExpr("1 a", "2 b", "3 c"))
    with pytest.raises(DocumentError):
        store.create("  ", spark.range(1))
    with pytest.raises(DocumentError):
        store.read("unknown")
