import random

import pytest
from pyspark.sql import functions as F

from conftest import values
from sheetloom.operators import grid
from sheetloom.operators.grid import Filter, GridError, Sort
from sheetloom.operators.rules import Rule


@pytest.fixture(scope="module")
def people(spark):
    rows = [(0, "Ana", "31", "x"), (1, "", "5", None), (2, None, "7", ""), (3, "  ", "9", "y"), (4, "bia", "10", "50%"), (5, "Ana", None, "a_b")]
    return spark.createDataFrame(rows, "_row_id bigint, nome string, idade string, `a.b` string")


def ids(df):
    return [r._row_id for r in df.collect()]


def test_clean_filters():
    columns = ["a", "b"]
    kept = grid.clean_filters(
        [Filter("a", "equals", " x "), Filter("z", "equals", "x"), Filter("a", "contains", "  "), Filter("b", "empty"), Filter("b", "like", "q"), Filter("a", "quality_violation"), Filter("a", "quality_violation", rule_id="r")],
        columns,
    )
    assert [(f.column, f.operator, f.value) for f in kept] == [("a", "equals", "x"), ("b", "empty", ""), ("b", "contains", "q"), ("a", "quality_violation", "")]


def test_filters(people):
    def found(*filters, rules=()):
        return sorted(ids(grid.filter_rows(people, filters, rules)))

    assert found(Filter("nome", value="AN")) == [0, 5]
    assert found(Filter("nome", "empty")) == [1, 2, 3]
    assert found(Filter("a.b", "contains", "%")) == [0, 1, 2, 3, 4, 5]
    assert found(Filter("a.b", "equals", "50%")) == [4]
    once, number = Rule("u", "nome", "unique", "once"), Rule("n", "idade", "numeric", "number")
    assert found(Filter("nome", "quality_violation", rule_id="u"), rules=[once]) == [0, 5]
    assert found(Filter("nome", "quality_violation", rule_id="u"), Filter("idade", "equals", "31"), rules=[once]) == [0]
    with pytest.raises(GridError):
        found(Filter("nome", "quality_violation", rule_id="n"), rules=[number])
    with pytest.raises(GridError):
        found(Filter("nome", "quality_violation", rule_id="gone"), rules=[number])


def test_sort_puts_blanks_last(people):
    assert ids(grid.sort_rows(people, Sort("nome"))) == [3, 0, 5, 4, 1, 2]
    assert ids(grid.sort_rows(people, Sort("nome", "desc"))) == [4, 0, 5, 3, 1, 2]
    assert ids(grid.sort_rows(people, Sort("unknown", "desc"))) == [0, 1, 2, 3, 4, 5]


def test_visible_columns(people):
    assert grid.visible_columns(people, ["a.b", "zzz", "nome"]) == ["a.b", "nome"]
    assert grid.visible_columns(people, ["zzz"]) == ["nome", "idade", "a.b"]


def test_window(people):
    window = grid.open_window(people, [Filter("nome", value="a")], Sort("idade", "desc"), 0, 1, ["idade", "nome"])
    assert window.columns == ["idade", "nome"] and window.limit == 25 and window.total_rows == 3
    assert window.rows == [["31", "Ana"], ["10", "bia"], [None, "Ana"]] and window.row_ids == [0, 4, 5]
    assert not window.has_more and window.next_offset is None and window.filters[0]["operator"] == "contains"
    assert window.stats == {
        "column_count": 3, "columns_with_empty": 3, "empty_cells": 6,
        "quality": [{"column": "nome", "empty_count": 3}, {"column": "idade", "empty_count": 1}, {"column": "a.b", "empty_count": 2}],
    }


def test_violation_window(people):
    window = grid.violation_window(people, Rule("r", "a.b", "required", "given"))
    assert window.row_ids == [1, 2] and window.total_rows == 2


@pytest.fixture(scope="module")
def many(spark):
    random.seed(5)
    rows = [(i, random.choice([None, "", "hot", "hot", f"v{random.randint(0, 300):03d}"])) for i in range(3000)]
    return rows, spark.createDataFrame(rows, "_row_id bigint, v string").repartition(7)


def by_hand(rows, direction):
    filled = sorted((r for r in rows if r[1]), key=lambda r: r[0])
    filled.sort(key=lambda r: r[1], reverse=direction == "desc")
    return [i for i, _ in filled] + [i for i, v in rows if not v]


@pytest.mark.parametrize("direction", ["asc", "desc"])
@pytest.mark.parametrize("offset", [0, 700, 1990, 2980, 5000])
def test_shallow_and_deep_pages_agree(many, direction, offset):
    rows, df = many
    expected = by_hand(rows, direction)[offset : offset + 60]
    assert ids(grid.page_rows(df, Sort("v", direction), offset, 60)) == expected
    assert ids(grid.page_rows(df, Sort("v", direction), offset, 60, deep_offset=10)) == expected


@pytest.mark.parametrize("direction", ["asc", "desc"])
def test_walking_pages_sees_every_row_once(many, direction):
    rows, df = many
    page = [tuple(r) for r in grid.page_rows(df, Sort("v", direction), 0, 500).collect()]
    seen = []
    while page:
        seen += [r[0] for r in page]
        last = page[-1]
        page = [tuple(r) for r in grid.next_page(df, Sort("v", direction), (last[1], last[0]), 500).collect()]
    assert seen == by_hand(rows, direction)


def test_sorted_page_is_a_top_k(many):
    plan = grid.page_rows(many[1], Sort("v"), 100, 50)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "rangepartitioning" not in plan


def test_blank_stats_only_lists_columns_with_blanks(people):
    assert values(grid.blank_stats(people.withColumn("full", F.lit("x")))) == [("nome", 3), ("idade", 1), ("a.b", 2)]
