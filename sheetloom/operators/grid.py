"""Filtered, sorted and paged views of a table, and its blank-cell statistics."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, functions as F, types as T

from sheetloom.functions.text import as_text, blank_cell, cell, contains_ignoring_case, text_of
from sheetloom.operators.rules import Rule, violation, violations
from sheetloom.plans.fused import all_of, passes, union_all, unpack

ROW_ID = "_row_id"
PAGE_MIN, PAGE_MAX = 25, 500
DEEP_OFFSET = 2_000
BRACKET_PARTS, BRACKET_ROWS = 200, 20_000
OPERATORS = ("contains", "equals", "empty", "quality_violation")


class GridError(ValueError):
    """A filter that does not fit the table."""


@dataclass(frozen=True)
class Filter:
    column: str
    operator: str = "contains"
    value: str = ""
    rule_id: str | None = None


@dataclass(frozen=True)
class Sort:
    column: str
    direction: str = "asc"


def data_columns(df: DataFrame, row_id: str | None) -> list[str]:
    return [name for name in df.columns if name != row_id]


def visible_columns(df: DataFrame, requested: Sequence[str] = (), row_id: str | None = ROW_ID) -> list[str]:
    """Requested columns that exist, in the requested order; all columns when none is left."""
    existing = data_columns(df, row_id)
    return [name for name in requested if name in existing] or existing


# --- filters -------------------------------------------------------------------------------------------------------


def clean_filters(filters: Sequence[Filter], columns: Sequence[str]) -> list[Filter]:
    """Drop filters that cannot apply: unknown columns, blank values, violations without a rule."""
    kept = []
    for f in filters:
        operator = f.operator if f.operator in OPERATORS else "contains"
        needs_value = operator in ("contains", "equals")
        needs_rule = operator == "quality_violation"
        if f.column not in columns or (needs_value and not f.value.strip()) or (needs_rule and not (f.rule_id or "").strip()):
            continue
        kept.append(Filter(f.column, operator, f.value.strip(), f.rule_id))
    return kept


def _cell_predicate(df: DataFrame, f: Filter, rules: dict[str, Rule]) -> Column:
    if f.operator == "empty":
        return blank_cell(df, f.column)
    text = text_of(df, f.column)
    if f.operator == "equals":
        return text == f.value
    if f.operator == "contains":
        return contains_ignoring_case(text, f.value)
    return violation(rules[f.rule_id], text)


def _split_filters(df: DataFrame, filters: Sequence[Filter], rules: Sequence[Rule], columns: Sequence[str]):
    """Predicates on single cells, and the rules that need the whole table (uniqueness)."""
    by_id = {rule.rule_id: rule for rule in rules}
    predicates, table_rules = [], []
    for f in clean_filters(filters, columns):
        if f.operator == "quality_violation":
            if f.rule_id not in by_id:
                raise GridError(f"no rule '{f.rule_id}'")
            if by_id[f.rule_id].column != f.column:
                raise GridError("the rule belongs to another column than the filter")
            if by_id[f.rule_id].rule_type == "unique":
                table_rules.append(by_id[f.rule_id])
                continue
        predicates.append(_cell_predicate(df, f, by_id))
    return predicates, table_rules


def filter_rows(df: DataFrame, filters: Sequence[Filter], rules: Sequence[Rule] = (), row_id: str | None = ROW_ID) -> DataFrame:
    """Rows that pass all filters. Uniqueness looks at the whole table, whatever the other filters keep."""
    predicates, table_rules = _split_filters(df, filters, rules, data_columns(df, row_id))
    if not table_rules:
        return df.where(all_of(predicates)) if predicates else df
    if len(table_rules) == 1:
        kept = violations(df, table_rules[0])
    else:
        if row_id is None:
            raise GridError("several uniqueness filters need row ids")
        kept = violations(df, table_rules[0])
        for rule in table_rules[1:]:
            kept = kept.join(violations(df, rule).select(cell(row_id)), row_id, "left_semi")
    return kept.where(all_of(predicates)) if predicates else kept


# --- sort and page -------------------------------------------------------------------------------------------------


def _sort_key(df: DataFrame, sort: Sort | None) -> Column | None:
    if sort is None or sort.column not in df.columns:
        return None
    column = cell(sort.column)
    textual = isinstance(df.schema[sort.column].dataType, T.StringType)
    return F.nullif(column, F.lit("")) if textual else column


def sort_order(df: DataFrame, sort: Sort | None, row_id: str | None = ROW_ID) -> list[Column]:
    """Sort expressions: empty text and NULL last in both directions, the row id as tie-breaker.

    A sorted table without row ids is ordered by its other columns where the sort column ties, so that its pages do not overlap.
    """
    key = _sort_key(df, sort)
    order = []
    if key is not None:
        order.append(key.desc_nulls_last() if sort.direction == "desc" else key.asc_nulls_last())
    if row_id is not None and row_id in df.columns:
        order.append(cell(row_id).asc())
    elif key is not None:
        order += [cell(f.name).asc() for f in df.schema if f.name != sort.column and not isinstance(f.dataType, (T.MapType, T.VariantType))]
    return order


def sort_rows(df: DataFrame, sort: Sort | None, row_id: str | None = ROW_ID) -> DataFrame:
    order = sort_order(df, sort, row_id)
    return df.orderBy(*order) if order else df


def page_size(limit: int) -> int:
    return max(PAGE_MIN, min(PAGE_MAX, limit))


def page_rows(
    df: DataFrame, sort: Sort | None, offset: int, limit: int, row_id: str | None = ROW_ID, deep_offset: int = DEEP_OFFSET
) -> DataFrame:
    """One page of 25 to 500 rows in sort order.

    Up to ``deep_offset`` rows, some pages, every task keeps its best ``offset + limit`` rows. Beyond that a sketch of the sort key brackets the
    page, the rows before the bracket are counted, and only sort keys and row ids inside it are sorted; the page's rows are fetched by id.
    """
    limit = page_size(limit)
    if offset + limit <= deep_offset:
        return sort_rows(df, sort, row_id).offset(offset).limit(limit)
    inside, before = _around_page(df, sort, offset, limit, row_id)
    if row_id is None or row_id not in df.columns:
        return sort_rows(inside, sort, row_id).offset(offset - before).limit(limit)
    key = _sort_key(df, sort)
    thin = inside.select(*([key.alias("sort_key")] if key is not None else []), cell(row_id).alias("id"))
    order = [F.col("id").asc()]
    if key is not None:
        order.insert(0, F.desc_nulls_last("sort_key") if sort.direction == "desc" else F.asc_nulls_last("sort_key"))
    ids = thin.orderBy(*order).offset(offset - before).limit(limit).select("id")
    if isinstance(df.schema[row_id].dataType, (T.IntegralType, T.StringType)):
        # At most 500 literals, which the scan can use to skip row groups.
        return sort_rows(df.where(cell(row_id).isin([row.id for row in ids.collect()])), sort, row_id)
    chosen = F.broadcast(ids.withColumnRenamed("id", row_id))
    return sort_rows(df.join(chosen, row_id, "left_semi"), sort, row_id)


def _around_page(df: DataFrame, sort: Sort | None, offset: int, limit: int, row_id: str | None) -> tuple[DataFrame, int]:
    """The rows whose sort key lies near the sorted positions of a page, and how many rows come before them.

    Brackets are narrowed until ``BRACKET_ROWS`` remain or the key is a single value, then the row id goes on in its place. A bracket that misses the page
    is not used, so a poor sketch costs time only. Text keys have no sketch; their rows are all taken.
    """
    before = 0
    keys = [(_sort_key(df, sort), sort.direction == "desc")] if _sort_key(df, sort) is not None else []
    if row_id is not None and row_id in df.columns:
        keys.append((cell(row_id), False))
    for key, descending in keys:
        kind = df.select(key).schema[0].dataType
        if not isinstance(kind, (T.NumericType, T.DateType, T.TimestampType)):
            break
        while True:
            found = _bracket(df, key, descending, offset - before, limit)
            if found is None:
                break
            df, skipped, left, single = found
            before += skipped
            if left <= BRACKET_ROWS:
                return df, before
            if single:
                break
        if found is None:
            break
    return df, before


def _bracket(df: DataFrame, key: Column, descending: bool, offset: int, limit: int) -> tuple[DataFrame, int, int, bool] | None:
    """Rows of a bracket around sorted positions, the rows before it, the rows in it, and whether it is one value; None if it is no narrower."""
    shares = F.array(*[F.lit(i / BRACKET_PARTS) for i in range(BRACKET_PARTS + 1)])
    whole = df.agg(F.count(F.lit(1)).alias("n"), F.count(key).alias("filled"), F.percentile_approx(key, shares, F.lit(10_000)).alias("q")).first()
    end = min(offset + limit, whole.n)
    if not whole.filled or offset >= whole.n:
        return None
    if offset >= whole.filled:
        return (df.where(key.isNull()), whole.filled, whole.n - whole.filled, True) if whole.filled else None
    first, last = (max(0, whole.filled - end), whole.filled - offset) if descending else (offset, min(end, whole.filled))
    low = whole.q[max(0, first * BRACKET_PARTS // whole.filled - 1)]
    high = whole.q[min(BRACKET_PARTS, -(-last * BRACKET_PARTS // whole.filled) + 1)]
    within, ahead = (key >= F.lit(low)) & (key <= F.lit(high)), key > F.lit(high) if descending else key < F.lit(low)
    if end > whole.filled:
        within = (key.isNull() | (key <= F.lit(high))) if descending else (key.isNull() | (key >= F.lit(low)))
    counted = df.agg(F.count_if(ahead).alias("ahead"), F.count_if(within).alias("within")).first()
    if counted.ahead > offset or counted.ahead + counted.within < end or counted.within == whole.n:
        return None
    return df.where(within), counted.ahead, counted.within, low == high


def next_page(df: DataFrame, sort: Sort | None, after: tuple, limit: int, row_id: str = ROW_ID) -> DataFrame:
    """The page after a row, given its ``(sort value, row id)``: a filter instead of an offset, so depth costs nothing."""
    key = _sort_key(df, sort)
    last_key, last_id = after
    later_id = cell(row_id) > F.lit(last_id)
    if key is None:
        rest = df.where(later_id)
    elif last_key is None or last_key == "":
        rest = df.where(key.isNull() & later_id)
    else:
        beyond = key < F.lit(last_key) if sort.direction == "desc" else key > F.lit(last_key)
        rest = df.where(beyond | key.isNull() | ((key == F.lit(last_key)) & later_id))
    return sort_rows(rest, sort, row_id).limit(page_size(limit))


# --- statistics and envelopes --------------------------------------------------------------------------------------


def blank_stats(df: DataFrame, row_id: str | None = ROW_ID) -> DataFrame:
    """Blank cells of every column that has some, from one scan for all columns."""
    frames = []
    for part in passes(data_columns(df, row_id)):
        row = df.agg(*[F.count_if(blank_cell(df, name)).alias(str(i)) for i, name in enumerate(part)])
        structs = [F.struct(F.lit(name).alias("column"), cell(str(i)).alias("empty_count")) for i, name in enumerate(part)]
        frames.append(unpack(row, structs))
    return union_all(frames).where("empty_count > 0")


def window_summary(
    df: DataFrame,
    filters: Sequence[Filter] = (),
    rules: Sequence[Rule] = (),
    offset: int = 0,
    limit: int = 100,
    row_id: str | None = ROW_ID,
) -> DataFrame:
    """The page envelope without the rows: filtered count and blank totals of the unfiltered table, in one scan.

    A uniqueness filter needs its own job for the filtered count.
    """
    columns = data_columns(df, row_id)
    predicates, table_rules = _split_filters(df, filters, rules, columns)
    filtered = F.count_if(all_of(predicates)).alias("total_rows")
    if table_rules:
        filtered = F.lit(filter_rows(df, filters, rules, row_id).count()).cast("bigint").alias("total_rows")
    position, row = {name: i for i, name in enumerate(columns)}, None
    for part in passes(columns):
        blanks = [F.count_if(blank_cell(df, name)).alias(f"b{position[name]}") for name in part]
        counted = df.agg(*([filtered] if row is None else []), *blanks)
        row = counted if row is None else row.crossJoin(counted)  # one row each
    each = F.array(*[F.col(f"b{i}") for i in range(len(columns))])
    limit = page_size(limit)
    shown = F.greatest(F.lit(0), F.least(F.lit(limit), F.col("total_rows") - F.lit(offset)))
    reached = F.lit(offset) + shown
    has_more = reached < F.col("total_rows")
    return row.select(
        F.lit(len(columns)).alias("column_count"),
        "total_rows",
        F.lit(offset).alias("offset"),
        F.lit(limit).alias("limit"),
        has_more.alias("has_more"),
        F.when(has_more, reached).alias("next_offset"),
        F.size(F.filter(each, lambda n: n > 0)).alias("columns_with_empty"),
        F.aggregate(each, F.lit(0).cast("bigint"), lambda total, n: total + n).alias("empty_cells"),
        each.alias("empty_counts"),
    )


@dataclass
class TableWindow:
    columns: list[str]
    column_types: list[str]
    rows: list[list[str | None]]
    row_ids: list[int] | None
    total_rows: int
    offset: int
    limit: int
    has_more: bool
    next_offset: int | None
    sort: dict | None
    filters: list[dict] = field(default_factory=list)
    stats: dict = field(default_factory=dict)


def open_window(
    df: DataFrame,
    filters: Sequence[Filter] = (),
    sort: Sort | None = None,
    offset: int = 0,
    limit: int = 100,
    requested: Sequence[str] = (),
    rules: Sequence[Rule] = (),
    row_id: str | None = ROW_ID,
) -> TableWindow:
    """A page with its envelope in two jobs: the page itself, and one fused scan for all counts."""
    row_id = row_id if row_id in df.columns else None
    columns = visible_columns(df, requested, row_id)
    everything = data_columns(df, row_id)
    page = page_rows(filter_rows(df, filters, rules, row_id), sort, offset, limit, row_id)
    ids = [cell(row_id)] if row_id else []
    shown = page.select(*ids, *[as_text(cell(c), df.schema[c].dataType).alias(f"c{i}") for i, c in enumerate(columns)])
    rows = shown.collect()
    summary = window_summary(df, filters, rules, offset, limit, row_id).first()
    known_sort = sort if sort is not None and sort.column in everything else None
    return TableWindow(
        columns=columns,
        column_types=[df.schema[c].dataType.simpleString() for c in columns],
        rows=[[row[f"c{i}"] for i in range(len(columns))] for row in rows],
        row_ids=[row[row_id] for row in rows] if row_id else None,
        total_rows=summary.total_rows,
        offset=offset,
        limit=summary["limit"],
        has_more=offset + len(rows) < summary.total_rows,
        next_offset=offset + len(rows) if offset + len(rows) < summary.total_rows else None,
        sort=asdict(known_sort) if known_sort else None,
        filters=[asdict(f) for f in clean_filters(filters, everything)],
        stats={
            "column_count": summary.column_count,
            "columns_with_empty": summary.columns_with_empty,
            "empty_cells": summary.empty_cells,
            "quality": [{"column": c, "empty_count": n} for c, n in zip(everything, summary.empty_counts) if n > 0],
        },
    )


def violation_window(df: DataFrame, rule: Rule, offset: int = 0, limit: int = 100, requested: Sequence[str] = (), row_id: str | None = ROW_ID) -> TableWindow:
    """The rows that break one rule, as a page."""
    broken = Filter(rule.column, "quality_violation", rule_id=rule.rule_id)
    return open_window(df, [broken], None, offset, limit, requested, [rule], row_id)
