"""Batch cell edits and column renames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from sheetloom.functions.text import cell
from sheetloom.operators.grid import ROW_ID, data_columns
from sheetloom.operators.rules import Rule, rename_rules

EDIT_SCHEMA = "row_id bigint, column_name string, value string, sequence bigint"


class EditError(ValueError):
    """An edit or rename that does not fit the table."""


def _fits(df: DataFrame, columns: Sequence[str]) -> Column:
    """Whether the text of an edit can become a value of its column; text columns take everything, NULL fits anywhere."""
    fits = F.lit(True)
    for name in columns:
        ok = F.col("value").isNull() | F.col("value").try_cast(df.schema[name].dataType).isNotNull()
        fits = F.when(F.col("column_name") == name, ok).otherwise(fits)
    return fits


def checked_edits(df: DataFrame, edits: DataFrame, row_id: str = ROW_ID) -> DataFrame:
    """Edits with a ``problem``: unknown column, value of the wrong type, or NULL when they can be applied."""
    columns = data_columns(df, row_id)
    known = F.col("column_name").isin(*columns)
    negative = F.col("row_id") < 0
    typed = [c for c in columns if not isinstance(df.schema[c].dataType, T.StringType)]
    problem = F.when(~known | negative, "unknown cell").when(~_fits(df, typed), "wrong type")
    return edits.withColumn("problem", problem)


def unmatched_edits(df: DataFrame, edits: DataFrame, row_id: str = ROW_ID) -> DataFrame:
    """Edits of rows that do not exist."""
    return edits.join(df.select(cell(row_id).alias("row_id")), "row_id", "left_anti")


def patched(df: DataFrame, edits: DataFrame, row_id: str = ROW_ID) -> DataFrame:
    """The table with all applicable edits made; of several edits of a cell the one with the highest sequence wins.

    Edits are reduced to one row per edited row before the join, so the size of that side, not of the table, decides
    between a broadcast and a shuffle. Only columns that occur in the edits are touched.
    """
    named = {r.column_name for r in edits.select("column_name").distinct().collect()}  # at most one row per column counts
    columns = [c for c in data_columns(df, row_id) if c in named]
    if not columns:
        return df
    usable = checked_edits(df, edits, row_id).where("problem IS NULL")
    latest = usable.groupBy(F.col("row_id").alias("edited_row")).agg(
        *[
            F.max_by(F.struct("value"), F.when(F.col("column_name") == name, F.col("sequence"))).alias(f"edit_{i}")
            for i, name in enumerate(columns)
        ]
    )
    joined = df.join(latest, cell(row_id) == F.col("edited_row"), "left")
    out = []
    for name in df.columns:
        if name not in columns:
            out.append(cell(name))
            continue
        edit = F.col(f"edit_{columns.index(name)}")
        new = edit["value"].try_cast(df.schema[name].dataType)
        out.append(F.when(edit.isNotNull(), new).otherwise(cell(name)).alias(name))
    return joined.select(*out)


def rename_column(df: DataFrame, index: int, new_name: str, rules: Sequence[Rule] = (), row_id: str | None = ROW_ID) -> tuple[DataFrame, list[Rule]]:
    """Rename by position among the data columns; the rules of the old name follow."""
    columns = data_columns(df, row_id)
    new_name = new_name.strip()
    if not new_name:
        raise EditError("the new column name is blank")
    if not 0 <= index < len(columns):
        raise EditError(f"no column at position {index}")
    old = columns[index]
    if old == new_name:
        return df, list(rules)
    if new_name in df.columns or any(c.lower() == new_name.lower() for c in columns if c != old):
        raise EditError(f"there already is a column '{new_name}'")
    return df.select(*[cell(c).alias(new_name) if c == old else cell(c) for c in df.columns]), rename_rules(rules, old, new_name)
