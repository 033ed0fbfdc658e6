"""Column transformations: expression, impact counts, samples and cell-level change log."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

from sheetloom.functions.dates import DEFAULT_FORMAT, FORMATS, is_serial, serial_to_date
from sheetloom.functions.text import as_text, blank, cell, text_of, trimmed
from sheetloom.operators.grid import ROW_ID

CHANGED_SAMPLES, FAILED_SAMPLES = 20, 5
PAD_MIN, PAD_MAX = 1, 512


class TransformError(ValueError):
    """A transformation that cannot run on the table."""


@dataclass(frozen=True)
class Transformation:
    kind: str
    column: str
    config: dict = field(default_factory=dict)


def _text_setting(config: dict, name: str) -> str:
    if not isinstance(config.get(name), str):
        raise TransformError(f"the transformation needs '{name}'")
    return config[name]


def _replaced(text: Column, config: dict) -> Column:
    find, replacement = _text_setting(config, "find"), _text_setting(config, "replacement")
    if config.get("regex") is True:
        raise TransformError("replace works on literal text only")
    return F.replace(text, F.lit(find), F.lit(replacement))


def _padded(text: Column, config: dict) -> Column:
    length = config.get("length")
    if not isinstance(length, int) or isinstance(length, bool) or not PAD_MIN <= length <= PAD_MAX:
        raise TransformError(f"the padded length must be a whole number from {PAD_MIN} to {PAD_MAX}")
    character = config.get("character") if isinstance(config.get("character"), str) else "0"
    return F.lpad(text, length, character[:1] or "0")


def _serial_text(text: Column, config: dict) -> Column:
    name = config.get("output_format") if isinstance(config.get("output_format"), str) else DEFAULT_FORMAT
    if name not in FORMATS:
        raise TransformError(f"unknown output format '{name}'")
    value = trimmed(text)
    return F.when(is_serial(value), F.date_format(serial_to_date(value), FORMATS[name][2])).otherwise(text)


_EXPRESSIONS = {
    "trim": lambda text, config: trimmed(text),
    "uppercase": lambda text, config: F.upper(text),
    "lowercase": lambda text, config: F.lower(text),
    "replace": _replaced,
    "pad_left": _padded,
    "excel_serial_date": _serial_text,
}


def expression(df: DataFrame, t: Transformation, row_id: str | None = ROW_ID) -> tuple[Column, Column]:
    """``(new text, failed)``; only the serial conversion can fail, on filled cells that hold no serial."""
    if not t.column.strip() or t.column == row_id or t.column not in df.columns:
        raise TransformError(f"no column '{t.column}' to transform")
    if t.kind not in _EXPRESSIONS:
        raise TransformError(f"unknown transformation '{t.kind}'")
    text = text_of(df, t.column)
    failed = ~blank(text) & ~is_serial(trimmed(text)) if t.kind == "excel_serial_date" else F.lit(False)
    return _EXPRESSIONS[t.kind](text, t.config), F.coalesce(failed, F.lit(False))


@dataclass(frozen=True)
class Outcome:
    """A transformation of one column: texts before and after, the new value in the column's type, and what went wrong."""

    before: Column
    after: Column
    value: Column
    failed: Column
    misfit: Column


def outcome(df: DataFrame, t: Transformation, row_id: str | None = ROW_ID) -> Outcome:
    """A column keeps its type: a new text that cannot become a value of it is a misfit, and the text after is that of the value."""
    new, failed = expression(df, t, row_id)
    before, kind = text_of(df, t.column), df.schema[t.column].dataType
    if isinstance(kind, StringType):
        return Outcome(before, new, new, failed, F.lit(False))
    value = F.when(before.eqNullSafe(new), cell(t.column)).otherwise(new.try_cast(kind))
    misfit = new.isNotNull() & value.isNull()
    return Outcome(before, as_text(value, kind), value, failed | misfit, misfit)


def transformed(df: DataFrame, t: Transformation, row_id: str | None = ROW_ID) -> DataFrame:
    return df.withColumn(t.column, outcome(df, t, row_id).value)


def impact(df: DataFrame, t: Transformation, row_id: str | None = ROW_ID) -> DataFrame:
    """Total, affected, unchanged and failed rows in one scan."""
    new = outcome(df, t, row_id)
    changed = ~new.before.eqNullSafe(new.after)
    total, affected = F.count(F.lit(1)), F.count_if(changed)
    return df.agg(
        total.alias("total_rows"),
        affected.alias("affected_rows"),
        (total - affected).alias("unchanged_rows"),
        F.count_if(new.failed).alias("failed_rows"),
    )


def samples(df: DataFrame, t: Transformation, row_id: str = ROW_ID) -> DataFrame:
    """Up to 20 changed rows, then up to 5 failed rows when fewer than 5 of the changed ones failed, in row order."""
    new = outcome(df, t, row_id)
    view = df.select(cell(row_id).alias("row_id"), new.before.alias("original"), new.after.alias("transformed"), new.failed.alias("failed"))
    changed = (
        view.where("NOT (original <=> transformed)")
        .orderBy("row_id")
        .limit(CHANGED_SAMPLES)
        .select("row_id", "original", "transformed", F.when(F.col("failed"), "failed").otherwise("changed").alias("status"))
    )
    if t.kind != "excel_serial_date" and isinstance(df.schema[t.column].dataType, StringType):
        return changed
    broken = view.where("failed").orderBy("row_id").limit(FAILED_SAMPLES)
    broken = broken.select("row_id", "original", "transformed", F.lit("failed").alias("status"))
    # A failed serial keeps its text and a misfit has none, so the second list always applies.
    return changed.unionByName(broken)


def deltas(df: DataFrame, t: Transformation, transformation_id: str, row_id: str = ROW_ID) -> DataFrame:
    """One log row per changed cell."""
    new = outcome(df, t, row_id)
    return df.where(~new.before.eqNullSafe(new.after)).select(
        F.lit(transformation_id).alias("transformation_id"),
        cell(row_id).cast("bigint").alias("row_id"),
        F.lit(t.column).alias("column_name"),
        new.before.alias("old_value"),
        new.after.alias("new_value"),
    )
