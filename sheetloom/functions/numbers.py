"""Lenient text-to-number parsing."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Spellings accepted as a number or as one of the special floating-point values.
NUMBER = r"^\s*[+-]?(?:[0-9](?:_?[0-9])*\.?(?:[0-9](?:_?[0-9])*)?|\.[0-9](?:_?[0-9])*)(?:[eE][+-]?[0-9]+)?\s*\z"
SPECIAL = r"^\s*[+-]?(?i:inf|infinity|nan)\s*\z"
DECIMAL_TEXT = r"^[+-]?([0-9]+(\.[0-9]+)?|\.[0-9]+)\z"


def decimal_point(value: Column) -> Column:
    return F.replace(value, F.lit(","), F.lit("."))


def parse_double(value: Column) -> Column:
    """Number with ``,`` or ``.`` as the decimal mark, ``_`` between digits allowed; NULL when it is not a number."""
    text = decimal_point(value)
    return F.when(text.rlike(NUMBER) | text.rlike(SPECIAL), F.replace(text, F.lit("_"), F.lit("")).try_cast("double"))


def parse_decimal(value: Column) -> Column:
    """Only plain integers and decimals: what makes a column numeric."""
    text = decimal_point(value)
    return F.when(text.rlike(DECIMAL_TEXT), text.try_cast("double"))


def finite(number: Column) -> Column:
    """NULL for NaN and the infinities, which have no place on a histogram axis."""
    return F.when(~F.isnan(number) & (F.abs(number) != float("inf")), number)
