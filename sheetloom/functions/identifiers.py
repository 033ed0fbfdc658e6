"""Check digits and address shapes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

# Fixed value: what counts as an address.
EMAIL = r"^[A-Za-z0-9.!#$%&'*+/=?^_`{|}~-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+\z"


def valid_email(value: Column) -> Column:
    return value.rlike(EMAIL)


def valid_cpf(value: Column) -> Column:
    """Eleven digits, not all equal, closed by two modulo-11 check digits. Other characters are ignored."""
    digits = F.regexp_replace(value, "[^0-9]", "")

    def check_digit(count: int) -> Column:
        weighted = (F.substring(digits, i + 1, 1).try_cast("int") * (count + 1 - i) for i in range(count))
        return (reduce(Column.__add__, weighted) * 10) % 11 % 10

    def matches(count: int) -> Column:
        return F.substring(digits, count + 1, 1).try_cast("int") == check_digit(count)

    all_equal = F.replace(digits, F.substring(digits, 1, 1), F.lit("")) == ""
    return F.when((F.length(digits) == 11) & ~all_equal, matches(9) & matches(10)).otherwise(False)
