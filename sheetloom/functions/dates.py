"""Date text, strict date formats, and day serials of spreadsheets."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Bounds of a day serial, the serial of the day that never existed, and the day before serial 1.
SERIAL_MIN, SERIAL_MAX, SERIAL_GAP = 1, 73050, 60
SERIAL_BASE = "1899-12-31"

# Accepted formats -> (shape of the text, parse pattern, output pattern).
FORMATS = {
    "DD/MM/YYYY": (r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{1,4}\z", "d/M/y", "dd/MM/yyyy"),
    "YYYY/MM/DD": (r"^[0-9]{1,4}/[0-9]{1,2}/[0-9]{1,2}\z", "y/M/d", "yyyy/MM/dd"),
    "YYYY-MM-DD": (r"^[0-9]{1,4}-[0-9]{1,2}-[0-9]{1,2}\z", "y-M-d", "yyyy-MM-dd"),
    "DD-MM-YYYY": (r"^[0-9]{1,2}-[0-9]{1,2}-[0-9]{1,4}\z", "d-M-y", "dd-MM-yyyy"),
}
DEFAULT_FORMAT = "DD/MM/YYYY"

# Year-month-day with one kind of separator, then optionally a time and a zone.
_TIMESTAMP = (
    r"^\s*([0-9]{1,6})([-/ \\])([0-9]{1,2})\2([0-9]{1,2})"
    r"(?:(?:T| +)([0-9]{1,2}:[0-9]{1,2}(?::[0-9]{1,2}(?:\.[0-9]*)?)?)"
    r"(?: *(?:Z|UTC|GMT|[+-][0-9]{2}(?::?[0-9]{2})?|[A-Za-z_]+/[A-Za-z_/]+))?)?\s*\z"
)
# The same in the one spelling most files use, which casts as it is.
_PLAIN_TIMESTAMP = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}(?: (?:[01][0-9]|2[0-3]):[0-9]{2}:[0-9]{2}(?:\.[0-9]{1,6})?)?\z"
_MIDNIGHT_24 = r" 24(:0{1,2}){1,2}(\.0*)?\z"
TIME_OF_DAY = r"[ T][0-9]{1,2}:[0-9]{2}"


def parse_timestamp(value: Column) -> Column:
    """Timestamp without zone from ISO-like text; plain years, year-months and integers are refused."""
    flat = F.regexp_replace(value, _TIMESTAMP, "$1-$3-$4 $5")
    flat = F.concat(F.repeat(F.lit("0"), F.greatest(F.lit(0), F.lit(5) - F.locate("-", flat))), flat)
    late = flat.rlike(_MIDNIGHT_24)
    at_start = F.regexp_replace(flat, _MIDNIGHT_24, " 00:00").try_cast("timestamp_ntz")
    parsed = F.when(late, at_start + F.expr("INTERVAL 1 DAY")).otherwise(flat.try_cast("timestamp_ntz"))
    return F.when(value.rlike(_PLAIN_TIMESTAMP), value.try_cast("timestamp_ntz")).when(value.rlike(_TIMESTAMP), parsed)


def has_time_of_day(value: Column) -> Column:
    return value.rlike(TIME_OF_DAY)


def parse_format(value: Column, name: str) -> Column:
    """Date in one of the four fixed formats; unknown format names mean day/month/year."""
    shape, pattern, _ = FORMATS.get(name, FORMATS[DEFAULT_FORMAT])
    return F.when(value.rlike(shape), F.try_to_timestamp(value, F.lit(pattern)).cast("date"))


def _serial_number(value: Column) -> Column:
    """Casts are attempted only where they cannot fail: a failed one costs an exception per cell."""
    return F.when(value.rlike(r"^0*[0-9]{1,5}\z"), value.try_cast("bigint"))


def is_serial(value: Column) -> Column:
    """True for a whole number that a spreadsheet shows as a date; never NULL."""
    number = _serial_number(value)
    return F.coalesce(number.between(SERIAL_MIN, SERIAL_MAX) & (number != SERIAL_GAP), F.lit(False))


def serial_to_date(value: Column) -> Column:
    """The date of a serial; serials after the gap are one day early because day 60 was never real."""
    number = _serial_number(value).cast("int")
    days = F.when(number > SERIAL_GAP, number - 1).otherwise(number)
    return F.when(is_serial(value), F.date_add(F.lit(SERIAL_BASE).cast("date"), days))
