"""Means and deviations that do not depend on the order of rows.

Floating-point sums change with the order of their terms, so the last digits of a mean follow partitions and tasks. Here a number is split into an integer and a
power of two, integers of one power are summed exactly as decimals, and the few sums, one for each power, are put together as fractions. The result is the
true mean, rounded once.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Row, functions as F

BITS, HALF = 54, 27
#: Powers of two from this on; smaller digits, below 2 ** -1013, are dropped alike for every number.
LEAST_POWER = -960


def split(df: DataFrame, x: str = "x") -> DataFrame:
    """The same rows with the power of two ``p`` of their number, a little off at most, and the integer that is left in three columns.

    Zero, NaN, infinities and missing numbers have no power and need no sum.
    """
    value = F.col(x)
    plain = value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf")) & (value != 0)
    powered = df.withColumn("p", F.when(plain, F.greatest(F.lit(LEAST_POWER), F.floor(F.log2(F.abs(value))).cast("int"))))
    whole = powered.withColumn("whole", F.when(F.col("p").isNotNull(), (value * F.pow(F.lit(2.0), BITS - F.col("p"))).cast("bigint")))
    return whole.withColumns({"high": F.shiftright("whole", HALF), "low_part": F.col("whole").bitwiseAND(F.lit((1 << HALF) - 1))})


def sums(frequency: str = "frequency", x: str = "x") -> list[Column]:
    """Aggregates of ``split`` rows of one power, each ``frequency`` times: sums of integers below 2 ** 56 and, by halves, of their squares."""
    f, value, high, low = F.col(frequency), F.col(x), F.col("high"), F.col("low_part")
    times = f.cast("decimal(20,0)")
    total = [F.sum(v.cast("decimal(20,0)") * times).alias(n) for n, v in (("s", F.col("whole")), ("hh", high * high), ("hl", high * low), ("ll", low * low))]
    special = [F.sum(F.when(c, f).otherwise(0)).alias(n) for n, c in (("nans", F.isnan(value)), ("ups", value == float("inf")), ("downs", value == float("-inf")))]
    return [*total, F.sum(F.when(value.isNotNull(), f).otherwise(0)).alias("numbers"), *special]


def mean_and_deviation(rows: Iterable[Row]) -> tuple[float | None, float | None]:
    """Mean and sample deviation from the sums of every power (rows with ``p`` and the aggregates of ``sums``)."""
    n, total, squares = 0, Fraction(0), Fraction(0)
    nans = ups = downs = 0
    for r in rows:
        n, nans, ups, downs = n + (r.numbers or 0), nans + (r.nans or 0), ups + (r.ups or 0), downs + (r.downs or 0)
        if r.p is not None:
            unit = Fraction(2) ** (r.p - BITS)
            total += int(r.s) * unit
            squares += ((int(r.hh) << 2 * HALF) + (int(r.hl) << HALF + 1) + int(r.ll)) * unit * unit
    if not n:
        return None, None
    if nans or ups or downs:
        mean = math.nan if nans or ups and downs else math.inf if ups else -math.inf
        return mean, math.nan if n > 1 else None
    return _rounded(total / n), _root((squares - total * total / n) / (n - 1)) if n > 1 else None


def _rounded(value: Fraction) -> float:
    try:
        return float(value)
    except OverflowError:
        return math.copysign(math.inf, value)


def _root(value: Fraction) -> float:
    """The square root of a fraction to all digits of a float, also where the fraction itself has none."""
    if value <= 0:
        return 0.0
    shift = (value.denominator.bit_length() - value.numerator.bit_length() + 130) // 2
    scaled = value * Fraction(4) ** shift
    return _rounded(Fraction(math.isqrt(int(scaled))) / Fraction(2) ** shift)
