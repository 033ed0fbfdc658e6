"""Exact medians of weighted numbers without sorting a column in one task.

A round counts the numbers of every bucket between the smallest and the largest candidate; the bucket that holds the middle rank gives the candidates of the
next round. Buckets of the first round are on a logarithmic scale, which parts numbers of very different size, those of later rounds are linear
between the smallest and largest number of their bucket. The rounds are the same whatever the number of rows; two or three do for most columns.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, functions as F

from sheetloom.functions.text import cell

BUCKETS = 4096


@dataclass
class Search:
    """Where the lower middle number of a column is: between ``low`` and ``high``, with ``below`` numbers under ``low``."""

    rows: int
    low: float | None = None
    high: float | None = None
    below: int = 0
    above: float | None = None  # the smallest number over ``high``

    @property
    def rank(self) -> int:
        return (self.rows - 1) // 2

    def narrow(self, buckets: list[Row]) -> None:
        """Go to the bucket with the lower middle rank."""
        buckets = sorted(buckets, key=lambda b: b.low)
        before = self.below
        for b, after in zip(buckets, [*buckets[1:], None]):
            if before + b.rows > self.rank:
                self.low, self.high, self.below = b.low, b.high, before
                self.above = after.low if after is not None else self.above
                self.upto = before + b.rows
                return
            before += b.rows
        raise RuntimeError("the numbers changed while their median was looked for")

    @property
    def found(self) -> bool:
        return self.low is not None and self.low == self.high

    @property
    def median(self) -> float:
        """The middle number, or the mean of the two."""
        if self.rows % 2 or self.upto > self.rank + 1:
            return self.low
        return self.low + (self.above - self.low) * 0.5


def _by_column(values: dict[int, float]) -> Column:
    return F.element_at(F.create_map(*[F.lit(v) for pair in values.items() for v in pair]), F.col("column_index"))


def weighted_medians(numbers: DataFrame, rows: dict[int, int]) -> dict[int, float]:
    """The medians of (column_index, x, frequency), NULLs ignored; ``rows`` has the number of numbers of every column."""
    todo = {i: Search(n) for i, n in rows.items() if n}
    done: dict[int, float] = {}
    numbers = numbers.where(F.col("x").isNotNull())
    while todo:
        x, index = F.col("x"), F.col("column_index")
        fresh = [i for i, s in todo.items() if s.low is None]
        started = {i: s for i, s in todo.items() if s.low is not None}
        bucket = F.floor(F.signum(x) * F.log1p(F.abs(x)) * 8)
        kept = index.isin(*fresh) if fresh else F.lit(False)
        if started:
            low, high = _by_column({i: float(s.low) for i, s in started.items()}), _by_column({i: float(s.high) for i, s in started.items()})
            # Halved where the distance of the ends has no value.
            scale = _by_column({i: 0.5 if math.isinf(s.high - s.low) else 1.0 for i, s in started.items()})
            place = F.floor((x * scale - low * scale) / (high * scale - low * scale) * BUCKETS)
            inside = index.isin(*started) & x.between(low, high)
            bucket, kept = F.when(index.isin(*started), place).otherwise(bucket), kept | inside
        # Infinite and missing numbers have no place on a scale and stand alone.
        alone = F.isnan(x) | (F.abs(x) == float("inf"))
        grouped = numbers.where(kept).groupBy("column_index", F.when(~alone, bucket).alias("bucket"), F.when(alone, x).alias("lone"))
        counted = grouped.agg(F.min("x").alias("low"), F.max("x").alias("high"), F.sum("frequency").alias("rows")).collect()
        for i, s in list(todo.items()):
            s.narrow([r for r in counted if r.column_index == i])
            if s.found or s.low != s.low:
                done[i] = s.median
                del todo[i]
    return done


def exact_median(df: DataFrame, name: str) -> float | None:
    counted = df.groupBy(cell(name).cast("double").alias("x")).agg(F.count(F.lit(1)).alias("frequency")).select(F.lit(0).alias("column_index"), "x", "frequency")
    n = counted.where("x IS NOT NULL").agg(F.sum("frequency")).first()[0]
    return weighted_medians(counted, {0: n})[0] if n else None
