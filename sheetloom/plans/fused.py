"""Many statistics from one scan.

A statistic per column would cost a scan per column. These helpers put them all in one ungrouped aggregate and turn the
single result row back into one row per statistic. Very wide tables are cut into passes of disjoint columns, which a
columnar source reads at no extra cost.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

COLUMNS_PER_PASS = 100
SMALL_SHARE = 16 << 20


def passes(columns: Sequence[str], size: int = COLUMNS_PER_PASS) -> Iterator[Sequence[str]]:
    for start in range(0, len(columns), size):
        yield columns[start : start + size]


def _is_small(df: DataFrame) -> bool:
    """Whether the input is known to be too small to keep all cores busy."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) < _cores(df) * SMALL_SHARE


def _cores(df: DataFrame) -> int:
    return df.sparkSession.sparkContext.defaultParallelism


def spread(df: DataFrame) -> DataFrame:
    """Give every core a share of an input that is too small to be split by the scan; larger inputs stay as they are.

    Cell statistics cost far more time than such a shuffle of at most ``SMALL_SHARE`` bytes per core.
    """
    if df.is_cached or not _is_small(df):
        return df
    return df.repartition(_cores(df))


@contextmanager
def held(df: DataFrame) -> Iterator[DataFrame]:
    """Keep a small input in memory while several jobs read it; larger inputs are read again by each job."""
    if not _is_small(df):
        yield df
        return
    kept = df.repartition(_cores(df)).persist()
    try:
        yield kept
    finally:
        kept.unpersist()


def unpack(row: DataFrame, structs: Sequence[Column]) -> DataFrame:
    """One output row per struct built from a one-row frame."""
    return row.select(F.inline(F.array(*structs)))


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def any_of(predicates: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, predicates, F.lit(False))


def all_of(predicates: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, predicates, F.lit(True))
