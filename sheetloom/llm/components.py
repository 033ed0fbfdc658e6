"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sheetloom.llm.common import keep, release


def components(edges: DataFrame) -> DataFrame:
    """(id, component): for every end of an edge (a, b) the smallest id that links reach from it. Ends without a value are no ends.

    Large-star hangs every larger neighbour of a node below the node's smallest neighbour, small-star every smaller one; both keep
    the components and flatten them until each is a star around its smallest id. Minima are pre-aggregated before the shuffle and each
    round is written to the shared folder, so neither a hub nor a lost executor makes a round long.
    """
    pairs = keep(_directed(edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))), "edges")
    before = None
    while True:
        last, pairs = pairs, keep(_small(_large(pairs)), "stars")
        release(last)
        state = pairs.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(a, b))"), F.sum(F.col("b").cast("decimal(38,0)"))).collect()[0]
        if state == before:
            break
        before = state
    roots = pairs.select(F.col("b").alias("id")).distinct()
    return pairs.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots.select("id", F.col("id").alias("component")))


def _directed(edges: DataFrame) -> DataFrame:
    """Every edge once, from the larger end to the smaller."""
    return edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _large(pairs: DataFrame) -> DataFrame:
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.where(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where(F.col("a") != F.col("b")).distinct()


def _small(pairs: DataFrame) -> DataFrame:
    least = pairs.groupBy("a").agg(F.min("b").alias("m"))
    moved = pairs.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
    return moved.where(F.col("a") != F.col("b")).distinct()
