"""Exact top-k search by inner product with MaxScore.

Vectors are integers per component; the components are the terms of a query. Candidates lie in blocks, each with one posting
column per component and the smallest and largest value of every column, which bound what a component can add to a score. Per
query and block the components are ordered by the span of their contribution. Those whose spans together cannot lift a candidate
over the query's tenth best score so far are non-essential: the essential columns are traversed for the whole block, and the others
are read, one after the other, only for candidates whose partial score plus what is left of the bound still competes.

The query set is taken in blocks of a bounded number of rows, each sent to all tasks; every task keeps its k best candidates per query,
and the shards are merged by a k-limited window over (task, query) winners.

Defined results: rows without vec_id take no part, nor do missing or empty vectors or those with a missing or non-finite component. A shorter vector counts
zeros for what it lacks. Rows that repeat a vec_id are separate candidates of one query; repeated query rows give one query (the smallest vector).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sheetloom.llm.common import keep, query, table

QUERY_ROWS = 4096
BLOCK_ROWS = 4096
SCHEMA = "query_id long, vec_id long, score long"


def integers(column: str, scale: int) -> Column:
    return F.transform(F.col(column), lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))


def usable(column: str) -> Column:
    bad = F.exists(F.col(column), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(column).isNotNull() & (F.size(column) > 0) & ~F.coalesce(bad, F.lit(False))


def _matrix(rows, width: int) -> np.ndarray:
    """Rows as one column-major matrix. Float arithmetic is exact below 2^53, integers wrap only above 2^63."""
    out = np.zeros((len(rows), width), np.int64, order="F")
    for i, row in enumerate(rows):
        out[i, : len(row)] = row
    return out


class Block:
    """Posting columns of some candidates and the bounds of each."""

    def __init__(self, ids: np.ndarray, rows, width: int):
        order = np.argsort(ids, kind="stable")
        self.ids, matrix = ids[order], _matrix([rows[i] for i in order], width)
        self.low, self.high = matrix.min(0), matrix.max(0)
        self.largest = max(abs(int(self.low.min())), abs(int(self.high.max())))
        self.columns = matrix

    def best(self, query_id: int, q: np.ndarray, k: int, floor: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of candidates that may be among the k best, where ``floor`` is the k-th best score so far."""
        columns = self.columns
        n, width = columns.shape
        fits = self.largest * int(np.abs(q).max(initial=0)) * max(width, 1) < 2**53
        kind = np.float64 if fits else np.int64
        ends = np.stack([q * self.low, q * self.high])
        top = ends.max(0)
        if floor is None:
            score = self._product(columns, q, kind)
            alive = np.arange(n)
        else:
            order = np.argsort(ends.min(0) - top, kind="stable")  # the widest span first
            rest = np.concatenate([np.cumsum(top[order][::-1])[::-1], [0]])  # the most that components i.. can add
            low_rest = np.concatenate([np.cumsum(ends.min(0)[order][::-1])[::-1], [0]])
            # With the least of every essential component, the rest cannot reach the floor: no candidate is met there alone.
            essential = int(np.searchsorted(-(rest - low_rest), -(floor - low_rest[0]), side="right"))
            essential = min(max(essential, 1), width)
            first = order[:essential]
            score = self._product(columns[:, first], q[first], kind)
            alive = np.flatnonzero(score + rest[essential] >= floor)
            score = score[alive]
            for start in range(essential, width, 8):
                if not len(alive):
                    break
                part = order[start : start + 8]
                score = score + self._product(columns[np.ix_(alive, part)], q[part], kind)
                near = score + rest[min(start + 8, width)] >= floor
                alive, score = alive[near], score[near]
        ids, score = self.ids[alive], score.astype(np.int64)
        other = ids != query_id
        return ids[other], score[other]

    @staticmethod
    def _product(columns: np.ndarray, q: np.ndarray, kind) -> np.ndarray:
        return columns.astype(kind) @ q.astype(kind)


def _leading(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    if len(ids) > k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        near = scores >= edge
        ids, scores = ids[near], scores[near]
    order = np.lexsort((ids, -scores))[:k]
    return ids[order], scores[order]


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): the k highest inner products of each query over all other rows, ties to the smaller vec_id.

    Both tables hold (vec_id long, vector array<long>).
    """
    queries = queries.groupBy("vec_id").agg(F.min("vector").alias("vector"))
    count = queries.count()
    blocks = max(1, -(-count * 10 // (QUERY_ROWS * 9)))
    partial = []
    for b in range(blocks):
        part = queries.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).collect()
        ids, rows = [r.vec_id for r in part], [np.asarray(r.vector, np.int64) for r in part]
        found = _shard(vectors, vectors.sparkSession.sparkContext.broadcast((ids, rows)), k)
        partial.append(found if blocks == 1 else keep(found, "topk"))
    merged = partial[0]
    for other in partial[1:]:
        merged = merged.unionByName(other)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return merged.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _shard(vectors: DataFrame, sent, k: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        query_ids, query_rows = sent.value
        best: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for frame in batches:
            for start in range(0, len(frame), BLOCK_ROWS):
                part = frame.iloc[start : start + BLOCK_ROWS]
                rows = list(part.vector)
                width = max([len(r) for r in rows] + [len(q) for q in query_rows] + [1])
                block = Block(part.vec_id.to_numpy(), rows, width)
                for i, (query_id, q) in enumerate(zip(query_ids, query_rows)):
                    old = best.get(i)
                    floor = int(old[1][-1]) if old is not None and len(old[0]) == k else None
                    ids, scores = block.best(query_id, np.pad(q, (0, width - len(q))), k, floor)
                    if old is not None:
                        ids, scores = np.concatenate([old[0], ids]), np.concatenate([old[1], scores])
                    best[i] = _leading(ids, scores, k)
        for i, (ids, scores) in best.items():
            yield pd.DataFrame({"query_id": np.full(len(ids), query_ids[i], np.int64), "vec_id": ids, "score": scores})

    return vectors.mapInPandas(run, SCHEMA)


SQL = """
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
         CAST(list_sum(list_transform(range(1, least(len(q.v), len(c.v)) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id),
ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""


@query(SQL)
def op10_exact_topk_search(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings").where(F.col("vec_id").isNotNull() & usable("embedding"))
    whole = rows.select("vec_id", integers("embedding", 1024).alias("vector"))
    return top_k(whole, whole.where(F.col("vec_id") % 100 == 0), 10)
