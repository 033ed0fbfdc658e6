"""Best-fit packing under conflicts.

Documents are put into sequences of ``capacity`` characters. A sequence holds no two documents of one source and none of one duplicate cluster.
Bins are ordered by residual: a segment tree over the residuals 0 to ``capacity`` keeps, for every range of residuals, the sources that all bins of the range
hold already. For each document, largest first, the successor search walks to the smallest sufficient residual with a bin that lacks the
source, compares cluster bitmaps there and goes on until a compatible bin is found, which is the tightest one; otherwise a bin is opened.

A text longer than the capacity fills sequences of its own; what remains is packed as its last piece. Documents are dealt to shards by a hash of id, text
digest and copy number, about ``shard_rows`` each, so that their number and not their size follows the input; a shard packs on its own. Only ids, lengths,
digests, sources and clusters move.

The query takes the near-duplicate components of the documents as clusters; ``sized`` alone, as in the pipeline, whose second stage has removed near copies,
those of equal texts.

Defined results: a missing or empty text is one piece of length 0; a missing source or cluster conflicts with nothing; rows that repeat an id and rows
without one are packed each (and share the cluster if their texts are equal); equal lengths go in order of id, rows without one last, then of digest.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetloom.llm.common import keep, query, table, whole_text
from sheetloom.llm.components import components
from sheetloom.llm.jaccard import similar_components

CAPACITY = 8192
SHARD_ROWS = 8000
PLACED = "id long, n_chars int, piece int, n_pieces int, size int, shard int, bin int, slot int"
NAMED = f"{PLACED}, digest string, missing boolean"


class Bins:
    """Open bins by residual. ``common[node]`` has the source bits that every bin below the node has; -1 where there is none."""

    def __init__(self, capacity: int):
        self.width = 1 << capacity.bit_length()
        self.common = [-1] * (2 * self.width)
        self.at: dict[int, list[int]] = {}
        self.sources: list[int] = []
        self.clusters: list[int] = []

    def _refresh(self, residual: int) -> None:
        common = -1
        for b in self.at.get(residual, ()):
            common &= self.sources[b]
        node = residual + self.width
        self.common[node] = common
        while node > 1:
            node //= 2
            new = self.common[2 * node] & self.common[2 * node + 1]
            if self.common[node] == new:
                break
            self.common[node] = new

    def _next(self, residual: int, source: int) -> int:
        """The smallest residual from ``residual`` on with a bin that lacks the source, or -1."""
        node = residual + self.width
        while True:
            if self._lacks(node, source):
                while node < self.width:
                    node = 2 * node if self._lacks(2 * node, source) else 2 * node + 1
                return node - self.width
            while node & 1:  # up to the next subtree on the right
                node //= 2
            if node == 0:
                return -1
            node += 1

    def _lacks(self, node: int, source: int) -> bool:
        common = self.common[node]
        return common != -1 and not common & source if source else common != -1

    def place(self, size: int, source: int, cluster: int, capacity: int) -> int:
        """Put an item into the tightest compatible bin, the oldest of equals, and return its number."""
        residual = self._next(size, source) if size < self.width else -1
        while residual >= 0:
            for b in self.at[residual]:
                if not self.sources[b] & source and not self.clusters[b] & cluster:
                    self._move(b, residual, residual - size, source, cluster)
                    return b
            residual = self._next(residual + 1, source) if residual + 1 < self.width else -1
        self.sources.append(0)
        self.clusters.append(0)
        b = len(self.sources) - 1
        self._move(b, None, capacity - size, source, cluster)
        return b

    def _move(self, b: int, old: int | None, new: int, source: int, cluster: int) -> None:
        if old is not None:
            self.at[old].remove(b)
        self.sources[b] |= source
        self.clusters[b] |= cluster
        own = self.at.setdefault(new, [])
        own.append(b)
        own.sort()
        for residual in {new, old} - {None}:
            self._refresh(residual)


def pack(items: pd.DataFrame, capacity: int) -> pd.DataFrame:
    """Pack one shard: rows (id, size, source, cluster) give rows (id, n_chars, piece, n_pieces, size, bin, slot)."""
    items = items.sort_values(["size", "id"], ascending=[False, True], kind="stable")
    sources = {s: 1 << i for i, s in enumerate(sorted({s for s in items["source"] if s is not None and s == s}))}
    # Only clusters that occur twice in the shard can conflict.
    often = Counter(c for c in items["cluster"] if c is not None and c == c)
    clusters = {c: 1 << i for i, c in enumerate(sorted(c for c, n in often.items() if n > 1))}
    rows, rest = [], []
    opened = 0
    for i, size, source, cluster in zip(items["id"], items["size"], items["source"], items["cluster"]):
        full, left = divmod(int(size), capacity)
        if full and not left:
            full, left = full - 1, capacity
        pieces = full + 1
        for p in range(full):
            rows.append((i, size, p, pieces, capacity, opened, 0))
            opened += 1
        rest.append((left, i, size, pieces, sources.get(source, 0), clusters.get(cluster, 0)))
    rest.sort(key=lambda r: (-r[0], r[1]))
    bins, filled = Bins(capacity), Counter()
    for left, i, size, pieces, source, cluster in rest:
        b = bins.place(left, source, cluster, capacity)
        rows.append((i, size, pieces - 1, pieces, left, opened + b, filled[b]))
        filled[b] += 1
    return pd.DataFrame(rows, columns=["id", "n_chars", "piece", "n_pieces", "size", "bin", "slot"])


def _placed(docs: DataFrame, capacity: int, shard_rows: int) -> DataFrame:
    """PLACED rows and the digest for documents (id, size, source, cluster, digest); every row is packed, whatever it shares with others."""
    docs = docs.select(F.col("id").cast("long"), F.col("size").cast("int"), "source", F.col("cluster").cast("long"), "digest")
    shards = max(1, -(-docs.count() // shard_rows))

    def run(key: tuple, items: pd.DataFrame) -> pd.DataFrame:
        items = items.sort_values(["missing", "id", "digest", "source", "copy"], kind="stable").reset_index(drop=True)
        # Items go by their number in this order, as ids may be missing or repeated.
        packed = pack(items.assign(id=np.arange(len(items))), capacity).assign(shard=np.int32(key[0]))
        own = items.loc[packed["id"], ["id", "digest", "missing"]].reset_index(drop=True)
        out = packed.assign(id=own["id"], digest=own["digest"], missing=own["missing"])
        return out[["id", "n_chars", "piece", "n_pieces", "size", "shard", "bin", "slot", "digest", "missing"]]

    # Equal rows are counted and then numbered, which needs no sort of them.
    alike = docs.groupBy(*docs.columns).agg(F.count(F.lit(1)).alias("_n"))
    each = alike.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), "_n"))).drop("_n")
    dealt = each.withColumn("shard", F.pmod(F.xxhash64("id", "digest", "source", "copy"), F.lit(shards)).cast("int"))
    dealt = dealt.withColumns({"missing": F.col("id").isNull(), "id": F.coalesce("id", F.lit(0).cast("long"))})
    return dealt.groupBy("shard").applyInPandas(run, NAMED).withColumn("id", F.when(~F.col("missing"), F.col("id"))).drop("missing")


def best_fit(docs: DataFrame, capacity: int = CAPACITY, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """PLACED rows for documents (id, size, source, cluster, digest); (shard, bin) names a sequence, slot the order in it."""
    return _placed(docs, capacity, shard_rows).drop("digest")


def _digest() -> Column:
    return F.sha2(whole_text().cast("binary"), 256)


def sized(docs: DataFrame, id_column: str = "doc_id", *others: str) -> DataFrame:
    """Documents as packing items: characters, source, the hash of the text as the duplicate cluster, and the digest of the text."""
    cluster = F.when(F.length(whole_text()) > 0, F.xxhash64("text"))
    return docs.select(F.col(id_column).alias("id"), F.char_length(whole_text()).alias("size"), "source", cluster.alias("cluster"), _digest().alias("digest"), *others)


def packed_texts(docs: DataFrame, id_column: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """(shard, bin, slot, doc_id, piece, n_pieces, n_chars, text): the sequences with their texts, every character of every row once."""
    placed = _placed(sized(docs, id_column), capacity, SHARD_ROWS)
    # Rows of one id and text are alike here, so one text serves all their placements. Both sides have the same keys, so texts are dealt out once.
    own = {"_key": F.coalesce(F.col(id_column).cast("long"), F.lit(0)), "_none": F.col(id_column).isNull(), "_digest": _digest()}
    one = docs.select(*[c.alias(n) for n, c in own.items()], whole_text().alias("text")).groupBy(*own).agg(F.min("text").alias("text"))
    keyed = placed.withColumns({"_key": F.coalesce("id", F.lit(0)), "_none": F.col("id").isNull(), "_digest": F.col("digest")})
    found = keyed.join(one, list(own))
    return found.select("shard", "bin", "slot", F.col("id").alias("doc_id"), "piece", "n_pieces", F.col("size").alias("n_chars"), F.substring("text", F.col("piece") * capacity + 1, F.col("size")).alias("text"))


def near_clusters(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """(_key, cluster): the near-duplicate component of every document with words, by its id or, without one, by the hash of its text.

    Rows that repeat an id count as linked, so that a conflict of any of them holds for the id.
    """
    keyed = docs.select(_key(id_column).alias("id"), whole_text().alias("text"))
    found = similar_components(keyed, 5, 4, 5).where("n_shingles > 0")
    found = keep(found.groupBy("id").agg(F.array_sort(F.collect_set("component_id")).alias("all")), "clusters")
    links = found.where(F.size("all") > 1).select(F.col("all")[0].alias("b"), F.explode("all").alias("a")).where("a != b")
    out = found.select(F.col("id").alias("_key"), F.col("all")[0].alias("cluster"))
    if links.isEmpty():
        return out
    merged = components(links).select(F.col("id").alias("cluster"), F.col("component").alias("_merged"))
    return out.join(merged, "cluster", "left").select("_key", F.coalesce("_merged", "cluster").alias("cluster"))


def _key(id_column: str) -> Column:
    return F.coalesce(F.col(id_column).cast("long"), F.xxhash64(whole_text()))


def near_sized(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Documents as packing items whose clusters hold near copies too (similarity 0.8 or more on five-word shingles)."""
    items = sized(docs.withColumn("_key", _key(id_column)), id_column, "_key").drop("cluster")
    return items.join(near_clusters(docs, id_column), "_key", "left").drop("_key")


@query()
def op9_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    placed = best_fit(keep(near_sized(table(spark, folder, "documents")), "items"))
    return placed.withColumnRenamed("id", "doc_id")
