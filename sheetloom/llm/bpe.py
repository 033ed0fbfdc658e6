"""Byte-level BPE encoding and decoding by ranked merges.

Text is cut into pre-tokens by the tokenizer's pattern, every distinct pre-token is merged once, and the results are put back in order.
There are two forms of the merge with equal results:

* ``fold_ids``: Spark higher-order functions fold the merges over the byte array of a word. The rank map is a literal hash table (buckets of byte
  keys and ranks) that the optimizer makes once. It suits word lists. A fold costs some 100 to 200 microseconds a word, and putting the ids of
  distinct words back into documents costs a shuffle of every occurrence, so over whole documents it exceeds the check tool's limits (README).
* ``encode``: the same merges in Arrow batches. A task keeps the ids of the distinct pre-tokens it has met, up to a fixed number; there is no shuffle.

Decoding concatenates the byte pieces of the ids.

Defined results: a missing text counts as empty, an empty text has no ids and decodes to nothing; pre-tokens of any length are merged in
O(n log n); repeated rows are encoded each; special tokens are never made.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetloom.llm.common import query, table, whole_text

KNOWN_WORDS = 400_000
BUCKETS = 1 << 14
NO_RANK = (1 << 31) - 1


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a rank file, read on the driver (a fixed vocabulary)."""
    with open(path, "rb") as lines:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}


def default_ranks() -> tuple[str, dict[bytes, int]]:
    import public_tokenizers

    return public_tokenizers.PATTERN, read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one pre-token: the pair of lowest rank is merged, the leftmost first, until no pair has a rank."""
    if word in ranks:
        return [ranks[word]]
    if len(word) > 64:
        return _merge_long(word, ranks)
    parts = [word[i : i + 1] for i in range(len(word))]
    pairs = [ranks.get(word[i : i + 2], NO_RANK) for i in range(len(word) - 1)]
    while pairs:
        lowest = min(pairs)
        if lowest == NO_RANK:
            break
        i = pairs.index(lowest)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pairs[i]
        if i:
            pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], NO_RANK)
        if i < len(pairs):
            pairs[i] = ranks.get(parts[i] + parts[i + 1], NO_RANK)
    return [ranks[p] for p in parts]


def _merge_long(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same with a queue of pairs and linked pieces: piece i starts at byte i and ends where ``ends[i]`` says."""
    n = len(word)
    ends, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    waiting = []

    def offer(i: int) -> None:
        if i >= 0 and ends[i] < n and (rank := ranks.get(word[i : ends[ends[i]]])) is not None:
            heapq.heappush(waiting, (rank, i, ends[ends[i]]))

    for i in range(n - 1):
        offer(i)
    while waiting:
        _, i, end = heapq.heappop(waiting)
        if not alive[i] or ends[i] >= n or ends[ends[i]] != end:
            continue
        gone = ends[i]
        alive[gone], ends[i] = False, end
        if end < n:
            before[end] = i
        offer(before[i])
        offer(i)
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : ends[i]]])
        i = ends[i]
    return out


class Known(dict):
    """The packed ids of the pre-tokens met so far; forgotten all at once when there are too many."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, word: str) -> bytes:
        if len(self) >= KNOWN_WORDS:
            self.clear()
        ids = np.array(merge(word.encode("utf-8"), self.ranks), "<u4").tobytes()
        self[word] = ids
        return ids


def encode(docs: DataFrame, pattern: str, ranks: dict[bytes, int]) -> DataFrame:
    """(id, ids binary, n_tokens, decoded binary) for documents (id, text): ids as little-endian unsigned 32-bit integers."""
    sent = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, split = Known(sent.value), regex.compile(pattern)
        pieces = {rank: piece for piece, rank in sent.value.items()}
        for batch in batches:
            ids = [b"".join(map(known.__getitem__, split.findall(text or ""))) for text in batch.column("text").to_pylist()]
            decoded = [b"".join(map(pieces.__getitem__, np.frombuffer(i, "<u4").tolist())) for i in ids]
            yield pa.record_batch([batch.column("id"), pa.array(ids, pa.binary()), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(decoded, pa.binary())], names=["id", "ids", "n_tokens", "decoded"])

    kind = dict(docs.dtypes)["id"]
    return docs.select("id", "text").mapInArrow(run, f"id {kind}, ids binary, n_tokens long, decoded binary")


def digests(docs: DataFrame, pattern: str, ranks: dict[bytes, int]) -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): as ``encode``, with digests made where the bytes are."""
    sent = docs.sparkSession.sparkContext.broadcast(ranks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, split = Known(sent.value), regex.compile(pattern)
        pieces = {rank: piece for piece, rank in sent.value.items()}
        for batch in batches:
            counts, of_ids, of_text = [], [], []
            for text in batch.column("text"):
                ids = b"".join(map(known.__getitem__, split.findall(text.as_py() or "")))
                counts.append(len(ids) // 4)
                of_ids.append(hashlib.sha256(ids).hexdigest())
                of_text.append(hashlib.sha256(b"".join(map(pieces.__getitem__, np.frombuffer(ids, "<u4").tolist()))).hexdigest())
            yield pa.record_batch([batch.column("id"), pa.array(counts, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], names=["id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = dict(docs.dtypes)["id"]
    return docs.select("id", "text").mapInArrow(run, f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def rank_literal(spark: SparkSession, ranks: dict[bytes, int]) -> Column:
    """The rank map as one literal: buckets by the hash of the bytes, each with its keys and, after a filler, their ranks."""
    rows = spark.createDataFrame([(bytearray(k), v) for k, v in ranks.items()], "k binary, r int").select("k", "r", F.hash("k").bitwiseAND(F.lit(BUCKETS - 1)).alias("b"))
    buckets = [{"k": [], "r": [NO_RANK]} for _ in range(BUCKETS)]
    for row in rows.collect():
        buckets[row.b]["k"].append(base64.b64encode(bytes(row.k)).decode())
        buckets[row.b]["r"].append(row.r)
    return F.from_json(F.lit(json.dumps(buckets, separators=(",", ":"))), "array<struct<k:array<binary>,r:array<int>>>")


def fold_ids(word: Column, buckets: Column) -> Column:
    """The ids of a word, a binary column: a fold over its bytes merges the pair of lowest rank in each step.

    The state is the array of piece boundaries and the ranks of neighbouring pieces; a merge removes one boundary.
    """
    n = F.length(word)

    def folded(map_of: Column) -> Column:
        def rank(piece: Column) -> Column:
            bucket = F.get(map_of, F.hash(piece).bitwiseAND(F.lit(BUCKETS - 1)))
            return F.get(bucket["r"], F.array_position(bucket["k"], piece).cast("int"))

        def piece(bounds: Column, i: Column, j: Column) -> Column:
            return F.substring(word, F.get(bounds, i) + 1, F.get(bounds, j) - F.get(bounds, i))

        def step(state: Column, _: Column) -> Column:
            lowest = F.array_min(state["r"])

            def merged(p: Column) -> Column:
                def with_bounds(b: Column) -> Column:
                    new = F.transform(state["r"], lambda x, i: F.when(i == p, -1).when(i == p - 1, rank(piece(b, i, i + 2))).when(i == p + 1, rank(piece(b, p, p + 2))).otherwise(x))
                    return F.struct(b.alias("b"), F.array_remove(new, F.lit(-1)).alias("r"))

                return F.get(F.transform(F.array(F.array_remove(state["b"], F.get(state["b"], p + 1))), with_bounds), F.lit(0))

            done = lowest.isNull() | (lowest == NO_RANK)
            return F.when(done, state).otherwise(F.get(F.transform(F.array((F.array_position(state["r"], lowest) - 1).cast("int")), merged), F.lit(0)))

        pairs = F.when(n > 1, F.transform(F.sequence(F.lit(1), n - 1), lambda i: rank(F.substring(word, i, F.lit(2))))).otherwise(F.array().cast("array<int>"))
        start = F.struct(F.sequence(F.lit(0), n).alias("b"), pairs.alias("r"))
        ids = lambda s: F.transform(F.slice(s["b"], 2, n), lambda e, i: rank(piece(s["b"], i, i + 1)))
        return F.aggregate(F.sequence(F.lit(1), n), start, step, ids)

    filled = F.get(F.transform(F.array(buckets), folded), F.lit(0))
    return F.when(n > 0, filled).otherwise(F.array().cast("array<int>"))


def decode_column(ids: Column, pieces: Column) -> Column:
    """The bytes of an array of ids: the binary pieces (a literal array in order of ids) concatenated."""
    return F.aggregate(ids, F.lit(b""), lambda done, i: F.concat(done, F.get(pieces, i)))


@query()
def op7_byte_bpe(spark: SparkSession, folder: str) -> DataFrame:
    pattern, ranks = default_ranks()
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), whole_text().alias("text"))
    return digests(docs, pattern, ranks).withColumnRenamed("id", "doc_id")
