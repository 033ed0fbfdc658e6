"""Cost-balanced packing of token ids into fixed sequences.

A document's tokens and an end id are cut where a sequence ends. Every full ``CAPACITY`` of them is a sequence of its own; what remains, less than one
sequence, is packed. The cost of a piece of n tokens is ``LINEAR * n + QUADRATIC * n * n`` (matrix products and attention within the document); a
sequence costs the sum of its pieces. Remainders go in descending order to the sequence of least cost that has room for all of their tokens; where none has,
to the one of least cost with any room, which takes what it can hold, and the rest is placed like another remainder. Room is looked up in a tree over the
remaining tokens (0 to ``CAPACITY``) that keeps the least cost of every range.

A shard opens as many sequences as its tokens fill, and for the tokens beyond the last full sequence one for each power of two in their number, so that
every sequence is filled to the end and none needs padding. Documents are dealt to shards by a hash of id and row, about ``shard_rows`` each, so the number
of shards follows the input and not their size: a shard holds at most ``shard_rows`` remainders of less than ``CAPACITY`` tokens, whatever the texts.

Ids are made once, in the task that reads the text: full sequences leave it as digests, remainders with their ids (two bytes each where the vocabulary
allows). Very long texts are encoded in parts cut before a blank between
two letters, where a pre-token always ends, so the ids are those of the whole text.

Defined results: a missing or empty text is the end id alone; rows without an id and rows that repeat one are packed each; equal costs go in order of id,
rows without one last, then of the row's place in the table; an empty table has no pieces; columns other than id and text play no part.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator
from functools import cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetloom.llm.common import keep, query, table, whole_text

CAPACITY = 1024
SHARD_ROWS = 8000
LINEAR, QUADRATIC = 2048.0, 1.0
PART_CHARS, BATCH_CHARS = 200_000, 1_000_000
SEAM = re.compile(r"(?<=[^\W\d_])(?= [^\W\d_])")
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@cache
def _tokenizer(path: str):
    """One tokenizer a worker, on one thread, as Spark runs the tasks side by side."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def parts_of(text: str, size: int = PART_CHARS) -> list[str]:
    """The text in parts of ``size`` characters or a little more, cut only before a blank between two letters."""
    parts, at = [], 0
    while len(text) - at > size:
        seam = SEAM.search(text, at + size)
        if seam is None:
            break
        parts.append(text[at : seam.start()])
        at = seam.start()
    return [*parts, text[at:]]


def byte_ranks(tokenizer) -> dict[bytes, int] | None:
    """The pieces of a byte-level tokenizer as bytes with their ids, if ids follow the order of merges; else None.

    A byte is written as a printable character: as itself, or as the next one from 256 on.
    """
    model = json.loads(tokenizer.to_str())["model"]
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model.get("merges", ())]
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    ids = [model["vocab"][a + b] for a, b in merges]
    special = {t.content for t in tokenizer.get_added_tokens_decoder().values()}
    pieces = {w: i for w, i in model["vocab"].items() if w not in special}
    if ids != sorted(ids) or not all(c in byte_of for w in pieces for c in w):
        return None
    return {bytes(byte_of[c] for c in w): i for w, i in pieces.items()}


class Encoder:
    """Texts to ids by a tokenizer file, an end id behind each.

    Given the ``pattern`` that the tokenizer splits text by, pieces are merged by their ids with the rank encoder of tiktoken, three to four times faster than the
    tokenizers library and with its ids: where every piece is what its own bytes merge to, merging the lowest id is merging by the list of merges. Texts
    with a special token go to the library, as all do without a pattern.
    """

    def __init__(self, path: str, pattern: str | None, end_id: int):
        self.tokenizer = _tokenizer(path)
        self.kind = "<u4" if self.tokenizer.get_vocab_size() > 1 << 16 else "<u2"
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        ranks = byte_ranks(self.tokenizer) if pattern else None
        self.by_rank = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}) if ranks else None
        self.end = np.array([end_id], self.kind)

    def __call__(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text, made in groups of bounded size."""
        for group in _groups([(i, p) for i, t in enumerate(texts) for p in parts_of(t)]):
            by_text: dict[int, list[np.ndarray]] = {}
            for (i, _), ids in zip(group, self.encoded([p for _, p in group])):
                by_text.setdefault(i, []).append(ids)
            for parts in by_text.values():
                yield np.concatenate([*parts, self.end])

    def encoded(self, parts: list[str]) -> list[np.ndarray]:
        if self.by_rank is None or any(s in p for s in self.special for p in parts):
            return [np.array(e.ids, self.kind) for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]
        return [np.array(self.by_rank.encode_ordinary(p), self.kind) for p in parts]


def _groups(parts: list[tuple[int, str]]) -> Iterator[list[tuple[int, str]]]:
    """Parts of neighbouring texts with ``BATCH_CHARS`` characters together or, where one text has more, all parts of that text."""
    group, chars = [], 0
    for part in parts:
        if group and chars + len(part[1]) > BATCH_CHARS and group[-1][0] != part[0]:
            yield group
            group, chars = [], 0
        group.append(part)
        chars += len(part[1])
    if group:
        yield group


def digest(ids: np.ndarray) -> int:
    """The CRC-32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())


def cut(docs: DataFrame, path: str, pattern: str | None = None, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """Documents (id, text) as pieces: full sequences with a number of their own in ``filled``, remainders with their ids in ``rest``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, filled, row = TaskContext.get().partitionId() << 40, 0, 0
        encode = Encoder(path, pattern, end_id)
        for batch in batches:
            out = []
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for doc, ids in zip(batch.column("id").to_pylist(), encode(texts)):
                n = len(ids)
                for start in range(0, n - capacity + 1, capacity):
                    out.append((doc, start, capacity, digest(ids[start : start + capacity]), n, part + filled, None, None))
                    filled += 1
                if n % capacity:
                    rest = ids[n - n % capacity :]
                    out.append((doc, n - n % capacity, len(rest), None, n, None, part + row, rest.tobytes()))
                row += 1
            columns = list(zip(*out)) or [[]] * 8
            kinds = [pa.int64()] * 7 + [pa.binary()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "filled", "row", "rest"])

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, filled long, row long, rest binary"
    return docs.select(F.col("id").cast("long").alias("id"), "text").mapInArrow(run, schema)


class Sequences:
    """Open sequences by room. ``least[node]`` is the smallest (cost, number) of the sequences whose room lies in the node's range, or None."""

    def __init__(self, rooms: list[int], capacity: int, linear: float, quadratic: float):
        self.width = 1 << capacity.bit_length()
        self.least: list[tuple[float, int] | None] = [None] * (2 * self.width)
        self.by_room: dict[int, list[tuple[float, int]]] = {}
        self.room = list(rooms)
        self.linear, self.quadratic = linear, quadratic
        for number, room in enumerate(rooms):
            heappush(self.by_room.setdefault(room, []), (0.0, number))
        for room in self.by_room:
            self._refresh(room)

    def cost(self, n: int) -> float:
        return self.linear * n + self.quadratic * n * n

    def _refresh(self, room: int) -> None:
        own = self.by_room.get(room)
        node = room + self.width
        self.least[node] = own[0] if own else None
        while node > 1:
            node //= 2
            a, b = self.least[2 * node], self.least[2 * node + 1]
            self.least[node] = a if b is None or a is not None and a <= b else b

    def _cheapest(self, room: int) -> tuple[float, int] | None:
        """The sequence of least cost with ``room`` tokens left or more."""
        best, low, high = None, room + self.width, 2 * self.width
        while low < high:
            for node in ([low] if low & 1 else []) + ([high - 1] if high & 1 else []):
                if self.least[node] is not None and (best is None or self.least[node] < best):
                    best = self.least[node]
            low, high = (low + 1) // 2, high // 2
        return best

    def take(self, n: int) -> tuple[int, int]:
        """Place up to n tokens: (sequence, tokens it takes). All of them where one has room for all, in the cheapest such sequence."""
        found = self._cheapest(n) or self._cheapest(1)
        cost, number = found
        room = self.room[number]
        taken = min(n, room)
        heappop(self.by_room[room])
        self._refresh(room)
        self.room[number] = room - taken
        if room > taken:
            heappush(self.by_room.setdefault(room - taken, []), (cost + self.cost(taken), number))
            self._refresh(room - taken)
        return number, taken


def rooms_for(tokens: int, capacity: int = CAPACITY) -> list[int]:
    """Full sequences, and one for each power of two in what is left, the largest first."""
    full, left = divmod(tokens, capacity)
    return [capacity] * full + [1 << i for i in range(left.bit_length() - 1, -1, -1) if left >> i & 1]


def assign(lengths: list[int], capacity: int = CAPACITY, linear: float = LINEAR, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int, int]]:
    """Pack items of the given lengths, each at most ``capacity``: (item, start in the item, length, sequence, offset in the sequence)."""
    rooms = rooms_for(sum(lengths), capacity)
    open_ones = Sequences(rooms, capacity, linear, quadratic)
    # Descending by length is descending by cost. What a full sequence could not take waits for its turn among the shorter items.
    waiting = [(-n, i, 0) for i, n in enumerate(lengths) if n]
    waiting.sort(reverse=True)
    cut_off: list[tuple[int, int, int]] = []
    placed = []
    while waiting or cut_off:
        n, item, start = waiting.pop() if not cut_off or waiting and waiting[-1] <= cut_off[0] else heappop(cut_off)
        number, taken = open_ones.take(-n)
        placed.append((item, start, taken, number, rooms[number] - open_ones.room[number] - taken))
        if taken < -n:
            heappush(cut_off, (n + taken, item, start + taken))
    return placed


def packed(docs: DataFrame, path: str, pattern: str | None = None, capacity: int = CAPACITY, end_id: int = 0, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """PIECE rows for documents (id, text): every token and end id in exactly one piece of one sequence."""
    pieces = keep(cut(docs, path, pattern, capacity, end_id), "pieces")
    rests = pieces.where(F.col("filled").isNull())
    shards = max(1, -(-rests.count() // shard_rows))
    kind = Encoder(path, None, end_id).kind

    def run(key: tuple, rests: pa.Table) -> pa.Table:
        rests = rests.sort_by([("doc_id", "ascending"), ("row", "ascending")])
        docs, starts, totals = (rests.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens"))
        ids = [np.frombuffer(b, kind) for b in rests.column("rest").to_pylist()]
        rows = [(docs[i], starts[i] + a, n, digest(ids[i][a : a + n]), totals[i], ((key[0].as_py() << 32) + s) * 2 + 1, at) for i, a, n, s, at in assign(list(map(len, ids)), capacity)]
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
        return pa.table([pa.array(c, pa.int64()) for c in zip(*rows)], names=names)

    dealt = rests.select("doc_id", "start", "doc_tokens", "row", "rest", F.pmod(F.xxhash64("doc_id", "row"), F.lit(shards)).alias("shard"))
    shared = dealt.groupBy("shard").applyInArrow(run, PIECE)
    # Even numbers are full sequences of one document, odd ones those of the shards.
    alone = pieces.where(F.col("filled").isNotNull()).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("filled") * 2).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return alone.unionByName(shared)


@query()
def op12_balanced_packing(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), whole_text().alias("text"))
    return packed(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
