"""Words, word hashes, intermediate tables and the query registry of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetloom.plans import files
from sheetloom.session import scratch_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
STEP = np.uint64(0x9E3779B97F4A7C15)


def query(sql: str | None = None):
    """Register a function under its own name, with its SQL twin where there is one."""

    def add(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLES[function.__name__] = sql
        return function

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: The 256 remainders of CRC-32, as a CTE of the SQL twins.
CRC_TABLE = """crc_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_prepend(i, range(8)), lambda x, k: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)) AS crc
)"""


def crc32_sql(text: str) -> str:
    """The unsigned CRC-32 of ASCII text in the SQL twins, next to ``crc_table``."""
    codes = f"list_transform(string_split({text}, ''), lambda c: ascii(c)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {codes}), lambda done, c: xor(done >> 8, crc[(xor(done, c) & 255) + 1])), 4294967295)"


def whole_text(column: str = "text") -> Column:
    """The text, a missing one as the empty text."""
    return F.coalesce(F.col(column), F.lit(""))


def words(text: Column) -> Column:
    """The words of a text in order: what stands between blanks, tabs and line ends."""
    plain = reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(" ")), "\t\n\x0b\x0c\r", text)
    return F.array_remove(F.split(plain, " ", -1), "")


def lower_ascii(text: Column) -> Column:
    """A-Z lower-cased and nothing else. Texts without other letters, recognised by their bytes, take the faster way."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def word_hashes(text: Column, lower: bool = True) -> Column:
    """The 64-bit hash of every word in order, A-Z lower-cased first if asked."""
    return F.transform(words(lower_ascii(text) if lower else text), lambda w: F.xxhash64(w))


def keep(df: DataFrame, purpose: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there and lost executors cost nothing."""
    path = scratch_dir(df.sparkSession, purpose)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(*tables: DataFrame) -> None:
    """Delete kept tables that no later result reads; what was made of them is written by then, so a lost executor needs them no more."""
    for df in tables:
        for file in df.inputFiles()[:1]:
            files.delete(df.sparkSession, file.rpartition("/")[0])


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def rolling(hashes: np.ndarray, k: int) -> np.ndarray:
    """The hash of every k words in a row; entry i covers words i to i + k - 1."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = hashes[:n].copy()
    for i in range(1, k):
        out *= STEP
        out += hashes[i : i + n]
    return mix(out)


def shingle_set(hashes: np.ndarray, k: int) -> np.ndarray:
    """The sorted distinct shingle hashes of one text; a text of fewer than k words is one shingle, one without words has none."""
    if len(hashes) == 0:
        return hashes
    return np.unique(rolling(hashes, min(k, len(hashes))))


def lists(batch: pa.RecordBatch, name: str) -> Iterator[np.ndarray]:
    """The rows of an array<long> column as unsigned integers, without copying."""
    column = batch.column(name)
    values, offsets = column.values.to_numpy(zero_copy_only=False).view(np.uint64), column.offsets.to_numpy()
    for a, b in zip(offsets[:-1], offsets[1:]):
        yield values[a:b]


PIECE = 1 << 20
BASE = 0xD6E8FEB86659FD93
_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: int, size: int) -> np.ndarray:
    """base ** 0, base ** 1 … modulo 2 ** 64, kept for the next piece."""
    if len(_powers.get(name, ())) < size:
        factors = np.full(size, base, np.uint64)
        factors[0] = 1
        _powers[name] = np.multiply.accumulate(factors)
    return _powers[name][:size]


def _word_hashes(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words in lower-cased bytes; no word reaches over a cut."""
    apart = (data == 32) | ((data >= 9) & (data <= 13))
    first, last = ~apart, ~apart
    new = np.zeros(len(data) + 1, bool)
    new[cuts] = True
    first[1:] &= apart[:-1] | new[1:-1]
    last[:-1] &= apart[1:] | new[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data + np.uint8(1)) * _power("up", BASE, len(data)), out=sums[1:])
    down = _power("down", pow(BASE, -1, 1 << 64), len(data))[starts]
    return starts, mix((sums[ends] - sums[starts]) * down + (ends - starts).astype(np.uint64) * STEP)


def word_lists(column: pa.Array) -> Iterator[np.ndarray]:
    """The 64-bit hashes of every text's words in order, see ``word_runs``."""
    for hashes, places in word_runs(column):
        for a, b in zip(places[:-1], places[1:]):
            yield hashes[a:b]


def word_runs(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The 64-bit hashes of the words of some texts in a row, A-Z lower-cased, and where each text begins and the last one ends among them.

    A hash is a polynomial of the word's bytes, all words of a piece of a megabyte at once. Pieces end between words and texts are taken a few megabytes
    at a time, so arrays stay small whatever the texts; a missing text has no words.
    """
    column = column.fill_null("").cast(pa.large_string())
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if offsets[-1] else np.empty(0, np.uint8)
    row = 0
    while row < len(column):
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + 4 * PIECE, "right")) - 1)
        yield _runs_of(data[offsets[row] : offsets[last]], offsets[row : last + 1] - offsets[row])
        row = last


def _runs_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts, hashes, at = [np.empty(0, np.int64)], [np.empty(0, np.uint64)], 0
    with np.errstate(over="ignore"):
        while at < len(data):
            end = min(at + PIECE, len(data))
            while end < len(data):  # on to the next blank or text
                ahead = data[end : end + PIECE]
                gap = np.flatnonzero((ahead == 32) | ((ahead >= 9) & (ahead <= 13)))[:1]
                text = int(offsets[np.searchsorted(offsets, end)])
                if len(gap) or text < end + len(ahead):
                    end = min(end + int(gap[0]) if len(gap) else text, text)
                    break
                end += len(ahead)
            piece = data[at:end]
            piece = np.where((piece >= 65) & (piece <= 90), piece | 32, piece)
            inside = offsets[np.searchsorted(offsets, at) : np.searchsorted(offsets, end, "right")] - at
            own, found = _word_hashes(piece, inside)
            starts.append(own + at)
            hashes.append(found)
            at = end
    return np.concatenate(hashes), np.searchsorted(np.concatenate(starts), offsets)


def shingle_sets(column: pa.Array, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The sets of ``shingle_set`` for some texts in a row, and where each text's set begins and the last one ends."""
    for hashes, places in word_runs(column):
        sizes = np.diff(places)
        bounds = np.concatenate(([0], np.cumsum(np.where(sizes >= k, sizes - k + 1, np.minimum(sizes, 1)))))
        found = np.empty(bounds[-1], np.uint64)
        with np.errstate(over="ignore"):
            inside = np.arange(len(hashes)) + k <= np.repeat(places[1:], sizes)
            found[np.repeat(sizes >= k, np.diff(bounds))] = rolling(hashes, k)[inside[: max(0, len(hashes) - k + 1)]]
            for i in np.flatnonzero((sizes > 0) & (sizes < k)):
                found[bounds[i]] = rolling(hashes[places[i] : places[i + 1]], sizes[i])[0]
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            found[a:b].sort()
        new = np.ones(len(found), bool)
        new[1:] = found[1:] != found[:-1]
        new[bounds[:-1][np.diff(bounds) > 0]] = True
        yield found[new], np.concatenate(([0], np.cumsum(new)))[bounds]


def signed(values) -> np.ndarray:
    return np.asarray(values, np.uint64).view(np.int64)
