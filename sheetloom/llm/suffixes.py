"""Suffix-array deduplication with sparse suffixes.

A suffix of a document, counted in words, is retained where its start is a minimiser: the place with the smallest hash of eight words among 25 places in
a row. Any passage of 50 words therefore holds a retained suffix within its first 25 words, at the same place in every copy.

1. The key of a suffix is the hash of its first 25 words. Only suffixes whose key occurs twice go on; keys are counted with pre-aggregation.
2. A window of 50 words belongs to the minimiser of its own first 25 places, which is the same in every copy of the window. The windows of one suffix are a
   block. Blocks are sorted by content, document and place into ranges that split even the copies of one block, and neighbours are compared: the first of
   equal blocks stands for all, the others are copies.
3. The windows of the blocks that stand first are sorted and compared in the same way, since blocks that differ may share some of their windows. A window
   that occurs twice is a repeated passage, its first occurrence in (document, place) the original and every other one a copy.

Every window of 50 words that occurs twice is found, whatever third texts share. The order of originals and copies is the same everywhere, so every
word of a copy has a first occurrence that is none.

Defined results: words are compared exactly as written, white space does not count; missing, empty and short texts have no passages; a text repeated within one
document counts as a repeat; rows without an id are left out. Rows that repeat an id are taken as the one with the smallest text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sheetloom.llm.common import STEP, WORD, keep, lists, mix, query, rolling, signed, table, whole_text, word_hashes

LEAST = 50
KEY = SPAN = 25
GRAM = 8
CONTEXT = 25
DEPTH = 3  # bytes of a word's hash in a context
SPANS = "id long, start int, stop int, other long, later int"
EDGE = "key long, after binary, before binary, id long, place int"
BLOCK = "hash long, id long, start int, stop int, windows binary"
HELD = f"{BLOCK}, other long, later int, origin long, part int, lead boolean, first boolean, last boolean"


def minimisers(hashes: np.ndarray) -> np.ndarray:
    """The retained places of one document, in order."""
    grams = rolling(hashes, GRAM)
    if len(hashes) < LEAST or len(grams) < SPAN:
        return np.empty(0, np.int64)
    view = np.lib.stride_tricks.sliding_window_view(grams, SPAN)
    places = np.unique(view.argmin(axis=1) + np.arange(len(view)))
    return places[places + KEY <= len(hashes)]


def suffixes(docs: DataFrame) -> DataFrame:
    """(key, id, place) of every retained suffix of documents (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys, places = batch.column("id").to_numpy(), [], []
            with np.errstate(over="ignore"):
                for h in lists(batch, "hashes"):
                    found = minimisers(h)
                    places.append(found)
                    keys.append(rolling(h, KEY)[found] if len(found) else np.empty(0, np.uint64))
            counts = [len(p) for p in places]
            if sum(counts):
                yield pa.record_batch([pa.array(signed(np.concatenate(keys))), pa.array(np.repeat(ids, counts)), pa.array(np.concatenate(places).astype(np.int32))], names=["key", "id", "place"])

    return docs.select("id", word_hashes(F.col("text"), lower=False).alias("hashes")).mapInArrow(run, "key long, id long, place int")


def _cut(hashes: np.ndarray, count: int) -> bytes:
    """The upper bytes of up to ``count`` hashes, filled up with a mark that differs from document to document's end only by chance."""
    own = (hashes[:count] >> np.uint64(64 - 8 * DEPTH)).astype(">u4").view(np.uint8).reshape(-1, 4)[:, 4 - DEPTH :]
    return own.tobytes()


def _contexts(docs: DataFrame) -> DataFrame:
    """Suffixes (id, places, hashes) with what follows their key and what precedes them, nearest word first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys, after, before, owner, places = batch.column("id").to_pylist(), [], [], [], [], []
            with np.errstate(over="ignore"):
                for i, h, own in zip(ids, lists(batch, "hashes"), batch.column("places").to_pylist()):
                    own = np.array(sorted(own), np.int64)
                    keys.append(rolling(h, KEY)[own])
                    owner.append(np.full(len(own), i, np.int64))
                    places.append(own)
                    for p in own:
                        after.append(_cut(h[p + KEY :], CONTEXT))
                        before.append(_cut(h[max(0, p - CONTEXT) : p][::-1], CONTEXT))
            if after:
                yield pa.record_batch([pa.array(signed(np.concatenate(keys))), pa.array(after, pa.binary()), pa.array(before, pa.binary()), pa.array(np.concatenate(owner)), pa.array(np.concatenate(places).astype(np.int32))], names=["key", "after", "before", "id", "place"])

    return docs.mapInArrow(run, EDGE)


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Contexts as rows of words, and how many words each has."""
    parts = column.to_pylist()
    width = CONTEXT * DEPTH
    flat = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in parts), np.uint8).reshape(len(parts), CONTEXT, DEPTH)
    return flat, np.array([len(p) // DEPTH for p in parts])


def _matches(rows: pa.Table) -> list[np.ndarray]:
    """The columns of SPANS for all neighbours of a sorted run of suffixes that share at least LEAST words."""
    key, ids, place = (rows.column(c).to_numpy() for c in ("key", "id", "place"))
    at = np.flatnonzero(key[1:] == key[:-1])  # of a shared key, whether or not enough more is shared
    if not len(at):
        return [np.empty(0, np.int64)] * 5
    reach = []
    for name in ("after", "before"):
        words, have = _matrix(rows.column(name).combine_chunks())
        same = (words[at] == words[at + 1]).all(axis=2) & (np.arange(CONTEXT) < np.minimum(have[at], have[at + 1])[:, None])
        reach.append(np.cumprod(same, axis=1).sum(axis=1))
    right, left = reach
    long = left + KEY + right >= LEAST
    at, right, left = at[long], right[long], left[long]
    if not len(at):
        return [np.empty(0, np.int64)] * 5
    a, b = at, at + 1
    # In a run of matching neighbours the first in (document, place) is the original; of each pair the one farther from it is the copy.
    fresh = np.ones(len(key), bool)
    fresh[b] = False
    run = np.cumsum(fresh) - 1
    order = np.lexsort((place, ids))
    rank = np.empty(len(key), np.int64)
    rank[order] = np.arange(len(key))
    original = order[np.minimum.reduceat(rank, np.flatnonzero(fresh))]
    later = original[run[a]] <= a
    sides = [(ids[x], place[x] - left, place[x] + KEY + right, ids[y], flag) for x, y, flag in ((a, b, ~later), (b, a, later))]
    return [np.concatenate(c) for c in zip(*sides)]


def _compare(ordered: DataFrame) -> DataFrame:
    """Spans of all neighbours within partitions, and the first and last suffix of each partition as edge rows.

    A run is held until it ends, so memory follows the longest run of one key in a partition.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, first, last, index = None, None, None, None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            rows = pa.Table.from_batches([batch])
            index = batch.column("part")[0].as_py()
            rows = rows.drop(["part"])
            first = rows.slice(0, 1) if first is None else first
            last = rows.slice(rows.num_rows - 1, 1)
            rows = rows if held is None else pa.concat_tables([held, rows])
            # Suffixes of the last key wait for the rest of their run.
            keys = rows.column("key").to_numpy()
            start = len(keys) - int(np.argmax((keys != keys[-1])[::-1])) if (keys != keys[-1]).any() else 0
            held = rows.slice(start)
            if start:
                yield from spans(rows.slice(0, start))
        if held is not None:
            yield from spans(held)
        if first is not None:
            for order, row in ((0, first), (1, last)):
                r = row.to_pylist()[0]
                yield pa.record_batch(
                    [pa.array([r["id"]], pa.int64()), pa.array([r["place"]], pa.int32()), pa.nulls(1, pa.int32()), pa.array([r["key"]], pa.int64()), pa.array([order], pa.int32()), pa.array([r["after"]], pa.binary()), pa.array([r["before"]], pa.binary()), pa.array([index], pa.int32())],
                    names=["id", "start", "stop", "other", "later", "after", "before", "part"],
                )

    def spans(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        i, start, stop, other, later = _matches(rows)
        n = len(i)
        if not n:
            return
        yield pa.record_batch(
            [pa.array(i), pa.array(start.astype(np.int32)), pa.array(stop.astype(np.int32)), pa.array(other), pa.array(later.astype(np.int32)), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int32())],
            names=["id", "start", "stop", "other", "later", "after", "before", "part"],
        )

    return ordered.mapInArrow(run, f"{SPANS}, after binary, before binary, part int")


def _across(edges: list) -> list[tuple]:
    """Spans between the last suffix of a partition and the first of the next: two rows per partition, whatever the data."""
    ends = sorted(edges, key=lambda r: (r.part, r.later))
    out = []
    for left, right in zip(ends, ends[1:]):
        if left.part != right.part:
            pair = pa.table({"key": [left.other, right.other], "after": pa.array([bytes(left.after), bytes(right.after)], pa.binary()), "before": pa.array([bytes(left.before), bytes(right.before)], pa.binary()), "id": [left.id, right.id], "place": [left.start, right.start]})
            out += [tuple(int(x) for x in row) for row in zip(*_matches(pair))]
    return out


def _wanted(docs: DataFrame) -> DataFrame:
    """(id, places, hashes): the word hashes of documents with suffixes whose key occurs twice, and the places of these."""
    docs = docs.where(F.col("id").isNotNull()).select("id", F.coalesce("text", F.lit("")).alias("text"))
    found = keep(suffixes(docs), "suffixes")
    repeated = found.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    wanted = found.join(repeated, "key", "left_semi").groupBy("id").agg(F.collect_set("place").alias("places"))
    one = docs.groupBy("id").agg(F.min("text").alias("text"))
    return one.join(wanted, "id").select("id", "places", word_hashes(F.col("text"), lower=False).alias("hashes"))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(id, start, stop, other, later): matches of at least 50 words between neighbouring suffixes, in words, not yet united.

    ``other`` is the document of the neighbour; ``later`` is 1 for the copy of the two. A third text between two copies can hide them
    from each other, so this comparison alone is not whole; ``repeated_windows`` is.
    """
    spark = docs.sparkSession
    # A place beyond the text belongs to another row of the same id.
    texts = _wanted(docs).withColumn("places", F.filter("places", lambda p: p + KEY <= F.size("hashes")))
    contexts = keep(_contexts(texts), "contexts")
    order = ["key", "after", "id", "place"]
    ordered = contexts.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    compared = keep(_compare(ordered), "matches")
    spans = compared.where(F.col("part").isNull()).select("id", "start", "stop", "other", "later")
    rest = _across(compared.where(F.col("part").isNotNull()).collect())
    return spans.unionByName(spark.createDataFrame(rest, SPANS)) if rest else spans


def block_columns(hashes: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The hashes of all windows that belong to ``places``, in order, and for every block where its windows begin there, its first word and its hash."""
    windows = rolling(hashes, LEAST)
    nothing = np.empty(0, np.int64)
    if not len(windows):
        return windows, nothing, nothing, np.empty(0, np.uint64)
    grams = np.lib.stride_tricks.sliding_window_view(rolling(hashes, GRAM), SPAN)
    offset = grams[: len(windows)].argmin(axis=1)
    place = offset + np.arange(len(windows))
    chosen = np.flatnonzero(np.isin(place, places))
    if not len(chosen):
        return windows[:0], nothing, nothing, np.empty(0, np.uint64)
    begin = np.flatnonzero(np.r_[True, place[chosen][1:] != place[chosen][:-1]])
    parts = mix(windows[chosen] + STEP * (offset[chosen] + 1).astype(np.uint64))
    return windows[chosen], begin, chosen[begin], mix(np.add.reduceat(parts, begin))


def _blocks(texts: DataFrame) -> DataFrame:
    """BLOCK rows of documents (id, places, hashes): the words from ``start`` to ``stop`` and the hashes of the windows between them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, start, stop, key, parts = [], [], [], [], []
            with np.errstate(over="ignore"):
                for i, h, own in zip(batch.column("id").to_pylist(), lists(batch, "hashes"), batch.column("places").to_pylist()):
                    windows, begin, first, hashed = block_columns(h, np.array(own, np.int64))
                    ends = np.r_[begin[1:], len(windows)]
                    owner.append(np.full(len(begin), i, np.int64))
                    start.append(first)
                    stop.append(first + ends - begin + LEAST - 1)
                    key.append(hashed)
                    parts += [windows[a:b].tobytes() for a, b in zip(begin, ends)]
            if parts:
                yield pa.record_batch(
                    [pa.array(signed(np.concatenate(key))), pa.array(np.concatenate(owner)), pa.array(np.concatenate(start).astype(np.int32)), pa.array(np.concatenate(stop).astype(np.int32)), pa.array(parts, pa.binary())],
                    names=["hash", "id", "start", "stop", "windows"],
                )

    return texts.mapInArrow(run, BLOCK)


def _windows(blocks: DataFrame) -> DataFrame:
    """BLOCK rows of the single windows of blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = batch.column("windows").to_pylist()
            counts = np.array([len(p) // 8 for p in parts], np.int64)
            if not counts.sum():
                continue
            within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            start = np.repeat(batch.column("start").to_numpy(), counts) + within
            yield pa.record_batch(
                [pa.array(np.frombuffer(b"".join(parts), np.int64)), pa.array(np.repeat(batch.column("id").to_numpy(), counts)), pa.array(start.astype(np.int32)), pa.array((start + LEAST).astype(np.int32)), pa.nulls(len(start), pa.binary())],
                names=["hash", "id", "start", "stop", "windows"],
            )

    return blocks.mapInArrow(run, BLOCK)


def _holders(rows: DataFrame, purpose: str) -> DataFrame:
    """BLOCK rows with ``other`` and ``later``: of rows with one hash the first in (id, start) is the original and has the second one's document
    as ``other``, or none if it is alone; all others are copies and have the original's. One row is held at a time, whatever the length of a run.
    """
    order = ["hash", "id", "start"]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, origin, runs, begun, emitted = None, 0, 0, True, False
        for batch in batches:
            if batch.num_rows == 0:
                continue
            rows = pa.Table.from_batches([batch] if held is None else [held, batch]).combine_chunks()
            out, state = marked(rows, origin, runs, begun, emitted, False)
            if out is not None:
                emitted = True
                yield out
            held = rows.slice(rows.num_rows - 1).to_batches()[0]
            origin, runs, begun = state
        if held is not None:
            yield marked(pa.Table.from_batches([held]), origin, runs, begun, emitted, True)[0]

    def marked(rows: pa.Table, origin: int, runs: int, begun: bool, emitted: bool, end: bool):
        key, ids = rows.column("hash").to_numpy(), rows.column("id").to_numpy()
        same = key[1:] == key[:-1]
        new = np.r_[begun, ~same]
        at = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
        origins = np.where(at >= 0, ids[at], origin)
        number = runs + np.cumsum(new)
        state = (int(origins[-1]), int(number[-1] - new[-1]), bool(new[-1]))
        n = len(key) if end else len(key) - 1
        if not n:
            return None, state
        follows, after = np.r_[same, False], np.r_[ids[1:], 0]
        other = pa.array(np.where(new, after, origins)[:n], mask=(new & ~follows)[:n])
        rows = rows.slice(0, n).combine_chunks()
        columns = {c: rows.column(c) for c in ("hash", "id", "start", "stop")}
        windows = rows.column("windows").to_pylist()
        first, last = np.zeros(n, bool), np.zeros(n, bool)
        first[0], last[-1] = not emitted, end
        columns |= {"windows": pa.array([w if f else None for w, f in zip(windows, new[:n])], pa.binary()), "other": other, "later": pa.array((~new[:n]).astype(np.int32)), "origin": pa.array(origins[:n])}
        columns |= {"part": rows.column("part"), "lead": pa.array(number[:n] == 1), "first": pa.array(first), "last": pa.array(last)}
        return pa.Table.from_pydict(columns).combine_chunks().to_batches()[0], state

    held = keep(ordered.mapInArrow(run, HELD), purpose)
    ends = held.where(F.col("first") | F.col("last")).select("hash", "id", "part", "later", "origin", "first", "last").collect()
    fixes = _continued(ends)
    out = held.select("hash", "id", "start", "stop", "windows", "other", "later", "part", "lead", "last")
    if fixes:
        out = out.join(F.broadcast(held.sparkSession.createDataFrame(fixes, "part int, _origin long, _next long")), "part", "left")
        copy = F.col("lead") & F.col("_origin").isNotNull()
        partner = F.when(F.col("last") & F.col("_next").isNotNull(), F.col("_next")).otherwise(F.col("other"))
        out = out.withColumns({"other": F.when(copy, F.col("_origin")).otherwise(partner), "later": F.when(copy, F.lit(1)).otherwise(F.col("later"))})
    return out.select("hash", "id", "start", "stop", "windows", "other", "later")


def _continued(ends: list) -> list[tuple]:
    """(part, origin, next) from the first and last row of each partition: the original of a run that began in an earlier partition, and the document
    of the next partition's first row where the last row is an original whose copies begin there.
    """
    firsts, lasts = {r.part: r for r in ends if r.first}, {r.part: r for r in ends if r.last}
    origins: dict[int, int] = {}
    after: dict[int, int] = {}
    before = None
    for part in sorted(firsts):
        first, last = firsts[part], lasts[part]
        goes_on = before is not None and before[0] == first.hash
        if goes_on:
            origins[part] = before[1]
            if before[3]:
                after[before[2]] = first.id
        through = goes_on and last.hash == first.hash
        before = (last.hash, origins[part] if through else last.origin, part, not through and last.later == 0)
    return [(p, origins.get(p), after.get(p)) for p in sorted({*origins, *after})]


def repeated_windows(docs: DataFrame) -> DataFrame:
    """(id, start, stop, other, later): all passages of 50 words or more that occur twice, in words, not yet united.

    ``later`` is 1 where an earlier (document, place) holds the same words, which ``other`` names; otherwise ``other`` is a document that repeats them.
    """
    blocks = _holders(keep(_blocks(_wanted(docs)), "blocks"), "holders")
    windows = _holders(_windows(blocks.where("later = 0").select("id", "start", "windows")), "windows")
    return blocks.unionByName(windows).where(F.col("other").isNotNull()).select("id", "start", "stop", "other", "later")


def united(spans: DataFrame) -> DataFrame:
    """(id, start, stop, other, later): overlapping or touching spans of a document as one, with its smallest partner."""
    by = Window.partitionBy("id").orderBy("start", "stop")
    reach = F.max("stop").over(by.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.groupBy("id", "start", "stop").agg(F.min("other").alias("other"), F.max("later").alias("later"))
    marked = marked.withColumn("_new", F.coalesce((F.col("start") > reach).cast("int"), F.lit(1)))
    marked = marked.withColumn("_island", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    out = marked.groupBy("id", "_island").agg(F.min("start").alias("start"), F.max("stop").alias("stop"), F.min("other").alias("other"), F.max("later").alias("later"))
    return out.drop("_island")


def without_copies(docs: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Documents with the later copies of repeated passages cut from their texts; all rows and columns stay.

    A word is cut only if a smaller (document, place) holds the words around it, so its first occurrence stays.
    """
    spans = united(repeated_windows(docs.select(F.col(id_column).cast("long").alias("id"), "text")).where("later = 1"))
    cuts = spans.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("_cuts")).withColumnRenamed("id", "_id")
    names = docs.columns
    joined = docs.join(cuts, F.col(id_column).cast("long") == F.col("_id"), "left").select(*[f"`{n}`" for n in names], "_cuts")
    word = re.compile(WORD)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [_without(t, c, word) if c else t for t, c in zip(batch.column("text").to_pylist(), batch.column("_cuts").to_pylist())]
            columns = [pa.array(texts, pa.string()) if n == "text" else batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = ", ".join(f"`{n.replace('`', '``')}` {kind}" for n, kind in docs.dtypes)
    return joined.mapInArrow(run, schema)


def _without(text: str | None, cuts: list[dict], word: re.Pattern) -> str | None:
    if text is None:
        return None
    found = [m.span() for m in word.finditer(text)]
    out, at = [], 0
    for c in cuts:
        if c["start"] < len(found):
            out.append(text[at : found[c["start"]][0]])
            at = found[min(c["stop"], len(found)) - 1][1]
    return "".join([*out, text[at:]])


@query()
def op6_suffix_array_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select(F.col("doc_id").alias("id"), whole_text().alias("text"))
    out = united(repeated_windows(docs))
    return out.select(
        F.col("id").alias("doc_id"), F.col("start").alias("start_word"), F.col("stop").alias("end_word"), (F.col("stop") - F.col("start")).alias("n_words"), F.col("other").alias("partner_id"), F.col("later").alias("is_copy")
    )
