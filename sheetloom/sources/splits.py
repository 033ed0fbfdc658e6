"""Lines and records of text files by input split: numbers in file order, and quotes that enclose line breaks.

Files are read as lines, split by Spark wherever it likes. A record may go on over line ends inside quotes, so whether a line starts a record depends on all
lines before it in its file. A line maps the state before it (at a record's start, or inside quotes) to the state behind it; a split's map is the composition of
its lines' maps. One pass composes the maps of every split, a small job per file follows them from split to split, and then every split
knows its state and the number of its first record. What a split cannot finish leaves it as a fragment under the number of its record, and fragments of one
number are joined. No task reads more than its split, whatever is quoted.

Splits are recognised by file and offset, so all passes must cut files alike: ``pin`` fixes the one setting that follows the size of the cluster, and a
split that an earlier pass has not seen is an error.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from sheetloom.session import scratch_dir

#: A quoted field from its opening quote on, after the start of a line or a delimiter; possessive, so long fields need no stack.
CLOSED = '"(?:[^"]|"")*+"'
REST_OF_FIELD = '^(?:[^"]|"")*+"'
SPLIT = ["file", "start"]


def pin(spark: SparkSession) -> None:
    """Let the cut of files depend on their sizes and settings alone, not on the executors of the moment."""
    key = "spark.sql.files.minPartitionNum"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, str(spark.sparkContext.defaultParallelism))


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """Written to the shared folder and read back."""
    folder = scratch_dir(df.sparkSession, purpose)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def lines(spark: SparkSession, paths: str | Sequence[str], line_end: str = "\n") -> DataFrame:
    """(value, path, file, start, blank): all lines without their ends; (file, start) names the split."""
    raw = spark.read.option("lineSep", line_end).text(paths)
    placed = raw.select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"))
    return placed.select("value", "path", F.xxhash64("path").alias("file"), "start", (F.trim(without_return(F.col("value"))) == "").alias("blank"))


def without_return(value: Column) -> Column:
    """A record without the carriage return that belongs to its line end."""
    return F.when(value.endswith("\r"), F.left(value, F.char_length(value) - 1)).otherwise(value)


def filled_lines(all_lines: DataFrame) -> DataFrame:
    """Lines that are not blank, numbered in order within a task."""
    return all_lines.where(~F.col("blank")).drop("blank").withColumns({"value": without_return(F.col("value")), "line": F.monotonically_increasing_id()})


def opens(value: Column, delimiter: str) -> Column:
    """Whether a line that starts a record ends inside quotes."""
    quoted = "\\Q" + delimiter + "\\E"
    left = F.regexp_replace(value, f"(^|{quoted}){CLOSED}", "$1_")
    return F.contains(value, F.lit('"')) & left.rlike(f'(?:^|{quoted})"')


def stays_open(value: Column, delimiter: str) -> Column:
    """Whether a line that starts inside quotes ends inside quotes."""
    closed = value.rlike(REST_OF_FIELD)
    return ~F.contains(value, F.lit('"')) | ~closed | opens(F.regexp_replace(value, REST_OF_FIELD, "_"), delimiter)


def in_order(splits: DataFrame) -> DataFrame:
    """Splits (path, start, rows) with the rows before them and their file's rank among files with rows; one row for each split."""
    order = Window.orderBy("path", "start")
    before = F.coalesce(F.sum("rows").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = splits.where("rows > 0").select("path", "start", before.alias("before"), F.dense_rank().over(Window.orderBy("path")).alias("rank"))
    return ranked.select("*", F.min("before").over(Window.partitionBy("path")).alias("file_first"))


def states(before: bool, opened: np.ndarray, stays: np.ndarray) -> np.ndarray:
    """The state behind every line (inside quotes or not), from the state before the first and the lines' maps."""
    n = len(opened)
    fixed = np.maximum.accumulate(np.where(opened == stays, np.arange(n), -1))
    swaps = np.cumsum(opened & ~stays)
    since = swaps - np.where(fixed >= 0, swaps[fixed], 0)
    start = np.where(fixed >= 0, opened[fixed], before)
    return start ^ (since % 2 == 1)


def _flagged(all_lines: DataFrame, delimiter: str) -> DataFrame:
    return all_lines.withColumns({"opened": opens(F.col("value"), delimiter), "stays": stays_open(F.col("value"), delimiter)})


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, int, int, int]]:
    """(file, start, from, to): neighbouring lines of one split."""
    file, start = batch.column("file").to_numpy(), batch.column("start").to_numpy()
    if not len(file):
        return
    cuts = np.flatnonzero((np.diff(file) != 0) | (np.diff(start) != 0)) + 1
    for a, b in zip([0, *cuts], [*cuts, len(file)]):
        yield int(file[a]), int(start[a]), int(a), int(b)


def _flags(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [batch.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("opened", "stays", "blank")]


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For both states before a split: the state behind it and the records that start in it."""
    done: list[list] = []
    for batch in batches:
        opened, stays, blank = _flags(batch)
        for file, start, a, b in _runs(batch):
            if not done or done[-1][:2] != [file, start]:
                done.append([file, start, False, 0, True, 0])
            own = done[-1]
            for at in (2, 4):
                after = states(own[at], opened[a:b], stays[a:b])
                before = np.concatenate([[own[at]], after[:-1]])
                own[at], own[at + 1] = bool(after[-1]), own[at + 1] + int((~before & ~blank[a:b]).sum())
    columns = list(zip(*done)) or [[]] * 6
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.bool_(), pa.int64()]
    yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=["file", "start", "after_start", "rows_start", "after_quotes", "rows_quotes"])


def _followed(splits: pd.DataFrame) -> pd.DataFrame:
    """The state before each split of one file, and the records that start in it."""
    splits = splits.sort_values("start")
    inside, states_, rows = False, [], []
    for s in splits.itertuples():
        states_.append(inside)
        rows.append(s.rows_quotes if inside else s.rows_start)
        inside = s.after_quotes if inside else s.after_start
    return pd.DataFrame({"file": splits["file"], "start": splits["start"], "inside": states_, "rows": rows})


def _assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records (number, rank, head, start, whole, value); those that a split begins or ends with may be fragments."""
    split, inside, number, rank, first = None, False, 0, 0, 0
    held: list[str] = []
    held_number, whole = 0, True
    names = ["number", "rank", "head", "start", "whole", "value"]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.bool_(), pa.string()]
        return pa.record_batch([pa.array(c, k) for c, k in zip(list(zip(*rows)) or [[]] * 6, kinds)], names=names)

    for batch in batches:
        opened, stays, blank = _flags(batch)
        values, rows = batch.column("value"), []
        for file, start, a, b in _runs(batch):
            if split != (file, start):
                if inside:
                    rows.append((held_number, rank, held_number == first, split[1], False, "\n".join(held)))
                split, inside = (file, start), batch.column("inside")[a].as_py()
                number, rank, first = (batch.column(c)[a].as_py() for c in ("before", "rank", "file_first"))
                held, held_number, whole = [], number - 1, False
            after = states(inside, opened[a:b], stays[a:b])
            before = np.concatenate([[inside], after[:-1]])
            begins = ~before & ~blank[a:b]
            numbers = number + np.cumsum(begins) - 1
            alone = np.flatnonzero(begins & ~after)
            if len(alone):
                n = len(alone)
                own = numbers[alone]
                yield pa.record_batch([pa.array(own), pa.array(np.full(n, rank, np.int32)), pa.array(own == first), pa.array(np.full(n, start)), pa.array(np.ones(n, bool)), values.take(pa.array(alone + a))], names=names)
            for i in np.flatnonzero(before | begins & after):
                value = values[int(i) + a].as_py()
                if begins[i]:
                    held, held_number, whole = [value], int(numbers[i]), True
                else:
                    held.append(value)
                    if not after[i]:
                        rows.append((held_number, rank, held_number == first, start, whole, "\n".join(held)))
            inside, number = bool(after[-1]), number + int(begins.sum())
        yield batch_of(rows)
    if inside:
        yield batch_of([(held_number, rank, held_number == first, split[1], False, "\n".join(held))])


def records(all_lines: DataFrame, delimiter: str) -> DataFrame:
    """(number, rank, head, value): the records of all files, numbered from 0 in order of files; ``head`` marks the first of a file."""
    flagged = _flagged(all_lines, delimiter)
    narrow = flagged.select(*SPLIT, "opened", "stays", "blank")
    summaries = stored(narrow.mapInArrow(_summaries, "file long, start long, after_start boolean, rows_start long, after_quotes boolean, rows_quotes long"), "split-states")
    followed = summaries.groupBy("file").applyInPandas(_followed, "file long, start long, inside boolean, rows long")
    paths = all_lines.select("file", "path").distinct()
    followed = stored(followed.join(paths, "file"), "split-starts")
    numbered = in_order(followed)
    # Splits within one record start none and so have no place of their own; the record's number is that of the last one started before them.
    order = Window.orderBy("path", "start")
    all_splits = followed.select("*", F.coalesce(F.sum("rows").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    of_file = numbered.groupBy("path").agg(F.first("rank").alias("rank"), F.first("file_first").alias("file_first"))
    places = all_splits.join(of_file, "path").select(*SPLIT, "inside", "before", "rank", "file_first")
    # One short row for each split, some 40 bytes for every spark.sql.files.maxPartitionBytes of input.
    located = flagged.drop("path").join(F.broadcast(places), SPLIT, "left")
    located = located.withColumn("before", seen(F.col("before")))
    found = stored(located.mapInArrow(_assembled, "number long, rank int, head boolean, start long, whole boolean, value string"), "records")
    kept = ["number", "rank", "head"]
    pieces = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "value"))), lambda p: p["value"]), "\n")
    joined = found.where("not whole").groupBy(*kept).agg(pieces.alias("value"))
    # A quote that is never closed takes the rest of its file.
    joined = joined.withColumn("value", F.when(opens(F.col("value"), delimiter), F.concat("value", F.lit('"'))).otherwise(F.col("value")))
    return found.where("whole").unionByName(joined, allowMissingColumns=True).select(*kept, without_return(F.col("value")).alias("value"))


def seen(value: Column) -> Column:
    return F.when(value.isNull(), F.raise_error(F.lit("the files or their splits have changed since they were surveyed")).cast("long")).otherwise(value)
