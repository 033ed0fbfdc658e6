"""CSV and TSV in and out, as all-text tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from sheetloom.functions.text import cell, text_view
from sheetloom.operators.grid import ROW_ID
from sheetloom.sources import splits
from sheetloom.sources.headers import csv_names

DELIMITERS = (",", ";", "\t", "|")


class LayoutError(ValueError):
    """Files of one table whose headers differ."""


@dataclass(frozen=True)
class Layout:
    """Delimiter and column names of a set of files that share a header."""

    delimiter: str
    names: tuple[str, ...]

    def widened(self, width: int) -> Layout:
        extra = [None] * (width - len(self.names))
        return Layout(self.delimiter, tuple(csv_names([*self.names, *extra])))


def _field_count(record: Column, delimiter: str) -> Column:
    """Fields of a raw record: delimiters outside quoted fields, plus one."""
    bare = F.when(F.contains(record, F.lit('"')), F.regexp_replace(record, splits.CLOSED, "")).otherwise(record)
    return F.length(bare) - F.length(F.replace(bare, F.lit(delimiter), F.lit(""))) + 1


@dataclass(frozen=True)
class Survey:
    """What all lines of a set of files say.

    ``layouts`` has one entry for each distinct header line, ``width`` is the most fields of any record, ``multi_line`` says whether quotes enclose
    line breaks. ``records`` (header, value, number) are the raw records in order of files, numbered from 0.
    """

    layouts: dict[str, Layout]
    width: int
    multi_line: bool
    records: DataFrame | None


def survey(spark: SparkSession, paths: str | Sequence[str], delimiter: str | None = None) -> Survey:
    """The header of every file, the delimiter, the width of all records and quoted line breaks, from one scan of all lines.

    One aggregate with a row for each split: its first filled line, how many it has, and for every possible delimiter the most fields and whether a record that
    starts there is still inside quotes at its end. Only distinct header lines come to the driver. The delimiter is the one that splits the header into
    at least two fields; if several do, another aggregate counts the lines that each splits like the header, and more fields win a tie.
    """
    splits.pin(spark)
    able = (delimiter,) if delimiter else DELIMITERS
    line_end, found = "\n", None
    for line_end in ("\n", "\r"):
        lines = splits.lines(spark, paths, line_end)
        found = _surveyed(splits.filled_lines(lines), able)
        headers = [r.header for r in found.groupBy("path").agg(F.min_by("header", "start").alias("header")).select("header").distinct().orderBy("header").collect()]
        # A file whose lines end with carriage returns alone is one line here.
        if not any("\r" in header for header in headers):
            break
    if not headers:
        return Survey({}, 0, False, None)
    chosen = delimiter or _delimiter(lines, headers)
    index = able.index(chosen)
    seen = found.agg(F.max(f"width{index}"), F.max(f"open{index}")).first()
    if seen[1]:
        return _broken_survey(spark, lines, chosen)
    return Survey(_layouts(spark, headers, chosen), seen[0], False, _whole_lines(splits.filled_lines(lines), found))


def _surveyed(filled: DataFrame, able: Sequence[str]) -> DataFrame:
    value, facts = F.col("value"), []
    for i, d in enumerate(able):
        facts += [F.max(_field_count(value, d)).alias(f"width{i}"), F.max(F.when(F.contains(value, F.lit('"')), splits.opens(value, d)).otherwise(False)).alias(f"open{i}")]
    # Numbers alone are counted in a hash table of a row a split; with a text among the results, every task would sort its lines.
    numbers = filled.groupBy("path", *splits.SPLIT).agg(F.count(F.lit(1)).alias("rows"), F.min("line").alias("first"), *facts)
    by_split = splits.stored(numbers, "survey-numbers")
    # The first lines are fetched by their numbers, one a split, as the records are placed below.
    places = by_split.select(*splits.SPLIT, F.col("first").alias("line"))
    heads = filled.join(F.broadcast(places), [*splits.SPLIT, "line"]).select(*splits.SPLIT, F.col("value").alias("header"))
    return splits.stored(by_split.join(heads, splits.SPLIT), "survey")


def _whole_lines(filled: DataFrame, found: DataFrame) -> DataFrame:
    """Records where every line is one: numbers follow from the line's number in its task and the rows of the splits before."""
    ordered = splits.in_order(found).join(found.select("path", "start", *[c for c in ("file", "first", "header")]), ["path", "start"])
    ordered = ordered.withColumns(
        {"header": F.first("header").over(Window.partitionBy("path").orderBy("start")), "shift": F.col("before") - F.col("rank") - F.col("first"), "skip": F.when(F.col("before") == F.col("file_first"), F.col("first"))}
    )
    # One row for each split, some 40 bytes and a header for every spark.sql.files.maxPartitionBytes of input.
    places = ordered.select(*splits.SPLIT, "header", "shift", "skip")
    placed = filled.join(F.broadcast(places), splits.SPLIT, "left").withColumn("number", splits.seen(F.col("shift")) + F.col("line"))
    return placed.where(~F.col("line").eqNullSafe(F.col("skip"))).select("header", "value", "number")


def _broken_survey(spark: SparkSession, lines: DataFrame, delimiter: str) -> Survey:
    """The survey where quotes enclose line breaks: records are put together first."""
    found = splits.records(lines, delimiter)
    heads = splits.stored(found.where("head").select("rank", F.col("value").alias("header")), "headers")
    width = found.agg(F.max(_field_count(F.col("value"), delimiter))).first()[0]
    headers = [r.header for r in heads.select("header").distinct().orderBy("header").collect()]
    body = found.where("not head").join(heads, "rank").select("header", "value", (F.col("number") - F.col("rank")).alias("number"))
    return Survey(_layouts(spark, headers, delimiter), width, True, body)


def _delimiter(lines: DataFrame, headers: Sequence[str]) -> str:
    spark = lines.sparkSession
    widths = [_field_count(F.col("value"), d).alias(f"n{i}") for i, d in enumerate(DELIMITERS)]
    of_headers = spark.createDataFrame([(h,) for h in headers], "value string").select(*widths).collect()
    able = [i for i in range(len(DELIMITERS)) if all(row[f"n{i}"] >= 2 for row in of_headers)]
    if len(able) < 2:
        return DELIMITERS[able[0]] if able else ","
    agreeing = [F.count_if(_field_count(F.col("value"), DELIMITERS[i]).isin(*{row[f"n{i}"] for row in of_headers})).alias(f"n{i}") for i in able]
    counted = lines.where(~F.col("blank")).agg(*agreeing).first()
    return DELIMITERS[max(able, key=lambda i: (counted[f"n{i}"], of_headers[0][f"n{i}"], -i))]


def _options(delimiter: str) -> dict[str, str]:
    return {"sep": delimiter, "escape": '"', "mode": "PERMISSIVE", "multiLine": "true", "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}


def _fields(record: Column, width: int, delimiter: str) -> Column:
    return F.from_csv(record, ", ".join(f"c{i} string" for i in range(width)), _options(delimiter))


def _layouts(spark: SparkSession, headers: Sequence[str], delimiter: str) -> dict[str, Layout]:
    """The layout of every distinct header line."""
    lines = spark.createDataFrame([(i, h.lstrip("\ufeff")) for i, h in enumerate(headers)], "i int, value string").coalesce(1)
    counted = lines.withColumn("n", _field_count(F.col("value"), delimiter))
    width = counted.agg(F.max("n")).first()[0]
    rows = counted.select("i", "n", _fields(F.col("value"), width, delimiter).alias("f")).collect()
    return {headers[row.i]: Layout(delimiter, tuple(csv_names([row.f[i] for i in range(row.n)]))) for row in rows}


def named_rows(found: Survey) -> DataFrame:
    """All records as text under the names of the widest layout, with their number as row id; empty fields, quoted or not, are NULL.

    Headers may name the same columns in other orders; short records are padded.
    """
    layouts = {h: layout.widened(max(found.width, len(layout.names))) for h, layout in found.layouts.items()}
    first = next(iter(layouts.values()))
    distinct = list(dict.fromkeys(layout.names for layout in layouts.values()))
    # All layouts have the width of the widest record, so one parser serves them; the header says which field a name stands for.
    parsed = found.records.select(F.col("number").alias(ROW_ID), "header", F.inline(F.array(_fields(F.col("value"), len(first.names), first.delimiter))))
    columns = []
    for name in first.names:
        by_place: dict[int, list[str]] = {}
        for header, layout in layouts.items():
            by_place.setdefault(layout.names.index(name), []).append(header)
        places = sorted(by_place, key=lambda at: -len(by_place[at]))
        value = F.col(f"c{places[0]}")
        for at in places[1:]:
            value = F.when(F.col("header").isin(by_place[at]), F.col(f"c{at}")).otherwise(value)
        columns.append(F.nullif(value, F.lit("")).alias(name))
    assert all(sorted(names) == sorted(first.names) for names in distinct)
    return parsed.select(ROW_ID, *columns)


def sniff(spark: SparkSession, paths: str | Sequence[str], delimiter: str | None = None) -> Layout:
    """Delimiter and header of files that share one header."""
    return _one(survey(spark, paths, delimiter))


def _one(found: Survey) -> Layout:
    names = list(dict.fromkeys(found.layouts.values()))
    if len(names) > 1:
        raise LayoutError(f"the files have {len(names)} different headers ({'; '.join(', '.join(layout.names) for layout in names[:5])})")
    return names[0] if names else Layout(",", ())


def read_delimited(spark: SparkSession, paths: str | Sequence[str], delimiter: str | None = None) -> DataFrame:
    """Delimited files with one header as a text table; short rows are padded, longer rows add columns, quoted line breaks are kept."""
    found = survey(spark, paths, delimiter)
    layout = _one(found)
    if not layout.names:
        return spark.createDataFrame([], "")
    return named_rows(found).drop(ROW_ID)


def write_delimited(df: DataFrame, path: str, delimiter: str = ",", mode: str = "error") -> None:
    """Header, then every row of the table; NULL is nothing, empty text is ``""``, quotes are doubled."""
    shown = text_view(df.select(*[cell(c) for c in df.columns if c != ROW_ID]))
    (
        shown.write.mode(mode)
        .options(header=True, sep=delimiter, escape='"', emptyValue='""')
        .options(ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
        .csv(path)
    )


def write_tsv(df: DataFrame, path: str, mode: str = "error") -> None:
    write_delimited(df, path, "\t", mode)
