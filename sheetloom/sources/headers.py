"""Column names and header rows of files without a schema."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from sheetloom.functions.text import blank

# How far to look for a header, the weights of its signs, and the name of a nameless column.
SCAN_ROWS = 20
PER_CELL, PER_WORD, NEXT_ROW, PER_SHARED_COLUMN, AFTER_TITLE, SIMILAR_WIDTH, LEAST_SCORE = 10, 3, 25, 2, 6, 8, 30
NAMELESS = "coluna"


def unique_names(raw: Sequence[str | None], nameless=lambda index: NAMELESS, first_suffix: int = 2) -> list[str]:
    """Trimmed names, blanks named, repeats numbered. Names that differ only in case count as repeats, as Spark needs."""
    names: list[str] = []
    taken: set[str] = set()
    for index, name in enumerate(raw):
        base = (name or "").strip() or nameless(index)
        candidate, suffix = base, first_suffix
        while candidate.lower() in taken:
            candidate, suffix = f"{base}_{suffix}", suffix + 1
        taken.add(candidate.lower())
        names.append(candidate)
    return names


def csv_names(raw: Sequence[str | None]) -> list[str]:
    """Names of delimited files: nameless columns are ``column<position>`` and repeats start at ``_1``."""
    return unique_names(raw, lambda index: f"column{index}", 1)


def column_letters(index: int) -> str:
    """Spreadsheet letters of a 0-based column."""
    letters, rest = "", index + 1
    while rest:
        rest, digit = divmod(rest - 1, 26)
        letters = chr(ord("A") + digit) + letters
    return letters


def header_range(header_row: int, column_count: int) -> str:
    """The cell range a table with this header occupies, open at the bottom."""
    if column_count <= 0:
        raise ValueError("the header row has no columns")
    return f"A{header_row}:{column_letters(column_count - 1)}"


def detect_headers(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Most likely header row of every sheet, from its first rows.

    ``cells`` holds ``(*keys, row_number, column_index, value)``. At most ``SCAN_ROWS`` rows per sheet enter the windows, so
    they stay small however many sheets there are. A sheet without a recognisable header gives no row.
    """
    keys = list(keys)
    sheet_order = Window.partitionBy(*keys).orderBy("row_number")
    rows = (
        cells.where(F.col("row_number").between(1, SCAN_ROWS))
        .groupBy(*keys, "row_number")
        .agg(
            F.sort_array(F.collect_set(F.when(~blank(F.col("value")), F.col("column_index")))).alias("filled"),
            F.count_if(F.col("value").rlike(r"\p{IsAlphabetic}")).alias("words"),
        )
        .withColumn("n", F.size("filled"))
        .withColumn("order", F.row_number().over(sheet_order))
    )
    single = F.when(F.col("n") == 1, 1).otherwise(0)
    nothing = F.array().cast("array<int>")
    seen = rows.select(
        "*",
        F.coalesce(F.lead("filled").over(sheet_order), nothing).alias("next_filled"),
        F.coalesce(F.lag("n").over(sheet_order), F.lit(0)).alias("before"),
        F.coalesce(F.lead(single).over(sheet_order), F.lit(0)).alias("single_1"),
        F.coalesce(F.lead("words").over(sheet_order), F.lit(0)).alias("next_words"),
        F.coalesce(F.lead(single, 2).over(sheet_order), F.lit(0)).alias("single_2"),
        F.coalesce(F.lead(single, 3).over(sheet_order), F.lit(0)).alias("single_3"),
        F.count("*").over(Window.partitionBy(*keys)).alias("rows_scanned"),
    )
    next_n = F.size("next_filled")
    shared = F.size(F.array_intersect("filled", "next_filled"))
    score = (
        F.col("n") * PER_CELL
        + F.col("words") * PER_WORD
        + F.when(next_n >= 2, NEXT_ROW + shared * PER_SHARED_COLUMN).otherwise(0)
        + F.when(F.col("before") <= 1, AFTER_TITLE).otherwise(0)
        + F.when(F.abs(next_n - F.col("n")) <= 2, SIMILAR_WIDTH).otherwise(0)
    )
    is_title = (F.col("words") > 0) & (F.col("single_1") == 1) & (F.col("next_words") > 0) & (F.col("single_2") == 1)
    followers = F.col("single_1") + F.col("single_2") + F.col("single_3")
    starts_column = ~is_title & ((followers >= 2) | ((F.col("order") == 1) & (followers >= 1)))
    scored = seen.withColumn("score", F.when(F.col("n") >= 2, score))
    candidates = scored.where(((F.col("n") >= 2) & (F.col("score") >= LEAST_SCORE)) | ((F.col("n") == 1) & starts_column))
    # Any multi-column header beats every single-column one; then the score, then the earliest row.
    best = Window.partitionBy(*keys).orderBy((F.col("n") >= 2).desc(), F.col("score").desc_nulls_last(), "row_number")
    return (
        candidates.withColumn("rank", F.row_number().over(best))
        .where("rank = 1")
        .select(
            *keys,
            F.col("row_number").alias("header_row"),
            (F.array_max("filled") + 1).alias("column_count"),
            "rows_scanned",
            (F.col("n") == 1).alias("fallback_used"),
        )
    )
