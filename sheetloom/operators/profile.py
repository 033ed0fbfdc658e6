"""Column profiles of all-text tables.

Statistics look at the trimmed text of filled cells. Profiles rest on a value table: every distinct value of every column with its frequency, counted natively
and only then turned into text and parsed, each value once. Counts, types, all statistics, histograms, top values and medians are weighted by frequency, so the
table itself is read once, whatever its size. Texts over ``SHORT`` characters go by length and digest; only those that are shown are fetched afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window, functions as F, types as T

from sheetloom.functions.dates import SERIAL_GAP, SERIAL_MAX, SERIAL_MIN, has_time_of_day, is_serial, parse_timestamp, serial_to_date
from sheetloom.functions.numbers import finite, parse_decimal, parse_double
from sheetloom.functions.text import as_text, bounded_key, cell, value_of
from sheetloom.operators import sums
from sheetloom.operators.medians import weighted_medians
from sheetloom.plans.fused import passes, union_all, unpack
from sheetloom.session import scratch_dir

# Words of the two boolean classes, labels, bucket and top-k sizes, share of serials that makes a date.
YES_WORDS = ("true", "1", "sim", "s", "yes", "y")
NO_WORDS = ("false", "0", "nao", "não", "n", "no")
LONGEST_WORD = 5
YES_LABEL, NO_LABEL = "Sim", "Nao"
TEXT_DATE_LABEL, SERIAL_DATE_LABEL = "Texto", "Serial de data do Excel"
BUCKETS = 12
TOP_VALUES = 10
SHORT, LEAD = 64, 16
SERIAL_SHARE = 0.90

PROFILE_SCHEMA = (
    "column string, physical_type string, inferred_type string, date_source string, "
    "total_count bigint, filled_count bigint, empty_count bigint, empty_percentage double, "
    "distinct_count bigint, duplicate_count bigint, "
    "text_stats struct<min_length:double, avg_length:double, max_length:double>, "
    "numeric_stats struct<min:double, max:double, avg:double, median:double, stddev:double>, "
    "date_stats struct<min:string, max:string, predominant_format:string, example_original:string, "
    "example_interpreted:string>, "
    "boolean_stats array<struct<label:string, count:bigint, percentage:double>>, "
    "top_values array<struct<value:string, count:bigint>>, "
    "distribution array<struct<bucket:int, min:double, max:double, count:bigint>>"
)


def filled_value(df: DataFrame, name: str) -> Column:
    """Trimmed text of a filled cell, NULL for a blank one."""
    return F.nullif(value_of(df, name), F.lit(""))


def filled_values(df: DataFrame, name: str) -> DataFrame:
    return df.select(filled_value(df, name).alias("value")).where(F.col("value").isNotNull())


def percentage(part: Column, total: Column) -> Column:
    return F.when(total == 0, F.lit(0.0)).otherwise(part * F.lit(100.0) / total)


def _families(df: DataFrame, columns: Sequence[str]) -> dict[str, list[int]]:
    """Column places by the type their values are counted in."""
    found: dict[str, list[int]] = {}
    for i, name in enumerate(columns):
        kind = df.schema[name].dataType
        if isinstance(kind, T.IntegralType):
            family = "bigint"
        elif isinstance(kind, (T.FloatType, T.DoubleType, T.TimestampType, T.TimestampNTZType, T.DateType, T.BooleanType)):
            family = kind.simpleString()
        else:
            family = "text"
        found.setdefault(family, []).append(i)
    return found


#: What is known of long texts, which are not kept.
LONG_FACTS = {"long_x": "double", "long_t": "timestamp_ntz", "long_plain": "boolean", "long_unsigned": "boolean", "long_clock": "boolean"}


def _is_plain(number: Column) -> Column:
    return ~number.contains(".") & ~number.contains(",")


def _is_unsigned(number: Column) -> Column:
    return ~number.startswith("-") & ~number.startswith("+")


def _digest(text: Column) -> Column:
    """SHA-256 in 44 characters."""
    return F.base64(F.unhex(F.sha2(text.cast("binary"), 256)))


def _counted(df: DataFrame, columns: Sequence[str], places: Sequence[int], family: str) -> DataFrame:
    """(column_index, value, digest, lead, size, LONG_FACTS, frequency) of the columns of one family; a blank is a value without text.

    Values are counted as they are. Long texts are counted by digest and length, with their first characters and, as they cannot be parsed later, what number or
    time they are.
    """
    if family != "text":
        kind = T.LongType() if family == "bigint" else df.schema[columns[places[0]]].dataType
        values = df.select(*[cell(columns[i]).cast(kind).alias(str(i)) for i in places])
        counts = values.unpivot([], [str(i) for i in places], "column_index", "key").groupBy("column_index", "key").agg(F.count(F.lit(1)).alias("frequency"))
        # The text is made in a step of its own, since an expression that long must not be repeated in the next.
        shown = counts.select(F.col("column_index").cast("int"), as_text(F.col("key"), kind).alias("value"), "frequency")
        return shown.select(
            "column_index", "value", F.lit(None).cast("string").alias("digest"), F.substring("value", 1, LEAD).alias("lead"), F.length("value").alias("size"),
            *[F.lit(None).cast(t).alias(n) for n, t in LONG_FACTS.items()], "frequency",
        )
    values = df.select(F.inline(F.array(*[F.struct(F.lit(i).alias("column_index"), value_of(df, columns[i]).alias("text")) for i in places])))
    text, long = F.col("text"), F.length("text") > SHORT
    # A number or a time starts with a blank, a sign, a mark or a digit, which prose seldom does.
    parsable = long & text.rlike(r"^[\s+\-.,0-9]")
    facts = [F.when(parsable, fact).alias(n) for n, fact in zip(LONG_FACTS, (parse_decimal(text), parse_timestamp(text), _is_plain(text), _is_unsigned(text), has_time_of_day(text)))]
    # A short text is a key by itself; what goes with a long one is one field, so that the many short keys stay small.
    known = F.when(long, F.struct(_digest(text).alias("digest"), F.substring(text, 1, LEAD).alias("lead"), F.length("text").alias("size"), *facts))
    keyed = values.select(F.col("column_index").cast("int"), F.when(~long & (text != ""), text).alias("value"), known.alias("known"))
    counts = keyed.groupBy("column_index", "value", "known").agg(F.count(F.lit(1)).alias("frequency"))
    return counts.select(
        "column_index", "value", "known.digest", F.coalesce("known.lead", F.substring("value", 1, LEAD)).alias("lead"), F.coalesce("known.size", F.length("value")).alias("size"),
        *[f"known.{n}" for n in LONG_FACTS], "frequency",
    )


def value_table(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Every distinct value of every column with its frequency and what it could be, one row each; blanks have no ``size``."""
    counted = union_all([_counted(df, columns, places, family) for family, places in _families(df, columns).items()])
    value, x = F.col("value"), F.col("x")
    numbers = counted.withColumn("x", F.coalesce(parse_decimal(value), "long_x"))
    whole = x.isNotNull() & F.coalesce(_is_plain(value), "long_plain")
    unsigned = whole & F.coalesce(_is_unsigned(value), "long_unsigned")
    in_serial_range = x.between(SERIAL_MIN, SERIAL_MAX) & (x != SERIAL_GAP)
    parsed = numbers.select(
        "column_index", "value", "digest", "lead", "size", "frequency", "x", "long_clock",
        F.when(F.col("size") <= LONGEST_WORD, F.lower(value)).alias("word"),
        F.coalesce(F.when(x.isNull(), parse_timestamp(value)), "long_t").alias("t"),
        F.coalesce(whole, F.lit(False)).alias("is_whole"),
        F.when(unsigned & in_serial_range, x.cast("bigint")).alias("serial"),
    )
    clock = F.col("t").isNotNull() & F.coalesce(has_time_of_day(value), "long_clock")
    return parsed.withColumn("clock", F.coalesce(clock, F.lit(False))).drop("long_clock")


def _stored_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    table, folder = value_table(df, columns), scratch_dir(df.sparkSession, "values")
    table.write.parquet(folder)
    return df.sparkSession.read.schema(table.schema).parquet(folder)


def cells(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(column_index, value)`` for every cell, NULL for blank ones.

    Statistics grouped by the index need one set of expressions whatever the number of columns, so the generated code stays
    small on wide tables, and their shuffle carries one partial row per column and task.
    """
    values = df.select(*[value_of(df, n).alias(str(i)) for i, n in enumerate(columns)])
    long = values.unpivot([], [str(i) for i in range(len(columns))], "column_index", "value")
    return long.select(F.col("column_index").cast("int"), F.when(F.col("value") != "", F.col("value")).alias("value"))


def _names(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.sparkSession.createDataFrame(list(enumerate(columns)), "column_index int, column string")


# --- counts, types, top values -------------------------------------------------------------------------------------


def profile_counts(df: DataFrame, columns: Sequence[str] | None = None, approximate: bool = False) -> DataFrame:
    """Row, filled, blank, distinct and duplicate counts per column; ``approximate`` trades the shuffle for a sketch."""
    columns = list(columns or df.columns)
    frames = []
    for part in passes(columns):
        values = df.select(*[filled_value(df, name).alias(str(i)) for i, name in enumerate(part)])
        indexes = range(len(part))
        aggregates = [F.count(F.lit(1)).alias("total")]
        aggregates += [F.count(str(i)).alias(f"filled_{i}") for i in indexes]
        if approximate:
            aggregates += [F.approx_count_distinct(str(i), 0.01).alias(f"distinct_{i}") for i in indexes]
        elif len(part) == 1:
            aggregates += [F.count_distinct(bounded_key(F.col("0"), SHORT)).alias("distinct_0")]
        counts = unpack(
            values.agg(*aggregates),
            [
                F.struct(
                    F.lit(i).alias("column_index"),
                    F.lit(name).alias("column"),
                    F.col("total").alias("total_count"),
                    F.col(f"filled_{i}").alias("filled_count"),
                    *([F.col(f"distinct_{i}").alias("distinct_count")] if approximate or len(part) == 1 else []),
                )
                for i, name in enumerate(part)
            ],
        )
        if "distinct_count" not in counts.columns:
            keys = cells(df, part).where("value IS NOT NULL").select("column_index", bounded_key(F.col("value"), SHORT).alias("key"))
            distinct = keys.distinct().groupBy("column_index").agg(F.count("*").alias("distinct_count"))
            counts = counts.join(distinct, "column_index", "left").fillna(0, ["distinct_count"])
        frames.append(counts)
    empty = F.col("total_count") - F.col("filled_count")
    return union_all(frames).select(
        "column",
        "total_count",
        "filled_count",
        empty.alias("empty_count"),
        percentage(empty, F.col("total_count")).alias("empty_percentage"),
        "distinct_count",
        F.greatest(F.lit(0), F.col("filled_count") - F.col("distinct_count")).alias("duplicate_count"),
    )


def _parsed(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Cells with their decimal number and timestamp, each NULL where the text has none."""
    value, x = F.col("value"), F.col("x")
    # Prose seldom starts like a number or a time, which spares the copies that parsing makes.
    numbers = cells(df, columns).withColumn("value", F.when(value.isNull() | value.rlike(r"^[\s+\-.,0-9]") | (F.length(value) <= LONGEST_WORD), value).otherwise("prose"))
    numbers = numbers.select("column_index", "value", F.length(value).alias("size"), parse_decimal(value).alias("x"))
    whole = x.isNotNull() & ~value.contains(".") & ~value.contains(",")
    unsigned = whole & ~value.startswith("-") & ~value.startswith("+")
    in_serial_range = x.between(SERIAL_MIN, SERIAL_MAX) & (x != SERIAL_GAP)
    return numbers.select(
        "*",
        F.when(F.col("size") <= LONGEST_WORD, F.lower(value)).alias("word"),
        F.when(x.isNull(), parse_timestamp(value)).alias("t"),
        F.coalesce(whole, F.lit(False)).alias("is_whole"),
        F.when(unsigned & in_serial_range, x.cast("bigint")).alias("serial"),
    )


def _type_aggregates() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("total"),
        F.count("value").alias("filled"),
        F.count_if(F.col("word").isin(*YES_WORDS)).alias("yes"),
        F.count_if(F.col("word").isin(*NO_WORDS)).alias("no"),
        F.count_if("is_whole").alias("integers"),
        F.count("x").alias("decimals"),
        F.count("t").alias("timestamps"),
        F.count_if(F.col("t").isNotNull() & has_time_of_day(F.col("value"))).alias("times"),
        F.count("serial").alias("serials"),
    ]


def _with_type(counts: DataFrame) -> DataFrame:
    """``inferred_type`` and ``date_source`` from the counts of one column per row."""
    filled = F.col("filled")
    boolean = F.col("yes") + F.col("no") == filled
    dated = F.col("timestamps") == filled
    timed = dated & (F.col("times") > 0)
    serial = F.col("serials") >= SERIAL_SHARE * filled
    kind = (
        F.when(filled == 0, "text")
        .when(boolean, "boolean")
        .when(timed, "datetime")
        .when(dated | serial, "date")
        .when(F.col("integers") == filled, "integer")
        .when(F.col("decimals") == filled, "decimal")
        .otherwise("text")
    )
    source = F.when(dated, "formatted").otherwise("excel_serial")
    return counts.withColumn("inferred_type", kind).withColumn("date_source", F.when(kind == "date", source))


def _native_counts(c: Column, kind: T.DataType) -> dict[str, Column] | None:
    """The type counts of a typed column without its text, by what the text of such a value always looks like; None for other types."""
    filled, none = F.count(c), F.lit(0).cast("bigint")
    counts = {"filled": filled, "yes": none, "no": none, "integers": none, "decimals": none, "timestamps": none, "times": none, "serials": none}
    if isinstance(kind, T.IntegralType):
        serial = F.count_if(c.between(SERIAL_MIN, SERIAL_MAX) & (c != SERIAL_GAP))
        return counts | {"yes": F.count_if(c == 1), "no": F.count_if(c == 0), "integers": filled, "decimals": filled, "serials": serial}
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        # From 1e-4 up to 1e16 a number is shown with a decimal point, beyond with an exponent.
        return counts | {"decimals": F.count_if((c == 0) | ((F.abs(c) >= 1e-4) & (F.abs(c) < 1e16)))}
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        shown = F.count_if(F.year(c).between(1, 9999))
        return counts | {"timestamps": shown, "times": none if isinstance(kind, T.DateType) else shown}
    return None


def infer_types(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Semantic type of every column. Dates count as dates when all filled cells parse.

    Numbers and times are counted as they are, all in one aggregate; only other columns are looked at as text.
    """
    columns = list(columns or df.columns)
    native = {c: n for c in columns if (n := _native_counts(cell(c), df.schema[c].dataType)) is not None}
    frames = []
    for part in passes(list(native)):
        row = df.agg(*[n.alias(f"{name}_{i}") for i, c in enumerate(part) for name, n in native[c].items()])
        structs = [F.struct(F.lit(c).alias("column"), *[F.col(f"{name}_{i}").alias(name) for name in native[c]]) for i, c in enumerate(part)]
        frames.append(_with_type(unpack(row, structs)).select("column", "inferred_type", "date_source"))
    for part in passes([c for c in columns if c not in native]):
        typed = _with_type(_parsed(df, part).groupBy("column_index").agg(*_type_aggregates()))
        named = _names(df, part).join(typed, "column_index", "left")
        frames.append(named.select("column", F.coalesce("inferred_type", F.lit("text")).alias("inferred_type"), "date_source"))
    return union_all(frames)


def top_values(df: DataFrame, column: str, k: int = TOP_VALUES) -> DataFrame:
    """Most frequent trimmed values, ties by value; each task keeps only its own ``k`` best.

    Values are counted by a bounded key with their first characters. Longer texts are fetched where they can be among the ``k``.
    """
    value = F.col("value")
    counted = filled_values(df, column).groupBy(bounded_key(value, SHORT).alias("key"), F.substring(value, 1, LEAD).alias("lead")).agg(F.count("*").alias("frequency"))
    best = [F.col("frequency").desc(), F.col("lead").asc()]
    kept = counted.orderBy(*best).limit(k).collect()
    if not kept:
        return counted.select(F.col("key").alias("value"), "frequency").limit(0)
    last = kept[-1]
    able = counted.where((F.col("frequency") > last.frequency) | ((F.col("frequency") == last.frequency) & (F.col("lead") <= last.lead)))
    size = F.substring_index("key", ":", 1).cast("int")
    short = able.where(size <= SHORT).select(F.expr("substring(key, locate(':', key) + 1)").alias("value"), "frequency")
    texts = filled_values(df, column).where(F.length("value") > SHORT).select("value", bounded_key(value, SHORT).alias("key"))
    long = texts.join(able.where(size > SHORT).select("key", "frequency"), "key").groupBy("key", "frequency").agg(F.min("value").alias("value"))
    return short.unionByName(long.select("value", "frequency")).orderBy(F.col("frequency").desc(), F.col("value").asc()).limit(k)


# --- statistics of one column --------------------------------------------------------------------------------------


def text_stats(df: DataFrame, column: str) -> DataFrame:
    size = F.length("value")
    return filled_values(df, column).agg(
        F.min(size).cast("double").alias("min_length"),
        F.avg(size).alias("avg_length"),
        F.max(size).cast("double").alias("max_length"),
    )


def _numbers(df: DataFrame, column: str) -> DataFrame:
    """One number per row, NULL where there is none. A filter here would be pushed down and repeat the parsing."""
    return df.select(value_of(df, column).alias("value")).select(parse_double(F.col("value")).alias("x"))


def numeric_stats(df: DataFrame, column: str, approximate_median: bool = False) -> DataFrame:
    """Min, max, mean, median and sample deviation, from the distinct numbers and their frequencies; sums are exact."""
    numbers = df.groupBy(cell(column).alias("key")).agg(F.count(F.lit(1)).alias("frequency"))
    numbers = numbers.select(F.lit(0).alias("column_index"), parse_double(value_of(numbers, "key")).alias("x"), "frequency")
    folder = scratch_dir(df.sparkSession, "values")
    numbers.write.parquet(folder)
    numbers = df.sparkSession.read.schema(numbers.schema).parquet(folder)
    by_power = sums.split(numbers).groupBy("p").agg(*sums.sums()).collect()
    n = sum(r.numbers or 0 for r in by_power)
    schema = "min double, max double, avg double, median double, stddev double"
    if not n:
        return df.sparkSession.createDataFrame([(None,) * 5], schema)
    mean, deviation = sums.mean_and_deviation(by_power)
    if approximate_median:
        median = df.select(parse_double(value_of(df, column)).alias("x")).agg(F.percentile_approx("x", 0.5, 10_000)).first()[0]
    else:
        median = weighted_medians(numbers, {0: n})[0]
    ends = numbers.agg(F.min("x"), F.max("x")).first()
    return df.sparkSession.createDataFrame([(ends[0], ends[1], mean, median, deviation)], schema)


def _bucket(x: Column, low: float | None, high: float | None) -> Column:
    if low is None or high is None or low == high:
        return F.lit(0)
    position = F.floor((x - F.lit(low)) / (F.lit(high) - F.lit(low)) * F.lit(BUCKETS))
    return F.least(F.lit(BUCKETS - 1), F.greatest(F.lit(0), position)).cast("int")


def _edges(bucket: int, low: float, high: float) -> tuple[float, float]:
    if abs(high - low) < 2.220446049250313e-16:
        return low, high
    width = (high - low) / BUCKETS
    return low + width * bucket, high if bucket + 1 >= BUCKETS else low + width * (bucket + 1)


def histogram(df: DataFrame, column: str) -> DataFrame:
    """Equal-width buckets between the smallest and largest finite number; empty buckets are absent."""
    numbers = _numbers(df, column).select(finite(F.col("x")).alias("x"))
    bounds = numbers.agg(F.min("x").alias("low"), F.max("x").alias("high")).first()
    bucket = F.when(F.col("x").isNotNull(), _bucket(F.col("x"), bounds.low, bounds.high))
    counted = numbers.groupBy(bucket.alias("bucket")).agg(F.count("x").alias("frequency")).where("frequency > 0")
    edges = [_edges(b, bounds.low, bounds.high) for b in range(BUCKETS)] if bounds.low is not None else [(None, None)]
    at = F.col("bucket") + 1
    return counted.select(
        "bucket",
        F.element_at(F.array(*[F.lit(e[0]) for e in edges]), at).alias("min"),
        F.element_at(F.array(*[F.lit(e[1]) for e in edges]), at).alias("max"),
        "frequency",
    )


def date_stats(df: DataFrame, column: str, date_source: str | None = "formatted") -> DataFrame:
    """First and last timestamp as ISO text; columns of dates are labelled, columns of datetimes are not."""
    stamps = filled_values(df, column).select(parse_timestamp(F.col("value")).alias("t"))
    return stamps.agg(
        F.min("t").cast("string").alias("min"),
        F.max("t").cast("string").alias("max"),
        F.lit(TEXT_DATE_LABEL if date_source else None).cast("string").alias("predominant_format"),
    )


def serial_date_stats(df: DataFrame, column: str) -> DataFrame:
    """First and last date of the day serials, with the smallest serial in text order as the example."""
    value = F.col("value")
    row = filled_values(df, column).where(is_serial(value)).agg(
        F.min(value.cast("bigint")).alias("first"), F.max(value.cast("bigint")).alias("last"), F.min(value).alias("example")
    )
    return row.select(
        serial_to_date(F.col("first").cast("string")).cast("string").alias("min"),
        serial_to_date(F.col("last").cast("string")).cast("string").alias("max"),
        F.lit(SERIAL_DATE_LABEL).alias("predominant_format"),
        F.col("example").alias("example_original"),
        serial_to_date(F.col("example")).cast("string").alias("example_interpreted"),
    )


def boolean_stats(df: DataFrame, column: str) -> DataFrame:
    word = F.lower("value")
    row = filled_values(df, column).agg(
        F.count("*").alias("filled"), F.count_if(word.isin(*YES_WORDS)).alias("yes"), F.count_if(word.isin(*NO_WORDS)).alias("no")
    )
    return unpack(
        row,
        [
            F.struct(F.lit(label).alias("label"), F.col(c).alias("frequency"), percentage(F.col(c), F.col("filled")).alias("percentage"))
            for label, c in ((YES_LABEL, "yes"), (NO_LABEL, "no"))
        ],
    )


# --- whole table ---------------------------------------------------------------------------------------------------


def profile_table(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per column with counts, inferred type, top values and the statistics block of that type."""
    rows: list[tuple] = []
    for part in passes(list(columns or df.columns)):
        rows += _profile_pass(df, list(part))
    return df.sparkSession.createDataFrame(rows, PROFILE_SCHEMA)


def _facts(values: DataFrame) -> dict[int, dict]:
    """Counts and ends of every column."""
    f, x, word = F.col("frequency"), F.col("x"), F.col("word")

    def times(condition: Column) -> Column:
        return F.sum(F.when(condition, f).otherwise(0))

    filled = F.col("size").isNotNull()
    facts = {
        "total": F.sum(f), "filled": times(filled), "values_": F.count_if(filled),
        "yes": times(word.isin(*YES_WORDS)), "no": times(word.isin(*NO_WORDS)), "integers": times(F.col("is_whole")), "decimals": times(x.isNotNull()),
        "timestamps": times(F.col("t").isNotNull()), "times": times(F.col("clock")), "serials": times(F.col("serial").isNotNull()),
        "characters": F.sum((F.col("size") * f).cast("decimal(38,0)")),
        "shortest": F.min("size"), "longest": F.max("size"), "low": F.min("x"), "high": F.max("x"), "first": F.min("t").cast("string"), "last": F.max("t").cast("string"),
        "serial_low": F.min("serial"), "serial_high": F.max("serial"),
    }
    # Numbers and times only: with a text among the results, every task would sort its values.
    return {row.column_index: row.asDict() for row in values.groupBy("column_index").agg(*[c.alias(n) for n, c in facts.items()]).collect()}


def _sums(values: DataFrame, columns: list[int]) -> dict[int, tuple[float | None, float | None]]:
    """Mean and deviation of numeric columns, from one row for each power of two among their numbers."""
    numbers = values.where(F.col("column_index").isin(*columns)).select("column_index", "x", "frequency")
    rows = sums.split(numbers).groupBy("column_index", "p").agg(*sums.sums()).collect()
    return {i: sums.mean_and_deviation(r for r in rows if r.column_index == i) for i in columns}


def _types(df: DataFrame, facts: dict[int, dict]) -> dict[int, tuple[str, str | None]]:
    names = ("filled", "yes", "no", "integers", "decimals", "timestamps", "times", "serials")
    rows = df.sparkSession.createDataFrame([(i, *[f[n] for n in names]) for i, f in facts.items()], "i int, " + ", ".join(f"{n} bigint" for n in names))
    return {r.i: (r.inferred_type, r.date_source) for r in _with_type(rows.coalesce(1)).collect()}


def _examples(values: DataFrame, serial: list[int]) -> dict[int, str]:
    """The first text of a serial in each column of serials."""
    found = values.where(F.col("column_index").isin(*serial) & F.col("serial").isNotNull())
    return {r.column_index: r.example for r in found.groupBy("column_index").agg(F.min("value").alias("example")).collect()}


def _days(df: DataFrame, facts: dict[int, dict], serial: list[int]) -> dict[tuple[int, str], str]:
    """The dates of the smallest, largest and example serials."""
    rows = [(i, name, str(facts[i][name])) for i in serial for name in ("serial_low", "serial_high", "example")]
    if not rows:
        return {}
    shown = df.sparkSession.createDataFrame(rows, "i int, name string, value string").coalesce(1)
    return {(r.i, r.name): r.day for r in shown.select("i", "name", serial_to_date(F.col("value")).cast("string").alias("day")).collect()}


BEST_SCHEMA = "column_index int, value string, lead string, frequency bigint, long boolean"
BEST_FIRST = [("column_index", "ascending"), ("frequency", "descending"), ("lead", "ascending"), ("long", "descending"), ("value", "ascending")]


def _best_rows(rows: pa.Table) -> pa.Table:
    """The ``TOP_VALUES`` best rows of every column, and as many of those that are short."""
    rows = rows.sort_by(BEST_FIRST)
    index, short = rows["column_index"].to_numpy(), ~rows["long"].to_numpy()
    _, first, column = np.unique(index, return_index=True, return_inverse=True)
    shorter = np.cumsum(short) - short  # the short rows before each
    keep = (np.arange(len(index)) - first[column] < TOP_VALUES) | (short & (shorter - shorter[first][column] < TOP_VALUES))
    return rows.filter(pa.array(keep))


def _best_of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What can be among the best values of a column, from the values of one task; only those so far are held."""
    best = None
    for batch in batches:
        fresh = pa.Table.from_batches([batch])
        best = _best_rows(fresh if best is None else pa.concat_tables([best, fresh]))
    if best is not None:
        yield from best.to_batches()


def _value_report(values: DataFrame, bounds: dict[int, tuple[float, float]]) -> list[Row]:
    """Histogram buckets and the best values of all columns by frequency and first characters: long texts first among equals (``place``), and short ones alone.

    Every task hands on its own best values, so the windows see a few rows a task and column, however many values a column has.
    """
    index = F.col("column_index")
    filled = values.where(F.col("size").isNotNull())
    long = F.col("long")
    by = [F.col("frequency").desc(), F.col("lead").asc()]
    place = F.row_number().over(Window.partitionBy("column_index").orderBy(*by, long.desc(), F.col("value").asc()))
    among_short = F.row_number().over(Window.partitionBy("column_index", "long").orderBy(*by, F.col("value").asc()))
    able = filled.select("column_index", "value", "lead", "frequency", F.col("digest").isNotNull().alias("long")).mapInArrow(_best_of_task, BEST_SCHEMA)
    top = able.withColumns({"place": place, "short": among_short}).where((F.col("place") <= TOP_VALUES) | (~long & (F.col("short") <= TOP_VALUES)))
    reports = [top.select("column_index", F.lit("top").alias("kind"), "place", "value", "lead", "frequency", "long")]
    if bounds:

        def by_column(at: int) -> Column:
            return F.element_at(F.create_map(*[F.lit(v) for i, b in bounds.items() for v in (i, b[at])]), index)

        low, high = by_column(0), by_column(1)
        position = F.floor((F.col("x") - low) / F.nullif(high - low, F.lit(0.0)) * F.lit(BUCKETS))
        clamped = F.least(F.lit(BUCKETS - 1), F.greatest(F.lit(0), F.coalesce(position, F.lit(0)))).cast("int")
        buckets = filled.where(index.isin(*bounds)).groupBy("column_index", clamped.alias("place")).agg(F.sum("frequency").alias("frequency"))
        reports.append(buckets.withColumn("kind", F.lit("bucket")))
    everything = reports[0]
    for report in reports[1:]:
        everything = everything.unionByName(report, allowMissingColumns=True)
    return everything.collect()


def _top(df: DataFrame, column: str, index: int, values: DataFrame, mine: list[Row]) -> list[tuple[str, int]]:
    """The most frequent values of one column, ties by value; long texts are fetched if some can be among them."""
    top = [(r.value, r.frequency) for r in mine if r.kind == "top" and not r.long]
    leading = [r for r in mine if r.kind == "top" and r.place <= TOP_VALUES]
    if any(r.long for r in leading):
        last = max(leading, key=lambda r: r.place)
        able = (F.col("frequency") > last.frequency) | ((F.col("frequency") == last.frequency) & (F.col("lead") <= last.lead))
        long = values.where((F.col("column_index") == index) & F.col("digest").isNotNull() & able).select("digest", "frequency")
        texts = filled_values(df, column).where(F.length("value") > SHORT).select("value", _digest(F.col("value")).alias("digest"))
        fetched = texts.join(long, "digest").groupBy("digest", "frequency").agg(F.min("value").alias("value"))
        top += [(r.value, r.frequency) for r in fetched.orderBy(F.col("frequency").desc(), F.col("value").asc()).limit(TOP_VALUES).collect()]
    return sorted(top, key=lambda t: (-t[1], t[0].encode()))[:TOP_VALUES]


def _profile_pass(df: DataFrame, columns: list[str]) -> list[tuple]:
    values = _stored_values(df, columns)
    facts = _facts(values)
    if not facts:
        return [(c, df.schema[c].dataType.simpleString(), "text", None, 0, 0, 0, 0.0, 0, 0, (None,) * 3, *[None] * 3, [], []) for c in columns]
    types = _types(df, facts)
    numeric = [i for i in facts if types[i][0] in ("integer", "decimal")]
    moments = _sums(values, numeric) if numeric else {}
    serial = [i for i in facts if types[i][1] == "excel_serial"]
    for i, example in (_examples(values, serial) if serial else {}).items():
        facts[i]["example"] = example
    days = _days(df, facts, serial)
    report = _value_report(values, {i: (facts[i]["low"], facts[i]["high"]) for i in numeric})
    middle = weighted_medians(values.where(F.col("column_index").isin(*numeric)).select("column_index", "x", "frequency"), {i: facts[i]["decimals"] for i in numeric}) if numeric else {}

    rows = []
    for i, name in enumerate(columns):
        s, (kind, source) = facts[i], types[i]
        mine = [r for r in report if r.column_index == i]
        top = _top(df, name, i, values, mine)
        text = numbers_block = dates = booleans = None
        distribution: list[tuple] = []
        if i in numeric:
            mean, deviation = moments[i]
            numbers_block = (s["low"], s["high"], mean, middle[i], deviation)
            buckets = sorted((r for r in mine if r.kind == "bucket"), key=lambda r: r.place)
            distribution = [(r.place, *_edges(r.place, s["low"], s["high"]), r.frequency) for r in buckets]
        elif source == "excel_serial":
            dates = (days[i, "serial_low"], days[i, "serial_high"], SERIAL_DATE_LABEL, s["example"], days[i, "example"])
        elif kind in ("date", "datetime"):
            dates = (s["first"], s["last"], TEXT_DATE_LABEL if source else None, None, None)
        elif kind == "boolean":
            booleans = [(label, n, n * 100.0 / s["filled"]) for label, n in ((YES_LABEL, s["yes"]), (NO_LABEL, s["no"]))]
        else:
            text = (float(s["shortest"]), int(s["characters"]) / s["filled"], float(s["longest"])) if s["filled"] else (None,) * 3
        blanks = s["total"] - s["filled"]
        counts = (s["total"], s["filled"], blanks, blanks * 100.0 / s["total"], s["values_"], max(0, s["filled"] - s["values_"]))
        rows.append((name, df.schema[name].dataType.simpleString(), kind, source, *counts, text, numbers_block, dates, booleans, top, distribution))
    return rows
