"""Blank statistics, counts, types and profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sheetloom.operators import grid, profile
from sheetloom.plans.fused import union_all
from sheetloom.suite import query
from sheetloom.suite.inputs import DIRTY_COLUMNS, DIRTY_ORDERS, dirty_orders, empty, number, serial, serial_date, table, v

COLUMNS = {
    "orders": ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"),
    "customer": ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"),
    "lineitem": ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"),
    "part": ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"),
    "labels": ("doc_id", "quality", "toxic"),
    "events": ("event_id", "ts", "user_id", "event_type", "value", "props"),
    "supplier": ("s_suppkey", "s_name", "s_nationkey", "s_acctbal"),
    "nation": ("n_nationkey", "n_name", "n_regionkey"),
    "documents": ("doc_id", "text", "lang", "source", "n_chars"),
    "conversations": ("conv_id", "turn", "role", "text"),
    "region": ("r_regionkey", "r_name"),
    "embeddings": ("vec_id", "embedding", "label"),
    "pages": ("page_id", "url", "html"),
    "benchmark": ("item_id", "text"),
}

# The words of the two boolean classes, and how whole and decimal numbers and times of day look.
YES, NO = "('true', '1', 'sim', 's', 'yes', 'y')", "('false', '0', 'nao', 'não', 'n', 'no')"
WHOLE = "^[+-]?[0-9]+$"
DECIMAL = "^[+-]?([0-9]+([.][0-9]+)?|[.][0-9]+)$"
TIME_OF_DAY = "[ T][0-9]{1,2}:[0-9]{2}"


def _filled(source: str, c: str) -> str:
    return f"select {v(c)} as value from {source} where not {empty(c)}"


def _type_cte(source: str, c: str) -> str:
    """What every single value could be, then what all of them agree on, from the narrowest kind to the widest."""
    return f"""values_{c} as ({_filled(source, c)}),
    seen_{c} as (select (lower(value) in {YES} or lower(value) in {NO}) as word, regexp_matches(value, '{WHOLE}') as whole,
        regexp_matches(replace(value, ',', '.'), '{DECIMAL}') as num, try_cast(value as date) is not null as day,
        try_cast(value as timestamp) is not null as moment, regexp_matches(value, '{TIME_OF_DAY}') as clock,
        {serial("value")} as serial_day from values_{c}),
    agreed_{c} as (select count(*) as n, bool_and(word) as word, bool_and(whole) as whole, bool_and(num) as num,
        bool_and(moment) and bool_or(clock) as moment, bool_and(day) or bool_and(moment) as day,
        avg(cast(serial_day as integer)) >= 0.9 as serial_days from seen_{c}),
    type_{c} as (select list_filter([if(word, 'boolean', null), if(moment, 'datetime', null), if(day, 'date', null), if(serial_days, 'date', null),
            if(whole, 'integer', null), if(num, 'decimal', null), 'text'], lambda x: x is not null)[1] as kind,
        case when n > 0 and not word and not moment then if(day, 'formatted', if(serial_days, 'excel_serial', null)) end as source from agreed_{c})"""


# --- blanks and counts ---


@query(
    f"with {DIRTY_ORDERS} select * from ("
    + " union all ".join(f"select '{c}' as column_name, count(*) filter ({empty(c)}) as empty_count from dirty" for c in DIRTY_COLUMNS)
    + ") where empty_count > 0"
)
def blank_stats_dirty_orders(spark: SparkSession, folder: str) -> DataFrame:
    return grid.blank_stats(dirty_orders(spark, folder), "row_id").withColumnRenamed("column", "column_name")


HOLES = {"l_quantity": (7, "7"), "l_discount": (0, "0"), "l_returnflag": ("R", "'R'"), "l_linestatus": ("?", "'?'"), "l_linenumber": (3, "3"), "l_suppkey": (5, "5")}


@query(
    "select * from ("
    + " union all ".join(
        f"select '{c}' as column_name, count(*) filter ({empty(f'nullif({c}, {HOLES[c][1]})' if c in HOLES else c)}) as empty_count from lineitem" for c in COLUMNS["lineitem"]
    )
    + ") where empty_count > 0"
)
def blank_stats_lineitem(spark: SparkSession, folder: str) -> DataFrame:
    """All columns, some with holes made by value: none of the table's own has a blank."""
    items = table(spark, folder, "lineitem").withColumns({c: F.nullif(F.col(c), F.lit(v)) for c, (v, _) in HOLES.items()})
    return grid.blank_stats(items).withColumnRenamed("column", "column_name")


def _counts_sql(source: str, columns) -> str:
    return " union all ".join(
        f"""select '{c}' as column_name, count(*) as total_count, count(*) filter (not {empty(c)}) as filled_count,
        count(*) filter ({empty(c)}) as empty_count, round(count(*) filter ({empty(c)}) * 100.0 / count(*), 6) as empty_percentage,
        count(distinct case when not {empty(c)} then {v(c)} end) as distinct_count,
        count(*) filter (not {empty(c)}) - count(distinct case when not {empty(c)} then {v(c)} end) as duplicate_count from {source}"""
        for c in columns
    )


def _rounded_counts(counts: DataFrame) -> DataFrame:
    return counts.withColumnRenamed("column", "column_name").withColumn("empty_percentage", F.round("empty_percentage", 6))


@query(f"with {DIRTY_ORDERS} {_counts_sql('dirty', DIRTY_COLUMNS)}")
def profile_counts_dirty_orders(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded_counts(profile.profile_counts(dirty_orders(spark, folder), DIRTY_COLUMNS))


@query(_counts_sql("documents", ["text"]))
def profile_counts_document_text(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded_counts(profile.profile_counts(table(spark, folder, "documents"), ["text"]))


@query(
    "with "
    + ", ".join(_type_cte(t, c).replace(f"_{c}", f"_{t}_{c}") for t, columns in COLUMNS.items() for c in columns)
    + " "
    + " union all ".join(
        f"select '{t}' as table_name, '{c}' as column_name, kind as inferred_type, source as date_source from type_{t}_{c}"
        for t, columns in COLUMNS.items()
        for c in columns
    )
)
def infer_types_all_tables(spark: SparkSession, folder: str) -> DataFrame:
    return union_all(
        [
            profile.infer_types(table(spark, folder, t), columns).select(
                F.lit(t).alias("table_name"), F.col("column").alias("column_name"), "inferred_type", "date_source"
            )
            for t, columns in COLUMNS.items()
        ]
    )


@query(
    f"with {DIRTY_ORDERS}, "
    + ", ".join(_type_cte("dirty", c) for c in DIRTY_COLUMNS)
    + " "
    + " union all ".join(f"select '{c}' as column_name, kind as inferred_type, source as date_source from type_{c}" for c in DIRTY_COLUMNS)
)
def infer_types_dirty_orders(spark: SparkSession, folder: str) -> DataFrame:
    return profile.infer_types(dirty_orders(spark, folder), DIRTY_COLUMNS).withColumnRenamed("column", "column_name")


# --- one column ---


@query(
    f"with {DIRTY_ORDERS} select {v('priority')} as value, count(*) as frequency from dirty where not {empty('priority')} "
    "group by 1 order by 2 desc, 1 limit 10"
)
def top_values_priority(spark: SparkSession, folder: str) -> DataFrame:
    return profile.top_values(dirty_orders(spark, folder), "priority")


@query(f"select value, count(*) as frequency from ({_filled('documents', 'text')}) group by 1 order by 2 desc, 1 limit 10")
def top_values_document_text(spark: SparkSession, folder: str) -> DataFrame:
    return profile.top_values(table(spark, folder, "documents"), "text")


@query(
    "select cast(min(length(value)) as double) as min_length, round(avg(length(value)), 6) as avg_length, "
    f"cast(max(length(value)) as double) as max_length from ({_filled('documents', 'text')})"
)
def text_stats_documents(spark: SparkSession, folder: str) -> DataFrame:
    return profile.text_stats(table(spark, folder, "documents"), "text").withColumn("avg_length", F.round("avg_length", 6))


# Means and deviations are fractions of whole numbers, so the twins sum ten-thousandths: the order of rows plays no part, and six digits are rounded once.
PARTS = "cast(round(x * 10000) as hugeint)"
MEAN = f"sign(sum({PARTS})) * cast((abs(sum({PARTS})) * 200 + count(x)) // (2 * count(x)) as double) / 1000000"
DEVIATION = f"round(sqrt(cast(count(x) * sum({PARTS} * {PARTS}) - sum({PARTS}) * sum({PARTS}) as double) / (count(x) * nullif(count(x) - 1, 0))) / 10000, 6)"


def _numeric_sql(source: str, c: str) -> str:
    return f"""select round(min(x), 6) as min, round(max(x), 6) as max, {MEAN} as avg, round(median(x), 6) as median,
        {DEVIATION} as stddev from (select {number("value")} as x from ({_filled(source, c)}))"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


@query(_numeric_sql("lineitem", "l_extendedprice"))
def numeric_stats_extendedprice(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(profile.numeric_stats(table(spark, folder, "lineitem"), "l_extendedprice"))


@query(f"with {DIRTY_ORDERS} {_numeric_sql('dirty', 'price_text')}")
def numeric_stats_dirty_price(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(profile.numeric_stats(dirty_orders(spark, folder), "price_text"))


def _histogram_sql(source: str, c: str) -> str:
    """Each number's share of the range, in twelfths; the largest number belongs to the last twelfth."""
    return f"""ranged as (select x, min(x) over () as lo, max(x) over () - min(x) over () as span
        from (select {number("value")} as x from ({_filled(source, c)})) where x is not null),
    twelfths as (select lo, span, if(span = 0, 0, least(trunc((x - lo) / nullif(span, 0) * 12), 11)) as part from ranged)
    select cast(part as integer) as bucket, round(lo + span / 12 * part, 6) as min,
        round(if(part = 11, lo + span, lo + span / 12 * (part + 1)), 6) as max, count(*) as frequency
    from twelfths group by part, lo, span"""


@query("with " + _histogram_sql("lineitem", "l_extendedprice"))
def histogram_extendedprice(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(profile.histogram(table(spark, folder, "lineitem"), "l_extendedprice"))


@query(f"with {DIRTY_ORDERS}, " + _histogram_sql("dirty", "price_text"))
def histogram_dirty_price(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(profile.histogram(dirty_orders(spark, folder), "price_text"))


def _dates_sql(source: str, c: str, label: str) -> str:
    return f"""select strftime(min(t), '%Y-%m-%d %H:%M:%S') as min, strftime(max(t), '%Y-%m-%d %H:%M:%S') as max, {label} as predominant_format
        from (select try_cast(value as timestamp) as t from ({_filled(source, c)}))"""


@query(_dates_sql("orders", "o_orderdate", "'Texto'"))
def date_stats_orderdate(spark: SparkSession, folder: str) -> DataFrame:
    return profile.date_stats(table(spark, folder, "orders"), "o_orderdate")


@query(f"with {DIRTY_ORDERS} {_dates_sql('dirty', 'day_text', 'cast(null as varchar)')}")
def date_stats_mixed_days(spark: SparkSession, folder: str) -> DataFrame:
    return profile.date_stats(dirty_orders(spark, folder), "day_text", None)


def _serials_sql(source: str, c: str) -> str:
    return f"""select cast(min(d) as varchar) as min, cast(max(d) as varchar) as max, 'Serial de data do Excel' as predominant_format,
        min(value) as example_original, cast(arg_min(d, value) as varchar) as example_interpreted
        from (select value, {serial_date("value")} as d from ({_filled(source, c)})) where d is not null"""


@query(_serials_sql("part", "p_partkey"))
def serial_stats_partkey(spark: SparkSession, folder: str) -> DataFrame:
    return profile.serial_date_stats(table(spark, folder, "part"), "p_partkey")


@query(f"with {DIRTY_ORDERS} {_serials_sql('dirty', 'serial_text')}")
def serial_stats_dirty(spark: SparkSession, folder: str) -> DataFrame:
    return profile.serial_date_stats(dirty_orders(spark, folder), "serial_text")


def _booleans_sql(source: str, c: str) -> str:
    return " union all ".join(
        f"select '{label}' as label, count(*) filter (lower(value) in {words}) as frequency, "
        f"round(count(*) filter (lower(value) in {words}) * 100.0 / count(*), 6) as percentage from ({_filled(source, c)})"
        for label, words in (("Sim", YES), ("Nao", NO))
    )


@query(_booleans_sql("labels", "quality"))
def boolean_stats_labels(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(profile.boolean_stats(table(spark, folder, "labels"), "quality"))


@query(f"with {DIRTY_ORDERS} {_booleans_sql('dirty', 'flag')}")
def boolean_stats_dirty_flag(spark: SparkSession, folder: str) -> DataFrame:
    return _rounded(profile.boolean_stats(dirty_orders(spark, folder), "flag"))


# --- whole tables ---


def _profile_sql(source: str, columns, prefix: str = "") -> str:
    """The whole profile in long form: (column_name, block, item, number, text)."""
    ctes, parts = [], []
    for c in columns:
        ctes.append(_type_cte(source, c))
        ctes.append(f"numbers_{c} as (select {number('value')} as x from values_{c})")
        ctes.append(f"bounds_{c} as (select min(x) as lo, max(x) as hi from numbers_{c})")
        ctes.append(
            f"""placed_{c} as (select case when hi = lo then 0 else
            least(11, greatest(0, cast(floor((x - lo) / (hi - lo) * 12) as bigint))) end as bucket from numbers_{c}, bounds_{c}
            where (select kind from type_{c}) in ('integer', 'decimal'))"""
        )
        ctes.append(f"top_{c} as (select value, count(*) as n from values_{c} group by 1 order by 2 desc, 1 limit 10)")
        ctes.append(f"serials_{c} as (select value, {serial_date('value')} as d from values_{c})")

        def item(block, name, number_sql, text_sql, rest):
            return (
                f"select '{c}' as column_name, '{block}' as block, {name} as item, cast({number_sql} as double) as number, "
                f"cast({text_sql} as varchar) as text {rest}"
            )

        def only(*kinds):
            return f"where (select kind from type_{c}) in ({', '.join(repr(k) for k in kinds)})"

        parts += [
            item("type", "'inferred_type'", "null", "kind", f"from type_{c}"),
            item("counts", "'total'", "count(*)", "null", f"from {source}"),
            item("counts", "'filled'", "count(*)", "null", f"from values_{c}"),
            item("counts", "'distinct'", "count(distinct value)", "null", f"from values_{c}"),
            item("text", "'min'", "min(length(value))", "null", f"from values_{c} {only('text')} having count(*) > 0"),
            item("text", "'avg'", "round(avg(length(value)), 6)", "null", f"from values_{c} {only('text')} having count(*) > 0"),
            item("text", "'max'", "max(length(value))", "null", f"from values_{c} {only('text')} having count(*) > 0"),
            *[
                item("numeric", f"'{n}'", f, "null", f"from numbers_{c} {only('integer', 'decimal')} having count(*) > 0")
                for n, f in (("min", "round(min(x), 6)"), ("max", "round(max(x), 6)"), ("avg", MEAN), ("median", "round(median(x), 6)"), ("stddev", DEVIATION))
            ],
            item("bucket", "cast(bucket as varchar)", "count(*)", "null", f"from placed_{c} group by bucket"),
            *[
                item(
                    "date", f"'{n}'", "null", f"{n}(try_cast(value as timestamp))",
                    f"from values_{c} {only('date', 'datetime')} and (select source from type_{c}) is distinct from 'excel_serial' having count(*) > 0",
                )
                for n in ("min", "max")
            ],
            *[
                item(
                    "serial", f"'{n}'", "null", f"cast({f} as varchar)",
                    f"from serials_{c} {only('date')} and (select source from type_{c}) = 'excel_serial' and d is not null having count(*) > 0",
                )
                for n, f in (("min", "min(d)"), ("max", "max(d)"), ("example", "min(value)"), ("example_date", "arg_min(d, value)"))
            ],
            *[
                item("boolean", f"'{label}'", f"count(*) filter (lower(value) in {words})", "null", f"from values_{c} {only('boolean')} having count(*) > 0")
                for label, words in (("Sim", YES), ("Nao", NO))
            ],
            item("top", "cast(row_number() over (order by n desc, value) as varchar)", "n", "value", f"from top_{c}"),
        ]
    return f"with {prefix}" + ", ".join(ctes) + " " + " union all ".join(f"select * from ({p})" for p in parts)


def _long_profile(report: DataFrame) -> DataFrame:
    def entry(block, item, number=None, text=None):
        return F.struct(
            F.lit(block).alias("block"),
            (item if not isinstance(item, str) else F.lit(item)).alias("item"),
            (number if number is not None else F.lit(None)).cast("double").alias("number"),
            (text if text is not None else F.lit(None)).cast("string").alias("text"),
        )

    fixed = [
        entry("type", "inferred_type", text=F.col("inferred_type")),
        entry("counts", "total", F.col("total_count")),
        entry("counts", "filled", F.col("filled_count")),
        entry("counts", "distinct", F.col("distinct_count")),
    ]
    text = [entry("text", n, F.round(f"text_stats.{n}_length", 6)) for n in ("min", "avg", "max")]
    numeric = [entry("numeric", n, F.round(f"numeric_stats.{n}", 6)) for n in ("min", "max", "avg", "median", "stddev")]
    dates = [entry("date", n, text=F.col(f"date_stats.{n}")) for n in ("min", "max")]
    serials = [
        entry("serial", n, text=F.col(f"date_stats.{f}"))
        for n, f in (("min", "min"), ("max", "max"), ("example", "example_original"), ("example_date", "example_interpreted"))
    ]
    nothing = F.array_except(F.array(fixed[0]), F.array(fixed[0]))

    def when(condition, entries):
        return F.when(condition, entries).otherwise(nothing)

    is_serial = F.coalesce(F.col("date_source") == "excel_serial", F.lit(False))
    blocks = [
        F.array(*fixed),
        when(F.col("text_stats").isNotNull(), F.array(*text)),
        when(F.col("numeric_stats").isNotNull(), F.array(*numeric)),
        when(F.col("date_stats").isNotNull() & ~is_serial, F.array(*dates)),
        when(F.col("date_stats").isNotNull() & is_serial, F.array(*serials)),
        F.transform("distribution", lambda b: entry("bucket", b["bucket"].cast("string"), b["count"])),
        F.coalesce(F.transform("boolean_stats", lambda b: entry("boolean", b["label"], b["count"])), nothing),
        F.transform("top_values", lambda t, i: entry("top", (i + 1).cast("string"), t["count"], t["value"])),
    ]
    return report.select(F.col("column").alias("column_name"), F.explode(F.concat(*blocks)).alias("e")).select("column_name", "e.*")


@query(_profile_sql("customer", COLUMNS["customer"]))
def profile_table_customer(spark: SparkSession, folder: str) -> DataFrame:
    return _long_profile(profile.profile_table(table(spark, folder, "customer")))


@query(_profile_sql("lineitem", COLUMNS["lineitem"]))
def profile_table_lineitem(spark: SparkSession, folder: str) -> DataFrame:
    return _long_profile(profile.profile_table(table(spark, folder, "lineitem")))


@query(_profile_sql("dirty", DIRTY_COLUMNS, DIRTY_ORDERS + ", "))
def profile_table_dirty_orders(spark: SparkSession, folder: str) -> DataFrame:
    return _long_profile(profile.profile_table(dirty_orders(spark, folder), DIRTY_COLUMNS))


@query(_profile_sql("events", COLUMNS["events"]))
def profile_table_events(spark: SparkSession, folder: str) -> DataFrame:
    return _long_profile(profile.profile_table(table(spark, folder, "events")))
