"""Input tables, a table with dirt in it, and the SQL fragments of the twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def dirty_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as a text document with blanks, padding, broken numbers, mixed dates, serials, addresses and tax ids."""
    key, price = F.col("o_orderkey"), F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    code = F.lpad(F.col("o_custkey").cast("string"), 9, "0")

    def every(n: int):
        return key % n == 0

    return table(spark, folder, "orders").select(
        key.alias("row_id"),
        F.when(every(7), None)
        .when(every(11), "   ")
        .when(every(13), F.concat(F.lit(" "), "o_orderpriority", F.lit(" ")))
        .when(every(17), F.lit(" "))
        .otherwise(F.col("o_orderpriority"))
        .alias("priority"),
        F.when(every(17), "ABC").when(every(19), F.replace(price, F.lit("."), F.lit(","))).otherwise(price).alias("price_text"),
        F.when(every(23), "someday")
        .when(every(5), F.date_format("o_orderdate", "dd/MM/yyyy"))
        .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
        .alias("day_text"),
        F.when(every(31), "12.5").when(every(9), "").otherwise((key * 7 % 80000).cast("string")).alias("serial_text"),
        F.concat(F.lit("user."), code, F.when(every(12), " at ").otherwise("@"), F.lit("example.com")).alias("email"),
        F.when(every(29), "529.982.247-25").when(every(10), F.lit("123")).otherwise(F.concat(code, F.lit("00"))).alias("tax_id"),
        F.when(every(3), "Sim").when(every(4), " NAO ").otherwise("y").alias("flag"),
    )


def v(c: str) -> str:
    return f"trim(cast({c} as varchar))"


def empty(c: str) -> str:
    return f"({c} is null or {v(c)} = '')"


def number(c: str) -> str:
    return f"try_cast(replace({c}, ',', '.') as double)"


def day_number(c: str) -> str:
    """A whole number in plain digits, else NULL."""
    return f"try_cast(nullif(regexp_extract({c}, '^[0-9]+$'), '') as bigint)"


def serial(c: str) -> str:
    """Whether a spreadsheet shows the number as a day up to 2099; day 60 does not exist."""
    return f"coalesce({day_number(c)} between 1 and 73050 and {day_number(c)} != 60, false)"


def serial_date(c: str) -> str:
    """Counted from 1899-12-30; days before the missing one lie a day later."""
    n = day_number(c)
    return f"if({serial(c)}, date '1899-12-30' + cast({n} + cast({n} < 60 as integer) as integer), null)"


DIRTY_ORDERS = """dirty as (
    select o_orderkey as row_id,
        case when o_orderkey % 7 = 0 then null when o_orderkey % 11 = 0 then '   '
             when o_orderkey % 13 = 0 then concat(' ', o_orderpriority, ' ')
             when o_orderkey % 17 = 0 then chr(160) else o_orderpriority end as priority,
        case when o_orderkey % 17 = 0 then 'ABC'
             when o_orderkey % 19 = 0 then replace(cast(cast(o_totalprice as decimal(18,2)) as varchar), '.', ',')
             else cast(cast(o_totalprice as decimal(18,2)) as varchar) end as price_text,
        case when o_orderkey % 23 = 0 then 'someday'
             when o_orderkey % 5 = 0 then strftime(o_orderdate, '%d/%m/%Y')
             else strftime(o_orderdate, '%Y-%m-%d') end as day_text,
        case when o_orderkey % 31 = 0 then '12.5' when o_orderkey % 9 = 0 then ''
             else cast(o_orderkey * 7 % 80000 as varchar) end as serial_text,
        concat('user.', lpad(cast(o_custkey as varchar), 9, '0'),
               case when o_orderkey % 12 = 0 then ' at ' else '@' end, 'example.com') as email,
        case when o_orderkey % 29 = 0 then '529.982.247-25' when o_orderkey % 10 = 0 then '123'
             else concat(lpad(cast(o_custkey as varchar), 9, '0'), '00') end as tax_id,
        case when o_orderkey % 3 = 0 then 'Sim' when o_orderkey % 4 = 0 then ' NAO ' else 'y' end as flag
    from orders)"""

DIRTY_COLUMNS = ("priority", "price_text", "day_text", "serial_text", "email", "tax_id", "flag")
