"""Text, number, date and check-digit functions on edge values, next to what DuckDB makes of them."""

import duckdb
import pytest
from pyspark.sql import functions as F

from conftest import values
from sheetloom.functions.dates import is_serial, parse_format, parse_timestamp, serial_to_date
from sheetloom.functions.identifiers import valid_cpf, valid_email
from sheetloom.functions.numbers import parse_double
from sheetloom.functions.text import as_text, blank, bounded_key, contains_ignoring_case, trimmed
from pyspark.sql import types as T


def one_column(spark, items, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(items)], f"i int, v {kind}").orderBy("i")


def sql_values(expression, items):
    connection = duckdb.connect()
    return [connection.execute(f"select {expression} from (select ?::varchar as v)", [v]).fetchall()[0][0] for v in items]


TEXTS = [None, "", " ", " ", "\t", " a ", " é　", "x y", "​", "ok"]


def test_trim_and_blank(spark):
    df = one_column(spark, TEXTS).select(trimmed(F.col("v")).alias("t"), blank(F.col("v")).alias("b"))
    assert [r.t for r in df.collect()] == sql_values("trim(v)", TEXTS)
    assert [r.b for r in df.collect()] == sql_values("v is null or trim(v) = ''", TEXTS)


NUMBERS = ["1,5", "1.5", "1d", "1f", "1_000", "1__0", "1e3", "1e400", "inf", "-Infinity", "nan", "2024", " 12 ", "1.234.5", ".5", "5.", "abc", "", "12345678901234567890", "+7", "0x1F", "1_e5", "-,5"]


def test_parse_double(spark):
    got = [r.x for r in one_column(spark, NUMBERS).select(parse_double(F.col("v")).alias("x")).collect()]
    assert [repr(x) for x in got] == [repr(x) for x in sql_values("try_cast(replace(v, ',', '.') as double)", NUMBERS)]


DATES = ["2024-1-5", "2024/01/05", "2024 01 05", "2024\\01\\05", "2024-01/05", "2024", "2024-01", "25149", "20240105", "now", "2024-02-31", "24-1-5", "2024-01-05 10:00", "2024-01-05T10:00:00Z", "2024-01-05 10", "2024-01-05 9:30", "2024-01-05 1:2", "2024-01-05 24:00:00", "2024-01-05 25:00", "2024-01-05 10:00:60", "2024-01-05 10:00:00.", "2024-01-05 10:00:00.123456789", "2024-01-05x", "2024-001-05", "2024-01-05T", "2024-01-05  10:00", "2024-01-05 10:00:00 UTC", "2024-01-05 10:00:00 +02:00", "text", ""]


def test_parse_timestamp(spark):
    got = [r.t for r in one_column(spark, DATES).select(parse_timestamp(F.col("v")).alias("t")).collect()]
    assert got == sql_values("try_cast(v as timestamp)", DATES)


FORMATTED = ["7/11/1968", "07/11/68", "31/04/2023", "29/02/2020", "7/11/12345", "7/11/968", "7/11/1968x", "1968/11/07", "1968-11-07", "07-11-1968", "7.11.1968", "007/11/1968", "25149", ""]
PATTERNS = {"DD/MM/YYYY": "%d/%m/%Y", "YYYY/MM/DD": "%Y/%m/%d", "YYYY-MM-DD": "%Y-%m-%d", "DD-MM-YYYY": "%d-%m-%Y", "other": "%d/%m/%Y"}


@pytest.mark.parametrize("name", PATTERNS)
def test_parse_format(spark, name):
    got = [r.d for r in one_column(spark, FORMATTED).select(parse_format(F.col("v"), name).alias("d")).collect()]
    assert got == sql_values(f"cast(try_strptime(v, '{PATTERNS[name]}') as date)", FORMATTED)


def test_serials(spark):
    texts = ["1", "59", "60", "61", "25149", "0", "73050", "73051", "90000000009", "12345678901234567890123", "25149.5", "-5", "007", "", None]
    df = one_column(spark, texts).select(is_serial(F.col("v")).alias("ok"), serial_to_date(F.col("v")).cast("string").alias("d"))
    got = dict(zip(texts, [(r.ok, r.d) for r in df.collect()]))
    assert got["1"] == (True, "1900-01-01") and got["59"] == (True, "1900-02-28") and got["61"] == (True, "1900-03-01")
    assert got["25149"] == (True, "1968-11-07") and got["73050"] == (True, "2099-12-31") and got["007"] == (True, "1900-01-07")
    assert all(got[t] == (False, None) for t in ("60", "0", "73051", "90000000009", "12345678901234567890123", "25149.5", "-5", "", None))


def test_cpf_and_email(spark):
    tax = ["529.982.247-25", "52998224725", "52998224724", "123", "11111111111", "abc", "529982247250"]
    assert [r.x for r in one_column(spark, tax).select(valid_cpf(F.col("v")).alias("x")).collect()] == [True, True] + [False] * 5
    mail = ["a@b.co", "a.b+c@x-y.example.com", "a@b", "a b@c.de", "@b.co", "a@b.co\n", "a@b..co"]
    assert [r.x for r in one_column(spark, mail).select(valid_email(F.col("v")).alias("x")).collect()] == [True, True] + [False] * 5


FLOATS = [0.0, -0.0, 1.0, 0.1, 1e7, 123456789.125, 9999999.5, 1e15, 1.5e15, 1e16, 1.25e20, 0.001, 0.00012, 1e-4, 1e-5, 1.5e-7, -2.5e-10, 1e100, float("inf"), float("-inf"), float("nan"), 1 / 3, -1e8, 12345678.9]


def test_float_text(spark):
    got = [r.t for r in one_column(spark, FLOATS, "double").select(as_text(F.col("v"), T.DoubleType()).alias("t")).collect()]
    connection = duckdb.connect()
    assert got == [connection.execute("select cast(?::double as varchar)", [f]).fetchall()[0][0] for f in FLOATS]


def test_other_text(spark):
    row = spark.sql("select array(1.5D, null) a, X'0102' b, true c, date'2024-01-05' d, timestamp_ntz'2024-01-05 01:02:03.5' e, 1.50BD f")
    got = [as_text(F.col(n), row.schema[n].dataType).alias(n) for n in row.columns]
    assert values(row.select(*got)) == [("[1.5,null]", "<2 bytes>", "true", "2024-01-05", "2024-01-05 01:02:03.5", "1.50")]


@pytest.mark.parametrize("needle", ["%", "_b", "\\", "É", "a\\", "100%"])
def test_contains(spark, needle):
    texts = ["abc", "a\\b", "ÉTÉ", None, "100% sure", "", "a%b", "\\"]
    got = [r.x for r in one_column(spark, texts).select(contains_ignoring_case(F.col("v"), needle).alias("x")).collect()]
    connection = duckdb.connect()
    pattern = f"%{needle.lower()}%"
    assert got == [connection.execute("select lower(coalesce(?::varchar, '')) like ?", [t, pattern]).fetchall()[0][0] for t in texts]


def test_bounded_key_tells_texts_apart(spark):
    texts = ["a" * 256, "a" * 257, "a" * 300, "b" * 300, "", "1:a", "a"]
    keys = [r.k for r in one_column(spark, texts).select(bounded_key(F.col("v")).alias("k")).collect()]
    assert len(set(keys)) == len(texts) and max(map(len, keys)) <= 260
