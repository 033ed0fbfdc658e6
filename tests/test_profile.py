import math
import random
import statistics
from fractions import Fraction

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from conftest import values
from sheetloom.operators import medians, profile, sums


def text_table(spark, items, name="c"):
    return spark.createDataFrame([(v,) for v in items], f"`{name}` string")


@pytest.mark.parametrize(
    "items, expected",
    [
        (["41275", "40010", "40777", "43810"], ("date", "excel_serial")),
        (["1", "0", " 1 ", ""], ("boolean", None)),
        (["Sim", "NÃO", "y"], ("boolean", None)),
        (["1", "2", "60"] + ["5"] * 7, ("date", "excel_serial")),
        (["1", "60", "60"], ("integer", None)),
        (["100000", "-5", "+7"], ("integer", None)),
        (["1,5", ".5", "100000"], ("decimal", None)),
        (["1e3", "1.5"], ("text", None)),
        (["2024-01-05", "2024/2/6"], ("date", "formatted")),
        (["2024-01-05", "2024-02-06 10:00"], ("datetime", None)),
        (["2024-01-05", "soon"], ("text", None)),
        (["2024"], ("date", "excel_serial")),
        (["", None, " "], ("text", None)),
        ([], ("text", None)),
        (["12345678901234567890"], ("integer", None)),
    ],
)
def test_inferred_type(spark, items, expected):
    assert values(profile.infer_types(text_table(spark, items)), "inferred_type", "date_source") == [expected]


def test_serial_profile(spark):
    row = profile.profile_table(text_table(spark, ["9131", "41275", "40010", "43810"], "planted")).first()
    assert (row.inferred_type, row.date_source) == ("date", "excel_serial")
    assert row.date_stats.example_original == "40010" and row.date_stats.example_interpreted == "2009-07-16"
    assert (row.date_stats.min, row.date_stats.max) == ("1924-12-30", "2019-12-11")


def test_profile_of_awkward_names_and_empty_table(spark):
    df = spark.createDataFrame([("x", " ")], "`a.b c` string, `MUNICÍPIO.` string")
    rows = {r.column: r for r in profile.profile_table(df).collect()}
    assert rows["a.b c"].top_values[0].value == "x" and rows["MUNICÍPIO."].filled_count == 0
    empty = profile.profile_table(df.limit(0)).collect()
    assert [(r.column, r.inferred_type, r.total_count, r.empty_percentage) for r in empty] == [("a.b c", "text", 0, 0.0), ("MUNICÍPIO.", "text", 0, 0.0)]


def test_profile_of_many_columns(spark):
    df = spark.range(5).select(*[(F.col("id") * i).cast("string").alias(f"c{i}") for i in range(230)])
    rows = profile.profile_table(df).collect()
    assert len(rows) == 230 and rows[229].distinct_count == 5 and rows[0].distinct_count == 1


def test_top_values_ties_and_trimming(spark):
    df = text_table(spark, ["b", " b", "a", "a ", "c", None, "", *[f"z{i:02d}" for i in range(20)]])
    top = values(profile.top_values(df, "c"))
    assert top[:3] == [("a", 2), ("b", 2), ("c", 1)] and len(top) == 10


def test_counts_approximate(spark):
    df = text_table(spark, [str(i % 50) for i in range(1000)])
    row = profile.profile_counts(df, approximate=True).first()
    assert row.filled_count == 1000 and abs(row.distinct_count - 50) <= 2


def test_histogram_edges(spark):
    rows = values(profile.histogram(text_table(spark, ["0", "12", "6,0", "abc", "inf", "nan", ""]), "c"))
    assert sorted((b, n) for b, _, _, n in rows) == [(0, 1), (6, 1), (11, 1)]
    assert values(profile.histogram(text_table(spark, ["5", "5"]), "c")) == [(0, 5.0, 5.0, 2)]
    assert values(profile.histogram(text_table(spark, ["x"]), "c")) == []


def test_numeric_stats_of_one_number(spark):
    assert values(profile.numeric_stats(text_table(spark, ["7", "x"]), "c")) == [(7.0, 7.0, 7.0, 7.0, None)]
    assert values(profile.numeric_stats(text_table(spark, ["x"]), "c")) == [(None,) * 5]


def test_exact_medians(spark):
    random.seed(7)
    n = 100_000
    columns = {
        "skewed": [3.25 if random.random() < 0.4 else random.lognormvariate(0, 4) for _ in range(n)],
        "even": [float(i) for i in range(n)],
        "heavy": [10.0**random.randint(-200, 200) for _ in range(n)],
        "holes": [None if i % 3 else float(i % 1001) for i in range(n)],
    }
    df = spark.createDataFrame(list(zip(*columns.values())), ", ".join(f"{c} double" for c in columns)).repartition(8).cache()
    for name, data in columns.items():
        assert medians.exact_median(df, name) == statistics.median(x for x in data if x is not None), name


def test_medians_of_special_numbers(spark):
    inf = float("inf")
    for data in ([1.0, inf, inf, 2.0, -inf], [5e-324, -5e-324, 0.0, 1.7e308, -1.7e308], [1.0, 2.0], [4.0], [-0.0, 0.0, 1e-320]):
        df = spark.createDataFrame([(x,) for x in data], "x double")
        assert medians.exact_median(df, "x") == statistics.median(data), data
    assert medians.exact_median(spark.createDataFrame([(None,)], "x double"), "x") is None


@pytest.mark.parametrize("partitions", [1, 3, 8, 64])
def test_sums_do_not_depend_on_partitions(spark, partitions):
    """The true mean and deviation, rounded once, however the rows are dealt."""
    rng = random.Random(11)
    columns = {"mixed": [rng.choice([1e16, -1e16, 1.0, 0.1, 1e-9]) for _ in range(3000)], "cents": [round(rng.uniform(0, 0.1), 2) for _ in range(3000)], "tiny": [rng.uniform(-1, 1) * 10.0 ** rng.randint(-250, 250) for _ in range(3000)]}
    for name, data in columns.items():
        df = spark.createDataFrame([(x,) for x in data], f"{name} double").repartition(partitions)
        row = profile.numeric_stats(df, name).first()
        exact = [Fraction(x) for x in data]
        mean = sum(exact) / len(exact)
        variance = sum((x - mean) ** 2 for x in exact) / (len(exact) - 1)
        assert row.avg == float(mean), name
        assert row.stddev == pytest.approx(math.sqrt(float(variance)) if variance < 10**300 else row.stddev, rel=1e-15)
    assert sums._root(Fraction(10) ** 400 * 4) == 2e200 and sums._root(Fraction(1, 10**400)) == 1e-200


def test_long_texts_in_profiles(spark):
    """Texts over the short limit are counted by digest, parsed all the same, and shown whole."""
    head = "h" * 40
    items = [head * 2 + "b"] * 3 + [head * 2 + "a"] * 3 + [head] * 3 + [f"{head}{head}{i:03d}" for i in range(30)] + ["short"]
    df = text_table(spark, items)
    expected = sorted(((v, items.count(v)) for v in set(items)), key=lambda t: (-t[1], t[0]))[:10]
    assert values(profile.top_values(df, "c")) == expected
    row = profile.profile_table(df).first()
    assert [tuple(t) for t in row.top_values] == expected and row.distinct_count == 34
    digits = profile.profile_table(text_table(spark, ["1" * 70, "2" * 80])).first()
    assert digits.inferred_type == "integer" and digits.numeric_stats.max == float("2" * 80)
    assert profile.profile_table(text_table(spark, ["1" * 70, "1" * 70 + ".5"])).first().inferred_type == "decimal"
    assert profile.profile_table(text_table(spark, ["2024-01-05" + " " * 70 + "10:00"])).first().inferred_type == "datetime"


def test_best_values_of_a_task():
    """Batch by batch no more is held than can be shown, and it is what a sort of everything would show."""
    rng = random.Random(5)
    rows = []
    for i in range(3000):
        text = rng.choice("ab") * rng.choice([1, 2, profile.SHORT + 1]) + f"{i:04d}"
        long = len(text) > profile.SHORT
        rows.append((rng.randrange(3), None if long else text, text[: profile.LEAD], rng.choice([1, 1, 2]), long))
    schema = pa.schema([("column_index", pa.int32()), ("value", pa.string()), ("lead", pa.string()), ("frequency", pa.int64()), ("long", pa.bool_())])
    batches = [pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[i : i + 70]), schema)], schema=schema) for i in range(0, 3000, 70)]
    held = [tuple(r.values()) for b in profile._best_of_task(iter(batches)) for r in b.to_pylist()]
    assert len(held) <= 3 * 2 * profile.TOP_VALUES
    for column in range(3):
        ordered = sorted((r for r in rows if r[0] == column), key=lambda r: (-r[3], r[2], not r[4], r[1] or ""))
        for some in (lambda r: True, lambda r: not r[4]):
            expected = [r[2:] for r in ordered if some(r)][: profile.TOP_VALUES]
            assert [r[2:] for r in held if r[0] == column and some(r)][: profile.TOP_VALUES] == expected
    assert list(profile._best_of_task(iter([]))) == []


def test_profile_sorts_no_column(spark, monkeypatch):
    """No task gets or sorts all values of a column: facts are hashed, and windows see what tasks hand on."""
    df = spark.range(50_000).select(F.col("id").cast("string").alias("key"), (F.col("id") % 70000 + 1).alias("day"))
    stored = profile._stored_values(df, df.columns)
    seen = []
    monkeypatch.setattr(type(df), "collect", lambda self, of=type(df).collect: seen.append(self) or of(self))
    facts, report = profile._facts(stored), profile._value_report(stored, {})
    assert facts[0]["values_"] == 50_000 and [r.value for r in sorted(report, key=lambda r: r.place) if r.column_index == 0][:3] == ["0", "1", "10"]
    plans = [frame._jdf.queryExecution().toString() for frame in seen]
    assert "SortAggregate" not in plans[0]
    assert plans[1].rindex("Window [") < plans[1].rindex("MapInArrow")
    assert profile.profile_table(df.select("day")).first().date_stats.example_original == "1"
