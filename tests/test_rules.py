import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from conftest import values
from sheetloom.operators import rules
from sheetloom.operators.rules import Rule, RuleError


def text_table(spark, items):
    return spark.createDataFrame(list(enumerate(items)), "_row_id bigint, c string")


def broken(spark, items, rule_type, **config):
    found = rules.violations(text_table(spark, items), Rule("r", "c", rule_type, "rule", config))
    return sorted(r._row_id for r in found.collect())


def test_date_rule(spark):
    written = ["28.02.2021", "28-02-2021", "2021-02-28", "29-02-2021", "7-3-99", "", None, "44255", "44255.0", "soon"]
    assert broken(spark, written, "date", format="DD-MM-YYYY") == [0, 2, 3, 7, 8, 9]
    assert broken(spark, written, "date", format="DD-MM-YYYY", accept_excel_serial=True) == [0, 2, 3, 8, 9]
    assert broken(spark, written, "date", format="YYYY-MM-DD") == [0, 1, 3, 4, 7, 8, 9]


def test_cell_rules(spark):
    assert broken(spark, [None, "", "  ", " ", "x"], "required") == [0, 1, 2, 3]
    assert broken(spark, ["a", " a", "b", "A", "", "", None], "unique") == [0, 1]
    assert broken(spark, ["abc", " abc ", "ab", "", "😀😀😀"], "length", value=3) == [2]
    assert broken(spark, ["1,5", "1d", "inf", "x", ""], "numeric") == [1, 3]
    assert broken(spark, ["1", "2", "3", "x", ""], "numeric_range", min=1, max=3) == [3]
    assert broken(spark, ["1", "2", "3", "x", ""], "numeric_range", min=1, max=3, inclusive=False) == [0, 2, 3]
    assert broken(spark, ["A", "b", " a ", "c", ""], "allowed_values", values=["a", " b "], ignore_case=True) == [3]
    assert broken(spark, ["x1", "1x\n", "1", ""], "regex", pattern=r"^\d") == [0]
    assert broken(spark, ["a\n", "a"], "regex", pattern="a$") == [0]
    assert broken(spark, ["529.982.247-25", "123", "11111111111", "abc", ""], "cpf") == [1, 2, 3]
    assert broken(spark, ["a@b.co", "a@b", None], "email") == [1]


def test_long_list_equals_short_list(spark):
    items = [str(i) for i in range(3000)] + ["x", "", None]
    allowed = [str(i) for i in range(0, 3000, 2)]
    assert broken(spark, items, "allowed_values", values=allowed) == [*range(1, 3000, 2), 3000]


@pytest.mark.parametrize("hot_values", [rules.HOT_VALUES, 2])
def test_repeated_rows_with_hot_values(spark, monkeypatch, hot_values):
    """Brute force over a column where one value fills a third of the rows."""
    monkeypatch.setattr(rules, "HOT_VALUES", hot_values)
    random.seed(3)
    items = ["hot" if random.random() < 0.33 else random.choice(["", None, " x ", "x", str(random.randint(0, 4000)), "y" * 400]) for _ in range(6000)]
    trimmed = [(v or "").strip() for v in items]
    counts = Counter(v for v in trimmed if v)
    expected = [i for i, v in enumerate(trimmed) if counts[v] > 1]
    assert broken(spark, items, "unique") == expected


def test_repeated_rows_plan_broadcasts_only_the_hot_list(spark):
    plan = rules.repeated_rows(text_table(spark, ["a", "a"]), "c")._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" in plan and "GlobalLimit 1000" in plan


def test_results_and_summary(spark):
    df = text_table(spark, ["1", "1", "x", "", "5"])
    checks = [
        Rule("u", "c", "unique", "once"),
        Rule("n", "c", "numeric", "number"),
        Rule("off", "c", "required", "given", enabled=False),
        Rule("bad", "c", "regex", "pattern", {"pattern": "("}),
        Rule("look", "c", "regex", "pattern", {"pattern": "(?=a)"}),
        Rule("what", "c", "no such type", "type"),
        Rule("list", "c", "allowed_values", "list", {"values": [" "]}),
        Rule("len", "c", "length", "length", {"mode": "between", "min": 1}),
        Rule("lost", "nowhere", "required", "column"),
    ]
    results = {r.rule_id: r for r in rules.rule_results(df, checks).collect()}
    assert [results[k].status for k in ("u", "n", "off", "bad", "look", "what", "list", "len", "lost")] == ["ok", "ok", "disabled"] + ["error"] * 6
    assert (results["u"].violation_count, results["u"].evaluated_rows, results["u"].violation_percentage) == (2, 4, 40.0)
    assert (results["n"].violation_count, results["n"].total_rows) == (1, 5)
    assert results["bad"].error and results["off"].violation_count == 0
    summary = rules.quality_summary(df, checks).first()
    assert (summary.total_rows, summary.problem_rows, summary.valid_rows, summary.score) == (5, 3, 2, 40.0)
    assert rules.quality_summary(df.limit(0), checks[:2]).first().score == 0.0


def test_rules_without_uniqueness_need_no_value_shuffle(spark):
    checks = [Rule("n", "c", "numeric", "number"), Rule("e", "c", "email", "mail"), Rule("r", "c", "required", "given")]
    plan = rules.rule_results(text_table(spark, ["1"]), checks)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan


def test_stored_rules(spark):
    rule = Rule.from_json("1", "c", "length", "name", '{"mode": "max", "value": 3}')
    assert rule.config["value"] == 3
    for arguments in ((" ", "length", "n", "{}"), ("c", "length", " ", "{}"), ("c", "length", "n", "{"), ("c", "length", "n", "[]")):
        with pytest.raises(RuleError):
            Rule.from_json("1", *arguments)
    assert [r.column for r in rules.rename_rules([rule, Rule("2", "d", "required", "x")], "c", "e")] == ["e", "d"]


@pytest.mark.parametrize(
    "pattern, text, matches",
    [("a$", "a", True), ("[[]x", "[x", True), ("[a&&b]", "&", True), ("(?P<n>a)", "a", True), (r"\$", "$", True), ("[$]", "$", True), ("[[:digit:]]", "7", True), ("[]a]", "]", True), ("a.b", "a\rb", True), ("a.b", "a\nb", False)],
)
def test_patterns(spark, pattern, text, matches):
    assert spark.range(1).select(F.lit(text).rlike(rules.java_pattern(pattern)).alias("m")).first().m is matches


@pytest.mark.parametrize("pattern", ["(?=a)", "(?!a)", "(?<=a)b", "(?<!a)b", r"(a)\1", " "])
def test_refused_patterns(pattern):
    with pytest.raises(RuleError):
        rules.java_pattern(pattern)


def test_values_keep_whole_texts(spark):
    long_a, long_b = "a" * 5000 + "1", "a" * 5000 + "2"
    assert broken(spark, [long_a, long_b, long_a], "unique") == [0, 2]
    assert values(rules.repeated_rows(text_table(spark, [long_a, long_b, long_a]), "c").orderBy("_row_id"), "c") == [(long_a,), (long_a,)]
