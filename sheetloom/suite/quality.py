"""Quality rules, their results, and the rows that break them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sheetloom.operators import grid, rules
from sheetloom.operators.rules import Rule
from sheetloom.suite import query
from sheetloom.suite.inputs import DIRTY_ORDERS, dirty_orders, empty, number, serial, table, v
from pyspark.sql import functions as F

PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM"]
# Fixed value: what counts as an address.
EMAIL = r"^[A-Za-z0-9.!#$%&''*+/=?^_`{|}~-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+$"

# Both check digits from the definition with ascending weights: the weighted sum modulo 11, where ten counts as zero.
CPF_BROKEN = f"""(select len(d) <> 11 or len(list_distinct(d)) = 1
    or list_sum(list_transform(d[1:9], lambda x, i: x * i)) % 11 % 10 <> d[10]
    or list_sum(list_transform(d[1:10], lambda x, i: x * (i - 1))) % 11 % 10 <> d[11]
    from (select list_transform(regexp_extract_all({v("tax_id")}, '[0-9]'), lambda x: cast(x as integer)) as d))"""


def _strict(c: str, pattern: str) -> str:
    return f"try_strptime({v(c)}, '{pattern}') is not null"


# Rule -> SQL for "the filled value breaks it".
RULES: list[tuple[Rule, str]] = [
    (Rule("required", "priority", "required", "priority given"), "blank"),
    (Rule("unique", "tax_id", "unique", "tax id once"), "repeated"),
    (Rule("length_exact", "tax_id", "length", "11 characters", {"value": 11}), f"length({v('tax_id')}) <> 11"),
    (Rule("length_min", "priority", "length", "6 or more", {"mode": "min", "value": 6}), f"length({v('priority')}) < 6"),
    (Rule("length_max", "priority", "length", "6 or less", {"mode": "max", "value": 6}), f"length({v('priority')}) > 6"),
    (Rule("length_between", "price_text", "length", "7 to 8", {"mode": "between", "min": 7, "max": 8}), f"(length({v('price_text')}) < 7 or length({v('price_text')}) > 8)"),
    (Rule("numeric", "price_text", "numeric", "a number"), f"{number(v('price_text'))} is null"),
    (
        Rule("range_inclusive", "price_text", "numeric_range", "in range", {"min": 100000, "max": 300000}),
        f"({number(v('price_text'))} is null or {number(v('price_text'))} < 100000 or {number(v('price_text'))} > 300000)",
    ),
    (
        Rule("range_exclusive", "serial_text", "numeric_range", "inside", {"min": 7, "max": 70000, "inclusive": False}),
        f"({number(v('serial_text'))} is null or {number(v('serial_text'))} <= 7 or {number(v('serial_text'))} >= 70000)",
    ),
    (
        Rule("allowed", "priority", "allowed_values", "known", {"values": PRIORITIES}),
        f"{v('priority')} not in ({', '.join(repr(p) for p in PRIORITIES)})",
    ),
    (
        Rule("allowed_any_case", "flag", "allowed_values", "yes or no", {"values": ["SIM", " nao ", ""], "ignore_case": True}),
        f"lower({v('flag')}) not in ('sim', 'nao')",
    ),
    (Rule("regex", "priority", "regex", "digit first", {"pattern": "^[1-3]-[A-Z]+$"}), f"not regexp_matches({v('priority')}, '^[1-3]-[A-Z]+$')"),
    (Rule("date_default", "day_text", "date", "day first"), f"not ({_strict('day_text', '%d/%m/%Y')})"),
    (Rule("date_iso", "day_text", "date", "ISO", {"format": "YYYY-MM-DD"}), f"not ({_strict('day_text', '%Y-%m-%d')})"),
    (
        Rule("date_serial", "serial_text", "date", "serial", {"format": "YYYY/MM/DD", "accept_excel_serial": True}),
        f"not ({_strict('serial_text', '%Y/%m/%d')} or {serial(v('serial_text'))})",
    ),
    (Rule("email", "email", "email", "address"), f"not regexp_matches({v('email')}, '{EMAIL}')"),
    (Rule("cpf", "tax_id", "cpf", "tax id"), CPF_BROKEN),
]


def _broken(rule: Rule, sql: str) -> str:
    if sql == "blank":
        return empty(rule.column)
    filled = f"not {empty(rule.column)}"
    if sql == "repeated":
        c = rule.column
        return f"({filled} and {v(c)} in (select {v(c)} from dirty where not {empty(c)} group by 1 having count(*) > 1))"
    return f"({filled} and {sql})"


def _rule_query(rule: Rule, sql: str):
    def run(spark: SparkSession, folder: str) -> DataFrame:
        found = rules.violations(dirty_orders(spark, folder), rule)
        return found.select("row_id", F.col(rule.column).alias("value"))

    run.__name__ = f"rule_{rule.rule_id}"
    return query(f"with {DIRTY_ORDERS} select row_id, {rule.column} as value from dirty where {_broken(rule, sql)}")(run)


for _rule, _sql in RULES:
    _rule_query(_rule, _sql)


@query(
    f"""with {DIRTY_ORDERS} select rule_id, total_rows, evaluated_rows, violation_count,
    round(violation_count * 100.0 / total_rows, 6) as violation_percentage, 'ok' as status from ("""
    + " union all ".join(
        f"select '{r.rule_id}' as rule_id, count(*) as total_rows, "
        f"{'count(*)' if r.rule_type == 'required' else f'count(*) filter (not {empty(r.column)})'} as evaluated_rows, "
        f"(select count(*) from dirty where {_broken(r, s)}) as violation_count from dirty"
        for r, s in RULES
    )
    + ")"
)
def rule_results_all(spark: SparkSession, folder: str) -> DataFrame:
    results = rules.rule_results(dirty_orders(spark, folder), [r for r, _ in RULES])
    share = F.round("violation_percentage", 6).alias("violation_percentage")
    return results.select("rule_id", "total_rows", "evaluated_rows", "violation_count", share, "status")


def _summary_sql(columns) -> str:
    return " union all ".join(
        f"""select '{c}' as column_name, count(*) as total_rows, count(*) filter (broken) as problem_rows,
        count(*) - count(*) filter (broken) as valid_rows, round((count(*) - count(*) filter (broken)) * 100.0 / count(*), 6) as score
        from (select ({' or '.join(f'coalesce({_broken(r, s)}, false)' for r, s in RULES if r.column == c)}) as broken from dirty)"""
        for c in columns
    )


@query(f"with {DIRTY_ORDERS} {_summary_sql(dict.fromkeys(r.column for r, _ in RULES))}")
def quality_summary(spark: SparkSession, folder: str) -> DataFrame:
    summary = rules.quality_summary(dirty_orders(spark, folder), [r for r, _ in RULES])
    return summary.withColumnRenamed("column", "column_name").withColumn("score", F.round("score", 6))


@query(
    """select count(*) as total_rows, sum(n)::bigint as violation_count from (select count(*) as n from documents
    where trim(text) <> '' group by trim(text) having count(*) > 1), (select count(*) as total from documents) group by total"""
    .replace("select count(*) as total_rows", "select total as total_rows")
)
def unique_document_text(spark: SparkSession, folder: str) -> DataFrame:
    rule = Rule("text", "text", "unique", "text once")
    return rules.rule_results(table(spark, folder, "documents"), [rule]).select("total_rows", "violation_count")


@query("select doc_id from documents where trim(text) in (select trim(text) from documents where trim(text) <> '' group by 1 having count(*) > 1)")
def unique_document_rows(spark: SparkSession, folder: str) -> DataFrame:
    return rules.violations(table(spark, folder, "documents"), Rule("text", "text", "unique", "text once")).select("doc_id")


@query(
    f"""with {DIRTY_ORDERS} select row_id, price_text from dirty where not {empty('price_text')} and {number(v('price_text'))} is null
    order by row_id limit 100 offset 50"""
)
def violations_page(spark: SparkSession, folder: str) -> DataFrame:
    rule = Rule("numeric", "price_text", "numeric", "a number")
    orders = dirty_orders(spark, folder)
    broken = grid.filter_rows(orders, [grid.Filter("price_text", "quality_violation", rule_id="numeric")], [rule], "row_id")
    return grid.page_rows(broken, None, 50, 100, "row_id").select("row_id", "price_text")
