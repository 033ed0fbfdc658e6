"""Column quality rules.

A rule becomes a violation predicate over the trimmed text of a cell. All rules of a table are counted in one scan; a
uniqueness rule adds one shuffle of bounded keys, and its counts come from the groups themselves, without a join back.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sheetloom.functions.dates import DEFAULT_FORMAT, is_serial, parse_format
from sheetloom.functions.identifiers import valid_cpf, valid_email
from sheetloom.functions.numbers import parse_double
from sheetloom.functions.text import blank, bounded_key, cell, text_of, trimmed, value_of
from sheetloom.plans.fused import any_of, passes, spread, union_all, unpack
from sheetloom.session import ensure_checkpoint_dir

HOT_VALUES = 1000
LISTED_VALUES = 1000


class RuleError(ValueError):
    """A rule that cannot be turned into a predicate."""


@dataclass(frozen=True)
class Rule:
    rule_id: str
    column: str
    rule_type: str
    name: str
    config: dict = field(default_factory=dict)
    enabled: bool = True

    @staticmethod
    def from_json(rule_id: str, column: str, rule_type: str, name: str, configuration: str, enabled: bool = True) -> "Rule":
        """A rule from stored text; a blank column, a blank name or text that is no JSON object is refused."""
        if not column.strip():
            raise RuleError("the rule names no column")
        if not name.strip():
            raise RuleError("the rule has no name")
        try:
            config = json.loads(configuration)
        except json.JSONDecodeError as error:
            raise RuleError(f"the rule configuration is not JSON: {error}") from error
        if not isinstance(config, dict):
            raise RuleError("the rule configuration is not a JSON object")
        return Rule(rule_id, column, rule_type, name, config, enabled)


def rename_rules(rules: Sequence[Rule], old: str, new: str) -> list[Rule]:
    """Rules follow a renamed column."""
    return [replace(rule, column=new) if rule.column == old else rule for rule in rules]


# --- predicates ----------------------------------------------------------------------------------------------------


def _required(config: dict, name: str):
    if config.get(name) is None:
        raise RuleError(f"the rule needs '{name}'")
    return config[name]


def _wrong_length(value: Column, config: dict) -> Column:
    size, mode = F.length(value), config.get("mode", "exact")
    if mode == "between":
        return ~size.between(_required(config, "min"), _required(config, "max"))
    limit = _required(config, "value")
    return size < limit if mode == "min" else size > limit if mode == "max" else size != limit


def _out_of_range(value: Column, config: dict) -> Column:
    low, high = float(_required(config, "min")), float(_required(config, "max"))
    number = parse_double(value)
    outside = (number < low) | (number > high) if config.get("inclusive", True) else (number <= low) | (number >= high)
    return number.isNull() | outside


def _listed(config: dict) -> list[str]:
    values = [v.strip() for v in config.get("values", []) if v.strip()]
    if not values:
        raise RuleError("the rule needs at least one allowed value")
    return [v.lower() for v in values] if config.get("ignore_case") else values


def _not_listed(value: Column, config: dict) -> Column:
    return ~(F.lower(value) if config.get("ignore_case") else value).isin(*_listed(config))


def java_pattern(pattern: str) -> str:
    """A linear-time regular expression in Java's dialect.

    Only ``\\n`` ends a line, ``$`` is the end of the text, brackets nest nothing, and look-around or back references,
    which have no linear-time meaning, are refused.
    """
    if not pattern.strip():
        raise RuleError("the rule needs a pattern")
    out, in_class, i = [], False, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\" and i + 1 < len(pattern):
            if pattern[i + 1] in "123456789k" and not in_class:
                raise RuleError("back references are not supported")
            out.append(pattern[i : i + 2])
            i += 2
            continue
        if in_class:
            opens_named_class = c == "[" and pattern.startswith("[:", i)
            if opens_named_class:
                end = pattern.find(":]", i)
                out.append("\\p{" + pattern[i + 2 : end].capitalize() + "}")
                i = end + 2
                continue
            in_class = c != "]"
            out.append("\\" + c if c in "[&" else c)
        elif c == "[":
            in_class = True
            out.append(c)
            for mark in ("^", "]"):
                if pattern.startswith(mark, i + 1):
                    out.append(mark if mark == "^" else "\\]")
                    i += 1
        elif c == "$" and "(?m" not in pattern:
            out.append("\\z")
        elif c == "(" and pattern.startswith("(?", i):
            head = pattern[i : i + 4]
            if head.startswith(("(?=", "(?!", "(?<=", "(?<!", "(?>")):
                raise RuleError("look-around is not supported")
            if head.startswith("(?P<"):
                out.append("(?<")
                i += 4
                continue
            out.append(c)
        else:
            out.append(c)
        i += 1
    return "(?d)" + "".join(out)


def _no_match(value: Column, config: dict) -> Column:
    return ~value.rlike(java_pattern(config.get("pattern", "")))


def _no_date(value: Column, config: dict) -> Column:
    accepted = parse_format(value, config.get("format", DEFAULT_FORMAT)).isNotNull()
    return ~(accepted | is_serial(value)) if config.get("accept_excel_serial") else ~accepted


# Predicates on a filled value, by rule type.
_PREDICATES = {
    "length": _wrong_length,
    "numeric": lambda value, config: parse_double(value).isNull(),
    "numeric_range": _out_of_range,
    "allowed_values": _not_listed,
    "regex": _no_match,
    "date": _no_date,
    "email": lambda value, config: ~valid_email(value),
    "cpf": lambda value, config: ~valid_cpf(value),
}
RULE_TYPES = ("required", "unique", *_PREDICATES)


def broken_value(rule: Rule, value: Column) -> Column:
    """The violation predicate of a rule that looks at one cell only, over its trimmed text; never NULL."""
    if rule.rule_type == "required":
        return value.isNull() | (value == "")
    if rule.rule_type not in _PREDICATES:
        raise RuleError(f"rule type '{rule.rule_type}' has no predicate on a single cell")
    return F.coalesce((value != "") & _PREDICATES[rule.rule_type](value, rule.config), F.lit(False))


def violation(rule: Rule, text: Column) -> Column:
    """The same predicate over the untrimmed text."""
    return broken_value(rule, trimmed(text))


def _check_runnable(spark: SparkSession, rule: Rule) -> None:
    """Refuse a broken rule before the scan, so that it cannot fail the others."""
    if rule.rule_type not in RULE_TYPES:
        raise RuleError(f"unknown rule type '{rule.rule_type}'")
    if rule.rule_type == "unique":
        return
    probe = broken_value(rule, F.lit("x"))
    if rule.rule_type == "regex":
        try:
            spark.range(1).select(probe).first()
        except Exception as error:
            raise RuleError(f"invalid pattern: {rule.config.get('pattern')}") from error


# --- violating rows ------------------------------------------------------------------------------------------------


def repeated_keys(df: DataFrame, column: str) -> DataFrame:
    """``(repeated_key, occurrences)`` of filled values that occur more than once."""
    value = trimmed(text_of(df, column))
    keys = df.where(value != "").select(bounded_key(value).alias("repeated_key"))
    return keys.groupBy("repeated_key").agg(F.count("*").alias("occurrences")).where("occurrences > 1")


def repeated_rows(df: DataFrame, column: str) -> DataFrame:
    """All rows whose filled value occurs more than once.

    The repeated keys are found first and checkpointed, so that later steps do not group the table again. The most frequent
    ones are looked up in a broadcast list of at most ``HOT_VALUES`` short keys, so no task ever receives all copies of a hot
    value. Every other value holds less than one row in ``HOT_VALUES`` and is found by a semi join.
    """
    ensure_checkpoint_dir(df.sparkSession)
    repeated = repeated_keys(df, column).checkpoint()
    hot = repeated.orderBy(F.col("occurrences").desc(), "repeated_key").limit(HOT_VALUES).select("repeated_key", F.lit(True).alias("is_hot"))
    value = trimmed(text_of(df, column))
    keyed = df.withColumn("repeated_key", F.when(value != "", bounded_key(value))).where("repeated_key IS NOT NULL")
    marked = keyed.join(F.broadcast(hot), "repeated_key", "left")
    frequent = marked.where("is_hot")
    others = marked.where("is_hot IS NULL").join(repeated, "repeated_key", "left_semi")
    columns = [cell(name) for name in df.columns]
    return frequent.select(*columns).unionByName(others.select(*columns))


def violations(df: DataFrame, rule: Rule) -> DataFrame:
    """The rows that break a rule."""
    if rule.rule_type == "unique":
        return repeated_rows(df, rule.column)
    if rule.rule_type == "allowed_values" and len(_listed(rule.config)) > LISTED_VALUES:
        return _rows_not_listed(df, rule)
    return df.where(violation(rule, text_of(df, rule.column)))


def _rows_not_listed(df: DataFrame, rule: Rule) -> DataFrame:
    """Long lists become an anti join; the planner broadcasts the list when its size allows."""
    value = trimmed(text_of(df, rule.column))
    allowed = df.sparkSession.createDataFrame([(v,) for v in _listed(rule.config)], "allowed_value string").distinct()
    looked_up = F.lower(value) if rule.config.get("ignore_case") else value
    return df.where(~blank(text_of(df, rule.column))).join(allowed, looked_up == F.col("allowed_value"), "left_anti")


# --- counts --------------------------------------------------------------------------------------------------------


def _result(rule: Rule, status: str, total: Column, evaluated: Column, count: Column, error: str | None = None) -> Column:
    share = F.when(total == 0, F.lit(0.0)).otherwise(count / total * F.lit(100.0))
    return F.struct(
        F.lit(rule.column).alias("column"),
        F.lit(rule.rule_id).alias("rule_id"),
        F.lit(rule.name).alias("rule_name"),
        F.lit(rule.rule_type).alias("rule_type"),
        total.alias("total_rows"),
        evaluated.alias("evaluated_rows"),
        count.alias("violation_count"),
        share.alias("violation_percentage"),
        F.lit(status).alias("status"),
        F.lit(error).cast("string").alias("error"),
    )


def _values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Trimmed text of the given columns under positional names, so that predicates refer to it without repeating it."""
    return df.select(*[value_of(df, name).alias(f"v{i}") for i, name in enumerate(columns)])


def _group_counts(df: DataFrame, column: str, rules: Sequence[Rule]) -> DataFrame:
    """One row of counts for a column with a uniqueness rule, from groups of equal values.

    Equal values break the same rules, so group sizes are enough: a group breaks ``unique`` when it has two rows.
    """
    value = F.col("v0")
    plain = {id(rule): broken_value(rule, value) for rule in rules if rule.rule_type != "unique"}
    marked = _values(df, [column]).select(
        F.when(value != "", bounded_key(value)).alias("group_key"),
        any_of(plain.values()).alias("is_broken"),
        *[predicate.alias(f"is_broken_{i}") for i, predicate in enumerate(plain.values())],
    )
    groups = marked.groupBy("group_key").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("is_broken").alias("broken"),
        *[F.count_if(f"is_broken_{i}").alias(f"broken_{i}") for i in range(len(plain))],
    )
    filled = F.when(F.col("group_key").isNotNull(), F.col("n")).otherwise(0)
    repeated = F.when(F.col("group_key").isNotNull() & (F.col("n") > 1), F.col("n"))
    position = {key: i for i, key in enumerate(plain)}
    each = [repeated if rule.rule_type == "unique" else F.col(f"broken_{position[id(rule)]}") for rule in rules]

    def total(c: Column, name: str) -> Column:
        return F.coalesce(F.sum(c), F.lit(0)).alias(name)

    return groups.agg(
        total(F.col("n"), "total"),
        total(filled, "filled_0"),
        total(F.coalesce(repeated, F.col("broken")), "problems_0"),
        *[total(c, f"counts_0_{i}") for i, c in enumerate(each)],
    )


def _counted(df: DataFrame, by_column: dict[str, list[Rule]]) -> list[tuple[DataFrame, dict[str, int]]]:
    """One-row frames of counts: one per uniqueness column, one per pass for all other columns together."""
    frames: list[tuple[DataFrame, dict[str, int]]] = []
    plain = [c for c, rules in by_column.items() if all(r.rule_type != "unique" for r in rules)]
    for part in passes(plain):
        marks, aggregates = [], [F.count(F.lit(1)).alias("total")]
        for tag, column in enumerate(part):
            value = F.col(f"v{tag}")
            predicates = [broken_value(rule, value) for rule in by_column[column]]
            marks += [p.alias(f"m_{tag}_{i}") for i, p in enumerate(predicates)]
            marks.append((value != "").alias(f"f_{tag}"))
            names = [f"m_{tag}_{i}" for i in range(len(predicates))]
            aggregates += [F.count_if(n).alias(n.replace("m_", "counts_")) for n in names]
            aggregates.append(F.count_if(f"f_{tag}").alias(f"filled_{tag}"))
            aggregates.append(F.count_if(any_of([F.col(n) for n in names])).alias(f"problems_{tag}"))
        frames.append((_values(spread(df), part).select(*marks).agg(*aggregates), {column: tag for tag, column in enumerate(part)}))
    for column, rules in by_column.items():
        if column not in plain:
            frames.append((_group_counts(spread(df), column, rules), {column: 0}))
    return frames


def _usable(df: DataFrame, rules: Sequence[Rule]) -> tuple[dict[str, list[Rule]], dict[int, str]]:
    usable: dict[str, list[Rule]] = {rule.column: [] for rule in rules}
    errors: dict[int, str] = {}
    for rule in rules:
        if not rule.enabled:
            continue
        try:
            if rule.column not in df.columns:
                raise RuleError(f"no column '{rule.column}'")
            _check_runnable(df.sparkSession, rule)
            usable[rule.column].append(rule)
        except RuleError as error:
            errors[id(rule)] = str(error)
    return {c: r for c, r in usable.items() if c in df.columns}, errors


def rule_results(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """One row per rule: evaluated rows, violations and their share of all rows, status ``ok``, ``error`` or ``disabled``."""
    by_column, errors = _usable(df, rules)
    zero = F.lit(0).cast("bigint")
    out = []
    for frame, tags in _counted(df, by_column):
        structs = []
        for column, tag in tags.items():
            total, filled = F.col("total"), F.col(f"filled_{tag}")
            for i, rule in enumerate(by_column[column]):
                evaluated = total if rule.rule_type == "required" else filled
                structs.append(_result(rule, "ok", total, evaluated, F.col(f"counts_{tag}_{i}")))
            for rule in rules:
                if rule.column == column and not rule.enabled:
                    structs.append(_result(rule, "disabled", total, zero, zero))
                elif rule.column == column and id(rule) in errors:
                    structs.append(_result(rule, "error", total, zero, zero, errors[id(rule)]))
        if structs:
            out.append(unpack(frame, structs))
    lost = [r for r in rules if r.column not in by_column]
    if lost:
        structs = [_result(r, "error" if r.enabled else "disabled", F.col("total"), zero, zero, errors.get(id(r))) for r in lost]
        out.append(unpack(df.agg(F.count(F.lit(1)).alias("total")), structs))
    return union_all(out)


def quality_summary(df: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """One row per column with rules: rows that break at least one enabled rule, the rest, and the share of the rest."""
    by_column, _ = _usable(df, rules)
    out = []
    for frame, tags in _counted(df, by_column):
        structs = []
        for column, tag in tags.items():
            total, problems = F.col("total"), F.col(f"problems_{tag}")
            valid = total - problems
            structs.append(
                F.struct(
                    F.lit(column).alias("column"),
                    total.alias("total_rows"),
                    problems.alias("problem_rows"),
                    valid.alias("valid_rows"),
                    F.when(total == 0, F.lit(0.0)).otherwise(valid / total * F.lit(100.0)).alias("score"),
                )
            )
        out.append(unpack(frame, structs))
    return union_all(out)
