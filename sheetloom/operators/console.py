"""Read-only SQL over documents under their logical names."""

from __future__ import annotations

import re
from collections.abc import Iterable
from contextlib import contextmanager
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from sheetloom.functions.text import cell, quote
from sheetloom.operators.grid import ROW_ID
from sheetloom.sources.headers import unique_names

CURRENT_DOCUMENT = "documento"
TABULAR, DIRECT = ("select", "with"), ("show", "describe", "explain")
# The present context of each session: its document names, each with the view of the session's owner that it hides, if there is one.
_OPEN: WeakKeyDictionary[SparkSession, dict[str, DataFrame | None]] = WeakKeyDictionary()
# Plan nodes that read nothing: rows written in the query, and references to its own WITH clauses.
HARMLESS = {"OneRowRelation", "LocalRelation", "CTERelationRef", "Range", "EmptyRelation", "UnionLoopRef"}
QUOTED_NAMES = "spark.sql.ansi.doubleQuotedIdentifiers"


class QueryError(ValueError):
    """A query or context that is refused before it runs."""


def read_only(query: str) -> str:
    """The query without closing semicolons; anything but one reading statement is refused."""
    sql = query.strip().rstrip(";").strip()
    if not sql:
        raise QueryError("the query is empty")
    if ";" in sql:
        raise QueryError("one query at a time")
    if sql.split()[0].lower() not in TABULAR + DIRECT:
        raise QueryError("only SELECT, WITH, SHOW, DESCRIBE and EXPLAIN are allowed")
    return sql


def ambiguous_names(names: Iterable[str]) -> list[str]:
    """Logical names that occur again once trimmed and lower-cased."""
    seen, again = set(), set()
    for name in names:
        key = name.strip().lower()
        if key in seen:
            again.add(name)
        seen.add(key)
    return sorted(again)


def _view(df: DataFrame, name: str) -> None:
    df.select(*[cell(c) for c in df.columns if c != ROW_ID]).createOrReplaceTempView(quote(name))


def _open(spark: SparkSession, documents: Iterable[tuple[str, DataFrame]]) -> None:
    """Make these documents known and no others: views of the context before go, and views of the session's owner that they hid come back."""
    for name, hidden in _OPEN.pop(spark, {}).items():
        if hidden is None:
            spark.catalog.dropTempView(name)
        else:
            hidden.createOrReplaceTempView(quote(name))
    _OPEN[spark] = {}
    temporary = {t.name.lower() for t in spark.catalog.listTables() if t.isTemporary}
    for name, df in documents:
        known = {n.lower() for n in _OPEN[spark]}
        _OPEN[spark][name] = spark.table(quote(name)) if name.lower() in temporary and name.lower() not in known else None
        _view(df, name)


def _children(node) -> list:
    seqs = (node.children(), node.subqueries())
    return [s.apply(i) for s in seqs for i in range(s.size())]


def _strangers(spark: SparkSession, result: DataFrame) -> list[str]:
    """What a query reads besides documents of the context, from its analysed plan; views of documents are not looked into."""
    known = {n.lower() for n in _OPEN.get(spark, {})}
    found, todo = [], [result._jdf.queryExecution().analyzed()]
    while todo:
        node = todo.pop()
        kind = node.nodeName().split(" ")[0]
        if kind == "View":
            name = node.desc().identifier()
            if name.database().isDefined() or name.table().lower() not in known:
                found.append(name.unquotedString())
            continue
        below = _children(node)
        if not below and kind not in HARMLESS:
            found.append(node.simpleStringWithNodeId()[:100])
        todo += below
    return found


def _allowed(spark: SparkSession, result: DataFrame) -> DataFrame:
    strangers = _strangers(spark, result)
    if strangers:
        raise QueryError(f"the query reads what is no document here: {'; '.join(sorted(strangers)[:3])}")
    return result


def _direct(spark: SparkSession, sql: str) -> DataFrame:
    """SHOW, DESCRIBE and EXPLAIN, about documents of the context only."""
    known = {n.lower() for n in _OPEN.get(spark, {})}
    head, _, rest = sql.partition(" ")
    if head.lower() == "explain":
        _allowed(spark, spark.sql(re.sub(r"(?i)^\s*(extended|codegen|cost|formatted)\b", "", rest)))
        return spark.sql(sql)
    named = re.findall(r"Unresolved\w* \[([^\]]*)\]", spark._jsparkSession.sessionState().sqlParser().parsePlan(sql).toString())
    if head.lower() == "show":
        if not re.match(r"(?i)show\s+(tables|views)\b", sql):
            raise QueryError("only SHOW TABLES and SHOW VIEWS are allowed")
        shown = spark.sql(sql)
        column = next(c for c in shown.columns if c.lower() in ("tablename", "viewname"))
        return shown.where(F.lower(column).isin(*known))
    if not named or any(n.lower() not in known for n in named):
        raise QueryError("only documents can be described")
    return spark.sql(sql)


def document_context(df: DataFrame, name: str) -> None:
    """Make one document known as ``documento`` and under its own name; documents of an earlier context are known no longer."""
    _open(df.sparkSession, [(CURRENT_DOCUMENT, df), (name, df)])


def workspace_context(documents: Iterable[tuple[str, DataFrame]]) -> None:
    """Make every document known under its name, and no others; views are lazy, so unused ones cost nothing."""
    documents = list(documents)
    again = ambiguous_names(name for name, _ in documents)
    if again:
        raise QueryError(f"duplicate document names: {', '.join(again)}")
    if documents:
        _open(documents[0][1].sparkSession, documents)


@contextmanager
def _quoted_names(spark: SparkSession):
    before = spark.conf.get(QUOTED_NAMES)
    spark.conf.set(QUOTED_NAMES, "true")
    try:
        yield
    finally:
        spark.conf.set(QUOTED_NAMES, before)


def run_query(spark: SparkSession, query: str) -> DataFrame:
    """The result as a lazy DataFrame; page, filter and profile it like any other table.

    SELECT and WITH are analysed as a sub-query, where the grammar allows no writing statement, and refused if the analysed plan reads anything but documents of
    the context: files, tables of the catalog and views of others. Double quotes enclose names. Columns of one name, as a join of two tables has them, are
    told apart by a number.
    """
    sql = read_only(query)
    with _quoted_names(spark):
        if sql.split()[0].lower() in TABULAR:
            result = _allowed(spark, spark.sql(f"SELECT * FROM (\n{sql}\n) AS console_query"))
            repeats = len({c.lower() for c in result.columns}) < len(result.columns)
            return result.toDF(*unique_names(result.columns)) if repeats else result
        return _direct(spark, sql)


def result_schema(spark: SparkSession, query: str) -> T.StructType:
    """Columns and types of a query from its analysis alone; nothing runs."""
    return run_query(spark, query).schema
