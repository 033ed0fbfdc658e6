"""Text form of cells, blanks, and the text predicates built on them.

All functions are built-in Column expressions, so they stay inside generated JVM code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

# The Unicode space separators that a trim removes (tab, newline and zero-width space stay).
SPACE_SEPARATORS = "\u0020\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def quote(name: str) -> str:
    """A column name as a Spark identifier; needed for names with dots, blanks or backticks."""
    return "`" + name.replace("`", "``") + "`"


def cell(name: str) -> Column:
    return F.col(quote(name))


def sql_literal(value: str) -> str:
    """A SQL string literal for generated expressions."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _floating_text(c: Column) -> Column:
    """Plain decimal notation from 1e-4 up to 1e16 and a two-digit exponent outside, instead of Java's ``1.0E7``."""
    java = c.cast("string")
    mantissa = F.regexp_replace(F.substring_index(java, "E", 1), r"\.0$", "")
    exponent = F.substring_index(java, "E", -1)
    digits = F.ltrim(exponent, F.lit("-"))
    sign = F.when(exponent.startswith("-"), "-").otherwise("+")
    padded = F.concat(sign, F.when(F.length(digits) < 2, F.lpad(digits, 2, "0")).otherwise(digits))
    size = F.abs(c)
    return (
        F.when(((size >= 1e-3) & (size < 1e7)) | (size == 0), java)
        .when(F.isnan(c), F.lit("nan"))
        .when(java == "Infinity", F.lit("inf"))
        .when(java == "-Infinity", F.lit("-inf"))
        .when(
            (size >= 1e7) & (size < 1e16),
            F.regexp_replace(java.try_cast("decimal(38,10)").cast("string"), r"(\.[0-9]*?[1-9]|\.0)0*$", "$1"),
        )
        .when(
            (size >= 1e-4) & (size < 1e-3),
            F.regexp_replace(java.try_cast("decimal(38,24)").cast("string"), r"0+$", ""),
        )
        .otherwise(F.concat(mantissa, F.lit("e"), padded))
    )


def as_text(c: Column, data_type: T.DataType) -> Column:
    """The text a grid shows for a cell: ISO text for temporal values, JSON for nested ones, sizes for binary."""
    if isinstance(data_type, (T.StringType, T.VarcharType, T.CharType)):
        return c
    if isinstance(data_type, (T.FloatType, T.DoubleType)):
        return _floating_text(c)
    if isinstance(data_type, T.BinaryType):
        return F.concat(F.lit("<"), F.octet_length(c).cast("string"), F.lit(" bytes>"))
    if isinstance(data_type, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(c)
    return c.cast("string")


def text_of(df: DataFrame, name: str) -> Column:
    return as_text(cell(name), df.schema[name].dataType)


def text_view(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """The same rows with every column as text, except the ``keep`` columns (row ids)."""
    return df.select(*[cell(f.name) if f.name in keep else as_text(cell(f.name), f.dataType).alias(f.name) for f in df.schema])


def trimmed(text: Column) -> Column:
    """Text without outer spaces. All-ASCII text, recognised by its byte length, takes the much faster plain trim."""
    return F.when(F.octet_length(text) == F.length(text), F.trim(text)).otherwise(F.btrim(text, F.lit(SPACE_SEPARATORS)))


def value_of(df: DataFrame, name: str) -> Column:
    """Trimmed text of a cell; only text columns can have anything to trim."""
    text = text_of(df, name)
    return trimmed(text) if isinstance(df.schema[name].dataType, T.StringType) else text


def blank(text: Column) -> Column:
    """True for NULL and for text of spaces only; never NULL."""
    return text.isNull() | (trimmed(text) == "")


def blank_cell(df: DataFrame, name: str) -> Column:
    """Whether a cell is blank; outside text columns only NULL is, which needs no text at all."""
    return blank(cell(name)) if isinstance(df.schema[name].dataType, T.StringType) else cell(name).isNull()


def contains_ignoring_case(text: Column, needle: str) -> Column:
    """``%`` and ``_`` in the needle stay wildcards; a backslash is an ordinary character."""
    pattern = "%" + needle.lower().replace("\\", "\\\\") + "%"
    return F.lower(F.coalesce(text, F.lit(""))).like(pattern)


def bounded_key(value: Column, longest: int = 256) -> Column:
    """A grouping key of at most a few hundred characters that is equal exactly when the texts are equal.

    Long texts shuffle as a SHA-256 digest. The leading length keeps short texts and digests apart.
    """
    size = F.length(value)
    return F.concat(size.cast("string"), F.lit(":"), F.when(size <= longest, value).otherwise(F.sha2(value, 256)))
