"""What counts as missing, and numbers read from text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Text cells that count as missing, whatever their case.
MISSING_TOKENS = ("", "nan", "none", "null", "na", "n/a")
# Text cells that read as yes and no when a column is typed.
TRUE_TOKENS = ("true", "yes", "1", "t", "y", "on")
FALSE_TOKENS = ("false", "no", "0", "f", "n", "off")
# Text cells that become 1 and 0 in a matrix of features; others are refused there.
ONE_TOKENS = ("yes", "true", "1", "y")
ZERO_TOKENS = ("no", "false", "0", "n")

_NUMBER = r"(?i)^\s*[+-]?((\d+(_\d+)*(\.(\d+(_\d+)*)?)?|\.\d+(_\d+)*)(e[+-]?\d+(_\d+)*)?|inf(inity)?|nan)\s*$"
_NAN = r"(?i)^\s*[+-]?nan\s*$"


def is_numeric_type(kind: T.DataType) -> bool:
    return isinstance(kind, (T.NumericType, T.BooleanType))


def is_missing(column: Column, kind: T.DataType) -> Column:
    """Null, NaN, or a text token that stands for nothing."""
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return column.isNull() | F.isnan(column)
    if isinstance(kind, T.StringType):
        return column.isNull() | F.lower(F.trim(column)).isin(*MISSING_TOKENS)
    return column.isNull()


def parses(column: Column) -> Column:
    """Whether a text is a number by the rules of ``float()`` for ASCII text."""
    return column.rlike(_NUMBER)


def to_number(column: Column, kind: T.DataType) -> Column:
    """Double value of a cell; null where it is missing or no number (ANSI-safe)."""
    if isinstance(kind, T.StringType):
        clean = F.regexp_replace(column, "_", "")
        return F.when(parses(column) & ~column.rlike(_NAN), F.trim(clean).try_cast("double"))
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return F.when(~F.isnan(column), column.cast("double"))
    return column.cast("double")


def as_feature(column: Column, kind: T.DataType) -> Column:
    """Double value of a cell, with yes / no words as 1 and 0; null where it is neither."""
    value = to_number(column, kind)
    if not isinstance(kind, T.StringType):
        return value
    word = F.lower(F.trim(column))
    return F.coalesce(value, F.when(word.isin(*ONE_TOKENS), 1.0).when(word.isin(*ZERO_TOKENS), 0.0))


def as_text(column: Column, kind: T.DataType) -> Column:
    """Text of a category; whole doubles as ``7.0``."""
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        whole = (column == F.floor(column)) & (F.abs(column) < 1e16)
        return F.when(whole, F.concat(column.cast("decimal(20,0)").cast("string"), F.lit(".0"))).otherwise(column.cast("string"))
    if isinstance(kind, T.BooleanType):
        return F.initcap(column.cast("string"))
    return column.cast("string")
