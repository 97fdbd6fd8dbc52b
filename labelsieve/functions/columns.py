"""Tokens, text trimming and guarded parsing."""

from pyspark.sql import Column, functions as F

from labelsieve.constants import MISSING_TOKEN, NA_STRINGS

# Every code point Unicode counts as white space, plus the four ASCII separators.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Spark would also cast '1d', '1f' and 'NaN'; those are text here.
NUMBER = (
    r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
    r"|^\s*[+-]?(?i:inf|infinity)\s*$"
)


def quoted(name: str) -> str:
    """The name as an identifier; column names here contain dots."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(quoted(name))


def present(df, names) -> list[str]:
    """Those of ``names`` the frame has, in the order given."""
    return [name for name in names if name in df.columns]


def token(column: Column, missing: str = MISSING_TOKEN) -> Column:
    """The column as text, with a spelling for null."""
    return F.coalesce(column.cast("string"), F.lit(missing))


def strip(column: Column) -> Column:
    """Text without white space at its ends; most text has none and is passed on."""
    ends = F.substring(column, 1, 1).isin(*WHITESPACE) | F.substring(column, -1, 1).isin(*WHITESPACE)
    return F.when(ends, F.btrim(column, F.lit(WHITESPACE))).otherwise(column)


def numeric(column: Column) -> Column:
    """Number the text spells, or null."""
    text = column.cast("string")
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def numeric_or_zero(column: Column) -> Column:
    return F.coalesce(numeric(column), F.lit(0.0))


def null_if_missing(column: Column) -> Column:
    """Null for the spellings a default CSV read takes for missing."""
    return F.when(~column.isin(*NA_STRINGS), column)


def binary_label(column: Column) -> Column:
    """0 or 1 from a numeric-looking label; null where it is neither."""
    text = column.cast("string")
    value = numeric(text).try_cast("int")
    return (
        F.when(text == "0", 0).when(text == "1", 1).when(value.isin(0, 1), value)
    )


def xlogx(count: Column) -> Column:
    return F.when(count > 0, count * F.log(count.cast("double"))).otherwise(F.lit(0.0))
