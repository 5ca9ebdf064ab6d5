"""Column functions that read names and values typed by hand."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts, in lower case and without outer blanks, that say there is no value.
NO_VALUE = ("", "n/a", "na", "#n/a", "null", "none", "nil", "nan", "-", "--", "?", "unknown", "undefined")

_BLANKS = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\u00a0\ufeff"
_WHOLE = r"^[+-]?(?:\d+|\d{1,3}(?:,\d{3})+)(?:\.\d*)?(?:[eE][+-]?\d{1,3})?$"
_DECIMAL = r"^[+-]?(?:\d+(?:[.,]\d*)?|[.,]\d+)(?:[eE][+-]?\d{1,3})?$"


def strip(c: Column) -> Column:
    """c without outer blanks of any kind."""
    return F.btrim(c, F.lit(_BLANKS))


def kebab(c: Column) -> Column:
    """A name in any style (camelCase, snake_case, words, upper case) in lower-case hyphenated form; dots are kept."""
    bare = strip(c)
    split = F.when(bare.rlike(r"[\p{Ll}\d]\p{Lu}"), F.regexp_replace(bare, r"([\p{Ll}\d])(\p{Lu})", "$1-$2")).otherwise(bare)
    return F.regexp_replace(F.lower(split), r"[\s_-]+", "-")


def usable_text(c: Column) -> Column:
    """c without outer blanks; NULL if it says that there is no value."""
    t = strip(c)
    return F.when(~F.lower(t).isin(*NO_VALUE), t)


def whole_number(c: Column) -> Column:
    """c as bigint: a comma groups thousands, an exponent and a fraction of zeros are allowed; else NULL."""
    return whole_text(usable_text(c))


def whole_text(t: Column) -> Column:
    """whole_number of a usable_text."""
    n = F.replace(F.when(t.rlike(_WHOLE), t), F.lit(","), F.lit("")).try_cast("decimal(38,10)")
    return F.coalesce(t.try_cast("bigint"), F.when(n == F.floor(n), n).try_cast("bigint"))


def decimal_number(c: Column) -> Column:
    """c as double: a comma is the decimal mark; not a number as a whole: NULL."""
    return decimal_text(usable_text(c))


def decimal_text(t: Column) -> Column:
    """decimal_number of a usable_text."""
    n = F.replace(F.when(t.rlike(_DECIMAL), t), F.lit(","), F.lit(".")).try_cast("double")
    return F.when(~F.isnan(n) & (F.abs(n) != F.lit(float("inf"))), n)


def email_key(c: Column) -> Column:
    """c without outer blanks and in lower case; blank: NULL."""
    t = F.lower(strip(c))
    return F.when(t != "", t)


def repo_path(c: Column) -> Column:
    """c with / as separator and without leading ./; empty: NULL."""
    t = F.regexp_replace(F.translate(c, "\\", "/"), r"^(?:\./+)+", "")
    return F.when(t != "", t)
