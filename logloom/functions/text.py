"""String helpers that follow the Unicode whitespace class used by JSON log producers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that count as whitespace when trimming or collapsing.
WHITESPACE = (
    "\t\n\x0b\x0c\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
)
_SPACE_RUN = "[\\t\\n\\x0B\\f\\r \\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]+"

# Anything a collapse would change: two in a row, or one that is no plain space.
_NOT_SINGLE_SPACES = "  |[\\t\\n\\x0B\\f\\r\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]"


def _is_space(sign: Column) -> Column:
    return F.contains(F.lit(WHITESPACE), sign)


def trim(text: Column) -> Column:
    """Text without whitespace at its ends; text that has none is passed on as it is.

    Trimming a set of characters walks over the whole text, looking at the two
    ends does not.
    """
    ends = _is_space(F.left(text, F.lit(1))) | _is_space(F.right(text, F.lit(1)))
    return F.when(ends, F.btrim(text, F.lit(WHITESPACE))).otherwise(text)


def is_blank(text: Column) -> Column:
    return F.when(
        _is_space(F.left(text, F.lit(1))), F.btrim(text, F.lit(WHITESPACE)) == ""
    ).otherwise(F.when(text.isNotNull(), False))


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed a single time, however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def collapse(text: Column) -> Column:
    """Trim, then turn every whitespace run into one space."""
    return once(
        trim(text),
        lambda bare: F.when(
            F.rlike(bare, F.lit(_NOT_SINGLE_SPACES)), F.regexp_replace(bare, _SPACE_RUN, " ")
        ).otherwise(bare),
    )


def first_line(body: Column) -> Column:
    """First non-blank line, collapsed; ``''`` when there is none.

    Trimming the body first drops the leading blank lines, so only the head of
    a multi-line text is looked at and no array of lines is built.
    """
    return once(F.substring_index(trim(body), "\n", 1), collapse)
