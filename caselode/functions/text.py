r"""Text functions: Unicode white space, case folding, literal search.

`lower` and the built-in collations differ from full case folding (ss for ß,
ffi for the ligature, σ for the final form), so folding is an Arrow UDF; a
query that folding cannot change takes the built-in `contains` instead.
"""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = r"(?U)\s+"


def strip(x: Column) -> Column:
    """Without Unicode white space at the ends (trim takes spaces only)."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def compact(x: Column) -> Column:
    """Without any white space."""
    return F.regexp_replace(x, BLANK, "")


def collapse(x: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return strip(F.regexp_replace(x, BLANK, " "))


def newlines(x: Column) -> Column:
    """CRLF and CR as LF."""
    return F.replace(F.replace(x, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))


def casefold():
    """The Arrow UDF for full Unicode case folding; null stays null."""

    @F.pandas_udf("string")
    def fold(x: pd.Series) -> pd.Series:
        return x.map(lambda v: v.casefold(), na_action="ignore")

    return fold


def is_literal(query: str) -> bool:
    """Whether case folding can neither change nor produce the characters of a query."""
    return all(0xAC00 <= ord(c) <= 0xD7A3 or c.isascii() and not c.isalpha() for c in query)


#: Rows of a batch whose texts Python holds at a time.
SLICE = 128


def _folded_holds(needle: str):
    """The Arrow UDF that tests texts under full case folding; the folded texts stay where they are made."""

    @F.arrow_udf("boolean")
    def holds(x: pa.Array) -> pa.Array:
        found = []
        for at in range(0, len(x), SLICE):
            found += [None if v is None else needle in v.casefold() for v in x.slice(at, SLICE).to_pylist()]
        return pa.array(found, pa.bool_())

    return holds


def contains_folded(x: Column, query: str) -> Column:
    """Literal substring test under case folding; null is no match.

    The query is folded on the driver. Only queries with letters that fold
    pay for Python.
    """
    needle = query.casefold()
    found = F.contains(x, F.lit(needle)) if is_literal(needle) else _folded_holds(needle)(x)
    return F.coalesce(found, F.lit(False))


def like_literal(x: Column, part: str) -> Column:
    """LIKE %part% with every character of part literal."""
    return F.contains(x, F.lit(part))


def brief(x: Column, n: int) -> Column:
    """The first n characters and, if there are more, the length."""
    return F.when(F.length(x) > n, F.concat(F.left(x, F.lit(n)), F.lit("…("), F.length(x).cast("string"), F.lit(")"))).otherwise(x)


def label_join(*parts: Column, by: str = " · ") -> Column:
    """Distinct parts that aren't null, in order."""
    return F.array_join(F.array_distinct(F.array_compact(F.array(*parts))), by)


def search_text(*parts: Column) -> Column:
    """Parts that aren't null, one a line."""
    return F.concat_ws("\n", *parts)


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def slice_of(x: Column, start: Column, end: Column) -> Column:
    """Code points start (from 0) to end."""
    return F.substring(x, start + 1, end - start)


def context(x: Column, start: Column, end: Column, width: int = 100) -> tuple[Column, Column]:
    """Up to `width` code points before start and after end."""
    lo = F.greatest(F.lit(0), start - width)
    return slice_of(x, lo, start), F.substring(x, end + 1, F.lit(width))
