"""Dates: three written forms, agreement of sources, repair proposals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_FORMS = ((r"^\d{8}$", "yyyyMMdd"), (r"^\d{4}\.\d{2}\.\d{2}$", "yyyy.MM.dd"), (r"^\d{4}-\d{2}-\d{2}$", "yyyy-MM-dd"))
#: How dates are written in titles and in sections on the close of argument.
_CITED = r"(?<![0-9])([0-9]{4})\.\s*([0-9]{1,2})\.\s*([0-9]{1,2})\.(?![0-9])"
_CLOSING_DATE = r"(?<![0-9])([0-9]{4})\.\s*([0-9]{1,2})\.\s*([0-9]{1,2})(?![0-9])\.?"
_CLOSING = r"【\s*변론\s*종(?:결|료)(?:일)?\s*】([^【]*)"
NO_DATE = ("", "empty", "no_info")
SENTINEL = "2072-01-01"


def parse_date(x: Column) -> Column:
    """A date from YYYYMMDD, YYYY.MM.DD or YYYY-MM-DD; null for all else and for days that don't exist."""
    return F.coalesce(*[F.when(x.rlike(form), F.try_to_date(x, fmt)) for form, fmt in _FORMS])


def compact_day(x: Column) -> Column:
    """A date from YYYYMMDD only."""
    return F.when(x.rlike(r"^\d{8}$"), F.try_to_date(x, "yyyyMMdd"))


def day_digits(x: Column) -> Column:
    """Digits of a written date, if there are eight."""
    d = F.regexp_replace(x, "[^0-9]", "")
    return F.when(F.length(d) == 8, d)


def _written(x: Column, pattern: str) -> Column:
    """All dates of a pattern of year, month and day; null for days that don't exist."""
    part = lambda k: F.regexp_extract_all(x, F.lit(pattern), k)
    rows = F.arrays_zip(part(1).alias("y"), part(2).alias("m"), part(3).alias("d"))
    return F.transform(rows, lambda p: F.try_to_date(F.concat_ws("-", p["y"], F.lpad(p["m"], 2, "0"), F.lpad(p["d"], 2, "0")), "yyyy-MM-dd"))


def cited_dates(x: Column) -> Column:
    """All dates written `YYYY. M. D.`, null for days that don't exist."""
    return _written(x, _CITED)


def cited_date(x: Column) -> Column:
    """The date of a citation that has exactly one."""
    found = cited_dates(x)
    return F.when(F.size(found) == 1, F.get(found, F.lit(0)))


def metadata_date(x: Column) -> Column:
    """A date in one of the three forms, or written out whole."""
    x = F.trim(x)
    whole = F.when(x.rlike(f"^(?:{_CITED})$"), F.get(cited_dates(x), F.lit(0)))
    return F.coalesce(parse_date(x), whole)


def date_state(x: Column) -> Column:
    """MISSING, INVALID or VALID; only the words for no date, as they are, are MISSING, so blanks are INVALID."""
    return F.when(x.isNull() | x.isin(*NO_DATE), "MISSING").when(metadata_date(x).isNull(), "INVALID").otherwise("VALID")


def agreed_date(*values: Column) -> Column:
    """The one date that all given texts say; null if any is no date or two differ."""
    present = F.array_compact(F.array(*[F.when(F.trim(v) != "", v) for v in values]))
    days = F.transform(present, parse_date)
    one = F.array_distinct(days)
    return F.when((F.size(present) > 0) & ~F.exists(days, lambda d: d.isNull()) & (F.size(one) == 1), F.get(one, F.lit(0)))


def decision_date_status(title: Column, html: Column, *metadata: Column, sentinel: str = SENTINEL) -> Column:
    """Proposal for a missing decision date from the title: one of eight states, the first that holds.

    The title must stand in the visible text, white space and end marks aside.
    """
    none = F.expr("cast(array() as array<date>)")
    days = F.coalesce(cited_dates(title), none)
    day = F.get(days, F.lit(0))
    squeezed = lambda x: F.regexp_replace(F.coalesce(x, F.lit("")), r"(?U)\s+", "")
    name = F.regexp_replace(squeezed(title), "[★☆*]+$", "")
    shown = (squeezed(title) != "") & F.contains(squeezed(html), name)
    states = F.array(*[date_state(m) for m in metadata]) if metadata else F.expr("cast(array() as array<string>)")
    values = F.array(*[metadata_date(m) for m in metadata]) if metadata else none
    return (
        F.when(F.exists(days, lambda d: d.isNull()), "INVALID_TITLE_DATE")
        .when(F.size(days) == 0, "MISSING_TITLE_DATE")
        .when(F.size(days) > 1, "AMBIGUOUS_TITLE")
        .when(day == F.lit(sentinel).cast("date"), "SENTINEL_DATE")
        .when(~shown, "TITLE_NOT_CONFIRMED_IN_HTML")
        .when(F.array_contains(states, "INVALID"), "INVALID_METADATA")
        .when(F.exists(values, lambda v: F.coalesce(v != day, F.lit(False))), "METADATA_CONFLICT")
        .otherwise("READY")
    )


def closing_dates(x: Column) -> Column:
    """Dates in the sections that follow a heading on the close of argument."""
    parts = F.coalesce(F.regexp_extract_all(x, F.lit(_CLOSING), 1), F.expr("cast(array() as array<string>)"))
    return F.flatten(F.transform(parts, lambda p: _written(p, _CLOSING_DATE)))


def closing_date_status(text: Column, html: Column, previous: Column) -> Column:
    """Proposal for the closing date: the largest date, which the visible text must have too; to review if several occur."""
    days, shown = closing_dates(text), closing_dates(html)
    top = F.array_max(days)
    return (
        F.when(F.exists(days, lambda d: d.isNull()), "INVALID_DATE")
        .when((F.size(days) == 0) & previous.isNotNull(), "EXISTING_DATE_NOT_REPRODUCED")
        .when(F.size(days) == 0, "NOT_FOUND")
        .when(F.size(days) > 1, "REVIEW_MULTIPLE")
        .when(~F.coalesce(F.array_contains(shown, top), F.lit(False)), "NOT_CONFIRMED_IN_HTML")
        .when(previous.isNotNull() & (previous != top), "EXISTING_DATE_CONFLICT")
        .otherwise("READY")
    )


def in_window(day: Column, start: str | None, end: str | None, most_days: int = 92) -> Column:
    """start <= day <= end; both or neither, and not too far apart."""
    if (start is None) != (end is None):
        raise ValueError("both ends of a window, or none")
    if start is None:
        return F.lit(True)
    from datetime import date

    a, b = date.fromisoformat(start), date.fromisoformat(end)
    if not 0 <= (b - a).days <= most_days:
        raise ValueError(f"a window of 0 to {most_days} days")
    return day.between(F.lit(a), F.lit(b))


def dated_spans(text: str) -> list[dict]:
    """Dates written `YYYY. M. D.` with their places in the text; date is None for days that don't exist."""
    import re
    from datetime import date

    out = []
    for m in re.finditer(_CITED, text):
        try:
            day = date(int(m[1]), int(m[2]), int(m[3])).isoformat()
        except ValueError:
            day = None
        out.append({"text": m[0], "start": m.start(), "end": m.end(), "date": day})
    return out


def dated_spans_udf():
    from .html import _each

    return _each(dated_spans, "array<struct<text:string,start:int,end:int,date:string>>")
