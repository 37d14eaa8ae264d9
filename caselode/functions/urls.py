"""URL functions and the predicates that say which URLs may be used."""

from __future__ import annotations

from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def part(url: Column, what: str, key: str | None = None) -> Column:
    """A part of a URL, null if it can't be parsed."""
    args = [url, F.lit(what)] + ([F.lit(key)] if key else [])
    return F.call_function("try_parse_url", *args)


def query_keys(url: Column) -> Column:
    """Names of the query's parameters, in order."""
    q = part(url, "QUERY")
    return F.when(q.isNull(), F.expr("cast(array() as array<string>)")).otherwise(F.transform(F.split(q, "&"), lambda p: F.split_part(p, F.lit("="), F.lit(1))))


def is_safe(url: Column, secrets: tuple[str, ...] = ("token", "key", "secret", "password", "signature")) -> Column:
    """http(s) with a host, without credentials, fragment or a parameter that may hold a secret."""
    names = F.transform(query_keys(url), F.lower)
    ok = F.lower(part(url, "PROTOCOL")).isin("http", "https") & part(url, "HOST").isNotNull()
    ok &= part(url, "USERINFO").isNull() & part(url, "REF").isNull()
    return F.coalesce(ok & (F.size(F.array_intersect(names, F.array(*[F.lit(s) for s in secrets]))) == 0), F.lit(False))


def is_endpoint(url: Column, scheme: str, host: str, path: str, keys: list[str]) -> Column:
    """Exactly this scheme, host and path, and exactly these parameters, each once."""
    found = F.array_sort(query_keys(url))
    ok = (part(url, "PROTOCOL") == scheme) & (part(url, "HOST") == host) & (part(url, "PATH") == path)
    return F.coalesce(ok & (found == F.array_sort(F.array(*[F.lit(k) for k in keys]))), F.lit(False))


def file_name(url: Column, key: str) -> Column:
    """A decoded parameter of the query."""
    return F.try_url_decode(part(url, "QUERY", key))


def joined():
    """The Arrow UDF for a reference against its base."""

    @F.pandas_udf("string")
    def join(base: pd.Series, ref: pd.Series) -> pd.Series:
        return pd.Series([None if b is None or r is None else urljoin(b, r) for b, r in zip(base, ref, strict=True)])

    return join


def unique_mapping_url(names: Column, base: str) -> Column:
    """The URL of a mapping that names one file; null if none or several."""
    one = F.array_distinct(names)
    return F.when(F.size(one) == 1, F.concat(F.lit(base), F.url_encode(F.get(one, F.lit(0)))))


#: The provider's parameters for an article that a judgment links to.
ARTICLE_MODE, ARTICLE_CLASS = "11", "L"


def article_params(law: Column, article: Column, context: Column, frame_day: Column) -> Column:
    """Parameters of the request for a linked article; null where context or day is not of the known form.

    The context `prec` takes the frame's day, `precYYYYMMDD` its own; the day must be a real date.
    """
    day = F.when(context == "prec", frame_day).when(context.rlike("^prec[0-9]{8}$"), F.substring(context, 5, 8))
    real = day.rlike("^[0-9]{8}$") & F.try_to_date(day, "yyyyMMdd").isNotNull()
    blank = F.lit("")
    fields = {"joNo": article, "joEfYd": blank, "mode": F.lit(ARTICLE_MODE), "lsNm": law, "ancYd": blank, "lsId": F.concat(F.lit("prec"), day), "efYd": day, "lsClsCd": F.lit(ARTICLE_CLASS)}
    return F.when(real, F.struct(*[v.alias(k) for k, v in fields.items()]))
