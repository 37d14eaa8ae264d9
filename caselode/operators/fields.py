"""Fields of a document as long rows: text sections, metadata, judges, parties; wide again; roll-up and checks.

A page passes through Python once, for its visible text and the stretches
between its accepted headings; everything that is made of these is an
expression of built-in functions beside the page's other columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.html import page_sections_udf
from ..functions.text import slice_of, strip
from ..session import ship

#: Who may be named in a heading of parties, and who signs.
PARTY = "원고|피고|청구인|신청인|항고인|항소인|피신청인|상고인|사건본인|참가인|검사"
SIGNS = "대법관|대법원장|판사|재판관|군판사"

_RANGES = "array<struct<start:int,end:int>>"


def stretches(sections: Column, labels: list[str], tail: bool) -> Column:
    """The sections under one of the labels, in the order of the text; tail: of headings in square brackets."""
    return F.filter(sections, lambda s: (s["tail"] == F.lit(tail)) & s["label"].isin(labels))


def parties_in(sections: Column) -> Column:
    """The sections whose heading names a party."""
    return F.filter(sections, lambda s: ~s["tail"] & s["label"].rlike(PARTY))


def said(text: Column, sections: Column) -> Column:
    """What sections say, heading included: each without white space at its ends, a line break between; null without any."""
    lines = F.transform(sections, lambda s: strip(slice_of(text, s["start"], s["end"])))
    return F.when(F.size(sections) > 0, F.array_join(lines, "\n"))


def ranges(sections: Column) -> Column:
    return F.transform(sections, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))


def by_label(text: Column, sections: Column) -> Column:
    """A map from each heading to what stands below it; of equal headings the last one counts."""
    last = lambda label: F.element_at(F.filter(sections, lambda s: s["label"] == label), -1)
    below = lambda s: strip(slice_of(text, s["body_start"], s["end"]))
    labels = F.array_distinct(F.transform(sections, lambda s: s["label"]))
    return F.map_from_entries(F.transform(labels, lambda x: F.struct(x, below(last(x)))))


def signature(text: Column) -> Column:
    """struct<role, names, ranges> of the first line that a judge signs; null without one."""
    pattern = rf"(?sU)\A(.*?)((?m:^)\s*({SIGNS})\s+([^\n]+))"
    part = lambda k: F.regexp_extract(text, pattern, k)
    start = F.length(part(1))
    span = F.array(F.struct(start.cast("int").alias("start"), (start + F.length(part(2))).cast("int").alias("end")))
    return F.when(text.rlike(rf"(?mU)^\s*({SIGNS})\s+[^\n]"), F.struct(part(3).alias("role"), strip(part(4)).alias("names"), span.alias("ranges")))


def text_fields(docs: DataFrame, key: str, html: str, sections: dict[str, list[str]], tail: list[str]) -> DataFrame:
    """(doc, name, value, status, reason, ranges) of sections found in documents' visible text.

    sections: field name -> labels; names in `tail` have square-bracket
    headings. A section that repeats is joined and put to REVIEW. Each party
    and the first judges' line give fields of their own.
    """
    ship(docs.sparkSession)
    body = [x for n, labels in sections.items() if n not in tail for x in labels]
    page = page_sections_udf(body, [x for n in tail for x in sections[n]], PARTY)
    rows = docs.select(F.col(key).cast("string").alias("doc"), page(F.col(html)).alias("page")).select("doc", "page.visible", "page.sections")
    visible, found = F.col("visible"), F.col("sections")

    def field(name: Column, value: Column, spans: Column, repeats: Column) -> Column:
        status, why = F.when(repeats, "REVIEW").otherwise("PRESENT"), F.when(repeats, "section repeats").otherwise("explicit section")
        return F.struct(name.alias("name"), value.alias("value"), status.alias("status"), why.alias("reason"), spans.cast(_RANGES).alias("ranges"))

    once = F.lit(False)
    cells = []
    for name, labels in sections.items():
        own = stretches(found, labels, name in tail)
        cells.append(field(F.lit(name), said(visible, own), ranges(own), F.size(own) > 1))
    signed = signature(visible)
    cells.append(field(F.concat(F.lit("judge:"), signed["role"]), signed["names"], signed["ranges"], once))
    named = F.transform(parties_in(found), lambda s: field(F.concat(F.lit("party:"), s["label"]), strip(slice_of(visible, s["body_start"], s["end"])), F.array(F.struct(s["start"], s["end"])), once))
    return rows.select("doc", F.inline(F.concat(F.array(*cells), named))).where("value is not null and name is not null")


def metadata_fields(docs: DataFrame, key: str, columns: dict[str, str]) -> DataFrame:
    """(doc, name, value, status, reason, ranges) from metadata columns; null and blank are no fields."""
    cells = [F.struct(F.lit(name).alias("name"), F.col(c).cast("string").alias("value")) for name, c in columns.items()]
    rows = docs.select(F.col(key).cast("string").alias("doc"), F.inline(F.array(*cells))).where("value is not null and value <> ''")
    return rows.select("doc", "name", "value", F.lit("PRESENT").alias("status"), F.lit("metadata").alias("reason"), F.lit(None).cast(_RANGES).alias("ranges"))


def complete(fields: DataFrame, docs: DataFrame, key: str, names: list[str], status: str = "NOT_PROVIDED") -> DataFrame:
    """A row for each document and name: those without a field get `status`."""
    more = [f for f in fields.schema if f.name not in ("doc", "name")]
    own = fields.where(F.col("name").isin(names)).groupBy("doc").agg(F.collect_list(F.struct("name", *[F.col(f.name) for f in more])).alias("_own"))  # a document's fields
    rows = docs.select(F.col(key).cast("string").alias("doc")).join(own, "doc", "left")
    lacking = F.array_except(F.array(*[F.lit(n) for n in names]), F.coalesce(F.transform("_own", lambda x: x["name"]), F.array().cast("array<string>")))
    empty = F.transform(lacking, lambda n: F.struct(n.alias("name"), *[F.lit(None).cast(f.dataType).alias(f.name) for f in more]))
    out = rows.select("doc", F.inline(F.when(F.col("_own").isNull(), empty).otherwise(F.concat("_own", empty))))
    return out.withColumn("status", F.coalesce("status", F.lit(status)))


def wide(fields: DataFrame, names: list[str]) -> DataFrame:
    """One row per document with the names as columns."""
    return fields.groupBy("doc").pivot("name", names).agg(F.first("value"))


def anomalies(fields: DataFrame, headings: DataFrame, expected: dict[str, str]) -> DataFrame:
    """HEADING_WITHOUT_FIELD for headings (doc, label) whose field has no value."""
    from ..functions.keys import literal_map

    named = headings.withColumn("name", F.try_element_at(literal_map(expected), F.col("label"))).where("name is not null").select("doc", "name").distinct()
    filled = fields.where("value is not null and value <> ''").select("doc", "name")
    return named.join(filled, ["doc", "name"], "left_anti").select("doc", F.lit("LOGIC_REQUIRED").alias("category"), F.lit("HEADING_WITHOUT_FIELD").alias("code"), F.col("name").alias("location"))
