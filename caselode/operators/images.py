"""Image references and acquisitions: status by precedence, one request per URL, accounting, provider state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .latest import latest_per_key
from .paging import numbered

STATES = ["NEVER_ATTEMPTED", "ACQUIRED", "FAILED", "OTHER"]
RESOLVED, NAME_ONLY, MISMATCH, UNRESOLVED = "RESOLVED", "NAME_ONLY", "ID_MISMATCH", "UNRESOLVED"


def reference_status(explicit: Column, mismatch: Column, name: Column, url: Column) -> Column:
    """A valid explicit status, else a mismatch flag, else a name without URL, else a URL, else unresolved."""
    valid = explicit.isin(RESOLVED, NAME_ONLY, MISMATCH, UNRESOLVED)
    return (
        F.when(valid, explicit)
        .when(F.coalesce(mismatch, F.lit(False)), MISMATCH)
        .when(name.isNotNull() & url.isNull(), NAME_ONLY)
        .when(url.isNotNull(), RESOLVED)
        .otherwise(UNRESOLVED)
    )


def sniff(content: Column) -> Column:
    """Image type by its first bytes; null if none fits."""
    h = F.hex(F.substring(content, 1, 12))
    return (
        F.when(h.startswith("FFD8FF"), "jpeg")
        .when(h.startswith("89504E470D0A1A0A"), "png")
        .when(h.startswith("474946383761") | h.startswith("474946383961"), "gif")
        .when(h.startswith("52494646") & (F.substring(h, 17, 8) == "57454250"), "webp")
        .when(h.startswith("424D"), "bmp")
    )


def same_number(a: Column, b: Column) -> Column:
    """Whether two names end in the same number, as ImageId12 and img12 do."""
    n = lambda x: F.regexp_extract(x, r"([0-9]+)(?:\.[A-Za-z]+)?$", 1)
    return (n(a) != "") & (n(a) == n(b))


def requests(references: DataFrame, url: str, order: str) -> DataFrame:
    """The first occurrence of each URL, and whether its mentions disagree about a mismatch."""
    first = latest_per_key(references.where(F.col(url).isNotNull()), [url], [F.asc(order)])
    return first


def plan_acquisition(references: DataFrame, attempts: DataFrame, url: str, order: str) -> DataFrame:
    """URLs never tried before, in order of first mention."""
    fresh = requests(references, url, order).join(attempts.select(url).distinct(), url, "left_anti")
    return numbered(fresh, [order, url])


def accounting(outcomes: DataFrame, url: str, order: str, size: str, budget: int) -> DataFrame:
    """Per URL ACQUIRED, FAILED or SKIPPED: with the running bytes beyond the budget everything is skipped."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum(F.coalesce(F.col(size), F.lit(0)).cast("bigint")).over(w)
    state = F.when(total > budget, "SKIPPED").when(F.col(size).isNull(), "FAILED").otherwise("ACQUIRED")
    return outcomes.withColumn("outcome", state)


def provider_state(references: DataFrame, attempts: DataFrame, url: str, order: str) -> DataFrame:
    """References with the state of the latest attempt of their URL."""
    last = latest_per_key(attempts, [url], [F.desc(order)]).select(url, F.col("outcome").alias("_o"))
    j = references.join(last, url, "left")
    return j.withColumn("state", F.when(F.col("_o").isNull(), "NEVER_ATTEMPTED").when(F.col("_o").isin("ACQUIRED", "FAILED"), F.col("_o")).otherwise("OTHER")).drop("_o")


def mapping_reason(names: Column, file: Column, width: Column) -> Column:
    """Why a provider's mapping isn't exact, the first reason that holds, or EXACT."""
    return (
        F.when(names.isNull() | (F.size(names) == 0), "NO_MAPPING")
        .when(F.size(F.array_distinct(names)) > 1, "SEVERAL_MAPPINGS")
        .when(file.isNull() | (file == ""), "NO_FILE_NAME")
        .when(F.get(names, F.lit(0)) != file, "NAME_DIFFERS")
        .when(F.coalesce(width, F.lit(0)) <= 0, "NO_SIZE")
        .otherwise("EXACT")
    )


#: Largest image that is taken: bytes, and pixels.
MOST_BYTES, MOST_PIXELS = 16 << 20, 25_000_000


def dimensions(content: Column) -> Column:
    """struct<width, height> from the header of a PNG, GIF or BMP; null for others and for headers that are cut off."""
    h = F.hex(F.substring(content, 1, 32))
    number = lambda at, n: F.conv(F.nullif(F.substring(h, 2 * at + 1, 2 * n), F.lit("")), 16, 10).cast("bigint")
    turned = lambda at, n: sum((number(at + k, 1) * F.lit(1 << 8 * k) for k in range(1, n)), number(at, 1))
    pair = lambda w, h: F.struct(w.alias("width"), h.alias("height"))
    kind, size = sniff(content), F.octet_length(content)
    return F.when((kind == "png") & (size >= 24), pair(number(16, 4), number(20, 4))).when((kind == "gif") & (size >= 10), pair(turned(6, 2), turned(8, 2))).when((kind == "bmp") & (size >= 26), pair(turned(18, 4), turned(22, 4)))


def image_state(content: Column) -> Column:
    """Whether bytes may be kept as an image: OK, or the first reason against it."""
    size = dimensions(content)
    return (
        F.when(content.isNull() | (F.octet_length(content) == 0), "IMAGE_EMPTY")
        .when(F.octet_length(content) > MOST_BYTES, "IMAGE_TOO_LARGE")
        .when(sniff(content).isNull(), "IMAGE_TYPE_UNKNOWN")
        .when(sniff(content).isin("png", "gif", "bmp") & size.isNull(), "IMAGE_TRUNCATED")
        .when((size["width"] <= 0) | (size["height"] <= 0) | (size["width"] * size["height"] > MOST_PIXELS), "IMAGE_DIMENSIONS")
        .otherwise("OK")
    )


def assembled(references: DataFrame, attempts: DataFrame, prior: DataFrame, url: str, order: str, blob: str) -> DataFrame:
    """References with the state of their URL's latest attempt and its blob, or the one that an earlier revision has proven.

    A carried blob makes the state ACQUIRED, with carried true.
    """
    from .ledger import carry_forward

    last = latest_per_key(attempts, [url], [F.desc(order)]).select(url, F.col("outcome").alias("_o"), F.col(blob))
    j = carry_forward(references.join(last, url, "left"), prior, url, blob)
    state = F.when(F.col("carried"), "ACQUIRED").when(F.col("_o").isNull(), "NEVER_ATTEMPTED").when(F.col("_o").isin("ACQUIRED", "FAILED"), F.col("_o")).otherwise("OTHER")
    return j.withColumn("state", state).drop("_o")


def manifest(references: DataFrame, url: str, order: str, status: str, most: int) -> DataFrame:
    """One row a URL, the first `most` in order of first mention: order, mentions, and whether they disagree about a mismatch."""
    known = references.where(F.col(url).isNotNull())
    per = known.groupBy(url).agg(F.min(order).alias("first"), F.count("*").alias("mentions"), (F.bool_or(F.col(status) == MISMATCH) & F.bool_or(F.col(status) != MISMATCH)).alias("disagree"))
    return per.orderBy("first", url).limit(most)
