"""Tagged cells: one struct for columns whose values have mixed types, and missing values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

CELL = T.StructType([T.StructField("original_type", T.StringType()), T.StructField("encoding", T.StringType()), T.StructField("text", T.StringType()), T.StructField("integer", T.LongType())])
LIMIT = 1 << 63


def text_of(kind: T.DataType, x: Column) -> Column:
    """What a search sees of a value: text, then integer, then value of a struct; else the value written out."""
    if isinstance(kind, T.StructType):
        names = {f.name: f.dataType for f in kind}
        parts = [x[n].cast("string") for n in ("text", "integer", "value") if n in names and not isinstance(names[n], (T.StructType, T.ArrayType, T.MapType))]
        return F.coalesce(*parts, F.to_json(x)) if parts else F.to_json(x)
    if isinstance(kind, (T.ArrayType, T.MapType)):
        return F.to_json(x)
    return x.cast("string")


def tag(kind: T.DataType, x: Column) -> Column:
    """A value as a tagged cell. Integers beyond 64 bits keep their digits as text."""
    name = F.lit(kind.simpleString())
    cell = lambda enc, text=None, integer=None: F.struct(name.alias("original_type"), F.lit(enc).alias("encoding"), (text if text is not None else F.lit(None).cast("string")).alias("text"), (integer if integer is not None else F.lit(None).cast("bigint")).alias("integer"))
    if isinstance(kind, T.StringType):
        full = cell("STRING", text=x)
    elif isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        full = cell("INTEGER", integer=x.cast("bigint"))
    elif isinstance(kind, T.DecimalType) and kind.scale == 0:
        inside = x.between(-LIMIT, LIMIT - 1)
        full = F.when(inside, cell("INTEGER", integer=x.try_cast("bigint"))).otherwise(cell("BIG_INTEGER", text=x.cast("string")))
    else:
        # a column of its own around the value keeps numbers that JSON has no word for
        full = cell("JSON", text=F.to_json(F.struct(x.alias("value"))))
    return F.when(x.isNull(), cell("NULL")).otherwise(full)


def untag(cell: Column) -> Column:
    """The text of a cell back, whatever its encoding; null for NULL."""
    return F.when(cell["encoding"] == "NULL", F.lit(None).cast("string")).otherwise(F.coalesce(cell["text"], cell["integer"].cast("string")))


def wrapped_value(x: Column) -> Column:
    """The `value` of a text that is a JSON object with one; else the text."""
    return F.coalesce(F.when(F.startswith(x, F.lit("{")), F.get_json_object(x, "$.value")), x)


def missing_kind(kind: T.DataType, x: Column) -> Column:
    """NULL, BLANK, TEXT_EMPTY/NAN/NONE/0, NUMERIC_ZERO, NAN, EMPTY_CONTAINER or PRESENT."""
    out = F.when(x.isNull(), "NULL")
    if isinstance(kind, T.StringType):
        word = F.lower(F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
        out = out.when(word == "", "BLANK").when(word.isin("empty", "nan", "none", "0"), F.concat(F.lit("TEXT_"), F.upper(word)))
    elif isinstance(kind, (T.FloatType, T.DoubleType)):
        out = out.when(F.isnan(x), "NAN").when(x == 0, "NUMERIC_ZERO")
    elif isinstance(kind, T.NumericType):
        out = out.when(x == 0, "NUMERIC_ZERO")
    elif isinstance(kind, (T.ArrayType, T.MapType)):
        out = out.when(F.size(x) == 0, "EMPTY_CONTAINER")
    return out.otherwise("PRESENT")


def body_state(x: Column) -> Column:
    """EMPTY_OR_SENTINEL for texts that stand for none; else OBSERVED; ERROR for null."""
    word = F.lower(F.regexp_replace(x, r"(?U)^\s+|\s+$", ""))
    return F.when(x.isNull(), "ERROR").when(word.isin("", "empty", "no_info", "none"), "EMPTY_OR_SENTINEL").otherwise("OBSERVED")


def sorted_object(x: Column) -> Column:
    """A JSON object with its keys in order, to compare without their order; other texts as they are."""
    entries = F.array_sort(F.map_entries(F.from_json(x, "map<string,string>")))
    parsed = F.startswith(x, F.lit("{")) & F.from_json(x, "map<string,string>").isNotNull()
    return F.when(parsed, F.to_json(F.map_from_entries(entries))).otherwise(x)


def whole_number(x: Column) -> Column:
    """A text as an integer, white space aside; null for all else."""
    return F.trim(x).try_cast("bigint")


def scalar_text(x: Column) -> Column:
    """A trimmed text; null if blank."""
    t = F.trim(x.cast("string"))
    return F.when(t != "", t)
