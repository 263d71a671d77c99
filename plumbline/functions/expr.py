"""Column expressions shared by the operators.  All of them stay inside codegen."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def quoted(name: str) -> Column:
    """Column by exact name, safe for dots and spaces."""
    return F.col("`" + name.replace("`", "``") + "`")


def rounded(c: Column | str, digits: int = 6) -> Column:
    """Round, with negative zero folded into zero."""
    return F.round(as_column(c), digits) + F.lit(0.0)


def at_least_one(c: Column | str) -> Column:
    return F.greatest(as_column(c), F.lit(1))


def safe_divide(num: Column | str, den: Column | str) -> Column:
    """Null instead of an error when the denominator is zero."""
    return F.try_divide(as_column(num).cast("double"), as_column(den).cast("double"))


def clamp(c: Column | str, low: Column | float, high: Column | float) -> Column:
    """Clip into [low, high]; null stays null (`greatest` alone would skip it)."""
    c = as_column(c)
    low = low if isinstance(low, Column) else F.lit(low)
    high = high if isinstance(high, Column) else F.lit(high)
    return F.when(c.isNotNull(), F.greatest(low, F.least(high, c)))


def is_finite(c: Column | str) -> Column:
    c = as_column(c).cast("double")
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def finite_or_null(c: Column | str) -> Column:
    c = as_column(c)
    return F.when(is_finite(c), c)


def integer_like(c: Column | str, tolerance: float = 1e-9) -> Column:
    c = as_column(c).cast("double")
    return F.abs(c - F.round(c)) <= F.lit(tolerance)


def to_number(c: Column | str) -> Column:
    """Number, or null when the text is not one."""
    return as_column(c).try_cast("double")


def percent(c: Column | str, digits: int = 1) -> Column:
    return F.round(as_column(c) * 100, digits)


def short_number(c: Column | str, digits: int = 4) -> Column:
    """Shortest text of a number rounded to `digits` places, keeping one decimal: 1.0, 3.45."""
    text = F.format_string(f"%.{digits}f", F.round(as_column(c).cast("double"), digits) + F.lit(0.0))
    return F.regexp_replace(text, "0{1,%d}$" % (digits - 1), "")


def range_label(low: Column | str, high: Column | str, digits: int = 4) -> Column:
    return F.concat(short_number(low, digits), F.lit(" to "), short_number(high, digits))


def name_tokens(c: Column | str, min_length: int = 1) -> Column:
    """Lower-cased alphanumeric pieces of a name."""
    pieces = F.split(F.lower(as_column(c)), "[^a-z0-9]+")
    return F.filter(pieces, lambda t: F.length(t) >= min_length)


# Date layouts tried in turn, each with the shape text must have to be tried.
DATE_LAYOUTS = (
    ("yyyy-MM-dd HH:mm:ss", r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$"),
    ("yyyy/MM/dd", r"^\d{4}/\d{2}/\d{2}$"),
    ("MM/dd/yyyy", r"^\d{2}/\d{2}/\d{4}$"),
    ("dd-MM-yyyy", r"^\d{2}-\d{2}-\d{4}$"),
    ("dd MMM yyyy", r"^\d{2} [A-Za-z]{3} \d{4}$"),
    ("MMM dd yyyy", r"^[A-Za-z]{3} \d{2} \d{4}$"),
)
ISO_SHAPE = r"^\d{4}(-\d{1,2}(-\d{1,2}([ T]\d{1,2}:\d{1,2}(:\d{1,2}(\.\d{1,9})?)?(Z|[+-]\d{2}:?\d{2})?)?)?)?$"


def lenient_timestamp(c: Column | str) -> Column:
    """Timestamp by ISO rules, else by the first layout that fits, else null.

    A failed parse is costly, so each layout is tried only on text of its shape.
    """
    text = F.trim(as_column(c))
    tried = [F.when(text.rlike(ISO_SHAPE), text.try_cast("timestamp"))]
    tried += [F.when(text.rlike(shape), F.try_to_timestamp(text, F.lit(layout))) for layout, shape in DATE_LAYOUTS]
    return F.coalesce(*tried)


def key_hash(key: str | Sequence[str]) -> Column:
    """32 hex digits that depend only on the row key: the same order on every engine and run."""
    names = [key] if isinstance(key, str) else list(key)
    texts = [F.coalesce(quoted(n).cast("string"), F.lit("")) for n in names]
    return F.md5(texts[0] if len(texts) == 1 else F.concat_ws("|", *texts))


def fingerprint(columns: Sequence[str]) -> Column:
    """Content fingerprint of a row: first 16 hex digits of SHA-1 over its text form."""
    texts = [F.coalesce(quoted(c).cast("string"), F.lit("")) for c in columns]
    return F.substring(F.sha1(F.concat_ws("|", *texts)), 1, 16)


def finite_nested(c: Column, dtype: T.DataType) -> Column:
    """Replace NaN and infinities by null at any depth of arrays, maps and structs."""
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return finite_or_null(c)
    if isinstance(dtype, T.ArrayType):
        return F.transform(c, lambda x: finite_nested(x, dtype.elementType))
    if isinstance(dtype, T.MapType):
        return F.transform_values(c, lambda _, v: finite_nested(v, dtype.valueType))
    if isinstance(dtype, T.StructType):
        fields = [finite_nested(c.getField(f.name), f.dataType).alias(f.name) for f in dtype.fields]
        return F.when(c.isNotNull(), F.struct(*fields))
    return c


def finite_frame(df: DataFrame) -> DataFrame:
    """`finite_nested` over every column."""
    return df.select(*[finite_nested(quoted(f.name), f.dataType).alias(f.name) for f in df.schema.fields])


def merge_maps(base: Column, override: Column) -> Column:
    """Map union in which non-null entries of `override` win."""
    present = F.map_filter(override, lambda _, v: v.isNotNull())
    kept = F.map_filter(base, lambda k, _: ~F.map_contains_key(present, k))
    return F.map_concat(kept, present)


def sorted_entries(m: Column) -> Column:
    return F.array_sort(F.map_entries(m))
