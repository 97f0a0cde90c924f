"""Scalar column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def col(name: str) -> Column:
    """A column whose name may hold dots, slashes or blanks."""
    return F.col(f"`{name}`")


def clean_double(c: Column) -> Column:
    """Number, with text that does not parse, null and NaN as 0 (infinities stay)."""
    return F.coalesce(F.nanvl(c.try_cast("double"), F.lit(0.0)), F.lit(0.0))


def clean_float(c: Column) -> Column:
    """`clean_double` at single precision."""
    return clean_double(c).cast("float")


def number(df: DataFrame, name: str, as_type: str = "double") -> Column:
    """`clean_double` of a column, without the text steps where its type is already numeric."""
    c, kind = col(name), df.schema[name].dataType
    if isinstance(kind, (T.FloatType, T.DoubleType)):
        return F.coalesce(F.nanvl(c, F.lit(0.0).cast(kind)), F.lit(0.0).cast(kind)).cast(as_type)
    if isinstance(kind, (T.IntegralType, T.DecimalType, T.BooleanType)):
        return F.coalesce(c.cast(as_type), F.lit(0.0).cast(as_type))
    return clean_double(c).cast(as_type)


def float_lit(value: float) -> Column:
    return F.lit(float(value)).cast("float")


def finite_or_null(c: Column) -> Column:
    """Infinities and NaN as null."""
    return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), None).otherwise(c)


def ratio(num: Column, den: Column) -> Column:
    """num / den, 0 where den is not positive."""
    return F.when(den > 0, num / den).otherwise(F.lit(0.0))


def clip(c: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def sigmoid(c: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-c))


def lower_text(c: Column) -> Column:
    """Trimmed lower-case text, null as empty."""
    return F.lower(F.trim(F.coalesce(c.cast("string"), F.lit(""))))


def alnum_key(c: Column) -> Column:
    """Lower-case letters and digits only."""
    return F.regexp_replace(F.lower(F.trim(c)), r"[^\p{L}\p{N}]", "")


def squashed(c: Column) -> Column:
    """Lower-case text without byte-order mark and without any white space."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[\uFEFF\\s]+", "")


def safe_file_name(c: Column) -> Column:
    """Letters, digits, '-' and '_' kept, anything else as '_'."""
    return F.regexp_replace(c, r"[^\p{L}\p{N}_\-]", "_")


def iso_utc(micros: Column) -> Column:
    """Epoch microseconds as ISO text with Z; the fraction is left out when it is zero."""
    ts = F.to_utc_timestamp(F.timestamp_micros(micros), F.current_timezone())
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    part = F.pmod(micros, F.lit(1_000_000))
    return F.concat(whole, F.when(part != 0, F.concat(F.lit("."), F.lpad(part.cast("string"), 6, "0")))
                    .otherwise(F.lit("")), F.lit("Z"))


# Identity columns of a flow, in key order.
KEY_COLUMNS = [
    "flow_id", "pcap_file", "__source_file__", "__source_path__",
    "src_ip", "dst_ip", "src_port", "dst_port", "protocol",
]


def flow_key(columns: list[str]) -> Column:
    """SHA-1 over the identity columns at hand; blank parts are left out.

    A row with no identity at all is keyed by its whole content.
    """
    parts = [F.nullif(F.trim(col(c).cast("string")), F.lit("")) for c in KEY_COLUMNS if c in columns]
    whole = F.to_json(F.struct(*[col(c) for c in sorted(columns)]))
    if not parts:
        return F.sha1(whole)
    joined = F.concat_ws("|", *parts)
    return F.sha1(F.when(joined == "", whole).otherwise(joined))
