"""Tolerant text -> number / integer / datetime coercion.

Spark's own casts are both too strict (``'3.0'`` is not an int) and too
lenient (``'1.5d'`` is a double, ``'2024'`` a timestamp), so each coercion
first checks the text against a fixed pattern and only then casts. The final
cast to the column's type is an ANSI cast, so an out-of-range value fails
the job instead of wrapping.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Accepted text shapes.
NUMBER_PATTERN = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"
INFINITY_PATTERN = r"^(?i)[+-]?(inf|infinity)$"
# the two above as one pattern, so a value is matched once
NUMBER_OR_INF_PATTERN = r"^[+-]?(([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?|(?i:inf|infinity))$"
INTEGER_PATTERN = r"^[+-]?[0-9]+$"
DATETIME_PATTERN = (r"^[0-9]{4}-[0-9]{2}-[0-9]{2}([ T][0-9]{2}:[0-9]{2}"
                    r"(:[0-9]{2}([.][0-9]{1,9})?(Z|[+-][0-9]{2}:[0-9]{2})?)?)?$")
# a zone right after the minutes, which the cast does not read
ZONED_MINUTE_PATTERN = r"^([0-9]{4}-[0-9]{2}-[0-9]{2}[ T][0-9]{2}:[0-9]{2})(Z|[+-][0-9]{2}:[0-9]{2})$"
# Other ways to write a datetime, by name: the order of month, day
# and year, and what stands between them. A time may follow, of a day or of twelve
# hours with AM or PM. Where a column fits several, the first one is taken.
_YEAR, _MONTH, _DAY = "([0-9]{4})", "(0?[1-9]|1[0-2])", "(0?[1-9]|[12][0-9]|3[01])"
_TIME = (r"(?:[ T]+((?:[01]?[0-9]|2[0-3]):[0-5][0-9](?::[0-5][0-9](?:[.][0-9]{1,9})?)?))?"
         r"|[ T]+((?:0?[1-9]|1[0-2]):[0-5][0-9](?::[0-5][0-9](?:[.][0-9]{1,9})?)?) *(?:[Aa]|([Pp]))[Mm]")
DATETIME_FORMATS = {
    "iso": None,
    "month/day/year": (f"{_MONTH}/{_DAY}/{_YEAR}", "$3-$1-$2"),
    "day/month/year": (f"{_DAY}/{_MONTH}/{_YEAR}", "$3-$2-$1"),
    "month-day-year": (f"{_MONTH}-{_DAY}-{_YEAR}", "$3-$1-$2"),
    "day-month-year": (f"{_DAY}-{_MONTH}-{_YEAR}", "$3-$2-$1"),
    "day.month.year": (f"{_DAY}[.]{_MONTH}[.]{_YEAR}", "$3-$2-$1"),
    "year/month/day": (f"{_YEAR}/{_MONTH}/{_DAY}", "$1-$2-$3"),
    "yearmonthday": (r"([0-9]{4})(0[1-9]|1[0-2])(0[1-9]|[12][0-9]|3[01])", "$1-$2-$3"),
}
# Whitespace a numeric parser skips around a value (C isspace).
EDGE_WS = " \t\n\x0b\x0c\r"
# Tolerance under which a parsed value counts as whole.
WHOLE_TOLERANCE = 1e-9

# pickup/dropoff column pairs converted to datetimes when both are present.
DATETIME_PAIRS = (
    ("tpep_pickup_datetime", "tpep_dropoff_datetime"),
    ("lpep_pickup_datetime", "lpep_dropoff_datetime"),
    ("pickup_datetime", "dropoff_datetime"),
)

_INT_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip_ws(c: Column | str) -> Column:
    return F.btrim(_col(c), F.lit(EDGE_WS))


def is_number_text(c: Column | str, allow_inf: bool = True) -> Column:
    return strip_ws(c).rlike(NUMBER_OR_INF_PATTERN if allow_inf else NUMBER_PATTERN)


def is_integer_text(c: Column | str) -> Column:
    return strip_ws(c).rlike(INTEGER_PATTERN)


def _parsed_double(c: Column | str) -> Column:
    """Number text -> double. Only the words inf/infinity give an infinity: a
    numeral beyond the double range (``1e400``) is NULL, as pandas makes it."""
    s = strip_ws(c)
    d = s.cast("double")
    return (F.when(s.rlike(NUMBER_PATTERN), F.when(F.abs(d) < F.lit(float("inf")), d))
             .when(s.rlike(INFINITY_PATTERN), d))


def to_number(c: Column | str, target: T.DataType = T.DoubleType()) -> Column:
    """Text -> number of ``target``; text that is not a number becomes NULL.

    Decimals are parsed exactly from the text (no detour through double);
    infinities are kept for floating types only.
    """
    s = strip_ws(c)
    if isinstance(target, T.DecimalType):
        return F.when(s.rlike(NUMBER_PATTERN) & _parsed_double(c).isNotNull(), s).cast(target)
    return _parsed_double(c).cast(target)


def fraction_flag(c: Column | str) -> Column:
    """True when the text parses as a number that is not whole (nulled by P7)."""
    s = strip_ws(c)
    d = _parsed_double(c)
    frac = F.when(d.isNotNull(), F.pmod(d, F.lit(1.0)))
    return (~s.rlike(INTEGER_PATTERN)) & d.isNotNull() & ~F.coalesce(frac <= WHOLE_TOLERANCE, F.lit(False))


def to_integer(c: Column | str, target: T.DataType = T.LongType()) -> Column:
    """Text -> integer of ``target``.

    Plain integer text is cast exactly (no loss above 2**53). Other numeric
    text is accepted when it is whole within 1e-9 (``3.0``, ``1e3``), else NULL.
    The final ANSI cast fails the job on overflow (``70000`` into smallint).
    """
    s = strip_ws(c)
    d = _parsed_double(c)
    frac = F.pmod(d, F.lit(1.0))
    whole = F.when(s.rlike(INTEGER_PATTERN), s.cast("bigint")).when(
        frac <= WHOLE_TOLERANCE, (d - frac).cast("bigint"))
    return whole if isinstance(target, T.LongType) else whole.cast(target)


def to_datetime(c: Column | str, target: T.DataType = T.TimestampNTZType(), fmt: str = "iso") -> Column:
    """Date or datetime text in one format -> timestamp; anything else (incl. 2024-02-30) NULL.

    A trailing ``Z`` or offset of ISO text is dropped and the written wall time
    kept; digits of a second beyond the sixth are cut off. The other formats
    take hours of a day, or of twelve with AM or PM.
    """
    s = strip_ws(c)
    if fmt == "iso":
        return (F.when(s.rlike(DATETIME_PATTERN), s.try_cast(target))
                 .when(s.rlike(ZONED_MINUTE_PATTERN), F.regexp_extract(s, ZONED_MINUTE_PATTERN, 1).try_cast(target)))
    pattern, order = _pattern(fmt), DATETIME_FORMATS[fmt][1]
    ts = F.regexp_replace(s, pattern, order + " $4$5").try_cast(T.TimestampNTZType())
    # hours of twelve: 12 is the first of each half
    half = F.upper(F.regexp_extract(s, "([AaPp])[Mm]$", 1))
    hours = F.when(half == "P", 12).otherwise(0) - F.when((half != "") & (F.hour(ts) == 12), 12).otherwise(0)
    return F.when(s.rlike(pattern), ts + F.make_dt_interval(hours=hours)).cast(target)


def _pattern(fmt: str) -> str:
    return f"^{DATETIME_FORMATS[fmt][0]}(?:{_TIME})$"


def datetime_fits(c: Column | str) -> Column:
    """The formats that a text is written in, as a number with a bit for each of
    them; NULL for NULL. ``bit_and`` of it over a column has the formats that all
    values are written in. A day that its month does not have fits by its form."""
    others = F.lit(0)
    for i, f in enumerate(DATETIME_FORMATS):
        if f != "iso":
            others = others + F.when(strip_ws(c).rlike(_pattern(f)), F.lit(1 << i)).otherwise(F.lit(0))
    return F.when(_col(c).isNotNull(), F.when(to_datetime(c).isNotNull(), F.lit(1)).otherwise(others))


def fitting_formats(bits: int | None) -> list[str]:
    """Names of the formats in a number of :func:`datetime_fits`, the preferred first."""
    return [f for i, f in enumerate(DATETIME_FORMATS) if (bits or 0) >> i & 1]


def is_integral_type(t: T.DataType) -> bool:
    return isinstance(t, _INT_TYPES)


def is_numeric_type(t: T.DataType) -> bool:
    return isinstance(t, (T.FloatType, T.DoubleType, T.DecimalType))
