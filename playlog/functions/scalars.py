"""Column helpers with exact semantics; all stay on the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MINUTE = 60_000_000
HOUR = 60 * MINUTE
DAY = 24 * HOUR
KEY_MARK = "\x1f"


def norm(c: Column) -> Column:
    """Null as the empty text; Unicode white space stripped."""
    return F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"(?U)^\s+|\s+$", "")


def blank_as(c: Column, label: str) -> Column:
    return F.when(c == "", F.lit(label)).otherwise(c)


def pyround(v: Column, n: int) -> Column:
    """Rounds a non-negative double to n decimals, half to even on its exact binary value."""
    if n == 0:
        return F.rint(v)
    k = float(10**n)
    split = v * F.lit(134217729.0)
    hi = split - (split - v)
    lo = v - hi
    p = v * F.lit(k)
    e = (hi * F.lit(k) - p) + lo * F.lit(k)
    f = F.floor(p).cast("double")
    d = p - f
    up = (d > 0.5) | ((d == 0.5) & ((e > 0) | ((e == 0) & (f % 2 == 1))))
    return (f + F.when(up, 1.0).otherwise(0.0)) / F.lit(k)


def share(part: Column, whole: Column) -> Column:
    """100 * part / whole to one decimal; 0 where whole is 0."""
    return F.when(whole == 0, 0.0).otherwise(pyround(F.lit(100.0) * part / whole, 1))


def exact_mean(v: Column) -> Column:
    """Aggregate: the mean of doubles that are 0 or from 0.1 to 127, rounded once from the exact
    sum of their binary values.  Those are multiples of 2^-56, so they're summed as whole numbers."""
    whole = (v * F.lit(2.0**56)).cast("long").cast("decimal(20,0)")
    n = F.count(v).cast("decimal(18,0)")
    total = (F.sum(whole) * F.lit(1 << 20).cast("decimal(8,0)")).cast("decimal(38,0)")
    rest = (total % n).cast("decimal(38,0)")
    # the quotient has more bits than a double; a last one stands for all that follow
    quotient = ((total - rest).cast("decimal(38,0)") / n).cast("decimal(37,0)")
    return (quotient * 2 + F.when(rest > 0, 1).otherwise(0)).cast("double") / F.lit(2.0**77)


def micros(at: Column) -> Column:
    return F.unix_micros(at)


def span(start: Column, end: Column, unit: int) -> Column:
    """Time from start to end in units of microseconds, as a double computed from seconds."""
    return (micros(end) - micros(start)) / F.lit(1_000_000.0) / F.lit(unit / 1_000_000.0)


def iso(at: Column) -> Column:
    """ISO text with a space and the offset; microseconds only where there are any."""
    whole = F.date_format(at, "yyyy-MM-dd HH:mm:ssxxx")
    return F.when(micros(at) % 1_000_000 == 0, whole).otherwise(F.date_format(at, "yyyy-MM-dd HH:mm:ss.SSSSSSxxx"))


def iso_year(at: Column) -> Column:
    return F.extract(F.lit("YEAROFWEEK"), at)


def split_genres(c: Column) -> Column:
    """The distinct genres of a tag, lower-case, those of one character dropped."""
    parts = F.split(F.lower(norm(c)), r"[;,/|]+")
    return F.array_distinct(F.filter(F.transform(parts, lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), lambda x: F.length(x) > 1))


def first_year(c: Column) -> Column:
    """The first four digits in a text, as a number; null if there are none."""
    return F.regexp_extract(c.cast("string"), r"(\d{4})", 1).try_cast("int")


def as_int(c: Column, default: int = 0) -> Column:
    """A whole number, else the first run of digits, else the default."""
    text = norm(c)
    whole = F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("int"))
    real = F.when(text.rlike(r"^[+-]?\d+\.\d+$"), text.try_cast("double").try_cast("int"))
    found = F.coalesce(whole, real, F.regexp_extract(text, r"(\d+)", 1).try_cast("int"), F.lit(default))
    return F.when(found == 0, F.lit(default)).otherwise(found)


def parse_dt(c: Column, number: Column | None = None) -> Column:
    """A timestamp from text: epoch seconds, milliseconds or microseconds by size where it
    is all digits (or where `number` says that the stored value was a number), else ISO
    8601, without a zone as UTC; null if neither."""
    text = norm(c)
    numeric = text.rlike(r"^\d+(\.\d+)?$") | (F.coalesce(number, F.lit(False)) if number is not None else F.lit(False))
    value = text.try_cast("double")
    seconds = F.when(value > 1e13, value / 1e6).when(value > 1e10, value / 1e3).otherwise(value)
    epoch = F.when(F.abs(seconds) < 2.5e11, F.timestamp_micros(F.round(seconds * 1e6).cast("long")))
    shaped = text.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:\d{2}(:\d{2}([.,]\d+)?)?)?)?( ?(Z|[+-]\d{2}(:?\d{2})?))?$")
    plain = F.regexp_replace(F.regexp_replace(text, ",", "."), r"^(\S+)T", "$1 ")
    zoned = text.rlike(r"[T ].*(Z|[+-]\d{2}(:?\d{2})?)$")
    filled = F.regexp_replace(plain, r"^(\S+ \d{2}) ?(Z|[+-].*)?$", "$1:00:00$2")
    filled = F.regexp_replace(filled, r"^(\S+ \d{2}:\d{2}) ?(Z|[+-].*)?$", "$1:00$2")
    stamp = F.when(zoned, filled.try_cast("timestamp")).otherwise(F.concat(filled, F.lit("Z")).try_cast("timestamp"))
    day = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(text, F.lit(" 00:00:00Z")).try_cast("timestamp"))
    return F.when(text == "", None).when(numeric, epoch).when(shaped, F.coalesce(day, stamp))


def path_stem(path: Column) -> Column:
    """The last component of a path without its last suffix."""
    name = F.regexp_extract(path, r"([^/]*)/*$", 1)
    return F.regexp_replace(name, r"^(.+)\.[^.]+$", "$1")


def path_track_number(path: Column) -> Column:
    """The number that leads a file's name, 0 if none does."""
    return F.coalesce(F.regexp_extract(path_stem(norm(path)), r"^\s*(\d{1,3})(?:\s*[-._)\]]+\s*|\s+)", 1).try_cast("int"), F.lit(0))
