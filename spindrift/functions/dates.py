"""ISO-8601 strings as instants (session time zone UTC), and the rules on them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from spindrift.functions.text import clean_whitespace

ISO = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}(:?\d{2}(:?\d{2}([.,]\d+)?)?)?\s*(Z|[+-]\d{2}(:?\d{2})?)?)?$"


def instant(c: Column | str) -> Column:
    """Timestamp of a date or a timestamp; a missing offset means UTC, anything malformed null."""
    token = clean_whitespace(c)
    return F.when(token.rlike(ISO), F.try_to_timestamp(token)).otherwise(F.lit(None).cast("timestamp"))


def is_date_only(c: Column | str) -> Column:
    return clean_whitespace(c).rlike(r"^\d{4}-\d{2}-\d{2}$")


def normalized(c: Column | str) -> Column:
    """Date-only strings as dates, others as UTC timestamps with offset; null where malformed."""
    at = instant(c)
    micros = F.date_format(at, "SSSSSS")
    stamp = F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.when(micros == "000000", "").otherwise(F.concat(F.lit("."), micros)), F.lit("+00:00"))
    return F.when(is_date_only(c), F.date_format(at, "yyyy-MM-dd")).otherwise(stamp)


def start_floor(c: Column | str) -> Column:
    return F.coalesce(F.date_format(instant(c), "yyyy-MM-dd"), F.lit(""))


def end_exclusive(c: Column | str) -> Column:
    return F.coalesce(F.date_format(F.date_add(instant(c).cast("date"), 1), "yyyy-MM-dd"), F.lit(""))


def in_range(published: Column | str, start: str = "", end: str = "", undated: bool = False) -> Column:
    """Within the bounds. With any bound, undated rows fail unless undated; a date-only end holds its whole day."""
    if not start.strip() and not end.strip():
        return F.lit(True)
    at, ok = instant(published), F.lit(True)
    if start.strip():
        ok &= at >= instant(F.lit(start))
    if end.strip():
        until = instant(F.lit(end))
        ok &= F.when(is_date_only(F.lit(end)), at < until + F.expr("INTERVAL 1 DAY")).otherwise(at <= until)
    return F.coalesce(ok, F.lit(False)) | (F.lit(undated) & (clean_whitespace(published) == ""))


def earliest(dates: Column) -> Column:
    """Earliest of an array of strings, normalised; of one instant the timestamp before the date, then by text; '' if none is valid."""
    made = F.transform(dates, lambda d: F.struct(instant(d).alias("at"), F.when(is_date_only(d), -1).otherwise(-2).alias("precision"), normalized(d).alias("text")))
    valid = F.filter(made, lambda x: x["at"].isNotNull())
    return F.coalesce(F.array_min(valid)["text"], F.lit(""))


def earliest_of(c: Column | str) -> Column:
    """earliest as an aggregate over rows: nothing is gathered."""
    key = F.struct(instant(c).alias("at"), F.when(is_date_only(c), -1).otherwise(-2).alias("precision"), normalized(c).alias("text"))
    return F.coalesce(F.min(F.when(instant(c).isNotNull(), key))["text"], F.lit(""))


def relative_range(start: Column | str, end: Column | str, now: Column) -> Column:
    """Smallest of day, week, month, year before now that holds both bounds (no end: now); '' if none does or there is no start."""
    a, b = instant(start), F.coalesce(instant(end), now)
    out = F.when(a.isNull() | (b < a), "")
    for name, days in (("day", 1), ("week", 7), ("month", 31), ("year", 366)):
        since = now - F.expr(f"INTERVAL {days} DAY")
        out = out.when((a >= since) & (b >= since), name)
    return out.otherwise("")


def over_fetch(n: Column, most: int, multiplier: int = 2) -> Column:
    return F.least(F.lit(most), F.greatest(n, n * multiplier))


def date_parts(parts: Column) -> Column:
    """[year, month?, day?] as a date string; '' if malformed."""
    made = F.try_make_timestamp(F.get(parts, F.lit(0)), F.coalesce(F.get(parts, F.lit(1)), F.lit(1)), F.coalesce(F.get(parts, F.lit(2)), F.lit(1)), F.lit(0), F.lit(0), F.lit(0))
    return F.coalesce(F.date_format(made, "yyyy-MM-dd"), F.lit(""))


def pdf_date(c: Column | str) -> Column:
    """`D:YYYYMMDDHHmmSS…` as an ISO string; the date alone where there is no time."""
    token = clean_whitespace(c)
    day = F.regexp_replace(F.regexp_extract(token, r"^(?:D:)?(\d{8})", 1), r"(\d{4})(\d{2})(\d{2})", "$1-$2-$3")
    time = F.regexp_replace(F.regexp_extract(token, r"^(?:D:)?\d{8}(\d{6})", 1), r"(\d{2})(\d{2})(\d{2})", "$1:$2:$3")
    return F.when(day == "", "").when(time == "", day).otherwise(F.concat(day, F.lit("T"), time, F.lit("+00:00")))


def epoch(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
