"""Dates: reading the exports' many spellings, keys, windows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from keepsake.functions.text import col, let, strip

# The spellings met in exports, by what a date starts with; tried in this order.
FORMATS = {
    r"^[A-Za-z]+\.? \d": (
        "MMM d, yyyy, h:mm:ss a z", "MMM d, yyyy, h:mm:ss a", "MMM d, yyyy, H:mm:ss",
        "MMM d, yyyy", "MMMM d, yyyy, h:mm:ss a z", "MMMM d, yyyy, h:mm:ss a", "MMMM d, yyyy"),
    r"^\d{1,2} [A-Za-z]": ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss z", "d MMM yyyy HH:mm Z"),
    r"^\d{4}-": ("yyyy-MM-dd HH:mm:ss z", "yyyy-MM-dd HH:mm:ss Z"),
    r"^\d{4}/": ("yyyy/MM/dd HH:mm:ss", "yyyy/MM/dd"),
    r"^\d{1,2}/": ("M/d/yyyy, h:mm:ss a", "M/d/yyyy H:mm", "M/d/yyyy"),
}
_DIGITS = r"^\d+$"


def plain_date(c: Column | str) -> Column:
    """ISO first, then the formats that fit the start of the text; unreadable text gives null."""
    # Noise: the weekday in front, a remark such as "(UTC)" behind, narrow blanks before AM/PM.
    bare = F.regexp_replace(strip(c), r"^[A-Za-z]{3,9},\s+(?=\d)|\s*\([^)]*\)$", "")
    clean = F.regexp_replace(bare, r"[\s\x{202F}]+", " ")

    def read(text: Column) -> Column:
        out = F.lit(None).cast("timestamp")
        for shape, formats in reversed(list(FORMATS.items())):
            tried = [F.try_to_timestamp(text, F.lit(f)) for f in formats]
            if shape == r"^\d{4}-":
                tried.insert(0, text.try_cast("timestamp"))
            out = F.when(text.rlike(shape), F.coalesce(*tried)).otherwise(out)
        return out

    return let(clean, read)


def _from_ms(ms: Column) -> Column:
    # Outside years 0001..9999 there is no timestamp to give.
    ok = (ms >= -62135596800000) & (ms < 253402300800000)
    return F.when(ok, F.timestamp_millis(F.when(ok, ms).cast("long")))


def forum_date(c: Column | str) -> Column:
    """Numbers below 1e10 are seconds, others milliseconds; other text is a date."""
    n = strip(c).try_cast("double")
    n = F.when(strip(c) != "", n)
    return F.coalesce(_from_ms(F.when(n < 1e10, n * 1000).otherwise(n)),
                      F.when(n.isNull(), plain_date(c)))


def chat_date(c: Column | str, is_number: Column | None = None) -> Column:
    """Numbers above 1e12 are milliseconds, others seconds; strings are dates."""
    n = col(c).cast("string").try_cast("double")
    if is_number is not None:
        n = F.when(is_number, n)
    return F.coalesce(_from_ms(F.when(n > 1e12, n).otherwise(n * 1000)),
                      F.when(n.isNull(), plain_date(c)))


def takeout_date(c: Column | str) -> Column:
    """Digits above 1e15 are microseconds, above 1e10 milliseconds, others seconds."""
    text = strip(c)
    n = F.when(text.rlike(_DIGITS), text.try_cast("double"))
    ms = F.when(n > 1e15, n / 1000).when(n > 1e10, n).otherwise(n * 1000)
    return F.coalesce(_from_ms(ms), F.when(n.isNull(), plain_date(c)))


def bookmark_date(c: Column | str, webkit_epoch: bool = True) -> Column:
    """Bookmark times count microseconds from 1601; False reads them from 1970 instead."""
    if not webkit_epoch:
        return takeout_date(c)
    n = strip(c).try_cast("double")
    return F.coalesce(
        F.when(n > 1e16, _from_ms(n / 1000 - 11644473600000.0)), takeout_date(c))


# --- Keys ----------------------------------------------------------------------------------------

def day_key(ts: Column | str) -> Column:
    return F.date_format(col(ts), "yyyy-MM-dd")


def month_key(ts: Column | str) -> Column:
    return F.date_format(col(ts), "yyyy-MM")


def quarter_key(ts: Column | str) -> Column:
    c = col(ts)
    return F.concat(F.year(c).cast("string"), F.lit("-Q"), F.quarter(c).cast("string"))


def hour_of_day(ts: Column | str, tz: str | None = None) -> Column:
    c = col(ts)
    return F.hour(F.from_utc_timestamp(c, tz) if tz else c)


def conversation_key(ms: Column | str) -> Column:
    return F.date_format(F.timestamp_millis(col(ms)), "yyyy-MM-dd_HH")


def iso(ts: Column | str) -> Column:
    """ISO-8601 text in UTC with milliseconds."""
    return F.date_format(col(ts), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def iso_seconds(ts: Column | str) -> Column:
    return F.coalesce(F.date_format(col(ts), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("no date"))


# --- Windows -------------------------------------------------------------------------------------

def in_window(ts: Column | str, lower: Column | None = None, upper: Column | None = None) -> Column:
    """Window test in which undated rows pass."""
    c = col(ts)
    ok = F.lit(True)
    if lower is not None:
        ok = ok & (lower.isNull() | (c >= lower))
    if upper is not None:
        ok = ok & (upper.isNull() | (c <= upper))
    return c.isNull() | ok


def in_timeframe(ts: Column | str, start: Column, end: Column) -> Column:
    """Inclusive bounds in which undated rows fail; without both bounds everything passes."""
    return start.isNull() | end.isNull() | F.coalesce(col(ts).between(start, end), F.lit(False))
