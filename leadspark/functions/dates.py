"""Date grammar as Column expressions: rewrite each notation to year-month-day, then cast once.

The rewrites are a chain of anchored replacements that each leave foreign notations alone, and the final
try-cast checks the calendar. A value that is no date costs a few failed matches and never an
exception per format.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadspark import fixed_values as fv
from leadspark.functions.binding import let

_CLOCK = (r"[ T]+(\d{1,2}):(\d{2})(?::\d{2}(?:[.,]\d+)?)?(?: ?([AaPp][Mm]))?"
          r"(?: ?(?:Z|z|UTC|GMT|[+-]\d{2}:?\d{2}))?$")

# Clock times without a colon -> with one.
_CLOCKS = [
    (r"^(\d{8})T(\d{2})(\d{2})(?:[0-5]\d)?$", "$1 $2:$3"),
    (r"[ T]+(\d{1,2}) ?([AaPp][Mm])$", " $1:00 $2"),
]
_WEEKDAY = "(?:mon|tue|wed|thu|fri|sat|sun|monday|tuesday|wednesday|thursday|friday|saturday|sunday)"

# Notation -> year-month-day, tried in this order. Month names are numbers by then ("~6~").
_REWRITES = [
    (r"^(\d{4})[/.](\d{1,2})[/.](\d{1,2})$", "$1-$2-$3"),
    (r"^(\d{4})(\d{2})(\d{2})$", "$1-$2-$3"),
    (r"^(\d{2})(\d{2})(\d{2})$", "$1/$2/$3"),
    (r"^(\d{4})$", "$1-1-1"),
    (r"^(\d{1,2})[/\-](\d{4})$", "$2-$1-1"),
    (r"^(\d{4})[/\-](\d{1,2})$", "$1-$2-1"),
    (r"^(3[2-9]|[4-9]\d)([/.])(\d{1,2})\2(\d{1,2})$", "$1-$3-$4"),  # no day either: year first
    (r"^(1[3-9]|2\d|3[01])([/.\-])(\d{1,2})\2(\d{4}|\d{1,2})$", "$4-$3-$1"),  # no month: day first
    (r"^([01]?\d)([/.\-])(\d{1,2})\2(\d{4}|\d{1,2})$", "$4-$1-$3"),
]
_NAMED_REWRITES = [
    (r"^~(\d+)~\.?[ \-](\d{1,2})(?:st|nd|rd|th)?,?[ \-](\d{4}|\d{1,2})$", "$3-$1-$2"),
    (r"^(\d{4}|3[2-9]|[4-9]\d)[ \-]~(\d+)~\.?,?[ \-](\d{1,2})$", "$1-$2-$3"),
    (r"^(\d{1,2})(?:st|nd|rd|th)?[ \-]~(\d+)~\.?,?[ \-](\d{4}|\d{1,2})$", "$3-$2-$1"),
    (r"^~(\d+)~\.?,? (\d{4})$", "$2-$1-1"),
]


def _apply(value: Column, rewrites: list[tuple[str, str]]) -> Column:
    for pattern, replacement in rewrites:
        value = F.regexp_replace(value, pattern, replacement)
    return value


def _without_weekday(part: Column) -> Column:
    """The value without a weekday before or behind a whole date; beside less, a weekday would decide the day."""
    def whole(rest: Column) -> Column:
        return F.when(rest.rlike("[A-Za-z]{3}"), rest.rlike(r"\d\D+\d")).otherwise(rest.rlike(r"^\d+\D+\d+\D+\d+$|^\d{6}(?:\d{2})?$"))

    rest = F.regexp_replace(F.regexp_replace(part, rf"(?i)^{_WEEKDAY}\b[.,]* *", ""), rf"(?i)[, ]+{_WEEKDAY}$", "")
    return let(rest, lambda r: F.when(whole(r), r).otherwise(part))


def _number_months(part: Column) -> Column:
    numbers = {n: i for i, m in enumerate(fv.MONTHS, 1) for n in (m, m[:3])}
    numbers["sept"] = 9
    table = F.expr("map(" + ", ".join(f"'{n}', '~{i}~'" for n, i in numbers.items()) + ")")
    word = F.regexp_extract(part, "([A-Za-z]{3,9})", 1)
    return F.regexp_replace(part, F.lit("[A-Za-z]{3,9}"), F.coalesce(F.element_at(table, F.lower(word)), F.lit("?")))


def _cast_ymd(ymd: Column, as_of: Column) -> Column:
    ymd = F.regexp_replace(ymd, "^([0-9])-", "0$1-")
    # 2-digit years lie within the 50 years after as_of or before it
    this_century = (F.substring(ymd, 1, 2).try_cast("int") + 2000) < F.year(as_of) + 50
    century = F.when(~ymd.rlike("^[0-9]{2}-"), "").when(this_century, "20").otherwise("19")
    return F.when(ymd.rlike(r"^[0-9]+-[0-9]{1,2}-[0-9]{1,2}$"), F.concat(century, ymd)).try_cast("date")


def parse_date(cleaned: Column, as_of: Column) -> Column:
    """DATE of a whitespace-cleaned value, or NULL. ``as_of`` is a DATE and sets the 2-digit year pivot."""
    dated = let(F.regexp_replace(_apply(cleaned, _CLOCKS), _CLOCK, ""), lambda part: F.when(
        part.rlike("[A-Za-z]{3}"), let(part, _without_weekday)).otherwise(part))
    ymd = let(dated, lambda part: F.when(
        part.rlike("[A-Za-z]{3}"), _apply(let(part, _number_months), _NAMED_REWRITES)
    ).otherwise(_apply(part, _REWRITES)))
    parsed = let(ymd, lambda v: _cast_ymd(v, as_of))
    return let(parsed, lambda d: F.when(d.between(F.lit("1678-01-01").cast("date"),
                                                  F.lit("2261-12-31").cast("date")), d))


def parse_minutes(cleaned: Column) -> Column:
    """Minutes after midnight shown by the value's clock time (0 without one); NULL if out of range."""
    return let(_apply(cleaned, _CLOCKS), _clock_minutes)


def _clock_minutes(cleaned: Column) -> Column:
    hour = F.regexp_extract(cleaned, _CLOCK, 1).try_cast("int")
    minute = F.regexp_extract(cleaned, _CLOCK, 2).try_cast("int")
    half = F.lower(F.regexp_extract(cleaned, _CLOCK, 3))
    in_range = (minute <= 59) & F.when(half == "", hour <= 23).otherwise(hour.between(1, 12))
    hour24 = F.when(half == "", hour).otherwise(hour % 12 + F.when(half == "pm", 12).otherwise(0))
    return F.when(cleaned.contains(":"), F.when(in_range, hour24 * 60 + minute)).otherwise(F.lit(0))


def format_date(date: Column) -> Column:
    return F.date_format(date, "MM/dd/yyyy")


def format_minutes(minutes: Column) -> Column:
    """" HH:mm", or nothing at midnight."""
    return let(minutes, lambda m: F.when(m > 0, F.date_format(F.timestamp_seconds(m * 60), " HH:mm"))
               .when(m == 0, F.lit("")))
