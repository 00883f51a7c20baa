"""Dates, amounts and keyword tests on raw export text, all native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_TIME = r"(?:(?:T| +)(\d{1,2}):(\d{2})(?::(\d{2}(?:\.\d{1,6})?))?(?: *([AaPp])\.?[Mm]\.?)?)?(?: *(?:Z|UTC|GMT|[+-]\d{2}:?\d{2}))?"
# Accepted date shapes in the order they are tried, with the groups that
# hold year, month and day. Three two-digit numbers start with the year when they can.
DATE_SHAPES = [
    (r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})" + _TIME + "$", (1, 2, 3)),
    (r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4})" + _TIME + "$", (3, 1, 2)),
    (r"^(\d{1,2})[- ]([A-Za-z]{3,9})[- ,]+(\d{4})" + _TIME + "$", (3, 2, 1)),
    (r"^([A-Za-z]{3,9})[- .]+(\d{1,2})[- ,]+(\d{4})" + _TIME + "$", (3, 1, 2)),
    (r"^(\d{4})(\d{2})(\d{2})" + _TIME + "$", (1, 2, 3)),
    (r"^(\d{1,2})[-/.](0?[1-9]|1[0-2])[-/.](0?[1-9]|[12]\d|3[01])" + _TIME + "$", (1, 2, 3)),
    (r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{2})" + _TIME + "$", (3, 1, 2)),
    (r"^(\d{1,2})[- ]([A-Za-z]{3,9})[- ,]+(0?[1-9]|[12]\d|3[01])" + _TIME + "$", (1, 2, 3)),
    (r"^(\d{1,2})[- ]([A-Za-z]{3,9})[- ,]+(\d{2})" + _TIME + "$", (3, 2, 1)),
    (r"^([A-Za-z]{3,9})[- .]+(\d{1,2})[- ,]+(\d{2})" + _TIME + "$", (3, 1, 2)),
]
WEEKDAY = r"(?i)^(mon|tue|wed|thu|fri|sat|sun)[a-z]*\.?,? +"
# Two-digit years from here on are in the last century (a fixed border, whatever today is).
CENTURY_FROM = 69
# strptime directives as pattern letters
DIRECTIVES = {"Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "b": "MMM", "B": "MMMM", "H": "HH", "I": "hh", "M": "mm", "S": "ss",
              "f": "SSSSSS", "p": "a", "a": "EEE", "A": "EEEE", "%": "'%'"}
MONTHS = "janfebmaraprmayjunjulaugsepoctnovdec"
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def _from_parts(parts: Column) -> Column:
    """Timestamp from ``[year, month, day, hour, minute, second, a or p]`` texts; a name may stand for the month."""
    at = F.instr(F.lit(MONTHS), F.lower(F.substring(parts[1], 1, 3)))
    named = F.when(at % 3 == 1, ((at + 2) / 3).cast("int"))
    year, day = parts[0].try_cast("int"), parts[2].try_cast("int")
    year = F.when(F.length(parts[0]) > 2, year).when(year < CENTURY_FROM, year + 2000).otherwise(year + 1900)
    month = F.coalesce(parts[1].try_cast("int"), named)
    # a leading zero gives absent parts the value 0
    hour, minute = (F.concat(F.lit("0"), parts[i]).try_cast("int") for i in (3, 4))
    second = F.concat(F.lit("0"), parts[5]).try_cast("decimal(16,6)")
    half = F.lower(parts[6])
    hour = F.when(half == "", hour).when((hour >= 1) & (hour <= 12), hour % 12 + F.when(half == "p", 12).otherwise(0))
    # month first; a month that cannot be is the day
    swap = month > 12
    return F.try_make_timestamp_ntz(
        year, F.when(swap, day).otherwise(month), F.when(swap, month).otherwise(day), hour, minute, second
    )


def _pattern(date_format: str) -> str:
    """A strptime format as a datetime pattern."""
    out, at = "", 0
    while at < len(date_format):
        letter = date_format[at]
        if letter == "%":
            at += 1
            if date_format[at:at + 1] not in DIRECTIVES:
                raise ValueError(f"directive not supported: %{date_format[at:at + 1]}")
            out += DIRECTIVES[date_format[at]]
        else:
            out += f"'{letter}'" if letter.isalpha() else "''" if letter == "'" else letter
        at += 1
    return out


def parse_date(text: Column, date_format: str | None = None) -> Column:
    """Zone-less timestamp from mixed date text; null when no shape fits.

    Slash dates are month first; when that month cannot be, the day is read first. A
    weekday before the date and a zone behind it are skipped: the time stays as written.
    Missing parts are never filled in from today's date. ``date_format`` (strptime
    directives) is tried before the shapes. The text is cut once into its parts, whatever
    its shape.
    """
    text = F.trim(text.cast("string"))
    plain = F.regexp_replace(text, WEEKDAY, "")
    cut = F
    for pattern, groups in DATE_SHAPES:
        order = "|".join(f"${g}" for g in (*groups, 4, 5, 6, 7))
        cut = cut.when(plain.rlike(pattern), F.regexp_replace(plain, pattern, order))
    parts = F.split(cut, r"\|")
    found = F.transform(F.array(parts), _from_parts)[0]
    if date_format is None:
        return found
    return F.coalesce(F.try_to_timestamp(text, F.lit(_pattern(date_format))).cast("timestamp_ntz"), found)


def date_column(name: str, type_name: str, date_format: str | None = None) -> Column:
    """Typed date columns pass through; anything else is parsed as text."""
    if type_name in ("date", "timestamp", "timestamp_ntz"):
        return F.col(f"`{name}`").cast("timestamp_ntz")
    return parse_date(F.col(f"`{name}`"), date_format)


def parse_amount(text: Column) -> Column:
    """Number from text such as ``$1,234.50``; null when it is not plainly a number."""
    clean = F.trim(F.regexp_replace(text.cast("string"), "[$,]", ""))
    return F.when(clean.rlike(NUMBER), clean.try_cast("double"))


def matched_keywords(text: Column, keywords: list[str]) -> Column:
    """Keywords found in the text, in list order; plain substrings, any case."""
    upper = F.upper(F.coalesce(text.cast("string"), F.lit("")))
    found = F.array(*[F.when(upper.contains(k.upper()), F.lit(k)) for k in keywords])
    return F.array_compact(found)


def contains_any(text: Column, keywords: list[str]) -> Column:
    upper = F.upper(F.coalesce(text.cast("string"), F.lit("")))
    hit = F.lit(False)
    for keyword in keywords:
        hit = hit | upper.contains(keyword.upper())
    return hit


def date_text(value: Column) -> Column:
    return F.coalesce(F.date_format(value, "yyyy-MM-dd"), F.lit(""))


def component_list(ids: Column) -> Column:
    """``"a, b,,c"`` as ``[a, b, c]``; null gives an empty list."""
    parts = F.transform(F.split(F.coalesce(ids, F.lit("")), ","), lambda p: F.trim(p))
    return F.filter(parts, lambda p: p != "")
