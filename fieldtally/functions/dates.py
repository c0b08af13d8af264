"""Mixed date text to UTC timestamps, and month buckets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldtally.functions.categories import category_key
from fieldtally.functions.text import strip

# English month names a date may spell out, in full or by three letters.
MONTHS = [
    "january", "february", "march", "april", "may", "june",
    "july", "august", "september", "october", "november", "december",
]

CLOCK = r"(?:[ T]+(\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?))?$"
ISO = (
    r"^\d{4}(-\d{1,2}(-\d{1,2}([ T]+\d{1,2}:\d{1,2}(:\d{1,2}(\.\d+)?)?"
    r"\s*(Z|UTC|[+-]\d{2}:?\d{2}|[+-]\d{2})?)?)?)?\s*$"
)
YEAR, DAY, MONTH, AFTER_MONTHS = r"(\d{4})", r"(\d{1,2})", "(0?[1-9]|1[0-2])", r"(1[3-9]|[2-9]\d)"
# in full, by three letters, or as "sept"
NAME = "(" + "|".join(
    f"{m[:3]}(?=(?:{m[3:]}{'|t' if m == 'september' else ''})?(?![a-z]))" for m in MONTHS
) + ")[a-z]*"

# Numeric spellings and their ISO order. Month first; day first only where that reading is impossible.
CENTURY = (("20", r"([0-6]\d|7[0-5])"), ("19", r"(7[6-9]|[89]\d)"))  # years of two digits: 00-75 and 76-99
REORDER = [
    (rf"^{MONTH}[/.-]{YEAR}$", "$2-$1"),
    *((rf"^{MONTH}[/.-]{DAY}[/.-]{years}{CLOCK}", f"{century}$3-$1-$2 $4") for century, years in CENTURY),
    *((rf"^{AFTER_MONTHS}[/.-]{MONTH}[/.-]{years}{CLOCK}", f"{century}$3-$2-$1 $4") for century, years in CENTURY),
    (rf"^{YEAR}(\d{{2}})(\d{{2}}){CLOCK}", "$1-$2-$3 $4"),
    (rf"^{YEAR}[/.]{DAY}[/.]{DAY}{CLOCK}", "$1-$2-$3 $4"),
    (rf"^{MONTH}[/.-]{DAY}[/.-]{YEAR}{CLOCK}", "$3-$1-$2 $4"),
    (rf"^{AFTER_MONTHS}[/.-]{MONTH}[/.-]{YEAR}{CLOCK}", "$3-$2-$1 $4"),
]
# Spellings with a month name, brought to "day month year time".
SPELT = [
    (rf"(?i)^{NAME}\.?,?[ -]{YEAR}$", "1 $1 $2 "),
    *((rf"(?i)^{DAY}[ -]{NAME}\.?,?[ -]{years}{CLOCK}", f"$1 $2 {century}$3 $4") for century, years in CENTURY),
    *((rf"(?i)^{NAME}\.?[ -]{DAY},?[ -]{years}{CLOCK}", f"$2 $1 {century}$3 $4") for century, years in CENTURY),
    (rf"(?i)^{DAY}[ -]{NAME}\.?,?[ -]{YEAR}{CLOCK}", "$1 $2 $3 $4"),
    (rf"(?i)^{NAME}\.?[ -]{DAY},?[ -]{YEAR}{CLOCK}", "$2 $1 $3 $4"),
]
SPELT_FORM = "d MMM yyyy[ ][H:mm][:ss][.SSSSSS]"


def _rewritten(text: Column, rules: list[tuple[str, str]]) -> Column:
    for pattern, order in rules:
        text = F.regexp_replace(text, pattern, order)
    return text


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once; it also keeps the generated code short."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _iso(text: Column) -> Column:
    """NULL for text of another form and for a day that does not exist, never an error."""
    return F.when(text.rlike(ISO), text.try_cast("timestamp"))


def _any_form(text: Column) -> Column:
    spelt = F.try_to_timestamp(F.rtrim(_rewritten(text, SPELT)), F.lit(SPELT_FORM))
    return F.coalesce(_iso(text), _bound(_rewritten(text, REORDER), _iso), spelt)


def parse_dates(value: Column, kind: str) -> Column:
    """A zone-less UTC timestamp, or NULL where the value is missing or not a date.

    A column that already is a timestamp comes back untouched, so a range test on it still
    reaches the Parquet reader. Offsets move to UTC (the session zone is UTC).
    """
    if kind == "time":
        return value.cast("timestamp_ntz")
    if kind != "text":
        return F.lit(None).cast("timestamp_ntz")
    # the commonest form, a plain day, is told by its shape without running any pattern
    dash = F.lit("-")
    plain = (F.length(value) == 10) & (F.substring(value, 5, 1) == dash) & (F.substring(value, 8, 1) == dash)
    moment = F.when(plain, value.try_cast("timestamp")).otherwise(_bound(strip(value), _any_form))
    return moment.cast("timestamp_ntz")


def month_bucket(moment: Column) -> Column:
    return category_key(F.date_format(moment, "yyyy-MM"))
