"""Numbers read from cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldtally.functions.text import strip

NUMBER = r"(?i)^[+-]?((\d+\.?\d*|\.\d+)(e[+-]?\d+)?|inf|infinity)$"


def to_number(value: Column, kind: str) -> Column:
    """A double, or NULL where the cell is missing or is not a number."""
    if kind in ("whole", "real", "bool"):
        return value.cast("double")
    if kind == "text":
        bare = strip(value)
        return F.when(bare.rlike(NUMBER), bare.try_cast("double"))
    return F.lit(None).cast("double")


def quotient(a: Column, b: Column) -> Column:
    """True division: a zero divisor gives a signed infinity, zero by zero is missing."""
    a, b = a.cast("double"), b.cast("double")
    infinite = F.when(a > 0, F.lit(float("inf"))).when(a < 0, F.lit(float("-inf")))
    return F.when(b != 0, F.nanvl(F.try_divide(a, b), F.lit(None))).when(b == 0, infinite)


def floored_modulo(a: Column, b: Column) -> Column:
    """Remainder with the sign of the divisor; a zero divisor gives missing.

    The divisor is added only where the signs differ, so nothing leaves the range of the type.
    """
    rest = F.try_mod(a, b)
    return F.when(b != 0, F.when((rest != 0) & ((rest < 0) != (b < 0)), rest + b).otherwise(rest))


def progress_pct(actual: Column, target: Column) -> Column:
    """Actual as a percentage of the target, one decimal; missing without a usable target."""
    return F.round(F.lit(100.0) * actual / F.nullif(target.cast("double"), F.lit(0.0)), 1)


def shown_number(value: Column) -> Column:
    """A number as a report cell shows it: a whole one without a fraction, others to four places."""
    number = value.cast("double")
    whole = (number == F.floor(number)) & (F.abs(number) < 1e15)
    rounded = F.bround(number, 4)
    return F.when(whole, number.cast("bigint").cast("string")).otherwise(rounded.cast("string"))
