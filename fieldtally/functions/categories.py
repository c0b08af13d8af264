"""Category labels, their order, and spelling keys."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from fieldtally.functions.text import strip

# Fixed value: the label every report uses for an absent category.
MISSING = "(missing)"


def category_key(value: Column) -> Column:
    """Category text, with missing values under one label."""
    return F.coalesce(value.cast("string"), F.lit(MISSING))


def category_order(label: Column) -> list[Column]:
    """Sort keys: code-point order with the missing label last."""
    return [label == F.lit(MISSING), label]


def ordered_labels(labels: Sequence[str]) -> list[str]:
    return sorted(labels, key=lambda text: (text == MISSING, text))


def spelling_key(value: Column, suffixes: Sequence[str] = ()) -> Column:
    """Variants that differ in case, spacing or a listed suffix share this key."""
    key = F.lower(strip(F.regexp_replace(value, r"(?U)\s+", " ")))
    known = [f"\\Q{suffix.strip().lower()}\\E" for suffix in suffixes if suffix.strip()]
    return F.regexp_replace(key, rf"(?: (?:{'|'.join(known)}))+\z", "") if known else key
