"""Text expressions: trimming, activity lists, redaction, caps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python counts as white space.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The same, without the plain blank, as a pattern.
ODD_BLANK = "[" + "".join(f"\\u{ord(c):04x}" for c in WHITESPACE if c != " ") + "]"

# What counts as a phone number or a GPS pair, and its replacement.
PHONE = (
    r"\+?38\s?0\d{2}[\s-]?\d{3}[\s-]?\d{2}[\s-]?\d{2}"
    r"|\+380[\s-]\d{2}[\s-]\d{3}[\s-]\d{2}[\s-]\d{2}"
    r"|\b0\d{9}\b"
    r"|\+\d{11,14}"
)
GPS_PAIR = (
    r"\b\d{2}\.\d{4,}\s*,\s*\d{2}\.\d{4,}\b"
    r"|\b\d{2}\.\d{4,}\s+\d{2}\.\d{4,}\b"
)
REDACTED = "[REDACTED]"

# Document cap and its marker, control characters no workbook cell may hold.
DOCUMENT_CAP = 30_000
TRUNCATED = "\n[... document truncated ...]"
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f]"

# Every alternative starts with one of these characters: testing that first skips most of a text.
PHONE_SEARCH = f"(?U)(?=[+03])(?:{PHONE})"
GPS_SEARCH = rf"(?U)(?=\d)(?:{GPS_PAIR})"


def strip(value: Column) -> Column:
    return F.btrim(value, F.lit(WHITESPACE))


def _literal(separator: str) -> str:
    """A pattern for the separator itself; one character needs no regex engine when splitting."""
    if len(separator) == 1:
        return separator if separator.isalnum() or separator in " ,;_-/" else "\\" + separator
    return "\\Q" + separator.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def split_activities(value: Column, separator: str | None) -> Column:
    """The activities named in one cell; an empty array for a missing or blank cell."""
    text = value.cast("string")
    if not separator:
        parts = trimmed = F.array(strip(text))
    else:
        literal = _literal(separator)
        parts = F.transform(F.split(strip(text), literal), strip)
        # with plain blanks only, splitting can do the trimming without touching each part
        if separator == " ":
            trimmed = F.split(text, literal)
        elif separator == separator.strip(" "):
            trimmed = F.split(F.trim(text), f" *{literal} *")
        else:
            trimmed = parts
    parts = F.when(text.rlike(ODD_BLANK), parts).when(text.isNotNull(), trimmed)
    return F.coalesce(F.array_remove(parts, ""), F.array().cast("array<string>"))


def is_personal(value: Column) -> Column:
    """True where the text holds a phone number or a GPS pair anywhere."""
    return value.rlike(PHONE_SEARCH) | value.rlike(GPS_SEARCH)


def redact(value: Column) -> Column:
    """Phones first, then GPS pairs in what is left."""
    without_phones = F.regexp_replace(value, PHONE_SEARCH, REDACTED)
    return F.regexp_replace(without_phones, GPS_SEARCH, REDACTED)


def redaction_count(value: Column) -> Column:
    without_phones = F.regexp_replace(value, PHONE_SEARCH, REDACTED)
    return F.regexp_count(value, F.lit(PHONE_SEARCH)) + F.regexp_count(
        without_phones, F.lit(GPS_SEARCH)
    )


def cap_chars(value: Column, cap: int = DOCUMENT_CAP, marker: str = TRUNCATED) -> Column:
    return F.when(
        F.length(value) > cap, F.concat(F.substring(value, 1, cap), F.lit(marker))
    ).otherwise(value)


def cap_bytes(value: Column, cap: int) -> Column:
    """The longest valid UTF-8 prefix within ``cap`` bytes (a character has at most four)."""
    raw = F.encode(value, "UTF-8")
    prefixes = [
        F.try_validate_utf8(F.substring(raw, 1, max(cap - back, 0)).cast("string"))
        for back in range(4)
    ]
    return F.when(F.octet_length(value) > cap, F.coalesce(*prefixes)).otherwise(value)


def strip_control(value: Column) -> Column:
    return F.regexp_replace(value, CONTROL, "")
