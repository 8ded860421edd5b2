"""Text expressions: cleaning, length and boilerplate filters, quality scores, sanitising. All stay in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
BOILERPLATE = ("cookie policy", "privacy policy", "terms of service", "all rights reserved", "copyright", "subscribe", "newsletter")
BOILERPLATE_SHORT = ("cookie policy", "privacy policy", "terms of service")
QUALITY_ISSUES = ("test", "placeholder", "todo", "fixme", "xxx")
#: White space, letters and digits of Unicode, spelled out so that every engine reads them alike.
SPACE = r"[\t\n\x0b\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
WORD = r"[\p{L}\p{N}_]"
NOT_CLEAN = r"[^\p{L}\p{N}_ .,!?;:\-]"
STRUCTURED = (rf"^{WORD}+\([^)]+\)", rf"^{WORD}+:{SPACE}*{WORD}+", rf"^\p{{Nd}}+{SPACE}+\p{{Nd}}+")
DANGEROUS = (r"\.\./", r"\.\.\\", r"^/etc/", r"^/usr/", r"^C:\\Windows", r"<script", r"javascript:", r"on\w+\s*=", r"eval\s*\(", r"exec\s*\(", r"__import__")
MIN_LENGTH, MAX_LENGTH = 10, 4096

STRING_OPS = ("lower", "upper", "strip", "replace", "contains")


def string_op(column: Column, operation: str, pattern: str | None = None, replacement: str | None = None, regex: bool = False) -> Column:
    """lower, upper, strip, replace (literal unless `regex`) or contains (a regular expression; gives a boolean)."""
    if operation in ("lower", "upper"):
        return getattr(F, operation)(column)
    if operation == "strip":
        return F.regexp_replace(column, f"^{SPACE}+|{SPACE}+$", "")
    if operation == "replace":
        return F.regexp_replace(column, pattern, replacement or "") if regex else F.replace(column, F.lit(pattern), F.lit(replacement or ""))
    if operation == "contains":
        return column.rlike(pattern)
    raise ValueError(f"operation must be one of {STRING_OPS}")


def has_any(text: Column, words: tuple[str, ...]) -> Column:
    """Whether the lower-cased text contains one of the words."""
    low = F.lower(text)
    return reduce(lambda a, b: a | b, [low.contains(w) for w in words])


def clean(text: Column) -> Column:
    """White space collapsed, everything but word characters and .,!?;:- removed, trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, f"{SPACE}+", " "), NOT_CLEAN, ""))


def normalize(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, f"{SPACE}+", " "))


def reject_reason(text: Column, min_length: int = MIN_LENGTH, max_length: int = MAX_LENGTH, boilerplate: bool = True) -> Column:
    """Why a text is rejected: 'No text field', 'length_filter' or 'boilerplate'; null if it passes."""
    cleaned = clean(text)
    n = F.length(cleaned)
    out = F.when(text.isNull(), "No text field").when((n < min_length) | (n > max_length), "length_filter")
    return out.when(has_any(cleaned, BOILERPLATE), "boilerplate") if boilerplate else out


def words(text: Column) -> Column:
    return F.size(F.filter(F.split(text, f"{SPACE}+"), lambda w: w != ""))


def text_quality(text: Column) -> Column:
    """0 for less than 10 characters; else 1, times .8 below 50 characters, times .7 below 5 words."""
    short = F.coalesce(F.length(string_op(text, "strip")) < MIN_LENGTH, F.lit(True))
    return F.when(short, 0.0).otherwise(F.when(F.length(text) < 50, 0.8).otherwise(1.0) * F.when(words(text) < 5, 0.7).otherwise(1.0))


def instruction_format(instruction: Column) -> Column:
    structured = reduce(lambda a, b: a | b, [instruction.rlike(p) for p in STRUCTURED])
    return F.when(structured, "structured").otherwise("natural_language")


def instruction_quality(instruction: Column, min_length: int = 5) -> Column:
    n = F.length(instruction)
    by_length = F.when(n < min_length, 0.3).when(n > 1000, 0.8).otherwise(1.0)
    return by_length * F.when(has_any(instruction, QUALITY_ISSUES), 0.5).otherwise(1.0)


def sanitize(text: Column, max_length: int | None = None) -> Column:
    """Dangerous patterns, NULs and control characters removed, trimmed, cut to `max_length`."""
    out = reduce(lambda t, p: F.regexp_replace(t, f"(?i){p}", ""), DANGEROUS, text)
    out = string_op(F.regexp_replace(out, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", ""), "strip")
    return F.substring(out, 1, max_length) if max_length else out
