"""Text expressions shared by the normalization jobs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The language-tag shape accepted for text evidence.
LANGUAGE_TAG = r"\A[a-z]{2,3}(?:-[A-Za-z0-9]{2,8})*\z"
# What counts as an e-mail address, a URL or a phone-like digit run.
EMAIL_LIKE = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
URL_LIKE = r"(?i)https?://"
PHONE_LIKE = r"(?<!\p{Nd})(?:\+?\p{Nd}[ .()-]?){8,}\p{Nd}(?!\p{Nd})"

_SPACE = r"[\s\u001c-\u001f\u0085\p{Z}]"


def has_text(value: Column) -> Column:
    """Non-null and not made of white space only."""
    return F.coalesce(value.rlike(r"[^\s\p{Z}]"), F.lit(False))


def nonblank(value: Column) -> Column:
    """The value itself, or null when it is blank."""
    return F.when(has_text(value), value)


def fold_case(value: Column) -> Column:
    """Case folding for German and English text (``lower`` keeps the sharp s)."""
    return F.replace(F.lower(value), F.lit("ß"), F.lit("ss"))


def trim_space(value: Column) -> Column:
    return F.regexp_replace(value, rf"\A{_SPACE}+|{_SPACE}+\z", "")


def slug(value: Column) -> Column:
    """Lower-case ASCII slug: other runs become one hyphen, none at the ends."""
    return F.regexp_replace(F.regexp_replace(fold_case(value), "[^a-z0-9]+", "-"), r"\A-+|-+\z", "")


def alias_key(value: Column) -> Column:
    """Retailer alias form: folded, punctuation and space runs to one space, null when nothing is left."""
    folded = fold_case(trim_space(value))
    return F.nullif(F.trim(F.regexp_replace(folded, "[^a-z0-9äöüß]+", " ")), F.lit(""))


def clean(value: Column, max_len: int = 160) -> Column:
    """Drop control characters, collapse white space, cut to a bound; null when empty."""
    return F.nullif(F.substring(F.trim(without_controls(value, _SPACE)), 1, max_len), F.lit(""))


def without_controls(value: Column, space: str) -> Column:
    """Control characters dropped, runs of ``space`` (a character class) made one space."""
    return F.regexp_replace(F.regexp_replace(value, r"[\x00-\x1f\x7f]", ""), f"{space}+", " ")


def log_safe(value: Column, max_len: int = 512) -> Column:
    """One terminal-safe line: escape sequences removed, control characters replaced, bounded."""
    return log_line(F.regexp_replace(value, r"\x1b(?:\[[0-?]*[ -/]*[@-~]|\][^\x07]*(?:\x07|\x1b\\))", ""), max_len)


def log_line(value: Column, max_len: int = 512) -> Column:
    """One line, control characters replaced (that of an escape sequence too), bounded."""
    text = F.regexp_replace(value, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "?")
    text = F.regexp_replace(text, r"[\r\n\t]", " ")
    return F.when(F.length(text) > max_len, F.concat(F.substring(text, 1, max_len - 1), F.lit("…"))).otherwise(text)


def pii_like(value: Column) -> Column:
    """Text that looks like it holds an address, a link or a phone number."""
    return value.rlike(EMAIL_LIKE) | value.rlike(URL_LIKE) | value.rlike(PHONE_LIKE)


def csv_safe(value: Column) -> Column:
    """Quote cells a spreadsheet would run as a formula."""
    risky = value.rlike(r"\A[\t\r\n]") | value.rlike(r"\A[\s\p{Z}]*[=+\-@]")
    return F.when(risky, F.concat(F.lit("'"), value)).otherwise(value)


def sorted_set(value: Column) -> Column:
    return F.array_sort(F.array_distinct(value))
