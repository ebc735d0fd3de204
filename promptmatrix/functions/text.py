"""Text functions that agree with Python's string methods."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Everything that str.strip() removes: Unicode white space and the four separators that Java's class leaves out.
_SPACE = r"[\s\x1c-\x1f\x85]"


def strip(c: Column) -> Column:
    """The text without white space at its ends; only a text whose first or last character may be white is searched."""
    plain = r"^[\x21-\x7e]"
    bare = F.substring(c, 1, 1).rlike(plain) & F.substring(c, -1, 1).rlike(plain)
    return F.when(bare | c.isNull(), c).otherwise(F.regexp_replace(c, rf"(?U)^{_SPACE}+|{_SPACE}+\z", ""))


def is_blank(c: Column) -> Column:
    return strip(c) == ""


def snip(c: Column, limit: int, mark: str = "…") -> Column:
    """The text if it has at most ``limit`` characters, else its first ``limit`` and a mark."""
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit(mark))).otherwise(c)


def snip_counted(c: Column, limit: int) -> Column:
    """Like ``snip``, saying how many characters are left out."""
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit("… ("), (F.length(c) - limit).cast("string"), F.lit(" more chars)"))).otherwise(c)


def guard_formula(c: Column) -> Column:
    """A cell that a spreadsheet would run as a formula, made text."""
    return F.when(F.ltrim(c).rlike(r"^[=+\-@]"), F.concat(F.lit("'"), c)).otherwise(c)


def escape_html(c: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def escape_markdown(c: Column) -> Column:
    """Text for one cell of a Markdown table."""
    c = F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\|"))
    return F.regexp_replace(c, r"\s*\R\s*", " ")


def hash_case_id(c: Column) -> Column:
    """A stable stand-in for a case id that may identify a person."""
    return F.concat(F.lit("case-"), F.substring(F.sha2(c.cast("binary"), 256), 1, 16))


def scrub(c: Column, secrets: list[str], mark: str = "[redacted]") -> Column:
    """Known secret values of eight characters or more replaced, longest first."""
    for value in sorted({s for s in secrets if len(s) >= 8}, key=len, reverse=True):
        c = F.replace(c, F.lit(value), F.lit(mark))
    return c
