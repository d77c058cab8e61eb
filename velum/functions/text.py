"""Text expressions with the semantics of the origin's regular expressions, as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Whitespace as browsers' \\s has it: more than Java's. Usable in Java and RE2 classes.
SPACES = r"\t\n\x{0b}\f\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
WS = f"[{SPACES}]"
#: \\b over ASCII word characters; Java's own also counts accented letters.
BOUNDARY = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
#: Typographic marks and their plain forms.
QUOTES_FROM, QUOTES_TO = "‘’‚‛“”„‟–—", "''''\"\"\"\"--"
CHARS_PER_PAGE = 3000
SCANNED_BELOW = 80
LOW_CONFIDENCE = 60


def java(pattern: str) -> str:
    """A pattern with {ws}, {nows} and {b} placeholders, for Java."""
    return pattern.replace("{ws}", WS).replace("{sp}", SPACES).replace("{nows}", f"[^{SPACES}]").replace("{b}", BOUNDARY)


def re2(pattern: str) -> str:
    """The same pattern for RE2, whose \\b is over ASCII already."""
    return pattern.replace("(?iu)", "(?i)").replace("{ws}", WS).replace("{sp}", SPACES).replace("{nows}", f"[^{SPACES}]").replace("{b}", r"\b")


def trim_all(c: Column) -> Column:
    """Without Unicode blanks at both ends."""
    return F.regexp_replace(c, f"^{WS}+|{WS}+\\z", "")


def escaped(c: Column) -> Column:
    """A literal, usable inside a regular expression."""
    return F.regexp_replace(c, r"([\\.*+?^${}()|\[\]])", r"\\$1")


def replacement(c: Column) -> Column:
    """A literal, usable as a replacement."""
    return F.regexp_replace(c, r"([\\$])", r"\\$1")


def literal_count(text: Column, literal: Column) -> Column:
    """Non-overlapping occurrences of a literal, whatever its case; 0 for an empty literal."""
    low, key = F.lower(text), F.lower(literal)
    return F.when(F.length(key) > 0, ((F.length(low) - F.length(F.replace(low, key, F.lit("")))) / F.length(key)).cast("int")).otherwise(F.lit(0))


def standalone_count(text: Column, literal: Column) -> Column:
    return F.regexp_count(text, F.concat(F.lit("(?iu)" + BOUNDARY), escaped(literal), F.lit(BOUNDARY)))


def plain_quotes(c: Column) -> Column:
    return F.translate(c, QUOTES_FROM, QUOTES_TO)


def page_count(text: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(F.length(text) / F.lit(CHARS_PER_PAGE)).cast("int"))


def unified_breaks(c: Column) -> Column:
    return F.regexp_replace(c, r"\r\n?", "\n")


def fused_letters(c: Column) -> Column:
    """Three or more single letters parted by single spaces become one word."""
    letter = "A-Za-zÀ-ÿ"
    inside = f"(?<![{letter}])(?:[{letter}] ){{2,}}[{letter}](?![{letter}])"
    parts = F.split(F.regexp_replace(c, f"({inside})", "\u0001$1\u0001"), "\u0001")
    return F.array_join(F.transform(parts, lambda x: F.when(x.rlike(f"^{inside}\\z"), F.replace(x, F.lit(" "), F.lit(""))).otherwise(x)), "")


def initials(c: Column) -> Column:
    """First letters of the parts of a name, each with a stop; null if it has no letters."""
    bare = trim_all(F.regexp_replace(F.regexp_replace(c, r"\(.*?\)", ""), "[0-9]", ""))
    parts = F.filter(F.transform(F.split(bare, f"[{SPACES}\\-_]+"), lambda p: F.regexp_replace(p, "[^A-Za-zÀ-ÿ]", "")), lambda p: F.length(p) > 0)
    return F.when(F.size(parts) > 0, F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lit("."))), " "))
