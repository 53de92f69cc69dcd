"""Column functions on text: stripping, first match of several patterns, blocks between keywords."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ignore case, ^ and $ at line feeds, and only the line feed ends a line.
FLAGS = "(?imd)"


def strip(c: Column) -> Column:
    """Without white space at both ends, that is what \\s matches; Spark's trim takes spaces only unless it is told."""
    return F.btrim(c, F.lit(" \t\n\x0b\f\r"))


def strip_chars(c: Column, chars: str) -> Column:
    """Without any of the characters, given as the inside of a character class, at both ends."""
    return F.regexp_replace(c, rf"\A[{chars}]+|[{chars}]+\z", "")


def squeeze(c: Column) -> Column:
    return F.regexp_replace(c, r"\s+", " ")


def normalised(c: Column) -> Column:
    """One kind of line end and no no-break spaces; null stays null."""
    # Most texts have neither, which a plain look tells.
    ends = F.when(F.contains(c, F.lit("\r")), F.regexp_replace(c, r"\r\n?", "\n")).otherwise(c)
    return F.when(F.contains(c, F.lit(" ")), F.translate(ends, " ", " ")).otherwise(ends)


def first_match(text: Column, patterns, flags: str = FLAGS) -> Column:
    """Group 1, stripped, of the first pattern that matches, even if it is empty; null if none does."""
    tries = [F.when(F.rlike(text, F.lit(flags + p)), strip(F.regexp_extract(text, flags + p, 1))) for p in patterns]
    return F.coalesce(*tries)


def all_matches(text: Column, pattern: str, group: int = 1, flags: str = FLAGS) -> Column:
    return F.regexp_extract_all(text, F.lit(flags + pattern), F.lit(group))


def block(text: Column, starts, ends) -> Column:
    """What follows the first start keyword that occurs, up to the first end keyword or the end; empty if none occurs."""
    stop = "|".join(ends)
    return F.coalesce(first_match(text, [rf"(?:{s})\s*[:\-]?\s*\n?(.*?)(?:{stop}|\z)" for s in starts], "(?is)"), F.lit(""))


def lines(text: Column) -> Column:
    """Stripped lines that are not blank."""
    return F.filter(F.transform(F.split(text, "\n"), strip), lambda x: x != "")


def tokens(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda x: x != "")


def contains_any(c: Column, words) -> Column:
    """Whether any of the words occurs in c, which is worked out once."""
    return F.rlike(c, F.lit("|".join(rf"\Q{w}\E" for w in words))) if words else F.lit(False)


def count_of(c: Column, words) -> Column:
    """How many of the words occur in c; overlapping words count each. Inside a lambda c is worked out for each word: bind it."""
    return sum((c.contains(w).cast("int") for w in words), F.lit(0))
