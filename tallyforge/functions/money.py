"""Column functions on amounts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"


def amount(c: Column) -> Column:
    """The number that a printed amount means, as a double; 0 for what is none.

    Knows currency signs, commas at any places, a comma before two last digits
    as the decimal sign, and closing marks such as ``/-``.
    """
    s = F.regexp_replace(c, r"[₹\s\x{A0}]", "")
    s = F.regexp_replace(s, r"\A(?i:Rs\.?|INR)", "")
    s = F.regexp_replace(s, r"[)\]}>.,:;'\"|/\-]+\z", "")
    # A comma before two last digits is the decimal sign, unless there is a point anywhere.
    s = F.regexp_replace(s, r"\A([^.]*),(\d{2})\z", "$1.$2")
    s = F.regexp_replace(s, r"[^0-9.\-]", "")
    return F.coalesce(s.try_cast("double"), F.lit(0.0))


def money(c: Column) -> Column:
    """A printed amount as an exact decimal."""
    return amount(c).cast(MONEY)


def percent(base: Column, rate: Column, share: str = "0.01") -> Column:
    """Tax on a decimal base at a rate in percent. Multiplied, not divided, so that it is exact."""
    return F.round(base.cast(MONEY) * rate.cast("decimal(9,4)") * F.lit(share).cast("decimal(5,3)"), 2).cast(MONEY)


def rupees(c: Column) -> Column:
    return F.concat(F.lit("₹"), F.format_number(c, 2))


def percentage(c: Column, digits: int = 0) -> Column:
    return F.format_string(f"%.{digits}f%%", c * 100)
