"""Column functions on tax and vendor identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.constants import GSTIN, GSTIN_VALID
from .layers import let
from .text import all_matches

#: First and last place, and whether digits or letters stand there.
_SLOTS = ((1, 2, "digit"), (3, 7, "letter"), (8, 11, "digit"), (12, 12, "letter"), (13, 13, "digit"))


def normal_gstin(c: Column) -> Column:
    """Upper case without spaces, letters read where digits stand turned into those digits and the other way round."""
    turned = {"digit": ("OILS", "0115"), "letter": ("015", "OIS")}

    def of(s: Column) -> Column:
        parts = [F.translate(F.substring(s, a, b - a + 1), *turned[kind]) for a, b, kind in _SLOTS]
        return F.concat(*parts, F.translate(F.substring(s, 14, 1), "27S0", "ZZZZ"), F.substring(s, 15, 1000))

    # Each place asks for the identifier, which may have been searched for.
    return let(F.upper(F.translate(c, " ", "")), of)


def gstins(text: Column) -> Column:
    """All identifiers in a text, repaired, each once, in order of first occurrence."""
    return F.array_distinct(F.transform(all_matches(text, GSTIN), normal_gstin))


def is_gstin(c: Column) -> Column:
    # What is upper case already needs no turning, which costs more than the search.
    return F.rlike(F.trim(c), F.lit(GSTIN_VALID)) | F.rlike(F.upper(F.trim(c)), F.lit(GSTIN_VALID))


def hashed_code(c: Column, prefix: str = "CMS", digits: int = 7) -> Column:
    """A prefix and the MD5 of c as a number, modulo a power of ten."""
    m = 10**digits
    word = lambda h, i: F.conv(F.substr(h, F.lit(i * 8 + 1), F.lit(8)), 16, 10).cast("long")

    def folded(h: Column) -> Column:
        # Written out: a fold over four words costs more than the words.
        n = F.lit(0).cast("long")
        for i in range(4):
            n = F.pmod(n * F.lit(1 << 32) + word(h, i), F.lit(m))
        return n

    n = let(F.md5(c), folded)
    return F.concat(F.lit(prefix), F.lpad(n.cast("string"), digits, "0"))
