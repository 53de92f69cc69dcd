"""Header fields of a document from its text. Every function takes a text column and returns a column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.dates import normal_date
from ..functions.ids import gstins, normal_gstin
from ..functions.layers import let
from ..functions.money import amount
from ..functions.text import all_matches, block, contains_any, first_match, lines, strip
from ..plans import constants as K

PARTY = ("name", "address", "gstin", "state", "state_code", "pan", "email", "phone")
BANK = ("bank_name", "account_number", "ifsc", "branch", "swift")
FIELD = "struct<value: string, confidence: double, source: string, page_number: int, needs_review: boolean>"


def field(value: Column, confidence: float, source: Column | str) -> Column:
    """An extracted field; without a value its confidence is 0. What is below medium needs a review."""
    known = value.isNotNull()
    sure = F.when(known, F.lit(confidence)).otherwise(F.lit(0.0))
    src = F.lit(source) if isinstance(source, str) else source
    return F.struct(value.alias("value"), sure.alias("confidence"), src.alias("source"), F.lit(None).cast("int").alias("page_number"), (sure < K.MEDIUM).alias("needs_review"))


def _usable(number: Column) -> Column:
    return number.isNotNull() & ~F.lower(number).isin(*K.NOT_A_NUMBER) & (number != "")


def fiscal_year_shapes(year: str = K.FISCAL_YEAR) -> list[str]:
    """Numbers with a fiscal year inside, such as AB/25-26/0012, for years of a pattern."""
    return [rf"\b([A-Z0-9]{{2,5}}/[A-Z0-9\-]+/{year}/\d{{2,6}})\b", rf"\b([A-Z0-9]{{2,5}}/{year}/\d{{2,6}})\b", rf"\b([A-Z0-9]{{3,5}}-{year}-\d{{2,6}})\b"]


def _below_header(text: Column) -> Column:
    """The first token that could be a number in the twenty lines below a line with the word invoice."""
    clean = lambda t: F.regexp_replace(t, r"^[^A-Za-z0-9]+|[^A-Za-z0-9]+$", "")

    def good(t: Column) -> Column:
        return F.length(t).between(5, 21) & t.rlike(r"\d") & t.rlike(r"^[A-Za-z0-9\-/]+$") & ~t.rlike(r"(?i)^[0-9a-f]{15,}") & ~F.lower(t).isin(*K.NUMBER_REJECTS)

    def of(line: Column) -> Column:
        found = F.filter(F.transform(F.split(line, r"\s+"), clean), good)
        return F.when(contains_any(F.lower(line), K.ADDRESS_WORDS), None).otherwise(F.get(found, 0))

    def search(all_lines: Column, candidates: Column) -> Column:
        after = lambda i: F.get(F.filter(F.slice(candidates, i + 2, 20), lambda c: c.isNotNull()), 0)
        per_header = F.transform(all_lines, lambda x, i: F.when(F.rlike(x, F.lit(r"(?i)\bInvoice\b")), after(i)))
        return F.get(F.filter(per_header, lambda c: c.isNotNull()), 0)

    return let(F.split(text, "\n"), lambda ls: let(F.transform(ls, of), lambda cs: search(ls, cs)))


def invoice_number(text: Column) -> Column:
    """By label, else by the shape of a number with a fiscal year, else below a header; null if none is found."""
    usable = lambda c: let(c, lambda x: F.when(_usable(x), x))
    return F.coalesce(usable(first_match(text, K.NUMBER_PATTERNS)), first_match(text, fiscal_year_shapes()), usable(_below_header(text)))


def invoice_date(text: Column, strict_compat: bool = False) -> Column:
    """By label, else on or shortly below a line with the word date, else the first date of any shape; null if none."""
    labelled = first_match(text, [rf"{label}\s*{shape}" for label in K.DATE_LABELS for shape in K.DATES])
    def near(all_lines: Column) -> Column:
        # Lines first, then shapes: the nearest line wins.
        shortly = lambda i: F.coalesce(*[first_match(F.get(all_lines, i + k), K.DATES) for k in range(4)])
        hits = F.transform(all_lines, lambda x, i: F.when(F.rlike(x, F.lit(r"(?i)\bdated?\b")), shortly(i)))
        return F.get(F.filter(hits, lambda c: c.isNotNull()), 0)

    found = F.coalesce(labelled, let(F.split(text, "\n"), near), first_match(text, K.DATES))
    return let(found, lambda c: normal_date(c, strict_compat))


def total_text(text: Column, strict_compat: bool = False) -> Column:
    """The total as printed. Outside strict_compat a generic total is no part of a sub total or a tax total."""
    anchor = r"\b" if strict_compat else r"(?<![A-Za-z][ \t-])(?<![A-Za-z])"
    return first_match(text, [p.replace("{anchor}", anchor) for p in K.TOTAL_PATTERNS])


def subtotal(text: Column) -> Column:
    return F.coalesce(amount(first_match(text, K.SUBTOTAL_PATTERNS)), F.lit(0.0))


def round_off(text: Column) -> Column:
    return F.coalesce(first_match(text, K.ROUND_OFF_PATTERNS).try_cast("double"), F.lit(0.0))


def or_blank(text: Column, patterns) -> Column:
    return F.coalesce(first_match(text, patterns), F.lit(""))


def bank(text: Column) -> Column:
    return let(first_match(text, K.BANK_BRANCH), lambda branch: _bank(text, branch))


def _bank(text: Column, branch: Column) -> Column:
    parts = F.split(branch, "&")
    own = F.regexp_extract(F.array_join(F.slice(parts, 2, 9), "&"), r"([A-Z]{4}\d{7})", 1)
    code = F.when(F.rlike(branch, F.lit(r"[A-Z]{4}\d{7}")) & (own != ""), own).otherwise(or_blank(text, K.BANK_IFSC))
    return F.struct(
        or_blank(text, K.BANK_NAME).alias("bank_name"),
        or_blank(text, K.BANK_ACCOUNT).alias("account_number"),
        code.alias("ifsc"),
        F.coalesce(strip(F.get(parts, 0)), F.lit("")).alias("branch"),
        or_blank(text, K.BANK_SWIFT).alias("swift"),
    )


def party(text: Column) -> Column:
    """Name, address, identifiers and contacts of a party from its block of text."""
    # The block and its lines are found once, not for each field.
    return let(text, lambda own: let(lines(own), lambda own_lines: _party(own, own_lines)))


def _party(text: Column, own: Column) -> Column:
    clean = lambda xs: F.transform(xs, lambda x: strip(F.regexp_replace(F.regexp_replace(x, "[|'\"-]", ""), r"\s+", " ")))
    named = F.filter(clean(own), lambda x: ~F.lower(x).isin(*K.PARTY_REJECTS) & (F.length(x) > 3) & ~x.rlike(r"(?i)Invoice\s*No"))

    def taken(rest: Column) -> Column:
        """Lines up to the first that names a field."""
        stop = F.array_position(F.transform(rest, lambda x: x.rlike(K.ADDRESS_STOP)), F.lit(True)).cast("int")
        return let(stop, lambda n: F.when(n > 0, F.slice(rest, 1, n - 1)).otherwise(rest))

    after = F.slice(own, 2, 100_000)
    address = F.filter(F.transform(let(after, taken), lambda x: strip(F.regexp_replace(x, r"\|", ""))), lambda x: ~F.lower(x).isin(*K.PARTY_REJECTS))
    return F.struct(
        F.coalesce(F.get(named, 0), F.lit("")).alias("name"),
        F.array_join(address, ", ").alias("address"),
        F.coalesce(normal_gstin(first_match(text, [K.GSTIN])), F.lit("")).alias("gstin"),
        or_blank(text, [r"State\s*(?:Name)?\s*[:\-]?\s*(.+?)(?:,|Code|\n|$)"]).alias("state"),
        or_blank(text, [r"Code\s*[:\-]?\s*(\d{1,2})"]).alias("state_code"),
        F.upper(or_blank(text, [r"PAN\s*(?:No)?\.?\s*[:\-]?\s*([A-Z]{5}\d{4}[A-Z])"])).alias("pan"),
        F.regexp_extract(text, r"[\w.+-]+@[\w-]+\.[\w.]+", 0).alias("email"),
        or_blank(text, [r"(?:Phone|Mobile|Tel|Contact)\s*(?:No)?\.?\s*[:\-]?\s*([\d\-\s+]{10,15})"]).alias("phone"),
    )


def seller_block(text: Column) -> Column:
    return strip(F.regexp_extract(text, r"(?is)\A\s*(.*?)(?:" + "|".join(K.SELLER_ENDS) + r"|\z)", 1))


def buyer_block(text: Column) -> Column:
    return block(text, K.BUYER_STARTS, K.BUYER_ENDS)


def ship_block(text: Column) -> Column:
    return block(text, K.SHIP_STARTS, K.SHIP_ENDS)


def assigned_gstins(text: Column, seller: Column, buyer: Column) -> Column:
    """Seller's and buyer's identifier, as a struct; a missing one is the first of the text that the other doesn't have."""
    none = F.array().cast("array<string>")

    def of(found: Column) -> Column:
        s = F.coalesce(F.when(seller != "", seller), F.get(F.filter(found, lambda x: x != buyer), 0), F.lit(""))
        return let(s, lambda s: F.struct(s.alias("seller"), F.coalesce(F.when(buyer != "", buyer), F.get(F.filter(found, lambda x: x != s), 0), F.lit("")).alias("buyer")))

    # The text is searched only where one is missing.
    return let(F.when((seller != "") & (buyer != ""), none).otherwise(gstins(text)), of)


def emails(text: Column) -> Column:
    return all_matches(text, r"([\w.+-]+@[\w-]+\.[\w.]+)", 1, "")
