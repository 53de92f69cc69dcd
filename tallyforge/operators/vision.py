"""Invoices from the JSON replies of a vision model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.layers import computed, let
from ..functions.money import percent
from ..functions.text import strip
from ..plans import constants as K
from .fields import field
from .lines import ITEM
from .taxes import DETAIL

_PARTY = "struct<name: string, address: string, gstin: string, state: string, state_code: string, pan: string, email: string, phone: string>"
REPLY = (
    f"struct<invoice_number: string, invoice_date: string, due_date: string, po_number: string, place_of_supply: string, reverse_charge: string, irn: string, ack_number: string, ack_date: string, seller: {_PARTY}, buyer: {_PARTY}, "
    "line_items: array<struct<sr_no: int, description: string, hsn_sac: string, quantity: double, unit: string, unit_price: double, taxable_amount: double, gst_rate: double>>, "
    "subtotal: double, round_off: double, grand_total: double, amount_in_words: string, bank: struct<bank_name: string, account_number: string, ifsc: string, branch: string, swift: string>>"
)
REQUIRED = ("invoice_number", "invoice_date")


def _text(c: Column) -> Column:
    return F.coalesce(strip(c), F.lit(""))


def inter_state(seller: Column, buyer: Column) -> Column:
    """Whether two identifiers name different states; no, if one is missing."""
    return (seller != "") & (buyer != "") & (F.left(seller, F.lit(2)) != F.left(buyer, F.lit(2)))


def _item(x: Column, pos: Column, away: Column) -> Column:
    base, rate = F.coalesce(x.taxable_amount, F.lit(0.0)), F.coalesce(x.gst_rate, F.lit(0.0))
    qty = F.when(F.coalesce(x.quantity, F.lit(0.0)) == 0, 1.0).otherwise(x.quantity)
    price = F.when(F.coalesce(x.unit_price, F.lit(0.0)) == 0, base / qty).otherwise(x.unit_price)
    igst = F.when(away & (rate > 0), percent(base, rate).cast("double")).otherwise(0.0)
    half = F.when(~away & (rate > 0), percent(base, rate, "0.005").cast("double")).otherwise(0.0)
    return F.struct(
        F.coalesce(x.sr_no, pos + 1).alias("sr_no"), _text(x.description).alias("description"), _text(x.hsn_sac).alias("hsn_sac"), qty.alias("quantity"), F.coalesce(x.unit, F.lit("pc")).alias("unit"),
        price.alias("unit_price"), F.lit(0.0).alias("discount"), base.alias("taxable_amount"), rate.alias("gst_rate"), half.alias("cgst_amount"), half.alias("sgst_amount"), igst.alias("igst_amount"),
        F.round(base + igst + half + half, 2).alias("total_amount"),
    ).cast(ITEM)


def tax_groups(items: Column) -> Column:
    """Tax rows by type and rate, half the rate for the two equal halves, in order of first occurrence."""
    one = lambda kind, rate, x, value: F.struct(F.lit(kind).alias("tax_type"), rate.alias("rate"), x.taxable_amount.alias("taxable_amount"), value.alias("tax_amount"))
    legs = F.flatten(F.transform(items, lambda x: F.array(one("IGST", x.gst_rate, x, x.igst_amount), one("CGST", x.gst_rate / 2, x, x.cgst_amount), one("SGST", x.gst_rate / 2, x, x.sgst_amount))))
    legs = F.filter(legs, lambda g: g.tax_amount > 0)

    def total(legs, h):
        own = F.filter(legs, lambda g: (g.tax_type == h.t) & (g.rate == h.r))
        s = lambda f: F.round(F.aggregate(F.transform(own, f), F.lit(0.0), lambda a, v: a + v), 2)
        return F.struct(h.t.alias("tax_type"), h.r.alias("rate"), s(lambda g: g.taxable_amount).alias("taxable_amount"), s(lambda g: g.tax_amount).alias("tax_amount")).cast(DETAIL)

    heads = lambda ls: F.array_distinct(F.transform(ls, lambda g: F.struct(g.tax_type.alias("t"), g.rate.alias("r"))))
    return let(legs, lambda ls: F.transform(heads(ls), lambda h: total(ls, h)))


def vision_invoices(replies: DataFrame, key: str = "doc_id", reply: str = "reply_json") -> DataFrame:
    """(key, invoice fields, error): replies that are no JSON of the schema, or lack a required string, have an error and nulls.

    The stated total stays unless it is further than one unit from what
    subtotal, taxes and round-off make.
    """
    r = F.col("r")
    out = computed(replies, {"r": F.from_json(reply, REPLY)}).select(key, "r")
    bad = r.isNull()
    for name in REQUIRED:
        bad = bad | F.col(f"r.{name}").isNull()
    out = out.withColumn("error", F.when(bad, "The reply is not an invoice"))
    away = inter_state(_text(F.col("r.seller.gstin")), _text(F.col("r.buyer.gstin")))
    out = computed(out, {"inter_state": away})
    items = F.transform(F.coalesce("r.line_items", F.array().cast("array<" + REPLY.split("line_items: array<")[1].split(">>")[0] + ">>")), lambda x, i: _item(x, i, F.col("inter_state")))
    out = computed(out, {"line_items": items})
    out = computed(out, {"tax_details": tax_groups(F.col("line_items"))})
    add = lambda a, f: F.aggregate(F.transform(a, f), F.lit(0.0), lambda s, v: s + v)
    out = out.withColumns(
        {
            "subtotal": F.when(F.coalesce("r.subtotal", F.lit(0.0)) == 0, F.round(add("line_items", lambda x: x.taxable_amount), 2)).otherwise(F.col("r.subtotal")),
            "total_tax": F.round(add("tax_details", lambda x: x.tax_amount), 2),
            "round_off": F.coalesce("r.round_off", F.lit(0.0)),
        }
    )
    due = F.round(F.col("subtotal") + F.col("total_tax") + F.col("round_off"), 2)
    stated = F.coalesce("r.grand_total", F.lit(0.0))
    out = out.withColumn("grand_total_value", F.when(F.abs(stated - due) > K.VISION_TOLERANCE, due).otherwise(stated))
    f = lambda c: field(_text(c), K.HIGH, "ocr")
    names = ("due_date", "po_number", "place_of_supply", "irn", "ack_number", "ack_date", "amount_in_words")
    return out.select(
        key, f(F.col("r.invoice_number")).alias("invoice_number"), f(F.col("r.invoice_date")).alias("invoice_date"), f(F.format_string("%.2f", "grand_total_value")).alias("grand_total"), "grand_total_value",
        *(_text(F.col(f"r.{n}")).alias(n) for n in names), F.coalesce(F.nullif(_text(F.col("r.reverse_charge")), F.lit("")), F.lit("No")).alias("reverse_charge"),
        "r.seller", "r.buyer", "r.bank", "inter_state", "line_items", "tax_details", "subtotal", "total_tax", "round_off", "error",
    )
