"""Double-entry journal rows from invoices.

Slabs are the sums of an invoice's items by rate and code. Each makes an
expense row and its tax rows; two rows per invoice credit the vendor. Slabs are
grouped once; credits are sums over slabs of the same grouping, so the journal
costs two shuffles on the invoice's key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import fiscal_period
from ..functions.ids import hashed_code
from ..functions.layers import computed
from ..functions.money import MONEY, percent
from ..plans import constants as K

LEG = "struct<leg: string, seq: int, account: string, description: string, dr_cr: string, amount: decimal(18,2), rate: decimal(9,4), taxable: decimal(18,2)>"


def slabs(items: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, gst_rate, hsn, base, first_pos, description) of items(key, pos, gst_rate, hsn, base, description); first_pos orders slabs as first seen."""
    return items.groupBy(key, "gst_rate", F.trim("hsn").alias("hsn")).agg(F.sum("base").cast(MONEY).alias("base"), F.min("pos").alias("first_pos"), F.min_by("description", "pos").alias("description"))


def slab_base(slab_count: Column, base: Column, subtotal: Column) -> Column:
    """A slab's base; the subtotal if it is the only slab and has none."""
    return F.when((base <= 0) & (slab_count == 1), subtotal).otherwise(base)


#: Letters of a keyword that it is looked up by.
_GRAM, _SHARES = 3, 16


def _grams(text: Column, n: int = _GRAM) -> Column:
    """All stretches of n letters of a text, each once; none of a shorter one."""
    places = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(places, lambda i: F.substring(text, i, F.lit(n))))


def vendor_match(invoices: DataFrame, vendors: DataFrame, name: str = "seller", key: str = "doc_id") -> DataFrame:
    """invoices with vendor_code, gl_code and journal_type of the first vendor row whose keyword its seller's name contains.

    vendors(seq, keyword, vendor_code, gl_code, journal_type) of any number: each
    keyword is filed under that of its three-letter stretches that the fewest
    keywords have, each distinct seller name asks for its own stretches, and what
    meets is compared in whole. Shorter keywords are filed under themselves; an
    empty one is in every name.
    """
    names = invoices.select(F.col(name).alias("_n")).distinct().withColumn("_u", F.upper("_n"))
    v = vendors.select("seq", F.upper("keyword").alias("_kw"), F.struct("vendor_code", F.col("gl_code").cast("string").alias("gl_code"), "journal_type").alias("_v")).where("_kw IS NOT NULL")
    stretches = v.where(F.length("_kw") >= _GRAM).select("_kw").distinct().select("_kw", F.explode(_grams(F.col("_kw"))).alias("_g"))
    often = stretches.groupBy("_g").agg(F.count(F.lit(1)).alias("_often"))
    rarest = stretches.join(often, "_g").groupBy("_kw").agg(F.min_by("_g", F.struct("_often", "_g")).alias("_g"))
    short = v.where(F.length("_kw").between(1, _GRAM - 1)).select("_kw").distinct().withColumn("_g", F.col("_kw"))
    first = v.groupBy("_kw").agg(F.min("seq").alias("_seq"), F.min_by("_v", "seq").alias("_v"))
    # An empty keyword is in every name; names ask for it in shares, so they don't meet in one place.
    share = lambda c: F.concat(F.lit("\0"), c.cast("string"))
    everywhere = first.where("_kw = ''").withColumn("_g", F.explode(F.transform(F.sequence(F.lit(0), F.lit(_SHARES - 1)), share)))
    filed = rarest.unionByName(short).join(first, "_kw").unionByName(everywhere)
    asks = F.concat(F.array(share(F.pmod(F.hash("_n"), F.lit(_SHARES)))), *(_grams(F.col("_u"), n) for n in range(1, _GRAM + 1)))
    asked = names.where("_n IS NOT NULL").select("_n", "_u", F.explode(asks).alias("_g"))
    found = asked.join(filed, "_g").where(F.col("_u").contains(F.col("_kw")))
    best = found.groupBy("_n").agg(F.min_by("_v", "_seq").alias("_v"))
    return invoices.join(best, F.col(name) == F.col("_n"), "left").drop("_n")


def with_vendor(invoices: DataFrame, vendors: DataFrame | None, gstin: str = "seller_gstin", name: str = "seller") -> DataFrame:
    """invoices with vendor_code, gl_code, journal_type: matched, else a code from the identifier or the name."""
    if vendors is not None:
        invoices = vendor_match(invoices, vendors, name)
    else:
        invoices = invoices.withColumn("_v", F.lit(None).cast("struct<vendor_code: string, gl_code: string, journal_type: string>"))
    code = hashed_code(F.when(F.coalesce(gstin, F.lit("")) != "", F.col(gstin)).otherwise(F.coalesce(name, F.lit(""))))
    hit = F.col("_v").isNotNull()
    return invoices.withColumns(
        {
            "vendor_code": F.when(hit, F.coalesce("_v.vendor_code", F.lit(K.JOURNAL["vendor"]))).otherwise(code),
            "gl_code": F.coalesce("_v.gl_code", F.lit(K.JOURNAL["gl"])),
            "journal_type": F.coalesce("_v.journal_type", F.lit(K.JOURNAL["type"])),
        }
    ).drop("_v")


def line_description(date: Column, first_item: Column) -> Column:
    """MON.YY/FIRST/ITEM/WORDS, the words cut to twenty characters."""
    month = F.coalesce(F.upper(F.date_format(date, "MMM.yy")), F.lit("APR.26"))
    words = F.array_join(F.filter(F.split(F.regexp_replace(F.upper(first_item), r"[^\p{L}\p{N} /]", ""), " +"), lambda w: w != ""), "/")
    return F.concat(month, F.lit("/"), F.coalesce(F.left(words, F.lit(20)), F.lit("EXPENSES")))


def _leg(leg: str, seq, account: Column, description: Column, side: str, value: Column, rate: Column | None = None, taxable: Column | None = None) -> Column:
    return F.struct(
        F.lit(leg).alias("leg"), F.lit(seq).alias("seq"), account.cast("string").alias("account"), description.cast("string").alias("description"), F.lit(side).alias("dr_cr"),
        value.cast(MONEY).alias("amount"), (F.lit(None) if rate is None else rate).cast("decimal(9,4)").alias("rate"), (F.lit(None) if taxable is None else taxable).cast(MONEY).alias("taxable"),
    ).cast(LEG)


def debit_legs(base: Column, rate: Column, inter_state: Column, gl: Column) -> Column:
    """The debit rows of a slab."""
    j = K.JOURNAL
    fixed = lambda x: F.lit(j[x])
    half = percent(base, rate, "0.005")
    tax = lambda name, seq, value, r: _leg(name, seq, fixed(name), F.lit(f"GST input cr exps-{name.upper()}"), "D", value, r, base)
    return F.concat(
        F.array(_leg("expense", 0, gl, fixed("expense"), "D", base)),
        F.when((rate > 0) & inter_state, F.array(tax("igst", 1, percent(base, rate), rate)))
        .when(rate > 0, F.array(tax("sgst", 1, half, rate / 2), tax("cgst", 2, half, rate / 2)))
        .otherwise(F.array().cast(f"array<{LEG}>")),
    )


def tax_of(base: Column, rate: Column, inter_state: Column) -> Column:
    """A slab's whole tax, as its debit rows have it."""
    half = percent(base, rate, "0.005")
    return F.when(rate <= 0, F.lit(0).cast(MONEY)).when(inter_state, percent(base, rate)).otherwise((half + half).cast(MONEY))


def journal(invoices: DataFrame, items: DataFrame, vendors: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """Journal rows of invoices(key, doc_seq, number, invoice_date, seller, seller_gstin, buyer_gstin, inter_state, source_file, reverse_charge, subtotal).

    Rows are ordered by doc_seq and leg_seq, debits before credits.
    """
    heads = with_vendor(invoices, vendors)
    s = slabs(items, key)
    # An invoice's slabs come together once; how many they are is bounded by its rates and codes.
    per = s.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("first_pos", "gst_rate", "hsn", "base", "description"))).alias("slabs"))
    d = heads.join(per, key, "left").withColumn("slabs", F.coalesce("slabs", F.array().cast(per.schema["slabs"].dataType)))
    d = computed(d, {"slabs": F.transform("slabs", lambda x: x.withField("base", slab_base(F.size("slabs"), x.base, F.col("subtotal").cast(MONEY))))})
    first = F.get("slabs", 0).description
    date = F.col("invoice_date")
    total = lambda f: F.aggregate(F.transform("slabs", f), F.lit(0).cast("decimal(28,2)"), lambda a, x: (a + x).cast("decimal(28,2)"))
    base = total(lambda x: x.base)
    tax = total(lambda x: tax_of(x.base, x.gst_rate, F.col("inter_state")))
    debits = F.flatten(
        F.transform(
            "slabs",
            lambda x, i: F.transform(
                debit_legs(x.base, x.gst_rate, F.col("inter_state"), F.col("gl_code")), lambda g: F.struct((i * 10 + g.seq).alias("leg_seq"), g.alias("g"), F.when(g.leg != "expense", x.hsn).alias("hsn"))
            ),
        )
    )
    credit = lambda leg, n, v: F.struct((F.size("slabs") * 10 + n).alias("leg_seq"), _leg(leg, n, F.col("vendor_code"), F.col("seller"), "C", v).alias("g"), F.lit(None).cast("string").alias("hsn"))
    credits = F.concat(F.array(credit("base_credit", 0, base)), F.when(tax > 0, F.array(credit("tax_credit", 1, tax))).otherwise(F.array().cast(f"array<struct<leg_seq: int, g: {LEG}, hsn: string>>")))
    # Not behind the generator, so that who doesn't ask for them doesn't pay for them.
    d = computed(d.withColumns({"period": fiscal_period(date), "line_text": line_description(date, first)}), {"_legs": F.concat(debits, credits)})
    d = d.withColumn("_l", F.explode("_legs")).select("*", "_l.leg_seq", "_l.hsn", "_l.g.*").drop("_legs", "_l", "slabs", "seq")
    return d.withColumn("l_id", F.when((F.col("leg_seq") == 0) & (F.col("leg") == "expense"), K.JOURNAL["first"]).otherwise(K.JOURNAL["other"]))


def upload_format(rows: DataFrame) -> DataFrame:
    """Journal rows under unique names c01 to c56, as the upload has them; display names are in constants."""
    debit, j = F.col("dr_cr") == "D", K.JOURNAL
    expense = F.col("leg") == "expense"
    none, tag = F.lit(j["none"]), F.lit
    stem = F.left(F.get(F.split("source_file", r"\."), 0), F.lit(20))
    filled = {
        1: F.col("l_id"), 2: F.col("period"), 3: F.col("invoice_date"), 4: F.col("account"), 5: F.col("description"), 6: tag("INR"), 7: F.col("amount"),
        8: F.col("dr_cr"), 9: F.when(debit, F.col("journal_type")).otherwise(j["type"]),
        11: F.when(debit, F.concat("vendor_code", tag("/"), F.upper("seller"))).otherwise(stem), 12: F.col("line_text"),
        17: F.when(debit, j["branch"]).when(F.col("leg") == "base_credit", j["base_credit"]).otherwise(j["tax_credit"]), 18: none, 19: tag(j["channel"]),
        20: none, 21: none, 22: none, 23: F.when(expense, j["tds"]).otherwise(j["none"]), 24: tag(j["department"]), 26: F.col("vendor_code"),
        27: F.col("invoice_date"), 32: F.col("seller_gstin"), 33: F.col("number"), 37: F.col("hsn"), 38: F.col("taxable"),
        39: F.when(expense, F.col("reverse_charge")), 40: F.when(expense, F.col("reverse_charge")), 43: F.col("rate"), 44: F.col("buyer_gstin"),
        45: F.when(debit & ~expense, j["gl"]),
    }
    names = range(1, len(K.JOURNAL_COLUMNS) + 1)
    return rows.select("doc_seq", "leg_seq", *(filled.get(n, F.lit(None).cast("string")).alias(f"c{n:02d}") for n in names))


def guide(spark) -> DataFrame:
    """What stands in which journal column."""
    return spark.createDataFrame([(i, *row) for i, row in enumerate(K.JOURNAL_GUIDE)], "seq int, head string, details string")
