"""Rules on invoices: formats, dates, arithmetic, completeness, and the status they add up to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.dates import to_date
from ..functions.ids import is_gstin
from ..functions.layers import computed, let
from ..plans import constants as K

ISSUE = "struct<field_name: string, issue: string, severity: string, expected: string, actual: string>"
STATUSES = ("PASS", "WARNING", "FAIL")


def issue(field: str | Column, text: str | Column, severity: str, expected: Column | None = None, actual: Column | None = None) -> Column:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    none = F.lit(None)
    return F.struct(lit(field).alias("field_name"), lit(text).alias("issue"), F.lit(severity).alias("severity"), (none if expected is None else expected).cast("string").alias("expected"), (none if actual is None else actual).cast("string").alias("actual")).cast(ISSUE)


def found(*issues: Column) -> Column:
    """Those that are not null, in order."""
    return F.filter(F.array(*issues), lambda x: x.isNotNull())


def missing(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) == ""


# fixed values: names of checked fields and texts of issues, as reports quote them


def gstin_issue(c: Column, name: str) -> Column:
    code = F.upper(F.trim(c))
    bad = issue(name, F.concat(F.lit("Invalid GSTIN format: '"), code, F.lit("' (expected 15-char pattern)")), "WARNING", F.lit("NN AAAAA NNNN A N Z X"), code)
    return F.when(missing(c), issue(name, "GSTIN not found", "WARNING")).when(~is_gstin(c), bad)


def date_issue(c: Column, name: str, as_of: Column) -> Column:
    """as_of is given, not read from a clock, so reruns agree."""
    say = lambda what: issue(name, F.concat(F.lit(what), c), "WARNING", None, c)

    def of(d: Column) -> Column:
        return (
            F.when(missing(c), issue(name, "Date not found", "WARNING"))
            .when(d.isNull(), issue(name, F.concat(F.lit("Cannot parse date: '"), c, F.lit("'")), "WARNING", None, c))
            .when(d > F.date_add(as_of, 1), say("Date is in the future: "))
            .when(d < F.date_sub(as_of, 365 * 5), say("Date is more than 5 years old: "))
        )

    # The date is read once, not for each of its tests.
    return let(to_date(c), of)


def off(a: Column, b: Column, tolerance: float = K.TOLERANCE) -> Column:
    return F.abs(a - b) > F.lit(tolerance)


def line_math(quantity: Column, price: Column, value: Column) -> Column:
    """Whether quantity times price misses the amount, all three being known."""
    return (quantity > 0) & (price > 0) & (value > 0) & off(quantity * price, value)


def shown(x: Column) -> Column:
    """A number as it is, without an exponent."""
    return F.when(F.abs(x) < 1e7, x.cast("string")).otherwise(F.regexp_replace(x.cast("decimal(30,4)").cast("string"), r"(\.\d+?)0+$", "$1"))


def _cents(x: Column) -> Column:
    return F.format_string("%.2f", x)


def line_issues(items: Column) -> Column:
    def one(x, i):
        product = x.quantity * x.unit_price
        text = F.concat(F.lit("qty("), shown(x.quantity), F.lit(") × rate("), shown(x.unit_price), F.lit(") = "), _cents(product), F.lit(" ≠ amount("), shown(x.taxable_amount), F.lit(")"))
        return F.when(line_math(x.quantity, x.unit_price, x.taxable_amount), issue(F.concat(F.lit("Line Item "), (i + 1).cast("string")), text, "WARNING", _cents(product), _cents(x.taxable_amount)))

    return F.filter(F.transform(items, one), lambda x: x.isNotNull())


def subtotal_issue(items: Column, subtotal: Column) -> Column:
    s = F.aggregate(items, F.lit(0.0), lambda a, x: a + x.taxable_amount)
    text = F.concat(F.lit("Sum of items ("), _cents(s), F.lit(") ≠ subtotal ("), _cents(subtotal), F.lit(")"))
    return F.when((F.size(items) > 0) & (subtotal > 0) & off(s, subtotal), issue("Subtotal", text, "WARNING", _cents(s), _cents(subtotal)))


def total_issue(total: Column, tax: Column, round_off: Column, subtotal: Column) -> Column:
    text = F.concat(F.lit("subtotal("), _cents(subtotal), F.lit(") + tax("), _cents(tax), F.lit(") = "), _cents(subtotal + tax), F.lit(" ≠ grand_total("), _cents(total), F.lit(")"))
    return F.when((total > 0) & (tax > 0) & (subtotal > 0) & off(total - tax - round_off, subtotal), issue("Grand Total", text, "WARNING", _cents(subtotal + tax), _cents(total)))


def completeness(number: Column, date: Column, total: Column, seller: Column, n_items: Column) -> Column:
    required = {"Invoice Number": number, "Invoice Date": date, "Grand Total": total, "Seller Name": seller}
    fails = [F.when(missing(c), issue(n, f"Required field '{n}' is missing", "FAIL")) for n, c in required.items()]
    return found(*fails, F.when(n_items == 0, issue("Line Items", "No line items extracted", "WARNING")))


def severity(status: Column) -> Column:
    return F.when(status == "FAIL", 2).when(status == "WARNING", 1).otherwise(0)


def status_of(level: Column) -> Column:
    return F.when(level >= 2, "FAIL").when(level == 1, "WARNING").otherwise("PASS")


def worst(issues: Column) -> Column:
    return status_of(F.coalesce(F.array_max(F.transform(issues, lambda x: severity(x.severity))), F.lit(0)))


def validated(invoices: DataFrame, as_of: Column, strict_compat: bool = False) -> DataFrame:
    """invoices with validation: status, issues in order of the rules, math_check, gst_valid, complete.

    strict_compat takes identifiers for valid as long as no issue with them is
    a failure, and none ever is.
    """
    c = F.col
    math = F.concat(line_issues(c("line_items")), found(subtotal_issue(c("line_items"), c("subtotal")), total_issue(c("grand_total_value"), c("total_tax"), c("round_off"), c("subtotal"))))
    gaps = completeness(c("invoice_number.value"), c("invoice_date.value"), c("grand_total.value"), c("seller.name"), F.size("line_items"))
    codes = found(gstin_issue(c("seller.gstin"), "Seller GSTIN"), gstin_issue(c("buyer.gstin"), "Buyer GSTIN"))
    out = computed(invoices, {"_codes": codes, "_date": found(date_issue(c("invoice_date.value"), "Invoice Date", as_of)), "_math": math, "_gaps": gaps}).withColumn("_all", F.concat("_codes", "_date", "_math", "_gaps"))
    fails = lambda a: F.exists(a, lambda x: x.severity == "FAIL")
    valid = ~fails("_codes") if strict_compat else F.size("_codes") == 0
    v = F.struct(worst(c("_all")).alias("status"), c("_all").alias("issues"), (F.size("_math") == 0).alias("math_check"), valid.alias("gst_valid"), (~fails("_gaps")).alias("complete"))
    return out.withColumn("validation", v).drop("_codes", "_date", "_math", "_gaps", "_all")


def duplicates(invoices: DataFrame, number: str = "number", seq: str = "doc_seq", file: str = "source_file") -> DataFrame:
    """invoices with duplicate_of: the file of the last earlier document with the same number. Blank numbers, which could be most of the rows, are not compared and not shuffled into one task."""
    known = F.coalesce(number, F.lit("")) != ""
    salted = F.when(known, F.col(number)).otherwise(F.concat(F.lit("\x00"), F.col(seq).cast("string")))
    earlier = F.lag(file).over(W.partitionBy("_number").orderBy(seq))
    return invoices.withColumn("_number", salted).withColumn("duplicate_of", earlier).drop("_number")


def duplicate_errors(invoices: DataFrame) -> DataFrame:
    """invoices with a processing error where an earlier document has the same number."""
    marked = duplicates(invoices.withColumn("_own_number", F.col("invoice_number.value")), "_own_number")
    said = F.concat(F.lit("DUPLICATE: Same invoice # found in "), F.col("duplicate_of"))
    errors = F.when(F.col("duplicate_of").isNotNull(), F.concat("processing_errors", F.array(said))).otherwise(F.col("processing_errors"))
    return marked.withColumn("processing_errors", errors).drop("_own_number", "duplicate_of")


def against_expected(invoices: DataFrame, expected: DataFrame) -> DataFrame:
    """(source_file, number_right, total_right, items_right, right) of invoices(source_file, number, total, n_items) that have a row in expected(same columns).

    Texts are compared as printed. Equality joins let sizes decide the strategy.
    """
    e = expected.select("source_file", *(F.col(c).alias(f"_{c}") for c in ("number", "total", "n_items")))
    same = {c: F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ("number", "total", "n_items")}
    out = invoices.join(e, "source_file").select("source_file", same["number"].alias("number_right"), same["total"].alias("total_right"), same["n_items"].alias("items_right"))
    return out.withColumn("right", F.col("number_right") & F.col("total_right") & F.col("items_right"))
