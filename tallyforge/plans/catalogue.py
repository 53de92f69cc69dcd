"""Queries by name, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, ids, money, text
from ..operators import fields, invoice, journal, layout, lines, pages, tables, taxes, validate, vision
from . import constants as K
from . import star
from .star import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_S = star.SQL


@query(_S + "SELECT doc_id, pos, quantity, base, gst_rate, hsn, description FROM i")
def q_items(spark, d):
    return star.items(spark, d).select("doc_id", "pos", "quantity", "base", "gst_rate", "hsn", "description")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice::DECIMAL(18,2)::DOUBLE AS amount FROM lineitem")
def q_amount_parse(spark, d):
    rows = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_extendedprice").cast(money.MONEY).cast("string").alias("v"))
    lakhs = F.regexp_replace("v", r"(\d)(?=(\d\d)+\d\.)", "$1,")
    k = F.pmod("l_orderkey", F.lit(4))
    shown = F.when(k == 0, F.concat(F.lit("₹ "), lakhs)).when(k == 1, F.concat(F.lit("Rs. "), lakhs, F.lit("/-"))).when(k == 2, F.concat(F.lit("INR "), F.regexp_replace(lakhs, r"\.(\d\d)$", ",$1"))).otherwise(F.concat(lakhs, F.lit(")")))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", money.amount(shown).alias("amount"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%d/%m/%Y') AS normal_date FROM orders")
def q_date_norm(spark, d):
    o = read(spark, d, "orders")
    formats = ["dd/MM/yyyy", "d-MMM-yyyy", "MMMM d, yyyy", "yyyy-MM-dd", "d.M.yyyy"]
    shown = F.date_format("o_orderdate", formats[0])
    for i, f in enumerate(formats):
        shown = F.when(F.pmod("o_orderkey", F.lit(len(formats))) == i, F.date_format("o_orderdate", f)).otherwise(shown)
    return o.select("o_orderkey", dates.normal_date(F.concat(shown, F.lit(" "))).alias("normal_date"))


@query("SELECT o_orderkey, concat(year(o_orderdate) - CASE WHEN month(o_orderdate) < 4 THEN 1 ELSE 0 END, '/', lpad(((month(o_orderdate) + 8) % 12 + 1)::VARCHAR, 3, '0')) AS period FROM orders")
def q_fiscal_period(spark, d):
    return read(spark, d, "orders").select("o_orderkey", dates.fiscal_period(F.col("o_orderdate")).alias("period"))


@query("SELECT c_custkey, concat(c_nationkey + 10, 'AABOI', lpad((c_custkey % 10000)::VARCHAR, 4, '0'), 'S1Z', c_custkey % 10) AS gstin FROM customer")
def q_gstin_normalize(spark, d):
    c = read(spark, d, "customer")
    clean = star.gstin(F.col("c_nationkey"), "AABOI", F.col("c_custkey"))
    clean = F.concat(F.left(clean, F.lit(11)), F.lit("S1Z"), F.right(clean, F.lit(1)))
    misread = F.concat(
        F.translate(F.substring(clean, 1, 2), "01", "OI"), F.translate(F.substring(clean, 3, 5), "OI", "01"), F.translate(F.substring(clean, 8, 4), "015", "oLS"), F.lit("5I"),
        F.element_at(F.array(*map(F.lit, "Z2s0")), (F.pmod("c_custkey", F.lit(4)) + 1).cast("int")), F.substring(clean, 15, 1),
    )
    return c.select("c_custkey", ids.normal_gstin(misread).alias("gstin"))


@query("SELECT s_suppkey, s_suppkey % 3 <> 0 AS valid FROM supplier")
def q_gstin_valid(spark, d):
    s = read(spark, d, "supplier")
    code = star.gstin(F.col("s_nationkey"), "AABCS", F.col("s_suppkey"))
    return s.select("s_suppkey", ids.is_gstin(F.when(F.pmod("s_suppkey", F.lit(3)) == 0, F.translate(code, "K", "9")).otherwise(F.lower(code))).alias("valid"))


_MOD = "CASE WHEN {0} IS NULL THEN NULL ELSE (((('0x' || substr(md5({0}), 1, 8))::HUGEINT * 4294967296 + ('0x' || substr(md5({0}), 9, 8))::HUGEINT) % 10000000 * 4294967296 + ('0x' || substr(md5({0}), 17, 8))::HUGEINT) % 10000000 * 4294967296 + ('0x' || substr(md5({0}), 25, 8))::HUGEINT) % 10000000 END"


def _code(c: str) -> str:
    return f"concat('CMS', lpad(({_MOD.format(c)})::VARCHAR, 7, '0'))"


@query(f"SELECT s_suppkey, {_code('s_name')} AS vendor_code FROM supplier")
def q_vendor_code(spark, d):
    return read(spark, d, "supplier").select("s_suppkey", ids.hashed_code(F.col("s_name")).alias("vendor_code"))


@query(r"SELECT doc_id, array_to_string(regexp_extract_all(text, '[\w.+-]+@[\w-]+\.[\w.]+'), ' ') AS emails FROM documents")
def q_email_extract(spark, d):
    return read(spark, d, "documents").select("doc_id", F.array_join(fields.emails(F.col("text")), " ").alias("emails"))


@query("SELECT o_orderkey, o_totalprice::DECIMAL(18,2)::DOUBLE AS total, round(o_totalprice::DECIMAL(18,2) * 0.5, 2)::DOUBLE AS subtotal FROM orders")
def q_field_coalesce(spark, d):
    o = read(spark, d, "orders").withColumn("v", F.col("o_totalprice").cast(money.MONEY))
    labels = ["Grand Total: ₹ ", "Total Amount Rs. ", "Balance Due: INR ", "Net payable amount = ", "Total "]
    label = F.element_at(F.array(*map(F.lit, labels)), (F.pmod("o_orderkey", F.lit(len(labels))) + 1).cast("int"))
    t = F.concat(F.lit("Sub Total "), F.round(F.col("v") * F.lit(0.5).cast("decimal(2,1)"), 2).cast(money.MONEY), F.lit("\n"), label, F.col("v"))
    return o.select("o_orderkey", money.amount(fields.total_text(t)).alias("total"), fields.subtotal(t).alias("subtotal"))


@query(_S + "SELECT doc_id, pos, hsn, 'nos' AS unit, 4 AS n_numbers FROM i")
def q_line_tokens(spark, d):
    rows = star.items(spark, d).withColumn("line", F.concat_ws(" ", F.lit("|"), F.col("pos"), "description", F.concat("hsn", F.lit(",")), F.col("quantity"), F.lit("Nos."), F.lit("7:50"), F.col("base")))
    return lines.line_tokens(rows.drop("hsn")).select("doc_id", "pos", "hsn", "unit", F.size("numbers").alias("n_numbers"))


@query(_S + "SELECT doc_id, count(*) AS n_lines FROM i GROUP BY doc_id")
def q_section_state(spark, d):
    # By the keys that invoices are dealt by: their lines are many times their size and would travel.
    key = ["l_orderkey", "l_suppkey"]
    state = lines.section_state(lines.text_lines(star.printed(spark, d, *key), [*key, "doc_id"]), key)
    return state.where("event IS NULL AND in_section AND NOT done AND line NOT LIKE '%GST%'").groupBy(*key, "doc_id").agg(F.count(F.lit(1)).alias("n_lines")).drop(*key)


@query(_S + "SELECT doc_id, pos AS sr_no, description, hsn AS hsn_sac, quantity::DOUBLE AS quantity, base::DOUBLE AS taxable_amount FROM i")
def q_text_items(spark, d):
    found = lines.text_items(star.printed(spark, d).select("doc_id", "text"))
    return found.select("doc_id", "item.sr_no", "item.description", "item.hsn_sac", "item.quantity", "item.taxable_amount")


def _table(rows: DataFrame) -> DataFrame:
    cells = F.array(F.concat(F.col("pos").cast("string"), F.lit(".")), "description", "hsn", F.col("quantity").cast("string"), F.format_number(F.round(F.col("base") / F.col("quantity"), 2), 2), F.format_number("base", 2))
    header = F.array(F.array(*map(F.lit, ["Sl No", "Description", "HSN/SAC", "Qty", "Rate", "Amount"])))
    total = F.array(F.array(F.lit("Total"), F.lit(""), F.lit(""), F.lit(""), F.lit(""), F.format_number(F.col("total"), 2)))
    rows = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", cells.alias("cells")))).alias("r"), F.sum("base").alias("total"))
    return rows.select("doc_id", F.concat(header, F.transform("r", lambda x: x.cells), total).alias("table"))


@query(_S + "SELECT doc_id, pos AS sr_no, description, hsn AS hsn_sac, quantity::DOUBLE AS quantity, base::DOUBLE AS taxable_amount FROM i")
def q_table_items(spark, d):
    t = _table(star.items(spark, d)).select("doc_id", F.explode(tables.useful(tables.table_items(F.col("table")))).alias("item"))
    return t.select("doc_id", "item.sr_no", "item.description", "item.hsn_sac", "item.quantity", "item.taxable_amount")


@query(
    "SELECT * FROM (SELECT n_nationkey % 3 AS v, n_nationkey FROM nation) JOIN (VALUES (0, 'sr_no', 0), (0, 'description', 1), (0, 'hsn_sac', 2), (0, 'quantity', 3), (0, 'rate', 4), (0, 'amount', 5), "
    "(1, 'quantity', 0), (2, 'gst_rate', 0), (2, 'rate', 1), (2, 'amount', 2)) x(v2, field, column_no) ON v = v2"
)
def q_column_map(spark, d):
    headers = [["Sl No", "Description", "HSN/SAC", "Qty", "Rate", "Amount"], ["Qty", "Unit Price"], ["CGST", "Tax Rate", "Net Value", "Amount"]]
    v = F.pmod("n_nationkey", F.lit(3)).cast("int").alias("v")
    out = read(spark, d, "nation").select(v, "n_nationkey")
    header = F.element_at(F.array(*(F.array(*map(F.lit, h)) for h in headers)), F.col("v") + 1)
    return out.select("v", "n_nationkey", F.col("v").alias("v2"), F.explode(tables.column_map(header)).alias("field", "column_no"))


@query("SELECT l_orderkey, round(sum(CASE WHEN l_returnflag = 'N' THEN 1 ELSE 2 END) / (2.0 * count(*)), 6) AS fill FROM lineitem GROUP BY l_orderkey")
def q_fill_ratio(spark, d):
    cells = F.array(F.lit("x"), F.when(F.col("l_returnflag") == "N", " ").otherwise("y"))
    t = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(cells).alias("table"))
    return t.select("l_orderkey", F.round(tables.fill_ratio(F.col("table")), 6).alias("fill"))


@query(
    "SELECT user_id, column_no, min(value) AS bound FROM (SELECT user_id, value, (sum(n) OVER (PARTITION BY user_id ORDER BY value ROWS UNBOUNDED PRECEDING))::INT AS column_no FROM "
    "(SELECT user_id, value, CASE WHEN value - lag(value) OVER (PARTITION BY user_id ORDER BY value) > 15 THEN 1 ELSE 0 END AS n FROM events)) GROUP BY ALL"
)
def q_cluster_columns(spark, d):
    return layout.column_bounds(read(spark, d, "events").select("user_id", F.col("value").alias("x0")), ["user_id"])


@query(
    "WITH RECURSIVE e AS (SELECT user_id, value, event_id, row_number() OVER (PARTITION BY user_id ORDER BY value, event_id) AS n FROM events), "
    "r AS (SELECT user_id, value, event_id, n, value AS anchor, 0 AS row_no FROM e WHERE n = 1 UNION ALL "
    "SELECT e.user_id, e.value, e.event_id, e.n, CASE WHEN abs(e.value - anchor) > 5 THEN e.value ELSE anchor END, row_no + CASE WHEN abs(e.value - anchor) > 5 THEN 1 ELSE 0 END FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1) "
    "SELECT user_id, event_id, row_no FROM r"
)
def q_cluster_rows(spark, d):
    words = read(spark, d, "events").select("user_id", F.col("value").alias("y0"), F.col("event_id").cast("double").alias("x0"), F.lit("w").alias("text"))
    return layout.cluster_rows(words, ["user_id"]).select("user_id", F.col("x0").cast("long").alias("event_id"), "row_no")


@query("SELECT event_id, greatest(len(list_filter([10, 40, 90, 160], lambda b: b <= value + 15)) - 1, 0)::INT AS column_no FROM events")
def q_assign_column(spark, d):
    bounds = F.array(*map(F.lit, (10.0, 40.0, 90.0, 160.0)))
    return read(spark, d, "events").select("event_id", layout.assign_column(F.col("value"), bounds).alias("column_no"))


@query(
    "SELECT l_orderkey, l_returnflag AS tax_type, max(l_extendedprice) AS tax_amount, arg_max(l_tax, (l_extendedprice, -l_linenumber, -l_partkey)) AS rate FROM lineitem GROUP BY ALL"
)
def q_tax_dedup(spark, d):
    rows = read(spark, d, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("tax_type"), F.col("l_extendedprice").alias("tax_amount"), F.col("l_tax").alias("rate"), (F.col("l_linenumber") * 10_000_000 + F.col("l_partkey")).alias("pos"))
    return taxes.dedup_taxes(rows, ["l_orderkey"]).select("l_orderkey", "tax_type", "tax_amount", "rate")


@query(_S + "SELECT doc_id, CASE WHEN inter_state THEN 'IGST' ELSE 'CGST' END AS tax_type, rate::DOUBLE AS rate, tax::DOUBLE AS tax_amount FROM t JOIN h USING (doc_id)")
def q_tax_rows(spark, d):
    t = star.printed(spark, d).select("doc_id", F.explode(taxes.tax_details(F.col("text"))).alias("x"))
    return t.select("doc_id", "x.tax_type", "x.rate", "x.tax_amount")


@query(_S + "SELECT doc_id, gst_rate, hsn, base, first_pos, description FROM s0")
def q_slabs(spark, d):
    return journal.slabs(star.items(spark, d))


@query(_S + "SELECT doc_id, gst_rate, hsn, igst, half AS cgst, half AS sgst FROM s")
def q_tax_split(spark, d):
    s = journal.slabs(star.items(spark, d)).join(star.heads(spark, d).select("doc_id", "inter_state"), "doc_id")
    away, none = F.col("inter_state"), F.lit(0).cast(money.MONEY)
    half = F.when(away, none).otherwise(money.percent(F.col("base"), F.col("gst_rate"), "0.005"))
    return s.select("doc_id", "gst_rate", "hsn", F.when(away, money.percent(F.col("base"), F.col("gst_rate"))).otherwise(none).alias("igst"), half.alias("cgst"), half.alias("sgst"))


@query(
    _S + ", it AS (SELECT doc_id, pos AS item_id, CASE pos % 3 WHEN 0 THEN hsn WHEN 1 THEN '1' || hsn ELSE hsn || '00' END AS hsn FROM i), r AS (SELECT doc_id, hsn, gst_rate AS rate, first_pos AS pos FROM s0 WHERE first_pos <= 2), "
    "m AS (SELECT it.*, r.hsn AS matched_hsn, r.rate AS matched_rate, row_number() OVER (PARTITION BY it.doc_id, item_id ORDER BY CASE WHEN it.hsn = r.hsn THEN 0 WHEN ends_with(it.hsn, r.hsn) THEN 1 ELSE 2 END, r.pos) AS n "
    "FROM it LEFT JOIN r ON it.doc_id = r.doc_id AND (it.hsn = r.hsn OR ends_with(it.hsn, r.hsn) OR starts_with(it.hsn, r.hsn))) SELECT doc_id, item_id, hsn, matched_hsn, matched_rate::DOUBLE AS matched_rate FROM m WHERE n = 1"
)
def q_hsn_rate(spark, d):
    i = star.items(spark, d)
    k = F.pmod("pos", F.lit(3))
    code = F.when(k == 0, F.col("hsn")).when(k == 1, F.concat(F.lit("1"), "hsn")).otherwise(F.concat("hsn", F.lit("00")))
    rates = journal.slabs(i).where("first_pos <= 2").select("doc_id", "hsn", F.col("gst_rate").cast("double").alias("rate"), F.col("first_pos").alias("pos"))
    return taxes.join_rates(i.select("doc_id", F.col("pos").alias("item_id"), code.alias("hsn")), rates)


def _vendors(spark, d):
    n = read(spark, d, "nation")
    return n.select(F.col("n_nationkey").alias("seq"), F.concat(F.lit("r#0000000"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias("keyword"), F.concat(F.lit("V"), "n_nationkey").alias("vendor_code"), (F.col("n_nationkey") + 500).cast("long").alias("gl_code"), F.lit("HEXPS").alias("journal_type"))


@query(
    f"WITH v AS (SELECT n_nationkey AS seq, concat('R#0000000', lpad(n_nationkey::VARCHAR, 2, '0')) AS kw, concat('V', n_nationkey) AS vendor_code, (n_nationkey + 500)::VARCHAR AS gl_code FROM nation), "
    f"m AS (SELECT s_suppkey, s_name, v.vendor_code, v.gl_code, row_number() OVER (PARTITION BY s_suppkey ORDER BY seq) AS n FROM supplier LEFT JOIN v ON contains(upper(s_name), kw)) "
    f"SELECT s_suppkey, coalesce(vendor_code, {_code('s_name')}) AS vendor_code, coalesce(gl_code, '{K.JOURNAL['gl']}') AS gl_code, CASE WHEN vendor_code IS NULL THEN '{K.JOURNAL['type']}' ELSE 'HEXPS' END AS journal_type FROM m WHERE n = 1"
)
def q_vendor_match(spark, d):
    s = read(spark, d, "supplier").select("s_suppkey", F.col("s_name").alias("seller"), F.lit("").alias("seller_gstin"))
    return journal.with_vendor(s, _vendors(spark, d)).select("s_suppkey", "vendor_code", "gl_code", "journal_type")


@query("SELECT conv_id AS doc_id, turn AS page_no FROM conversations c WHERE NOT EXISTS (SELECT 1 FROM conversations x WHERE x.conv_id = c.conv_id AND x.turn = c.turn AND x.turn % 2 = 0 AND regexp_matches(x.text, '[^ \\t\\n\\r\\f\\v]'))")
def q_hybrid_pages(spark, d):
    c = read(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_no"), "text")
    return pages.hybrid_pages(c.where("page_no % 2 = 0"), c).select("doc_id", "page_no")


_LEGS = (
    _S + ", f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY first_pos, gst_rate, hsn) - 1 AS n FROM s), c AS (SELECT doc_id, count(*) AS n FROM f GROUP BY doc_id), "
    "legs AS (SELECT doc_id, n * 10 AS leg_seq, 'expense' AS leg, 'D' AS dr_cr, base AS amount FROM f UNION ALL SELECT doc_id, n * 10 + 1, 'igst', 'D', igst FROM f WHERE gst_rate > 0 AND inter_state "
    "UNION ALL SELECT doc_id, n * 10 + 1, 'sgst', 'D', half FROM f WHERE gst_rate > 0 AND NOT inter_state UNION ALL SELECT doc_id, n * 10 + 2, 'cgst', 'D', half FROM f WHERE gst_rate > 0 AND NOT inter_state "
    "UNION ALL SELECT doc_id, c.n * 10, 'base_credit', 'C', base FROM t JOIN c USING (doc_id) UNION ALL SELECT doc_id, c.n * 10 + 1, 'tax_credit', 'C', tax FROM t JOIN c USING (doc_id) WHERE tax > 0) "
)


@query(
    _LEGS + f"SELECT doc_id, doc_seq, leg_seq::INT AS leg_seq, leg, dr_cr, amount, CASE WHEN leg_seq = 0 AND leg = 'expense' THEN '1;3;6;7' ELSE '6;7' END AS l_id, {_code('seller_gstin')} AS vendor_code, "
    "concat(year(invoice_date) - CASE WHEN month(invoice_date) < 4 THEN 1 ELSE 0 END, '/', lpad(((month(invoice_date) + 8) % 12 + 1)::VARCHAR, 3, '0')) AS period FROM legs JOIN h USING (doc_id)"
)
def q_journal(spark, d):
    rows = journal.journal(star.heads(spark, d), star.items(spark, d))
    return rows.select("doc_id", "doc_seq", "leg_seq", "leg", "dr_cr", "amount", "l_id", "vendor_code", "period")


@query(_LEGS + "SELECT doc_id, sum(CASE WHEN dr_cr = 'D' THEN amount END)::DECIMAL(28,2) AS debit, sum(CASE WHEN dr_cr = 'C' THEN amount END)::DECIMAL(28,2) AS credit, 0::DECIMAL(28,2) AS difference FROM legs GROUP BY doc_id")
def q_journal_balance(spark, d):
    rows = journal.journal(star.heads(spark, d), star.items(spark, d))
    side = lambda s: F.sum(F.when(F.col("dr_cr") == s, F.col("amount"))).cast("decimal(28,2)")
    out = rows.groupBy("doc_id").agg(side("D").alias("debit"), side("C").alias("credit"))
    return out.withColumn("difference", (F.col("debit") - F.col("credit")).cast("decimal(28,2)"))


@query(
    _LEGS + ", x AS (SELECT legs.*, f.hsn, f.base AS b, f.gst_rate FROM legs LEFT JOIN f ON legs.doc_id = f.doc_id AND f.n = legs.leg_seq // 10 AND dr_cr = 'D') "
    f"SELECT doc_seq, leg_seq::INT AS leg_seq, CASE dr_cr WHEN 'C' THEN {_code('seller_gstin')} ELSE CASE leg WHEN 'expense' THEN '{K.JOURNAL['gl']}' WHEN 'igst' THEN '{K.JOURNAL['igst']}' WHEN 'sgst' THEN '{K.JOURNAL['sgst']}' ELSE '{K.JOURNAL['cgst']}' END END AS c04, "
    "amount AS c07, dr_cr AS c08, CASE WHEN leg IN ('igst', 'sgst', 'cgst') THEN hsn END AS c37, CASE WHEN leg IN ('igst', 'sgst', 'cgst') THEN b END AS c38, "
    "CASE WHEN leg = 'igst' THEN gst_rate WHEN leg IN ('sgst', 'cgst') THEN gst_rate * 0.5 END::DECIMAL(9,4) AS c43, seller_gstin AS c32, buyer_gstin AS c44 FROM x JOIN h USING (doc_id)"
)
def q_upload_format(spark, d):
    rows = journal.upload_format(journal.journal(star.heads(spark, d), star.items(spark, d)))
    return rows.select("doc_seq", "leg_seq", "c04", "c07", "c08", "c32", "c37", "c38", "c43", "c44")


@query(
    _S + r"SELECT doc_id, concat(upper(strftime(invoice_date, '%b.%y')), '/', left(replace(upper(s0.description), ' ', '/'), 20)) AS line_text FROM h JOIN s0 USING (doc_id) "
    "QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY first_pos) = 1"
)
def q_line_description(spark, d):
    first = star.items(spark, d).where("pos = 1").select("doc_id", "description")
    return star.heads(spark, d).join(first, "doc_id").select("doc_id", journal.line_description(F.col("invoice_date"), F.col("description")).alias("line_text"))


@query("SELECT o_orderkey, lag(f) OVER (PARTITION BY n ORDER BY o_orderkey) AS duplicate_of FROM (SELECT o_orderkey, concat('f', o_orderkey) AS f, CASE WHEN o_orderkey % 5 = 0 THEN concat('x', o_orderkey) ELSE o_custkey::VARCHAR END AS n FROM orders)")
def q_duplicates(spark, d):
    o = read(spark, d, "orders").select("o_orderkey", F.col("o_orderkey").alias("doc_seq"), F.concat(F.lit("f"), "o_orderkey").alias("source_file"), F.when(F.pmod("o_orderkey", F.lit(5)) == 0, "").otherwise(F.col("o_custkey").cast("string")).alias("number"))
    return validate.duplicates(o).select("o_orderkey", "duplicate_of")


@query("SELECT l_orderkey, l_linenumber, l_partkey, abs(l_quantity * round(l_extendedprice / l_quantity, 1) - l_extendedprice) > 2.0 AS wrong FROM lineitem")
def q_line_math(spark, d):
    price = F.round(F.col("l_extendedprice") / F.col("l_quantity"), 1)
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", validate.line_math(F.col("l_quantity"), price, F.col("l_extendedprice")).alias("wrong"))


_CHECKED = _S + ", k AS (SELECT h.*, t.base, t.tax, t.base + t.tax AS total, coalesce(t.base + CASE WHEN doc_seq % 7 = 0 THEN 3 ELSE 0 END, 0)::DECIMAL(18,2) AS stated FROM h JOIN t USING (doc_id)) "


def _invoices(spark, d) -> DataFrame:
    """Structured invoices with planted faults: a wrong subtotal in every seventh, no number in every eleventh, a bad identifier in every thirteenth."""
    zero = F.lit(0.0)
    item = lambda x: F.struct(x.pos.alias("sr_no"), x.description.alias("description"), x.hsn.alias("hsn_sac"), x.quantity.cast("double").alias("quantity"), F.lit("pc").alias("unit"), F.round(x.base / x.quantity, 2).cast("double").alias("unit_price"), zero.alias("discount"), x.base.cast("double").alias("taxable_amount"), x.gst_rate.cast("double").alias("gst_rate"), zero.alias("cgst_amount"), zero.alias("sgst_amount"), zero.alias("igst_amount"), x.base.cast("double").alias("total_amount")).cast(lines.ITEM)
    d_ = star.documents(spark, d).drop("subtotal").withColumn("line_items", F.transform("items", item))
    n = lambda k: F.pmod("doc_seq", F.lit(k)) == 0
    total = (F.col("base") + F.col("tax")).cast("double")
    party = lambda name, code: F.struct(F.col(name).alias("name"), code.alias("gstin"))
    return d_.select(
        "doc_id", "doc_seq", "source_file", F.lit("digital").alias("pdf_type"), fields.field(F.when(~n(11), F.col("number")), K.HIGH, "text").alias("invoice_number"), fields.field(F.date_format("invoice_date", "dd/MM/yyyy"), K.HIGH, "text").alias("invoice_date"),
        fields.field((F.col("base") + F.col("tax")).cast(money.MONEY).cast("string"), K.MEDIUM, "inferred").alias("grand_total"), total.alias("grand_total_value"), party("seller", F.when(n(13), "12BAD").otherwise(F.col("seller_gstin"))).alias("seller"), party("buyer", F.col("buyer_gstin")).alias("buyer"),
        "line_items", (F.col("base") + F.when(n(7), 3).otherwise(0)).cast("double").alias("subtotal"), F.col("tax").cast("double").alias("total_tax"), F.lit(0.0).alias("round_off"), F.array().cast("array<string>").alias("processing_errors"),
        F.round((F.when(~n(11), K.HIGH).otherwise(0.0) + K.HIGH + K.MEDIUM) / 3, 3).alias("overall_confidence"),
    )


@query(_CHECKED + "SELECT doc_id, base::DOUBLE AS line_sum, stated::DOUBLE AS subtotal, doc_seq % 7 = 0 AS wrong FROM k")
def q_subtotal_check(spark, d):
    v = _invoices(spark, d)
    s = F.round(F.aggregate("line_items", F.lit(0.0), lambda a, x: a + x.taxable_amount), 2)
    return v.select("doc_id", s.alias("line_sum"), "subtotal", validate.subtotal_issue(F.col("line_items"), F.col("subtotal")).isNotNull().alias("wrong"))


@query(_CHECKED + "SELECT doc_id, total::DOUBLE AS grand_total, doc_seq % 7 = 0 AND tax > 0 AS wrong FROM k")
def q_total_check(spark, d):
    v = _invoices(spark, d)
    return v.select("doc_id", F.col("grand_total_value").alias("grand_total"), validate.total_issue(F.col("grand_total_value"), F.col("total_tax"), F.col("round_off"), F.col("subtotal")).isNotNull().alias("wrong"))


@query(_CHECKED + "SELECT doc_id, CASE WHEN doc_seq % 11 = 0 THEN 'Invoice Number' ELSE '' END AS missing FROM k")
def q_completeness(spark, d):
    gaps = validate.completeness(F.col("invoice_number.value"), F.col("invoice_date.value"), F.col("grand_total.value"), F.col("seller.name"), F.size("line_items"))
    return _invoices(spark, d).select("doc_id", F.array_join(F.transform(gaps, lambda x: x.field_name), ",").alias("missing"))


_AS_OF = "2003-06-01"
_STATUS = (
    "CASE WHEN doc_seq % 11 = 0 THEN 'FAIL' WHEN doc_seq % 13 = 0 OR doc_seq % 7 = 0 OR invoice_date < DATE '2003-06-01' - 1825 OR invoice_date > DATE '2003-06-02' OR EXISTS "
    "(SELECT 1 FROM i WHERE i.doc_id = k.doc_id AND abs(quantity * round(base / quantity, 2)::DECIMAL(18,2) - base) > 2.0) THEN 'WARNING' ELSE 'PASS' END"
)


@query(_CHECKED + f"SELECT doc_id, {_STATUS} AS status, doc_seq % 11 <> 0 AS complete FROM k")
def q_status(spark, d):
    return validate.validated(_invoices(spark, d), F.lit(_AS_OF).cast("date")).select("doc_id", "validation.status", "validation.complete")


@query(_CHECKED + f", z AS (SELECT {_STATUS} AS status FROM k) SELECT count(*) AS total, count_if(status = 'PASS')::BIGINT AS pass, count_if(status = 'WARNING')::BIGINT AS warning, count_if(status = 'FAIL')::BIGINT AS fail, 0::BIGINT AS unchecked FROM z")
def q_status_counts(spark, d):
    return invoice.status_counts(q_status(spark, d))


@query(
    _CHECKED + f"SELECT doc_seq + 1 AS ordinal, source_file, 'digital' AS pdf_type, CASE WHEN doc_seq % 11 = 0 THEN '' ELSE number END AS invoice_number, strftime(invoice_date, '%d/%m/%Y') AS invoice_date, seller AS seller_name, "
    f"CASE WHEN doc_seq % 13 = 0 THEN '12BAD' ELSE seller_gstin END AS seller_gstin, buyer_gstin, stated::DOUBLE AS subtotal, tax::DOUBLE AS total_tax, total::DOUBLE AS grand_total, (SELECT count(*) FROM i WHERE i.doc_id = k.doc_id)::INT AS line_items, "
    f"{_STATUS} AS status, CASE WHEN doc_seq % 11 = 0 THEN '57%' ELSE '88%' END AS confidence, '' AS errors FROM k"
)
def q_summary(spark, d):
    v = validate.validated(_invoices(spark, d), F.lit(_AS_OF).cast("date"))
    return invoice.summary(v, F.col("validation.status"))


@query(_CHECKED + "SELECT doc_id, CASE WHEN doc_seq % 11 = 0 THEN 0.567 ELSE 0.883 END::DOUBLE AS confidence, doc_seq % 11 = 0 AS number_needs_review FROM k")
def q_confidence(spark, d):
    return _invoices(spark, d).select("doc_id", F.col("overall_confidence").alias("confidence"), F.col("invoice_number.needs_review").alias("number_needs_review"))


_WS = r"regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g')"


@query(
    f"SELECT conv_id AS doc_id, count(*) AS page_count, count_if(length({_WS}) >= 50)::BIGINT AS digital_pages, count_if(length({_WS}) < 50)::BIGINT AS scanned_pages, "
    f"CASE WHEN count_if(length({_WS}) >= 50) = count(*) THEN 'digital' WHEN count_if(length({_WS}) >= 50) = 0 THEN 'scanned' ELSE 'hybrid' END AS pdf_type FROM conversations GROUP BY conv_id"
)
def q_classify(spark, d):
    c = read(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_no"), "text")
    return pages.classify(pages.page_profile(c)).select("doc_id", "page_count", "digital_pages", "scanned_pages", "pdf_type")


@query("SELECT conv_id AS doc_id, string_agg(coalesce(text, ''), chr(10) || chr(10) ORDER BY turn, coalesce(text, '')) AS text FROM conversations GROUP BY conv_id")
def q_full_text(spark, d):
    c = read(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page_no"), "text")
    return pages.full_text(c).select("doc_id", "text")


@query("SELECT user_id AS doc_id, round(coalesce(sum(CASE WHEN c > 0 THEN c END) / nullif(count_if(c > 0), 0), 0) / 997, 3) AS ocr_confidence FROM (SELECT user_id, greatest(round(value)::BIGINT % 1000, 0) AS c FROM events) GROUP BY user_id")
def q_ocr_confidence(spark, d):
    e = read(spark, d, "events").select(F.col("user_id").alias("doc_id"), (F.greatest(F.round("value").cast("long") % 1000, F.lit(0)) / 997).alias("confidence"))
    return pages.mean_confidence(e)


@query(
    _S + ", g AS (SELECT doc_id, sum(CASE WHEN inter_state THEN round(i.base * gst_rate * 0.01, 2) ELSE 2 * round(i.base * gst_rate * 0.005, 2) END) AS tax, sum(i.base) AS base FROM i JOIN h USING (doc_id) GROUP BY doc_id) "
    "SELECT doc_id, inter_state, base::DOUBLE AS subtotal, tax::DOUBLE AS total_tax, (base + tax)::DOUBLE AS grand_total, number FROM g JOIN h USING (doc_id)"
)
def q_vision_map(spark, d):
    i = star.items(spark, d)
    item = F.struct("description", F.col("hsn").alias("hsn_sac"), "quantity", F.col("base").cast("double").alias("taxable_amount"), "gst_rate")
    per = i.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", item.alias("item")))), lambda x: x.item).alias("line_items"))
    h = star.heads(spark, d).join(per, "doc_id")
    # States come from the identifiers, so these carry them; the stated total is wrong on purpose.
    reply = F.to_json(F.struct(F.col("number").alias("invoice_number"), F.date_format("invoice_date", "dd/MM/yyyy").alias("invoice_date"), F.struct(F.col("seller").alias("name"), F.col("seller_gstin").alias("gstin")).alias("seller"), F.struct(F.col("buyer").alias("name"), F.col("buyer_gstin").alias("gstin")).alias("buyer"), "line_items", F.lit(1.5).alias("grand_total")))
    v = vision.vision_invoices(h.select("doc_id", reply.alias("reply_json")))
    return v.select("doc_id", "inter_state", "subtotal", "total_tax", F.col("grand_total_value").alias("grand_total"), F.col("invoice_number.value").alias("number"))


@query(_S + "SELECT doc_id, seller, seller_gstin, seller_state, buyer, buyer_gstin FROM h")
def q_parties(spark, d):
    t = F.col("text")
    p = star.printed(spark, d).select("doc_id", fields.party(fields.seller_block(t)).alias("s"), fields.party(fields.buyer_block(t)).alias("b"))
    return p.select("doc_id", F.col("s.name").alias("seller"), F.col("s.gstin").alias("seller_gstin"), F.col("s.state").alias("seller_state"), F.col("b.name").alias("buyer"), F.col("b.gstin").alias("buyer_gstin"))


@query(_S + "SELECT doc_id, 'STATE BANK' AS bank_name, lpad(regexp_extract(number, '([0-9]+)$', 1), 8, '7') AS account_number, 'SBIN0001234' AS ifsc FROM h")
def q_bank(spark, d):
    return star.printed(spark, d).select("doc_id", fields.bank(F.col("text")).alias("b")).select("doc_id", "b.bank_name", "b.account_number", "b.ifsc")


@query(
    _S + "SELECT doc_id, number, strftime(invoice_date, '%d/%m/%Y') AS invoice_date, seller, buyer_gstin, place_of_supply, (base + tax)::DOUBLE AS grand_total, base::DOUBLE AS subtotal, tax::DOUBLE AS total_tax, "
    "(SELECT count(*) FROM i WHERE i.doc_id = h.doc_id)::INT AS n_items, 0.95::DOUBLE AS confidence FROM h JOIN t USING (doc_id)"
)
def q_parse_invoice(spark, d):
    p = invoice.parse(star.printed(spark, d))
    return p.select("doc_id", F.col("invoice_number.value").alias("number"), F.col("invoice_date.value").alias("invoice_date"), F.col("seller.name").alias("seller"), F.col("buyer.gstin").alias("buyer_gstin"), "place_of_supply", F.col("grand_total_value").alias("grand_total"), "subtotal", F.round("total_tax", 2).alias("total_tax"), F.size("line_items").alias("n_items"), F.col("overall_confidence").alias("confidence"))


#: Columns of the upload whose filled rows the guide's query counts, by the guide's row: it lists columns 2 to 45 but the fifth.
_GUIDED = {n - 2 - (n > 5): f"c{n:02d}" for n in (4, 7, 8, 32, 37, 38, 43, 44)}
_GUIDE_ROWS = ", ".join("({}, '{}', {}, {})".format(i, h, "NULL" if x is None else f"'{x}'", f"'{_GUIDED[i]}'" if i in _GUIDED else "NULL") for i, (h, x) in enumerate(K.JOURNAL_GUIDE))


@query(
    f"WITH g(seq, head, details, c) AS (VALUES {_GUIDE_ROWS}), u AS ({SQL['q_upload_format']}), n AS ("
    + " UNION ALL ".join(f"SELECT '{c}' AS c, count({c}) AS filled FROM u" for c in _GUIDED.values())
    + ") SELECT seq, head, details, coalesce(filled, 0) AS filled FROM g LEFT JOIN n USING (c)"
)
def q_guide(spark, d):
    """The guide, and how many rows of the tables' journal have something in the columns that vary."""
    rows = q_upload_format(spark, d).agg(*(F.count(c).alias(c) for c in _GUIDED.values()))
    filled = rows.select(F.inline(F.array(*(F.struct(F.lit(i).alias("seq"), F.col(c).alias("filled")) for i, c in _GUIDED.items()))))
    return journal.guide(spark).join(filled, "seq", "left").select("seq", "head", "details", F.coalesce("filled", F.lit(0).cast("long")).alias("filled"))


@query("SELECT o_orderkey, concat('₹', format('{:,.2f}', o_totalprice)) AS shown, concat(format('{:.1f}', (o_orderkey % 28)::DOUBLE), '%') AS rate FROM orders")
def q_formats(spark, d):
    return read(spark, d, "orders").select("o_orderkey", money.rupees(F.col("o_totalprice")).alias("shown"), F.format_string("%.1f%%", F.pmod("o_orderkey", F.lit(28)).cast("double")).alias("rate"))


@query("SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \\t\\n\\r\\f\\v]'))) AS n_lines FROM documents")
def q_text_lines(spark, d):
    return read(spark, d, "documents").select("doc_id", F.size(text.lines(F.col("text"))).cast("long").alias("n_lines"))
