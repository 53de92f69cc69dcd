"""Line items from free text.

The last event that opened or closed the items before a line decides whether it
is inside. A document's items are found in its own row, without a shuffle: its
events are written as a string of one sign a line, and each run behind an opening
sign is inside. ``section_state`` says the same of lines that are rows already, by
a window. What a line means is worked out on arrays of its tokens in built-in
functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.layers import computed, let
from ..functions.money import amount
from ..functions.text import count_of, squeeze, strip, strip_chars, tokens
from ..plans import constants as K

ITEM = "struct<sr_no: int, description: string, hsn_sac: string, quantity: double, unit: string, unit_price: double, discount: double, taxable_amount: double, gst_rate: double, cgst_amount: double, sgst_amount: double, igst_amount: double, total_amount: double>"

_EVIDENCE = r"\b\d{{{digits}}}\b.*[\d,]+\.\d{{2}}|[\d,]+\.\d{{2}}.*[\d,]+\.\d{{2}}"
_OUTER = r"\s\-+*/()\[\]{}\":;',."
_EDGE = r".,:;*\-"
#: What each code and each unit looks like, and a little more, so that most words are told by one search.
_LIKE_HSN = rf"\A[{_EDGE}]*\d{{4,8}}[{_EDGE}\x{{85}}\x{{2028}}\x{{2029}}]*\z"
_LIKE_UNIT = rf"\A[^a-zA-Z]*(?iu:{'|'.join(K.UNITS)})[^a-zA-Z]*\z"
#: A number that needs no cleaning.
_PLAIN = r"\A\d+(?:\.\d+)?\z"


def header_words(line: Column) -> Column:
    """Whether a line or joined row looks like a table's header."""
    return count_of(F.lower(line), K.HEADER_WORDS) >= 2


def event_of(line: Column) -> Column:
    """C, S, E or null."""
    has = lambda p: F.rlike(line, F.lit(p))
    return F.when(has(K.ITEMS_DONE), "C").when(has(K.ITEMS_START) | header_words(line), "S").when(has(K.ITEMS_END) & ~has(_EVIDENCE.format(digits=4)), "E")


def events(lines: DataFrame) -> DataFrame:
    """lines(line) with event: C ends the items of the document, S opens them, E closes them."""
    return lines.withColumn("event", event_of(F.col("line")))


def text_lines(docs: DataFrame, key: str | list[str] = "doc_id", text: str = "text") -> DataFrame:
    """(key, line_no, line): stripped lines that are not blank; the key may be several columns."""
    out = docs.select(*([key] if isinstance(key, str) else key), F.posexplode(F.split(text, "\n")).alias("line_no", "line"))
    return out.withColumn("line", strip(F.col("line"))).where("line <> ''")


def section_state(lines: DataFrame, key: str | list[str] = "doc_id") -> DataFrame:
    """lines with event, in_section and done, as they stand at each line; by a key that documents are dealt by, they don't travel."""
    w = W.partitionBy(key).orderBy("line_no").rowsBetween(W.unboundedPreceding, W.currentRow)
    out = events(lines)
    opened = F.when(F.col("event") == "S", True).when(F.col("event") == "E", False)
    return out.withColumns(
        {
            "in_section": F.coalesce(F.last(opened, ignorenulls=True).over(w), F.lit(False)),
            "done": F.coalesce(F.max(F.col("event") == "C").over(w), F.lit(False)),
        }
    )


def is_numeric(token: Column) -> Column:
    s = strip_chars(token, r"“”‘’\"'|\[\]()\-+*\s")
    s = strip_chars(s, _OUTER)
    s = strip_chars(F.regexp_replace(s, r"(?i)(?:g|pc|pcs|nos|kg|ltr|mtr|gm|box|pkt|set|pair|doz|ream)\z", ""), _EDGE)
    return F.rlike(F.regexp_replace(s, r"\A[₹$]|%\z", ""), F.lit(r"^[+-]?\d[\d,.:]*$"))


def _first_index(array: Column, test) -> Column:
    """Index of the first element that passes, -1 if none does."""
    return F.coalesce(F.get(F.filter(F.transform(array, lambda x, i: F.when(test(x), i)), lambda i: i.isNotNull()), 0), F.lit(-1))


def _bare(token: Column) -> Column:
    return strip_chars(token, _EDGE)


def _letters(token: Column) -> Column:
    return F.lower(F.regexp_replace(token, r"\A[^a-zA-Z]+|[^a-zA-Z]+\z", ""))


def parsed_line(line: Column) -> Column:
    """Cleaned tokens of a line, the places of its HSN code and unit, and its numbers as (v, i)."""
    clean = F.regexp_replace(strip(F.translate(line, "|‘’`©§~", " " * 7)), r"(\d):(\d{2})\b", "$1.$2")

    def places(toks: Column) -> Column:
        hsn = _first_index(toks, lambda t: F.rlike(t, F.lit(_LIKE_HSN)) & F.rlike(_bare(t), F.lit(r"^\d{4,8}$")) & ~_bare(t).isin(*K.NOT_HSN))
        return F.struct(hsn.alias("hsn_i"), _first_index(toks, lambda t: F.rlike(t, F.lit(_LIKE_UNIT)) & _letters(t).isin(*K.UNITS)).alias("unit_i"))

    def numbers(toks: Column, at: Column) -> Column:
        # A number has a digit: most words are told by that.
        cleaned = lambda t: F.when(F.rlike(t, F.lit(r"\d")) & is_numeric(t), amount(strip_chars(t, _OUTER)))
        value = lambda t, i: F.when(i != at.hsn_i, F.when(F.rlike(t, F.lit(_PLAIN)), t.cast("double")).otherwise(cleaned(t)))
        return F.filter(F.transform(toks, lambda t, i: F.struct(value(t, i).alias("v"), i.alias("i"))), lambda n: n.v > 0)

    return let(tokens(clean), lambda toks: let(places(toks), lambda at: F.struct(toks.alias("toks"), at.hsn_i.alias("hsn_i"), at.unit_i.alias("unit_i"), numbers(toks, at).alias("numbers"))))


def _hsn(p: Column) -> Column:
    return F.when(p.hsn_i >= 0, _bare(F.get(p.toks, p.hsn_i))).otherwise("")


def _unit(p: Column) -> Column:
    return F.when(p.unit_i >= 0, _letters(F.get(p.toks, p.unit_i))).otherwise("pc")


def line_tokens(lines: DataFrame) -> DataFrame:
    """lines(line) with toks, hsn_i, unit_i, numbers, hsn and unit."""
    out, p = computed(lines, {"_p": parsed_line(F.col("line"))}), F.col("_p")
    return out.select(*(c for c in lines.columns if c not in ("hsn", "unit")), "_p.*", _hsn(p).alias("hsn"), _unit(p).alias("unit"))


def decide(numbers: Column) -> Column:
    """Quantity, rate and amount from a line's numbers, at most the last three, and the place of the first one used."""
    n = F.size(numbers)
    at = lambda k: F.try_element_at(numbers, F.lit(k))
    q, r, a = at(-3).v, at(-2).v, at(-1).v
    product, whole = q * r, lambda x: F.bround(x, 0).cast("long").cast("string")
    off = F.abs(product - a)
    out = lambda qty, rate, amt, first: F.struct(qty.alias("qty"), rate.alias("rate"), amt.alias("amt"), first.alias("first"))
    three = (
        F.when(off <= F.greatest(F.lit(2.0), a * 0.05), out(q, r, a, at(-3).i))
        .when((F.length(whole(a)) < F.length(whole(product))) & F.endswith(whole(product), whole(a)), out(q, r, product, at(-3).i))
        .when(off <= a * 0.25, out(q, a / q, a, at(-3).i))
        .when((a > r) & (r <= 500), out(r, a / r, a, at(-2).i))
        .otherwise(out(q, a / q, a, at(-3).i))
    )
    v1, v2, one = F.get(numbers, 0).v, F.get(numbers, 1).v, F.lit(1.0)
    two = F.when((v1 <= 500) & (v2 > v1), out(v1, v2 / v1, v2, F.get(numbers, 0).i)).otherwise(out(F.round(v2 / v1, 2), v1, v2, F.get(numbers, 0).i))
    return F.when(n >= 3, three).when(n == 2, two).when(n == 1, out(one, v1, v1, F.get(numbers, 0).i))


def line_item(line: Column) -> Column:
    """The item that a line inside the items is, its sr_no null where it prints none; null if it is no item."""
    address = F.rlike(line, F.lit(K.ADDRESS_LINE)) & ~F.rlike(line, F.lit(_EVIDENCE.format(digits="4,8")))

    def serial(p: Column) -> Column:
        """The place of a leading serial number, -1 if there is none, and its value."""
        head, first = F.get(p.numbers, 0), F.get(p.toks, 0)
        leads = (head.i == 0) | ((head.i == 1) & (((F.length(first) <= 3) & ~F.rlike(first, F.lit(r"^[\p{L}\p{N}]+$"))) | first.isin("E", "I", "l")))
        found = leads & (head.v == F.floor(head.v)) & (head.v <= 200)
        return F.struct(F.when(found, head.i).otherwise(-1).alias("i"), F.when(found, head.v.cast("int")).alias("v"))

    def left(p: Column, s: Column) -> Column:
        """The numbers but the serial one; without any, the first number inside another token."""
        loose = F.transform(p.toks, lambda t, i: F.struct(F.when((i != p.hsn_i) & (i != s.i), amount(F.regexp_extract(t, r"\d+(?:\.\d+)?", 0))).alias("v"), i.alias("i")))
        rest = F.when(s.i >= 0, F.slice(p.numbers, 2, 10_000)).otherwise(p.numbers)
        return let(rest, lambda x: F.when(F.size(x) > 0, x).otherwise(F.slice(F.filter(loose, lambda n: n.v > 0), 1, 1)))

    def description(p: Column, s: Column, d: Column) -> Column:
        begin, end = s.i + 1, F.when((p.hsn_i >= 0) & (p.hsn_i < d.first), p.hsn_i).otherwise(d.first)
        inner = F.when(end > begin, F.slice(p.toks, begin + 1, end - begin))
        others = F.filter(F.transform(p.toks, lambda t, i: F.when((i != p.hsn_i) & (i != p.unit_i) & (i != s.i), t)), lambda t: t.isNotNull())
        return strip(squeeze(F.regexp_replace(F.array_join(F.coalesce(inner, others), " "), "[|\\[\\]()\"{}:;',.\\-]", " ")))

    def item(p: Column, s: Column, d: Column, words: Column) -> Column:
        zero, two = F.lit(0.0), lambda c: F.round(c, 2)
        return F.struct(
            s.v.alias("sr_no"), words.alias("description"), _hsn(p).alias("hsn_sac"), two(d.qty).alias("quantity"), _unit(p).alias("unit"), two(d.rate).alias("unit_price"), zero.alias("discount"),
            two(d.amt).alias("taxable_amount"), zero.alias("gst_rate"), zero.alias("cgst_amount"), zero.alias("sgst_amount"), zero.alias("igst_amount"), two(d.amt).alias("total_amount"),
        ).cast(ITEM)

    def decided(p: Column, s: Column) -> Column:
        of = lambda d: let(description(p, s, d), lambda words: F.when(F.length(words) >= 2, item(p, s, d, words)))
        return let(let(left(p, s), decide), lambda d: F.when(d.amt > 0, of(d)))

    found = lambda p: F.when((F.size(p.toks) >= 2) & (F.size(p.numbers) > 0), let(serial(p), lambda s: decided(p, s)))
    # A line without a digit has no number.
    return F.when(F.rlike(line, F.lit(r"\d")) & ~F.rlike(line, F.lit(K.NEVER_ITEM)) & ~address, let(parsed_line(line), found))


def numbered_items(text: Column) -> Column:
    """(line_no, item) of each line of a text that is an item, in order."""
    every = F.transform(F.split(text, "\n"), lambda x, i: F.struct(i.alias("line_no"), strip(x).alias("line")))
    every = F.filter(every, lambda x: x.line != "")

    def inside(lines: Column) -> Column:
        """For each line up to the end of the items a sign, 1 if it is inside them and no event itself."""
        signs = F.array_join(F.transform(lines, lambda x: F.coalesce(event_of(x.line), F.lit("-"))), "")
        runs = F.split(F.get(F.split(signs, "C", 2), 0), "(?=[SE])")
        return F.split(F.array_join(F.transform(runs, lambda r: F.when(r.startswith("S"), F.translate(r, "S-", "01")).otherwise(F.translate(r, "E-", "00"))), ""), "")

    def found(lines: Column) -> Column:
        kept = let(inside(lines), lambda signs: F.filter(lines, lambda x, i: F.coalesce(F.get(signs, i), F.lit("0")) == "1"))
        items = F.transform(kept, lambda x: F.struct(x.line_no.alias("line_no"), line_item(x.line).alias("item")))
        return let(F.filter(items, lambda x: x["item"].isNotNull()), lambda xs: F.transform(xs, lambda x, i: F.struct(x.line_no.alias("line_no"), x["item"].withField("sr_no", F.coalesce(x["item"].sr_no, i + 1)).alias("item"))))

    return let(every, found)


def text_items(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line_no, item) for each line that is an item."""
    return docs.select(key, F.explode(numbered_items(F.col(text))).alias("x")).select(key, "x.line_no", "x.item")


_LEAD = r"^[ \t]*[|'\"\\/§\-‘’`]*[ \t]*([a-zA-Z\d§/]+)[ \t]*[|'\"\\/§\-‘’`]*[ \t]*([^|\n]+?)[ \t]+"
_PRICE = r"([\d,]+[.)]?\d*)[ \t]*[|/\\\])}]?[ \t]*(?:\w+)?[ \t]*(.*?)[ \t\r]*$"
#: Shapes of item lines in clean text: groups of description, code, tax rate, quantity, unit, rate and amount (0: none).
LEGACY = (
    (_LEAD + r"(\d{4,8})[ \t]+(\d+\.?\d*)[ \t]*%[ \t]+(\d+\.?\d*)[ \t]+(\w+)[ \t]+" + _PRICE, (2, 3, 4, 5, 6, 7, 8)),
    (_LEAD + r"(\d{4,8})[ \t]+(\d+\.?\d*)[ \t]+(\w+)[ \t]+" + _PRICE, (2, 3, 0, 4, 5, 6, 7)),
    (_LEAD + r"(\d+\.?\d*)[ \t]+(\w+)?[ \t]+" + _PRICE, (2, 0, 0, 3, 4, 5, 6)),
)


def _item_of(desc: Column, hsn: Column, qty: Column, unit: Column, rate: Column, gst: Column, value: Column) -> Column:
    """An item whose taxes are not known yet; its number is settled later."""
    zero = F.lit(0.0)
    return F.struct(
        F.lit(1).alias("sr_no"), desc.alias("description"), hsn.alias("hsn_sac"), qty.alias("quantity"), unit.alias("unit"), rate.alias("unit_price"), zero.alias("discount"), value.alias("taxable_amount"),
        gst.alias("gst_rate"), zero.alias("cgst_amount"), zero.alias("sgst_amount"), zero.alias("igst_amount"), value.alias("total_amount"),
    ).cast(ITEM)


def _family(text: Column, p: str, groups: tuple[int, ...]) -> Column:
    """Items of all lines of one shape; months for units and descriptions with long hexadecimal runs are no items."""
    months = [m.lower() for m in K.MONTHS.split("|")]

    def one(m):
        part = lambda g: F.regexp_extract(m, p, g) if g else F.lit("")
        desc, hsn, gst, qty, unit, rate, value = (part(g) for g in groups)
        qty, rate, value = qty.try_cast("double"), amount(rate), amount(value)
        wrong = ((value == 0) | (F.abs(qty * rate - value) > 2)) & (qty > 0) & (rate > 0)
        desc = strip_chars(desc, " \\t\\n\\r|'\"‘’`()\\[\\].\\-")
        return _item_of(desc, hsn, qty, F.when(unit == "", "pc").otherwise(unit), rate, F.coalesce(gst.try_cast("double"), F.lit(0.0)), F.when(wrong, qty * rate).otherwise(value))

    good = F.filter(F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(0)), one), lambda x: ~F.lower(x.unit).isin(*months) & ~((F.length(x.description) > 10) & F.rlike(F.lower(x.description), F.lit("[a-f0-9]{10,}"))))
    return let(good, lambda xs: F.when(F.size(xs) > 0, F.transform(xs, lambda x, i: x.withField("sr_no", i + 1))))


def legacy_items(text: Column) -> Column:
    """Items by the first shape that yields any, as an array."""
    return F.coalesce(*(_family(text, "(?md)" + shape, groups) for shape, groups in LEGACY), F.array().cast(f"array<{ITEM}>"))


def consolidated_item(text: Column, base: Column) -> Column:
    """A single item for a document of which only a sum is known."""
    code, words = F.regexp_extract(text, r"\b(\d{4,8})\b", 1), F.regexp_extract(text, "(?i)" + K.SERVICES, 1)
    desc = F.when(words != "", F.left(strip(words), F.lit(50))).otherwise("SERVICE EXPENSES")
    return _item_of(desc, code, F.lit(1.0), F.lit("pc"), base, F.lit(0.0), base)
