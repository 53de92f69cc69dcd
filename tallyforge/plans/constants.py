"""Label aliases, word lists, codes and column names that results must agree on.

Patterns are Java regular expressions with one group, tried in order.
"""

CURRENCY = r"(?:Rs\.?|₹|INR)?"
VALUE = r"([A-Za-z0-9\-/]+)"
BLANK = r"[ \t]*"


def _labelled(label: str) -> str:
    """A label, an optional dot and separator, and a value on the same line."""
    return rf"{label}\.?{BLANK}[:\-]?{BLANK}{VALUE}"


# fixed values: invoice number labels
NUMBER_LABELS = (
    rf"Invoice{BLANK}(?:Number|Num|No)\b",
    rf"Invoice{BLANK}Reference\b",
    rf"Invoice{BLANK}#",
    rf"Bill{BLANK}(?:Number|No)\b",
    rf"Ref{BLANK}(?:Number|No)\b",
    rf"Inv\.?{BLANK}(?:Number|Num|No)\b",
    rf"Voucher{BLANK}(?:Number|Num|No)\b",
    rf"Receipt{BLANK}(?:Number|Num|No)\b",
)
NUMBER_PATTERNS = (*map(_labelled, NUMBER_LABELS[:5]), rf"#{BLANK}:{BLANK}([A-Za-z0-9\-]+)", *map(_labelled, NUMBER_LABELS[5:]))
# fixed values: words that are never an invoice number
NOT_A_NUMBER = ("date", "dated", "invoice", "consignee")
NUMBER_REJECTS = (
    "consignee", "dated", "date", "buyer", "seller", "ship", "bill", "dispatch", "delivery", "note", "mode", "terms", "payment", "limited", "private",
    "pvt", "ltd", "ackno", "irn", "ack", "services", "total", "amount", "invoice", "tax", "gst", "place", "supply", "state", "code", "name", "address",
)
# fixed values: marks of an address line
ADDRESS_WORDS = (
    "floor", "road", "street", "park", "delphi", "hiranandani", "powai", "maharashtra", "tamil", "delhi", "bldg", "building", "chennai", "mumbai",
    "bangalore", "bengaluru", "state", "code", "gstin", "pan", "email", "cin",
)

# fixed values: short names of months
MONTHS = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec"
# fixed values: date shapes, in order of trial
DATE_NUMERIC = r"\b(\d{1,2}-\d{1,2}-\d{2,4}|\d{1,2}/\d{1,2}/\d{2,4}|\d{1,2}\.\d{1,2}\.\d{2,4})\b"
DATE_DAY_MONTH = rf"\b(\d{{1,2}}[\s\-]*(?:{MONTHS})[a-z]*[\s\-,]*\d{{2,4}})\b"
DATE_MONTH_DAY = rf"\b((?:{MONTHS})[a-z]*\s+\d{{1,2}},?\s*\d{{2,4}})\b"
DATE_ISO = r"\b(\d{4}[\-/]\d{1,2}[\-/]\d{1,2})\b"
DATES = (DATE_NUMERIC, DATE_DAY_MONTH, DATE_MONTH_DAY, DATE_ISO)
# fixed values: labels of dates, shapes of identifiers, read and valid
DATE_LABELS = (r"(?:Invoice\s*)?Date\s*[:\-]?\s*", r"Dated\s*[:\-]?\s*")

GSTIN = r"([0-9OoILil]{2}[A-Za-z]{5}[0-9OoILil]{4}[A-Za-z][0-9OoILilA-Za-z]{3})"
GSTIN_VALID = r"^\d{2}[A-Z]{5}\d{4}[A-Z]\d[A-Z][A-Z\d]$"

_SUM = r"([\d,]+\.?\d*)"
_CENTS = r"([\d,]+\.\d{2})"
# fixed values: total labels, specific before generic
TOTAL_PATTERNS = (
    rf"\bGrand\s*Total\s*[:\-]?\s*{CURRENCY}\s*{_SUM}",
    rf"\b(?:Total\s*Invoice\s*Value|Total\s*Amount)\s*[:\-]?\s*{CURRENCY}\s*{_SUM}",
    rf"\bTotal\s*Amount\s*Due\s*(?:ON\s*\w+)?\s*[:\-]?\s*{CURRENCY}\s*{_SUM}",
    rf"\bNet\s*payable\s*amount\s*[=:\- \t]*\s*{_CENTS}",
    rf"\b(?:Net\s*(?:Amount|Payable)|Amount\s*Payable|Balance\s*Due|Total\s*Due)\s*[:\-]?\s*{CURRENCY}\s*{_SUM}",
    rf"^Total\s+(?:Rs\.?|₹|INR)\s*{_CENTS}\s*$",
    rf"^Total\s+(\d[\d,]+\.\d{{2}})\s*$",
    rf"{{anchor}}Total\s*[?|:\- \t=]*\s*(?:Rs\.?|₹|INR|Tf)?\s*{_CENTS}",
    rf"{{anchor}}Total\s*[=:\-]\s*{CURRENCY}\s*{_SUM}",
    rf"^Total\s*[a-zA-Z%#$_\s|]*\s*{_CENTS}",
)
SUBTOTAL_PATTERNS = (rf"(?:Sub\s*Total|Taxable\s*Value|Net\s*Charges)\s*[:\-]?\s*{CURRENCY}\s*{_SUM}",)
PLACE_PATTERNS = (r"Place\s*of\s*Supply\s*[:\-]?\s*(.+?)(?:\n|\(|$)",)
IRN_PATTERNS = (r"IRN\s*[:\-]?\s*([a-f0-9]{64})", r"IRN\s*[:\-]?\s*([A-Za-z0-9]{30,})")
ACK_NUMBER_PATTERNS = (r"Ack\s*(?:No|Number)\.?\s*[:\-]?\s*(\d+)",)
ACK_DATE_PATTERNS = (r"Ack\s*Date\s*[:\-]?\s*(.+?)(?:\n|$)",)
ORDER_PATTERNS = (r"(?:P\.?O\.?\s*(?:No|#|Number)?|Purchase\s*Order\s*(?:No)?|Buyer.?s\s*Order\s*No)\.?\s*[:\-]?\s*([A-Za-z0-9\-/]+(?:\s*[A-Za-z0-9\-/]+)*)",)
_RUPEES = r"(?:INR|Rs\.?|Indian\s*Rupee?s?)?\s*(.*?)(?:\n|$)"
WORDS_PATTERNS = (
    rf"Amount\s*(?:Chargeable|in\s*Words?)\s*(?:\(in\s*words\))?\s*[:\-]?\s*(?:E\.\s*&?\s*O\.E\.?)?\s*\n?\s*{_RUPEES}",
    rf"Total\s*In\s*Words\s*\n?\s*{_RUPEES}",
)
ROUND_OFF_PATTERNS = (r"Round\s*Off\s*[:\-]?\s*([\-\d.]+)",)
REVERSE_PATTERNS = (r"Reverse\s*Charge\s*[:\-]?\s*(\w+)",)
BANK_NAME = (r"Bank\s*Name\s*[:\-]?\s*(.+?)(?:\n|$)",)
BANK_ACCOUNT = (r"A/?c\s*No\.?\s*[:\-]?\s*(\d+)",)
BANK_IFSC = (r"(?:IFS?\s*Code|IFSC)\s*[:\-]?\s*([A-Z]{4}\d{7})",)
BANK_BRANCH = (r"Branch\s*(?:&?\s*IFS?\s*Code)?\s*[:\-]?\s*(.+?)(?:\n|$)",)
BANK_SWIFT = (r"SWIFT\s*(?:Code)?\s*[:\-]?\s*([A-Z]+)",)

# fixed values: where blocks of parties begin and end
SELLER_ENDS = (r"Consignee", r"Bill\s*To", r"Buyer", r"Issued\s*To", r"Ship\s*To", r"Sold\s*To")
BUYER_STARTS = (r"Bill\s*To", r"Buyer\s*\(Bill\s*to\)", r"Buyer", r"Issued\s*To", r"Sold\s*To")
BUYER_ENDS = (r"Sl\.?\s*No", r"Sr\.?\s*No", r"#\s", r"Particulars", r"Description", r"Item", r"HSN", r"Dispatch")
SHIP_STARTS = (r"Ship\s*To", r"Consignee\s*\(Ship\s*to\)", r"Consignee")
SHIP_ENDS = (r"Bill\s*To", r"Buyer", r"Invoice\s*No", r"Sl\.?\s*No", r"Dispatch")
PARTY_REJECTS = (
    "tax invoice", "invoice", "gst invoice", "original", "duplicate", "triplicate", "consignee", "buyer", "bill to", "ship to", "sold to",
    "delivery note", "dated", "terms of delivery", "mode/terms of payment",
)
ADDRESS_STOP = r"(?i)GSTIN|State|PAN|Code|CIN|Email|Phone|Contact|Invoice\s*No"

# fixed values: table headers
HEADER_WORDS = ("description", "particulars", "qty", "quantity", "rate", "amount", "hsn", "sac", "item", "sl.no", "sr.no")
TOTAL_WORDS = (
    "total", "sub total", "subtotal", "grand total", "amount chargeable", "tax amount", "carried forward", "continued", "output", "cgst", "sgst", "igst",
    "round off", "e. & o.e",
)
COLUMN_WORDS = (
    ("sr_no", ("sl", "sr", "sno", "s.no", "#", "no")),
    ("description", ("description", "particulars", "item", "product", "goods", "service")),
    ("hsn_sac", ("hsn", "sac")),
    ("quantity", ("qty", "quantity", "nos", "unit")),
    ("rate", ("rate", "price", "mrp")),
    ("per", ("per", "uom")),
    ("discount", ("disc",)),
    ("amount", ("amount", "total", "value")),
    ("gst_rate", ("gst", "tax rate")),
    ("cgst", ("cgst",)),
    ("sgst", ("sgst", "utgst")),
    ("igst", ("igst",)),
)

# fixed values: sections of item lines
ITEMS_DONE = r"(?i)\b(?:Declaration|Bank\s*Details|Amount\s*Chargeable|Rupees\s*Only|INR\s+\w+\s+Only)\b"
ITEMS_START = r"(?i)\b(?:Description\s*of\s*Goods|Particulars|S[lr]\s*\.?\s*No)\b"
ITEMS_END = r"(?i)(?:^|\s)(?:Total|Sub\s*Total|Amount\s*Chargeable|Round\s*Off|[CSI]GST\s*@|Tax\s*Amount|Taxable\s*Value|HSN/SAC\s+Taxable|Declaration|Bank\s*Details|continued)\b"
NEVER_ITEM = r"(?i)\b(?:[CSI]GST|UTGST|Sub\s*Total|Round\s*Off|Amount\s*Chargeable|Rupees\s*Only|Declaration|Bank\s*Details)\b"
ADDRESS_LINE = (
    r"(?i)(?:Floor|Road|Street|Basement|Tower|Place|Delhi|Mumbai|Chennai|Bangalore|Bengaluru|State\s*Name|GSTIN|E-Mail|Consignee|Buyer|Ship\s*to|Bill\s*to|"
    r"Dispatch|Delivery\s*Note|Mode/T|Reference\s*No|Invoice\s*No|Dated)"
)
UNITS = ("pc", "pcs", "nos", "kg", "ltr", "mtr", "gm", "box", "pkt", "set", "pair", "doz", "ream")
NOT_HSN = ("2025", "2026", "2027", "2028", "110044")
SERVICES = r"((?:Subscription|Support|Professional|Courier|Rent|Consulting|Maintenance|Charges|Fees|Service)[^\n]+)"

# fixed values: tax shapes
TAX_SHAPES = (
    (r"(CGST|SGST|IGST|UTGST|CESS)\s*(?:\d+\s*)?(?:\(?\s*)?(\d+\.?\d*)\s*%?\)?\s*[:\-]?\s*([\d,]+\.?\d*)", True),
    (r"OUTPUT\s*@\s*(CGST|SGST|IGST)\s*([\d,]+\.?\d*)", False),
    (r"(CGST|SGST|IGST)\d*\s*\((\d+\.?\d*)\s*%?\)\s*([\d,]+\.?\d*)", True),
)
HSN_RATE = r"(\d{4,8})\s+[\d,]+\.\d{2}\s+(?:.*?)\s*(\d+\.?\d*)\s*%"

# fixed values: journal codes
JOURNAL = {
    "vendor": "CMS0019487", "gl": "1310020100", "type": "SEXPS", "igst": "1120599006", "sgst": "1120599005", "cgst": "1120599007",
    "expense": "REPAIRS AND MAINT. OFFICE BLDG", "first": "1;3;6;7", "other": "6;7", "branch": "LXS00", "none": "_NA", "channel": "CC004",
    "tds": "TD02", "department": "SRO", "base_credit": "GST02", "tax_credit": "GST01", "no_items": "OFFICE EXPENSES",
}
# fixed values: journal columns; the twelfth repeats the name of the fifth
JOURNAL_COLUMNS = (
    "L id", "Acc Period", "Trans Date", "Account Code", "Description", "Curr Code", "Trans Amount", "Dr_Cr", "Jrnal Type", "Jrnal Source", "Reference",
    "Description", "Asset Code", "Asset Indicator", "Asset / Item Qty", "Due Date", "Branch Analysis Code", "Product  Analysis Code", "ChannelAnalysisCode",
    "Sub-Channel  Analysis Code", "Underwriting Year  Analysis Code", "Employee Code  Analysis Code", "TDS Applicability  Analysis Code",
    "Department   Analysis Code", "Sequence Code  Analysis Code", "Vendor Code  Analysis Code", "Invoice Date", "From Date", "To Date", "Addl Date 4",
    "Addl Date 5", "Cheque & NEFT Number", "Invoice Number", "Additional Remarks", "Àdditional Remarks 2", "CREDENCE DESCRIPTION", "HSN/SAC NO",
    "Taxable on Amount", "Reverse Charge (Y/N)", "Reverse charge %", "Item Details (Sr.No)", "Goods/Service", "GST Tax Rate",
    "Orginal Invoice no for Dr/Cr Notes", "Advance Challan No ", *(f"Addl Description {n}" for n in range(15, 26)),
)
# fixed values: journal columns and what stands in each, as the guide prints them
JOURNAL_GUIDE = (
    ("Acc Period", "Period of entry"),
    ("Trans Date", "Date of entry"),
    ("Account Code", "Respective GL code"),
    ("Curr Code", "INR"),
    ("Trans Amount", "Amount"),
    ("Dr_Cr", "Debit or Credit"),
    ("Jrnal Type", "SEXPS or HEXPS"),
    ("Jrnal Source", "Not applicable"),
    ("Reference", "Vendor code and Name"),
    ("Description", "Nature of expenses"),
    ("Asset Code", "to be blank"),
    ("Asset Indicator", "to be blank"),
    ("Asset / Item Qty", "to be blank"),
    ("Due Date", "to be blank"),
    ("Branch Analysis Code", "Branch code"),
    ("Product  Analysis Code", "Not applicable"),
    ("ChannelAnalysisCode", "Respective channel code"),
    ("Sub-Channel  Analysis Code", "Not applicable"),
    ("Underwriting Year  Analysis Code", "Not applicable"),
    ("Employee Code  Analysis Code", "Not applicable"),
    ("TDS Applicability  Analysis Code", "TD01  if TDS applicable"),
    ("Department   Analysis Code", None),
    ("Sequence Code  Analysis Code", "Not applicable"),
    ("Vendor Code  Analysis Code", "Vendor code"),
    ("Invoice Date", "Invoice date"),
    ("From Date", "Not applicable"),
    ("To Date", "Not applicable"),
    ("Addl Date 4", None),
    ("Addl Date 5", None),
    ("Cheque & NEFT Number", "Vendor GST number"),
    ("Invoice Number", "Vendor invoice number"),
    ("Additional Remarks", "NEFT or Cheque"),
    ("Àdditional Remarks 2", "Not applicable"),
    ("CREDENCE DESCRIPTION", "Not applicable"),
    ("HSN/SAC NO", "As per invoice"),
    ("Taxable on Amount", "Invoice value for GST"),
    ("Reverse Charge (Y/N)", "Not applicable"),
    ("Reverse charge %", "Not applicable"),
    ("Item Details (Sr.No)", "Not applicable"),
    ("Goods/Service", "Not applicable"),
    ("GST Tax Rate", "GST rate"),
    ("Orginal Invoice no for Dr/Cr Notes", "RS GST number"),
    ("Advance Challan No ", "Respective expenses account code"),
)
SUMMARY_COLUMNS = (
    "S.No", "Source File", "PDF Type", "Invoice Number", "Invoice Date", "Seller Name", "Seller GSTIN", "Buyer GSTIN", "Subtotal (₹)", "Total Tax (₹)",
    "Grand Total (₹)", "Line Items", "Validation Status", "Confidence", "Errors",
)

# fixed values: fiscal years inside an invoice number
FISCAL_YEAR = r"2[56]-?2[67]"

# limits
PAGE_CHARS, FILL_DIGITAL, FILL_OCR, TOLERANCE, VISION_TOLERANCE, HIGH, MEDIUM = 50, 0.15, 0.02, 2.0, 1.0, 0.95, 0.75
