"""Scalar functions as column expressions: keys, tax identifiers, numbers, dates and texts of money."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from payloom.sources.views import match_key

__all__ = ["match_key"]

#: The layout of a GSTIN, of a PAN, the places of a GSTIN that hold digits, and its check alphabet.
GSTIN = "^[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][1-9A-Z]Z[0-9A-Z]$"
PAN = "^[A-Z]{5}[0-9]{4}[A-Z]$"
DIGIT_PLACES = (0, 1, 7, 8, 9, 10, 12)
ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Date forms in the order in which they are tried.
DATE_FORMS = ("dd/MM/yyyy", "dd-MM-yyyy", "dd.MM.yyyy", "yyyy-MM-dd", "yyyy/MM/dd", "dd MMM yyyy", "dd MMMM yyyy", "dd-MMM-yyyy", "MMM dd, yyyy", "MMMM dd, yyyy", "MM/dd/yyyy", "dd/MM/yy")


def compact(x: Column) -> Column:
    """F-2: runs of white space as one space."""
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def gstin(x: Column) -> Column:
    """F-3: upper case, letters and digits, and at places of digits O as 0 and I, L as 1."""
    bare = F.regexp_replace(F.upper(x), "[^A-Z0-9]", "")
    places = F.array(*map(F.lit, DIGIT_PLACES))
    return F.array_join(F.transform(F.split(bare, ""), lambda c, i: F.when(F.array_contains(places, i), F.translate(c, "OIL", "011")).otherwise(c)), "")


def gstin_checksum(x: Column) -> Column:
    """F-5: whether the last of 15 characters is the check character of the others (weights 1, 2, 1, 2, ... in base 36)."""
    def sound(t: Column) -> Column:
        value = lambda i: F.call_function("locate", F.substring(t, i + 1, 1), F.lit(ALPHABET)) - 1
        total = F.lit(0)
        for i in range(14):
            product = value(i) * (1 + i % 2)
            total = total + F.floor(product / 36) + product % 36
        return F.coalesce((F.length(t) == 15) & (F.pmod(36 - F.pmod(total, F.lit(36)), F.lit(36)) == value(14)), F.lit(False))

    return once(x, sound)


def once(x: Column, use) -> Column:
    """``use`` of a column that is computed once, as a lambda's variable, and not at each place that names it."""
    return F.get(F.transform(F.array(x), use), F.lit(0))


def pan(x: Column) -> Column:
    """F-7."""
    return F.regexp_replace(F.upper(x), "[^A-Z0-9]", "")


def number(x: Column, default: float | None = 0.0) -> Column:
    """F-19, F-20: of a comma and a point the later one is the decimal mark; commas alone are decimal marks if two characters
    follow the last one (several are no number then), else they group."""
    def read(bare: Column) -> Column:
        comma, point = F.length(bare) - F.instr(F.reverse(bare), ","), F.length(bare) - F.instr(F.reverse(bare), ".")
        both = bare.contains(",") & bare.contains(".")
        text = F.when(both & (comma > point), F.replace(F.replace(bare, F.lit("."), F.lit("")), F.lit(","), F.lit("."))).when(both, F.replace(bare, F.lit(","), F.lit("")))
        tail = F.length(F.substring_index(bare, ",", -1))
        text = text.when(bare.contains(",") & (tail == 2), F.replace(bare, F.lit(","), F.lit("."))).otherwise(F.replace(bare, F.lit(","), F.lit("")))
        return text.try_cast("decimal(18,2)")

    parsed = once(F.regexp_replace(x, "[^0-9,.-]", ""), read)
    return parsed if default is None else F.coalesce(parsed, F.lit(default).cast("decimal(18,2)"))


def percent(x: Column) -> Column:
    """F-21: the first number."""
    return F.nullif(F.regexp_extract(x, r"(\d+(?:\.\d+)?)", 1), F.lit("")).try_cast("decimal(8,3)")


def invoice_date(x: Column, forms: tuple[str, ...] = DATE_FORMS) -> Column:
    """F-28: the first form that reads the text; texts that none reads stay null (see ``date_tail``)."""
    return F.coalesce(*[F.try_to_timestamp(F.trim(x), F.lit(f)).cast("date") for f in forms])


def date_tail(x: Column) -> Column:
    """F-28, F-29: free forms, day first, by an Arrow function for the few texts that no form reads."""
    @F.pandas_udf("date")
    def parsed(texts: pd.Series) -> pd.Series:
        from dateutil import parser

        def one(t):
            try:
                return parser.parse(t, dayfirst=True).date() if t else None
            except (ValueError, OverflowError, TypeError):
                return None

        return texts.map(one)

    return parsed(x)


def fingerprint(tax_id: Column, invoice_no: Column, day: Column, amount: Column) -> Column:
    """F-8: a hash of four normalised parts, null if any is missing."""
    parts = [F.nullif(F.upper(F.regexp_replace(tax_id, "[^A-Za-z0-9]", "")), F.lit("")), F.nullif(match_key(invoice_no), F.lit("")), day.cast("string"), F.bround(amount, 2).cast("decimal(18,2)").cast("string")]
    missing = F.lit(False)
    for p in parts:
        missing = missing | p.isNull()
    return F.when(~missing, F.sha2(F.concat_ws("|", *parts), 256))


def display_amount(x: Column) -> Column:
    """F-11: grouped thousands, without trailing zeros."""
    return F.regexp_replace(F.format_number(x, 2), "[.]?0+$", "")


def hsn(x: Column) -> Column:
    """F-13: the leading digits of a code."""
    return F.regexp_extract(x, r"^\s*(\d{2,8})", 1)


#: What a column's header holds, and what the column is; the first that fits counts.
HEADERS = (
    ("description|particular|product|item|service", "description"),
    ("hsn|sac", "hsn_sac"),
    (r"quantity|\bqty\b|\bqnty\b", "quantity"),
    ("(?=.*amount).*(?:gst|tax rate)", "tax_amount"),
    ("gst|tax rate", "gst_rate"),
    ("unit price|unit rate|^(?:rate|price)$", "unit_price"),
    ("tax amount", "tax_amount"),
    ("amount|total|value", "line_total"),
    ("discount", "discount"),
)


def header_key(x: Column) -> Column:
    """F-14: what a column's header means, by the first of HEADERS that its words hold."""
    def first(t: Column) -> Column:
        out = F.when(F.lit(False), "")
        for pattern, key in HEADERS:
            out = out.when(t.rlike(pattern), key)
        return out

    return once(F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", " ")), first)


#: Fixed value: how rows begin that sum others up.
SUMMARY = r"(?i)^\s*(sub ?total|grand total|total|tax|cgst|sgst|igst|balance)"


def is_summary(x: Column) -> Column:
    """F-15."""
    return x.rlike(SUMMARY)


def mean_confidence(fields: Column) -> Column:
    """F-26: the mean of the fields' confidences, null ones left out; 0 without any."""
    seen = F.filter(fields, lambda c: c.isNotNull())
    return F.when(F.size(seen) > 0, F.aggregate(seen, F.lit(0.0), lambda s, c: s + c) / F.size(seen)).otherwise(0.0)


def item_confidence(*cells: Column) -> Column:
    """F-27: 0.45 and 0.1 for each cell that was read, 0.98 at most."""
    return F.round(F.least(F.lit(0.98), F.lit(0.45) + 0.1 * sum((c.isNotNull().cast("int") for c in cells), F.lit(0))), 2)


def currency(x: Column) -> Column:
    """F-18: the first sign in a fixed order, else INR."""
    out = F.when(F.lit(False), "")
    for sign, code in (("₹", "INR"), ("Rs", "INR"), ("INR", "INR"), ("$", "USD"), ("USD", "USD"), ("€", "EUR"), ("EUR", "EUR"), ("£", "GBP"), ("GBP", "GBP")):
        out = out.when(x.contains(sign), code)
    return out.otherwise("INR")


def composite_confidence(fields: Column, ocr: Column, passed: Column) -> Column:
    """F-25: 0.6 of the fields' mean, 0.2 of the words' and 0.2 of the share of passed checks (half without any)."""
    return F.round(F.least(F.lit(1.0), 0.6 * fields + 0.2 * ocr + 0.2 * F.coalesce(passed, F.lit(0.5))), 3)


#: Names by which QR codes call an invoice's fields, in the order in which they are looked up.
QR_ALIASES = {
    "invoice_number": ("docno", "docnumber", "invoiceno", "invoicenumber", "invoiceid", "billno"),
    "invoice_date": ("docdt", "docdate", "invoicedate", "invoicedt"),
    "seller_gstin": ("sellergstin", "suppliergstin", "suppliergstinno", "suppliergstinnumber", "gstin"),
    "buyer_gstin": ("buyergstin", "recipientgstin", "customergstin"),
    "taxable_amount": ("tottaxableval", "taxablevalue", "taxableamount", "taxable"),
    "tax_total": ("tottax", "totaltax", "taxamount", "tax"),
    "grand_total": ("totinvval", "totalinvoicevalue", "invoicevalue", "grandtotal", "totalamount", "total"),
    "irn": ("irn",),
    "ack_number": ("ackno", "acknumber", "acknowledgementnumber", "ack"),
}
#: Levels of nested objects that are read in a payload.
QR_DEPTH = 4


def _json_map(t: Column) -> Column:
    return F.from_json(F.when(t.rlike(r"^\s*\{"), t), "map<string,string>")


def _last_wins(pairs: Column) -> Column:
    """A map of an array of (key, value); of equal keys the last counts."""
    at = lambda ps: F.filter(F.transform(ps, lambda p, i: F.struct(p["key"].alias("key"), p["value"].alias("value"), i.alias("i"))), lambda q: ~F.exists(F.slice(ps, q["i"] + 2, F.size(ps)), lambda r: r["key"] == q["key"]))
    return once(pairs, lambda ps: F.map_from_entries(F.transform(at(ps), lambda q: F.struct(q["key"], q["value"]))))


def _flat(t: Column, depth: int) -> Column:
    """F-33: the entries of a JSON object and of the objects in it, each after the entry that holds it."""
    entry = lambda e: F.struct(match_key(e["key"]).alias("key"), e["value"].alias("value"))
    here = lambda e: F.array(entry(e))
    more = here if depth == 0 else lambda e: F.concat(here(e), F.coalesce(_flat(e["value"], depth - 1), F.array().cast("array<struct<key:string,value:string>>")))
    return F.flatten(F.transform(F.map_entries(_json_map(t)), more))


def qr_fields(payload: Column) -> Column:
    """F-32, F-33, F-34: a QR payload as a map of normalised keys: from JSON (nested objects too), base64url JSON, a URL's
    query, or key=value pairs. Pairs bear the first alias of their field. Blank values don't count; the last of a key does."""
    decoded = F.try_to_binary(F.when(F.length(payload) >= 16, F.translate(payload, "-_", "+/")), F.lit("base64")).cast("string")
    split = lambda t, marks, sign: F.filter(F.transform(F.split(t, marks), lambda p: F.split(p, sign, 2)), lambda p: (F.size(p) == 2) & (F.trim(F.get(p, 1)) != "") & (F.trim(F.get(p, 0)) != ""))
    query = F.nullif(F.regexp_extract(payload, r"^[^#?]*\?([^#]*)", 1), F.lit(""))
    asked = F.transform(split(query, "&", "="), lambda p: F.struct(match_key(F.try_url_decode(p[0])).alias("key"), F.coalesce(F.try_url_decode(p[1]), p[1]).alias("value")))
    first = F.create_map(*[F.lit(v) for names in QR_ALIASES.values() for a in names for v in (a, names[0])])
    named = lambda k: F.coalesce(F.try_element_at(first, k), k)
    each = F.transform(F.split(payload, r"[|;&,\n]"), lambda p: F.split(p, F.when(p.contains("="), F.lit("=")).otherwise(F.lit(":")), 2))
    pairs = F.transform(F.filter(each, lambda p: (F.size(p) == 2) & (F.trim(F.get(p, 1)) != "") & (F.trim(F.get(p, 0)) != "")), lambda p: F.struct(named(match_key(p[0])).alias("key"), F.trim(p[1]).alias("value")))
    of_json = lambda t: _last_wins(F.filter(_flat(t, QR_DEPTH - 1), lambda e: e["key"].isNotNull()))
    return F.coalesce(of_json(payload), of_json(decoded), F.when(F.size(asked) > 0, _last_wins(asked)), _last_wins(pairs))


def qr_field(fields: Column, name: str) -> Column:
    """F-34: the first alias of a field that has a value."""
    return F.coalesce(*[F.nullif(F.try_element_at(fields, F.lit(a)), F.lit("")) for a in QR_ALIASES[name]])


def qr_canonical(name: str, x: Column) -> Column:
    """F-35: a value as values of its field are compared."""
    plain = F.lower(compact(x))
    if name in ("taxable_amount", "tax_total", "grand_total"):
        return F.coalesce(F.regexp_replace(x, "[^0-9.-]", "").try_cast("decimal(18,2)").cast("string"), F.lower(F.regexp_replace(x, r"\s+", "")))
    if name == "invoice_date":
        return F.coalesce(invoice_date(x).cast("string"), plain)
    if name in ("seller_gstin", "buyer_gstin"):
        return gstin(x)
    return match_key(x) if name == "invoice_number" else plain


def qr_comparison(fields: Column, known: dict[str, Column]) -> Column:
    """J-18: of each field that the code holds and ``known`` names: field, status, difference (of amounts that differ)."""
    def one(name: str, ours: Column) -> Column:
        qr = qr_field(fields, name)
        same = qr_canonical(name, qr) == qr_canonical(name, ours)
        status = F.when(F.coalesce(ours, F.lit("")) == "", "not_comparable").when(same, "match").otherwise("mismatch")
        bare = lambda x: F.regexp_replace(x, "[^0-9.-]", "").try_cast("decimal(18,2)")
        gap = F.when(~same, F.abs(bare(qr) - bare(ours)).cast("decimal(18,2)")) if name in ("taxable_amount", "tax_total", "grand_total") else F.lit(None).cast("decimal(18,2)")
        return F.when(qr.isNotNull(), F.struct(F.lit(name).alias("field"), status.alias("status"), gap.alias("difference")))

    return F.filter(F.array(*[one(n, c) for n, c in known.items()]), lambda r: r.isNotNull())


def qr_status(compared: Column) -> Column:
    """J-18: a mismatch if any field has one, else a match if any has one, else not comparable."""
    any_ = lambda s: F.exists(compared, lambda r: r["status"] == s)
    return F.when(any_("mismatch"), "mismatch").when(any_("match"), "match").otherwise("not_comparable")
