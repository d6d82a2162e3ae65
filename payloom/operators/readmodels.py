"""Lists, searches, queues, bundles and exports."""

from __future__ import annotations

import re
from datetime import date, datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from payloom.sources.views import AS_OF


def document_list(docs: DataFrame, status: str | None = None, vendor: str | None = None, start: str | None = None, end: str | None = None, page: int = 1, size: int = 20) -> DataFrame:
    """P-2, O-1, A-17: a page of documents, newest first, with the number of all matches and of pages."""
    size = max(1, min(100, size))
    for given, test in ((status, F.col("status") == status), (vendor, F.col("vendor_name").ilike(f"%{vendor}%")), (start, F.col("created_at") >= F.lit(start).cast("date")), (end, F.col("created_at") < F.date_add(F.lit(end).cast("date"), 1))):
        if given:
            docs = docs.where(test)
    counted = docs.agg(F.count("*").alias("matches"))
    shown = docs.orderBy(F.desc("created_at"), "document_id").offset((page - 1) * size).limit(size)
    return shown.select("document_id", "vendor_name", "status", "grand_total").crossJoin(counted).withColumn("pages", F.ceil(F.col("matches") / size))


def invoice_filter(invoices: DataFrame, status=None, risk=None, vendor_id=None, overdue: bool = False, start=None, end=None, low=None, high=None, as_of: str = AS_OF) -> DataFrame:
    """P-3: conjunction of the filters that are given."""
    tests = [
        (status, lambda: F.col("status") == status), (risk, lambda: F.col("risk_level") == risk), (vendor_id, lambda: F.col("vendor_id") == vendor_id), (overdue, lambda: (F.col("due_date") < F.lit(as_of).cast("date")) & (F.col("outstanding_amount") > 0)),
        (start, lambda: F.col("invoice_date") >= F.lit(start).cast("date")), (end, lambda: F.col("invoice_date") <= F.lit(end).cast("date")), (low, lambda: F.col("grand_total") >= F.lit(low).cast("decimal(18,2)")), (high, lambda: F.col("grand_total") <= F.lit(high).cast("decimal(18,2)")),
    ]
    for given, test in tests:
        if given is not None and given is not False:
            invoices = invoices.where(test())
    return invoices


def search_amount(term: str) -> str | None:
    """P-5: the amount that a search term states, if it states nothing else."""
    bare = re.sub(r"(?i)INR|Rs\.?|₹|,|\s", "", term)
    return bare if re.fullmatch(r"\d+(\.\d{1,2})?", bare) else None


def search_date(term: str) -> date | None:
    """P-6: a date in one of four forms."""
    for form in ("%Y-%m-%d", "%d/%m/%Y", "%d-%m-%Y", "%d %b %Y", "%d %B %Y"):
        try:
            return datetime.strptime(term.strip(), form).date()
        except ValueError:
            pass
    return None


def compact_gstin(term: str) -> str:
    """P-7: letters and digits in lower case, without a leading gstin or gst."""
    return re.sub("^(gstin|gst)", "", re.sub("[^a-z0-9]", "", term.lower()))


def invoice_search(invoices: DataFrame, vendors: DataFrame, term: str) -> DataFrame:
    """P-4, J-5: invoices whose number, order, status, vendor, amount or date matches the term. Wildcards of the term stay
    wildcards; an empty GSTIN matches nothing."""
    like, gstin = f"%{term.strip()}%", compact_gstin(term)
    by_vendor = F.col("name").ilike(like)
    if gstin:
        by_vendor = by_vendor | F.coalesce(F.lower("gstin").contains(gstin), F.lit(False))
    hits = vendors.where(by_vendor).select("tenant_id", "vendor_id", F.lit(True).alias("hit"))
    test = F.col("invoice_number").ilike(like) | F.col("po_number").ilike(like) | F.col("status").ilike(like) | F.col("hit")
    if amount := search_amount(term):
        test = test | (F.col("grand_total") == F.lit(amount).cast("decimal(18,2)"))
    if day := search_date(term):
        test = test | (F.col("invoice_date") == F.lit(day)) | (F.col("due_date") == F.lit(day))
    return invoices.join(hits, ["tenant_id", "vendor_id"], "left").where(F.coalesce(test, F.lit(False))).drop("hit")


def risk_queue(invoices: DataFrame) -> DataFrame:
    """P-10, O-3: medium and high risks, worst first."""
    return invoices.where(F.col("risk_level").isin("medium", "high")).orderBy(F.desc("risk_score"), F.desc("created_at"), "invoice_id")


def payments_due(invoices: DataFrame, vendors: DataFrame, overdue_only: bool = False, as_of: str = AS_OF) -> DataFrame:
    """Q-5, J-3, O-4: open balances by due date, whatever the status, with the vendor's name."""
    late = F.coalesce(F.col("due_date") < F.lit(as_of).cast("date"), F.lit(False))
    x = invoices.where("outstanding_amount > 0").withColumn("overdue", late)
    x = x.where("overdue") if overdue_only else x
    return x.join(vendors.select("tenant_id", "vendor_id", "name"), ["tenant_id", "vendor_id"], "left").select("invoice_id", "invoice_number", F.col("name").alias("vendor_name"), "due_date", "outstanding_amount", "currency", "overdue").orderBy(F.asc_nulls_last("due_date"), "invoice_id")


def vendor_detail(invoices: DataFrame, latest: int = 5) -> DataFrame:
    """O-5: each vendor's latest invoices, undated ones last."""
    w = Window.partitionBy("tenant_id", "vendor_id").orderBy(F.desc_nulls_last("invoice_date"), F.desc("created_at"), "invoice_id")
    return invoices.withColumn("place", F.row_number().over(w)).where(F.col("place") <= latest).select("vendor_id", "place", "invoice_id", "invoice_date", "grand_total")


def bundle(invoices: DataFrame, items: DataFrame, taxes: DataFrame, payments: DataFrame, vendors: DataFrame) -> DataFrame:
    """J-6, J-8: an invoice with its vendor and its lists of children, each collected by itself before it is joined."""
    each = lambda df, name, *order: df.groupBy("invoice_id").agg(F.sort_array(F.collect_list(F.struct(*order))).alias(name))
    x = invoices.join(vendors.select("tenant_id", "vendor_id", "name"), ["tenant_id", "vendor_id"], "left")
    for df, name, order in ((items, "items", ("pos", "description", "quantity", "unit_price")), (taxes, "taxes", ("tax_type", "rate_percent", "amount")), (payments, "payments", ("status", "amount"))):
        x = x.join(each(df, name, *order), "invoice_id", "left")
    return x


def bundle_digest(bundles: DataFrame) -> DataFrame:
    """A flat view of bundles."""
    return bundles.select("invoice_id", F.col("name").alias("vendor_name"), F.coalesce(F.size("items"), F.lit(0)).alias("n_items"), F.array_join(F.transform("items", lambda i: i["description"]), "|").alias("descriptions"), F.coalesce(F.size("taxes"), F.lit(0)).alias("n_taxes"), F.coalesce(F.size("payments"), F.lit(0)).alias("n_payments"))


def export_invoices(invoices: DataFrame, vendors: DataFrame, status: str | None = None) -> DataFrame:
    """S-22, S-23: the nine export columns as text, newest first."""
    x = invoice_filter(invoices, status=status).join(vendors.select("tenant_id", "vendor_id", "name"), ["tenant_id", "vendor_id"], "left")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return x.orderBy(F.desc("created_at"), "invoice_id").select(text("invoice_number").alias("invoice_number"), text("name").alias("vendor"), text("invoice_date").alias("invoice_date"), text("due_date").alias("due_date"), text("currency").alias("currency"), text("grand_total").alias("total"), text("outstanding_amount").alias("outstanding"), "status", "risk_level")


def export_lines(items: DataFrame, invoices: DataFrame) -> DataFrame:
    """S-25: one row per line item, or one row with a blank item; an item's confidence, else the invoice's."""
    per = items.groupBy("invoice_id").agg(F.sort_array(F.collect_list(F.struct("pos", "description", "quantity", "line_total"))).alias("items"))
    x = invoices.join(per, "invoice_id", "left").select("invoice_id", "invoice_number", "confidence", F.explode_outer("items").alias("i"))
    return x.select("invoice_id", "invoice_number", F.coalesce("i.pos", F.lit(0)).alias("pos"), F.coalesce("i.description", F.lit("")).alias("description"), F.col("i.quantity").alias("quantity"), F.col("i.line_total").alias("line_total"), "confidence")


def answers(questions: DataFrame, invoices: DataFrame, vendors: DataFrame) -> DataFrame:
    """Q-1: a fixed answer from an invoice's own data. The first route whose words the question holds wins; words match
    inside other words too."""
    q = F.lower("question")
    has = lambda *words: F.expr("false") if not words else F.exists(F.array(*map(F.lit, words)), lambda w: q.contains(w))
    money = lambda c: F.when(F.coalesce("currency", F.lit("INR")) == "INR", F.concat(F.lit("₹"), F.format_number(c, 2))).otherwise(F.concat(F.col("currency"), F.lit(" "), F.format_number(c, 2)))
    routes = [
        (("gstin",), F.coalesce("gstin", F.lit("GSTIN is not available in the invoice evidence.")), "invoice.vendor.gstin"),
        (("due",), F.coalesce(F.col("due_date").cast("string"), F.lit("Payment due date is not available.")), "invoice.due_date"),
        (("vendor", "supplier"), F.coalesce("name", F.lit("Vendor is not available in the invoice evidence.")), "invoice.vendor.name"),
        (("po", "purchase order"), F.coalesce("po_number", F.lit("No purchase-order reference was extracted.")), "invoice.po_number"),
        (("outstanding", "balance"), money("outstanding_amount"), "invoice.outstanding_amount"),
        (("total", "amount"), money("grand_total"), "invoice.grand_total"),
        (("status", "stage"), F.col("status"), "invoice.status"),
    ]
    answer, evidence = F.when(F.lit(False), ""), F.when(F.lit(False), "")
    for words, value, path in routes:
        answer, evidence = answer.when(has(*words), value), evidence.when(has(*words), path)
    x = questions.join(invoices, "invoice_id").join(vendors.select("tenant_id", "vendor_id", "name", "gstin"), ["tenant_id", "vendor_id"], "left")
    return x.select("question_id", "invoice_id", answer.otherwise("Not available in the invoice evidence.").alias("answer"), evidence.otherwise("invoice_json").alias("evidence"))
