"""Dashboards, aging, spend, tax and trend aggregates over the accounts-payable entities.

Each takes DataFrames and returns one; conditional aggregates are single passes, small dimensions are literals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from payloom.sources.views import AS_OF, CLOSED, MONEY, NOW

BUCKETS = ("Current", "1-30 Days", "31-60 Days", "61-90 Days", "90+ Days")


def _open(as_of: str = AS_OF):
    return ~F.col("status").isin(*CLOSED)


def _days_late(as_of: str):
    return F.greatest(F.lit(0), F.datediff(F.lit(as_of).cast("date"), F.coalesce("due_date", F.lit(as_of).cast("date"))))


def aging(invoices: DataFrame, as_of: str = AS_OF) -> DataFrame:
    """A-6: open amounts by days past due; all five buckets appear, in order."""
    days = _days_late(as_of)
    number = F.when(days == 0, 1).when(days <= 30, 2).when(days <= 60, 3).when(days <= 90, 4).otherwise(5)
    found = invoices.where(_open() & (F.col("outstanding_amount") > 0)).groupBy(number.alias("bucket_no")).agg(F.sum("outstanding_amount").alias("s"), F.count("*").alias("c"))
    names = F.array(*[F.struct(F.lit(i + 1).alias("bucket_no"), F.lit(b).alias("bucket")) for i, b in enumerate(BUCKETS)])
    dim = invoices.sparkSession.range(1).select(F.inline(names))
    return dim.join(found, "bucket_no", "left").select("bucket_no", "bucket", F.coalesce("s", F.lit(0)).cast(MONEY).alias("amount"), F.coalesce("c", F.lit(0)).alias("invoices"))


def dashboard(invoices: DataFrame, taxes: DataFrame, as_of: str = AS_OF) -> DataFrame:
    """A-5: counters by status and risk, balances and the tax total. The week ends on the coming Sunday."""
    day = F.lit(as_of).cast("date")
    week_end = F.date_add(F.date_trunc("week", day).cast("date"), 6)
    owed = F.when(_open(), F.col("outstanding_amount"))
    status = lambda s: F.count_if(F.col("status") == s)
    one = invoices.agg(
        F.count("*").alias("total_invoices"), *[status(s).alias(s) for s in ("review_required", "approved", "awaiting_payment", "paid", "rejected", "duplicate", "on_hold")],
        F.count_if((F.col("risk_level") == "high") & _open()).alias("high_risk"), F.coalesce(F.sum(owed), F.lit(0)).cast(MONEY).alias("outstanding"),
        F.coalesce(F.sum(F.when(F.col("due_date") < day, owed)), F.lit(0)).cast(MONEY).alias("overdue"), F.coalesce(F.sum(F.when((F.col("due_date") >= day) & (F.col("due_date") <= week_end), owed)), F.lit(0)).cast(MONEY).alias("due_this_week"),
        F.round(F.avg("confidence"), 3).alias("avg_confidence"),
    )
    tax = taxes.join(invoices.select("invoice_id"), "invoice_id").agg(F.coalesce(F.sum("amount"), F.lit(0)).cast(MONEY).alias("total_tax"))
    return one.crossJoin(F.broadcast(tax))  # one row and one row


def platform_summary(docs: DataFrame, now: str = NOW) -> DataFrame:
    """A-1, A-2: one pass over ingested documents; the model's share counts one source of two (the quirk is kept) and both."""
    done, t = F.col("status") == "completed", F.lit(now).cast("timestamp_ntz")
    share = lambda c: F.round(F.coalesce(F.try_divide(F.count_if(done & c), F.count_if(done)), F.lit(0.0)), 6)
    return docs.agg(
        F.count("*").alias("total"), F.count_if(done).alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"), F.round(F.avg(F.when(done, F.col("confidence"))), 3).alias("avg_confidence"), F.round(F.avg(F.when(done, F.col("processing_ms"))), 2).alias("avg_processing_ms"),
        F.count_if(F.col("created_at") >= F.date_trunc("day", t)).alias("today"), F.count_if(F.col("created_at") >= F.date_trunc("week", t)).alias("this_week"), share(F.col("source") == "vlm_fallback").alias("vlm_rate"),
        share(F.col("source").isin("vlm_fallback", "local_vlm")).alias("model_rate"), F.round(F.avg(F.when(done, F.col("cost").cast("double"))), 6).alias("avg_cost"),
    )


def vendor_spend(docs: DataFrame, limit: int = 20) -> DataFrame:
    """A-3: completed documents by vendor name and currency; an all-null sum ranks first."""
    x = docs.where((F.col("status") == "completed") & (F.coalesce("vendor_name", F.lit("")) != ""))
    x = x.groupBy("vendor_name", "currency").agg(F.count("*").alias("documents"), F.sum("grand_total").cast(MONEY).alias("total_spend"), F.round(F.avg("confidence"), 6).alias("avg_confidence"))
    return x.orderBy(F.desc_nulls_first("total_spend"), "vendor_name", "currency").limit(limit)


def ingest_trend(docs: DataFrame, days: int = 30, now: str = NOW) -> DataFrame:
    """A-4: by day; nulls count as 0 before averaging, and the first day is partial (the cutoff is a moment)."""
    since = F.lit(now).cast("timestamp_ntz") - F.expr(f"interval {max(1, min(365, days)) - 1} days")
    x = docs.where(F.col("created_at") >= since).groupBy(F.to_date("created_at").alias("day"))
    return x.agg(F.count("*").alias("documents"), F.round(F.avg(F.coalesce("confidence", F.lit(0.0))), 6).alias("avg_confidence"), F.round(F.avg(F.coalesce("processing_ms", F.lit(0.0))), 4).alias("avg_processing_ms"))


def invoice_trend(invoices: DataFrame) -> DataFrame:
    """A-10: by day of creation."""
    return invoices.groupBy(F.to_date("created_at").alias("day")).agg(F.count("*").alias("invoices"), F.sum("grand_total").cast(MONEY).alias("total"), F.round(F.avg("confidence"), 3).alias("avg_confidence"))


def monthly_rollup(invoices: DataFrame) -> DataFrame:
    """A-18: the daily trend by month; confidences are the plain mean of daily means."""
    day = invoice_trend(invoices)
    return day.groupBy(F.date_format("day", "yyyy-MM").alias("month")).agg(F.sum("invoices").alias("invoices"), F.round(F.avg("avg_confidence"), 8).alias("avg_confidence"))


def vendor_list(vendors: DataFrame, invoices: DataFrame, search: str | None = None) -> DataFrame:
    """A-9, A-11, J-4, P-8: every vendor with its invoices' count, amount and balance (0 without any)."""
    if search:
        vendors = vendors.where(F.col("name").ilike(f"%{search}%") | F.col("gstin").ilike(f"%{search}%"))
    m = invoices.groupBy("tenant_id", "vendor_id").agg(F.count("*").alias("n"), F.sum("grand_total").alias("a"), F.sum("outstanding_amount").alias("o"), F.avg("confidence").alias("c"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return vendors.join(m, ["tenant_id", "vendor_id"], "left").select("tenant_id", "vendor_id", "name", zero("n").alias("invoice_count"), zero("a").cast(MONEY).alias("total_spend"), zero("o").cast(MONEY).alias("outstanding"), F.round(zero("c"), 6).alias("avg_confidence"))


def spend_by_currency(vendors: DataFrame, invoices: DataFrame) -> DataFrame:
    """A-9 without mixing currencies."""
    return invoices.join(vendors.select("tenant_id", "vendor_id", "name"), ["tenant_id", "vendor_id"]).groupBy("tenant_id", "name", "currency").agg(F.count("*").alias("invoice_count"), F.sum("grand_total").cast(MONEY).alias("total_spend"))


def top_vendors(vendors: DataFrame, invoices: DataFrame, k: int = 6) -> DataFrame:
    """A-19: the vendors with the highest spend."""
    return vendor_list(vendors, invoices).select("vendor_id", "name", "total_spend").orderBy(F.desc("total_spend"), "vendor_id").limit(k)


def status_mix(invoices: DataFrame) -> DataFrame:
    """A-19: shares of the status chart, where all but three statuses are 'other'."""
    kind = F.when(F.col("status").isin("paid", "awaiting_payment", "review_required"), F.col("status")).otherwise("other")
    return invoices.groupBy(kind.alias("kind")).agg(F.count("*").alias("invoices"))


def gst_summary(invoices: DataFrame, taxes: DataFrame) -> DataFrame:
    """A-7: tax by type; the total and the number of invoices that have tax are the last row, of type null."""
    x = taxes.join(invoices.select("invoice_id"), "invoice_id")
    by_type = x.groupBy("tax_type").agg(F.sum("amount").cast(MONEY).alias("amount"), F.countDistinct("invoice_id").alias("invoices"))
    return by_type.unionByName(x.agg(F.lit(None).cast("string").alias("tax_type"), F.coalesce(F.sum("amount"), F.lit(0)).cast(MONEY).alias("amount"), F.countDistinct("invoice_id").alias("invoices")))


def tax_pivot(taxes: DataFrame) -> DataFrame:
    """A-8, S-33: CGST, SGST and IGST of an invoice; a combined amount is split so that both halves sum to it."""
    total = lambda *kinds: F.coalesce(F.sum(F.when(F.col("tax_type").isin(*kinds), F.col("amount"))), F.lit(0)).cast(MONEY)
    x = taxes.groupBy("invoice_id").agg(total("CGST").alias("c"), total("SGST").alias("s"), total("CGST_SGST").alias("both"), total("IGST").alias("igst"), total("CESS").alias("cess"))
    half = (F.col("both") / 2).cast(MONEY)
    return x.select("invoice_id", (F.col("c") + half).cast(MONEY).alias("cgst"), (F.col("s") + F.col("both") - half).cast(MONEY).alias("sgst"), "igst", "cess")


def outstanding(invoices: DataFrame, payments: DataFrame) -> DataFrame:
    """A-12: the total less confirmed payments, 0 at least."""
    paid = payments.where("status = 'confirmed'").groupBy("invoice_id").agg(F.sum("amount").alias("paid"))
    left = F.col("grand_total") - F.coalesce("paid", F.lit(0))
    return invoices.join(paid, "invoice_id", "left").select("invoice_id", "grand_total", F.coalesce("paid", F.lit(0)).cast(MONEY).alias("paid"), F.greatest(left, F.lit(0)).cast(MONEY).alias("outstanding"))


def po_totals(items: DataFrame) -> DataFrame:
    """A-16: the subtotal of an order's lines, each its total or quantity times price, and the tax on them."""
    stated = F.col("line_total") if "line_total" in items.columns else F.lit(None).cast(MONEY)
    line = F.coalesce(stated, (F.col("quantity") * F.col("unit_price")).cast(MONEY))
    x = items.withColumn("line", line).withColumn("tax", (F.col("line") * F.coalesce("tax_rate", F.lit(0)) / 100).cast(MONEY))
    return x.groupBy("po_id").agg(F.sum("line").cast(MONEY).alias("subtotal"), F.sum("tax").cast(MONEY).alias("tax_total"), (F.sum("line") + F.sum("tax")).cast(MONEY).alias("total"))
