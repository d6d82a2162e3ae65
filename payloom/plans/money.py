"""Queries over invoices, vendors, taxes and payments."""

from __future__ import annotations

from payloom.operators import marts as M
from payloom.operators import readmodels as R
from payloom.plans.register import query
from payloom.sources import views as V
from payloom.sources.views import AS_OF, NOW, with_views

_OPEN = "status not in ('paid', 'rejected', 'duplicate')"
_D = f"date '{AS_OF}'"


@query(with_views("invoices", f""", dim(bucket_no, bucket) as (values (1, 'Current'), (2, '1-30 Days'), (3, '31-60 Days'), (4, '61-90 Days'), (5, '90+ Days')),
x as (select case when d = 0 then 1 when d <= 30 then 2 when d <= 60 then 3 when d <= 90 then 4 else 5 end as bucket_no, outstanding_amount from (select greatest(0, {_D} - due_date) as d, outstanding_amount from invoices where {_OPEN} and outstanding_amount > 0))
select dim.bucket_no, bucket, cast(coalesce(sum(outstanding_amount), 0) as decimal(18,2)) as amount, count(outstanding_amount) as invoices from dim left join x on dim.bucket_no = x.bucket_no group by 1, 2"""))
def ap_aging(spark, d):
    return M.aging(V.invoices(spark, d))


@query(with_views("invoices invoice_taxes", f""" select count(*) as total_invoices, count(*) filter (status = 'review_required') as review_required, count(*) filter (status = 'approved') as approved, count(*) filter (status = 'awaiting_payment') as awaiting_payment,
count(*) filter (status = 'paid') as paid, count(*) filter (status = 'rejected') as rejected, count(*) filter (status = 'duplicate') as duplicate, count(*) filter (status = 'on_hold') as on_hold, count(*) filter (risk_level = 'high' and {_OPEN}) as high_risk,
cast(coalesce(sum(outstanding_amount) filter ({_OPEN}), 0) as decimal(18,2)) as outstanding, cast(coalesce(sum(outstanding_amount) filter ({_OPEN} and due_date < {_D}), 0) as decimal(18,2)) as overdue,
cast(coalesce(sum(outstanding_amount) filter ({_OPEN} and due_date >= {_D} and due_date <= cast(date_trunc('week', {_D}) as date) + 6), 0) as decimal(18,2)) as due_this_week, round(avg(confidence), 3) as avg_confidence,
(select cast(coalesce(sum(amount), 0) as decimal(18,2)) from invoice_taxes where invoice_id in (select invoice_id from invoices)) as total_tax from invoices"""))
def ap_dashboard(spark, d):
    return M.dashboard(V.invoices(spark, d), V.invoice_taxes(spark, d))


@query(with_views("ingested", f""" select count(*) as total, count(*) filter (status = 'completed') as completed, count(*) filter (status = 'failed') as failed, round(avg(confidence) filter (status = 'completed'), 3) as avg_confidence,
round(avg(processing_ms) filter (status = 'completed'), 2) as avg_processing_ms, count(*) filter (created_at >= date_trunc('day', timestamp '{NOW}')) as today, count(*) filter (created_at >= date_trunc('week', timestamp '{NOW}')) as this_week,
round(count(*) filter (status = 'completed' and source = 'vlm_fallback') / count(*) filter (status = 'completed'), 6) as vlm_rate, round(count(*) filter (status = 'completed' and source in ('vlm_fallback', 'local_vlm')) / count(*) filter (status = 'completed'), 6) as model_rate,
round(avg(cast(cost as double)) filter (status = 'completed'), 6) as avg_cost from ingested"""))
def platform_summary(spark, d):
    return M.platform_summary(V.ingested(spark, d))


@query(with_views("ingested", """ select vendor_name, currency, count(*) as documents, cast(sum(grand_total) as decimal(18,2)) as total_spend, round(avg(confidence), 6) as avg_confidence from ingested
where status = 'completed' and coalesce(vendor_name, '') <> '' group by 1, 2 order by total_spend desc nulls first, vendor_name, currency limit 20"""))
def vendor_spend(spark, d):
    return M.vendor_spend(V.ingested(spark, d))


@query(with_views("ingested", f""" select cast(created_at as date) as day, count(*) as documents, round(avg(coalesce(confidence, 0)), 6) as avg_confidence, round(avg(coalesce(processing_ms, 0)), 4) as avg_processing_ms
from ingested where created_at >= timestamp '{NOW}' - interval 19 day group by 1"""))
def ingest_trend(spark, d):
    return M.ingest_trend(V.ingested(spark, d), days=20)


@query(with_views("invoices", """ select cast(created_at as date) as day, count(*) as invoices, cast(sum(grand_total) as decimal(18,2)) as total, round(avg(confidence), 3) as avg_confidence from invoices group by 1"""))
def invoice_trend(spark, d):
    return M.invoice_trend(V.invoices(spark, d))


@query(with_views("invoices", """, day as (select cast(created_at as date) as day, count(*) as invoices, round(avg(confidence), 3) as avg_confidence from invoices group by 1)
select strftime(day, '%Y-%m') as month, cast(sum(invoices) as bigint) as invoices, round(avg(avg_confidence), 8) as avg_confidence from day group by 1"""))
def monthly_rollup(spark, d):
    return M.monthly_rollup(V.invoices(spark, d))


_VENDOR_LIST = """ select v.tenant_id, v.vendor_id, v.name, count(i.invoice_id) as invoice_count, cast(coalesce(sum(grand_total), 0) as decimal(18,2)) as total_spend, cast(coalesce(sum(outstanding_amount), 0) as decimal(18,2)) as outstanding,
round(coalesce(avg(confidence), 0), 6) as avg_confidence from vendors v left join invoices i on v.tenant_id = i.tenant_id and v.vendor_id = i.vendor_id {where} group by 1, 2, 3"""


@query(with_views("vendors invoices", _VENDOR_LIST.format(where="")))
def ap_vendor_spend(spark, d):
    return M.vendor_list(V.vendors(spark, d), V.invoices(spark, d))


@query(with_views("vendors invoices", _VENDOR_LIST.format(where="where v.name ilike '%00000012%' or v.gstin ilike '%00000012%'")))
def vendor_list(spark, d):
    return M.vendor_list(V.vendors(spark, d), V.invoices(spark, d), search="00000012")


@query(with_views("vendors invoices", """ select v.tenant_id, name, currency, count(*) as invoice_count, cast(sum(grand_total) as decimal(18,2)) as total_spend from invoices i join vendors v on v.tenant_id = i.tenant_id and v.vendor_id = i.vendor_id group by 1, 2, 3"""))
def spend_by_currency(spark, d):
    return M.spend_by_currency(V.vendors(spark, d), V.invoices(spark, d))


@query(with_views("vendors invoices", """ select v.vendor_id, name, cast(coalesce(sum(grand_total), 0) as decimal(18,2)) as total_spend from vendors v left join invoices i on v.tenant_id = i.tenant_id and v.vendor_id = i.vendor_id group by 1, 2 order by total_spend desc, vendor_id limit 6"""))
def top_vendors(spark, d):
    return M.top_vendors(V.vendors(spark, d), V.invoices(spark, d))


@query(with_views("invoices", """ select case when status in ('paid', 'awaiting_payment', 'review_required') then status else 'other' end as kind, count(*) as invoices from invoices group by 1"""))
def status_mix(spark, d):
    return M.status_mix(V.invoices(spark, d))


@query(with_views("invoices", """ select vendor_id, place, invoice_id, invoice_date, grand_total from (select *, cast(row_number() over (partition by tenant_id, vendor_id order by invoice_date desc nulls last, created_at desc, invoice_id) as integer) as place from invoices) where place <= 5"""))
def vendor_detail(spark, d):
    return R.vendor_detail(V.invoices(spark, d))


@query(with_views("invoices invoice_taxes", """, x as (select t.* from invoice_taxes t where invoice_id in (select invoice_id from invoices))
select tax_type, cast(sum(amount) as decimal(18,2)) as amount, count(distinct invoice_id) as invoices from x group by 1 union all select null, cast(coalesce(sum(amount), 0) as decimal(18,2)), count(distinct invoice_id) from x"""))
def gst_summary(spark, d):
    return M.gst_summary(V.invoices(spark, d), V.invoice_taxes(spark, d))


@query(with_views("invoice_taxes", """, x as (select invoice_id, coalesce(sum(amount) filter (tax_type = 'CGST_SGST'), 0) as both_, coalesce(sum(amount) filter (tax_type = 'IGST'), 0) as igst, coalesce(sum(amount) filter (tax_type = 'CESS'), 0) as cess from invoice_taxes group by 1),
y as (select *, cast((cast(both_ * 100 as bigint) + 1) // 2 as decimal(18,2)) / 100 as half from x)
select invoice_id, cast(half as decimal(18,2)) as cgst, cast(both_ - cast(half as decimal(18,2)) as decimal(18,2)) as sgst, cast(igst as decimal(18,2)) as igst, cast(cess as decimal(18,2)) as cess from y"""))
def tax_pivot(spark, d):
    return M.tax_pivot(V.invoice_taxes(spark, d))


@query(with_views("invoices payments", """ select i.invoice_id, grand_total, cast(coalesce(sum(amount) filter (p.status = 'confirmed'), 0) as decimal(18,2)) as paid, cast(greatest(0, grand_total - coalesce(sum(amount) filter (p.status = 'confirmed'), 0)) as decimal(18,2)) as outstanding
from invoices i left join payments p on i.invoice_id = p.invoice_id group by 1, 2"""))
def outstanding(spark, d):
    return M.outstanding(V.invoices(spark, d), V.payments(spark, d))


@query(with_views("purchase_order_items", """, x as (select po_id, cast(quantity * unit_price as decimal(18,2)) as line, tax_rate from purchase_order_items), y as (select po_id, line, cast(line * coalesce(tax_rate, 0) * cast(0.01 as decimal(3,2)) as decimal(18,2)) as tax from x)
select po_id, cast(sum(line) as decimal(18,2)) as subtotal, cast(sum(tax) as decimal(18,2)) as tax_total, cast(sum(line) + sum(tax) as decimal(18,2)) as total from y group by 1"""))
def po_totals(spark, d):
    return M.po_totals(V.purchase_order_items(spark, d))


@query(with_views("ingested", """, x as (select * from ingested where status = 'completed' and vendor_name ilike '%dor 1%' and created_at >= date '2024-01-05' and created_at < date '2024-01-20' + 1), n as (select count(*) as matches from x)
select document_id, vendor_name, status, grand_total, matches, cast(ceil(matches / 20) as bigint) as pages from (select * from x order by created_at desc, document_id limit 20 offset 20), n"""))
def document_list(spark, d):
    return R.document_list(V.ingested(spark, d), "completed", "dor 1", "2024-01-05", "2024-01-20", page=2)


@query(with_views("invoices", f""" select invoice_id, grand_total from invoices where status = 'awaiting_payment' and risk_level = 'high' and due_date < {_D} and outstanding_amount > 0 and invoice_date >= date '1996-01-01' and invoice_date <= date '2000-12-31' and grand_total >= 1000 and grand_total <= 300000"""))
def invoice_list(spark, d):
    return R.invoice_filter(V.invoices(spark, d), status="awaiting_payment", risk="high", overdue=True, start="1996-01-01", end="2000-12-31", low=1000, high=300000).select("invoice_id", "grand_total")


@query(with_views("invoices vendors", """ select invoice_id from invoices i left join vendors v on v.tenant_id = i.tenant_id and v.vendor_id = i.vendor_id where invoice_number ilike '%-77%' or po_number ilike '%-77%' or status ilike '%-77%' or name ilike '%-77%' or lower(gstin) like '%77%'"""))
def invoice_search(spark, d):
    return R.invoice_search(V.invoices(spark, d), V.vendors(spark, d), "-77").select("invoice_id")


@query(with_views("invoices vendors", """ select invoice_id from invoices i left join vendors v on v.tenant_id = i.tenant_id and v.vendor_id = i.vendor_id where name ilike '%GSTIN 05AAAPL%' or lower(gstin) like '%05aaapl%'"""))
def gstin_search(spark, d):
    return R.invoice_search(V.invoices(spark, d), V.vendors(spark, d), "GSTIN 05AAAPL").select("invoice_id")


@query(with_views("invoices", """ select invoice_id, risk_level, risk_score from invoices where risk_level in ('medium', 'high')"""))
def risk_queue(spark, d):
    return R.risk_queue(V.invoices(spark, d)).select("invoice_id", "risk_level", "risk_score")


@query(with_views("invoices vendors", f""" select invoice_id, invoice_number, name as vendor_name, due_date, outstanding_amount, currency, coalesce(due_date < {_D}, false) as overdue from invoices i left join vendors v on v.tenant_id = i.tenant_id and v.vendor_id = i.vendor_id where outstanding_amount > 0"""))
def payments_due(spark, d):
    return R.payments_due(V.invoices(spark, d), V.vendors(spark, d))


@query(with_views("invoices vendors invoice_items invoice_taxes payments", """, a as (select invoice_id, count(*) as n, string_agg(description, '|' order by pos) as descriptions from invoice_items group by 1), b as (select invoice_id, count(*) as n from invoice_taxes group by 1), c as (select invoice_id, count(*) as n from payments group by 1)
select i.invoice_id, name as vendor_name, cast(coalesce(a.n, 0) as integer) as n_items, descriptions, cast(coalesce(b.n, 0) as integer) as n_taxes, cast(coalesce(c.n, 0) as integer) as n_payments from invoices i left join vendors v on v.tenant_id = i.tenant_id and v.vendor_id = i.vendor_id left join a on i.invoice_id = a.invoice_id left join b on i.invoice_id = b.invoice_id left join c on i.invoice_id = c.invoice_id"""))
def invoice_bundle(spark, d):
    return R.bundle_digest(R.bundle(V.invoices(spark, d), V.invoice_items(spark, d), V.invoice_taxes(spark, d), V.payments(spark, d), V.vendors(spark, d)))


@query(with_views("invoices vendors", """ select invoice_number, coalesce(name, '') as vendor, cast(invoice_date as varchar) as invoice_date, cast(due_date as varchar) as due_date, currency, cast(grand_total as varchar) as total, cast(outstanding_amount as varchar) as outstanding, status, risk_level
from invoices i left join vendors v on v.tenant_id = i.tenant_id and v.vendor_id = i.vendor_id where status = 'on_hold'"""))
def export_invoices(spark, d):
    return R.export_invoices(V.invoices(spark, d), V.vendors(spark, d), status="on_hold")


@query(with_views("invoices invoice_items", """ select i.invoice_id, invoice_number, coalesce(pos, 0) as pos, coalesce(description, '') as description, quantity, line_total, confidence from invoices i left join invoice_items x on i.invoice_id = x.invoice_id"""))
def export_lines(spark, d):
    return R.export_lines(V.invoice_items(spark, d), V.invoices(spark, d))


@query(with_views("invoices vendors", """, q as (select conv_id * 1000 + turn as question_id, conv_id as invoice_id, ['What is the GSTIN?', 'When is it due?', 'Which supplier is it?', 'PO number?', 'How much balance is left?', 'Grand sum and tax amount', 'In which stage is it?', 'Why?'][cast(turn % 8 + 1 as integer)] as question from conversations)
select question_id, q.invoice_id, case cast((question_id % 1000) % 8 as integer) when 0 then coalesce(gstin, 'GSTIN is not available in the invoice evidence.') when 1 then coalesce(cast(due_date as varchar), 'x') when 2 then name when 3 then coalesce(po_number, 'No purchase-order reference was extracted.')
when 4 then case when currency = 'INR' then '₹' else currency || ' ' end || format('{:,.2f}', cast(outstanding_amount as double)) when 5 then case when currency = 'INR' then '₹' else currency || ' ' end || format('{:,.2f}', cast(grand_total as double)) when 6 then status else 'Not available in the invoice evidence.' end as answer,
['invoice.vendor.gstin', 'invoice.due_date', 'invoice.vendor.name', 'invoice.po_number', 'invoice.outstanding_amount', 'invoice.grand_total', 'invoice.status', 'invoice_json'][cast((question_id % 1000) % 8 + 1 as integer)] as evidence
from q join invoices i on i.invoice_id = q.invoice_id left join vendors v on v.tenant_id = i.tenant_id and v.vendor_id = i.vendor_id"""))
def assistant_answers(spark, d):
    from pyspark.sql import functions as F

    asked = ["What is the GSTIN?", "When is it due?", "Which supplier is it?", "PO number?", "How much balance is left?", "Grand sum and tax amount", "In which stage is it?", "Why?"]
    q = V.table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("question_id"), F.col("conv_id").alias("invoice_id"), F.element_at(F.array(*map(F.lit, asked)), (F.col("turn") % 8 + 1).cast("int")).alias("question"))
    return R.answers(q, V.invoices(spark, d), V.vendors(spark, d))
