"""Queries over duplicates, purchase orders, validation, risk and workflow."""

from __future__ import annotations

from pyspark.sql import functions as F

from payloom.functions import scalar as S
from payloom.operators import matching as X
from payloom.operators import rules as R
from payloom.plans.register import query
from payloom.sources import views as V
from payloom.sources.views import AS_OF, with_views

#: A GSTIN takes part in a fingerprint; numbers of a vendor recur every seven orders, and totals are coarse so that some agree.
_PRINTS = """, fp as (select i.*, v.gstin, regexp_replace(lower(invoice_number), '[^a-z0-9]+', '', 'g') as number_key, case when v.gstin is not null and invoice_date is not null and grand_total is not null
then sha256(upper(v.gstin) || '|' || regexp_replace(lower(invoice_number), '[^a-z0-9]+', '', 'g') || '|' || cast(invoice_date as varchar) || '|' || cast(grand_total as varchar)) end as fingerprint from (select * replace (date '2000-01-01' as invoice_date, cast(floor(grand_total / 100000) * 100000 as decimal(18,2)) as grand_total) from invoices) i
left join vendors v on v.tenant_id = i.tenant_id and v.vendor_id = i.vendor_id)"""


def _printed(spark, d):
    coarse = V.invoices(spark, d).withColumn("invoice_date", F.lit("2000-01-01").cast("date")).withColumn("grand_total", (F.floor(F.col("grand_total") / 100000) * 100000).cast(V.MONEY))
    return X.with_fingerprint(coarse, V.vendors(spark, d))


@query(with_views("invoices vendors", _PRINTS + " select invoice_id, fingerprint, number_key from fp"))
def fingerprints(spark, d):
    return _printed(spark, d).select("invoice_id", "fingerprint", "number_key")


_PRIOR = "order by created_at, invoice_id rows between unbounded preceding and 1 preceding"


@query(with_views("invoices vendors", _PRINTS + f""", w as (select *, case when status <> 'rejected' then invoice_id end as valid from fp),
x as (select *, case when fingerprint is not null then first_value(valid ignore nulls) over (partition by tenant_id, fingerprint {_PRIOR}) end as by_print, first_value(valid ignore nulls) over (partition by tenant_id, vendor_id, number_key {_PRIOR}) as any_,
first_value(case when fingerprint is null then valid end ignore nulls) over (partition by tenant_id, vendor_id, number_key {_PRIOR}) as bare from w),
y as (select *, case when number_key <> '' then case when fingerprint is null then any_ else bare end end as by_number from x)
select invoice_id, coalesce(by_print, by_number) as duplicate_of, case when by_print is not null then 'sha256_fingerprint' when by_number is not null then 'vendor_number' end as match_type, case when coalesce(by_print, by_number) is null and number_key <> '' then any_ end as repeat_of from y"""))
def duplicates(spark, d):
    return X.duplicates(_printed(spark, d)).select("invoice_id", "duplicate_of", "match_type", "repeat_of")


_COUNTED = "case when status not in ('rejected', 'duplicate') and grand_total > 0 then cast(grand_total as double) end"


@query(with_views("invoices", f""", x as (select *, round(avg({_COUNTED}) over (partition by tenant_id, vendor_id {_PRIOR}), 6) as historical_average from invoices)
select invoice_id, historical_average, coalesce(cast(grand_total as double) >= 3 * historical_average and cast(grand_total as double) - historical_average >= 1000, false) as amount_anomaly from x"""))
def amount_anomalies(spark, d):
    return X.anomalies(V.invoices(spark, d)).select("invoice_id", "historical_average", "amount_anomaly")


@query(with_views("invoices", f""", w as (select *, {_COUNTED} as counted from invoices), x as (select *, (sum(counted) over p - coalesce(counted, 0)) / nullif(count(counted) over p - (counted is not null)::int, 0) as a from w window p as (partition by tenant_id, vendor_id)), y as (select *, round(a, 6) as h from x)
select invoice_id, cast(floor(h) as bigint) as average, coalesce(cast(grand_total as double) >= 3 * h and cast(grand_total as double) - h >= 1000, false) as amount_anomaly from y"""))
def amount_anomalies_again(spark, d):
    return X.anomalies(V.invoices(spark, d), reproject=True).select("invoice_id", F.floor("historical_average").alias("average"), "amount_anomaly")


_RECORDS = """, r as (select o_orderkey as record_id, 't' || (o_custkey % 4) as tenant_id, case when o_orderkey % 3 = 0 then 'customer ' || lpad(cast(o_custkey as varchar), 9, '0') when o_orderkey % 3 = 1 then 'Unknown ' || o_custkey else upper(v.name) end as name,
case when o_orderkey % 4 = 0 then lower(v.gstin) when o_orderkey % 4 = 1 then '99XXXXX0000X1Z0' end as gstin from orders join vendors v on v.vendor_id = o_custkey)"""


def _records(spark, d):
    o, v = V.table(spark, d, "orders"), V.vendors(spark, d).select("vendor_id", "name", "gstin")
    k = F.col("o_orderkey") % 3
    name = F.when(k == 0, F.concat(F.lit("customer "), F.lpad(F.col("o_custkey").cast("string"), 9, "0"))).when(k == 1, F.concat(F.lit("Unknown "), F.col("o_custkey").cast("string"))).otherwise(F.upper("name"))
    tax = F.when(F.col("o_orderkey") % 4 == 0, F.lower("gstin")).when(F.col("o_orderkey") % 4 == 1, "99XXXXX0000X1Z0")
    return o.join(v, F.col("o_custkey") == F.col("vendor_id")).select(F.col("o_orderkey").alias("record_id"), F.concat(F.lit("t"), (F.col("o_custkey") % 4).cast("string")).alias("tenant_id"), name.alias("name"), tax.alias("gstin"))


@query(with_views("vendors", _RECORDS + """, k as (select *, regexp_replace(lower(name), '[^a-z0-9]+', '', 'g') as key from r),
g as (select tenant_id, upper(gstin) as g, min(vendor_id) as by_gstin from vendors where gstin is not null group by 1, 2), n as (select tenant_id, normalized_name as key, min(vendor_id) as by_name, min_by(gstin, vendor_id) as known from vendors where normalized_name <> '' group by 1, 2)
select record_id, coalesce(by_gstin, by_name) as vendor_id, case when by_gstin is not null then 'gstin' when by_name is not null then 'name' else 'new' end as resolved_by, coalesce(by_gstin is null and by_name is not null and upper(gstin) <> upper(known), false) as gstin_mismatch
from k left join g on g.tenant_id = k.tenant_id and g.g = upper(k.gstin) left join n on n.tenant_id = k.tenant_id and n.key = k.key"""))
def vendor_resolve(spark, d):
    return X.resolve_vendors(_records(spark, d), V.vendors(spark, d))


@query("""with r as (select 't' || (o_custkey % 4) as tenant_id, o_custkey as vendor_id, o_orderdate as made, o_orderkey as id, case when o_orderkey % 2 = 0 then 'Name ' || o_orderkey end as name, case when o_orderkey % 5 = 0 then 'm' || o_orderkey || '@x.example' end as email, case when o_orderkey % 3 = 0 then 'B' || o_orderkey end as bank from orders)
select tenant_id, vendor_id, last(name order by made, id) filter (where name is not null) as name, last(email order by made, id) filter (where email is not null) as email, first(bank order by made, id) filter (where bank is not null) as bank_account from r group by 1, 2""")
def vendor_attributes(spark, d):
    o, k = V.table(spark, d, "orders"), F.col("o_orderkey")
    text = lambda n, a, b="": F.when(k % n == 0, F.concat(F.lit(a), k.cast("string"), F.lit(b)))
    return X.vendor_attributes(o.select(F.concat(F.lit("t"), (F.col("o_custkey") % 4).cast("string")).alias("tenant_id"), F.col("o_custkey").alias("vendor_id"), F.col("o_orderdate").alias("created_at"), k.alias("record_id"), text(2, "Name ").alias("name"), text(5, "m", "@x.example").alias("email"), text(3, "B").alias("bank_account")))


_PLACED = """, ii as (select *, regexp_replace(lower(description), '[^a-z0-9]+', '', 'g') as key, row_number() over (partition by invoice_id, regexp_replace(lower(description), '[^a-z0-9]+', '', 'g') order by pos) as place from invoice_items),
pp as (select *, regexp_replace(lower(description), '[^a-z0-9]+', '', 'g') as key, row_number() over (partition by po_id, regexp_replace(lower(description), '[^a-z0-9]+', '', 'g') order by pos) as place from purchase_order_items),
known as (select i.*, p.po_id, p.vendor_id as po_vendor, p.currency as po_currency, p.total as po_total from invoices i left join purchase_orders p on p.tenant_id = i.tenant_id and lower(p.number) = lower(i.po_number)),
a as (select ii.*, po_id from ii join known on known.invoice_id = ii.invoice_id where po_id is not null), b as (select pp.*, invoice_id from pp join known on known.po_id = pp.po_id),
pair as (select coalesce(a.invoice_id, b.invoice_id) as invoice_id, a.pos as item_pos, b.pos as po_pos, a.quantity as q, b.quantity as po_q, a.unit_price as price, b.unit_price as po_price, a.gst_rate as rate, b.tax_rate as po_rate from a full join b on a.invoice_id = b.invoice_id and a.key = b.key and a.place = b.place)"""
_PO_VIEWS = "invoices invoice_items purchase_orders purchase_order_items goods_receipt_items"


@query(with_views(_PO_VIEWS, _PLACED + " select invoice_id, item_pos, po_pos from pair"))
def po_pairing(spark, d):
    i, p = V.invoices(spark, d), V.purchase_orders(spark, d)
    matched = i.withColumn("k", F.lower("po_number")).join(p.select("tenant_id", F.lower("number").alias("k"), "po_id"), ["tenant_id", "k"]).select("invoice_id", "po_id")
    return X.pairing(V.invoice_items(spark, d), V.purchase_order_items(spark, d), matched).select("invoice_id", "item_pos", "po_pos")


@query(with_views(_PO_VIEWS, """ select po_id, pos, cast(sum(quantity_received) as decimal(18,4)) as received from goods_receipt_items group by 1, 2"""))
def receipt_totals(spark, d):
    return V.goods_receipt_items(spark, d).groupBy("po_id", "pos").agg(F.sum("quantity_received").cast(V.QUANTITY).alias("received"))


_MATCH = _PLACED + """, lines as (select invoice_id, bool_or(po_pos is null) as not_on_po, coalesce(bool_or(q > po_q), false) as over_, coalesce(bool_or(q < po_q), false) as under_, coalesce(bool_or(abs(price - po_price) > 0.01), false) as price_differs, coalesce(bool_or(abs(rate - po_rate) > 0.01), false) as rate_differs, bool_or(item_pos is null) as unbilled from pair group by 1),
got as (select po_id, pos, sum(quantity_received) as received from goods_receipt_items group by 1, 2), over_po as (select p.po_id, bool_or(received > quantity + 0.0001) as x from purchase_order_items p join got on got.po_id = p.po_id and got.pos = p.pos group by 1),
over_got as (select a.invoice_id, bool_or(a.quantity > coalesce(received, 0) + 0.0001) as x from a join pp on pp.po_id = a.po_id and pp.key = a.key and pp.place = 1 left join got on got.po_id = pp.po_id and got.pos = pp.pos group by 1),
tx as (select invoice_id, cast(sum(amount) as decimal(18,2)) as tax from invoice_taxes group by 1),
m as (select k.*, tx.tax as tax_total, case when k.po_id is not null then cast(py.tax + case when k.po_id % 25 = 0 then 5 else 0 end as decimal(18,2)) end as po_tax, k.po_id in (select po_id from got) as three, coalesce(over_po.x, false) as received_over, coalesce(over_got.x, false) as billed_over, coalesce(not_on_po, false) as not_on_po, coalesce(over_, false) as over_, coalesce(under_, false) as under_, coalesce(price_differs, false) as price_differs, coalesce(rate_differs, false) as rate_differs, coalesce(unbilled, false) as unbilled
from known k left join lines on lines.invoice_id = k.invoice_id left join over_po on over_po.po_id = k.po_id left join over_got on over_got.invoice_id = k.invoice_id left join tx on tx.invoice_id = k.invoice_id left join tx py on py.invoice_id = k.po_id),
reasons as (select *, array_to_string(list_filter([case when coalesce(po_vendor <> vendor_id, false) then 'vendor' end, case when upper(coalesce(currency, 'INR')) <> upper(coalesce(po_currency, 'INR')) then 'currency' end, case when not_on_po then 'not_on_po' end, case when over_ then 'quantity' end, case when price_differs then 'price' end, case when rate_differs then 'tax_rate' end, case when abs(coalesce(tax_total, 0) - coalesce(po_tax, 0)) > 1 then 'tax_total' end,
case when three and received_over then 'received_over' end, case when three and billed_over then 'billed_over' end, case when grand_total - po_total > 1 then 'total_over' end], lambda r: r is not null), ',') as r from m),
verdicts as (select *, case when po_number is null then 'not_applicable' when po_id is null then 'mismatch' when r <> '' then 'mismatch' when grand_total - po_total < -1 or unbilled or under_ then 'partial' else 'matched' end as verdict from reasons)"""


@query(with_views(_PO_VIEWS + " invoice_taxes", _MATCH + """ select invoice_id, verdict, case when po_id is not null then case when three then 'three_way' else 'two_way' end end as mode, case when po_id is not null then r else '' end as reasons from verdicts"""))
def po_match(spark, d):
    tax = V.invoice_taxes(spark, d).groupBy("invoice_id").agg(F.sum("amount").cast(V.MONEY).alias("tax_total"))
    ordered = tax.select(F.col("invoice_id").alias("po_id"), (F.col("tax_total") + F.when(F.col("invoice_id") % 25 == 0, 5).otherwise(0)).cast(V.MONEY).alias("tax_total"))
    return X.match_orders(V.invoices(spark, d).join(tax, "invoice_id", "left"), V.invoice_items(spark, d), V.purchase_orders(spark, d).join(ordered, "po_id", "left"), V.purchase_order_items(spark, d), V.goods_receipt_items(spark, d))


def _payload(spark, d):
    i, v = V.invoices(spark, d), V.vendors(spark, d)
    line = V.invoice_items(spark, d).groupBy("invoice_id").agg(F.sum("line_total").cast(V.MONEY).alias("subtotal"), F.sum("discount").cast(V.MONEY).alias("discount_total"))
    tax = V.invoice_taxes(spark, d).groupBy("invoice_id").agg(F.sum("amount").cast(V.MONEY).alias("tax_sum"), F.bool_or(F.col("tax_type") == "IGST").alias("has_igst"), F.bool_or(F.col("tax_type") == "CGST_SGST").alias("has_split"))
    k = F.col("invoice_id")
    x = i.join(v.select("tenant_id", "vendor_id", F.col("name").alias("vendor_name"), "gstin"), ["tenant_id", "vendor_id"], "left").join(line, "invoice_id", "left").join(tax, "invoice_id", "left")
    total = F.when(k % 3 == 0, F.col("subtotal") - F.col("discount_total") + F.col("tax_sum")).when(k % 40 != 1, F.col("grand_total"))
    return x.select(
        k, F.when(k % 37 != 0, F.col("invoice_number")).alias("invoice_number"), "vendor_name", total.cast(V.MONEY).alias("grand_total"), F.when(k % 53 != 0, F.col("subtotal")).alias("subtotal"), F.col("subtotal").alias("items_total"), "discount_total", "tax_sum", F.when(k % 4 == 0, F.col("tax_sum") + 2).when(k % 4 == 1, F.col("tax_sum")).cast(V.MONEY).alias("tax_total"), F.lit(None).cast(V.MONEY).alias("shipping"),
        F.when(k % 41 == 0, F.date_add("invoice_date", 3000)).when(k % 47 != 0, F.col("invoice_date")).alias("invoice_date"), F.lit("some day").alias("date_text"), F.when(k % 7 == 0, F.when(k % 2 == 0, "soon").otherwise(" ")).alias("due_text"),
        F.when(k % 6 == 0, F.col("gstin")).when(k % 6 == 1, "29aagcb7383j1z4").alias("buyer_gstin"), F.when(k % 10 == 0, "abcde1234f").when(k % 10 == 1, "xx").alias("buyer_pan"), (k % 14 == 3).alias("has_cgst"), (k % 28 == 3).alias("has_sgst"), F.when(k % 43 == 0, F.date_add("invoice_date", -2)).when(k % 7 != 0, F.col("due_date")).alias("due_date"), "gstin", F.when(k % 3 == 0, F.concat(F.lit("abcde"), F.lpad((k % 10000).cast("string"), 4, "0"), F.lit("f"))).when(k % 3 == 1, "BADPAN").alias("pan"),
        "has_igst", "has_split", F.when(k % 9 == 0, "XYZ").otherwise(F.col("currency")).alias("currency"),
    )


_SUM36 = " + ".join(f"(p{i} // 36 + p{i} % 36)" for i in range(14))
_P = ", ".join(f"(strpos('{S.ALPHABET}', substr(gstin, {i + 1}, 1)) - 1) * {1 + i % 2} as p{i}" for i in range(14))
_PAYLOAD = f""", l as (select invoice_id, cast(sum(line_total) as decimal(18,2)) as subtotal, cast(sum(discount) as decimal(18,2)) as discount_total from invoice_items group by 1), t as (select invoice_id, cast(sum(amount) as decimal(18,2)) as tax_sum, bool_or(tax_type = 'IGST') as has_igst, bool_or(tax_type = 'CGST_SGST') as has_split from invoice_taxes group by 1),
pay as (select i.invoice_id, case when i.invoice_id % 37 <> 0 then invoice_number end as invoice_number, name as vendor_name, case when i.invoice_id % 3 = 0 then subtotal - discount_total + tax_sum when i.invoice_id % 40 <> 1 then grand_total end as grand_total, case when i.invoice_id % 53 <> 0 then subtotal end as subtotal, subtotal as items_total, discount_total, tax_sum,
case i.invoice_id % 4 when 0 then tax_sum + 2 when 1 then tax_sum end as tax_total, case when i.invoice_id % 41 = 0 then invoice_date + 3000 when i.invoice_id % 47 <> 0 then invoice_date end as invoice_date, case when i.invoice_id % 7 = 0 then case when i.invoice_id % 2 = 0 then 'soon' else ' ' end end as due_text, case i.invoice_id % 6 when 0 then gstin when 1 then '29AAGCB7383J1Z4' end as buyer_gstin, case i.invoice_id % 10 when 0 then 'ABCDE1234F' when 1 then 'XX' end as buyer_pan, i.invoice_id % 14 = 3 as has_cgst, i.invoice_id % 28 = 3 as has_sgst, case when i.invoice_id % 43 = 0 then invoice_date - 2 when i.invoice_id % 7 <> 0 then due_date end as due_date, gstin,
case i.invoice_id % 3 when 0 then 'ABCDE' || lpad(cast(i.invoice_id % 10000 as varchar), 4, '0') || 'F' when 1 then 'BADPAN' end as pan, has_igst, has_split, case when i.invoice_id % 9 = 0 then 'XYZ' else currency end as currency
from invoices i left join vendors v on v.tenant_id = i.tenant_id and v.vendor_id = i.vendor_id left join l on l.invoice_id = i.invoice_id left join t on t.invoice_id = i.invoice_id),
sums as (select *, {_P} from pay), checked as (select *, length(gstin) = 15 and (36 - ({_SUM36}) % 36) % 36 = strpos('{S.ALPHABET}', substr(gstin, 15, 1)) - 1 as sum_ok from sums),
e as (select *, case when gstin = '29AAGCB7383J1Z4' then true else sum_ok end as seller_ok, coalesce(has_split, false) or has_cgst or has_sgst as split, coalesce(has_igst, false) as igst, coalesce(subtotal, items_total) - discount_total + coalesce(tax_sum, tax_total, 0) as expected, date '{AS_OF}' + 365 as lim from checked),
flag as (select invoice_id, 'required_fields' as rule, 'error' as severity, not (coalesce(trim(invoice_number), '') = '' or coalesce(trim(vendor_name), '') = '' or grand_total is null) as passed from e
union all select invoice_id, 'arithmetic', 'warning', abs(grand_total - expected) <= 1 from e where grand_total is not null and coalesce(subtotal, items_total) is not null
union all select invoice_id, 'date_parseable', 'warning', false from e where invoice_date is null
union all select invoice_id, 'due_date_parseable', 'warning', false from e where due_date is null and due_text = 'soon'
union all select invoice_id, 'date_order', 'warning', invoice_date <= due_date from e where due_date is not null and invoice_date is not null
union all select invoice_id, 'date_future', 'warning', false from e where invoice_date > lim
union all select invoice_id, 'date_sanity', 'info', true from e where due_date is null and invoice_date <= lim and coalesce(due_text, '') <> 'soon'
union all select invoice_id, 'gstin', 'warning', sum_ok and regexp_matches(gstin, '{S.GSTIN}') and cast(substr(gstin, 1, 2) as integer) between 1 and 37 from e where gstin is not null
union all select invoice_id, 'pan', 'warning', regexp_matches(pan, '{S.PAN}') from e where pan is not null
union all select invoice_id, 'buyer_gstin', 'warning', buyer_gstin = '29AAGCB7383J1Z4' or (sum_ok and regexp_matches(gstin, '{S.GSTIN}') and cast(substr(gstin, 1, 2) as integer) between 1 and 37) from e where buyer_gstin is not null
union all select invoice_id, 'buyer_pan', 'warning', regexp_matches(buyer_pan, '{S.PAN}') from e where buyer_pan is not null
union all select invoice_id, 'gst_mode_consistency', case when ok then 'info' else 'warning' end, ok from (select invoice_id, not ((igst and split) or has_cgst <> has_sgst or coalesce(case when igst then substr(gstin, 1, 2) = substr(buyer_gstin, 1, 2) when split then substr(gstin, 1, 2) <> substr(buyer_gstin, 1, 2) end, false)) as ok from e)
union all select invoice_id, 'duplicate_invoice', 'info', true from e
union all select invoice_id, 'tax_total', 'warning', abs(tax_sum - tax_total) <= 1 from e where tax_sum is not null and tax_total is not null
union all select invoice_id, 'currency', 'warning', upper(coalesce(currency, '')) in {R.CURRENCIES!r} from e)"""
_PAY_VIEWS = "invoices vendors invoice_items invoice_taxes"


@query(with_views(_PAY_VIEWS, _PAYLOAD + " select invoice_id, rule, passed, severity from flag"))
def validations(spark, d):
    return R.validations(_payload(spark, d))


@query(with_views(_PAY_VIEWS, _PAYLOAD + """, p as (select invoice_id, round(least(1.0, 0.6 * 0.9 + 0.2 * 0.8 + 0.2 * (count(*) filter (passed) / count(*))), 3) as confidence from flag group by 1) select invoice_id, confidence from p"""))
def composite_confidence(spark, d):
    share = R.validations(_payload(spark, d)).groupBy("invoice_id").agg((F.count_if("passed") / F.count("*")).alias("share"))
    return share.select("invoice_id", S.composite_confidence(F.lit(0.9), F.lit(0.8), F.col("share")).alias("confidence"))


_RISK = _PAYLOAD + f""", x as (select invoice_id, invoice_id % 11 = 0 as is_duplicate, invoice_id % 13 = 0 as unknown_vendor, invoice_id % 17 = 0 as gstin_mismatch, invoice_id % 19 = 0 as bank_changed, case invoice_id % 5 when 0 then 'mismatch' when 1 then 'partial' else 'matched' end as verdict, invoice_id % 23 = 0 as anomaly, grand_total * 4 as grand_total from invoices),
f as (select invoice_id, sum(case rule when 'required_fields' then 25 when 'arithmetic' then 10 when 'tax_total' then 10 when 'gstin' then 10 when 'pan' then 10 else 5 end) as points from flag where not passed group by 1),
s as (select x.invoice_id, cast(least(100, is_duplicate::int * 40 + unknown_vendor::int * 15 + gstin_mismatch::int * 20 + bank_changed::int * 25 + (verdict in ('mismatch', 'partial'))::int * 15 + anomaly::int * 10 + (grand_total >= 1000000)::int * 10 + coalesce(points, 0)) as integer) as score from x left join f on f.invoice_id = x.invoice_id)"""


@query(with_views(_PAY_VIEWS, _RISK + " select invoice_id, score, case when score >= 50 then 'high' when score >= 20 then 'medium' else 'low' end as level from s"))
def risk_score(spark, d):
    k = F.col("invoice_id")
    verdict = F.when(k % 5 == 0, "mismatch").when(k % 5 == 1, "partial").otherwise("matched")
    x = V.invoices(spark, d).select("invoice_id", (k % 11 == 0).alias("is_duplicate"), (k % 13 == 0).alias("unknown_vendor"), (k % 17 == 0).alias("gstin_mismatch"), (k % 19 == 0).alias("bank_changed"), verdict.alias("verdict"), (k % 23 == 0).alias("amount_anomaly"), (F.col("grand_total") * 4).alias("grand_total"))
    return R.risk(x, R.validations(_payload(spark, d)).where("not passed").select("invoice_id", "rule")).drop("signals")


_ACTIONS = list(R.STEPS)


@query(with_views("invoices", f""", x as (select *, {_ACTIONS!r}[cast(invoice_id % 7 + 1 as integer)] as action, invoice_id % 6 = 0 as has_error, case when invoice_id % 8 = 0 then 'mismatch' else 'matched' end as verdict from invoices),
y as (select *, case """ + " ".join(f"when action = '{n}' and status in ({', '.join(map(repr, b))}) then '{a}'".replace(",)", ")") for n, (b, a) in R.STEPS.items()) + """ end as to_, action = 'approve' and (has_error or risk_level = 'high' or verdict = 'mismatch') as blocked from x)
select invoice_id, action, case when to_ = 'paid' and not blocked then cast(0 as decimal(18,2)) else outstanding_amount end as outstanding, case when to_ is not null and not blocked then to_ else status end as status, case when to_ is null then 'not allowed from this status' when blocked then 'blocked by checks' end as refused from y"""))
def workflow_step(spark, d):
    k = F.col("invoice_id")
    x = V.invoices(spark, d).withColumn("action", F.element_at(F.array(*map(F.lit, _ACTIONS)), (k % 7 + 1).cast("int"))).withColumn("has_error", k % 6 == 0).withColumn("verdict", F.when(k % 8 == 0, "mismatch").otherwise("matched")).withColumn("override", F.lit(False))
    return R.apply_action(x)


_NEXT = " ".join(f"when action = '{n}' and status in ({', '.join(map(repr, b))}) then '{a}'".replace(",)", ")") for n, (b, a) in R.STEPS.items())
_FOLD = f"""with recursive acts as (select user_id as invoice_id, {_ACTIONS!r}[cast(event_id * 13 % 7 + 1 as integer)] as action, row_number() over (partition by user_id order by ts, event_id) as n from events),
fold(invoice_id, n, action, before, status) as (select distinct user_id, cast(0 as bigint), cast(null as varchar), cast(null as varchar), 'review_required' from events
union all select f.invoice_id, a.n, a.action, f.status, coalesce(case a.action {" ".join(f"when '{n}' then case when f.status in ({', '.join(map(repr, b))}) then '{a}' end".replace(",)", ")") for n, (b, a) in R.STEPS.items())} end, f.status || '') from fold f join acts a on a.invoice_id = f.invoice_id and a.n = f.n + 1),
step as (select *, case action {" ".join(f"when '{n}' then before in ({', '.join(map(repr, b))})".replace(",)", ")") for n, (b, a) in R.STEPS.items())} end as allowed from fold)"""


def _log(spark, d):
    e = V.table(spark, d, "events")
    return e.select(F.col("user_id").alias("invoice_id"), F.struct("ts", "event_id").alias("at"), F.element_at(F.array(*map(F.lit, _ACTIONS)), (F.col("event_id") * 13 % 7 + 1).cast("int")).alias("action"))


@query(_FOLD + """ select invoice_id, arg_max(status, n) as status, cast(count(*) filter (allowed) as integer) as done, cast(count(*) filter (not allowed) as integer) as refused from step group by 1""")
def workflow_fold(spark, d):
    return R.fold_actions(_log(spark, d))


@query(_FOLD + """ select invoice_id, cast(row_number() over (partition by invoice_id order by n) - 1 as integer) as step, action, before as from_status, status as to_status from step where allowed""")
def workflow_audit(spark, d):
    return R.audit(_log(spark, d))


@query(with_views("invoices", f""", s as (select l_orderkey as invoice_id, list(cast(cast(l_extendedprice as decimal(18,2)) * cast(0.50 as decimal(4,2)) as decimal(18,2)) order by l_shipdate, l_linenumber, l_partkey, l_extendedprice) as a from lineitem group by 1),
f as (select i.invoice_id, i.status, grand_total, a, case when status in ('approved', 'awaiting_payment') then list_reduce(list_prepend(cast(grand_total as decimal(18,2)), a), lambda x, y: cast(case when y > 0 and y <= x then x - y else x end as decimal(18,2))) else grand_total end as outstanding from invoices i join s on s.invoice_id = i.invoice_id)
select invoice_id, outstanding, case when status in ('approved', 'awaiting_payment') then case when outstanding = 0 then 'paid' else 'awaiting_payment' end else status end as status from f"""))
def payment_fold(spark, d):
    x = V.table(spark, d, "lineitem")
    paid = x.select(F.col("l_orderkey").alias("invoice_id"), F.struct("l_shipdate", "l_linenumber", "l_partkey", "l_extendedprice").alias("at"), (F.col("l_extendedprice").cast(V.MONEY) * F.lit("0.50").cast("decimal(4,2)")).cast(V.MONEY).alias("amount"))
    return R.fold_payments(V.invoices(spark, d).withColumn("balance", F.col("grand_total")), paid).select("invoice_id", "outstanding", "status")


@query("""with r as (select 't' || (user_id % 4) as tenant_id, event_id as document_id, 'Vendor ' || (user_id % 40) as vendor_name, case when event_id % 10 <> 0 then 'Inv-' || (event_id % 300) end as invoice_number, event_id % 3 = 0 as done from events),
g as (select tenant_id, vendor_name, lower(invoice_number) as key, min(document_id) filter (done) as low, max(document_id) filter (done) as high from r where invoice_number is not null group by 1, 2, 3),
j as (select document_id, case when low <> document_id then low when high <> document_id then high end as duplicate_of from r join g on g.tenant_id = r.tenant_id and g.vendor_name = r.vendor_name and g.key = lower(r.invoice_number)) select * from j where duplicate_of is not null""")
def document_duplicates(spark, d):
    k, u = F.col("event_id"), F.col("user_id")
    text = F.when(k % 10 != 0, F.concat(F.when(k % 2 == 0, F.lit("INV-")).otherwise(F.lit("inv-")), (k % 300).cast("string")))
    x = V.table(spark, d, "events").select(F.concat(F.lit("t"), (u % 4).cast("string")).alias("tenant_id"), k.alias("document_id"), F.concat(F.lit("Vendor "), (u % 40).cast("string")).alias("vendor_name"), text.alias("invoice_number"), F.when(k % 3 == 0, "completed").otherwise("failed").alias("status"))
    return X.document_duplicates(x)


@query(with_views("purchase_order_items", """, r as (select l_orderkey as po_id, l_linenumber as pos, l_quantity from lineitem) select po_id, pos, l_quantity from r where not exists (select 1 from purchase_order_items p where p.po_id = r.po_id and p.pos = r.pos)"""))
def foreign_receipts(spark, d):
    r = V.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("po_id"), F.col("l_linenumber").alias("pos"), "l_quantity")
    return X.foreign_receipts(r, V.purchase_order_items(spark, d)).select("po_id", "pos", "l_quantity")


@query(with_views("invoices", """ select invoice_id, case when invoice_id % 7 = 0 then 'duplicate' when invoice_id % 11 = 0 then null else status end as prior, case when (invoice_id % 7 = 0 or invoice_id % 11 = 0 or status not in ('paid', 'rejected')) and invoice_id % 5 = 0 then 'duplicate' when invoice_id % 7 = 0 or invoice_id % 11 = 0 or status in ('review_required', 'duplicate') then 'review_required' else status end as status,
case invoice_id % 4 when 0 then null when 1 then 'a' when 2 then 'a; b' else 'a; b; c' end as reason from invoices"""))
def projection_status(spark, d):
    k = F.col("invoice_id")
    prior = F.when(k % 7 == 0, "duplicate").when(k % 11 == 0, None).otherwise(F.col("status"))
    flag = lambda m, ok, s: F.struct(F.lit(m).alias("message"), ok.alias("passed"), F.lit(s).alias("severity"))
    flags = F.array(flag("x", F.lit(False), "warning"), flag("a", k % 4 < 1, "error"), flag("b", k % 4 < 2, "error"), flag("c", k % 4 < 3, "error"), flag("d", k % 4 < 3, "error"))
    return V.invoices(spark, d).select("invoice_id", prior.alias("prior"), R.projected_status(prior, k % 5 == 0).alias("status"), R.blocking_reason(flags).alias("reason"))


_DOC_ID = "case when i.invoice_id % 8 = 1 or i.invoice_id % 4 = 2 then null when i.invoice_id % 16 = 3 then '29AAGCB7383J1Z4' else gstin end as doc_gstin"
_OWN_FLAGS = _PAYLOAD.replace("flag as (", "flag_ as (").replace("as due_date, gstin,", f"as due_date, gstin, {_DOC_ID},").replace("'gstin', 'warning', sum_ok and", "'gstin', 'warning', doc_gstin = '29AAGCB7383J1Z4' or sum_ok and").replace("between 1 and 37 from e where gstin is not null", "between 1 and 37 from e where doc_gstin is not null").replace("substr(gstin, 1, 2) = substr(b", "substr(doc_gstin, 1, 2) = substr(b").replace("substr(gstin, 1, 2) <> substr(b", "substr(doc_gstin, 1, 2) <> substr(b")
_PROJECT = _OWN_FLAGS + f""", kin as (select pay.*, i.tenant_id, i.created_at, i.po_number, i.vendor_id as own, case when i.invoice_id % 5 = 0 then null else i.status end as prior_status, case when i.invoice_id % 9 = 0 then 'AC0' else 'AC' || i.vendor_id end as bank_account, case i.invoice_id % 30 when 0 then 'mismatch' when 1 then 'match' when 2 then 'not_comparable' end as qr_status from pay join invoices i on i.invoice_id = pay.invoice_id),
doc as (select * replace (case when invoice_id % 8 = 1 then 'New ' || (invoice_id % 50) else vendor_name end as vendor_name, case when invoice_id % 8 = 1 or invoice_id % 4 = 2 then null when invoice_id % 16 = 3 then '29AAGCB7383J1Z4' else gstin end as gstin) from kin),
kv as (select *, regexp_replace(lower(vendor_name), '[^a-z0-9]+', '', 'g') as vkey, regexp_replace(lower(coalesce(invoice_number, '')), '[^a-z0-9]+', '', 'g') as number_key from doc),
vg as (select tenant_id, upper(gstin) as g, min(vendor_id) as by_gstin from vendors where gstin is not null group by 1, 2), vn as (select tenant_id, normalized_name as vkey, min(vendor_id) as by_name, arg_min(gstin, vendor_id) as known_gstin from vendors where normalized_name <> '' group by 1, 2),
rv as (select kv.*, coalesce(by_gstin, by_name) as known_id, by_gstin is null and by_name is not null and coalesce(upper(gstin) <> upper(known_gstin), false) as gstin_mismatch from kv left join vg on vg.tenant_id = kv.tenant_id and vg.g = upper(kv.gstin) left join vn on vn.tenant_id = kv.tenant_id and vn.vkey = kv.vkey),
nw as (select *, case when known_id is null then coalesce(upper(gstin), nullif(vkey, ''), '#' || invoice_id) end as new_key from rv),
fi as (select *, case when new_key is not null then first_value(invoice_id) over (partition by tenant_id, new_key order by created_at, invoice_id) end as first_id from nw),
vd as (select fi.* exclude (own, vkey), coalesce(known_id, -first_id) as vendor_id, coalesce(first_id = invoice_id, false) as unknown_vendor, coalesce(lower(fi.bank_account) <> lower(v.bank_account), false) as bank_changed,
 case when fi.gstin is not null and number_key <> '' and invoice_date is not null and grand_total is not null then upper(fi.gstin) || '|' || number_key || '|' || invoice_date || '|' || grand_total end as print, coalesce(prior_status, 'review_required') as status0 from fi left join vendors v on v.tenant_id = fi.tenant_id and v.vendor_id = fi.known_id),
va as (select *, case when status0 <> 'rejected' then invoice_id end as valid from vd),
du as (select *, case when print is not null then first_value(valid ignore nulls) over (partition by tenant_id, print {_PRIOR}) end as by_print, case when number_key <> '' then first_value(valid ignore nulls) over (partition by tenant_id, vendor_id, number_key {_PRIOR}) end as any_, case when number_key <> '' then first_value(case when print is null then valid end ignore nulls) over (partition by tenant_id, vendor_id, number_key {_PRIOR}) end as bare from va),
dd as (select *, coalesce(by_print, case when print is null then any_ else bare end) as duplicate_of, case when by_print is not null then 'sha256_fingerprint' when (case when print is null then any_ else bare end) is not null then 'vendor_number' end as match_type from du),
st as (select *, case when duplicate_of is null then any_ end as repeat_of, case when duplicate_of is not null and coalesce(prior_status, '') not in ('paid', 'rejected') then 'duplicate' when prior_status is null or prior_status in ('review_required', 'duplicate') then 'review_required' else prior_status end as status from dd),
an as (select *, round(avg({_COUNTED}) over (partition by tenant_id, vendor_id {_PRIOR}), 6) as h from st),
am as (select *, coalesce(cast(grand_total as double) >= 3 * h and cast(grand_total as double) - h >= 1000, false) as amount_anomaly from an)"""
_KNOWN = _PLACED[_PLACED.index("known as ("):]
_PROJECTED = _PROJECT + ", " + (_PLACED[2:_PLACED.index("known as (")] + _KNOWN.replace("from invoices i left join", "from am i left join")) + _MATCH[len(_PLACED):].replace(", case when abs(coalesce(tax_total, 0) - coalesce(po_tax, 0)) > 1 then 'tax_total' end", "").replace("m as (select k.*, tx.tax as tax_total,", "m as (select k.*,") + f""",
flag as (select * from flag_ where rule <> 'duplicate_invoice'),
extra as (select invoice_id, 'duplicate_invoice' as rule, 'error' as severity from am where duplicate_of is not null union all select invoice_id, 'repeated_invoice_number', 'warning' from am where repeat_of is not null and duplicate_of is null union all select invoice_id, 'purchase_order', 'warning' from verdicts where verdict = 'mismatch' union all select invoice_id, 'qr_ocr_mismatch', 'warning' from am where qr_status = 'mismatch'),
bad as (select invoice_id, rule, severity from flag where not passed union all select * from extra),
pts as (select invoice_id, string_agg(rule, ',' order by rule) as codes, sum(case rule when 'required_fields' then 25 when 'arithmetic' then 10 when 'tax_total' then 10 when 'gstin' then 10 when 'pan' then 10 when 'repeated_invoice_number' then 20 when 'qr_ocr_mismatch' then 15 else 5 end) as points from bad where rule not in ('duplicate_invoice', 'purchase_order') group by 1),
sc as (select am.*, v.verdict, case when v.po_id is not null then case when v.three then 'three_way' else 'two_way' end end as mode, cast(least(100, (duplicate_of is not null)::int * 40 + unknown_vendor::int * 15 + gstin_mismatch::int * 20 + bank_changed::int * 25 + (v.verdict in ('mismatch', 'partial'))::int * 15 + amount_anomaly::int * 10 + coalesce(am.grand_total >= 1000000, false)::int * 10 + coalesce(points, 0)) as integer) as risk_score,
 array_to_string(list_filter([case when duplicate_of is not null then 'duplicate_invoice' end, case when unknown_vendor then 'unknown_vendor' end, case when gstin_mismatch then 'gstin_mismatch' end, case when bank_changed then 'bank_details_changed' end, case when v.verdict in ('mismatch', 'partial') then 'po_mismatch' end, codes, case when amount_anomaly then 'amount_anomaly' end, case when am.grand_total >= 1000000 then 'large_purchase' end], lambda s: s is not null), ',') as signals from am join (select invoice_id, verdict, po_id, three from verdicts) v on v.invoice_id = am.invoice_id left join pts on pts.invoice_id = am.invoice_id),
rq as (select invoice_id, true as missing from bad where rule = 'required_fields')
select sc.invoice_id, vendor_id, unknown_vendor, duplicate_of, match_type, repeat_of, verdict, mode, amount_anomaly, risk_score, case when risk_score >= 50 then 'high' when risk_score >= 20 then 'medium' else 'low' end as risk_level, signals, status,
case when status = 'duplicate' then 'Duplicate invoice detected' when status = 'review_required' then array_to_string(nullif(list_filter([case when missing then 'required_fields' end, case when duplicate_of is not null then 'duplicate_invoice' end], lambda s: s is not null), []), '; ') end as review_reason from sc left join rq on rq.invoice_id = sc.invoice_id"""


def _documents(spark, d):
    k = F.col("invoice_id")
    i = V.invoices(spark, d).select("invoice_id", "tenant_id", "created_at", "po_number", F.when(k % 5 != 0, F.col("status")).alias("prior_status"), F.when(k % 9 == 0, "AC0").otherwise(F.concat(F.lit("AC"), F.col("vendor_id").cast("string"))).alias("bank_account"), F.when(k % 30 == 0, "mismatch").when(k % 30 == 1, "match").when(k % 30 == 2, "not_comparable").alias("qr_status"))
    x = _payload(spark, d).join(i, "invoice_id")
    name = F.when(k % 8 == 1, F.concat(F.lit("New "), (k % 50).cast("string"))).otherwise(F.col("vendor_name"))
    tax_id = F.when((k % 8 == 1) | (k % 4 == 2), None).when(k % 16 == 3, "29AAGCB7383J1Z4").otherwise(F.col("gstin"))
    return x.withColumns({"vendor_name": name, "gstin": tax_id})


@query(with_views(_PAY_VIEWS + " " + _PO_VIEWS, _PROJECTED))
def project_documents(spark, d):
    from payloom.operators.projection import project_documents as project

    return project(_documents(spark, d), V.invoice_items(spark, d), V.vendors(spark, d), V.purchase_orders(spark, d), V.purchase_order_items(spark, d), V.goods_receipt_items(spark, d))
