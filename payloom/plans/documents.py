"""Queries over texts, tables of cells, uploads, evaluation and the job queue."""

from __future__ import annotations

from pyspark.sql import functions as F

from payloom.functions import scalar as S
from payloom.operators import evaluate as E
from payloom.operators import extract as X
from payloom.plans.register import query
from payloom.sources import files as I
from payloom.sources import views as V
from payloom.sources.views import with_views
from payloom.streaming import jobs as J


@query("""select c_custkey, regexp_replace(lower(c_name), '[^a-z0-9]+', '', 'g') as key, trim(regexp_replace('  ' || c_name || '   ' || c_mktsegment || ' ', '\\s+', ' ', 'g')) as compact from customer""")
def match_keys(spark, d):
    return V.table(spark, d, "customer").select("c_custkey", S.match_key(F.col("c_name")).alias("key"), S.compact(F.concat(F.lit("  "), "c_name", F.lit("   "), "c_mktsegment", F.lit(" "))).alias("compact"))


_RAW = ", raw as (select vendor_id, 'gstin: ' || replace(replace(lower(gstin), '0', 'o'), '1', 'l') as raw from vendors where gstin is not null)"


@query(with_views("vendors", _RAW + """, b as (select vendor_id, regexp_replace(upper(substr(raw, 8)), '[^A-Z0-9]', '', 'g') as t from raw)
select vendor_id, array_to_string(list_transform(range(1, 16), lambda i: case when i - 1 in (0, 1, 7, 8, 9, 10, 12) then translate(t[i], 'OIL', '011') else t[i] end), '') as gstin from b"""))
def tax_id_normalise(spark, d):
    v = V.vendors(spark, d).where("gstin is not null")
    raw = F.replace(F.replace(F.lower("gstin"), F.lit("0"), F.lit("o")), F.lit("1"), F.lit("l"))
    return v.select("vendor_id", S.gstin(raw).alias("gstin"))


_SUM36 = " + ".join(f"(p{i} // 36 + p{i} % 36)" for i in range(14))
_P = ", ".join(f"(strpos('{S.ALPHABET}', substr(gstin, {i + 1}, 1)) - 1) * {1 + i % 2} as p{i}" for i in range(14))


@query(with_views("vendors", f""", s as (select vendor_id, gstin, {_P} from vendors) select vendor_id, coalesce(length(gstin) = 15 and (36 - ({_SUM36}) % 36) % 36 = strpos('{S.ALPHABET}', substr(gstin, 15, 1)) - 1, false) as sound from s"""))
def tax_id_checksum(spark, d):
    return V.vendors(spark, d).select("vendor_id", S.gstin_checksum(F.col("gstin")).alias("sound"))


#: An amount written in the ways that invoices have: Indian, plain, European, comma decimals, grouped, blank.
_WRITE = ["'₹ ' || format('{:,.2f}', x)", "cast(x as varchar)", "replace(replace(replace(format('{:,.2f}', x), ',', '_'), '.', ','), '_', '.')", "replace(cast(x as varchar), '.', ',')", "format('{:,}', cast(floor(x) as bigint))", "''"]


def _written(spark, d):
    x = F.col("o_totalprice").cast(V.MONEY)
    grouped = F.format_number(x, 2)
    forms = [F.concat(F.lit("₹ "), grouped), x.cast("string"), F.translate(F.translate(F.translate(grouped, ",", "_"), ".", ","), "_", "."), F.translate(x.cast("string"), ".", ","), F.format_number(x.cast("long"), 0), F.lit("")]
    text = F.element_at(F.array(*forms), (F.col("o_orderkey") % 6 + 1).cast("int"))
    return V.table(spark, d, "orders").select("o_orderkey", text.alias("text"))


@query(f"""with w as (select o_orderkey, cast(o_totalprice as decimal(18,2)) as x from orders), t as (select o_orderkey, x, case o_orderkey % 6 {" ".join(f"when {i} then {e}" for i, e in enumerate(_WRITE))} end as text from w)
select o_orderkey, text, cast(case o_orderkey % 6 when 4 then floor(x) when 5 then 0 else x end as decimal(18,2)) as amount, case when o_orderkey % 6 <> 5 then cast(case o_orderkey % 6 when 4 then floor(x) else x end as decimal(18,2)) end as amount_or_null from t""")
def number_parse(spark, d):
    t = F.col("text")
    return _written(spark, d).select("o_orderkey", "text", S.number(t).alias("amount"), S.number(t, None).alias("amount_or_null"))


@query("""with o as (select o_orderkey, cast(o_orderdate as date) as day from orders) select o_orderkey, case when o_orderkey % 6 = 5 then null else day end as day from o""")
def date_parse(spark, d):
    day = F.to_date("o_orderdate")
    forms = [F.date_format(day, f) for f in ("dd/MM/yyyy", "yyyy-MM-dd", "dd MMM yyyy", "yyyy/MM/dd", "dd-MMM-yyyy")] + [F.lit("31/02/2026")]
    text = F.element_at(F.array(*forms), (F.col("o_orderkey") % 6 + 1).cast("int"))
    return V.table(spark, d, "orders").select("o_orderkey", S.invoice_date(text).alias("day"))


@query("""select p_partkey, levenshtein(p_name, p_type) as distance, case when p_retailprice is not null then regexp_replace(format('{:,.2f}', cast(p_retailprice as decimal(18,2))), '[.]?0+$', '') end as shown from part""")
def edit_distance(spark, d):
    return V.table(spark, d, "part").select("p_partkey", F.levenshtein("p_name", "p_type").alias("distance"), S.display_amount(F.col("p_retailprice").cast(V.MONEY)).alias("shown"))


def _qr(spark, d):
    """Payloads: JSON, a URL's query, pairs, and base64url of JSON, with some totals off by one."""
    i = V.invoices(spark, d).join(V.vendors(spark, d).select("tenant_id", "vendor_id", "gstin"), ["tenant_id", "vendor_id"], "left")
    k, total = F.col("invoice_id"), (F.col("grand_total") + F.when(F.col("invoice_id") % 10 == 0, 2).otherwise(0)).cast(V.MONEY).cast("string")
    json = F.to_json(F.struct(F.lit("1.1").alias("Version"), F.struct(F.col("invoice_number").alias("DocNo"), F.col("invoice_date").cast("string").alias("DocDt"), F.struct(F.col("gstin").alias("SellerGstin")).alias("Parties")).alias("Data"), total.alias("TotInvVal"), F.lit("irn-1").alias("Irn")))
    tax = F.coalesce("gstin", F.lit(""))
    url = F.concat(F.lit("https://pay.example/qr?docno=x&invoice_no="), "invoice_number", F.lit("&invoice%20date="), F.col("invoice_date").cast("string"), F.lit("&sellergstin="), tax, F.lit("&total="), total)
    pairs = F.concat(F.lit("Invoice No: "), "invoice_number", F.lit("|Invoice Date="), F.col("invoice_date").cast("string"), F.lit(";Seller GSTIN="), tax, F.lit("|Grand Total="), total)
    coded = F.translate(F.base64(json.cast("binary")), "+/\n\r", "-_")
    return i.select(k, "invoice_number", "invoice_date", "gstin", "grand_total", F.element_at(F.array(json, url, pairs, coded), (k % 4 + 1).cast("int")).alias("payload"))


@query(with_views("invoices vendors", """ select invoice_id, case when invoice_id % 4 = 1 then 'x' else invoice_number end as qr_number, cast(invoice_date as varchar) as qr_date, gstin as qr_gstin, cast(cast(grand_total + case when invoice_id % 10 = 0 then 2 else 0 end as decimal(18,2)) as varchar) as qr_total, case when invoice_id % 4 in (0, 3) then 'irn-1' end as qr_irn
from invoices i left join vendors v on v.tenant_id = i.tenant_id and v.vendor_id = i.vendor_id"""))
def qr_fields(spark, d):
    x = _qr(spark, d).withColumn("f", S.qr_fields(F.col("payload")))
    name = lambda n: S.qr_field(F.col("f"), n)
    return x.select("invoice_id", name("invoice_number").alias("qr_number"), name("invoice_date").alias("qr_date"), name("seller_gstin").alias("qr_gstin"), name("grand_total").alias("qr_total"), name("irn").alias("qr_irn"))


@query(with_views("invoices vendors", """ select invoice_id, case when invoice_id % 10 = 0 or invoice_id % 4 = 1 then 'mismatch' else 'match' end as status, case when invoice_id % 10 = 0 then cast(2 as decimal(18,2)) end as difference,
cast(3 + (gstin is not null)::int as integer) as compared, case when gstin is not null and i.invoice_id % 9 = 0 then 1 else 0 end as not_comparable from invoices i left join vendors v on v.tenant_id = i.tenant_id and v.vendor_id = i.vendor_id"""))
def qr_compare(spark, d):
    x = _qr(spark, d).withColumn("f", S.qr_fields(F.col("payload")))
    known = {"invoice_number": F.lower("invoice_number"), "invoice_date": F.date_format("invoice_date", "dd/MM/yyyy"), "seller_gstin": F.when(F.col("invoice_id") % 9 != 0, F.lower("gstin")), "grand_total": F.concat(F.lit("INR "), F.format_number("grand_total", 2))}
    y = x.withColumn("c", S.qr_comparison(F.col("f"), known))
    return y.select("invoice_id", S.qr_status(F.col("c")).alias("status"), F.get(F.filter("c", lambda r: r["field"] == "grand_total"), F.lit(0))["difference"].alias("difference"), F.size("c").alias("compared"), F.size(F.filter("c", lambda r: r["status"] == "not_comparable")).alias("not_comparable"))


@query("""with x as (select doc_id, source, lang, sha256(coalesce(text, '')) as hash from documents), y as (select *, row_number() over (partition by source, hash order by doc_id desc) as place from x) select doc_id, hash from y where place = 1""")
def content_dedupe(spark, d):
    x = V.table(spark, d, "documents").select(F.col("source").alias("tenant_id"), F.col("doc_id").alias("document_id"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("content_hash"), F.lit(0).alias("created_at"))
    return I.newest_by_hash(x).select(F.col("document_id").alias("doc_id"), F.col("content_hash").alias("hash"))


@query("""select page_id, case when page_id % 5 = 0 then 'unsupported extension' when page_id % 5 = 1 then 'empty file' when page_id % 5 = 2 then 'content does not match extension' end as rejected, case page_id % 5 when 0 then null when 1 then 'application/pdf' when 2 then 'image/png' when 3 then 'application/pdf' else 'image/jpeg' end as mime from pages""")
def upload_checks(spark, d):
    k = F.col("page_id") % 5
    name = F.concat(F.col("page_id").cast("string"), F.element_at(F.array(*map(F.lit, (".exe", ".pdf", ".PNG", ".pdf", ".jpg"))), (k + 1).cast("int")))
    head = F.element_at(F.array(F.unhex(F.lit("4D5A")), F.unhex(F.lit("")), F.unhex(F.lit("FFD8FF")), F.unhex(F.lit("255044462D")), F.unhex(F.lit("FFD8FFE0"))), (k + 1).cast("int"))
    files = V.table(spark, d, "pages").select("page_id", name.alias("filename"), F.when(k == 1, head).otherwise(F.concat(head, F.col("html").cast("binary"))).alias("content"))
    return I.validate_uploads(files).select("page_id", "rejected", "mime")


@query(with_views("vendors", """, r as (select 't' || (s_suppkey % 4) as tenant_id, s_suppkey + 2 as row, case when s_suppkey % 9 = 0 then null when s_suppkey % 3 = 0 then ' customer#' || lpad(cast(s_suppkey as varchar), 9, '0') else s_name end as name from supplier)
select r.tenant_id, row, trim(r.name) as name, case when r.name is null then 'error' when v.vendor_id is null then 'insert' else 'update' end as change from r left join (select tenant_id, normalized_name, min(vendor_id) as vendor_id from vendors group by 1, 2) v on v.tenant_id = r.tenant_id and v.normalized_name = regexp_replace(lower(r.name), '[^a-z0-9]+', '', 'g')"""))
def import_vendors(spark, d):
    k = F.col("s_suppkey")
    name = F.when(k % 9 == 0, None).when(k % 3 == 0, F.concat(F.lit(" customer#"), F.lpad(k.cast("string"), 9, "0"))).otherwise(F.col("s_name"))
    rows = V.table(spark, d, "supplier").select(F.concat(F.lit("t"), (k % 4).cast("string")).alias("tenant_id"), (k + 2).alias("row"), name.alias("name"), F.lit(None).cast("string").alias("vendor_name"), F.lit(None).cast("string").alias("gstin"))
    good, bad = I.import_vendors(rows, V.vendors(spark, d))
    return good.select("tenant_id", "row", "name", "change").unionByName(bad.select("tenant_id", "row", F.lit(None).cast("string").alias("name"), F.lit("error").alias("change")))


@query(with_views("purchase_orders", """, r as (select 't' || (o_custkey % 4) as tenant_id, o_orderkey as row, case when o_orderkey % 31 = 0 then ' ' when o_orderkey % 3 = 0 then 'NEW-' || (o_orderkey // 6) else 'PO-' || o_orderkey end as number, o_orderkey % 13 <> 0 as fine from orders),
x as (select r.*, lower(trim(r.number)) as key, p.number is not null as known from r left join purchase_orders p on p.tenant_id = r.tenant_id and lower(p.number) = lower(trim(r.number))), y as (select *, sum(case when key <> '' and fine then 1 else 0 end) over (partition by tenant_id, key order by row) as place from x)
select tenant_id, row, case when key = '' then 'number is required' when not fine then 'invalid amount' when known or place > 1 then 'duplicate purchase order' end as error from y"""))
def import_pos(spark, d):
    k = F.col("o_orderkey")
    number = F.when(k % 31 == 0, " ").when(k % 3 == 0, F.concat(F.lit("NEW-"), F.floor(k / 6).cast("string"))).otherwise(F.concat(F.lit("PO-"), k.cast("string")))
    rows = V.table(spark, d, "orders").select(F.concat(F.lit("t"), (F.col("o_custkey") % 4).cast("string")).alias("tenant_id"), k.alias("row"), number.alias("number"), F.when(k % 13 == 0, "abc").otherwise("2").alias("quantity"), F.lit("10.50").alias("unit_price"))
    good, bad = I.import_orders(rows, V.purchase_orders(spark, d))
    return good.select("tenant_id", "row", F.lit(None).cast("string").alias("error")).unionByName(bad)


@query("""select event_id as document_id, 'grand_total' as field, cast(event_id as varchar) as predicted, case when event_id % 2 = 0 then '"' || event_type || '"' else '{"k":' || (event_id % 10) || '}' end as correct from events""")
def corrections(spark, d):
    k = F.col("event_id")
    x = V.table(spark, d, "events").select(k.alias("document_id"), F.lit("grand_total").alias("path"), k.cast("string").alias("old_value"), F.when(k % 2 == 0, F.col("event_type")).otherwise(F.concat(F.lit('{"k": '), (k % 10).cast("string"), F.lit("}"))).alias("new_value"), F.col("ts").alias("created_at"))
    return I.export_corrections(x).drop("created_at")


_FIELDS = ("invoice_number", "vendor_name", "grand_total")
_PAIRS = """, p as (select i.invoice_id, lower(i.invoice_number) as t1, case when i.invoice_id % 7 = 0 then '' when i.invoice_id % 11 = 0 then 'wrong' else lower(i.invoice_number) end as g1, lower(v.name) as t2, case when i.invoice_id % 5 = 0 then 'x' else lower(v.name) end as g2, case when i.invoice_id % 4 = 0 then '' else cast(grand_total as varchar) end as t3, cast(grand_total as varchar) as g3 from invoices i join vendors v on v.tenant_id = i.tenant_id and v.vendor_id = i.vendor_id)"""


def _labelled(spark, d):
    k = F.col("invoice_id")
    x = V.invoices(spark, d).join(V.vendors(spark, d).select("tenant_id", "vendor_id", "name"), ["tenant_id", "vendor_id"])
    total = F.col("grand_total").cast("string")
    truth = F.struct(F.col("invoice_number"), F.col("name").alias("vendor_name"), F.when(k % 4 == 0, None).otherwise(total).alias("grand_total"))
    guess = F.struct(F.when(k % 7 == 0, None).when(k % 11 == 0, "wrong").otherwise(F.upper("invoice_number")).alias("invoice_number"), F.when(k % 5 == 0, "x").otherwise(F.concat(F.lit(" "), "name")).alias("vendor_name"), total.alias("grand_total"))
    return x.select("invoice_id", truth.alias("expected"), guess.alias("predicted"))


@query(with_views("invoices vendors", _PAIRS + """, f as (select 'invoice_number' as field, t1 as t, g1 as g from p union all select 'vendor_name', t2, g2 from p union all select 'grand_total', t3, g3 from p),
c as (select field, count(*) filter (t <> '' and t = g) as tp, count(*) filter (g <> '' and not (t <> '' and t = g)) as fp, count(*) filter (t <> '' and t <> g) as fn from f group by 1), r as (select *, tp / (tp + fp) as p_, tp / (tp + fn) as r_ from c)
select field, tp, fp, fn, round(p_, 6) as precision, round(r_, 6) as recall, round(2 * p_ * r_ / (p_ + r_), 6) as f1 from r"""))
def eval_fields(spark, d):
    return E.field_scores(_labelled(spark, d), _FIELDS)


@query(with_views("invoices vendors", _PAIRS + " select count(*) as documents, round(count(*) filter (t1 = g1 and t2 = g2 and t3 = g3) / count(*), 6) as exact_match from p"))
def eval_exact(spark, d):
    return E.exact_match(_labelled(spark, d), _FIELDS)


@query(with_views("invoice_items", """, n as (select invoice_id, count(*) as t, count(*) - (invoice_id % 3 = 0)::int as g from invoice_items group by 1), c as (select sum(case when i.invoice_id % 4 = 0 and pos % 2 = 0 then 1 else 2 end) as ok from invoice_items i join n on n.invoice_id = i.invoice_id where pos <= g),
s as (select cast(sum(least(t, g)) as bigint) as tp, cast(sum(greatest(0, g - t)) as bigint) as fp, cast(sum(greatest(0, t - g)) as bigint) as fn from n), r as (select *, tp / (tp + fp) as p_, tp / (tp + fn) as r_ from s)
select tp, fp, fn, round(p_, 6) as precision, round(r_, 6) as recall, round(2 * p_ * r_ / (p_ + r_), 6) as f1, round(ok / (2 * tp), 6) as cell_accuracy from r, c"""))
def eval_rows(spark, d):
    items = V.invoice_items(spark, d)
    cells = lambda q: F.struct("pos", F.col("description").alias("description"), q.cast("string").alias("quantity"))
    k = F.col("invoice_id")
    x = items.groupBy("invoice_id").agg(F.sort_array(F.collect_list(cells(F.col("quantity")))).alias("expected_rows"), F.sort_array(F.collect_list(cells(F.when((k % 4 == 0) & (F.col("pos") % 2 == 0), -1).otherwise(F.col("quantity"))))).alias("p"))
    n = F.size("p") - (k % 3 == 0).cast("int")
    return E.row_scores(x.select("expected_rows", F.slice("p", F.lit(1), n).alias("predicted_rows")), ("description", "quantity"))


@query(with_views("ingested", """, s as (select list(processing_ms order by processing_ms) as l, count(processing_ms) as n, median(processing_ms) as m from ingested where processing_ms is not null) select n, round(m, 4) as p50, l[cast(greatest(0, cast(floor(0.95 * n) as bigint) - 1) + 1 as integer)] as p95 from s"""))
def eval_latency(spark, d):
    return E.latencies(V.ingested(spark, d), "processing_ms")


@query(with_views("ingested", " select source, count(*) as documents, round(count(*) / (select count(*) from ingested), 6) as share from ingested group by 1"))
def eval_sources(spark, d):
    return E.sources(V.ingested(spark, d))


@query("""with x as (select lower(p_name) as t, lower(replace(p_name, 'a', 'e')) as g from part), y as (select trim(regexp_replace(t, '\\s+', ' ', 'g')) as t, trim(regexp_replace(g, '\\s+', ' ', 'g')) as g from x),
w as (select *, list_distinct(list_concat(string_split(t, ' '), string_split(g, ' '))) as d from y), c as (select *, array_to_string(list_transform(string_split(t, ' '), lambda z: chr(cast(13312 + list_position(d, z) as integer))), '') as tc, array_to_string(list_transform(string_split(g, ' '), lambda z: chr(cast(13312 + list_position(d, z) as integer))), '') as gc from w),
e as (select t, length(t) as cn, (select 0) as z, len(string_split(t, ' ')) as wn, g, tc, gc from c)
select cast(sum(len(list_filter(range(1, cast(cn + 1 as bigint)), lambda i: t[i] <> g[i]))) as bigint) as char_errors, cast(sum(cn) as bigint) as chars, cast(sum(len(list_filter(range(1, cast(wn + 1 as bigint)), lambda i: tc[i] <> gc[i]))) as bigint) as word_errors, cast(sum(wn) as bigint) as words,
round(sum(len(list_filter(range(1, cast(cn + 1 as bigint)), lambda i: t[i] <> g[i]))) / sum(cn), 6) as cer, round(sum(len(list_filter(range(1, cast(wn + 1 as bigint)), lambda i: tc[i] <> gc[i]))) / sum(wn), 6) as wer from e""")
def eval_text(spark, d):
    return E.text_rates(V.table(spark, d, "part").select(F.col("p_name").alias("expected"), F.replace(F.col("p_name"), F.lit("a"), F.lit("e")).alias("predicted")))


def _words(spark, d):
    """Words of documents as boxes: twelve to a line, with some jitter."""
    x = V.table(spark, d, "documents").select("doc_id", F.posexplode(F.split(F.trim("text"), r"\s+")).alias("i", "text"))
    line = F.floor(F.col("i") / 12)
    return x.select("doc_id", F.floor(line / 50).cast("int").alias("page"), "text", ((F.col("i") % 12) * 80).cast("int").alias("x"), ((line % 50) * 30 + (F.col("i") * 7 % 9)).cast("int").alias("y"), F.lit(70).alias("width"), F.lit(12).alias("height"))


@query("""with w as (select doc_id, unnest(string_split_regex(trim(text), '\\s+')) as word, generate_subscripts(string_split_regex(trim(text), '\\s+'), 1) - 1 as i from documents)
select doc_id, cast(i // 600 as integer) as page, cast(i // 12 % 50 as integer) as line_no, string_agg(word, ' ' order by i) as text from w group by 1, 2, 3""")
def word_lines(spark, d):
    return X.lines(_words(spark, d))


@query()
def label_values(spark, d):
    return X.label_values(X.lines(_words(spark, d)), ("token", "ip", "id"), r"[0-9a-f]{6,}|\d+\.\d+\.\d+\.\d+")


@query("""select c_custkey, cast(c_custkey * 3 as varchar) as po, cast(c_custkey * 100 as decimal(18,2)) as largest, 2 as taxes, cast(c_custkey as decimal(18,2)) as first_tax from customer""")
def text_values(spark, d):
    k = F.col("c_custkey")
    text = F.concat(F.lit("Purchase Order No: "), (k * 3).cast("string"), F.lit("\nTotal 10.00 and Amount Payable "), (k * 100).cast("string"), F.lit(".00\nCGST @ 9% "), k.cast("string"), F.lit(".00 SGST 9 % "), k.cast("string"), F.lit(".00"))
    x = V.table(spark, d, "customer").select("c_custkey", text.alias("t")).withColumn("taxes", X.tax_rows(F.col("t")))
    return x.select("c_custkey", X.text_value(F.col("t"), ("purchase order no", "po no"), r"\d+").alias("po"), F.greatest(X.largest_amount(F.substring_index("t", "CGST", 1), "amount payable"), F.lit(0)).cast(V.MONEY).alias("largest"), F.size("taxes").alias("taxes"), F.get("taxes", F.lit(0))["amount"].alias("first_tax"))


@query(with_views("invoice_items", " select invoice_id as doc_id, pos - 1 as row_no, description, cast(quantity as decimal(18,2)) as quantity, unit_price, cast(line_total as decimal(18,2)) as line_total from invoice_items"))
def structured_items(spark, d):
    items = V.invoice_items(spark, d)
    cell = lambda c: F.concat(F.lit("<td>"), F.col(c).cast("string"), F.lit("</td>"))
    row = F.concat(F.lit("<tr>"), cell("description"), cell("quantity"), cell("unit_price"), cell("line_total"), F.lit("</tr>"))
    html = items.groupBy("invoice_id").agg(F.sort_array(F.collect_list(F.struct("pos", row.alias("r")))).alias("rows"))
    head = "<table><tr><th>Item <b>Description</b></th><th>Qty</th><th>Unit Price</th><th>Amount</th></tr>"
    text = F.concat(F.lit(head), F.array_join(F.transform("rows", lambda r: r["r"]), ""), F.lit("<tr><td>Total</td><td></td><td></td><td>1.00</td></tr></table>"))
    tables = html.select(F.col("invoice_id").alias("doc_id"), F.lit(0).alias("table_no"), X.table_rows(text).alias("rows"))
    return X.structured_items(tables).select("doc_id", "row_no", "description", "quantity", "unit_price", "line_total")


@query("""with h(key, want) as (values ('Item Description', 'description'), ('Product Price', 'description'), ('Item Total', 'description'), ('Unit Rate', 'unit_price'), ('RATE', 'unit_price'), ('Qty.', 'quantity'), ('Quantity', 'quantity'), ('HSN/SAC', 'hsn_sac'), ('GST %', 'gst_rate'), ('Tax Rate', 'gst_rate'), ('GST Amount', 'tax_amount'), ('Tax Amount (INR)', 'tax_amount'), ('Line Total', 'line_total'), ('Value', 'line_total'), ('Discount', 'discount'), ('Discount Amount', 'line_total'), ('Sr.', null), ('Service charge', 'description'), ('Unit Price', 'unit_price'), ('Amount', 'line_total')),
n as (select key, want, row_number() over (order by key) - 1 as i from h) select c_custkey, key as header, want as column_key, want is not null and want in ('quantity', 'unit_price') as measured, cast(0.45 + 0.1 * (c_custkey % 6) as double) as confidence from customer join n on n.i = c_custkey % 20""")
def header_keys(spark, d):
    heads = sorted(["Item Description", "Product Price", "Item Total", "Unit Rate", "RATE", "Qty.", "Quantity", "HSN/SAC", "GST %", "Tax Rate", "GST Amount", "Tax Amount (INR)", "Line Total", "Value", "Discount", "Discount Amount", "Sr.", "Service charge", "Unit Price", "Amount"])
    x = V.table(spark, d, "customer").select("c_custkey", F.element_at(F.array(*map(F.lit, heads)), (F.col("c_custkey") % 20 + 1).cast("int")).alias("header"))
    seen = [F.when(F.col("c_custkey") % 6 > i, F.lit(1)) for i in range(5)]
    key = S.header_key(F.col("header"))
    return x.select("c_custkey", "header", key.alias("column_key"), F.coalesce(key.isin("quantity", "unit_price"), F.lit(False)).alias("measured"), S.item_confidence(*seen).alias("confidence"))


@query()
def heuristic_items(spark, d):
    items = V.invoice_items(spark, d)
    line = items.select(F.col("invoice_id").alias("doc_id"), F.lit(0).alias("page"), F.col("pos").alias("line_no"), F.concat("description", F.lit(" "), F.col("quantity").cast("int").cast("string"), F.lit(" "), F.col("unit_price").cast("string"), F.lit(" "), F.col("line_total").cast("string")).alias("text"))
    heads = items.select(F.col("invoice_id").alias("doc_id")).distinct().select("doc_id", F.lit(0).alias("page"), F.lit(0).alias("line_no"), F.lit("Description Qty Rate Amount").alias("text"))
    return X.heuristic_items(line.unionByName(heads))


@query("""select doc_id, string_agg(text, chr(10) || chr(12) || chr(10) order by turn) as text, round(avg(case when turn % 5 <> 4 then (turn % 10) / 10.0::double end), 6) as confidence, cast(count(*) as integer) as pages from (select conv_id as doc_id, turn, text from conversations) group by 1""")
def combine_pages(spark, d):
    x = V.table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), "text", F.when(F.col("turn") % 5 == 4, -1.0).otherwise((F.col("turn") % 10) / 10.0).alias("confidence"))
    return X.combine_pages(x)


_JOBS = """with jobs as (select event_id as job_id, ts as created_at, case event_id % 4 when 0 then 'queued' when 1 then 'processing' when 2 then 'retrying' else 'completed' end as status, ts + interval 5 minute as available_at, ts + interval 1 minute as locked_at, cast(event_id % 4 as integer) as attempts from events)"""


def _jobs(spark, d):
    k, ts = F.col("event_id"), F.col("ts").cast("timestamp_ntz")
    return V.table(spark, d, "events").select(k.alias("job_id"), ts.alias("created_at"), F.element_at(F.array(*map(F.lit, ("queued", "processing", "retrying", "completed"))), (k % 4 + 1).cast("int")).alias("status"), (ts + F.expr("interval 5 minutes")).alias("available_at"), (ts + F.expr("interval 1 minute")).alias("locked_at"), (k % 4).cast("int").alias("attempts"))


@query(_JOBS + """ select job_id, 'processing' as status, attempts + 1 as attempts from jobs where (status = 'processing' and locked_at < timestamp '2024-01-10 00:00:00' - interval 15 minute) or (status in ('queued', 'retrying') and available_at <= timestamp '2024-01-10 00:00:00') order by created_at, job_id limit 25""")
def job_claims(spark, d):
    return J.claim(_jobs(spark, d), "2024-01-10 00:00:00", 25)


@query(_JOBS + """ select job_id, case when attempts >= 3 then 'dead_letter' else 'retrying' end as status, case when attempts < 3 then cast(least(60, pow(2, attempts)) as integer) end as wait_s from jobs""")
def job_retries(spark, d):
    return J.fail(_jobs(spark, d))


@query("""with x as (select user_id as document_id, event_id as seq, event_type as payload, lag(event_type) over (partition by user_id order by event_id) as before from events) select document_id, seq, payload from x where before is null or before <> payload""")
def status_changes(spark, d):
    return J.changes(V.table(spark, d, "events").select(F.col("user_id").alias("document_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("payload")))


_STANDARD = """, x as (select i.invoice_id as id, nullif(case when i.invoice_id % 9 = 0 then '' else invoice_number end, '') as invoice_number, coalesce(nullif(case when i.invoice_id % 4 = 0 then '' else currency end, ''), 'INR') as currency from invoices i),
t as (select invoice_id, coalesce(sum(amount) filter (tax_type = 'CGST_SGST'), 0) as both_, coalesce(sum(amount) filter (tax_type = 'IGST'), 0) as igst from invoice_taxes group by 1), n as (select invoice_id, count(*) as items, count(*) filter (pos % 2 = 1 or pos % 4 <> 0) as known from invoice_items group by 1)
select id, invoice_number, currency, cast(cast(cast(both_ * 100 as bigint) + 1 as bigint) // 2 * 0.01 as decimal(18,2)) as cgst, cast(both_ - cast(cast(cast(both_ * 100 as bigint) + 1 as bigint) // 2 * 0.01 as decimal(18,2)) as decimal(18,2)) as sgst, cast(igst as decimal(18,2)) as igst, cast(items as integer) as items, cast(known as integer) as known
from x join t on t.invoice_id = id join n on n.invoice_id = id"""


@query(with_views("invoices invoice_taxes invoice_items", _STANDARD))
def standard_form(spark, d):
    from payloom.operators import standard as N

    k = F.col("invoice_id")
    taxes = V.invoice_taxes(spark, d).groupBy("invoice_id").agg(F.collect_list(F.struct("tax_type", "rate_percent", "amount")).alias("taxes"))
    seen = F.when(F.col("pos") % 4 == 0, 0.0).otherwise(0.9)
    items = V.invoice_items(spark, d).groupBy("invoice_id").agg(F.sort_array(F.collect_list(F.struct("pos", "description", F.when(F.col("pos") % 2 == 0, 0).otherwise(F.col("quantity")).cast(V.QUANTITY).alias("quantity"), "unit_price", "line_total", seen.alias("confidence")))).alias("line_items"))
    field = lambda c: F.struct(c.alias("value"))
    none = F.lit(None).cast("string")
    x = V.invoices(spark, d).join(taxes, "invoice_id").join(items, "invoice_id")
    payload = F.struct(field(F.when(k % 9 == 0, "").otherwise(F.col("invoice_number"))).alias("invoice_number"), F.col("invoice_date").cast("string").alias("invoice_date"), none.alias("due_date"), field(none).alias("po_reference"), F.when(k % 4 == 0, "").otherwise(F.col("currency")).alias("currency"), F.struct(field(none).alias("name"), field(none).alias("gstin")).alias("vendor"), "line_items", "taxes", F.col("grand_total").alias("subtotal"), F.lit(0).cast(V.MONEY).alias("discount_total"), F.lit(0).cast(V.MONEY).alias("tax_total"), "grand_total")
    out = N.standard(x.select(k.alias("id"), payload.alias("payload")))
    return out.select("id", "invoice.invoice_number", "invoice.currency", "taxes.cgst", "taxes.sgst", "taxes.igst", F.size("items").alias("items"), F.size(F.filter("items", lambda i: i["quantity"].isNotNull())).alias("known"))


@query(with_views("invoices vendors invoice_taxes", """ select i.invoice_id as doc_id, invoice_number, cast(invoice_date as varchar) as invoice_day, v.gstin, name as vendor_name, grand_total from invoices i join vendors v on v.tenant_id = i.tenant_id and v.vendor_id = i.vendor_id"""))
def extraction(spark, d):
    from payloom.operators import standard as N

    x = V.invoices(spark, d).join(V.vendors(spark, d), ["tenant_id", "vendor_id"])
    text = F.concat_ws("\n", F.lit("TAX INVOICE"), F.concat(F.lit("Invoice No: "), "invoice_number"), F.concat(F.lit("Invoice Date: "), F.date_format("invoice_date", "dd/MM/yyyy")), F.concat(F.lit("GSTIN: "), "gstin"), F.lit("Seller:"), F.col("name"), F.lit("Bill To: someone"), F.lit("Subtotal 1.00"), F.concat(F.lit("Grand Total: ₹ "), F.format_number("grand_total", 2)))
    out = N.extract_text(x.select(F.col("invoice_id").alias("doc_id"), text.alias("text")))
    return out.select("doc_id", "invoice_number", F.col("invoice_day").cast("string").alias("invoice_day"), "gstin", "vendor_name", "grand_total")


_VARIANTS = """, x as (select i.invoice_id as k, i.invoice_id % 3 as v, v.name as name from invoices i join vendors v on v.tenant_id = i.tenant_id and v.vendor_id = i.vendor_id)
select k as doc_id, case when v = 0 then 'Messrs ' || name else name end as vendor_name, case when v = 0 then 'Buyer ' || k end as buyer_name, case when v = 0 then k || ' Road' end as billing_address, case v when 0 then 'IGST' when 1 then 'CGST_SGST' else case when k > 0 then 'VAT' end end as tax_type,
cast(case v when 0 then k when 1 then 2 * k + 0.5 else k end as decimal(18,2)) as tax_total, cast(case v when 1 then 5 when 2 then k + 0.25 end as decimal(18,2)) as subtotal, cast(case v when 0 then k + 2.5 when 1 then 3 * k + 100 else 2 * k + 0.25 end as decimal(18,2)) as grand_total from x"""


@query(with_views("invoices vendors", _VARIANTS))
def extraction_variants(spark, d):
    """Texts without the usual labels: names in the header, after tax numbers or beside the label; totals on the line after
    the label, by words of a total, and with the tax left out; three ways to state taxes; subtotals from items."""
    from payloom.operators import standard as N

    k = F.col("invoice_id")
    n, lines = k.cast("string"), lambda *c: F.concat_ws("\n", *[x if not isinstance(x, str) else F.lit(x) for x in c])
    money = lambda amount, cents: F.concat(amount.cast("string"), F.lit(cents))
    x = V.invoices(spark, d).join(V.vendors(spark, d), ["tenant_id", "vendor_id"])
    header = lines("TAX INVOICE", F.concat(F.lit("Messrs "), "name"), F.concat(F.lit("Bill To: Buyer "), n), F.concat(n, F.lit(" Road")), "", "Ship To:", "Store", "", "TOTAL:", F.concat(money(k + 1, ".50 "), money(k + 2, ".50")), F.concat(F.lit("18% IGST ₹"), money(k, ".00")))
    numbers = lines("Seller:", "GSTIN: 29ABCDE1234F1Z5", F.concat(F.lit("* "), "name"), "", "Subtotal 5", F.concat(F.lit("CGST @ 9% "), money(k, ".00")), F.concat(F.lit("SGST @ 9% "), money(k, ".50")), F.concat(F.lit("Total due within thirty days of receipt: "), money(k * 3 + 100, ".00")))
    beside = lines(F.concat(F.lit("Sold By : "), "name"), "Invoice Value:", F.concat(F.lit("₹ "), money(k, ".25")), F.concat(F.lit("VAT: "), money(k, ".00")))
    texts = x.select(k.alias("doc_id"), F.when(k % 3 == 0, header).when(k % 3 == 1, numbers).otherwise(beside).alias("text"))
    items = V.invoices(spark, d).where(k % 3 == 2).select(k.alias("doc_id"), money(k, ".25").cast(V.MONEY).alias("line_total"))
    out = N.extract_text(texts, items)
    return out.select("doc_id", "vendor_name", F.col("buyer.name").alias("buyer_name"), "buyer.billing_address", F.get("taxes", F.lit(0))["tax_type"].alias("tax_type"), "tax_total", "subtotal", "grand_total")
