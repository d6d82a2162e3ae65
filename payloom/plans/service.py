"""Queries over lists, contexts, readings, regions, edits and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from payloom.functions import scalar as S
from payloom.operators import extract as X
from payloom.operators import rules as R
from payloom.operators import service as Z
from payloom.operators import standard as N
from payloom.plans.register import query
from payloom.sources import views as V
from payloom.sources.views import with_views


@query("""select c_nationkey as batch_id, count(case when c_custkey % 3 <> 0 then 1 end) as files, case when count(case when c_custkey % 3 <> 0 then 1 end) = 0 then 'no files' when count(case when c_custkey % 3 <> 0 then 1 end) > 25 then 'too many files' end as rejected from customer group by 1""")
def upload_batches(spark, d):
    return Z.upload_batches(V.table(spark, d, "customer").select(F.col("c_nationkey").alias("batch_id"), F.when(F.col("c_custkey") % 3 != 0, F.col("c_name")).alias("filename")))


@query(with_views("invoices", " select invoice_id, invoice_number, grand_total from invoices where tenant_id = 't1' and invoice_id = (select max(invoice_id) from invoices where tenant_id = 't1')"))
def invoice_lookup(spark, d):
    i = V.invoices(spark, d)
    last = i.where("tenant_id = 't1'").agg(F.max("invoice_id")).first()[0]
    return Z.point_lookup(i, "t1", "invoice_id", last).select("invoice_id", "invoice_number", "grand_total")


_BOXES = "w as (select p_size as doc_id, cast(p_partkey % 3 as integer) as page, p_name as text, cast(p_partkey * 37 % 1000 as integer) as x, cast(p_partkey * 11 % 400 as integer) as y from part)"


def _boxes(spark, d):
    k = F.col("p_partkey")
    return V.table(spark, d, "part").select(F.col("p_size").alias("doc_id"), (k % 3).cast("int").alias("page"), F.col("p_name").alias("text"), (k * 37 % 1000).cast("int").alias("x"), (k * 11 % 400).cast("int").alias("y"), F.lit(60).alias("width"), F.lit(10).alias("height"))


@query(f"with {_BOXES} select *, cast(row_number() over (partition by doc_id, page order by y, x, text) - 1 as integer) as place from w")
def reading_order(spark, d):
    return Z.reading_order(_boxes(spark, d)).drop("width", "height")


@query(f"with {_BOXES}, o as (select *, row_number() over (partition by doc_id order by page, y, x, text) as n from w) select doc_id, substr(string_agg(text, chr(10) order by n), 1, 50) as context from o where n <= 3 group by 1")
def prompt_context(spark, d):
    return Z.context(_boxes(spark, d), 3, 50)


@query(f"with {_BOXES}, s as (select doc_id, page, case when x + 30 < 500 then 'left' else 'right' end as side, y, string_agg(text, ' ' order by x, text) as text from w group by 1, 2, 3, 4), o as (select doc_id, page, side, cast(row_number() over (partition by doc_id, page, side order by y) - 1 as integer) as line_no, text from s) select * from o where line_no < 15")
def column_lines(spark, d):
    return Z.side_lines(_boxes(spark, d), 1000)


@query(f"with {_BOXES} select doc_id, page, text, round(x / 1000, 6) as x0, round(least(1, (x + 60) / 1000), 6) as x1 from w where x < 700 and x + 60 > 200 and y < 300 and y + 10 > 50")
def region_words(spark, d):
    w = X.overlapping(_boxes(spark, d), 200, 50, 700, 300)
    box = N.page_box(F.col("x").cast("double"), F.col("y").cast("double"), F.col("width"), F.col("height"), F.lit(1000.0), F.lit(400.0))
    return w.withColumn("b", box).select("doc_id", "page", "text", F.round("b.x0", 6).alias("x0"), F.round("b.x1", 6).alias("x1"))


@query("""with l as (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) as line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as i from documents), f as (select doc_id, trim(line, ' ') as line, min(i) as i from l where trim(line, ' ') <> '' group by 1, 2)
select doc_id, count(*) as lines, sha256(string_agg(line, chr(10) order by i)) as digest from f group by 1""")
def distinct_lines(spark, d):
    x = V.table(spark, d, "documents").withColumn("l", Z.distinct_lines(F.coalesce("text", F.lit("")))).where(F.size("l") > 0)
    return x.select("doc_id", F.size("l").cast("long").alias("lines"), F.sha2(F.array_join("l", "\n"), 256).alias("digest"))


@query(with_views("purchase_orders vendors purchase_order_items goods_receipt_items", """, i as (select po_id, count(*) as lines, sum(quantity) as ordered from purchase_order_items group by 1), r as (select po_id, count(distinct pos) as received_lines, sum(quantity_received) as received from goods_receipt_items group by 1)
select p.po_id, v.name as vendor_name, cast(lines as integer) as lines, cast(ordered as decimal(18,4)) as ordered, cast(received_lines as integer) as received_lines, cast(received as decimal(18,4)) as received from purchase_orders p left join vendors v on v.tenant_id = p.tenant_id and v.vendor_id = p.vendor_id left join i on i.po_id = p.po_id left join r on r.po_id = p.po_id"""))
def purchase_order_view(spark, d):
    x = Z.purchase_order_view(V.purchase_orders(spark, d), V.vendors(spark, d), V.purchase_order_items(spark, d), V.goods_receipt_items(spark, d))
    total = lambda a, f: F.aggregate(a, F.lit(0).cast("decimal(18,4)"), lambda s, i: (s + i[f]).cast("decimal(18,4)"))
    n = lambda a: F.when(F.col(a).isNotNull(), F.size(a))
    return x.select("po_id", "vendor_name", n("items").alias("lines"), total("items", "quantity").alias("ordered"), n("receipts").alias("received_lines"), total("receipts", "received").alias("received"))


@query(with_views("vendors", " select tenant_id, vendor_id, name, cast(row_number() over (partition by tenant_id order by name, vendor_id) as integer) as place from vendors"))
def vendor_directory(spark, d):
    return Z.directory(V.vendors(spark, d)).select("tenant_id", "vendor_id", "name", "place")


@query("""select user_id as document_id, event_id as seq, event_type as event, cast(row_number() over (partition by user_id order by ts, event_id) as integer) as place from events""")
def document_timeline(spark, d):
    x = V.table(spark, d, "events").select(F.col("user_id").alias("document_id"), F.col("ts").alias("at"), F.col("event_id").alias("seq"), F.col("event_type").alias("event"))
    return Z.timeline(x).drop("at")


@query("""select doc_id as job_id, 'queued' as status, 0 as attempts, 'queued' as event from documents""")
def job_enqueue(spark, d):
    jobs, events = Z.enqueue(V.table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("at")))
    return jobs.join(events.withColumnRenamed("document_id", "job_id"), "job_id").select("job_id", "status", "attempts", "event")


@query(with_views("ingested", " select status, source, count(*) as documents, count(*) filter (processing_ms <= 100) as le_100, count(*) filter (processing_ms <= 500) as le_500, count(*) filter (processing_ms <= 1000) as le_1000, count(*) filter (processing_ms <= 2500) as le_2500, count(processing_ms) as timed from ingested group by 1, 2"))
def processing_metrics(spark, d):
    return Z.processing_metrics(V.ingested(spark, d))


@query("""with n as (select p_partkey, cast(p_size * cast(p_retailprice as decimal(10,2)) as decimal(18,2)) as subtotal from part), h as (select *, cast((cast(subtotal * 100 as bigint) * 18 + 100) // 200 * cast(0.01 as decimal(3,2)) as decimal(18,2)) as cgst from n) select p_partkey, subtotal, cgst, cgst as sgst, cast(subtotal + cgst + cgst as decimal(18,2)) as grand_total from h""")
def label_amounts(spark, d):
    a = Z.label_amounts(F.col("p_size"), F.col("p_retailprice").cast("decimal(10,2)"), F.lit(18))
    return V.table(spark, d, "part").select("p_partkey", a.alias("a")).select("p_partkey", "a.*")


@query("""with q as (select c_custkey, ['When is it due?', 'What GST charges are there?', 'Anything suspicious?', 'Is it a duplicate?', 'What is the total?', 'Who is the vendor?', 'Hello'][cast(c_custkey % 7 + 1 as integer)] as question from customer)
select c_custkey, question, ['due_date', 'tax', 'risk', 'duplicate', 'total', 'vendor', 'summary'][cast(c_custkey % 7 + 1 as integer)] as topic, case when c_custkey % 2 = 0 then substr('payable at ' || c_custkey, 1, 80) end as terms from q""")
def question_topics(spark, d):
    asked = F.array(*map(F.lit, ("When is it due?", "What GST charges are there?", "Anything suspicious?", "Is it a duplicate?", "What is the total?", "Who is the vendor?", "Hello")))
    k = F.col("c_custkey")
    x = V.table(spark, d, "customer").select(k, F.element_at(asked, (k % 7 + 1).cast("int")).alias("question"), F.concat(F.when(k % 2 == 0, F.lit("Payment Terms: ")).otherwise(F.lit("none ")), F.lit("payable at "), k.cast("string")).alias("line"))
    return x.select("c_custkey", "question", Z.topic(F.col("question")).alias("topic"), Z.labelled_text(F.col("line"), "payment terms").alias("terms"))


@query("""select p_partkey, case when p_size % 2 = 0 then cast(1000 + p_size as varchar) else '' end as hsn, case p_partkey % 4 when 0 then 'INR' when 1 then 'USD' when 2 then 'EUR' else 'INR' end as currency, round(case when p_size % 5 = 0 then 0.0::double else (0.5 + p_size / 100) / 2 end + case when p_size % 5 = 0 then 0.0::double else 0.25 end, 6) as mean,
case when p_size % 3 = 0 then p_size / 100 else 0.0::double end as share, case when p_size % 4 = 0 then 'first' else 'second' end as reading, p_size % 4 <> 0 as doubtful from part""")
def reading_rules(spark, d):
    k, n = F.col("p_partkey"), F.col("p_size")
    money = F.element_at(F.array(*map(F.lit, ("₹ 5", "$ 5", "€ 5", "5"))), (k % 4 + 1).cast("int"))
    shares = F.when(n % 5 == 0, F.array(F.lit(None).cast("double"))).otherwise(F.array(F.lit(0.5), F.lit(0.5) + n / 100, F.lit(None).cast("double")))
    read = lambda t, c: F.struct(F.lit(t).alias("text"), c.alias("confidence"))
    best = X.ocr_fallback(read("first", F.when(n % 4 == 0, 0.9).otherwise(0.2)), read("second", F.lit(0.9)))
    score = X.score(F.when(n % 3 == 0, F.when(n > 1, n.cast("double")).otherwise(n / 100)).otherwise(-1.0))
    return V.table(spark, d, "part").select(
        "p_partkey", S.hsn(F.when(n % 2 == 0, F.concat((n + 1000).cast("string"), F.lit(" x"))).otherwise("none")).alias("hsn"), S.currency(money).alias("currency"), F.round(S.mean_confidence(shares), 6).alias("mean"),
        score.alias("share"), best["text"].alias("reading"), X.needs_verification(F.when(n % 4 == 0, 0.95).otherwise(0.4), F.lit(False), F.lit(False)).alias("doubtful"),
    )


@query("""with c as (select p_partkey as table_id, p_size % 3 as r, p_size % 2 + 1 as n, p_name from part), x as (select table_id, unnest(range(r, r + n)) as r, unnest(range(0, 2)) as c2, p_name from c), y as (select c.table_id, a.r, b.c, c.p_name as text from c, lateral (select unnest(range(c.r, c.r + c.n)) as r) a, lateral (select unnest([0, 1]) as c) b) select table_id, cast(r as integer) as r, cast(c as integer) as c, text from y""")
def table_spans(spark, d):
    x = V.table(spark, d, "part").select(F.col("p_partkey").alias("table_id"), F.lit(0).alias("seq"), (F.col("p_size") % 3).alias("row"), F.lit(0).alias("col"), (F.col("p_size") % 2 + 1).alias("rows"), F.lit(2).alias("cols"), F.col("p_name").alias("text"))
    return X.explode_spans(x)


@query(with_views("invoice_items", " select invoice_id as id, cast(row_number() over (partition by invoice_id order by pos) as integer) as pos, description, cast(greatest(0, quantity * unit_price - discount) as decimal(18,2)) as taxable_value from invoice_items"))
def item_projection(spark, d):
    items = V.invoice_items(spark, d).groupBy("invoice_id").agg(F.sort_array(F.collect_list(F.struct("pos", "description", "quantity", "unit_price", "discount"))).alias("items"))
    return N.project_items(items.withColumnRenamed("invoice_id", "id"))


@query("""select event_id, event_id % 3 <> 0 as accepted, case when event_id % 3 = 0 then 'field is not editable' end as reason, case when event_id % 3 <> 0 then event_type end as value from events""")
def field_edits(spark, d):
    k = F.col("event_id")
    x = V.table(spark, d, "events").select("event_id", F.when(k % 3 == 0, "id").when(k % 3 == 1, "vendor.name").otherwise("currency").alias("path"), "event_type")
    good, bad = R.edits(x, ("vendor.name", "currency"))
    payload = F.struct(F.struct(F.lit("old").alias("name")).alias("vendor"))
    done = good.select("event_id", F.lit(True).alias("accepted"), F.lit(None).cast("string").alias("reason"), R.set_path(payload, "vendor.name", F.col("event_type"))["vendor"]["name"].alias("value"))
    return done.unionByName(bad.select("event_id", F.lit(False).alias("accepted"), "reason", F.lit(None).cast("string").alias("value")))


@query(with_views("invoices", """ select invoice_id, cast(least(6, invoice_id % 9) as integer) as named, invoice_id % 9 as held from invoices"""))
def top_signals(spark, d):
    s = F.when(F.col("invoice_id") % 9 > 0, F.sequence(F.lit(1).cast("long"), F.col("invoice_id") % 9)).otherwise(F.array().cast("array<bigint>"))
    pruned = Z.prune(F.struct(s.alias("signals"), F.lit("x").alias("raw_text")), ("raw_text",))
    return V.invoices(spark, d).select("invoice_id", pruned.alias("p")).select("invoice_id", F.size(Z.top_signals(F.col("p.signals"))).alias("named"), F.size("p.signals").cast("long").alias("held"))
