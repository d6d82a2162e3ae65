"""Accounts-payable entities over the star-schema tables: as DataFrames, and as SQL for oracles.

Every entity bears ``tenant_id`` first. ``AS_OF`` stands for today, so that results don't change from day to day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

AS_OF = "2001-06-30"
#: The moment that stands for now where ingestion is looked at.
NOW = "2024-01-25 12:00:00"
MONEY, QUANTITY, RATE = DecimalType(18, 2), DecimalType(18, 4), DecimalType(8, 3)
CLOSED = ("paid", "rejected", "duplicate")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def match_key(text) -> F.Column:
    """Lower-case letters and digits only; a sharp s counts as ss."""
    return F.regexp_replace(F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("ß"), F.lit("ss"))), "[^a-z0-9]+", "")


def money(x) -> F.Column:
    return x.cast(MONEY)


def vendors(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = F.broadcast(table(spark, sf_dir, "nation"))
    c = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    key = F.col("c_custkey")
    gstin = F.concat(F.lpad((F.col("n_nationkey") + 1).cast("string"), 2, "0"), F.lit("AAAPL"), F.lpad((key % 10000).cast("string"), 4, "0"), F.lit("C1Z"), (key % 10).cast("string"))
    return c.select(
        F.concat(F.lit("t"), (key % 4).cast("string")).alias("tenant_id"), key.alias("vendor_id"), F.col("c_name").alias("name"), match_key(F.col("c_name")).alias("normalized_name"),
        F.col("n_name").alias("state"), F.when(key % 10 != 0, gstin).alias("gstin"), F.concat(F.lit("AC"), key.cast("string")).alias("bank_account"),
    )


VENDORS = """vendors as (select 't' || (c_custkey % 4) as tenant_id, c_custkey as vendor_id, c_name as name, regexp_replace(lower(c_name), '[^a-z0-9]+', '', 'g') as normalized_name, n_name as state,
  case when c_custkey % 10 <> 0 then lpad(cast(n_nationkey + 1 as varchar), 2, '0') || 'AAAPL' || lpad(cast(c_custkey % 10000 as varchar), 4, '0') || 'C1Z' || (c_custkey % 10) end as gstin, 'AC' || c_custkey as bank_account
  from customer join nation on c_nationkey = n_nationkey)"""


def invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, key, vendor = table(spark, sf_dir, "orders"), F.col("o_orderkey"), F.col("o_custkey")
    state = F.col("o_orderstatus")
    status = F.when(key % 23 == 0, "rejected").when(key % 29 == 0, "duplicate").when(key % 31 == 0, "on_hold").when(state == "F", "paid").when(state == "O", "awaiting_payment").otherwise("review_required")
    score = (key * 7 % 101).cast("int")
    total = money(F.col("o_totalprice"))
    return o.select(
        F.concat(F.lit("t"), (vendor % 4).cast("string")).alias("tenant_id"), key.alias("invoice_id"), vendor.alias("vendor_id"), F.concat(F.lit("INV-"), vendor.cast("string"), F.lit("-"), (key % 7).cast("string")).alias("invoice_number"),
        F.when(key % 5 != 0, F.concat(F.lit("PO-"), key.cast("string"))).alias("po_number"), F.to_date("o_orderdate").alias("invoice_date"), F.date_add(F.to_date("o_orderdate"), 30).alias("due_date"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("created_at"), status.alias("status"), score.alias("risk_score"), F.when(score >= 50, "high").when(score >= 20, "medium").otherwise("low").alias("risk_level"),
        F.when(key % 10 == 0, "USD").otherwise("INR").alias("currency"), total.alias("grand_total"), F.when(status == "paid", money(F.lit(0))).otherwise(total).alias("outstanding_amount"),
        F.when(key % 13 != 0, (key % 101) / 101.0).alias("confidence"),
    )


INVOICES = """invoices as (select *, case when risk_score >= 50 then 'high' when risk_score >= 20 then 'medium' else 'low' end as risk_level, case when status = 'paid' then cast(0 as decimal(18,2)) else grand_total end as outstanding_amount from (
  select 't' || (o_custkey % 4) as tenant_id, o_orderkey as invoice_id, o_custkey as vendor_id, 'INV-' || o_custkey || '-' || (o_orderkey % 7) as invoice_number, case when o_orderkey % 5 <> 0 then 'PO-' || o_orderkey end as po_number,
  cast(o_orderdate as date) as invoice_date, cast(o_orderdate as date) + 30 as due_date, o_orderdate as created_at,
  case when o_orderkey % 23 = 0 then 'rejected' when o_orderkey % 29 = 0 then 'duplicate' when o_orderkey % 31 = 0 then 'on_hold' when o_orderstatus = 'F' then 'paid' when o_orderstatus = 'O' then 'awaiting_payment' else 'review_required' end as status,
  cast(o_orderkey * 7 % 101 as integer) as risk_score, case when o_orderkey % 10 = 0 then 'USD' else 'INR' end as currency, cast(o_totalprice as decimal(18,2)) as grand_total, case when o_orderkey % 13 <> 0 then (o_orderkey % 101) / 101.0::double end as confidence from orders) x)"""

_LINE_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def invoice_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy(*_LINE_ORDER)
    price, rate = money(F.col("l_extendedprice")), (F.col("l_tax") * 100).cast(RATE)
    x = table(spark, sf_dir, "lineitem").withColumn("pos", F.row_number().over(w))
    return x.select(
        F.col("l_orderkey").alias("invoice_id"), "pos", F.concat(F.lit("Part "), (F.col("l_partkey") % 20).cast("string")).alias("description"), F.col("l_quantity").cast(QUANTITY).alias("quantity"),
        money(F.expr("cast(round(l_extendedprice * 100) as bigint) div cast(l_quantity as bigint)").cast(MONEY) * F.lit("0.01").cast("decimal(3,2)")).alias("unit_price"), rate.alias("gst_rate"), money(price * F.col("l_discount").cast("decimal(4,2)")).alias("discount"), price.alias("line_total"),
        F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("line_status"),
    )


INVOICE_ITEMS = f"""invoice_items as (select l_orderkey as invoice_id, cast(row_number() over (partition by l_orderkey order by {", ".join(_LINE_ORDER)}) as integer) as pos, 'Part ' || (l_partkey % 20) as description, cast(l_quantity as decimal(18,4)) as quantity,
  cast(cast(cast(round(l_extendedprice * 100) as bigint) // cast(l_quantity as bigint) as decimal(18,2)) * cast(0.01 as decimal(3,2)) as decimal(18,2)) as unit_price, cast(l_tax * 100 as decimal(8,3)) as gst_rate, cast(cast(l_extendedprice as decimal(18,2)) * cast(l_discount as decimal(4,2)) as decimal(18,2)) as discount,
  cast(l_extendedprice as decimal(18,2)) as line_total, l_returnflag as flag, l_linestatus as line_status from lineitem)"""


def invoice_taxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem")
    kind = F.when(F.col("l_returnflag") == "A", "CGST_SGST").when(F.col("l_returnflag") == "N", "IGST").otherwise("CESS")
    net = money(F.col("l_extendedprice")) - money(money(F.col("l_extendedprice")) * F.col("l_discount").cast("decimal(4,2)"))
    return x.select(F.col("l_orderkey").alias("invoice_id"), kind.alias("tax_type"), (F.col("l_tax") * 100).cast(RATE).alias("rate_percent"), money(money(net) * F.col("l_tax").cast("decimal(4,2)")).alias("amount"))


INVOICE_TAXES = """invoice_taxes as (select l_orderkey as invoice_id, case l_returnflag when 'A' then 'CGST_SGST' when 'N' then 'IGST' else 'CESS' end as tax_type, cast(l_tax * 100 as decimal(8,3)) as rate_percent,
  cast(cast(cast(l_extendedprice as decimal(18,2)) - cast(cast(l_extendedprice as decimal(18,2)) * cast(l_discount as decimal(4,2)) as decimal(18,2)) as decimal(18,2)) * cast(l_tax as decimal(4,2)) as decimal(18,2)) as amount from lineitem)"""


def purchase_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    vendor = F.when(key % 11 == 0, F.col("o_custkey") + 1).when(key % 17 != 0, F.col("o_custkey"))
    total = F.when(key % 6 == 0, money(F.col("o_totalprice")) - F.lit(50)).otherwise(money(F.col("o_totalprice")))
    return o.where((key % 5 != 0) & (key % 19 != 0)).select(
        F.concat(F.lit("t"), (F.col("o_custkey") % 4).cast("string")).alias("tenant_id"), key.alias("po_id"), F.concat(F.lit("po-"), key.cast("string")).alias("number"), vendor.alias("vendor_id"),
        F.when(key % 14 == 0, "USD").when(key % 10 == 0, "usd").when(key % 3 != 0, "INR").alias("currency"), money(total).alias("total"),
    )


PURCHASE_ORDERS = """purchase_orders as (select 't' || (o_custkey % 4) as tenant_id, o_orderkey as po_id, 'po-' || o_orderkey as number, case when o_orderkey % 11 = 0 then o_custkey + 1 when o_orderkey % 17 <> 0 then o_custkey end as vendor_id,
  case when o_orderkey % 14 = 0 then 'USD' when o_orderkey % 10 = 0 then 'usd' when o_orderkey % 3 <> 0 then 'INR' end as currency, cast(case when o_orderkey % 6 = 0 then cast(o_totalprice as decimal(18,2)) - 50 else cast(o_totalprice as decimal(18,2)) end as decimal(18,2)) as total
  from orders where o_orderkey % 5 <> 0 and o_orderkey % 19 <> 0)"""


def purchase_order_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, key = invoice_items(spark, sf_dir), F.col("invoice_id")
    quantity = F.when((key + F.col("pos")) % 8 == 0, F.col("quantity") + 2).when((key + F.col("pos")) % 9 == 0, F.greatest(F.lit(1), F.col("quantity") - 1)).otherwise(F.col("quantity"))
    rate = F.when(key % 12 == 0, F.col("gst_rate") + 1).when(key % 15 != 0, F.col("gst_rate"))
    keep = (key % 5 != 0) & (key % 19 != 0) & ((key + 3 * F.col("pos")) % 16 != 0)
    return x.where(keep).select(
        key.alias("po_id"), "pos", F.upper("description").alias("description"), quantity.cast(QUANTITY).alias("quantity"), F.when((key + F.col("pos")) % 21 == 0, F.col("unit_price") + 1).otherwise(F.col("unit_price")).cast(MONEY).alias("unit_price"),
        rate.cast(RATE).alias("tax_rate"), "flag",
    )


PURCHASE_ORDER_ITEMS = """purchase_order_items as (select invoice_id as po_id, pos, upper(description) as description,
  cast(case when (invoice_id + pos) % 8 = 0 then quantity + 2 when (invoice_id + pos) % 9 = 0 then greatest(1, quantity - 1) else quantity end as decimal(18,4)) as quantity,
  cast(case when (invoice_id + pos) % 21 = 0 then unit_price + 1 else unit_price end as decimal(18,2)) as unit_price, cast(case when invoice_id % 12 = 0 then gst_rate + 1 when invoice_id % 15 <> 0 then gst_rate end as decimal(8,3)) as tax_rate, flag
  from invoice_items where invoice_id % 5 <> 0 and invoice_id % 19 <> 0 and (invoice_id + 3 * pos) % 16 <> 0)"""


def goods_receipt_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = purchase_order_items(spark, sf_dir).where("flag <> 'R' and po_id % 4 = 0")
    return x.select("po_id", "pos", F.when((F.col("po_id") + F.col("pos")) % 7 == 0, F.col("quantity") + 3).when((F.col("po_id") + F.col("pos")) % 10 == 0, F.col("quantity") - 1).otherwise(F.col("quantity")).cast(QUANTITY).alias("quantity_received"))


GOODS_RECEIPT_ITEMS = """goods_receipt_items as (select po_id, pos, cast(case when (po_id + pos) % 7 = 0 then quantity + 3 when (po_id + pos) % 10 = 0 then quantity - 1 else quantity end as decimal(18,4)) as quantity_received from purchase_order_items where flag <> 'R' and po_id % 4 = 0)"""


def payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = table(spark, sf_dir, "lineitem")
    return x.select(F.col("l_orderkey").alias("invoice_id"), money(money(F.col("l_extendedprice")) * F.lit("0.50").cast("decimal(4,2)")).alias("amount"), F.when(F.col("l_linestatus") == "F", "confirmed").otherwise("void").alias("status"))


PAYMENTS = """payments as (select l_orderkey as invoice_id, cast(cast(l_extendedprice as decimal(18,2)) * cast(0.50 as decimal(4,2)) as decimal(18,2)) as amount, case when l_linestatus = 'F' then 'confirmed' else 'void' end as status from lineitem)"""


def ingested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as the ingestion pipeline sees them."""
    e, kind, key = table(spark, sf_dir, "events"), F.col("event_type"), F.col("event_id")
    status = F.when(key % 11 == 0, "failed").when(key % 13 == 0, "processing").otherwise("completed")
    return e.select(
        F.concat(F.lit("t"), (F.col("user_id") % 4).cast("string")).alias("tenant_id"), key.alias("document_id"), F.col("ts").cast("timestamp_ntz").alias("created_at"), status.alias("status"), F.when(key % 17 != 0, F.concat(F.lit("vendor "), (F.col("user_id") % 40).cast("string"))).alias("vendor_name"),
        F.when(key % 7 != 0, (key % 101) / 101.0).alias("confidence"), F.when(key % 9 != 0, (key * 37 % 5000).cast("double")).alias("processing_ms"), F.when(key % 8 == 0, "vlm_fallback").when(key % 15 == 0, "local_vlm").otherwise("ocr_rule").alias("source"),
        F.when(key % 19 != 0, money(key * 31 % 100000 / 100)).alias("grand_total"), F.when(key % 6 == 0, "USD").otherwise("INR").alias("currency"), F.when(key % 8 == 0, (key % 50).cast("decimal(12,8)") / 1000).cast("decimal(12,8)").alias("cost"), kind.alias("kind"),
    )


INGESTED = """ingested as (select 't' || (user_id % 4) as tenant_id, event_id as document_id, ts as created_at, case when event_id % 11 = 0 then 'failed' when event_id % 13 = 0 then 'processing' else 'completed' end as status,
  case when event_id % 17 <> 0 then 'vendor ' || (user_id % 40) end as vendor_name, case when event_id % 7 <> 0 then (event_id % 101) / 101.0::double end as confidence, case when event_id % 9 <> 0 then cast(event_id * 37 % 5000 as double) end as processing_ms,
  case when event_id % 8 = 0 then 'vlm_fallback' when event_id % 15 = 0 then 'local_vlm' else 'ocr_rule' end as source, case when event_id % 19 <> 0 then cast((event_id * 31 % 100000) / 100.0::double as decimal(18,2)) end as grand_total,
  case when event_id % 6 = 0 then 'USD' else 'INR' end as currency, case when event_id % 8 = 0 then cast((event_id % 50) / 1000.0::double as decimal(12,8)) end as cost, event_type as kind from events)"""

_SQL = {"vendors": VENDORS, "invoices": INVOICES, "invoice_items": INVOICE_ITEMS, "invoice_taxes": INVOICE_TAXES, "purchase_orders": PURCHASE_ORDERS, "purchase_order_items": PURCHASE_ORDER_ITEMS, "goods_receipt_items": GOODS_RECEIPT_ITEMS, "payments": PAYMENTS, "ingested": INGESTED}
_NEEDS = {"purchase_order_items": ["invoice_items"], "goods_receipt_items": ["invoice_items", "purchase_order_items"]}


def with_views(names: str, body: str) -> str:
    """SQL of ``body`` after the definitions of the entities that it names; ``body`` may go on with definitions of its own."""
    wanted = [n for v in names.split() for n in [*_NEEDS.get(v, []), v]]
    return "with " + ",\n".join(_SQL[n] for n in dict.fromkeys(wanted)) + body
