"""Worked examples of the rules, and properties of the set-based rewrites."""

import datetime
import random
from decimal import Decimal

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from payloom.functions import scalar as S
from payloom.operators import evaluate as E
from payloom.operators import extract as X
from payloom.operators import matching as M
from payloom.operators import readmodels as R
from payloom.operators import rules


def one(spark, column, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return row.select(column).first()[0]


def test_keys_and_tax_identifiers(spark):
    assert one(spark, S.match_key(F.col("x")), x=" ABC Technologies Pvt. Ltd. ") == "abctechnologiespvtltd"
    assert one(spark, S.match_key(F.col("x")), x="INV/2026-1024") == "inv20261024"
    assert one(spark, S.match_key(F.col("x")), x="Straße") == "strasse"
    assert one(spark, S.gstin(F.col("x")), x="o7aapfu l939f1zv") == "07AAPFU1939F1ZV"
    for text, sound in (("27AAPFU0939F1ZV", True), ("29AAGCB7383J1Z4", True), ("27ABCDE1234F1Z5", False), ("27", False)):
        assert one(spark, S.gstin_checksum(F.col("x")), x=text) is sound


def test_numbers(spark):
    for text, value in (("1.234,56", "1234.56"), ("1,234.56", "1234.56"), ("1,23,456.00", "123456.00"), ("12,50", "12.50"), ("1,234", "1234.00"), ("1,234,56", "0.00"), ("1,234,567", "1234567.00"), ("", "0.00"), ("-", "0.00"), ("1 234.50", "1234.50")):
        assert one(spark, S.number(F.col("x")), x=text) == Decimal(value), text
    assert one(spark, S.number(F.col("x"), None), x="abc") is None
    assert one(spark, S.percent(F.col("x")), x="GST 18 %") == Decimal("18.000")
    assert one(spark, S.display_amount(F.lit("1000.00").cast("decimal(18,2)"))) == "1,000"


def test_dates(spark):
    for text, day in (("12 Aug 2026", (2026, 8, 12)), ("2026/08/12", (2026, 8, 12)), ("31/08/2026", (2026, 8, 31)), ("01/13/2026", (2026, 1, 13)), ("31/02/2026", None)):
        assert one(spark, S.invoice_date(F.col("x")), x=text) == (datetime.date(*day) if day else None), text
    assert one(spark, S.date_tail(F.col("x")), x="2026/08/12") == datetime.date(2026, 12, 8)  # day first: the two disagree


def test_fingerprint(spark):
    args = [F.lit("27abcde1234f1z5"), F.lit("INV/100"), F.lit("2026-08-12").cast("date"), F.lit("10620").cast("decimal(18,2)")]
    found = one(spark, S.fingerprint(*args))
    assert len(found) == 64
    assert one(spark, S.fingerprint(*args[:2], F.lit("2026-08-13").cast("date"), args[3])) != found
    assert one(spark, S.fingerprint(F.lit(None).cast("string"), *args[1:])) is None


def test_search_terms():
    assert R.search_amount("₹50,000") == "50000" and R.search_amount("Rs. 12.5") == "12.5" and R.search_amount("12 boxes") is None
    assert R.search_date("15 Aug 2026") == datetime.date(2026, 8, 15) and R.search_date("15.8") is None
    assert R.compact_gstin("GSTIN 27-AA") == "27aa"


def test_validation_examples(spark):
    base = dict(invoice_id=1, invoice_number="N", vendor_name="V", grand_total=Decimal("10620"), subtotal=Decimal("10000"), discount_total=Decimal("1000"), tax_sum=Decimal("1620"), tax_total=None, shipping=None, invoice_date=datetime.date(2000, 8, 1), due_date=datetime.date(2000, 8, 31), gstin=None, pan=None, has_igst=False, has_split=True, currency="INR")
    cases = [base, base | dict(invoice_id=2, grand_total=Decimal("10820")), base | dict(invoice_id=3, due_date=datetime.date(2000, 7, 1), pan="BADPAN"), base | dict(invoice_id=4, invoice_number=" ", tax_total=Decimal("1622"), gstin="27ABCDE1234F1Z5", currency=None)]
    schema = "invoice_id long, invoice_number string, vendor_name string, grand_total decimal(18,2), subtotal decimal(18,2), discount_total decimal(18,2), tax_sum decimal(18,2), tax_total decimal(18,2), shipping decimal(18,2), invoice_date date, due_date date, gstin string, pan string, has_igst boolean, has_split boolean, currency string"
    failed = {(r.invoice_id, r.rule) for r in rules.validations(spark.createDataFrame([tuple(c.values()) for c in cases], schema)).where("not passed").collect()}
    assert failed == {(2, "arithmetic"), (3, "date_order"), (3, "pan"), (4, "required_fields"), (4, "tax_total"), (4, "gstin"), (4, "currency")}


def test_workflow(spark):
    log = spark.createDataFrame([(1, i, a) for i, a in enumerate(["hold", "release", "reject", "hold"])] + [(2, i, a) for i, a in enumerate(["approve", "queue_payment", "mark_paid", "reject"])], "invoice_id long, at int, action string")
    assert {r.invoice_id: (r.status, r.done, r.refused) for r in rules.fold_actions(log).collect()} == {1: ("rejected", 3, 1), 2: ("paid", 3, 1)}


def test_audit_holds_every_transition(spark):
    log = spark.createDataFrame([(1, i, a) for i, a in enumerate(["hold", "release", "reject", "hold"])], "invoice_id long, at int, action string")
    assert [(r.step, r.from_status, r.to_status) for r in rules.audit(log).orderBy("step").collect()] == [(0, "review_required", "on_hold"), (1, "on_hold", "review_required"), (2, "review_required", "rejected")]


def test_payments(spark):
    for status, amounts, left, after in (("awaiting_payment", [59, 59], 0, "paid"), ("approved", [59], 59, "awaiting_payment"), ("awaiting_payment", [100, 59, 18], 0, "paid"), ("awaiting_payment", [59, 200, -1], 59, "awaiting_payment"), ("review_required", [59], 118, "review_required")):
        inv = spark.createDataFrame([(1, status, Decimal("118.00"))], "invoice_id long, status string, balance decimal(18,2)")
        pay = spark.createDataFrame([(1, i, Decimal(a)) for i, a in enumerate(amounts)], "invoice_id long, at int, amount decimal(18,2)")
        r = rules.fold_payments(inv, pay).first()
        assert (r.outstanding, r.status) == (left, after), amounts


def test_nested_qr_payload(spark):
    payload = '{"data": {"DocNo": "INV-1", "Parties": {"SellerGstin": "27aapfu0939f1zv"}, "TotInvVal": 59001}, "AckNo": ""}'
    fields = S.qr_fields(F.col("x"))
    known = {"invoice_number": F.lit("inv/1"), "seller_gstin": F.lit("27AAPFU0939F1ZV"), "grand_total": F.lit("59000.00"), "buyer_gstin": F.lit("x")}
    r = spark.range(1).select(F.lit(payload).alias("x")).select(fields.alias("f")).select(S.qr_comparison(F.col("f"), known).alias("c"), S.qr_field(F.col("f"), "ack_number").alias("ack")).first()
    assert {(c.field, c.status, c.difference) for c in r.c} == {("invoice_number", "match", None), ("seller_gstin", "match", None), ("grand_total", "mismatch", Decimal("1.00"))} and r.ack is None


def test_gst_mode_and_missing_subtotal(spark):
    base = dict(invoice_id=1, invoice_number="N", vendor_name="V", grand_total=Decimal("10620"), subtotal=None, items_total=Decimal("9000"), discount_total=None, tax_sum=Decimal("1620"), tax_total=None, shipping=None, invoice_date=None, due_date=None, date_text="some day", gstin="27AAPFU0939F1ZV", buyer_gstin="29AAGCB7383J1Z4", pan=None, has_igst=False, has_split=True, has_cgst=False, has_sgst=False, currency="INR")
    cases = [base, base | dict(invoice_id=2, has_split=False, has_igst=True), base | dict(invoice_id=3, has_split=False, has_cgst=True, buyer_gstin=None), base | dict(invoice_id=4, has_split=False, date_text=None)]
    schema = "invoice_id long, invoice_number string, vendor_name string, grand_total decimal(18,2), subtotal decimal(18,2), items_total decimal(18,2), discount_total decimal(18,2), tax_sum decimal(18,2), tax_total decimal(18,2), shipping decimal(18,2), invoice_date date, due_date date, date_text string, gstin string, buyer_gstin string, pan string, has_igst boolean, has_split boolean, has_cgst boolean, has_sgst boolean, currency string"
    found = rules.validations(spark.createDataFrame([tuple(c.values()) for c in cases], schema)).collect()
    assert {(r.invoice_id, r.rule) for r in found if not r.passed} == {(1, "gst_mode_consistency"), (1, "date_parseable"), (2, "date_parseable"), (3, "gst_mode_consistency"), (3, "date_parseable")}
    assert all(r.passed for r in found if r.rule in ("arithmetic", "duplicate_invoice"))


def greedy(items, orders):
    used, out = set(), []
    for i, d in enumerate(items):
        j = next((j for j, e in enumerate(orders) if j not in used and e == d), None)
        if j is not None:
            used.add(j)
        out.append((i, j))
    return sorted(out + [(None, j) for j in range(len(orders)) if j not in used], key=str)


@settings(max_examples=8, deadline=None)
@given(st.integers(0, 10**6))
def test_pairing_is_greedy(spark, seed):
    rng = random.Random(seed)
    cases = {k: ([rng.choice("abc") for _ in range(rng.randint(1, 6))], [rng.choice("abc") for _ in range(rng.randint(1, 6))]) for k in range(12)}
    kind = "string, quantity int, unit_price int"
    items = spark.createDataFrame([(k, i, d, 1, 1, 1) for k, (a, _) in cases.items() for i, d in enumerate(a)], f"invoice_id long, pos int, description {kind}, gst_rate int")
    orders = spark.createDataFrame([(k, i, d.upper(), 1, 1, 1) for k, (_, b) in cases.items() for i, d in enumerate(b)], f"po_id long, pos int, description {kind}, tax_rate int")
    matched = spark.createDataFrame([(k, k) for k in cases], "invoice_id long, po_id long")
    found = {}
    for r in M.pairing(items, orders, matched).collect():
        found.setdefault(r.invoice_id, []).append((r.item_pos, r.po_pos))
    assert {k: sorted(v, key=str) for k, v in found.items()} == {k: greedy(a, b) for k, (a, b) in cases.items()}


def test_lines_join_by_their_first_word(spark):
    words = spark.createDataFrame([(1, 0, "b", 50, 3), (1, 0, "a", 0, 0), (1, 0, "c", 90, 9), (1, 0, "d", 0, 14), (1, 1, "e", 0, 0)], "doc_id long, page int, text string, x int, y int")
    assert [(r.page, r.line_no, r.text) for r in X.lines(words).orderBy("page", "line_no").collect()] == [(0, 0, "a b c"), (0, 1, "d"), (1, 0, "e")]


def test_labelled_values(spark):
    lines = spark.createDataFrame([(1, 0, 0, "Tax Invoice"), (1, 0, 1, "Invoice No: INV-2026-3321"), (2, 0, 0, "Invoice Number"), (2, 0, 1, "REF-9"), (3, 0, 0, "nothing")], "doc_id long, page int, line_no int, text string")
    found = X.label_values(lines, ("invoice number", "invoice no"), r"[A-Z]+-[0-9-]+")
    assert {r.doc_id: r.value for r in found.collect()} == {1: "INV-2026-3321", 2: "REF-9"}


def test_tables_and_spans(spark):
    html = "<table><tr><th>Item</th><th>HSN</th><th>GST %</th><th>Amount</th></tr><tr><td>Key<b>board</b></td><td>8471</td><td>18%</td><td>1,000.00</td></tr><tr><td></td></tr></table>"
    rows = spark.range(1).select(F.lit(1).alias("doc_id"), F.lit(0).alias("table_no"), X.table_rows(F.lit(html)).alias("rows"))
    r = X.structured_items(rows).first()
    assert (r.description, r.hsn_sac, r.gst_rate, r.line_total) == ("Key board", "8471", Decimal("18.000"), Decimal("1000.00"))
    cells = spark.createDataFrame([(1, 0, 0, 0, 2, 1, "a"), (1, 1, 0, 0, 1, 2, "b")], "table_id long, seq int, row int, col int, rows int, cols int, text string")
    assert {(r.r, r.c): r.text for r in X.explode_spans(cells).collect()} == {(0, 0): "a", (1, 0): "a", (0, 1): "b"}


def test_words_beyond_the_private_alphabet(spark, monkeypatch):
    monkeypatch.setattr(E, "_WORDS", 2)
    x = spark.createDataFrame([("the cat sat", "the cut sat on"), ("a", "a"), ("a b c d", "b c d"), ("", "x y"), ("a b", "c")], "expected string, predicted string")
    assert E.text_rates(x).first().word_errors == 2 + 0 + 1 + 2 + 2


def test_error_rates(spark):
    x = spark.createDataFrame([("the cat sat", "the cut sat on")], "expected string, predicted string")
    r = E.text_rates(x).first()
    assert (r.char_errors, r.word_errors, r.words) == (4, 2, 3)
    lat = spark.createDataFrame([(float(i),) for i in range(1, 21)], "ms double")
    assert tuple(E.latencies(lat, "ms").first()) == (20, 10.5, 19.0)


def test_items_from_lines_over_batches(spark):
    """Documents go through Python in batches, not one by one; what a document's lines say is carried over their ends."""
    head, rows = "Description Qty Rate Amount", []
    texts = {None: ["no 1.00 2.00", head, "pen 2 1.50 3.00"], 1: [head, "wide", " blue box 3 10.00 30.00", "Sub total 30.00 30.00", "late 1 1.00 1.00"], 2: ["x 1 1.00 1.00"], 3: [head, "ink 7.00 21.00", "cap 1 0.00 5.00", None, "1,000.00 2,000.00"]}
    for doc, own in texts.items():
        rows += [(doc, 0, i, t) for i, t in enumerate(own)]
    random.Random(4).shuffle(rows)
    want = {(None, 0, "pen", 2.0, 1.5, 3.0), (1, 0, "wide blue box", 3.0, 10.0, 30.0), (3, 0, "ink", 3.0, 7.0, 21.0), (3, 1, "cap", 1.0, 0.0, 5.0), (3, 2, "", 2.0, 1000.0, 2000.0)}
    lines = spark.createDataFrame(rows, "doc_id long, page int, line_no int, text string")
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for size in ("1", "2", old):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            got = X.heuristic_items(lines)
            assert {tuple(r) for r in got.collect()} == want
            assert "FlatMapGroupsInPandas" not in got._jdf.queryExecution().toString()
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
