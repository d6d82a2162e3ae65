"""Queries that take their whole table."""

from payloom.plans import catalog
from payloom.sources import views as V

DATA = "/root/testdata/sf0.001"


def test_corrections_of_all_events(spark):
    got = catalog.queries()["corrections"](spark, DATA).collect()
    assert sorted(r.document_id for r in got) == sorted(r.event_id for r in V.table(spark, DATA, "events").collect())


def test_qr_compare_takes_all_payload_forms(spark):
    got = {r.invoice_id: r.status for r in catalog.queries()["qr_compare"](spark, DATA).collect()}
    assert set(got) == {r.invoice_id for r in V.invoices(spark, DATA).select("invoice_id").collect()}
    # The URL form names another number (docno=x).
    assert all(s == ("mismatch" if i % 4 == 1 or i % 10 == 0 else "match") for i, s in got.items())
