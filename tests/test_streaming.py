"""Streams give what the batch plans give."""

import tempfile
from pathlib import Path

from payloom.streaming import jobs


def test_status_changes_as_a_stream(spark):
    events = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (1, 3, "b"), (2, 4, "a"), (1, 5, "b"), (1, 6, "a")], "document_id long, seq long, payload string")
    want = {tuple(r) for r in jobs.changes(events).select("document_id", "seq", "payload").collect()}
    with tempfile.TemporaryDirectory() as d:
        events.coalesce(1).write.parquet(f"{d}/in")
        stream = jobs.stream_changes(spark.readStream.schema(events.schema).parquet(f"{d}/in"))
        q = stream.writeStream.format("parquet").option("checkpointLocation", f"{d}/ck").option("path", f"{d}/out").trigger(availableNow=True).start()
        q.awaitTermination()
        assert Path(f"{d}/out").exists()
        assert {tuple(r) for r in spark.read.parquet(f"{d}/out").collect()} == want


def test_retries(spark):
    x = spark.createDataFrame([(1, 1), (2, 2), (3, 3)], "job_id long, attempts int")
    assert {r.job_id: (r.status, r.wait_s) for r in jobs.fail(x).collect()} == {1: ("retrying", 2), 2: ("retrying", 4), 3: ("dead_letter", None)}


def test_lease_ends_after_fifteen_minutes(spark):
    rows = [(1, "processing", "2024-01-01 00:00:00", 1), (2, "processing", "2024-01-01 00:00:01", 1), (3, "queued", "2024-01-01 00:00:00", 0)]
    x = spark.createDataFrame(rows, "job_id long, status string, at string, attempts int").selectExpr("job_id", "status", "cast(at as timestamp_ntz) as locked_at", "cast(at as timestamp_ntz) as created_at", "cast(at as timestamp_ntz) as available_at", "attempts")
    assert sorted(r.job_id for r in jobs.claim(x, "2024-01-01 00:15:01", 5).collect()) == [1, 3]
