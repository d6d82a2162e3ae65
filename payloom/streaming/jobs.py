"""The document queue: claims, retries and status changes, as batch plans and as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LEASE_MINUTES, MOST_ATTEMPTS = 15, 3


def claim(jobs: DataFrame, now: str, count: int = 2) -> DataFrame:
    """T-2, O-9: the oldest jobs that wait or whose lease has run out, with one attempt more. jobs: job_id, status,
    available_at, locked_at, created_at, attempts."""
    t = F.lit(now).cast("timestamp_ntz")
    stale = (F.col("status") == "processing") & (F.col("locked_at") < t - F.expr(f"interval {LEASE_MINUTES} minutes"))
    free = F.col("status").isin("queued", "retrying") & (F.col("available_at") <= t)
    return jobs.where(stale | free).orderBy("created_at", "job_id").limit(count).select("job_id", F.lit("processing").alias("status"), (F.col("attempts") + 1).alias("attempts"))


def fail(jobs: DataFrame, most: int = MOST_ATTEMPTS) -> DataFrame:
    """T-3: failed attempts: another one min(60, 2^attempts) seconds later, or the dead letter."""
    wait = F.least(F.lit(60), F.pow(F.lit(2), F.col("attempts"))).cast("int")
    dead = F.col("attempts") >= most
    return jobs.select("job_id", F.when(dead, "dead_letter").otherwise("retrying").alias("status"), F.when(~dead, wait).alias("wait_s"))


def changes(events: DataFrame, key: str = "document_id") -> DataFrame:
    """T-5, W-6: events (key, seq, payload) that differ from the one before."""
    before = F.lag("payload").over(Window.partitionBy(key).orderBy("seq"))
    return events.withColumn("before", before).where("before is null or before <> payload").drop("before")


def stream_changes(events: DataFrame, key: str = "document_id") -> DataFrame:
    """T-5 as a stream: the last payload of each key is its state. events: key, seq, payload."""
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def emit(k, frames, state: GroupState):
        last = state.get[0] if state.exists else None
        out = []
        for frame in frames:
            for row in frame.sort_values("seq").itertuples(index=False):
                if row.payload != last:
                    out.append((k[0], row.seq, row.payload))
                    last = row.payload
        if last is not None:
            state.update((last,))
        yield pd.DataFrame(out, columns=[key, "seq", "payload"])

    return events.groupBy(key).applyInPandasWithState(emit, f"{key} long, seq long, payload string", "last string", "append", GroupStateTimeout.NoTimeout)


def daily_counts(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """A-4 as a stream (an extension): events by day, with a watermark."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 day").alias("day"), "event_type").count()


def reprocess(ids: DataFrame, jobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """T-7: documents that may be queued again, and those with a job that waits or runs."""
    active = jobs.where(F.col("status").isin("queued", "processing", "retrying")).select("document_id").distinct()
    return ids.join(active, "document_id", "left_anti"), ids.join(active, "document_id", "left_semi")
