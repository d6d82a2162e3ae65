"""What the service's pages and prompts are made of: lists, lookups, contexts, timelines and metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Files of a batch upload, words and characters of a prompt's context, signals that an answer names.
BATCH_FILES, CONTEXT_WORDS, CONTEXT_CHARS, SIGNALS = 25, 500, 12_000, 6


def upload_batches(files: DataFrame, most: int = BATCH_FILES) -> DataFrame:
    """S-3: a batch of no file, or of more than ``most``, is refused whole. files: batch_id, filename (null: none)."""
    n = F.count("filename")
    return files.groupBy("batch_id").agg(n.alias("files"), F.when(n == 0, "no files").when(n > most, "too many files").alias("rejected"))


def point_lookup(table: DataFrame, tenant: str, key: str, value) -> DataFrame:
    """P-9, P-1: the row of a tenant with this key; both predicates reach the scan."""
    return table.where((F.col("tenant_id") == tenant) & (F.col(key) == value))


def reading_order(words: DataFrame) -> DataFrame:
    """P-11: words with their place on the page: top to bottom, then left to right. words: doc_id, page, text, x, y."""
    return words.withColumn("place", F.row_number().over(Window.partitionBy("doc_id", "page").orderBy("y", "x", "text")) - 1)


def context(words: DataFrame, most: int = CONTEXT_WORDS, chars: int = CONTEXT_CHARS) -> DataFrame:
    """O-8: a document's first words in reading order, a line each, cut to a number of characters (that is the feature)."""
    w = Window.partitionBy("doc_id").orderBy("page", "y", "x", "text")
    x = words.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)
    lines = x.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("place", "text"))).alias("w"))
    return lines.select("doc_id", F.substring(F.array_join(F.transform("w", lambda t: t["text"]), "\n"), 1, chars).alias("context"))


def distinct_lines(text: Column) -> Column:
    """U-4: a text's lines, each once, in the order in which they come first; blank ones left out."""
    return F.array_distinct(F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda t: t != ""))


def top_signals(signals: Column, most: int = SIGNALS) -> Column:
    """O-11: the first signals that an answer names."""
    return F.slice(signals, 1, most)


def prune(payload: Column, heavy: tuple[str, ...]) -> Column:
    """P-18: a payload without the fields that a prompt has no use for."""
    return payload.dropFields(*heavy)


def purchase_order_view(orders: DataFrame, vendors: DataFrame, items: DataFrame, receipts: DataFrame) -> DataFrame:
    """J-8: an order with its vendor's name, its lines and what was received of each, collected before they are joined."""
    line = items.groupBy("po_id").agg(F.sort_array(F.collect_list(F.struct("pos", "description", "quantity", "unit_price"))).alias("items"))
    got = receipts.groupBy("po_id", "pos").agg(F.sum("quantity_received").alias("received")).groupBy("po_id").agg(F.sort_array(F.collect_list(F.struct("pos", "received"))).alias("receipts"))
    x = orders.join(vendors.select("tenant_id", "vendor_id", F.col("name").alias("vendor_name")), ["tenant_id", "vendor_id"], "left")
    return x.join(line, "po_id", "left").join(got, "po_id", "left")


def directory(vendors: DataFrame) -> DataFrame:
    """O-6: a tenant's vendors by name."""
    return vendors.withColumn("place", F.row_number().over(Window.partitionBy("tenant_id").orderBy("name", "vendor_id")))


def timeline(events: DataFrame) -> DataFrame:
    """O-6, T-6: events of a document in order of time, numbered. events: document_id, at, seq, event."""
    return events.withColumn("place", F.row_number().over(Window.partitionBy("document_id").orderBy("at", "seq")))


def enqueue(documents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """T-1: a queued job of each document, and the event that says so. documents: document_id, at."""
    jobs = documents.select(F.col("document_id").alias("job_id"), F.lit("queued").alias("status"), F.lit(0).alias("attempts"), F.col("at").alias("available_at"))
    return jobs, documents.select("document_id", "at", F.lit("queued").alias("event"))


def processing_metrics(documents: DataFrame, bounds: tuple[float, ...] = (100.0, 500.0, 1000.0, 2500.0)) -> DataFrame:
    """A-22: counters by status and source, and a cumulative histogram of processing times."""
    ms = F.col("processing_ms")
    return documents.groupBy("status", "source").agg(F.count("*").alias("documents"), *[F.count_if(ms <= b).alias(f"le_{int(b)}") for b in bounds], F.count(ms).alias("timed"))


def label_amounts(quantity: Column, price: Column, rate: Column) -> Column:
    """S-31: what a made-up invoice's labels say: net, two halves of its tax, total."""
    net = (quantity * price).cast("decimal(18,2)")
    half = (net * rate / 200).cast("decimal(18,2)")
    return F.struct(net.alias("subtotal"), half.alias("cgst"), half.alias("sgst"), (net + half + half).cast("decimal(18,2)").alias("grand_total"))


def side_lines(words: DataFrame, page_width: int, most: int = 15) -> DataFrame:
    """X-13: the lines of a page's left and right column: a word belongs where its centre lies; ``most`` lines a column (that is
    the feature). words: doc_id, page, text, x, y, width; those of one height are a line."""
    side = F.when(F.col("x") + F.col("width") / 2 < page_width / 2, "left").otherwise("right")
    x = words.withColumn("side", side).groupBy("doc_id", "page", "side", "y").agg(F.sort_array(F.collect_list(F.struct("x", "text"))).alias("w"))
    x = x.withColumn("line_no", F.row_number().over(Window.partitionBy("doc_id", "page", "side").orderBy("y")) - 1).where(F.col("line_no") < most)
    return x.select("doc_id", "page", "side", "line_no", F.array_join(F.transform("w", lambda t: t["text"]), " ").alias("text"))


def labelled_text(line: Column, label: str, most: int = 80) -> Column:
    """X-4: the free text after a label on its line, 80 characters of it at most, null without any."""
    return F.nullif(F.trim(F.substring(F.regexp_extract(line, rf"(?i)\b(?:{label})\s*[:#-]?\s*(.+)$", 1), 1, most)), F.lit(""))


#: Words of a question by which it is answered from the invoice itself, first come first.
TOPICS = (("due|when.*pay", "due_date"), ("gst|tax", "tax"), ("suspicious|risk|fraud", "risk"), ("duplicate", "duplicate"), ("total|amount", "total"), ("vendor|supplier", "vendor"))


def topic(question: Column) -> Column:
    """Q-1, Q-6: what a question asks for; ``summary`` if it names nothing known."""
    out = F.when(F.lit(False), "")
    for words, name in TOPICS:
        out = out.when(F.lower(question).rlike(words), name)
    return out.otherwise("summary")
