"""Uploads, imports, exports and stores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from payloom.functions.scalar import match_key

#: What files may be uploaded, by extension: media type and the bytes that they start with.
SIGNATURES = {"pdf": ("application/pdf", "25504446"), "png": ("image/png", "89504E470D0A1A0A"), "jpg": ("image/jpeg", "FFD8FF"), "jpeg": ("image/jpeg", "FFD8FF"), "tif": ("image/tiff", "49492A00"), "tiff": ("image/tiff", "49492A00")}
MOST_BYTES, MOST_FILES = 20 * 1024 * 1024, 25


def read_uploads(spark: SparkSession, path: str) -> DataFrame:
    """S-4: files of a folder with their bytes."""
    return spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("filename"), "content", "modificationTime")


def validate_uploads(files: DataFrame) -> DataFrame:
    """S-1, F-10: (filename, content) with ``mime``, ``sha256`` and ``rejected``, the reason if a file isn't taken."""
    extension = F.lower(F.element_at(F.split("filename", r"\."), -1))
    mime, starts = F.when(F.lit(False), ""), F.when(F.lit(False), F.lit(False))
    for name, (kind, head) in SIGNATURES.items():
        mime = mime.when(extension == name, kind)
        heads = [head, "4D4D002A"] if kind == "image/tiff" else [head]
        fits = F.lit(False)
        for h in heads:
            fits = fits | F.hex("content").startswith(h)
        starts = starts.when(extension == name, fits)
    size = F.octet_length("content")
    why = F.when(mime.isNull(), "unsupported extension").when(F.coalesce(size, F.lit(0)) == 0, "empty file").when(size > MOST_BYTES, "file too large").when(~starts, "content does not match extension")
    return files.withColumn("mime", mime).withColumn("sha256", F.sha2("content", 256)).withColumn("rejected", why)


def newest_by_hash(docs: DataFrame) -> DataFrame:
    """S-2, W-7: of documents with the same content the newest."""
    w = Window.partitionBy("tenant_id", "content_hash").orderBy(F.desc("created_at"), F.desc("document_id"))
    return docs.withColumn("place", F.row_number().over(w)).where("place = 1").drop("place")


def import_vendors(rows: DataFrame, vendors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """S-20: (row, name, vendor_name, gstin) against known vendors. Accepted rows say whether they update one (by GSTIN,
    then by name) or insert; of rows for the same new vendor the last wins. Rejected rows say why; rows count from 2."""
    name = F.nullif(F.trim(F.regexp_replace(F.coalesce("name", "vendor_name"), "^﻿", "")), F.lit(""))
    x = rows.select("tenant_id", "row", name.alias("name"), F.nullif(F.upper(F.trim("gstin")), F.lit("")).alias("gstin"))
    bad = x.where("name is null").select("tenant_id", "row", F.lit("vendor name is required").alias("error"))
    x = x.where("name is not null").withColumn("key", match_key(F.col("name")))
    tax = vendors.where("gstin is not null").groupBy("tenant_id", "gstin").agg(F.min("vendor_id").alias("by_gstin"))
    by_name = vendors.groupBy("tenant_id", F.col("normalized_name").alias("key")).agg(F.min("vendor_id").alias("by_name"))
    x = x.join(tax, ["tenant_id", "gstin"], "left").join(by_name, ["tenant_id", "key"], "left").withColumn("vendor_id", F.coalesce("by_gstin", "by_name"))
    who = F.coalesce(F.col("vendor_id").cast("string"), "gstin", "key")
    last = F.row_number().over(Window.partitionBy("tenant_id", who).orderBy(F.desc("row")))
    return x.withColumn("place", last).where("place = 1").select("tenant_id", "row", "name", "gstin", "vendor_id", F.when(F.col("vendor_id").isNull(), "insert").otherwise("update").alias("change")), bad


def import_orders(rows: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """S-21: (tenant_id, row, number, quantity, unit_price) as text. A number that is known, or comes twice, or that is
    missing, and unreadable amounts are errors of their row only."""
    q, p = F.col("quantity").try_cast("decimal(18,4)"), F.col("unit_price").try_cast("decimal(18,2)")
    x = rows.withColumn("q", q).withColumn("p", p).withColumn("key", F.nullif(F.lower(F.trim("number")), F.lit("")))
    have = known.select("tenant_id", F.lower("number").alias("key"), F.lit(True).alias("known")).distinct()
    x = x.join(have, ["tenant_id", "key"], "left")
    valid = F.col("key").isNotNull() & F.col("q").isNotNull() & F.col("p").isNotNull()
    x = x.withColumn("place", F.sum(valid.cast("int")).over(Window.partitionBy("tenant_id", "key").orderBy("row")))
    why = F.when(F.col("key").isNull(), "number is required").when(F.col("q").isNull() | F.col("p").isNull(), "invalid amount").when(F.col("known") | (F.col("place") > 1), "duplicate purchase order")
    x = x.withColumn("error", why)
    return x.where("error is null").select("tenant_id", "row", "number", (F.col("q") * F.col("p")).cast("decimal(18,2)").alias("total")), x.where("error is not null").select("tenant_id", "row", "error")


def export_corrections(corrections: DataFrame) -> DataFrame:
    """S-26, F-31: training rows with parsed values, in order of time."""
    def value(c: str):
        parsed = F.try_parse_json(F.col(c))
        quoted = F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('\\"')), F.lit('"'))
        return F.when(parsed.isNotNull(), F.to_json(parsed)).otherwise(quoted)

    return corrections.select("document_id", F.col("path").alias("field"), value("old_value").alias("predicted"), value("new_value").alias("correct"), "created_at").orderBy("created_at", "document_id")


def write_export(df: DataFrame, path: str, form: str) -> None:
    """S-22, S-24: csv or json; xlsx needs a library that isn't here."""
    if form == "csv":
        df.write.mode("overwrite").option("header", True).csv(path)
    elif form == "json":
        df.write.mode("overwrite").json(path)
    else:
        raise ValueError(f"export as {form} is not available")


def replace_document_rows(spark: SparkSession, rows: DataFrame, path: str) -> None:
    """S-27, S-28: rows take the place of all earlier rows of their documents, by partition."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("document_id").parquet(path)


def delete_documents(tables: dict[str, DataFrame], ids: DataFrame, active_jobs: DataFrame) -> dict[str, DataFrame]:
    """S-32: tables without the rows of documents that have no active job, children included."""
    gone = ids.join(active_jobs.select("document_id"), "document_id", "left_anti")
    return {name: df.join(gone, "document_id", "left_anti") for name, df in tables.items()}
