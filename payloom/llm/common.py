"""What the operators share: reading tables, the shared folder for cut lineage, text helpers."""

from __future__ import annotations

import atexit
import contextlib
import pickle
import re
import tempfile
import time
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: White space of the word contracts, as a character class body.
SPACE = r"\x20\x09-\x0D"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Where that is unset, only a local master may fall back to a temporary folder, as in tests.
    """
    conf = spark.sparkContext.getConf()
    if where := conf.get("spark.checkpoint.dir"):
        return where.rstrip("/")
    own = spark.sparkContext._jsc.sc().getCheckpointDir()
    if own.isDefined():
        return str(own.get()).rstrip("/")
    if not re.match(r"local($|\[)", conf.get("spark.master", "")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="payloom-"))
    return str(spark.sparkContext._jsc.sc().getCheckpointDir().get()).rstrip("/")


#: Folders of this process, by session; they go when the process ends, as results are read from them until then.
_FOLDERS: dict[str, SparkSession] = {}
_OWN = uuid.uuid4().hex


def _delete(spark: SparkSession, where: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@atexit.register
def _clean() -> None:
    for where, spark in _FOLDERS.items():
        with contextlib.suppress(Exception):  # the session may have ended before
            _delete(spark, where)


#: Seconds between two times at which the driver gives memory back, and the share of its heap's bound from which that shrinks.
GIVE_BACK_S, LARGE_HEAP = 3, 2 / 3
_GIVEN_BACK = [-float(GIVE_BACK_S)]


def give_back(spark: SparkSession) -> str | None:
    """Let the driver's JVM return to the system what it has freed: the answer of its command, None if it is not yet time again
    or the JVM has no such command.

    Native memory that Spark's many threads have freed stays with the C library, some 200 MB after plans of many steps. Nothing
    that is in use goes. A heap that bursts of planning have grown shrinks only in a full collection.
    """
    if time.monotonic() - _GIVEN_BACK[0] < GIVE_BACK_S:
        return None
    jvm, new_array = spark.sparkContext._jvm, spark.sparkContext._gateway.new_array
    java, management = jvm.java.lang, jvm.javax.management
    if java.Runtime.getRuntime().totalMemory() > LARGE_HEAP * java.Runtime.getRuntime().maxMemory():
        java.System.gc()
    try:
        # By reflection, as the server's class is not exported to py4j.
        kinds, values = new_array(java.Class, 4), new_array(java.Object, 4)
        for i, kind in enumerate(("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")):
            kinds[i] = java.Class.forName(kind)
        values[0], values[1] = management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        call = java.Class.forName("javax.management.MBeanServerConnection").getMethod("invoke", kinds)
        return call.invoke(java.management.ManagementFactory.getPlatformMBeanServer(), values)
    except Py4JError:
        return None
    finally:
        _GIVEN_BACK[0] = time.monotonic()


class Cut:
    """A table written to the shared folder: lineage ends there, and a lost executor costs only a read."""

    def __init__(self, df: DataFrame, name: str):
        self.spark = df.sparkSession
        folder = f"{shared_dir(self.spark)}/payloom-{_OWN}"
        _FOLDERS.setdefault(folder, self.spark)
        self.path = f"{folder}/{name}-{uuid.uuid4().hex}"
        df.write.parquet(self.path)
        self.df = self.spark.read.schema(df.schema).parquet(self.path)
        give_back(self.spark)

    def drop(self) -> None:
        """Delete the files of a table that nothing reads any more."""
        _delete(self.spark, self.path)


def with_columns(schema: T.StructType, *fields: T.StructField) -> T.StructType:
    """``schema`` with ``fields`` at its end; a column of the same name (any case) gives way to the new one."""
    new = {f.name.lower() for f in fields}
    return T.StructType([f for f in schema.fields if f.name.lower() not in new] + list(fields))


def add_arrays(batch: pa.RecordBatch, new: dict[str, pa.Array]) -> pa.RecordBatch:
    """``batch`` with columns of ``new`` at its end, in place of those that bear their names."""
    gone = {n.lower() for n in new}
    names = [n for n in batch.schema.names if n.lower() not in gone]
    return pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index(n)) for n in names] + list(new.values()), names + list(new))


def chunks_by_chars(lengths: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Consecutive [start, end) spans whose lengths sum to ``most`` at most, or that hold one item."""
    start = total = 0
    for i, n in enumerate(lengths):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(lengths):
        yield start, len(lengths)


def utf8_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column laid end to end, and the n + 1 offsets of its values (nulls are empty)."""
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]] if len(offsets) else data, offsets - (offsets[0] if len(offsets) else 0)


def crc_mod(doc_id: str, n: int):
    """crc32 of the id's decimal text, modulo n."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % F.lit(n)


#: Ranges of hashes that are counted to find a bound for a sample: that many numbers reach the driver at most.
HASH_RANGES = 1 << 14


def smallest_hashes(rows: DataFrame, h: str, limit: int, *ties: str) -> DataFrame:
    """``limit`` rows at most, those with the smallest 64-bit hash ``h``, or all if there are fewer. Only rows below the end of
    the range of hashes in which the last one lies are sorted, so that no task is sent what every partition's best rows sum to
    unless that many hashes are equal."""
    place = F.shiftright(h, 50) + F.lit(HASH_RANGES // 2)
    total = last = 0
    counts = rows.groupBy(place.alias("place")).count().toArrow().sort_by("place")
    for last, n in zip(counts.column("place").to_pylist(), counts.column("count").to_pylist()):
        total += n
        if total >= limit:
            break
    return rows.where(place <= F.lit(last)).orderBy(h, *ties).limit(limit)


def share(spark: SparkSession, thing):
    """A broadcast of an object of one of this package's classes, which workers read without the package (``shared``)."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(thing))


def shared(broadcast):
    return pickle.loads(broadcast.value)
