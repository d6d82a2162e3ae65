"""Sessions with the settings that the engine's plans expect."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str = "local[*]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; more settings as keywords with ``_`` for ``.``."""
    builder = SparkSession.builder.master(master).appName("payloom")
    settings = {"spark.sql.shuffle.partitions": str(shuffle_partitions), "spark.sql.adaptive.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false"}
    for key, value in (settings | {k.replace("_", "."): v for k, v in conf.items()}).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
