"""How many rows Spark hands to a Python worker at once."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


@contextmanager
def rows_at_once(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs that run inside hand over at most so many rows at once: whole texts are long, and both sides hold a batch."""
    before = spark.conf.get(_SETTING)
    spark.conf.set(_SETTING, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(_SETTING, before)
