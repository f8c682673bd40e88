"""Statement sources: a callable that gives lines since a date, brought to the schema that staging expects."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LINES = "ledger string, source string, record_id string, reference string, asset string, amount long, direction string, ingested_at timestamp_ntz"


def pulled(spark: SparkSession, fetch: Callable[[SparkSession, str], DataFrame], since: str) -> DataFrame:
    """Lines from a source with exactly the expected columns; a missing one is an error, a further one is dropped."""
    got = fetch(spark, since)
    columns = [c.strip().rsplit(" ", 1) for c in LINES.split(",")]
    return got.select(*(F.col(name).cast(kind).alias(name) for name, kind in columns))
