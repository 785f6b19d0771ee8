"""Statements that arrive as a stream, reconciled batch by batch.

Ids are fingerprints, so a row delivered again within the watermark is dropped, and later ones meet the same id."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.reconcile import Report, numbered, reconcile
from ..schemas import TRANSACTION, MatcherOptions


def read_transactions(spark: SparkSession, path: str) -> DataFrame:
    """Canonical transactions from a folder of Parquet files as they come, each id once within ten days of booking."""
    rows = spark.readStream.schema(TRANSACTION).parquet(path).withColumn("booked_at", F.col("booking_date").cast("timestamp"))
    return rows.withWatermark("booked_at", "10 days").dropDuplicatesWithinWatermark(["id"])


def reconcile_stream(stream: DataFrame, invoices: DataFrame, sink: Callable[[Report, int], None], checkpoint: str, options: MatcherOptions = MatcherOptions()) -> StreamingQuery:
    """Reconcile each micro-batch and hand its report to ``sink``; batches are ordered by booking date and id."""

    def batch(rows: DataFrame, number: int) -> None:
        if not rows.isEmpty():
            ordered = numbered(rows.drop("booked_at").withColumn("_at", F.struct("booking_date", "id")), "_at").drop("_at")
            sink(reconcile(ordered, invoices, options), number)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
