"""Hourly decision rollup of a stream."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from txnrisk.operators.monitor import hourly_rollup
from txnrisk.streaming.runs import RunStore
from txnrisk.streaming.source import AVAILABLE_NOW

COUNTS = ["approved", "reviewed", "declined"]
HOURS = T.StructType([T.StructField("decision_date", T.DateType()), T.StructField("decision_hour", T.IntegerType()), *[T.StructField(c, T.LongType()) for c in COUNTS]])


def rollup_stream(stream: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """Tumbling one-hour counts per decision; append mode emits an hour once the watermark has passed it."""
    decision = F.col("decision")
    hours = (
        stream.withWatermark("scored_at", watermark)
        .groupBy(F.window("scored_at", "1 hour"))
        .agg(
            F.count_if(decision == "APPROVE").alias("approved"),
            F.count_if(decision == "REVIEW").alias("reviewed"),
            F.count_if(decision == "DECLINE").alias("declined"),
        )
    )
    start = F.col("window.start")
    return hours.select(
        F.to_date(start).alias("decision_date"), F.hour(start).alias("decision_hour"), "approved", "reviewed", "declined"
    )


def store_rollup(rollup: DataFrame, path: str, checkpoint: str, trigger: Mapping[str, Any] = AVAILABLE_NOW) -> StreamingQuery:
    """Keep the changed hours of every micro-batch in their own batch partition (update mode).

    An hour's counts only grow, so ``read_rollup`` takes the newest batch that has it.
    """

    def store(rows: DataFrame, batch_id: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    writer = rollup.writeStream.outputMode("update").foreachBatch(store).option("checkpointLocation", checkpoint)
    return writer.trigger(**trigger).start()


def read_rollup(stored: DataFrame) -> DataFrame:
    """Latest counts per hour from the stored updates."""
    counts = ["approved", "reviewed", "declined"]
    newest = stored.groupBy("decision_date", "decision_hour").agg(F.max_by(F.struct(*counts), "batch_id").alias("v"))
    return newest.select("decision_date", "decision_hour", *[f"v.{c}" for c in counts])


def _sum_hours(rows: DataFrame) -> DataFrame:
    return rows.groupBy("decision_date", "decision_hour").agg(*[F.sum(c).alias(c) for c in COUNTS])


def rollup_store(spark: SparkSession, path: str, fan: int = 8) -> RunStore:
    """Hourly counts as merged runs: a refresh opens a bounded number of small files however long the job has run."""
    return RunStore(spark, path, HOURS, _sum_hours, fan)


def store_rollup_runs(stream: DataFrame, store: RunStore, checkpoint: str, trigger: Mapping[str, Any] = AVAILABLE_NOW) -> StreamingQuery:
    """Add each micro-batch's own counts of its hours, late ones included, to the store; no streaming state is kept."""

    def add(rows: DataFrame, batch_id: int) -> None:
        store.append(hourly_rollup(rows), batch_id)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def read_rollup_runs(store: RunStore) -> DataFrame:
    """Counts per hour of all stored micro-batches."""
    return _sum_hours(store.through(store.newest()))
