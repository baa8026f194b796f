"""Stream sources and sinks."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from itertools import pairwise
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def file_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int | None = None) -> DataFrame:
    """A Parquet table (a file or a folder of parts) as a stream; ``files_per_batch`` bounds a micro-batch."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


class Replay:
    """A stored table as a stream of several micro-batches, in the order of a time column.

    Slices of the table, cut at quantiles of the time, are appended to a folder one after the other; every slice is drained before
    the next one comes, so a job also shows that it goes on from its checkpoint. The cut does not depend on how the
    table is stored.
    """

    def __init__(self, rows: DataFrame, time: str, folder: str, slices: int = 2):
        spark = rows.sparkSession
        cuts = rows.select(F.percentile_approx(F.col(time), [i / slices for i in range(1, slices)], 1_000)).first()[0] or []
        edges = [None, *sorted(set(cuts)), None]
        self._parts = []
        for low, high in pairwise(edges):
            inside = F.lit(True) if low is None else F.col(time) > F.lit(low)
            inside = inside & (F.lit(True) if high is None else F.col(time) <= F.lit(high))
            # Rows without a time come first.
            self._parts.append(rows.where(inside | F.col(time).isNull() if low is None else inside))
        self._folder = folder
        self._append()
        self.stream = file_stream(spark, folder, rows.schema)

    def _append(self) -> None:
        self._parts.pop(0).write.mode("append").parquet(self._folder)

    def run(self, start: Callable[[], StreamingQuery]) -> None:
        """Start the job on what is there, wait for it, add the next slice, and so on to the end."""
        drain(start())
        while self._parts:
            self._append()
            drain(start())


# Process what is there and stop; run again to continue. Pass {"processingTime": "10 seconds"} for a live job.
AVAILABLE_NOW = {"availableNow": True}


def append_sink(df: DataFrame, path: str, checkpoint: str, trigger: Mapping[str, Any] = AVAILABLE_NOW) -> StreamingQuery:
    """Exactly-once Parquet sink."""
    writer = df.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append")
    return writer.trigger(**trigger).start(path)


def drain(query: StreamingQuery) -> None:
    """Wait for an available-now query and raise its failure."""
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
