"""Scoring a transaction stream into the decision log, duplicates, enrichment, monitoring."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from txnrisk.model.bundle import Bundle
from txnrisk.operators.assemble import assemble
from txnrisk.operators.decide import decision_record
from txnrisk.operators.monitor import hourly_rollup, kpis, latest_decisions
from txnrisk.schema import REVIEW_THRESHOLD
from txnrisk.sources.files import conform, read_decisions, write_decisions
from txnrisk.streaming.features import OnlineFeatures, feature_stream
from txnrisk.streaming.source import AVAILABLE_NOW


def score_batch(rows: DataFrame, bundle: Bundle, review: float = REVIEW_THRESHOLD, partial: bool = False) -> DataFrame:
    """Decision records of a batch: input contract, encoding, model, decision.

    The input holds all of the model's features; with ``partial`` absent ones count as missing values.
    """
    inputs = conform(rows)
    if not partial:
        bundle.require(inputs)
    kept = ["trans_num", "cc_num", "merchant", "unix_time", "amt", "is_fraud"]
    # The record keeps the raw ids and amount; the model sees its own encoded copies.
    raw = inputs.select(*[F.col(c).alias(f"_raw_{c}") for c in kept], "*")
    scored = bundle.score(raw).select(*[F.col(f"_raw_{c}").alias(c) for c in kept], F.col("score"))
    return decision_record(scored, "score", bundle.threshold, review)


def store_stream(
    stream: DataFrame,
    records: Callable[[DataFrame], DataFrame],
    sink: str,
    checkpoint: str,
    trigger: Mapping[str, Any] = AVAILABLE_NOW,
) -> StreamingQuery:
    """Append the decision records made of every micro-batch, whole or not at all.

    A replayed batch replaces its own folder of the sink, so rows are stored once.
    """

    def store(rows: DataFrame, batch_id: int) -> None:
        write_decisions(records(rows), sink, batch_id)

    return stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def score_stream(
    stream: DataFrame, bundle: Bundle, sink: str, checkpoint: str, trigger: Mapping[str, Any] = AVAILABLE_NOW
) -> StreamingQuery:
    """Score a stream whose rows hold the model's features into the decision log."""
    return store_stream(stream, lambda rows: score_batch(rows, bundle), sink, checkpoint, trigger)


def score_transactions(
    stream: DataFrame,
    bundle: Bundle,
    online: OnlineFeatures,
    sink: str,
    checkpoint: str,
    transactions: Callable[[DataFrame], DataFrame] | None = None,
    logins: Callable[[DataFrame], DataFrame] | None = None,
    trigger: Mapping[str, Any] = AVAILABLE_NOW,
) -> StreamingQuery:
    """Score a stream of raw transactions: features from the online state and the bundle's profiles, then model and decision."""

    def store(rows: DataFrame, batch_id: int) -> None:
        write_decisions(score_batch(rows, bundle), sink, batch_id)

    return feature_stream(stream, online, store, checkpoint, transactions, logins, trigger)


def dedup_stream(stream: DataFrame, watermark: str = "1 hour", key: Sequence[str] = ("trans_num",), t: str = "scored_at") -> DataFrame:
    """Drop replays of a key that arrive within the watermark of its first row; state is dropped after it."""
    return stream.withWatermark(t, watermark).dropDuplicatesWithinWatermark(list(key))


def enrich_stream(stream: DataFrame, feeds: Mapping[str, tuple[DataFrame, Sequence[str]]]) -> DataFrame:
    """Left-join static feeds to a stream; every micro-batch plans the join on the feeds' measured size."""
    return assemble(stream, feeds)


def monitor_snapshot(spark: SparkSession, sink: str, n: int = 500, since: str | None = None) -> dict[str, DataFrame]:
    """The monitor's tables over the decision log as it is now: latest rows, their figures, hourly volume.

    ``since`` reads scoring dates from there on only.
    """
    log = read_decisions(spark, sink, since)
    latest = latest_decisions(log, n)
    return {"latest": latest, "kpis": kpis(latest), "hourly": hourly_rollup(log)}
