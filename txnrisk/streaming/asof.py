"""As-of join of two streams: the time of the latest event of a key strictly before each row, corrected when events come late.

Rows and events arrive in any order. A row is emitted at once with what is known; an event that comes later than rows it belongs before
makes those rows come again with the next version. The state of a key is a map of chunks (``streaming.chunks``) of its rows and events by time; it
holds the allowed lateness, and the one event before it that rows may still look back to. Needs the RocksDB state store.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from txnrisk.streaming import chunks
from txnrisk.streaming.velocity import LATENESS

#: Version that marks an event among the rows of a chunk.
EVENT = -1


class LatestBefore(StatefulProcessor):
    def __init__(self, lateness: int):
        self.lateness = lateness

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.chunks = handle.getMapState("chunks", chunks.PART, chunks.PACKED)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = chunks.load(self.chunks)
        stored = np.unique(held.part)
        held = held.of(self._stays(held))
        known = held.at[held.version == EVENT]
        fresh, events = [], set()
        for row in rows:
            if row["at"] is None:
                continue
            if row["row_id"] is None:
                events.add(row["at"])
            else:
                fresh.append((row["at"], row["row_id"]))
        came = np.array(sorted(events.difference(known.tolist())), dtype=np.int64)
        at, ids = [t for t, _ in fresh] + came.tolist(), [row_id for _, row_id in fresh] + [None] * len(came)
        held, new = chunks.added(held, at, [0] * len(at), [0] * len(fresh) + [EVENT] * len(came), ids)
        if not len(held.at):
            return
        is_row = held.version != EVENT
        # Emitted rows that an event has come before, later than the one they saw.
        saw = np.append(np.iinfo(np.int64).min, known)[np.searchsorted(known, held.at, side="left")]
        changed = is_row & ~new & (np.searchsorted(came, held.at, side="left") > np.searchsorted(came, saw, side="right"))
        again = set(fresh)
        for i in np.flatnonzero(changed).tolist():
            changed[i] = (int(held.at[i]), held.ids[i]) not in again
        held = held._replace(version=held.version + changed.astype(np.int32))
        yield from self._latest(key[0], held, (new & is_row) | changed)
        chunks.store(self.chunks, held, self._stays(held), new | changed, stored)

    def _stays(self, held: chunks.Rows) -> np.ndarray:
        """What lies before the lateness goes, but for the second of its last event."""
        if not len(held.at):
            return np.zeros(0, dtype=bool)
        cut = held.at[-1] - self.lateness
        before = held.at[(held.version == EVENT) & (held.at < cut)]
        return (held.at >= cut) | (held.at == before[-1] if len(before) else False)

    def _latest(self, card, held: chunks.Rows, out: np.ndarray) -> Iterator[Row]:
        """The last event before each row."""
        events, t = held.at[held.version == EVENT], held.at[out]
        row = Row("key", "row_id", "at", "latest", "version")
        latest = [None, *events.tolist()]
        places = np.searchsorted(events, t, side="left").tolist()
        return (row(card, name, at, latest[i], version) for name, at, i, version in zip(held.ids[out].tolist(), t.tolist(), places, held.version[out].tolist(), strict=True))

    def close(self) -> None:
        pass


def asof_stream(rows: DataFrame, events: DataFrame, key: str, t: str, row_id: str, name: str = "latest_time", lateness: int = LATENESS) -> DataFrame:
    """(key, row id, time, latest event time or null, version) of a stream of rows against a stream of events; both have ``key`` and ``t``.

    Rows and events later than the lateness see and change only what is still held. Those without a time are left out.
    """
    left = rows.select(F.col(key).alias("key"), F.col(t).cast("long").alias("at"), F.col(row_id).cast("string").alias("row_id"))
    right = events.select(F.col(key).alias("key"), F.col(t).cast("long").alias("at"), F.lit(None).cast("string").alias("row_id"))
    kind = rows.schema[key].dataType.simpleString()
    joined = (
        left.unionByName(right)
        .groupBy("key")
        .transformWithState(
            statefulProcessor=LatestBefore(lateness),
            outputStructType=f"key {kind}, row_id string, at long, latest long, version int",
            outputMode="Append",
            timeMode="None",
        )
    )
    return joined.select(
        F.col("key").alias(key), F.col("row_id").cast(rows.schema[row_id].dataType).alias(row_id), F.col("at").alias(t), F.col("latest").alias(name), "version"
    )
