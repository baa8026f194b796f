"""Live velocity with map state: the rows of every card in chunks by time, corrections for late rows, timers for idle cards.

The state of a card is a map of chunks (``streaming.chunks``): times, exact amounts, ids and versions of its rows. A micro-batch reads the
map of its cards and writes only the chunks that it adds to, corrects or leaves behind, so state writes grow with the micro-batch and not
with the state. A row that comes late changes the windows of rows that were emitted before: those are emitted again with the next
version, so the newest version of every row equals the batch query whatever the order of arrival, as long as no row is later than the
allowed lateness. With ``idle_seconds`` a timer drops the map of a card that has had no rows for so long.

Needs the RocksDB state store (``use_rocksdb``).
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from txnrisk.functions import MONEY_UNITS, money_units
from txnrisk.schema import HORIZONS
from txnrisk.streaming import chunks
from txnrisk.streaming.velocity import LATENESS

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class CardSeconds(StatefulProcessor):
    def __init__(self, horizons: Mapping[str, int], lateness: int, correct: bool, idle_seconds: int | None):
        self.horizons, self.longest = dict(horizons), max(horizons.values())
        self.keep, self.correct, self.idle = self.longest + lateness, correct, idle_seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.chunks = handle.getMapState("chunks", chunks.PART, chunks.PACKED)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        batch = [r for r in rows if r["unix_time"] is not None]
        if not batch:
            return
        held = chunks.load(self.chunks)
        stored = np.unique(held.part)
        if len(held.at):  # what lies before the lateness may wait in a chunk that has not been written since
            held = held.of(held.at >= held.at[-1] - self.keep)
        t, names = [r["unix_time"] for r in batch], [r["trans_num"] for r in batch]
        held, fresh = chunks.added(held, t, [r["units"] for r in batch], [0] * len(batch), names)
        changed = self._corrected(held, fresh, set(zip(t, names, strict=True))) if self.correct else np.zeros(len(fresh), dtype=bool)
        held = held._replace(version=held.version + changed.astype(np.int32))
        yield from self._windows(key[0], held, fresh | changed)
        chunks.store(self.chunks, held, held.at >= held.at[-1] - self.keep, fresh | changed, stored)
        if self.idle is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + 1_000 * self.idle)

    def _corrected(self, held: chunks.Rows, fresh: np.ndarray, new: set) -> np.ndarray:
        """Rows emitted earlier whose windows a new row enters."""
        came = held.at[fresh]
        entered = np.searchsorted(came, held.at, side="left") > np.searchsorted(came, held.at - self.longest, side="left")
        changed = entered & ~fresh
        for i in np.flatnonzero(changed).tolist():
            changed[i] = (int(held.at[i]), held.ids[i]) not in new
        return changed

    def _windows(self, card, held: chunks.Rows, out: np.ndarray) -> Iterator[Row]:
        """Counts and amounts of the seconds before each row: differences of running totals."""
        units = np.concatenate([[0], np.cumsum(held.units)])
        t = held.at[out]
        until = np.searchsorted(held.at, t, side="left")
        names, columns = ["cc_num", "trans_num", "unix_time"], [[card] * len(t), held.ids[out].tolist(), t.tolist()]
        for h, width in self.horizons.items():
            since = np.searchsorted(held.at, t - width, side="left")
            names += [f"TxnCount_{h}", f"TxnAmount_{h}"]
            columns += [(until - since).tolist(), ((units[until] - units[since]) / MONEY_UNITS).tolist()]
        row = Row(*names, "version")
        return (row(*cells) for cells in zip(*columns, held.version[out].tolist(), strict=True))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        self.chunks.clear()
        return iter([])

    def close(self) -> None:
        pass


def velocity_versions(
    stream: DataFrame, horizons: Mapping[str, int] = HORIZONS, lateness: int = LATENESS, correct: bool = True, idle_seconds: int | None = None
) -> DataFrame:
    """(cc_num, trans_num, unix_time, TxnCount_<h>, TxnAmount_<h>, version) of a stream, the row's own second excluded.

    Version 0 comes with the row; higher ones correct it (none with ``correct=False``). Amounts below 10^14 count. A row without a time is left
    out. With ``idle_seconds`` the job needs a processing-time trigger to fire its timers.
    """
    counts = ", ".join(f"TxnCount_{h} long, TxnAmount_{h} double" for h in horizons)
    kind = stream.schema["trans_num"].dataType
    units = F.coalesce(money_units("amt", 18).cast("long"), F.lit(0)).alias("units")
    out = (
        stream.select("cc_num", F.col("trans_num").cast("string").alias("trans_num"), "unix_time", units)
        .groupBy("cc_num")
        .transformWithState(
            statefulProcessor=CardSeconds(horizons, lateness, correct, idle_seconds),
            outputStructType=f"cc_num long, trans_num string, unix_time long, {counts}, version int",
            outputMode="Append",
            timeMode="None" if idle_seconds is None else "ProcessingTime",
        )
    )
    return out.withColumn("trans_num", F.col("trans_num").cast(kind))


def newest_versions(stored: DataFrame) -> DataFrame:
    """The last version of every emitted row."""
    row = [c for c in stored.columns if c not in ("trans_num", "version")]
    newest = stored.groupBy("trans_num").agg(F.max_by(F.struct(*row), "version").alias("r"), F.max("version").alias("version"))
    return newest.select("trans_num", *[f"r.{c}" for c in row], "version")
