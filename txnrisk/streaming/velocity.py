"""Live velocity per card: counts and sums over trailing windows.

``velocity_stream`` keeps streaming state, ``velocity_batches`` keeps a table and suits streams that one card may
dominate.

The state of a card is one total per second, pruned to the longest window plus the allowed lateness, so it has a
fixed bound (about 700 thousand entries with the defaults) however many rows the card has; with ``expire`` it is dropped
when no row of the card has come for as long. Totals are integers
(amounts to four places, below 10^14). Within a micro-batch rows are looked up by time in the merged totals, so their order does not
matter; the micro-batch size (``files_per_batch`` at the source) bounds the rows of a card that meet in a task.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from functools import partial
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from txnrisk.functions import MONEY_UNITS, money_units
from txnrisk.operators.velocity import UNITS, per_second, velocity
from txnrisk.plans.hotkeys import HEAVY_ROWS, run_steps
from txnrisk.schema import HORIZONS
from txnrisk.session import materialise
from txnrisk.streaming.source import AVAILABLE_NOW

LATENESS = 86_400
STATE = "at array<long>, n array<long>, units array<long>"
SECONDS = f"cc_num long, unix_time long, n long, units {UNITS}"


def _advance(horizons: Mapping[str, int], keep: int, expire: bool, key: tuple, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Merge a card's micro-batch rows into its per-second totals and look every row's windows up."""
    if state.hasTimedOut:
        state.remove()
        return
    batch = pd.concat(list(rows), ignore_index=True)
    at, n, units = (np.array(v, dtype=np.int64) for v in (state.get if state.exists else ([], [], [])))
    newest = at[-1] if len(at) else np.iinfo(np.int64).min
    t = batch["unix_time"].to_numpy(np.int64)
    merged, place = np.unique(np.concatenate([at, t]), return_inverse=True)
    count, total = np.zeros(len(merged), np.int64), np.zeros(len(merged), np.int64)
    np.add.at(count, place, np.concatenate([n, np.ones(len(t), np.int64)]))
    np.add.at(total, place, np.concatenate([units, batch["_units"].to_numpy(np.int64)]))
    # Totals before each second, so a window is the difference of two lookups.
    before_n, before_units = (np.concatenate([[0], np.cumsum(v)]) for v in (count, total))
    until = np.searchsorted(merged, t, side="left")
    out = {"cc_num": key[0], "trans_num": batch["trans_num"], "unix_time": t}
    for name, seconds in horizons.items():
        since = np.searchsorted(merged, t - seconds, side="left")
        out[f"TxnCount_{name}"] = before_n[until] - before_n[since]
        out[f"TxnAmount_{name}"] = (before_units[until] - before_units[since]) / MONEY_UNITS
    out["is_late"] = (t < newest).astype(np.int32)
    held = merged >= merged[-1] - keep
    state.update((merged[held].tolist(), count[held].tolist(), total[held].tolist()))
    if expire:
        state.setTimeoutDuration(keep * 1_000)
    yield pd.DataFrame(out)


def velocity_stream(stream: DataFrame, horizons: Mapping[str, int] = HORIZONS, lateness: int = LATENESS, expire: bool = False) -> DataFrame:
    """(cc_num, trans_num, unix_time, TxnCount_<h>, TxnAmount_<h>, is_late), the row itself excluded.

    ``is_late`` marks rows older than one already emitted for the card: rows emitted before are not corrected. With ``expire`` the
    state of a card is dropped when none of its rows has come for the longest window plus the lateness; such a job runs
    batches without rows to do so and never ends by itself, so it needs a processing-time trigger.
    """
    counts = ", ".join(f"TxnCount_{h} long, TxnAmount_{h} double" for h in horizons)
    kind = stream.schema["trans_num"].dataType.simpleString()
    narrow = stream.select("cc_num", "trans_num", "unix_time", F.coalesce(money_units("amt", 18).cast("long"), F.lit(0)).alias("_units"))
    advance = partial(_advance, dict(horizons), max(horizons.values()) + lateness, expire)
    return narrow.groupBy("cc_num").applyInPandasWithState(
        advance,
        outputStructType=f"cc_num long, trans_num {kind}, unix_time long, {counts}, is_late int",
        stateStructType=STATE,
        outputMode="append",
        timeoutConf=GroupStateTimeout.ProcessingTimeTimeout if expire else GroupStateTimeout.NoTimeout,
    )


def velocity_batches(
    stream: DataFrame,
    history: str,
    sink: str,
    checkpoint: str,
    horizons: Mapping[str, int] = HORIZONS,
    heavy_rows: int = HEAVY_ROWS,
    trigger: Mapping[str, Any] = AVAILABLE_NOW,
) -> StreamingQuery:
    """The same windows with per-second totals in a table instead of keyed state; no Python in the tasks.

    Each micro-batch runs the batch operator on its rows and the totals of the last days, so a heavy card is cut
    into segments here too. Totals and results go to one folder per batch, which a replay replaces. Days that the
    longest window has left are pruned by partition and can be deleted.
    """
    longest = max(horizons.values())

    def advance(rows: DataFrame, batch_id: int) -> None:
        spark = rows.sparkSession
        # The batch is stored once: four steps below read it.
        narrow = materialise(rows.select("cc_num", "trans_num", "unix_time", "amt"), "velocity-batch")
        fresh = per_second(narrow).withColumn("day", F.floor(F.col("unix_time") / 86_400).cast("int"))
        fresh.write.mode("overwrite").partitionBy("day").parquet(f"{history}/batch_id={batch_id}")
        first, last = narrow.agg(F.min("unix_time"), F.max("unix_time")).first()
        if first is None:
            return
        known = spark.read.schema(f"{SECONDS}, day int, batch_id long").parquet(history)
        known = known.where(F.col("day").between((first - longest) // 86_400, last // 86_400) & (F.col("batch_id") <= batch_id))
        # Only the cards of the batch, and of each the time that its own rows look back on.
        spans = narrow.groupBy(F.col("cc_num").alias("_card")).agg(F.min("unix_time").alias("_first"), F.max("unix_time").alias("_last"))
        near = F.col("cc_num").eqNullSafe(F.col("_card")) & (F.col("unix_time") >= F.col("_first") - longest) & (F.col("unix_time") <= F.col("_last"))
        known = known.join(spans, near, "left_semi")
        steps = [velocity(horizons, feed="seconds")]
        out = run_steps(narrow, steps, min_rows=heavy_rows, feeds={"seconds": known.select("cc_num", "unix_time", "n", "units")})
        out.drop("amt").write.mode("overwrite").parquet(f"{sink}/batch_id={batch_id}")

    return stream.writeStream.foreachBatch(advance).option("checkpointLocation", checkpoint).trigger(**trigger).start()
