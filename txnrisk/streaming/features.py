"""Features of live transactions: the card's past as an online state in tables, profiles from the bundle.

The state of a card is its transactions of the last 30 days (in five narrow columns), its latest transaction if that is older, and its logins: one row
per recent second and one row for all before. It is kept as merged runs (``streaming.runs``), so a micro-batch writes what it
brings and reads a bounded number of files. Each micro-batch joins the state of its own cards and runs the batch operators over state and rows together:
values are those of the batch job whenever a card's rows arrive in time order, a heavy card is cut into segments here too, and
no Python runs in the tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from txnrisk.functions import safe_ratio
from txnrisk.operators.account import DAY, LOGIN_COLUMNS, running_before
from txnrisk.operators.asof import Profiles, finish_features, past_steps, run_past
from txnrisk.plans.hotkeys import HEAVY_ROWS, Step
from txnrisk.plans.running import Running
from txnrisk.schema import DEVIATION_SECONDS
from txnrisk.session import materialise
from txnrisk.streaming.runs import RunStore
from txnrisk.streaming.source import AVAILABLE_NOW

#: Seconds that a card's logins stay apart: a transaction that is later than this sees them as one.
LATENESS = 86_400
PAST = ["cc_num", "unix_time", "trans_num", "amt", "merch_lat", "merch_long"]
LOGIN_STATE = T.StructType([T.StructField(c, T.LongType()) for c in ("cc_num", "unix_time", "attempts", "failures", "changed")])


def _recent_rows(seconds: int) -> Callable[[DataFrame], DataFrame]:
    def merge(rows: DataFrame) -> DataFrame:
        """Rows of the window, and each card's latest row before it."""
        newest = rows.agg(F.max("unix_time").alias("t")).select("t").scalar()
        marked = rows.withColumn("_old", F.col("unix_time") < newest - seconds)
        last = marked.where("_old").groupBy("cc_num").agg(F.max(F.struct(*[c for c in PAST if c != "cc_num"])).alias("r")).select("cc_num", "r.*")
        return marked.where("NOT coalesce(_old, false)").select(*PAST).unionByName(last.select(*PAST))

    return merge


def _login_totals(lateness: int) -> Callable[[DataFrame], DataFrame]:
    def merge(rows: DataFrame) -> DataFrame:
        """One row per card and second, and one for all seconds before the last ones, at the latest of them."""
        newest = rows.agg(F.max("unix_time").alias("t")).select("t").scalar()
        apart = F.when(F.col("unix_time") >= newest - lateness, F.col("unix_time"))
        sums = [F.sum("attempts").alias("attempts"), F.sum("failures").alias("failures"), F.max("changed").alias("changed")]
        return rows.groupBy("cc_num", apart.alias("_apart")).agg(F.max("unix_time").alias("unix_time"), *sums).drop("_apart")

    return merge


def login_rows(logins: DataFrame) -> DataFrame:
    """A login feed (LOGIN_COLUMNS) as rows of the state."""
    attempt = F.col("is_password_change") == 0
    return logins.select(*LOGIN_COLUMNS).select(
        "cc_num",
        "unix_time",
        F.when(attempt, 1).otherwise(0).cast("long").alias("attempts"),
        F.when(attempt, F.col("is_failure")).otherwise(0).cast("long").alias("failures"),
        F.when(F.col("is_password_change") == 1, F.col("unix_time")).alias("changed"),
    )


def _login_step() -> Step:
    """Login features from the state's totals, strictly before each row."""
    specs = {"_attempts": Running("sum", F.col("attempts")), "_failures": Running("sum", F.col("failures")), "_changed": Running("max", F.col("changed"))}
    step = running_before("logins", "cc_num", "unix_time", specs)

    def finish(df: DataFrame) -> DataFrame:
        return df.withColumns(
            {
                "LoginAttempts": F.coalesce("_attempts", F.lit(0)).cast("long"),
                "LoginFailureRate": F.round(safe_ratio("_failures", "_attempts"), 4),
                "DaysSincePasswordChange": (F.col("unix_time") - F.col("_changed")) / DAY,
            }
        ).drop(*specs)

    return Step(lambda df, part: finish(step.plain(df, part)), lambda df, part: finish(step.heavy(df, part)))


class OnlineFeatures:
    """The online state below ``path``, for rows with the columns of ``schema``."""

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        schema: T.StructType,
        profiles: Profiles,
        window: int = DEVIATION_SECONDS,
        lateness: int = LATENESS,
        heavy_rows: int = HEAVY_ROWS,
        fan: int = 8,
    ):
        past = T.StructType([schema[c] for c in PAST])
        self.rows = RunStore(spark, f"{path}/rows", past, _recent_rows(window + lateness), fan)
        self.logins = RunStore(spark, f"{path}/logins", LOGIN_STATE, _login_totals(lateness), fan)
        self.profiles, self.heavy_rows = profiles, heavy_rows

    def advance(self, rows: DataFrame, logins: DataFrame | None, batch_id: int) -> DataFrame:
        """All features of a micro-batch's rows; its rows and logins become part of the state. Replays give the same."""
        fresh = materialise(rows, "online-batch")
        self.rows.append(fresh.select(*PAST), batch_id)
        known = None
        if logins is not None:
            # The micro-batch's own logins second by second: the store puts old ones together.
            fresh_logins = login_rows(logins)
            self.logins.append(fresh_logins, batch_id)
            known = self.logins.before(batch_id).unionByName(fresh_logins)
        cards = fresh.select(F.col("cc_num").alias("_card")).distinct()

        def of_cards(df: DataFrame) -> DataFrame:
            return df.join(cards, F.col("cc_num").eqNullSafe(F.col("_card")), "left_semi")

        feeds = {} if known is None else {"logins": of_cards(known)}
        steps = past_steps(None if known is None else _login_step())
        return finish_features(run_past(fresh, steps, self.heavy_rows, feeds, of_cards(self.rows.before(batch_id))), self.profiles)


def feature_stream(
    stream: DataFrame,
    online: OnlineFeatures,
    store: Callable[[DataFrame, int], None],
    checkpoint: str,
    transactions: Callable[[DataFrame], DataFrame] | None = None,
    logins: Callable[[DataFrame], DataFrame] | None = None,
    trigger: Mapping[str, Any] = AVAILABLE_NOW,
) -> StreamingQuery:
    """Hand the features of every micro-batch to ``store``.

    ``transactions`` and ``logins`` read the two kinds of rows off a micro-batch; without them all rows are transactions.
    """

    def advance(rows: DataFrame, batch_id: int) -> None:
        fresh = rows if transactions is None else transactions(rows)
        store(online.advance(fresh, None if logins is None else logins(rows), batch_id), batch_id)

    return stream.writeStream.foreachBatch(advance).option("checkpointLocation", checkpoint).trigger(**trigger).start()
