"""As-of lookups on account event feeds, login history and password age."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnrisk.functions import cut_right_closed, safe_ratio
from txnrisk.operators.sequence import LINEAR_HEAVY_ROWS
from txnrisk.plans.hotkeys import Part, Step, run_steps
from txnrisk.plans.running import Running, carried_running, plain_running, time_segment

# Right-closed edges of the password-age buckets, in days, and the age standing for "never".
PASSWORD_AGE_EDGES = [-1, 1, 7, 30, 365, 9999]
NEVER_CHANGED_DAYS = 9999
DAY = 86_400


def running_before(feed: str, key: str, t: str, specs: dict[str, Running]) -> Step:
    """Running aggregates of a feed strictly before each row, through one union and one window per key.

    At equal times rows sort before feed events, so an event never reaches a row of its own second.
    ``specs`` read the columns of the feed and ``_event_time``; all are null on the rows.
    """
    order = [F.col("_at"), F.col("_kind")]

    place = [F.col(key).alias("_key"), F.col(t).alias("_at"), F.lit(0).alias("_kind")]

    def union(df: DataFrame, part: Part) -> tuple[DataFrame, DataFrame]:
        rows = df.select(*place, F.struct(*[c for c in df.columns if c != key]).alias("_row"))
        source = part.feeds[feed]
        events = source.select(
            F.col(key).alias("_key"),
            F.col(t).alias("_at"),
            F.lit(1).alias("_kind"),
            *[F.col(c) for c in source.columns if c not in (key, t)],
            F.col(t).alias("_event_time"),
        )
        return rows.unionByName(events, allowMissingColumns=True), events

    def finish(out: DataFrame) -> DataFrame:
        # The key comes back from the window's own column, so the rows stay partitioned by it.
        return out.where(F.col("_kind") == 0).select(F.col("_key").alias(key), "_row.*", *specs)

    def plain(df: DataFrame, part: Part) -> DataFrame:
        stream, _ = union(df, part)
        return finish(plain_running(stream, ["_key"], order, specs))

    def heavy(df: DataFrame, part: Part) -> DataFrame:
        stream, events = union(df, part)
        history = part.base.select(*place).unionByName(events, allowMissingColumns=True)
        return finish(carried_running(stream, ["_key"], time_segment("_at", part.segment_seconds), order, specs, history=history))

    return Step(plain, heavy)


def asof_latest(
    txn: DataFrame, events: DataFrame, key: str, t: str, name: str = "latest_time", heavy_rows: int = LINEAR_HEAVY_ROWS
) -> DataFrame:
    """Time of the latest event of the same key strictly before each row of ``txn``; null without one."""
    step = running_before("events", key, t, {name: Running("max", F.col("_event_time"))})
    return run_steps(txn, [step], keys=[key], min_rows=heavy_rows, feeds={"events": events.select(key, t)}, t=t)


def login_history(feed: str = "logins", key: str = "cc_num", t: str = "unix_time") -> Step:
    """LoginAttempts, LoginFailureRate and DaysSincePasswordChange; password changes are not attempts."""
    attempt = F.col("is_password_change") == 0
    specs = {
        "_attempts": Running("sum", F.when(attempt, 1).otherwise(0)),
        "_failures": Running("sum", F.when(attempt, F.col("is_failure")).otherwise(0)),
        "_changed": Running("max", F.when(F.col("is_password_change") == 1, F.col("_event_time"))),
    }
    step = running_before(feed, key, t, specs)

    def finish(df: DataFrame) -> DataFrame:
        return df.withColumns(
            {
                "LoginAttempts": F.coalesce("_attempts", F.lit(0)).cast("long"),
                "LoginFailureRate": F.round(safe_ratio("_failures", "_attempts"), 4),
                "DaysSincePasswordChange": (F.col(t) - F.col("_changed")) / DAY,
            }
        ).drop(*specs)

    return Step(lambda df, part: finish(step.plain(df, part)), lambda df, part: finish(step.heavy(df, part)))


LOGIN_COLUMNS = ["cc_num", "unix_time", "is_failure", "is_password_change"]


def add_login_features(txn: DataFrame, logins: DataFrame, heavy_rows: int = LINEAR_HEAVY_ROWS) -> DataFrame:
    """Login history strictly before each transaction; ``logins`` holds LOGIN_COLUMNS, flags as 0/1."""
    return run_steps(txn, [login_history()], min_rows=heavy_rows, feeds={"logins": logins.select(*LOGIN_COLUMNS)})


def password_bucket(days: Column | str) -> Column:
    days = F.col(days) if isinstance(days, str) else days
    filled = F.coalesce(days, F.lit(NEVER_CHANGED_DAYS))
    return cut_right_closed(filled, PASSWORD_AGE_EDGES, range(len(PASSWORD_AGE_EDGES) - 1)).cast("int")


def add_password_features(df: DataFrame) -> DataFrame:
    """NullPwdChange, HasPasswordChange and DaysSincePasswordChangeBucket."""
    days = F.col("DaysSincePasswordChange")
    return df.withColumns(
        {
            "NullPwdChange": days.isNull().cast("int"),
            "HasPasswordChange": days.isNotNull().cast("int"),
            "DaysSincePasswordChangeBucket": password_bucket(days),
        }
    )
