"""What several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space between words, as a character class body.
SPACE = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def own_columns(df: DataFrame) -> list[Column]:
    """The frame's columns by reference, so that joined columns of the same name do not matter."""
    return [df[f"`{c}`"] for c in df.columns]


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else. Plain ASCII takes lower(), which is many times faster than translate()."""
    ascii_only = F.octet_length(text) == F.length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))


def space_words(text: Column) -> Column:
    """The words of a text between white space (space, tab to carriage return); null and blank texts have none."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, f"[{SPACE}]+", -1))


#: What a Python worker keeps between tasks: at most one operator's state, by (operator, parameters).
_HELD: dict[tuple, object] = {}
#: Bytes of a batch of rows that Spark hands to a Python worker.
BATCH_BYTES = 4_000_000


def held(name: str, key: object, build: Callable[[], object]) -> object:
    """The state of an operator in this worker, built at first use. What other operators have left here goes."""
    if (name, key) not in _HELD:
        release()
        _HELD[name, key] = build()
    return _HELD[name, key]


def release() -> None:
    """Drop what earlier operators have left in this worker; workers are reused from stage to stage."""
    _HELD.clear()
    gc.collect()
    trim()


def trim() -> None:
    """Give free memory back at the end of a task: the worker lives on beside the executor's later stages, also those without Python."""
    pa.default_memory_pool().release_unused()
    if free := getattr(ctypes.CDLL(None), "malloc_trim", None):  # the C library of Linux
        free(0)


def small_batches(df: DataFrame) -> DataFrame:
    """The frame, with its session set to hand rows to Python in batches of bounded bytes: texts may be long."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(df.sparkSession.conf.get(name).rstrip("b")) > BATCH_BYTES:
        df.sparkSession.conf.set(name, f"{BATCH_BYTES}b")
    return df


def text_slices(batch: pa.RecordBatch, size: int) -> Iterator[pa.RecordBatch]:
    """The rows of an Arrow batch in runs of about `size` bytes of column text, to bound what a Python worker holds."""
    length = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
    run = (np.cumsum(length) - length) // size
    cuts = np.append(np.flatnonzero(np.diff(run, prepend=-1)), len(run))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield batch.slice(int(a), int(b - a))


def running_offsets(totals: DataFrame, by: list[str], order: str, value: str, name: str) -> DataFrame:
    """Adds the sum of the value over earlier rows of the group; for small tables of bucket totals."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return totals.withColumn(name, F.coalesce(F.sum(value).over(w), F.lit(0).cast("long")))
