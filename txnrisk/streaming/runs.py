"""A table that grows by micro-batches and is read as a few merged runs.

Every micro-batch is one run of level 0. When ``fan`` runs of a level are complete they are merged into one run of the next level, so
after n micro-batches a reader opens at most (fan - 1) runs of each of log(n) levels: the digits of n in base ``fan``. Which
runs those are follows from n alone. A replayed micro-batch writes the same runs again; merged runs are
dropped one micro-batch later, when no replay can ask for them any more.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

Merge = Callable[[DataFrame], DataFrame]


def covering(n: int, fan: int) -> list[tuple[int, int]]:
    """(level, run) that together hold the micro-batches 0 .. n - 1, oldest first."""
    out, level, size = [], 0, 1
    while size * fan <= n:
        level, size = level + 1, size * fan
    done = 0
    while n > done:
        if n - done >= size:
            out.append((level, done // size))
            done += size
        else:
            level, size = level - 1, size // fan
    return out


def merges(batch_id: int, fan: int) -> list[tuple[int, int]]:
    """(level, run) that become complete with this micro-batch, lowest first."""
    out, level, size = [], 1, fan
    while (batch_id + 1) % size == 0:
        out.append((level, batch_id // size))
        level, size = level + 1, size * fan
    return out


class RunStore:
    """Runs below ``path``; ``merge`` maps the rows of several runs to those of one and must not depend on their order.

    Micro-batches are numbered from 0 without gaps, as a streaming query does; an empty one is an empty run.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, merge: Merge, fan: int = 8):
        self.spark, self.path, self.schema, self.merge, self.fan = spark, path.rstrip("/"), schema, merge, fan

    def _folder(self, level: int, run: int) -> str:
        return f"{self.path}/level-{level}/run-{run}"

    def _read(self, runs: list[tuple[int, int]]) -> DataFrame:
        if not runs:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[self._folder(*r) for r in runs])

    def _write(self, rows: DataFrame, level: int, run: int) -> None:
        columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema]
        rows.select(*columns).write.mode("overwrite").parquet(self._folder(level, run))

    def before(self, batch_id: int) -> DataFrame:
        """All rows of earlier micro-batches."""
        return self._read(covering(batch_id, self.fan))

    def through(self, batch_id: int) -> DataFrame:
        return self.before(batch_id + 1)

    def newest(self) -> int:
        """The last complete micro-batch, -1 without one; lists level 0, which holds fewer than two times ``fan`` runs."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/level-0")
        files = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(folder):
            return -1
        whole = [s.getPath() for s in files.listStatus(folder) if files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
        return max((int(p.getName().removeprefix("run-")) for p in whole), default=-1)

    def append(self, rows: DataFrame, batch_id: int) -> None:
        """Store the rows of a micro-batch, whole or not at all, and merge what it completes."""
        self._write(self.merge(rows), 0, batch_id)
        for level, run in merges(batch_id, self.fan):
            parts = [(level - 1, run * self.fan + i) for i in range(self.fan)]
            self._write(self.merge(self._read(parts)), level, run)
        for level, run in merges(batch_id - 1, self.fan) if batch_id else []:
            self._drop([(level - 1, run * self.fan + i) for i in range(self.fan)])

    def _drop(self, runs: list[tuple[int, int]]) -> None:
        for run in runs:
            folder = self.spark._jvm.org.apache.hadoop.fs.Path(self._folder(*run))
            folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)
