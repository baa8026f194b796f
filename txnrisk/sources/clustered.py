"""Transactions stored by card: the card windows of a job over such a table need no exchange.

Rows are dealt to buckets by a hash of the card and sorted by card and time inside each, one file a bucket. A scan then already has all rows of a
card in one task, so windows and statistics by card start from it; what is added later is another table of the same buckets.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame

from txnrisk.operators.sequence import ORDER
from txnrisk.session import run_folder


def write_clustered(df: DataFrame, buckets: int, path: str | None = None, name: str | None = None, key: str = "cc_num", order: Sequence[str] = ORDER) -> DataFrame:
    """Write a table of ``buckets`` files below ``path`` (default: the shared folder), known to the catalog as ``name``, and read it.

    Choose buckets so that one of them fits a task: a scan does not split it. Rows of one card share a bucket, so a card with more rows than a task should
    hold makes a long bucket; the operators still cut it into segments after the scan. Rows without a card are one bucket's.
    """
    spark = df.sparkSession
    name = name or f"clustered_{uuid.uuid4().hex}"
    # The same hash deals rows to tasks and to buckets: each task writes one file.
    writer = df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key, *order)
    writer.option("path", path or run_folder(spark, "clustered")).mode("overwrite").saveAsTable(name)
    return spark.table(name)
