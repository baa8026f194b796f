"""File sources and sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txnrisk.schema import DECISION_SCHEMA, INPUT_CONTRACT, TRANSACTION_SCHEMA


def read_transactions(spark: SparkSession, path: str, schema: T.StructType | None = TRANSACTION_SCHEMA, format: str | None = None) -> DataFrame:
    """CSV (also gzip) with a header, or Parquet.

    ``format`` is "csv" or "parquet"; without it the path's ending decides, and anything but .csv or .csv.gz is Parquet. Columns of a
    CSV are found by their header names: those of ``schema`` get its types (a value that cannot be read is null, and so is a column
    that the file lacks), others stay as text. With ``schema=None`` types are inferred, which reads the data twice. A gzip
    file is one task: convert it once with ``csv_to_parquet`` and read that. Text NaN becomes null.
    """
    name = path.rstrip("/").rsplit("/", 1)[-1].lower()
    if (format or ("csv" if name.endswith((".csv", ".csv.gz")) else "parquet")) == "parquet":
        return spark.read.parquet(path)
    reader = spark.read.option("header", True).option("nanValue", "NaN")
    raw = (reader if schema is not None else reader.option("inferSchema", True)).csv(path)
    if schema is not None:
        typed = [F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) if f.name in raw.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema]
        raw = raw.select(*typed, *[F.col(f"`{c}`") for c in raw.columns if c not in schema.names])
    floats = [f.name for f in raw.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return raw.withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in floats})


# Bytes of text that one task of a conversion sorts and writes; gzip text is taken for a tenth of its size.
CONVERTED_BYTES = 128_000_000
GZIP_RATIO = 10


def text_bytes(spark: SparkSession, source: str) -> int:
    """Bytes of text of a file or a folder of files, gzip ones among them unpacked by estimate."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(source)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(folder, True)
    size = 0
    while files.hasNext():
        file = files.next()
        size += file.getLen() * (GZIP_RATIO if file.getPath().getName().lower().endswith(".gz") else 1)
    return size


def csv_to_parquet(spark: SparkSession, source: str, target: str, schema: T.StructType | None = TRANSACTION_SCHEMA, partitions: int | None = None) -> None:
    """One-off conversion to date-partitioned Parquet.

    The range shuffle spreads an unsplittable gzip over the cluster, keeps a date in few files, and cuts a date
    that holds many rows by time. The number of partitions follows the size of the input unless it is given.
    """
    if partitions is None:
        partitions = max(1, -(-text_bytes(spark, source) // CONVERTED_BYTES))
    dated = with_event_date(read_transactions(spark, source, schema, format="csv"))
    write_transactions(dated.repartitionByRange(partitions, "event_date", "unix_time"), target)


def with_event_date(df: DataFrame, t: str = "unix_time") -> DataFrame:
    return df.withColumn("event_date", F.to_date(F.timestamp_seconds(t)))


def write_transactions(df: DataFrame, path: str, mode: str = "append") -> None:
    """Parquet partitioned by event date, so that period filters prune files."""
    with_event_date(df).write.mode(mode).partitionBy("event_date").parquet(path)


def split_period(df: DataFrame, cutoff: str = "2020-01-01") -> tuple[DataFrame, DataFrame]:
    """(train, test): event_date before the cut-off, and from it on."""
    dated = df if "event_date" in df.columns else with_event_date(df)
    day = F.lit(cutoff).cast("date")
    return dated.where(F.col("event_date") < day), dated.where(F.col("event_date") >= day)


def read_feed(spark: SparkSession, name: str, path: str, key: Sequence[str], check: bool = True) -> DataFrame:
    """A Parquet feed whose key must be unique; ``check`` counts duplicates and raises."""
    from txnrisk.operators.assemble import duplicate_keys

    feed = spark.read.parquet(f"{path.rstrip('/')}/{name}.parquet")
    if check and not duplicate_keys(feed, key).isEmpty():
        raise ValueError(f"feed {name!r} has duplicate keys on {list(key)}")
    return feed


def conform(df: DataFrame) -> DataFrame:
    """The serving input contract: six typed columns with defaults; other columns stay as they are.

    A missing column or a value that cannot be read as its type takes the default.
    """

    def column(name: str, kind: str, default) -> Column:
        value = F.col(name).try_cast(kind) if name in df.columns else F.lit(None)
        return F.coalesce(value, F.lit(default)).cast(kind).alias(name)

    extras = [F.col(c) for c in df.columns if c not in INPUT_CONTRACT]
    return df.select(*[column(n, k, v) for n, (k, v) in INPUT_CONTRACT.items()], *extras)


def write_decisions(df: DataFrame, path: str, batch_id: int | None = None) -> None:
    """Append decisions as Parquet, partitioned by scoring date.

    With a ``batch_id`` the rows go to their own folder, which a replay of the batch replaces, so a
    retried micro-batch is stored once.
    """
    out = df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in DECISION_SCHEMA])
    out = out.withColumn("decision_date", F.to_date("scored_at"))
    if batch_id is None:
        out.write.mode("append").partitionBy("decision_date").parquet(path)
    else:
        out.write.mode("overwrite").partitionBy("decision_date").parquet(f"{path.rstrip('/')}/batch_id={batch_id}")


def read_decisions(spark: SparkSession, path: str, since: str | None = None) -> DataFrame:
    """The decision log, from a scoring date on if given: earlier dates are pruned by partition."""
    log = spark.read.schema(T.StructType([*DECISION_SCHEMA.fields, T.StructField("decision_date", T.DateType())])).parquet(path)
    if since is not None:
        log = log.where(F.col("decision_date") >= F.lit(since).cast("date"))
    return log.select(*DECISION_SCHEMA.names)


def write_scored(df: DataFrame, path: str, csv: bool = False) -> None:
    """Scored table with all columns; ``csv`` writes gzip CSV part files with a header."""
    if csv:
        df.write.mode("overwrite").option("header", True).option("compression", "gzip").csv(path)
    else:
        df.write.mode("overwrite").parquet(path)
