"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of shuffled documents, repeated at most `max_repeats` times. A document's virtual finish time is
the cumulative size of its source up to and with it, divided by the source's weight. The mix is the global order of finish
times, cut at the total budget. Queues that run dry leave their share to the others, so that the words taken of a
source follow `source_targets`.

Nothing but (row, source, size, key) is shuffled. Cumulative sums go by buckets of bounded size: totals of each bucket are
added up first, and rows only meet the rows of their own bucket, so that a source may hold any share of all rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from txnrisk.llm.common import own_columns, running_offsets, space_words, table
from txnrisk.session import materialise

#: Rows that one task adds up one after the other.
BUCKET_ROWS = 25_000
#: Range of shuffle keys: 52 bits of a digest.
KEYS = 1 << 52


def document_sizes(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """One row per document: row (unique), doc_id, source, size (words between white space; null text: 0), key (shuffle key).

    Written to the shared folder, so that the texts are read once.
    """
    narrow = docs.select("doc_id", "source", F.size(space_words(F.col("text"))).cast("long").alias("size"))
    digest = F.md5(F.concat_ws("|", F.lit(seed), F.col("doc_id").cast("string"), F.col("source")).cast("binary"))
    key = F.conv(F.substring(digest, 1, 13), 16, 10).cast("long")
    return materialise(narrow.select(F.monotonically_increasing_id().alias("row"), "doc_id", "source", "size", key.alias("key")), "mix-sizes")


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), budget_share: float = 1.0, max_repeats: int = 3) -> DataFrame:
    """One row per source: source, source_size, weight, target, level.

    Sources by code point, null last, get the weights in turn and share `budget_share` of all sizes in proportion. No
    target exceeds `max_repeats` times the source's size; the excess is shared by the others by weight. `level` is the
    virtual time at which the budget is spent. Sources are a bounded vocabulary: their totals meet in one task.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = totals.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    turn = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    full = F.col("source_size") * max_repeats
    order = Window.orderBy(full / F.col("weight"), "rank")
    everything = Window.partitionBy()
    before = F.coalesce(F.sum(full).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    filled = (
        ranked.withColumn("weight", turn)
        .withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(budget_share)))
        .withColumn("own_level", (F.col("budget") - before) / left)
        .withColumn("open", full / F.col("weight") > F.col("own_level"))
        .withColumn("level", F.max(F.when(F.col("open"), F.col("own_level"))).over(everything))
    )
    target = F.when(F.col("open"), F.col("level") * F.col("weight")).otherwise(full.cast("double"))
    return filled.select("source", "source_size", "weight", target.alias("target"), "level", "budget")


def fair_queue(sizes: DataFrame, targets: DataFrame, max_repeats: int = 3) -> DataFrame:
    """The mix: one row per taken copy with row, source, size, repeat (from 1), finish, mix_start (words before it).

    Copies are ordered by (finish, source, key, row); the mix ends before the copy that would exceed the budget.
    """
    rows = sizes.count()
    parts = max(1, -(-rows // BUCKET_ROWS))
    bucketed = sizes.withColumn("bucket", F.floor(F.col("key") / F.lit(KEYS) * parts))
    by_source = running_offsets(bucketed.groupBy("source", "bucket").agg(F.sum("size").alias("n")), ["source"], "bucket", "n", "source_before").drop("n")
    # A source's row of totals is small; its rows of one bucket are as many as a task may add up.
    within = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size", "row")
    queued = bucketed.withColumn("inside", F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    offsets = by_source.withColumnsRenamed({"source": "o_source", "bucket": "o_bucket"})
    queued = queued.join(offsets, queued["source"].eqNullSafe(offsets["o_source"]) & (queued["bucket"] == offsets["o_bucket"])).drop("o_source", "o_bucket")
    named = targets.select(F.col("source").alias("t_source"), "source_size", "weight", "budget")
    # One row per source: broadcast by the optimizer as far as its measured size allows.
    queued = queued.join(named, queued["source"].eqNullSafe(named["t_source"])).drop("t_source")
    copies = (
        queued.withColumn("repeat", F.explode(F.sequence(F.lit(1), F.lit(max_repeats))))
        .withColumn("finish", ((F.col("repeat") - 1) * F.col("source_size") + F.col("source_before") + F.col("inside")) / F.col("weight"))
        .filter(F.col("size") > 0)
        .select("row", "source", "size", "key", "repeat", "finish", "budget")
    )
    copies = materialise(copies, "mix-copies")
    span = copies.agg(F.max("finish").alias("last"), F.count("*").alias("n")).first()
    cuts = max(1, -(-span["n"] // BUCKET_ROWS))
    step = F.lit(float(span["last"] or 1.0))
    ranged = copies.withColumn("slot", F.least(F.floor(F.col("finish") / step * cuts), F.lit(cuts - 1)))
    before = running_offsets(ranged.groupBy("slot").agg(F.sum("size").alias("n")), [], "slot", "n", "slot_before").drop("n")
    order = Window.partitionBy("slot").orderBy("finish", F.col("source").asc_nulls_last(), "key", "row")
    sums = ranged.withColumn("inside", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).join(before, "slot")
    end = F.col("slot_before") + F.col("inside")
    return sums.withColumn("mix_start", end - F.col("size")).filter(end <= F.col("budget")).select("row", "source", "size", "repeat", "finish", "mix_start")


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), budget_share: float = 1.0, max_repeats: int = 3, seed: str = "mix") -> DataFrame:
    """One row per document: doc_id, size, source_size, target (its source's), taken (words in the mix), repeats.

    Null and empty texts have size 0 and are taken with 0 words; null sources are one source, the last; repeated rows are
    documents of their own; a null doc_id is kept as it is; an empty table gives an empty result. Only doc_id, source
    and text are read of `docs`, so extra columns do not matter. Equal inputs give equal results.
    """
    sizes = document_sizes(docs, seed)
    targets = materialise(source_targets(sizes, weights, budget_share, max_repeats), "mix-targets")
    taken = fair_queue(sizes, targets, max_repeats).groupBy("row").agg(F.count("*").alias("repeats"))
    per_source = targets.select(F.col("source").alias("t_source"), "source_size", "target")
    out = sizes.join(taken, "row", "left").withColumn("repeats", F.coalesce("repeats", F.lit(0).cast("long")))
    out = out.join(per_source, out["source"].eqNullSafe(per_source["t_source"]))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken"), "repeats", "source")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix with all their columns, each as often as it is taken."""
    taken = mix(docs, **options).groupBy(F.col("doc_id").alias("mix_id"), F.col("source").alias("mix_source"), F.col("size").alias("mix_size")).agg(F.max("repeats").alias("mix_repeats"))
    size = F.size(space_words(docs["text"])).cast("long")
    same = docs["doc_id"].eqNullSafe(taken["mix_id"]) & docs["source"].eqNullSafe(taken["mix_source"]) & (size == taken["mix_size"])
    # A text without words costs nothing and stays once.
    times = F.when(taken["mix_size"] == 0, 1).otherwise(taken["mix_repeats"]).cast("int")
    return docs.join(taken, same).select(*own_columns(docs), F.explode(F.array_repeat(F.lit(0), times)).alias("__copy")).drop("__copy")


def op1_mix(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents"), weights=(5, 2, 1), budget_share=1.0, max_repeats=3).drop("repeats", "source")


QUERIES = {"op1_mix": op1_mix}

ORACLE = {
    "op1_mix": """
WITH words AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(concat_ws('|', 'mix', doc_id::VARCHAR, source)), 1, 13))::BIGINT AS k
  FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM words GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r FROM totals),
weighed AS (SELECT *, [5.0, 2.0, 1.0][(r % 3 + 1)::INT]::DOUBLE AS w, sum(source_size) OVER ()::DOUBLE AS budget FROM ranked),
levels AS (
  SELECT *, (budget - coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY 3 * source_size / w, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS own_level
  FROM weighed),
opened AS (SELECT *, 3 * source_size / w > own_level AS is_open FROM levels),
targets AS (
  SELECT *, max(CASE WHEN is_open THEN own_level END) OVER () AS level,
         CASE WHEN is_open THEN max(CASE WHEN is_open THEN own_level END) OVER () * w ELSE (3 * source_size)::DOUBLE END AS target
  FROM opened),
queued AS (
  SELECT doc_id, source, size, k, sum(size) OVER (PARTITION BY source ORDER BY k, doc_id, size ROWS UNBOUNDED PRECEDING) AS cum FROM words),
copies AS (
  SELECT q.*, e, budget, ((e - 1) * source_size + cum)::DOUBLE / w AS finish
  FROM queued q JOIN targets t ON q.source IS NOT DISTINCT FROM t.source, (SELECT unnest([1, 2, 3]) AS e)
  WHERE size > 0),
cut AS (SELECT *, sum(size) OVER (ORDER BY finish, source NULLS LAST, k, doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM copies),
taken AS (SELECT doc_id, sum(size)::BIGINT AS taken FROM cut WHERE upto <= budget GROUP BY doc_id)
SELECT q.doc_id, q.size, t.source_size, t.target, coalesce(taken.taken, 0)::BIGINT AS taken
FROM queued q JOIN targets t ON q.source IS NOT DISTINCT FROM t.source LEFT JOIN taken ON q.doc_id = taken.doc_id
""",
}
