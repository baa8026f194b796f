"""Removal of repeated passages by content-defined chunks of lines, in DataFrame operations only.

A document is cut after every line at which a rolling hash of the last lines is divisible by a constant, so cuts move with the
text around them and a passage of several lines is cut alike wherever it stands. Chunks of several lines whose digest
occurs more than once anywhere are compared byte by byte; all but the first occurrence, by (doc_id, place), are removed.

Only digests are shuffled for the count; texts of repeated chunks alone are compared. Tables that grow with the documents are joined
by merging at every size, so the plan that a small table gets is the one that a large table needs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from txnrisk.llm.common import table
from txnrisk.session import materialise

#: A cut is made where the hash of two lines is divisible by this: the mean length of a chunk in lines.
DIVISOR = 4
#: Lines a chunk needs to be removed.
MIN_LINES = 2


def _digest() -> Column:
    return F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))


def chunks(docs: DataFrame, divisor: int = DIVISOR, min_lines: int = MIN_LINES) -> DataFrame:
    """doc_id, digest, n_lines, first (line, from 0), lines (number), body of every chunk of at least min_lines that is not blank."""
    split = docs.filter("text is not null").select("doc_id", _digest().alias("digest"), F.split("text", "\n", -1).alias("all"))
    hashed = split.withColumn("h", F.transform("all", lambda line: F.conv(F.substring(F.md5(line.cast("binary")), 1, 8), 16, 10).cast("long")))
    cuts = f"filter(sequence(0, size(all) - 1), i -> i = size(all) - 1 or (if(i = 0, 0, h[i - 1]) * 31 + h[i]) % {divisor} = 0)"
    ranges = "transform(cuts, (e, k) -> struct(if(k = 0, 0, cuts[k - 1] + 1) AS first, e + 1 - if(k = 0, 0, cuts[k - 1] + 1) AS lines))"
    placed = hashed.withColumn("cuts", F.expr(cuts)).select("doc_id", "digest", "all", F.inline(F.expr(f"filter({ranges}, r -> r.lines >= {min_lines})")))
    body = F.array_join(F.slice("all", F.col("first") + 1, F.col("lines")), "\n")
    return placed.select("doc_id", "digest", "first", "lines", body.alias("body")).filter(F.btrim("body", F.lit(" \t\n\x0b\x0c\r")) != "")


def repeated(docs: DataFrame, divisor: int = DIVISOR, min_lines: int = MIN_LINES) -> DataFrame:
    """Distinct (doc_id, digest, first, lines) of the chunks to remove: occurrences but the first of chunks with equal bytes."""
    every = chunks(docs, divisor, min_lines).withColumn("chunk", F.unhex(F.md5(F.col("body").cast("binary"))))
    # The same row twice is one document.
    often = materialise(every.groupBy("chunk").agg(F.count("*").alias("n")).filter("n > 1").select("chunk"), "chunk-digests")
    texts = materialise(every.join(often.hint("merge"), "chunk", "left_semi").select("chunk", "body", "doc_id", "digest", "first", "lines"), "chunk-texts")
    # One text a chunk: the first occurrence's; the others are compared with it.
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "digest", "first")
    kept = texts.groupBy("chunk").agg(F.min(F.struct(place.alias("place"), F.col("body").alias("kept_body"))).alias("kept"))
    kept = materialise(kept.select("chunk", "kept.place", "kept.kept_body"), "chunk-first")
    other = texts.join(kept.hint("merge"), "chunk").filter((F.col("body") == F.col("kept_body")) & (place != F.col("place")))
    return other.select("doc_id", "digest", "first", "lines").distinct()


def without_repeats(docs: DataFrame, divisor: int = DIVISOR, min_lines: int = MIN_LINES) -> DataFrame:
    """One row per document: doc_id, n_lines, removed (lines), text (what is left, null for null).

    Texts are cut at newlines, whole and of any length; a null text has 0 lines. A chunk that fills a whole document is removed like any
    other, so a later copy of a document loses all its chunks of several lines. Rows with equal doc_id and text are one document;
    rows without a doc_id come last. An empty table gives an empty result. Only doc_id and text are read.
    """
    gone = materialise(repeated(docs, divisor, min_lines), "chunk-repeats")
    per_doc = gone.groupBy(F.col("doc_id").alias("g_id"), F.col("digest").alias("g_digest")).agg(F.collect_list(F.struct("first", "lines")).alias("gone"))
    rows = docs.select("doc_id", "text", _digest().alias("digest"))
    joined = rows.join(per_doc.hint("merge"), rows["doc_id"].eqNullSafe(per_doc["g_id"]) & (rows["digest"] == per_doc["g_digest"]), "left")
    lines = joined.withColumn("all", F.split("text", "\n", -1))
    # Marks of removed lines, then one pass over the lines.
    marks = F.expr("flatten(transform(gone, g -> sequence(g.first, g.first + g.lines - 1)))")
    marked = lines.withColumn("marks", F.when(F.col("gone").isNotNull(), F.map_from_entries(F.transform(marks, lambda i: F.struct(i, F.lit(True))))))
    left = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.expr("array_join(filter(all, (line, i) -> not coalesce(marks[i], false)), '\\n')"))
    removed = F.coalesce(F.expr("cast(aggregate(gone, 0, (a, g) -> a + g.lines) as long)"), F.lit(0).cast("long"))
    return marked.select("doc_id", F.coalesce(F.size("all"), F.lit(0)).cast("long").alias("n_lines"), removed.alias("removed"), left.alias("text"))


def op4_line_chunks(spark, sf_dir):
    found = without_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))


QUERIES = {"op4_line_chunks": op4_line_chunks}

ORACLE = {
    "op4_line_chunks": r"""
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL),
hashed AS (SELECT doc_id, l, list_transform(l, lambda x: ('0x' || substr(md5(x), 1, 8))::BIGINT) AS h FROM d),
cut AS (SELECT doc_id, l, list_filter(range(1, len(l) + 1), lambda i: i = len(l) OR ((CASE WHEN i = 1 THEN 0 ELSE h[i - 1] END) * 31 + h[i]) % 4 = 0) AS e FROM hashed),
parts AS (SELECT doc_id, l, e[k] AS last, CASE WHEN k = 1 THEN 1 ELSE e[k - 1] + 1 END AS first FROM (SELECT *, unnest(range(1, len(e) + 1)) AS k FROM cut)),
c AS (SELECT doc_id, first, last, array_to_string(l[first:last], chr(10)) AS body FROM parts WHERE last - first >= 1),
useful AS (SELECT * FROM c WHERE regexp_matches(body, '[^\x20\x09-\x0D]')),
ordered AS (SELECT *, row_number() OVER (PARTITION BY body ORDER BY doc_id, first) AS r FROM useful),
gone AS (SELECT doc_id, unnest(range(first, last + 1)) AS i FROM ordered WHERE r > 1),
marks AS (SELECT doc_id, list(i) AS gone FROM gone GROUP BY doc_id)
SELECT documents.doc_id, coalesce(len(l), 0)::BIGINT AS n_lines, coalesce(len(gone), 0)::BIGINT AS removed,
       sha256(CASE WHEN gone IS NULL THEN coalesce(text, '')
              ELSE coalesce(array_to_string(list_transform(list_filter(range(1, len(l) + 1), lambda i: NOT list_contains(gone, i)), lambda i: l[i]), chr(10)), '') END) AS text_sha256
FROM documents LEFT JOIN d USING (doc_id) LEFT JOIN marks USING (doc_id)
""",
}
