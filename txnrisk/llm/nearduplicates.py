"""Near duplicates by SuperMinHash, banding, verification on full sets and grouping.

Texts become sets of word shingles; documents of equal sets are one class and are handled once. Signatures are cut into
bands, and classes that agree in a band meet in a bucket. The member of a bucket that agrees with most others (the hub; near
the middle of a family of copies) stands for it: the bucket's members become members of the hub's star. What follows, exact comparison in blocks
and components, is in ``grouping``: every two classes that share a bucket are either compared or already connected, and no group is capped. The
remaining chance is banding's own: `miss` for a pair at the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txnrisk.llm import grouping as G
from txnrisk.llm import shingles as S
from txnrisk.llm.common import release, small_batches, table, text_slices, trim
from txnrisk.session import materialise

ROWS = 5
#: Bytes of text that are signed at once.
SLICE_BYTES = 700_000

SIGNED = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("n_shingles", T.LongType()),
    T.StructField("set_key", T.BinaryType()),
    T.StructField("mark", T.LongType()),
    T.StructField("buckets", T.ArrayType(T.LongType())),
])


def signed(docs: DataFrame, k: int, percent: int, rows: int = ROWS, miss: float = 1e-6) -> DataFrame:
    """doc_id, n_shingles, set_key (null for no words), mark and band keys of every document."""
    bands = S.bands_for(percent / 100, rows, miss)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for part in text_slices(batch, SLICE_BYTES):
                sets, counts = S.shingle_sets(part.column("text"), k)
                keys = S.band_keys(S.super_minhash(sets, counts, bands * rows), rows)
                lists = pa.ListArray.from_arrays(np.arange(part.num_rows + 1, dtype=np.int32) * bands, keys.ravel())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(S.set_keys(sets, counts), pa.binary()), part.column("mark"), lists], names=SIGNED.fieldNames())
        trim()

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text", G.text_mark().alias("mark")).mapInArrow(sign, SIGNED)


def star_members(classes: DataFrame) -> DataFrame:
    """Distinct (hub, set_key): the classes that share a bucket with the hub, and the hub itself."""
    placed = classes.select("set_key", F.explode("buckets").alias("bucket"))
    sizes = placed.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    shared = materialise(placed.join(sizes, "bucket"), "near-buckets")
    degree = shared.groupBy("set_key").agg(F.sum("size").alias("degree"))
    hubs = shared.join(degree, "set_key").groupBy("bucket").agg(F.max(F.struct("degree", "set_key")).alias("top"))
    stars = shared.join(hubs.select("bucket", F.col("top.set_key").alias("hub")), "bucket")
    return stars.select("hub", "set_key").distinct()


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, rows: int = ROWS, miss: float = 1e-6, block: int = G.BLOCK) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id of its group), kept, class_key.

    Words are lower-cased (A-Z) and lie between white space; a text of fewer than k words is one shingle. Documents are linked if
    100 * intersection >= percent * union of their sets. Null and blank texts have no shingles, are linked with nothing and
    kept. Repeated rows get equal results; a null doc_id takes part, but names a group only where no other id is there. An empty
    table gives an empty result. Only doc_id and text are read.
    """
    marked = materialise(signed(docs, k, percent, rows, miss), "near-signed")
    classes = materialise(G.classes_of(marked, F.first("buckets").alias("buckets")), "near-classes")
    # A family of copies shares most of its buckets: a whole star is finished at once.
    shared = materialise(star_members(classes).select(F.col("hub").alias("bucket"), "hub", "set_key"), "near-shared")
    return G.report(marked, G.connected(shared, classes, docs, k, percent, block))


def deduplicated(docs: DataFrame, k: int = 5, percent: int = 80, **options) -> DataFrame:
    """The documents, all columns, with one of every group: that of the smallest doc_id.

    Rows of one doc_id stay or go together, but of rows that also have the same text only one stays.
    """
    found = materialise(near_duplicates(docs, k, percent, **options).select("doc_id", "kept"), "near-kept")
    ids = found.groupBy(F.col("doc_id").alias("own_id")).agg(F.max("kept").alias("own_kept"), F.count("*").alias("own_rows"))
    ids = materialise(ids.filter("not own_kept or own_rows > 1"), "near-ids")
    gone, twice = ids.filter("not own_kept"), ids.filter("own_kept")
    # Ids grow with the documents: the join is the same at every size.
    left = docs.join(gone.hint("merge"), docs["doc_id"].eqNullSafe(gone["own_id"]), "left_anti")
    if twice.isEmpty():
        return left
    same = left["doc_id"].eqNullSafe(twice["own_id"])
    return left.join(twice, same, "left_anti").unionByName(left.join(twice, same, "left_semi").dropDuplicates(["doc_id", "text"]))


def op9_near_duplicates(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85).drop("class_key")


QUERIES = {"op9_near_duplicates": op9_near_duplicates}

ORACLE = {
    "op9_near_duplicates": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
sets AS (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(list_slice(w, i, i + 2), ' ')) END)) AS s FROM words),
classes AS (SELECT min(doc_id) AS c, len(s) AS n, s FROM sets WHERE len(s) > 0 GROUP BY s),
tokens AS (SELECT c, n, unnest(s) AS t FROM classes),
frequent AS (SELECT t, count(*) AS f FROM tokens GROUP BY t HAVING count(*) > 1),
ranked AS (SELECT c, n, t, f, row_number() OVER (PARTITION BY c ORDER BY f, t) AS r, count(*) OVER (PARTITION BY c) AS k FROM tokens JOIN frequent USING (t)),
prefixes AS (SELECT c, n, t FROM ranked WHERE r <= k - ceil(n * 0.85) + 1),
pairs AS (SELECT DISTINCT a.c AS a, b.c AS b FROM prefixes a JOIN prefixes b ON a.t = b.t AND a.c < b.c AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)),
links AS (
  SELECT a, b FROM (SELECT pairs.a, pairs.b, x.n AS xn, y.n AS yn, len(list_intersect(x.s, y.s)) AS i
                    FROM pairs JOIN classes x ON x.c = pairs.a JOIN classes y ON y.c = pairs.b)
  WHERE 100 * i >= 85 * (xn + yn - i)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(c, r) AS (SELECT c, c FROM classes UNION SELECT reach.c, ways.b FROM reach JOIN ways ON ways.a = reach.r),
roots AS (SELECT c, min(r) AS root FROM reach GROUP BY c)
SELECT doc_id, len(s)::BIGINT AS n_shingles, CASE WHEN len(s) = 0 THEN doc_id ELSE root END AS component_id,
       doc_id = CASE WHEN len(s) = 0 THEN doc_id ELSE root END AS kept
FROM sets LEFT JOIN classes USING (s) LEFT JOIN roots ON roots.c = classes.c
""",
}
