"""Benchmark decontamination by a broadcast set of word n-grams, in DataFrame operations only.

Every item is cut into windows of n words (an item of fewer words is one window). The broadcast set holds a 128-bit digest
of each window under the hash of its anchor, the longest of its words. Documents are scanned once: each word is looked up as an
anchor, and a window of the document that would lie around it is verified by its digest. So every position is tested against
the whole set, but windows are only put together where one may be. Only hits leave the scan. A window is a fixed
number of bytes whatever its words, and windows are broadcast in blocks of at most `block` of them, so a benchmark of
any size costs more scans, never more memory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from txnrisk.llm.common import lower_ascii, table
from txnrisk.session import materialise

#: Characters between words (after lower-casing), as a character class body.
BREAKS = r"\x00-\x2F\x3A-\x60\x7B-\x7F"
N_WORDS = 10
#: Windows broadcast at once: about 100 bytes each.
BLOCK = 500_000


def item_words(text: Column) -> Column:
    """Lower-cased runs of letters, digits and characters beyond ASCII; null has none."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), f"[{BREAKS}]+", -1), "")


def _digest(words: Column) -> Column:
    return F.unhex(F.md5(F.array_join(words, " ").cast("binary")))


def item_windows(items: DataFrame, n: int = N_WORDS) -> DataFrame:
    """Distinct (item_id, len, anchor, offset, window) of all windows of all items.

    window is the digest of its words, anchor the hash of its longest word (the first of several) and offset that word's place.
    """
    words = items.select("item_id", item_words(F.col("text")).alias("words")).filter(F.size("words") > 0)
    length = F.least(F.size("words"), F.lit(n))
    starts = F.explode(F.sequence(F.lit(1), F.size("words") - length + 1))
    cut = words.withColumn("len", length).withColumn("at", starts).select("item_id", "len", F.expr("slice(words, at, len)").alias("gram"))
    longest = F.array_max(F.transform("gram", lambda w, i: F.struct(F.length(w).alias("chars"), (-i).alias("place"), w.alias("word"))))
    marked = cut.withColumn("longest", longest)
    anchor, offset = F.xxhash64("longest.word"), (-F.col("longest.place")).cast("int")
    return marked.select("item_id", "len", anchor.alias("anchor"), offset.alias("offset"), _digest(F.col("gram")).alias("window")).distinct()


def window_hits(docs: DataFrame, windows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Distinct (doc_id, digest, at, len, window): window occurs in the document at word `at` (from 0)."""
    grams = materialise(windows.select("len", "anchor", "offset", "window").distinct(), "benchmark-windows")
    parts = max(1, -(-grams.count() // block))
    text = docs.select("doc_id", _text_digest().alias("digest"), item_words(F.col("text")).alias("words"))
    scanned = text.select("doc_id", "digest", "words", F.posexplode("words").alias("place", "word"))
    found = None
    for part in range(parts):
        own = grams.filter(F.pmod(F.xxhash64("window"), F.lit(parts)) == part)
        here = _digest(F.expr("slice(words, place - offset + 1, len)"))
        inside = (F.col("place") >= F.col("offset")) & (F.col("place") - F.col("offset") + F.col("len") <= F.size("words"))
        same = (F.xxhash64("word") == F.col("anchor")) & F.when(inside, here == F.col("window")).otherwise(F.lit(False))
        hits = scanned.join(F.broadcast(own), same).select("doc_id", "digest", (F.col("place") - F.col("offset")).alias("at"), "len", "window")
        found = hits if found is None else found.unionAll(hits)
    return found.distinct()


def _text_digest() -> Column:
    """Names the document together with doc_id, so that rows of one id but other texts are kept apart."""
    return F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))


def contamination(docs: DataFrame, items: DataFrame, n: int = N_WORDS, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit (words inside any window), item_ids (sorted as strings), spans.

    `spans` are the merged (first word, word after the last) ranges, or null. Null and empty texts have no words and no hit;
    items without words have no windows and items without an id count for spans but not as items; repeated rows get equal
    results each; an empty benchmark or table gives no hits. Extra columns are ignored.
    """
    windows = materialise(item_windows(items, n), "item-windows")
    hits = materialise(window_hits(docs, windows, block), "window-hits")
    doc = ["doc_id", "digest"]
    # The hits of one document meet in one task, as its text does anyway.
    per_start = hits.groupBy(*doc, "at").agg(F.max("len").alias("len"))
    order = Window.partitionBy(*doc).orderBy("at")
    reach = F.max(F.col("at") + F.col("len")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    opened = per_start.withColumn("reach", F.coalesce(reach, F.lit(0))).withColumn("opens", (F.col("at") > F.col("reach")) | (F.col("reach") == 0))
    spans = opened.withColumn("span", F.sum(F.col("opens").cast("int")).over(order)).groupBy(*doc, "span").agg(F.min("at").alias("first"), F.max(F.col("at") + F.col("len")).alias("end"))
    per_doc = spans.groupBy(*doc).agg(F.sum(F.col("end") - F.col("first")).alias("n_hit"), F.sort_array(F.collect_list(F.struct("first", "end"))).alias("spans"))
    named = hits.select(*doc, "window").distinct().join(windows.select("window", "item_id").distinct(), "window")
    items_of = named.groupBy(*doc).agg(F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("item_ids"))
    found = per_doc.join(items_of.withColumnsRenamed({"doc_id": "i_id", "digest": "i_digest"}), F.col("doc_id").eqNullSafe(F.col("i_id")) & (F.col("digest") == F.col("i_digest")))
    found = found.select(F.col("doc_id").alias("f_id"), F.col("digest").alias("f_digest"), "n_hit", "item_ids", "spans")
    base = docs.select("doc_id", _text_digest().alias("digest"), F.size(item_words(F.col("text"))).cast("long").alias("n_words"))
    out = base.join(found, base["doc_id"].eqNullSafe(found["f_id"]) & (base["digest"] == found["f_digest"]), "left")
    none = F.array().cast("array<string>")
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("item_ids", none).alias("item_ids"), "spans", "digest")


def decontaminated(docs: DataFrame, items: DataFrame, n: int = N_WORDS, drop: str = "documents") -> DataFrame:
    """The documents without those that hold a window (drop="documents"), or without the words inside windows (drop="spans")."""
    found = contamination(docs, items, n).filter("n_hit > 0").select(F.col("doc_id").alias("hit_id"), F.col("digest").alias("hit_digest"), F.col("spans").alias("hit_spans")).distinct()
    same = docs["doc_id"].eqNullSafe(found["hit_id"]) & (_text_digest() == found["hit_digest"])
    if drop == "documents":
        # Hits grow with the documents: the join is the same at every size.
        return docs.join(found.hint("merge"), same, "left_anti")
    # A piece is a word with the breaks after it; breaks before the first word are a piece of their own.
    edge = r"\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F"  # breaks before lower-casing
    pieces = F.split(docs["text"], f"(?<=[{edge}])(?=[^{edge}])", -1)
    shift = F.when(docs["text"].rlike(f"^[{edge}]"), 1).otherwise(0)

    def outside(_, i):
        return ~F.exists(found["hit_spans"], lambda s: (i - shift >= s["first"]) & (i - shift < s["end"]))

    left = F.when(found["hit_spans"].isNull(), docs["text"]).otherwise(F.array_join(F.filter(pieces, outside), ""))
    return docs.join(found, same, "left").select(*[left.alias("text") if c == "text" else docs[f"`{c}`"] for c in docs.columns])


def op7_decontaminate(spark, sf_dir):
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), n=N_WORDS)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ",").cast("binary"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


QUERIES = {"op7_decontaminate": op7_decontaminate}

_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = {
    "op7_decontaminate": f"""
WITH d AS (SELECT doc_id, coalesce({_WORDS}, []) AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
win AS (
  SELECT DISTINCT item_id, n, list_slice(w, i, i + n - 1) AS g
  FROM (SELECT item_id, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM win),
scan AS (
  SELECT doc_id, i, n, list_slice(w, i, i + n - 1) AS g
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
hit AS (SELECT doc_id, i, scan.n, item_id FROM scan JOIN win USING (g)),
places AS (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS p FROM hit),
hits AS (SELECT doc_id, count(*) AS n_hit FROM places GROUP BY doc_id),
its AS (SELECT doc_id, list_sort(list(DISTINCT item_id::VARCHAR)) AS ids FROM hit GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(ids), 0)::BIGINT AS n_items,
       sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (doc_id) LEFT JOIN its USING (doc_id)
""",
}
