"""From candidate stars of documents to groups: exact comparison in blocks, then connected components.

Documents of equal shingle sets are one class, named by ``set_key``. A star is a hub class and the members that may be similar to it or to one
another. Stars are cut into blocks of bounded size, each with the hub, and all sets of a block are compared exactly inside one task, which
reports the links that connect it and never a list of pairs. Stars of more than one block are finished by their rarest shingles: of the classes
that share a bucket with another component, those that may be similar share one of these, and the classes outside the largest component of such
a meeting are compared with all of it. So every two classes of a bucket are either compared, already connected or too unlike by their rarest
shingles, and no bucket is capped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txnrisk.llm import shingles as S
from txnrisk.llm.common import release, text_slices, trim
from txnrisk.session import materialise

#: Sets of a star that are compared with one another in one task; sets and shingles of a block of those that are left to compare.
BLOCK, SETS, SHINGLES = 200, 1_000, 500_000
#: Bytes of text that are cut into shingles at once.
SLICE_BYTES = 1_000_000

EDGES = T.StructType([T.StructField("a", T.BinaryType()), T.StructField("b", T.BinaryType())])
SHINGLED = T.StructType([
    T.StructField("set_key", T.BinaryType()),
    T.StructField("root", T.BinaryType()),
    T.StructField("n_shingles", T.LongType()),
    T.StructField("shingles", T.ArrayType(T.LongType())),
])


def text_mark() -> F.Column:
    """A number that tells rows of one doc_id with different texts apart."""
    return F.xxhash64("text")


def classes_of(marked: DataFrame, *more: F.Column) -> DataFrame:
    """set_key, rep and rep_mark (smallest doc_id of the class and the mark of its text), from set_key, doc_id and mark."""
    mark = F.coalesce(F.min_by("mark", "doc_id"), F.min("mark"))
    return marked.filter("set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("rep"), mark.alias("rep_mark"), F.max("n_shingles").alias("n_shingles"), *more)


def class_texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(set_key, text) of the classes wanted (set_key, rep, rep_mark), written once: the one place where texts are shuffled."""
    texts = docs.select(F.col("doc_id").cast("long").alias("text_id"), text_mark().alias("mark"), "text")
    # Both sides grow with the corpus: merged at every size.
    same = F.col("text_id").eqNullSafe(F.col("rep")) & (F.col("mark") == F.col("rep_mark"))
    found = texts.join(wanted.hint("merge"), same).select("set_key", "text")
    # Repeated rows of one id and text are one.
    return materialise(found.groupBy("set_key").agg(F.first("text").alias("text")), "near-texts")


def _compare(k: int, percent: int):
    """Spanning links of the texts of each group, a run of rows with one (hub, i, j): asked ones with all."""

    def links(group: dict[bytes, np.ndarray], asked: set[bytes]) -> list[tuple[bytes, bytes]]:
        members = list(group)
        if len(members) < 2 or not asked:
            return []
        rows = np.array([m in asked for m in members])
        near = S.linked_pairs(np.concatenate(list(group.values())), np.array([len(x) for x in group.values()]), percent, rows)
        row_of, asked_at = np.cumsum(rows) - 1, np.flatnonzero(rows)
        found, left = [], np.ones(len(members), dtype=bool)
        for root in asked_at:
            if not left[root]:
                continue
            left[root], front = False, [root]
            while front:
                at = front.pop()
                others = np.flatnonzero(near[row_of[at]]) if rows[at] else asked_at[near[:, at]]
                reached = others[left[others]]
                left[reached] = False
                front += reached.tolist()
                found += [(members[x], members[root]) for x in reached]
        return found

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        name, group, asked = None, {}, set()  # the sets of one group are held
        for batch in batches:
            for part in text_slices(batch, SLICE_BYTES):
                found = []
                sets, counts = S.shingle_sets(part.column("text"), k)
                ends = np.cumsum(counts)
                names = zip(*(part.column(c).to_pylist() for c in ("hub", "i", "j")), strict=True)
                rows = zip(names, part.column("set_key").to_pylist(), part.column("asked").to_pylist(), S.set_keys(sets, counts), (ends - counts).tolist(), ends.tolist(), strict=True)
                for own_name, key, is_asked, own, a, b in rows:
                    if own_name != name:
                        found += links(group, asked)
                        name, group, asked = own_name, {}, set()
                    if key == own:
                        group[key] = sets[a:b].copy()
                        if is_asked:
                            asked.add(key)
                if found:
                    yield _edges(found)
        if found := links(group, asked):
            yield _edges(found)
        del group
        trim()

    return compare


def _edges(found: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    a, b = zip(*found, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])


def block_links(groups: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Links (a, b) that connect the asked classes of each group (hub, i, j) with its similar ones; a group is compared inside one task."""
    rows = groups.hint("merge").join(texts, "set_key").select("hub", "i", "j", "set_key", "asked", "text")
    return rows.repartition("hub", "i", "j").sortWithinPartitions("hub", "i", "j", "set_key").mapInArrow(_compare(k, percent), EDGES)


def components(links: DataFrame) -> DataFrame:
    """(a, root) of every linked class but the roots: alternating large and small stars until nothing changes."""
    now = materialise(links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "near-links")
    seen = None
    while True:
        state = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if state == seen:
            return now.withColumnRenamed("b", "root")
        seen = state
        both = now.unionAll(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        lows = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lows, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").unionAll(lows.withColumnRenamed("m", "b"))
        now = materialise(small.select("a", "b").distinct(), "near-links")


def _open(shared: DataFrame, stars: DataFrame, roots: DataFrame, block: int) -> DataFrame:
    """(set_key, root) of the classes of stars of several blocks that share a bucket with a class of another component."""
    large = stars.filter(F.col("n") > block).select("hub")
    named = roots.select(F.col("a").alias("set_key"), "root")
    known = shared.join(large, "hub").join(named, "set_key", "left")
    known = materialise(known.select("bucket", "set_key", F.coalesce("root", "set_key").alias("root")), "near-unfinished")
    several = known.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("bucket")
    return materialise(known.join(several, "bucket").select("set_key", "root").distinct(), "near-open")


def _shingled(k: int):
    """set_key, root, n_shingles and the shingles of each class, from its text."""

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for part in text_slices(batch, SLICE_BYTES):
                sets, counts = S.shingle_sets(part.column("text"), k)
                same = pa.array([a == b for a, b in zip(part.column("set_key").to_pylist(), S.set_keys(sets, counts), strict=True)])
                lists = pa.ListArray.from_arrays(np.append(0, np.cumsum(counts)).astype(np.int32), sets.view(np.int64))
                columns = [part.column("set_key"), part.column("root"), pa.array(counts, pa.int64()), lists]
                yield pa.RecordBatch.from_arrays(columns, names=SHINGLED.fieldNames()).filter(same)
        trim()

    return shingle


def _rare_stars(left: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """(hub, set_key, n_shingles, root): classes of several components that share one of their rarest shingles, under the smallest class of those.

    Two similar sets have percent of the larger one in common, so the rarest shingle of all that they share is among the first of each when all but
    so many of its shared shingles are left out. A passage that many unlike texts hold comes last and brings nobody together.
    """
    rows = texts.join(left.hint("merge"), "set_key").select("set_key", "root", "text").mapInArrow(_shingled(k), SHINGLED)
    placed = rows.select("set_key", "root", "n_shingles", F.explode("shingles").alias("shingle"))
    placed = placed.withColumn("often", F.count(F.lit(1)).over(Window.partitionBy("shingle"))).filter("often > 1")
    own = Window.partitionBy("set_key")
    placed = placed.withColumns({"place": F.row_number().over(own.orderBy("often", "shingle")), "shared": F.count(F.lit(1)).over(own)})
    first = placed.filter(F.expr(f"place <= shared - (n_shingles * {percent} + 99) div 100 + 1"))
    met = Window.partitionBy("shingle")
    met = first.select("set_key", "n_shingles", "root", F.min("set_key").over(met).alias("hub"), F.min("root").over(met).alias("low"), F.max("root").over(met).alias("high"))
    return materialise(met.filter("low < high").select("hub", "set_key", "n_shingles", "root").distinct(), "near-rare")


def _unfinished(known: DataFrame) -> DataFrame:
    """Groups (hub, i, j, set_key, asked) to compare: of each star, the classes outside its largest component with all of it.

    The apart classes are asked: blocks of them meet blocks of all, as large as SETS and SHINGLES allow, so that a star is copied seldom.
    """
    parts = known.groupBy("hub", "root").agg(F.count("*").alias("own"), F.sum("n_shingles").alias("size"))
    main = parts.groupBy("hub").agg(
        F.max_by("root", F.struct("own", "root")).alias("main"), F.sum("own").alias("n"), F.sum("size").alias("size"),
        (F.sum("own") - F.max("own")).alias("n_apart"), (F.sum("size") - F.max_by("size", F.struct("own", "root"))).alias("apart_size"),
    )
    cut = known.join(main, "hub")
    i_of, j_of = (F.ceil(F.greatest(F.col(n) / SETS, F.col(size) / SHINGLES)).cast("int") for n, size in (("n_apart", "apart_size"), ("n", "size")))
    key, apart = F.xxhash64("set_key", "hub"), F.col("root") != F.col("main")
    left = cut.filter(apart).withColumn("i", F.pmod(key, i_of).cast("int")).withColumn("j", F.explode(F.sequence(F.lit(0), j_of - 1)))
    right = cut.withColumn("j", F.pmod(key, j_of).cast("int")).withColumn("i", F.explode(F.sequence(F.lit(0), i_of - 1)))
    both = left.select("hub", "i", "j", "set_key", F.lit(True).alias("asked")).unionAll(right.select("hub", "i", "j", "set_key", F.lit(False).alias("asked")))
    return both.groupBy("hub", "i", "j", "set_key").agg(F.max("asked").alias("asked"))


def connected(shared: DataFrame, classes: DataFrame, docs: DataFrame, k: int, percent: int, block: int = BLOCK) -> DataFrame:
    """(set_key, component) of every class: the smallest rep that its links reach.

    `shared` holds (bucket, hub, set_key) as a written table: the classes of each bucket, all to be compared, and the one of them whose star they join.
    """
    members = materialise(shared.select("hub", "set_key").distinct(), "near-stars")
    counts = members.groupBy("hub").agg(F.count("*").alias("n")).filter("n > 1")
    blocked = members.join(counts, "hub").withColumn("i", F.pmod(F.xxhash64("set_key"), F.ceil(F.col("n") / block)).cast("int"))
    wanted = materialise(classes.join(blocked.select("set_key").distinct(), "set_key").select("set_key", "rep", "rep_mark"), "near-wanted")
    texts = class_texts(docs, wanted)
    # The hub goes into every block.
    others = blocked.filter("set_key <> hub").select("hub", "i", "set_key")
    groups = others.unionAll(others.select("hub", "i").distinct().withColumn("set_key", F.col("hub"))).withColumns({"j": F.lit(0), "asked": F.lit(True)})
    roots = components(block_links(groups, texts, k, percent))
    if not counts.filter(F.col("n") > block).isEmpty():
        stars = _rare_stars(_open(shared, counts, roots, block), texts, k, percent)
        rest = block_links(_unfinished(stars), texts, k, percent)
        roots = components(roots.withColumnRenamed("root", "b").unionAll(rest))

    grouped = classes.select("set_key", "rep").join(roots.select(F.col("a").alias("set_key"), "root"), "set_key", "left")
    grouped = materialise(grouped.select("set_key", "rep", F.coalesce("root", "set_key").alias("group_key")), "near-groups")
    lowest = grouped.groupBy("group_key").agg(F.min("rep").alias("component"))
    return materialise(grouped.join(lowest, "group_key").select("set_key", "component"), "near-components")


def report(marked: DataFrame, placed: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, class_key of every document, from its set_key and the component of that."""
    out = marked.select("doc_id", "n_shingles", "set_key").join(placed, "set_key", "left")
    component = F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("component"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), F.col("set_key").alias("class_key"))
