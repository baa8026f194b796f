"""Jaccard join of word n-grams by PartEnum signatures.

Two sets of sizes a and b reach a similarity of p percent only if they differ in at most (a + b) (100 - p) / (100 + p) elements, and neither is
smaller than p percent of the other. Sizes are cut into bands so that similar sets lie in one band or two neighbouring ones; each
pair of neighbouring bands has its own partitioning of the domain of n-grams and its own largest difference k. The domain is dealt into
first-level parts and each of those into second-level cells. Of two sets that differ in at most k elements, at least one part holds
few enough differences to leave one of the enumerated subsets of its cells untouched: the sets have the same elements there and
share that part's signature. Nothing similar is missed, and only sets that share a signature are compared.

Parts whose subsets may be empty say little. Some parts more than needed are dealt, so that a set may leave as many out.
Large sets would have a signature for almost every word; they enumerate only as many of their parts as miss a pair at the threshold with
probability `miss` (0 enumerates all).

Signatures travel in blocks of packed numbers, one block for each task and receiving part, and are matched there. A signature that many sets of one
task share is announced by one entry, and its sets go on spread over all tasks, so that no common passage piles up in one. Classes
that share signatures form stars, which are compared exactly on full sets and put into groups.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txnrisk.llm import grouping as G
from txnrisk.llm import shingles as S
from txnrisk.llm.common import release, small_batches, table, text_slices, trim
from txnrisk.session import materialise

#: Up to this difference a band has one part, and all subsets that leave out as many cells are enumerated.
WHOLE = 3
#: Cells of a part beyond that; one of them is left out.
CELLS = 3
#: Spare parts: a share of those needed, and one.
SPARE = 0.08
MISS = 1e-12
#: Bytes of text hashed at once, signatures that a task packs at once, signatures a receiving part should have.
SLICE_BYTES, PACK, PART = 1_000_000, 2_000_000, 2_000_000
#: Sets of one task that share a signature before it counts as common.
COMMON = 64
#: Kinds of blocks: signatures with their sets; common ones, one entry each; sets of common ones.
PLAIN, ANNOUNCED, SPREAD = range(3)

KEYED = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("n_shingles", T.LongType()),
    T.StructField("set_key", T.BinaryType()),
    T.StructField("mark", T.LongType()),
])
PACKED = T.StructType([
    T.StructField("part", T.IntegerType()),
    T.StructField("kind", T.IntegerType()),
    T.StructField("marks", T.BinaryType()),
    T.StructField("refs", T.BinaryType()),
])
FOUND = T.StructType([T.StructField(c, T.LongType()) for c in ("bucket", "hub", "ref")])


class Bands:
    """Size bands for a threshold, and for each pair of neighbours (lower band i - 1, upper band i) how it deals the domain."""

    def __init__(self, percent: int, miss: float, largest: int):
        lows, highs = [1], [100 // percent]
        while highs[-1] < largest:
            lows.append(highs[-1] + 1)
            highs.append(100 * lows[-1] // percent)
        self.lows, self.highs = np.array(lows), np.array(highs)
        # Pair i joins sets of at most highs[i - 1] with sets of at most 100 / percent times that.
        below = np.array([0, *highs])
        self.k = (below + 100 * below // percent) * (100 - percent) // (100 + percent)
        self.parts = np.zeros(len(self.k), dtype=np.int64)
        self.used, self.spare = self.parts.copy(), self.parts.copy()
        for i, k in enumerate(self.k.tolist()):
            if k > WHOLE:
                need = k // 2 + 1  # a part with two differences or more is lost, so at most k // 2 are
                parts = math.ceil((1 + SPARE) * need) + 1
                one = 1 / parts
                whole = (1 - one) ** k + k * one * (1 - one) ** (k - 1)
                enough = math.ceil(math.log(miss) / math.log1p(-whole)) if miss else parts
                used = enough + math.ceil(0.1 * enough)
                self.parts[i] = parts
                self.used[i], self.spare[i] = (used, used - enough) if used < parts else (parts, parts - need)

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.highs, sizes)


@cache
def bands(percent: int, miss: float, largest: int) -> Bands:
    return Bands(percent, miss, largest)


def signatures(shingles: np.ndarray, counts: np.ndarray, percent: int, miss: float = MISS) -> tuple[np.ndarray, np.ndarray]:
    """(signatures of all sets, the set that each belongs to)."""
    plan = bands(percent, miss, 1 << max(1, int(counts.max(initial=1))).bit_length())
    own = plan.of(counts)
    out = []
    for above in (1, 0):  # a set is in the lower band of one pair and in the upper band of another
        pair = own + above
        # The upper band needs a signature only where a smaller partner can be in the lower one.
        least = -(-percent * counts // 100)
        meets = counts > 0 if above else (counts > 0) & (least <= np.append(0, plan.highs)[own])
        pair = np.where(meets, pair, 0)
        k = plan.k[pair]
        out.append(_enumerated(shingles, counts, pair, np.where(k > WHOLE, 0, k)))
        out.append(_dealt(shingles, counts, pair, np.where(k > WHOLE, plan.parts[pair], 0), plan))
    return np.concatenate([s for s, _ in out]), np.concatenate([o for _, o in out])


def _elements(counts: np.ndarray, chosen: np.ndarray, shingles: np.ndarray, pair: np.ndarray):
    """(set of each element of the chosen sets, its place drawn for the pair of bands, its value)."""
    owner = np.repeat(np.arange(len(counts)), counts)
    taken = chosen[owner]
    owner, element = owner[taken], shingles[taken]
    place = S.mix64(element ^ S.mix64(pair[owner].astype(np.uint64) * S._WORD))
    return owner, place, S.mix64(element + S._BASE)


def _enumerated(shingles, counts, pair, k) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of small sets: one part of 2 k + 2 cells, every subset without k cells."""
    found = [(np.empty(0, np.uint64), np.empty(0, np.int64))]
    for difference in sorted(set(k[k > 0].tolist())):
        chosen = k == difference
        cells = 2 * difference + 2
        owner, place, value = _elements(counts, chosen, shingles, pair)
        at = np.zeros(len(counts), dtype=np.int64)
        at[chosen] = np.arange(chosen.sum())
        sums = np.zeros(int(chosen.sum()) * cells, dtype=np.uint64)
        np.add.at(sums, at[owner] * cells + (place % np.uint64(cells)).astype(np.int64), value)
        sums = sums.reshape(-1, cells)
        tag = S.mix64(pair[chosen].astype(np.uint64) + S._STEP)
        for n, kept in enumerate(combinations(range(cells), cells - difference)):
            found.append((S.mix64(sums[:, kept].sum(axis=1, dtype=np.uint64) + tag + np.uint64((n + 1) * int(S._WORD) % 2**64)), np.flatnonzero(chosen)))
    return np.concatenate([s for s, _ in found]), np.concatenate([o for _, o in found])


def _dealt(shingles, counts, pair, parts, plan: Bands) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of larger sets: of each part, the subsets without one of its cells."""
    chosen = parts > 0
    owner, place, value = _elements(counts, chosen, shingles, pair)
    used = np.where(chosen, plan.used[pair], 0)
    part = ((place >> np.uint64(32)) * parts[owner].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
    kept = part < used[owner]
    owner, place, part, value = owner[kept], place[kept], part[kept], value[kept]
    first = np.cumsum(used) - used
    cell = (first[owner] + part) * CELLS + ((place & np.uint64(0xFFFFFFFF)) * np.uint64(CELLS) >> np.uint64(32)).astype(np.int64)
    total = int(used.sum())
    sums = np.zeros(total * CELLS, dtype=np.uint64)
    np.add.at(sums, cell, value)
    sums, filled = sums.reshape(-1, CELLS), np.bincount(cell, minlength=total * CELLS).reshape(-1, CELLS)
    whose = np.repeat(np.arange(len(counts)), used)
    number = np.arange(total) - first[whose]
    weak = filled.sum(axis=1) == filled.max(axis=1, initial=0)  # one of its subsets is empty
    few = np.bincount(whose, weights=weak, minlength=len(counts)) <= plan.spare[pair]
    stays = ~(weak & few[whose])
    tag = S.mix64((pair[whose].astype(np.uint64) << np.uint64(32)) + number.astype(np.uint64))
    left = sums.sum(axis=1, dtype=np.uint64)[:, None] - sums
    marks = S.mix64(left + tag[:, None] + np.arange(1, CELLS + 1, dtype=np.uint64) * S._STEP)
    return marks[stays].ravel(), np.repeat(whose[stays], CELLS)


def _refs(keys: list[bytes]) -> np.ndarray:
    """The first 40 bits of each class's key: a short pointer, which a few classes may share."""
    raw = np.frombuffer(b"".join(keys), np.uint8).reshape(-1, 16)[:, :5].astype(np.uint64)
    return (raw << np.arange(32, -1, -8, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def _pack(values: np.ndarray, size: int) -> bytes:
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].tobytes()


def _unpack(raw: bytes, size: int) -> np.ndarray:
    wide = np.zeros((len(raw) // size, 8), dtype=np.uint8)
    wide[:, :size] = np.frombuffer(raw, np.uint8).reshape(-1, size)
    return wide.view("<u8").ravel()


def keyed(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, set_key (null for no words) and mark of every document."""

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            for part in text_slices(batch, SLICE_BYTES):
                sets, counts = S.shingle_sets(part.column("text"), k)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(S.set_keys(sets, counts), pa.binary()), part.column("mark")], names=KEYED.fieldNames())
        trim()

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text", G.text_mark().alias("mark")).mapInArrow(key, KEYED)


def packed(docs: DataFrame, k: int, percent: int, miss: float, parts: int) -> DataFrame:
    """Blocks of signatures and class pointers (40 bits each): part says which task matches them.

    Of a signature only its part and 48 further bits are sent. The sets of a common one go to any part, with the whole signature.
    """

    def blocks(marks: np.ndarray, refs: np.ndarray) -> Iterator[tuple]:
        order = np.argsort(marks, kind="stable")
        marks, refs = marks[order], refs[order]
        opens = np.flatnonzero(np.append(True, marks[1:] != marks[:-1]))
        length = np.diff(np.append(opens, len(marks)))
        common = np.repeat(length >= COMMON, length)
        announced = np.zeros(len(marks), dtype=bool)
        announced[opens] = length >= COMMON
        for kind, rows in ((PLAIN, ~common), (ANNOUNCED, announced), (SPREAD, common)):
            if not rows.any():
                continue
            mark, ref = marks[rows], refs[rows]
            part = (ref if kind == SPREAD else mark) % np.uint64(parts)
            order = np.argsort(part, kind="stable")
            cuts = np.flatnonzero(np.append(True, np.diff(part[order]) != 0))
            for a, b in zip(cuts, [*cuts[1:], len(order)], strict=True):
                own = order[a:b]
                packed_marks = _pack(mark[own], 8) if kind == SPREAD else _pack(mark[own] // np.uint64(parts), 6)
                yield int(part[own[0]]), kind, packed_marks, _pack(ref[own], 5)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], names=PACKED.fieldNames())

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, refs, held, seen = [], [], 0, set()
        for source in batches:
            for part in text_slices(source, SLICE_BYTES):
                sets, counts = S.shingle_sets(part.column("text"), k)
                keys = S.set_keys(sets, counts)
                fresh = np.zeros(len(keys), dtype=bool)  # copies within a task send nothing
                for i, key in enumerate(keys):
                    if key is not None and key not in seen:
                        seen.add(key)
                        fresh[i] = True
                if len(seen) > 1_000_000:
                    seen.clear()
                if not fresh.any():
                    continue
                sets, counts = sets[np.repeat(fresh, counts)], counts[fresh]
                own, whose = signatures(sets, counts, percent, miss)
                marks.append(own)
                refs.append(_refs([key for key, f in zip(keys, fresh, strict=True) if f])[whose])
                held += len(own)
                if held >= PACK:
                    yield batch(list(blocks(np.concatenate(marks), np.concatenate(refs))))
                    marks, refs, held = [], [], 0
        if held:
            yield batch(list(blocks(np.concatenate(marks), np.concatenate(refs))))
        del marks, refs, seen
        trim()

    return small_batches(docs).select("text").mapInArrow(send, PACKED)


def matched(blocks: DataFrame, parts: int) -> DataFrame:
    """(bucket, hub, ref): pointers that share a signature, and the smallest of them; the hub is null for common signatures.

    Signatures that the same pointers share are one bucket.
    """

    def rows(bucket: np.ndarray, hub: np.ndarray | None, ref: np.ndarray) -> pa.RecordBatch:
        arrays = [pa.nulls(len(ref), pa.int64()) if v is None else pa.array(v.view(np.int64)) for v in (bucket, hub, ref)]
        return pa.RecordBatch.from_arrays(arrays, names=FOUND.fieldNames())

    def bucket(low: np.ndarray, part: np.ndarray | np.uint64) -> np.ndarray:
        return (low & np.uint64((1 << 48) - 1)) * np.uint64(parts) + part

    def match(part: int, held: list[tuple[int, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        marks, refs = np.concatenate([m for _, m, _ in held]), np.concatenate([r for *_, r in held])
        flags = np.repeat([kind == ANNOUNCED for kind, *_ in held], [len(m) for _, m, _ in held])
        order = np.lexsort((refs, marks))
        marks, refs, flags = marks[order], refs[order], flags[order]
        fresh = np.append(True, (marks[1:] != marks[:-1]) | (refs[1:] != refs[:-1])) | flags
        marks, refs, flags = marks[fresh], refs[fresh], flags[fresh]
        opens = np.flatnonzero(np.append(True, marks[1:] != marks[:-1]))
        length = np.diff(np.append(opens, len(marks)))
        run = np.repeat(np.arange(len(opens)), length)
        common = np.bincount(run, weights=flags, minlength=len(opens)) > 0
        # What the pointers of a run add up to names the run; equal runs are kept once.
        name = S.mix64(np.add.reduceat(S.mix64(refs), opens))
        kept = np.zeros(len(opens), dtype=bool)
        kept[np.unique(name, return_index=True)[1]] = True
        kept &= (length > 1) & ~common
        own = kept[run]
        if own.any():
            yield rows(name[run][own], refs[opens][run][own], refs[own])
        own = common[run]
        if own.any():
            yield rows(bucket(marks[own], np.uint64(part)), None, refs[own])

    def receive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for batch in batches:
            for part, kind, marks, refs in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                refs = _unpack(refs, 5)
                if kind == SPREAD:
                    whole = _unpack(marks, 8)
                    yield rows(bucket(whole // np.uint64(parts), whole % np.uint64(parts)), None, refs)
                    continue
                if part != now and held:
                    yield from match(now, held)
                    held = []
                now = part
                held.append((kind, _unpack(marks, 6), refs))
        if held:
            yield from match(now, held)
        del held
        trim()

    return blocks.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(receive, FOUND)


def buckets(docs: DataFrame, classes: DataFrame, k: int, percent: int, miss: float, parts: int) -> DataFrame:
    """Distinct (bucket, hub, set_key) of the classes that share a signature; the hub is one of them."""
    found = materialise(matched(packed(docs, k, percent, miss, parts), parts), "join-found")
    common = found.filter("hub is null").select("bucket", "ref").distinct()
    least = common.groupBy("bucket").agg(F.min("ref").alias("hub"), F.max("ref").alias("top")).filter("hub < top").select("bucket", "hub")
    pairs = found.filter("hub is not null").unionByName(common.join(least, "bucket"))
    pointed = classes.select("set_key", F.conv(F.hex(F.substring("set_key", 1, 5)), 16, 10).cast("long").alias("ref"))
    hubs = pointed.select(F.col("set_key").alias("hub_key"), F.col("ref").alias("hub"))
    out = pairs.join(pointed, "ref").join(hubs, "hub").select("bucket", F.col("hub_key").alias("hub"), "set_key")
    return materialise(out, "join-buckets")


def jaccard_join(docs: DataFrame, k: int = 5, percent: int = 80, miss: float = MISS, block: int = G.BLOCK, part: int = PART) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest doc_id that its links reach), kept, class_key.

    Words are lower-cased (A-Z) and lie between white space; a text of fewer than k words is one shingle. Documents are linked if
    100 * intersection >= percent * union of their sets (percent from 50 to 99). Null and blank texts have no shingles and are linked with
    nothing. Repeated rows get equal results; a null doc_id takes part, but names a group only where no other id is there. An empty
    table gives an empty result. Only doc_id and text are read, so other columns may have any name.
    """
    marked = materialise(keyed(docs, k), "join-keyed")
    size = marked.agg(F.sum("n_shingles").alias("n")).first()["n"] or 0
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // part))
    classes = materialise(G.classes_of(marked), "join-classes")
    shared = buckets(docs, classes, k, percent, miss, parts)
    return G.report(marked, G.connected(shared, classes, docs, k, percent, block))


def op12_jaccard_join(spark, sf_dir):
    return jaccard_join(table(spark, sf_dir, "documents"), k=5, percent=80).select("doc_id", "n_shingles", "component_id")


QUERIES = {"op12_jaccard_join": op12_jaccard_join}
ORACLE = {
    "op12_jaccard_join": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
sets AS (
  SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(list_slice(w, i, i + 4), ' ')) END)) AS s FROM words),
classes AS (SELECT min(doc_id) AS c, len(s) AS n, s FROM sets WHERE len(s) > 0 GROUP BY s),
tokens AS (SELECT c, n, unnest(s) AS t FROM classes),
frequent AS (SELECT t, count(*) AS f FROM tokens GROUP BY t HAVING count(*) > 1),
ranked AS (SELECT c, n, t, f, row_number() OVER (PARTITION BY c ORDER BY f, t) AS r, count(*) OVER (PARTITION BY c) AS k FROM tokens JOIN frequent USING (t)),
prefixes AS (SELECT c, n, t FROM ranked WHERE r <= k - ceil(n * 0.8) + 1),
pairs AS (SELECT DISTINCT a.c AS a, b.c AS b FROM prefixes a JOIN prefixes b ON a.t = b.t AND a.c < b.c AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
links AS (
  SELECT a, b FROM (SELECT pairs.a, pairs.b, x.n AS xn, y.n AS yn, len(list_intersect(x.s, y.s)) AS i
                    FROM pairs JOIN classes x ON x.c = pairs.a JOIN classes y ON y.c = pairs.b)
  WHERE 100 * i >= 80 * (xn + yn - i)),
ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(c, r) AS (SELECT c, c FROM classes UNION SELECT reach.c, ways.b FROM reach JOIN ways ON ways.a = reach.r),
roots AS (SELECT c, min(r) AS root FROM reach GROUP BY c)
SELECT doc_id, len(s)::BIGINT AS n_shingles, CASE WHEN len(s) = 0 THEN doc_id ELSE root END AS component_id
FROM sets LEFT JOIN classes USING (s) LEFT JOIN roots ON roots.c = classes.c
""",
}
