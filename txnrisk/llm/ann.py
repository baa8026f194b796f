"""Approximate nearest neighbours by balanced posting lists.

A bounded sample is split into balanced clusters; their centroids are kept in memory with a neighbour graph, in which the closest
centroids of any vector are found by best-first search. Every vector goes to the lists of its closest centroids; vectors near a
boundary, by the ratio of distances, go to several. A query reads the lists whose centroids are within a ratio of its
closest one. Lists and queries meet in blocks of bounded size, where distances are computed exactly in double precision.
Queries that find too few neighbours in their lists search all of them.

How many lists a query reads is measured: a sample of queries is compared with every vector, and lists are added until the sample's
recall is RECALL. If that many lists cost as much as all vectors, as in data without clusters, every query is compared with all vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txnrisk.llm.common import table
from txnrisk.session import materialise

#: Vectors a list is planned for; bounds of the number of lists and of the sample (rows, values).
LIST_ROWS, MAX_LISTS, SAMPLE_ROWS, SAMPLE_VALUES = 128, 4_096, 65_536, 8_000_000
#: Copies of a vector near a boundary, and how much further their centroids may be.
REPLICAS, REPLICA_RATIO = 4, 1.15
#: Lists that a query reads if they give the recall, how much further their centroids may be, and how many it reads at least.
PROBES, PROBE_RATIO, LEAST_PROBES = 128, 1.4, 8
#: Recall that the lists must reach on a sample of so many queries (and so many values of their neighbours).
RECALL, RECALL_QUERIES, RECALL_VALUES = 0.99, 200, 4_000_000
#: Planning figure: sending a query to a list counts as comparing it with so many rows.
ASK_ROWS = 512
#: Neighbours of a centroid in the graph: closest ones and random ones.
CLOSE_LINKS, RANDOM_LINKS = 16, 4
#: Vectors and queries of a list that meet in one task.
BLOCK_ROWS, BLOCK_QUERIES = 20_000, 500
SEED = 17


class CentroidGraph:
    """Centroids and the links along which the closest ones are found."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        n = len(centroids)
        rng = np.random.default_rng(SEED)
        self.entries = rng.permutation(n)[: min(n, 64)]
        close = min(CLOSE_LINKS, n - 1)
        links = [np.argpartition(_squares(centroids[i : i + 512], centroids) + np.where(np.arange(n)[None] == np.arange(i, min(n, i + 512))[:, None], np.inf, 0), max(close - 1, 0), axis=1)[:, :close] for i in range(0, n, 512)]
        self.links = np.concatenate([np.concatenate(links), rng.integers(0, n, (n, RANDOM_LINKS))], axis=1)

    def closest(self, vectors: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, distances) of about the `width` closest centroids of each vector, in order; missing ones have infinite distance."""
        n, q = len(self.centroids), len(vectors)
        if width * 3 >= n:  # no shorter than looking at all of them
            d = _squares(vectors, self.centroids)
            order = np.argsort(d, axis=1, kind="stable")[:, :width]
            return order, np.sqrt(np.take_along_axis(d, order, 1))
        ids = np.broadcast_to(self.entries, (q, len(self.entries)))
        distance = _squares(vectors, self.centroids[self.entries])
        seen = np.zeros((q, n), dtype=bool)
        seen[:, self.entries] = True
        if len(self.entries) < width:
            pad = width - len(self.entries)
            ids = np.concatenate([ids, np.zeros((q, pad), dtype=ids.dtype)], axis=1)
            distance = np.concatenate([distance, np.full((q, pad), np.inf)], axis=1)
        order = np.argsort(distance, axis=1)[:, :width]
        ids, distance = np.take_along_axis(ids, order, 1), np.take_along_axis(distance, order, 1)
        done = np.isinf(distance)
        live = np.arange(q)
        while len(live):
            at = np.argmin(done[live], axis=1)
            open_ = ~done[live, at]
            live, at = live[open_], at[open_]
            if not len(live):
                break
            done[live, at] = True
            near = self.links[ids[live, at]]
            fresh = ~seen[live[:, None], near]
            seen[live[:, None], near] = True
            d = ((self.centroids[near] - vectors[live][:, None, :]) ** 2).sum(axis=2)
            # A centroid may be linked twice: the second one is no news.
            order = np.argsort(near, axis=1, kind="stable")
            ordered = np.take_along_axis(near, order, 1)
            twice = np.zeros_like(fresh)
            np.put_along_axis(twice, order[:, 1:], ordered[:, 1:] == ordered[:, :-1], 1)
            d = np.where(fresh & ~twice, d, np.inf)
            all_ids = np.concatenate([ids[live], near], axis=1)
            all_d = np.concatenate([distance[live], d], axis=1)
            all_done = np.concatenate([done[live], np.isinf(d)], axis=1)
            order = np.argsort(all_d, axis=1, kind="stable")[:, :width]
            ids[live], distance[live] = np.take_along_axis(all_ids, order, 1), np.take_along_axis(all_d, order, 1)
            done[live] = np.take_along_axis(all_done, order, 1)
        return ids, np.sqrt(distance)

    def lists(self, vectors: np.ndarray, most: int, ratio: float, least: int = 1) -> list[np.ndarray]:
        """The lists of each vector: its `least` closest centroids and up to `most` within the ratio of distances."""
        ids, distance = self.closest(vectors, min(most, len(self.centroids)))
        near = ((distance <= distance[:, :1] * ratio + 1e-12) | (np.arange(ids.shape[1]) < least)) & np.isfinite(distance)
        return [i[ok] for i, ok in zip(ids, near, strict=True)]


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0)


def balanced_centroids(sample: np.ndarray, lists: int) -> np.ndarray:
    """Means of balanced clusters: halves along the line between two far points, halved again until there are enough."""
    sample = np.unique(sample, axis=0)  # copies of one vector are one point
    rng = np.random.default_rng(SEED)
    leaf = max(1, -(-len(sample) // lists))
    todo, found = [np.arange(len(sample))], []
    while todo:
        own = todo.pop()
        if len(own) <= leaf:
            found.append(sample[own].mean(axis=0))
            continue
        x = sample[own]
        a = x[rng.integers(len(x))]
        b = x[((x - a) ** 2).sum(axis=1).argmax()]
        half = np.zeros(len(x), dtype=bool)
        for _ in range(4):
            half = np.argsort(np.argsort(x @ (b - a), kind="stable"), kind="stable") < len(x) // 2
            a, b = x[half].mean(axis=0), x[~half].mean(axis=0)
        todo += [own[half], own[~half]]
    return np.array(found)


def usable(embeddings: DataFrame, column: str = "embedding") -> DataFrame:
    """row (unique), vec_id, vec (doubles) of the vectors that take part.

    Vectors that are null, empty or zero, or hold null or non-finite components, and rows without vec_id, take no part; of vectors
    of several lengths only those of the most frequent length do.
    """
    vec = F.col(column).cast("array<double>")
    plain = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), vec.alias("vec")).filter(
        "vec_id is not null and size(vec) > 0 and not exists(vec, x -> x is null or isnan(x) or abs(x) = double('Infinity')) and exists(vec, x -> x <> 0)"
    )
    stored = materialise(plain.select(F.monotonically_increasing_id().alias("row"), "vec_id", "vec"), "ann-vectors")
    usual = stored.groupBy(F.size("vec").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return stored if usual is None else stored.filter(F.size("vec") == usual["d"])


def fit(vectors: DataFrame) -> CentroidGraph | None:
    """The centroids of a sample of at most SAMPLE_ROWS vectors and SAMPLE_VALUES values; None without vectors."""
    stats = vectors.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("d")).first()
    n, d = stats["n"], stats["d"]
    if not n:
        return None
    most = max(2, min(SAMPLE_ROWS, SAMPLE_VALUES // d))
    lists = max(1, min(round(n / LIST_ROWS), MAX_LISTS, most // 8))
    draw = F.pmod(F.xxhash64(F.lit(SEED), "vec_id", "row"), F.lit(1 << 40)) / float(1 << 40)
    sample = vectors.select("vec", draw.alias("draw")).filter(F.col("draw") < min(1.0, 1.2 * most / n)).orderBy("draw").limit(most)
    return CentroidGraph(balanced_centroids(np.array([r["vec"] for r in sample.collect()], dtype=np.float64), lists))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def assigned(vectors: DataFrame, graph, most: int, ratio: float, least: int = 1) -> DataFrame:
    """The rows of vectors, once for each of their lists: list, row, vec_id, vec."""
    schema = T.StructType([T.StructField("list", T.IntegerType()), *vectors.select("row", "vec_id", "vec").schema.fields])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2_000):
                part = batch.slice(at, 2_000)
                lists = graph.value.lists(_matrix(part.column("vec")), most, ratio, least)
                rows = np.repeat(np.arange(part.num_rows), [len(x) for x in lists])
                out = part.take(pa.array(rows))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(lists), pa.int32()), *out.columns], names=schema.fieldNames())

    return vectors.select("row", "vec_id", "vec").mapInArrow(assign, schema)


def _nearest(k: int):
    def nearest(data: pa.Table) -> pa.Table:
        asks = data.column("asks").to_numpy()
        queries, rows = data.filter(pa.array(asks)), data.filter(pa.array(~asks))
        out: list[tuple[np.ndarray, ...]] = []
        if len(queries) and len(rows):
            p, p_row, p_id = _matrix(rows.column("vec").combine_chunks()), rows.column("row").to_numpy(), rows.column("vec_id").to_numpy()
            for at in range(0, len(queries), 100):
                part = queries.slice(at, 100)
                v, v_row, v_id = _matrix(part.column("vec").combine_chunks()), part.column("row").to_numpy(), part.column("vec_id").to_numpy()
                rough = _squares(v, p)
                rough[v_row[:, None] == p_row[None, :]] = np.inf
                size = (v * v).sum(1) + (p * p).sum(1).max()
                edge = np.partition(rough, min(k, len(p)) - 1, axis=1)[:, min(k, len(p)) - 1] + 1e-9 * size
                for i in range(len(v)):
                    near = np.flatnonzero((rough[i] <= edge[i]) & np.isfinite(rough[i]))
                    exact = np.sqrt(((p[near] - v[i]) ** 2).sum(axis=1))
                    best = np.lexsort((p_row[near], p_id[near], exact))[:k]
                    m = len(best)
                    out.append((np.full(m, v_row[i]), np.full(m, v_id[i]), p_row[near[best]], p_id[near[best]], exact[best]))
        columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.empty(0, np.int64)] * 4 + [np.empty(0)]
        return pa.table({n: pa.array(c, pa.float64() if n == "score" else pa.int64()) for n, c in zip(("q_row", "query_id", "row", "vec_id", "score"), columns, strict=True)})

    return nearest


def _search(asked: DataFrame, postings: DataFrame, k: int) -> DataFrame:
    """The best k rows of each query in each block of its lists."""
    rows = postings.groupBy("list").agg(F.count("*").alias("n_rows"))
    asks = asked.groupBy("list").agg(F.count("*").alias("n_asks"))
    blocks = rows.join(asks, "list").select("list", F.ceil(F.col("n_rows") / BLOCK_ROWS).cast("int").alias("row_blocks"), F.ceil(F.col("n_asks") / BLOCK_QUERIES).cast("int").alias("ask_blocks"))
    blocks = materialise(blocks, "ann-blocks")

    def every(count: str) -> F.Column:
        return F.explode(F.sequence(F.lit(0), F.col(count) - 1))

    p = postings.join(blocks, "list").withColumn("i", F.pmod(F.xxhash64("row"), F.col("row_blocks")).cast("int")).withColumn("j", every("ask_blocks"))
    q = asked.join(blocks, "list").withColumn("j", F.pmod(F.xxhash64("row"), F.col("ask_blocks")).cast("int")).withColumn("i", every("row_blocks"))
    met = p.select("list", "i", "j", "row", "vec_id", "vec", F.lit(False).alias("asks")).unionAll(q.select("list", "i", "j", "row", "vec_id", "vec", F.lit(True).alias("asks")))
    return met.groupBy("list", "i", "j").applyInArrow(_nearest(k), "q_row long, query_id long, row long, vec_id long, score double")


def _scan(asked: DataFrame, vectors: DataFrame, rows: int, k: int) -> DataFrame:
    """The best k rows of each query in each block of all vectors, which are dealt by hash."""
    deals = max(1, -(-rows // BLOCK_ROWS))
    dealt = vectors.select(F.pmod(F.xxhash64("row"), F.lit(deals)).cast("int").alias("list"), "row", "vec_id", "vec")
    everywhere = asked.select(F.explode(F.sequence(F.lit(0), F.lit(deals - 1))).alias("list"), "row", "vec_id", "vec")
    return _search(everywhere, dealt, k)


def lists_to_read(graph: CentroidGraph, pairs: list[tuple[int, np.ndarray, np.ndarray]], rows: int, copies: int, probes: int, ratio: float) -> tuple[int, float] | None:
    """(probes, ratio) at which the lists hold RECALL of the pairs (query's row, its vector, a true neighbour); None if comparing all rows costs no more.

    Probes are doubled from the given ones, each time with the given ratio and without one. `copies` are the rows of all lists.
    """
    lists = len(graph.centroids)
    at = {q: v for q, v, _ in pairs}
    order = {q: i for i, q in enumerate(at)}
    asked = np.array(list(at.values()))
    homes = graph.lists(np.array([n for _, _, n in pairs]), REPLICAS, REPLICA_RATIO)
    while True:
        for bound in (ratio, np.inf):
            read = graph.lists(asked, probes, bound, LEAST_PROBES)
            found = np.mean([np.isin(home, read[order[q]]).any() for (q, _, _), home in zip(pairs, homes, strict=True)])
            if found >= RECALL:
                return (probes, bound) if np.mean([len(x) for x in read]) * (copies / lists + ASK_ROWS) < rows else None
        if probes >= lists:
            return None
        probes *= 2


def nearest_neighbours(embeddings: DataFrame, queries: F.Column, k: int = 10, column: str = "embedding", probes: int = PROBES, probe_ratio: float = PROBE_RATIO) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every row that satisfies `queries` (a condition on vec_id).

    Candidates are all rows but the query's own; the score is the Euclidean distance of the vectors as they are, in doubles; ties go
    to the smaller vec_id. See `usable` for the vectors that take part. A query has fewer than k rows only if there are fewer
    candidates; repeated rows are candidates of each other; an empty table gives an empty result. `probes` and `probe_ratio` are where the
    search for RECALL starts.
    """
    spark = embeddings.sparkSession
    vectors = usable(embeddings, column)
    graph = fit(vectors)
    if graph is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    lists = len(graph.centroids)
    shared = spark.sparkContext.broadcast(graph)  # at most MAX_LISTS centroids and SAMPLE_VALUES / 8 values
    asked = vectors.filter(queries)
    best = Window.partitionBy("q_row").orderBy("score", "vec_id", "row")

    def top(rows: DataFrame) -> DataFrame:
        return rows.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)

    rows = vectors.count()
    wanted = min(k, rows - 1)
    some = max(1, min(RECALL_QUERIES, RECALL_VALUES // (graph.centroids.shape[1] * max(1, k))))
    sample = materialise(asked.orderBy(F.xxhash64(F.lit(SEED), "vec_id", "row")).limit(some), "ann-sample")
    true = top(_scan(sample, vectors, rows, k))
    true = true.select("q_row", F.col("row").alias("n_row")).join(vectors.select(F.col("row").alias("n_row"), F.col("vec").alias("n_vec")), "n_row")
    true = true.join(sample.select(F.col("row").alias("q_row"), "vec"), "q_row").select("q_row", "vec", "n_vec")
    pairs = [(r["q_row"], np.array(r["vec"]), np.array(r["n_vec"])) for r in true.collect()]
    if not pairs:  # no queries, or no candidates
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    postings = materialise(assigned(vectors, shared, REPLICAS, REPLICA_RATIO), "ann-lists")
    reads = lists_to_read(graph, pairs, rows, postings.count(), probes, probe_ratio)
    if reads is None:
        return materialise(top(_scan(asked, vectors, rows, k)), "ann-found").select("query_id", "rank", "vec_id", "score")
    found = _search(materialise(assigned(asked, shared, *reads, LEAST_PROBES), "ann-queries"), postings, k).distinct()
    found = materialise(top(found), "ann-found")
    enough = found.groupBy("q_row").agg(F.count("*").alias("n")).filter(F.col("n") >= wanted)
    short = asked.join(enough, asked["row"] == enough["q_row"], "left_anti")
    if wanted > 0 and not short.isEmpty():
        everywhere = short.select(F.explode(F.sequence(F.lit(0), F.lit(lists - 1))).alias("list"), "row", "vec_id", "vec")
        again = top(_search(materialise(everywhere, "ann-queries"), postings, k).distinct())
        found = found.join(enough, "q_row", "left_semi").unionByName(again)
    return found.select("query_id", "rank", "vec_id", "score")


def op5_nearest(spark, sf_dir):
    return nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, k=10)


QUERIES = {"op5_nearest": op5_nearest}
#: Approximate: tests measure recall against brute force.
ORACLE = {}
