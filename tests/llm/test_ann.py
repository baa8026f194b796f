import numpy as np
import pytest
from pyspark.sql import functions as F

from txnrisk.llm import ann as A

SCHEMA = "vec_id long, embedding array<float>, label int, row string, vec string, list string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], 0, "x", "x", "x") for i, v in rows], SCHEMA)


def brute(rows, k, every):
    used = [(i, np.array(v, np.float32).astype(float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    out = []
    for q, (i, v) in enumerate(used):
        if i % every == 0:
            near = sorted((float(np.sqrt(((w - v) ** 2).sum())), j) for p, (j, w) in enumerate(used) if p != q)[:k]
            out += [(i, rank + 1, j, d) for rank, (d, j) in enumerate(near)]
    return sorted(out)


def same(found, want):
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in found)
    return len(got) == len(want) and all(a[:3] == b[:3] and abs(a[3] - b[3]) < 1e-12 for a, b in zip(got, want, strict=True))


def test_small_table_with_odd_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=5).tolist()) for i in range(60)]
    rows += [(100 + i, rows[7][1]) for i in range(30)] + [(200, [0.0] * 5), (210, None), (220, [1, None, 0, 0, 0]), (230, [1, float("nan"), 0, 0, 0]), (240, [float("inf")] * 5), (250, []), (None, [1.0] * 5), (10, rows[10][1])]
    assert same(A.nearest_neighbours(vectors(spark, rows), F.col("vec_id") % 10 == 0).collect(), brute(rows, 10, 10))


def test_fewer_candidates_than_asked(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])]
    assert same(A.nearest_neighbours(vectors(spark, rows), F.col("vec_id") == 0).collect(), brute(rows, 10, 1)[:2])
    assert A.nearest_neighbours(vectors(spark, rows[:1]), F.col("vec_id") == 0).count() == 0
    assert A.nearest_neighbours(vectors(spark, []), F.col("vec_id") == 0).count() == 0


def test_recall_and_exact_scores(spark, monkeypatch):
    monkeypatch.setattr(A, "LIST_ROWS", 16)
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 12)) * 3
    rows = [(i, (centres[i % 40] + rng.normal(size=12)).tolist()) for i in range(3_000)]
    found = A.nearest_neighbours(vectors(spark, rows), F.col("vec_id") % 100 == 0, probes=24).collect()
    want = {(q, j): d for q, _, j, d in brute(rows, 10, 100)}
    got = {(r.query_id, r.vec_id): r.score for r in found}
    assert len(got) == len(want) == 300
    hits = got.keys() & want.keys()
    assert len(hits) >= 0.9 * len(want) and all(abs(got[x] - want[x]) < 1e-12 for x in hits)


def test_blocks_do_not_change_results(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(200)] + [(300 + i, [1.0, 2.0, 3.0, 4.0]) for i in range(150)]
    monkeypatch.setattr(A, "BLOCK_ROWS", 20)
    monkeypatch.setattr(A, "BLOCK_QUERIES", 3)
    assert same(A.nearest_neighbours(vectors(spark, rows), F.col("vec_id") % 20 == 0, probes=1_000, probe_ratio=1e9).collect(), brute(rows, 10, 20))


def test_short_answers_search_all_lists(spark, monkeypatch):
    monkeypatch.setattr(A, "LIST_ROWS", 2)
    monkeypatch.setattr(A, "REPLICAS", 1)
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=3).tolist()) for i in range(64)]
    assert same(A.nearest_neighbours(vectors(spark, rows), F.col("vec_id") % 8 == 0, probes=1).collect(), brute(rows, 10, 8))


def test_graph_search_and_balance():
    rng = np.random.default_rng(5)
    data = rng.normal(size=(20_000, 8))
    centroids = A.balanced_centroids(data, 500)
    graph = A.CentroidGraph(centroids)
    ids, distance = graph.closest(data[:300], 8)
    exact = np.argsort(A._squares(data[:300], centroids), axis=1)[:, :8]
    assert np.mean([len(set(a) & set(b)) / 8 for a, b in zip(ids, exact, strict=True)]) > 0.95
    assert (np.diff(distance, axis=1) >= 0).all() and all(len(set(i)) == 8 for i in ids)
    sizes = np.bincount(A._squares(data, centroids).argmin(axis=1), minlength=len(centroids))
    assert len(centroids) >= 400 and sizes.max() < 12 * sizes.mean()


def recall(found, rows, every):
    want = {(q, j) for q, _, j, _ in brute(rows, 10, every)}
    return len({(r.query_id, r.vec_id) for r in found} & want) / len(want)


def test_recall_without_clusters_does_not_fall_with_the_number_of_lists(spark, monkeypatch):
    monkeypatch.setattr(A, "LIST_ROWS", 8)
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=32).tolist()) for i in range(2_000)]
    found = A.nearest_neighbours(vectors(spark, rows), F.col("vec_id") % 50 == 0, probes=8).collect()
    assert recall(found, rows, 50) >= 0.99


@pytest.mark.parametrize("ask_rows", [0, 10**6])
def test_lists_are_added_until_the_recall_is_reached(spark, monkeypatch, ask_rows):
    monkeypatch.setattr(A, "LIST_ROWS", 8)
    monkeypatch.setattr(A, "LEAST_PROBES", 1)
    monkeypatch.setattr(A, "ASK_ROWS", ask_rows)
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(50, 6)) * 3
    rows = [(i, (centres[i % 50] + rng.normal(size=6)).tolist()) for i in range(2_500)]
    found = A.nearest_neighbours(vectors(spark, rows), F.col("vec_id") % 50 == 0, probes=1).collect()
    assert len(found) == 500 and recall(found, rows, 50) >= 0.99
