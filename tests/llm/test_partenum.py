import numpy as np
import pytest

from tests.llm.helpers import documents, empty, odd_rows, prose
from tests.llm.test_nearduplicates import brute, family
from txnrisk.llm import partenum as P


def pair_at_threshold(rng, size, percent):
    """Two sets, the second at most 100 / percent times as large, that just reach the similarity; None if only equal sets do."""
    other = int(rng.integers(size, max(size, size * 100 // percent) + 1))
    common = -(-percent * (size + other) // (100 + percent))
    if common > size or common == size == other:
        return None
    a = rng.integers(0, 2**63, size, dtype=np.uint64)
    return np.sort(a), np.sort(np.concatenate([a[:common], rng.integers(0, 2**63, other - common, dtype=np.uint64)]))


@pytest.mark.parametrize("percent", [60, 80, 85, 99])
@pytest.mark.parametrize("miss", [0, 1e-12])
def test_pairs_at_the_threshold_share_a_signature(percent, miss):
    rng, tried = np.random.default_rng(percent), 0
    for size in [*range(2, 60), 80, 100, 150, 250, 400, 1_000, 3_000]:
        for _ in range(10):
            pair = pair_at_threshold(rng, size, percent)
            if pair:
                marks, whose = P.signatures(np.concatenate(pair), np.array([len(x) for x in pair]), percent, miss)
                assert set(marks[whose == 0].tolist()) & set(marks[whose == 1].tolist()), (size, len(pair[1]))
                tried += 1
    assert tried > 15


def test_unlike_sets_seldom_share_a_signature():
    rng = np.random.default_rng(5)
    counts = rng.integers(20, 400, 2_000)
    marks, whose = P.signatures(rng.integers(0, 2**63, counts.sum(), dtype=np.uint64), counts, 80)
    order = np.lexsort((whose, marks))
    again = (marks[order][1:] == marks[order][:-1]) & (whose[order][1:] != whose[order][:-1])
    assert again.sum() < 200 and len(marks) < 1.1 * counts.sum()


def test_packing_is_undone():
    values = np.random.default_rng(1).integers(0, 2**40, 1_000, dtype=np.uint64)
    assert (P._unpack(P._pack(values, 5), 5) == values).all()


@pytest.mark.parametrize(("k", "percent", "block", "common", "pack"), [(5, 80, 200, 64, 2_000_000), (3, 85, 4, 3, 500), (5, 60, 6, 2, 100)])
def test_equals_all_pairs(spark, monkeypatch, k, percent, block, common, pack):
    monkeypatch.setattr(P, "COMMON", common)
    monkeypatch.setattr(P, "PACK", pack)
    monkeypatch.setattr(P.G, "SETS", block)
    passage = prose(90, 40)
    rows = odd_rows() + family(1, 40, 100, 7, 1000) + family(2, 30, 150, 12, 2000) + [(3000 + i, prose(5, 50), "en", "a", 0) for i in range(8)]
    rows += [(4000 + i, f"{passage} {prose(200 + i, 10)}", "en", "a", 0) for i in range(30)] + [(None, prose(i % 3, 9 + i // 3), "en", "a", 0) for i in range(30)]
    found = P.jaccard_join(documents(spark, rows).repartition(5), k=k, percent=percent, block=block).collect()
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=str)
    assert got == sorted(brute(rows, k, percent), key=str)


def test_a_common_passage_brings_unlike_texts_together_in_no_second_pass(spark, monkeypatch):
    """Sets to compare again do not grow with the square of those that hold one passage; near copies among them are still found."""
    rows = [(i, f"{prose(90, 60)} {prose(200 + i, 25)}", "en", "a", 0) for i in range(60)] + family(3, 12, 85, 3, 1000)
    rows += [(2000 + i, f"{prose(90, 60)} {prose(300, 25 - i)}", "en", "a", 0) for i in range(3)]
    copied, plain = [], P.G.block_links
    monkeypatch.setattr(P.G, "block_links", lambda groups, *more: copied.append(groups.count()) or plain(groups, *more))
    monkeypatch.setattr(P.G, "SETS", 6)
    found = P.jaccard_join(documents(spark, rows).repartition(5), k=5, percent=80, block=6).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found) == sorted(brute(rows, 5, 80))
    assert len(copied) == 2 and copied[1] <= len(rows)


def test_empty(spark):
    assert P.jaccard_join(empty(spark)).count() == 0
