import random

import numpy as np
import pyarrow as pa
import pytest

from tests.llm.helpers import WORDS, documents, empty, odd_rows, prose
from txnrisk.llm import nearduplicates as N
from txnrisk.llm import shingles as S


def shingle_set(text, k):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ")
    words = [w for w in words if w]
    if len(words) < k:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def brute(rows, k, percent):
    """Smallest id of the component of each row."""
    sets = [shingle_set(r[1], k) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    groups = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            groups[find(i)] = min(r[0], groups.get(find(i), r[0]))
    return [(r[0], len(sets[i]), groups.get(find(i))) for i, r in enumerate(rows)]


def family(seed, n, words, edits, first):
    """A text and copies of it with a few words changed: chains, stars and far members."""
    rng = random.Random(seed)
    base, out = prose(seed, words).split(), []
    for i in range(n):
        own = list(base)
        for _ in range(rng.randint(0, edits)):
            own[rng.randrange(words)] = rng.choice(WORDS) + str(rng.randrange(50))
        out.append((first + i, " ".join(own), "en", "a", 0))
    return out


@pytest.mark.parametrize(("k", "percent", "block"), [(3, 85, 200), (3, 85, 6), (5, 80, 4)])
def test_equals_all_pairs(spark, k, percent, block):
    rows = odd_rows() + family(1, 40, 100, 7, 1000) + family(2, 30, 150, 12, 2000) + [(3000 + i, prose(5, 50), "en", "a", 0) for i in range(8)]
    found = N.near_duplicates(documents(spark, rows), k=k, percent=percent, block=block).collect()
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in found), key=str)
    assert got == sorted(brute(rows, k, percent), key=str)
    assert all(r.kept == (r.doc_id == r.component_id) for r in found)


def test_deduplicated_keeps_one_of_each_group(spark):
    rows = odd_rows() + family(3, 10, 100, 2, 4000)
    docs = documents(spark, rows)
    out = N.deduplicated(docs)
    assert out.columns == docs.columns
    ids = sorted((r.doc_id for r in out.collect()), key=str)
    want = {c for _, n, c in brute(rows, 5, 80) if n} | {r[0] for r in rows if not shingle_set(r[1], 5)}
    assert ids == sorted(want, key=str)


def test_empty(spark):
    assert N.near_duplicates(empty(spark)).count() == 0
    assert N.deduplicated(empty(spark)).count() == 0


def test_words_and_shingles():
    texts = ["A  b\tc", None, "", " ", "é É", "x", "a b c a b c"]
    sets, counts = S.shingle_sets(pa.array(texts), 3)
    assert counts.tolist() == [len(shingle_set(t, 3)) for t in texts]
    again, _ = S.shingle_sets(pa.array(["zz", *texts])[1:], 3)
    assert (again == sets).all()


def test_super_minhash_takes_every_slot_once_for_one_element():
    one = S.super_minhash(np.array([12345], np.uint64), np.array([1]), 50)[0]
    assert sorted(v >> np.uint64(32) for v in one) == list(range(50))


def test_super_minhash_equals_the_plain_algorithm():
    rng = np.random.default_rng(1)
    elements, m = rng.integers(0, 2**63, 9, dtype=np.uint64), 16
    slots = [float("inf")] * m
    for e in elements:
        order = list(range(m))
        for step in range(m):
            draw = int(S.mix64(np.array([(int(e) + (step + 1) * int(S._BASE)) % 2**64], np.uint64))[0])
            place = step + ((draw & 0xFFFFFFFF) * (m - step) >> 32)
            order[step], order[place] = order[place], order[step]
            slots[order[step]] = min(slots[order[step]], (step << 32) | draw >> 32)
    assert S.super_minhash(elements, np.array([9]), m)[0].tolist() == slots


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(2)
    shared, a, b = (rng.integers(0, 2**63, n, dtype=np.uint64) for n in (600, 200, 200))
    both = np.concatenate([np.sort(np.concatenate([shared, x])) for x in (a, b)])
    one, two = S.super_minhash(both, np.array([800, 800]), 512)
    assert abs((one == two).mean() - 0.6) < 0.08


def test_linked_pairs_is_exact_at_the_threshold():
    a = np.arange(100, dtype=np.uint64)
    near, far = S.linked_pairs(np.concatenate([a, a[:85]]), np.array([100, 85]), 85)[0, 1], S.linked_pairs(np.concatenate([a, a[:84]]), np.array([100, 84]), 85)[0, 1]
    assert near and not far
