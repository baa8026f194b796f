from collections import defaultdict

from tests.llm.helpers import documents, empty, odd_rows
from txnrisk.llm import mixing

WEIGHTS = (5, 2, 1)


def brute(sizes):
    """Targets by repeated resharing, and the queue by a plain sort; sizes: doc, source, size, key."""
    sources = sorted({s for _, s, _, _ in sizes}, key=lambda s: (s is None, s or ""))
    weight = {s: WEIGHTS[i % 3] for i, s in enumerate(sources)}
    own = {s: sum(n for _, t, n, _ in sizes if t == s) for s in sources}
    total, open_, target = sum(own.values()), set(sources), {}
    while True:
        left = total - sum(target.values())
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = [s for s in open_ if share[s] >= 3 * own[s]]
        if not full:
            break
        for s in full:
            target[s] = 3 * own[s]
            open_.remove(s)
    target |= share
    copies, done = [], defaultdict(int)
    for doc, s, n, key in sorted(sizes, key=lambda x: (x[3], x[0] or 0)):
        done[s] += n
        copies += [((e * own[s] + done[s]) / weight[s], s is None, s or "", key, doc, n) for e in range(3) if n]
    taken, spent = defaultdict(int), 0
    for _, _, _, _, doc, n in sorted(copies, key=lambda c: (*c[:4], c[4] or 0)):
        spent += n
        if spent > total:
            break
        taken[doc] += n
    return own, target, taken


def test_equals_plain_queue(spark):
    rows = [r for i, r in enumerate(odd_rows()) if i != 6]  # one row an id, so that a plain sum by id is right
    docs = documents(spark, rows)
    sizes = [(r.doc_id, r.source, r.size, r.key) for r in mixing.document_sizes(docs).collect()]
    own, target, taken = brute(sizes)
    found = mixing.mix(docs).collect()
    assert len(found) == len(rows)
    for r in found:
        assert (r.source_size, r.taken) == (own[r.source], taken[r.doc_id])
        assert abs(r.target - target[r.source]) < 1e-6 and r.taken <= 3 * r.size


def test_buckets_do_not_change_the_mix(spark, monkeypatch):
    docs = documents(spark)
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.source or "")
    whole = sorted(mixing.mix(docs).collect(), key=key)
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 3)
    assert sorted(mixing.mix(docs).collect(), key=key) == whole


def test_sizes_and_repeated_rows(spark):
    found = mixing.mix(documents(spark)).collect()
    size = {r.doc_id: r.size for r in found}
    assert [size[i] for i in (1, 2, 3, 4, 5)] == [0, 0, 0, 1, 20_000]
    assert sum(r.doc_id == 6 for r in found) == 2


def test_mixed_documents_keep_all_columns(spark):
    docs = documents(spark)
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    times = defaultdict(int)
    for r in out.collect():
        times[r.doc_id] += 1
    repeats = defaultdict(int)
    for r in mixing.mix(docs).collect():
        repeats[r.doc_id] = max(repeats[r.doc_id], r.repeats) if r.size else 1
    assert times[1] == 1 and times[4] == repeats[4] and times[101] == repeats[101]


def test_empty(spark):
    assert mixing.mix(empty(spark)).count() == 0
    assert mixing.mixed_documents(empty(spark)).count() == 0
