"""The pipeline on a small table against its stages by plain means, and every SQL equivalent."""

import pytest

import corpus_pipeline as P
from tests.conftest import SMALL
from tests.harness import compare, duck
from tests.llm.helpers import documents, empty, odd_rows, prose
from tests.llm.test_decontaminate import brute as hits_of
from tests.llm.test_nearduplicates import brute as groups_of
from txnrisk import llm


def test_stages_over_odd_rows(spark, monkeypatch):
    item = prose(70, 30)
    rows = odd_rows() + [(700, prose(71, 80), "en", "a", 0), (701, prose(71, 80) + " end", "en", "b", 0), (702, f"{item} {prose(72, 20)}", "en", "c", 0)]
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    monkeypatch.setattr(P, "table", lambda spark, sf_dir, name: benchmark)
    docs, seen = documents(spark, rows), {}
    for name, stage in P.STAGES:
        out = stage(spark, docs, "").persist()
        assert name == P.STAGES[-1][0] or out.columns == docs.columns
        seen[name], docs = out.collect(), out
    ids = {name: sorted((r.doc_id for r in found), key=str) for name, found in seen.items()}
    with_letters = [r for r in rows if any(c.isalpha() for c in r[1] or "")]
    assert ids["language"] == sorted((r[0] for r in with_letters), key=str)
    stay = {c for _, _, c in groups_of(with_letters, 5, 80)}
    assert ids["near_duplicates"] == sorted(stay, key=str)
    clean = {h[0] for h in hits_of([r for r in with_letters if r[0] in stay], [(1, item)]) if not h[2]}
    assert ids["decontamination"] == sorted(clean, key=str) and 702 not in clean and 701 not in clean and 700 in clean
    assert set(ids["mixture"]) <= clean and ids["tokens"] == ids["mixture"]
    assert min(r.start for r in seen["tokens"]) == 0 and all(r.n_tokens > 1 for r in seen["tokens"])


def test_empty(spark, monkeypatch):
    benchmark = spark.createDataFrame([], "item_id long, text string")
    monkeypatch.setattr(P, "table", lambda *_: benchmark)
    docs = empty(spark)
    for _, stage in P.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0


def test_run(spark):
    found = P.run(spark, SMALL).collect()
    starts = sorted((r.start, r.n_tokens) for r in found)
    assert all(a + n == b for (a, n), (b, _) in zip(starts[:-1], starts[1:], strict=True))


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_query_equals_sql(spark, name):
    ok, message = compare(spark, duck(SMALL), SMALL, llm.queries()[name], llm.oracle_sql()[name])
    assert ok, message
