import hashlib
import re

import pytest

from tests.llm.helpers import documents, empty, odd_rows, prose
from txnrisk.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(rows, items, n=10):
    out = []
    for r in rows:
        own, hit, found = words(r[1]), set(), set()
        for item, text in items:
            item_words = words(text)
            size = min(n, len(item_words))
            windows = {tuple(item_words[i : i + size]) for i in range(len(item_words) - size + 1)} if size else set()
            for i in range(len(own) - size + 1 if size else 0):
                if tuple(own[i : i + size]) in windows:
                    hit |= set(range(i, i + size))
                    found.add(item)
        out.append((r[0], len(own), len(hit), sorted(str(x) for x in found if x is not None)))
    return out


@pytest.fixture(scope="module")
def cases():
    item, other = prose(50, 25), prose(51, 30)
    items = [(1, item), (10, item), (2, other), (3, "Short Item here"), (4, None), (5, " .. "), (None, prose(52, 12)), (2, other)]
    cut = other.split()
    rows = odd_rows() + [
        (200, f"{prose(60, 20)} {item.upper()}! {prose(61, 5)}", "en", "a", 0),
        (201, f"?? {' - '.join(cut[3:15])} {prose(62, 8)} {' '.join(cut[:10])}", "en", "a", 0),
        (202, "nine words " + " ".join(cut[:9]), "en", "a", 0),
        (203, "a short, ITEM; here and short item here", "en", "a", 0),
        (204, prose(52, 12), "en", "a", 0),
        (205, f"{item} {item} {other}", "en", "a", 0),
        (205, "another text of this id", "en", "a", 0),
    ]
    return rows, items


@pytest.mark.parametrize("block", [500_000, 7])
def test_equals_plain_search(spark, cases, block):
    rows, items = cases
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = D.contamination(documents(spark, rows), benchmark, block=block).collect()
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r.item_ids) for r in found), key=str)
    assert got == sorted(brute(rows, items), key=str)


def test_decontaminated(spark, cases):
    rows, items = cases
    benchmark, docs = spark.createDataFrame(items, "item_id long, text string"), documents(spark, rows)
    left = D.decontaminated(docs, benchmark)
    assert left.columns == docs.columns
    hits = brute(rows, items)
    assert sorted((r.doc_id for r in left.collect()), key=str) == sorted((h[0] for h in hits if not h[2]), key=str)
    spans = D.decontaminated(docs, benchmark, drop="spans")
    assert spans.columns == docs.columns
    by_text = {r.doc_id: r.text for r in spans.collect()}
    assert by_text[203] == "a and " and by_text[1] is None and by_text[4] == "Word"
    assert all(h[2] == 0 for h in brute([(i, t) for i, t in by_text.items()], items) if h[0] in (200, 203, 204, 205))


def test_query_digests(spark, cases, monkeypatch):
    rows, items = cases
    tables = {"documents": documents(spark, rows), "benchmark": spark.createDataFrame(items, "item_id long, text string")}
    monkeypatch.setattr(D, "table", lambda spark, sf_dir, name: tables[name])
    want = {(h[0], hashlib.sha256(",".join(h[3]).encode()).hexdigest(), len(h[3]), h[2] > 0) for h in brute(rows, items)}
    assert {(r.doc_id, r.items_sha256, r.n_items, r.contaminated) for r in D.op7_decontaminate(spark, "").collect()} == want


def test_empty(spark, cases):
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.contamination(empty(spark), none).count() == 0
    found = D.contamination(documents(spark), none).collect()
    assert len(found) == len(odd_rows()) and not any(r.n_hit for r in found)
    assert D.contamination(empty(spark), spark.createDataFrame(cases[1], "item_id long, text string")).count() == 0
