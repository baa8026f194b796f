import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import documents, empty, odd_rows
from txnrisk.llm import fillmiddle as M


def plain_cut(doc_id, text, seed=1):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or "<P>" in text or "<S>" in text or "<M>" in text or h[2] % 100 >= 90:
        return len(units), "plain", None, None, text
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 20:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


ODD = ["<P>", "a<S>b", "x <M", "<", "<<<P", "P> <S", "\n", "a\r\n b", "😀é a1b2", "A" * 5000, "<P<S<M" * 9, "... "]


def test_equals_plain_cut_and_restores(spark):
    rows = odd_rows() + [(1000 + i, ODD[i % len(ODD)], "en", "a", 0) for i in range(20 * len(ODD))]
    cut = M.fill_in_middle(documents(spark, rows))
    got = cut.withColumn("back", M.restored(F.col("output"), F.col("form"))).collect()
    assert len(got) == len(rows)
    want = [(i, t or "", *plain_cut(i, t)) for i, t, *_ in rows]
    found = [(r.doc_id, r.back, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got]
    assert sorted(found, key=str) == sorted(want, key=str)
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_empty(spark):
    assert M.fill_in_middle(empty(spark)).collect() == []


@pytest.mark.parametrize(("changed", "spm", "forms"), [(0, 0, {"plain"}), (100, 0, {"psm"}), (100, 100, {"spm"})])
def test_shares_are_parameters(spark, changed, spm, forms):
    rows = [(i, "one two three", "en", "a", 0) for i in range(30)]
    cut = M.fill_in_middle(documents(spark, rows), seed=7, changed=changed, spm=spm)
    assert {r.form for r in cut.collect()} == forms


def test_cut_offsets_of_a_long_text():
    text = "word, " * 200_000
    n, form, prefix, middle, output = M.Cutter(M.UNIT, M.SENTINELS, 1, 100, 0).cut(5, text)
    assert n == 600_000 and form == "psm"
    assert output[3 : 3 + prefix] == text[:prefix] and output.endswith("<M>" + text[prefix : prefix + middle])
    assert len(output) == len(text) + 9
