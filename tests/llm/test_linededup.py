import hashlib

import pytest

from tests.llm.helpers import documents, empty, odd_rows, prose
from txnrisk.llm import linededup as L

PASSAGE = [prose(i, 12) for i in range(400, 424)]


def chunks(text, divisor):
    lines = text.split("\n")
    h = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in lines]
    out, first = [], 0
    for i in range(len(lines)):
        if i == len(lines) - 1 or ((h[i - 1] if i else 0) * 31 + h[i]) % divisor == 0:
            out.append((first, i + 1))
            first = i + 1
    return lines, out


def brute(rows, divisor):
    seen, out = set(), []
    rows = sorted(set((r[0], r[1]) for r in rows), key=lambda r: (r[0] is None, r[0] or 0, hashlib.md5((r[1] or "").encode()).digest()))
    for doc, text in rows:
        if text is None:
            out.append((doc, 0, 0, None))
            continue
        lines, cut = chunks(text, divisor)
        gone = set()
        for a, b in cut:
            body = "\n".join(lines[a:b])
            if b - a < 2 or not body.strip(" \t\n\x0b\x0c\r"):
                continue
            if body in seen:
                gone |= set(range(a, b))
            seen.add(body)
        out.append((doc, len(lines), len(gone), "\n".join(x for i, x in enumerate(lines) if i not in gone)))
    return out


ROWS = odd_rows() + [
    (500, "\n".join(PASSAGE), "en", "a", 0),
    (501, "\n".join([prose(600, 9), *PASSAGE, prose(601, 4)]), "en", "a", 0),
    (502, "\n".join([*PASSAGE[5:], prose(602, 4), *PASSAGE]), "en", "a", 0),
    (503, "\n".join([*PASSAGE, *PASSAGE]), "en", "a", 0),
    (504, "\n\n\n\n\n\n", "en", "a", 0),
    (505, "\n\n\n\n\n\n", "en", "a", 0),
    (505, "\n".join(PASSAGE), "en", "a", 0),
    (None, "\n".join(PASSAGE), "en", "a", 0),
]


@pytest.mark.parametrize("divisor", [1, 4])
def test_equals_plain_removal(spark, divisor):
    found = L.without_repeats(documents(spark, ROWS), divisor=divisor).collect()
    assert len(found) == len(ROWS)
    got = {(r.doc_id, r.n_lines, r.removed, r.text) for r in found}
    assert got == set(brute(ROWS, divisor))


def test_cuts_move_with_the_text(spark):
    found = {r.doc_id: r.removed for r in L.without_repeats(documents(spark, ROWS)).collect() if r.doc_id in (501, 502, 503)}
    assert all(n >= len(PASSAGE) // 2 for n in found.values())


def test_empty(spark):
    assert L.without_repeats(empty(spark)).count() == 0
