import hashlib
import re

from tests.llm.helpers import documents, empty, odd_rows, prose
from txnrisk.llm import pii

# The patterns as the contract states them.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    values = [int(d) * (1 + i % 2) for i, d in enumerate(reversed(digits))]
    return sum(v - 9 if v > 9 else v for v in values) % 10 == 0


def brute(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            ok = {"ip": lambda m=m: all(int(p) <= 255 for p in m.group().split(".")), "card": lambda d=digits: 16 <= len(d) <= 19 and luhn(d), "phone": lambda d=digits: 8 <= len(d) <= 15}
            if ok.get(kind, lambda: True)():
                out.append((kind, m.start(), m.end()))
    return out


CASES = [
    "a@b.c@d.e x@y.z_a@b.co, a@b a@b. @c.d .@x.y-z.",
    "1.2.3.4.5.6.7.8 999.1.1.1 0001.02.3.255 1.2.3.256 é😀1.1.1.1",
    "4111 1111 1111 1111 4111-1111-1111-1112 4111  1111 1111 1111 5500005555555559123",
    "+1 (23) 45-67 89. +1234567 +12345678901234567 ++4 555 666 77 8",
    "+1 743 555-3824 172.242.194.228 4381893557741609 19@mail5.example.com",
]
ROWS = odd_rows() + [(300 + i, t, "en", "a", 0) for i, t in enumerate(CASES)] + [(300, CASES[1], "en", "a", 0)]


def test_base_spans_equal_plain_search(spark):
    found = pii.personal_data(documents(spark, ROWS)).collect()
    got = sorted(((r.doc_id, [(s.kind, s.start, s.end) for s in r.base]) for r in found), key=str)
    assert got == sorted(((r[0], brute(r[1])) for r in ROWS), key=str)
    assert all({s.start for s in r.base} <= {s.start for s in r.spans} for r in found)


def test_long_runs_take_linear_time(spark):
    text = "1" * 200_000 + " " + "a" * 200_000 + " " + "1 " * 50_000 + "+" + "1" * 100_000 + " x@y.zz"
    (row,) = pii.personal_data(documents(spark, [(1, text, None, None, None)])).collect()
    assert [(s.kind, s.end) for s in row.base] == [("email", len(text))]


def test_contexts_discover_identifiers(spark):
    def sentence(i, value):
        return f"{prose(i, 8)} my customer number: {value} thanks {prose(900 + i, 6)}"

    known = [(i, sentence(i, f"user{i}@mail.example.com"), "en", "a", 0) for i in range(12)]
    hidden = [(50, sentence(50, "user50(at)x"), "en", "a", 0), (51, sentence(51, "KD-93-4411"), "en", "a", 0), (52, f"{prose(52, 9)} KD-93-4411 {prose(53, 9)} chapter 12345", "en", "a", 0)]
    found = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans] for r in pii.personal_data(documents(spark, known + hidden), confidence=0.8).collect()}
    text = hidden[1][1]
    assert found[51] == [("identifier", text.index("KD-"), text.index("KD-") + len("KD-93-4411"))]
    assert found[52] == []  # the same token without a confident context, and a number in none
    assert len(found[3]) == 1


def test_secrets_are_found_by_form_and_context(spark):
    def secret(i):
        return hashlib.sha1(str(i).encode()).hexdigest() if i % 2 else hashlib.sha1(str(i).encode()).hexdigest().upper()

    rows = [(i, f'{prose(i, 8)} token = "{secret(i)}" {prose(900 + i, 6)}', "en", "a", 0) for i in range(12)]
    rows += [(50, f'{prose(50, 8)} token = "short1" {prose(51, 3)}', "en", "a", 0)]  # another form in the same context
    rows += [(60 + i, f"{prose(60 + i, 9)} {secret(60)} {prose(80 + i, 9)}", "en", "a", 0) for i in range(3)]  # the form without a context
    found = {r.doc_id: [(s.kind, s.start, s.end) for s in r.spans if s.kind in pii.ADDED] for r in pii.personal_data(documents(spark, rows)).collect()}
    for i, text, *_ in rows[:12]:
        start = text.index(secret(i))
        assert found[i] == [("secret", start, start + 40)]
    start = rows[12][1].index("short1")
    assert found[50] == [("identifier", start, start + 6)] and not any(found[60 + i] for i in range(3))


def test_rounds_go_on_until_nothing_is_found(spark):
    """A chain: each context shares its values with the next one only, so each round learns one context."""
    rows, contexts = [], ["alpha code:", "beta code:", "gamma code:", "delta code:"]
    values = [[f"user{i}@mail.example.com" for i in range(6)]] + [[f"ID-{c}-{i}" for i in range(6)] for c in range(4)]
    for c, context in enumerate(contexts):
        for i in range(6):
            for value in (values[c][i], values[c + 1][i]):
                rows += [(len(rows), f"{prose(len(rows), 7)} {context} {value} {prose(700 + len(rows), 5)}", "en", "a", 0)]
    found = pii.personal_data(documents(spark, rows), confidence=0.5, accept=0.5).collect()
    assert all(len(r.spans) == 1 for r in found)


def test_query_joins_spans(spark, monkeypatch):
    monkeypatch.setattr(pii, "table", lambda *_: documents(spark, ROWS))
    for r in pii.op8_personal_data(spark, "").collect():
        if r.doc_id in (301, 302, 303, 304):
            base = brute(CASES[r.doc_id - 300])
            assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == kind for k, _, _ in base) for kind in PLAIN]
            joined = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
            assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest() and set(joined.split(",")) <= set(r.spans.split(","))


def test_empty(spark):
    assert pii.personal_data(empty(spark)).count() == 0
