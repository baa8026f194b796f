import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from txnrisk.llm import conversations as C

SCHEMA = "conv_id long, turn long, role string, text string"
LEGAL = re.compile("(s?(ua)+)?")


def brute(rows):
    """(cost, audit, lines) of the cheapest repair by trying every edit of every turn, with up to two insertions in each gap."""
    seen, found = set(), [(0, "", "", ())]
    for role, text in [*rows, (None, None)]:
        inserted = list(found)
        for _ in range(2):
            inserted += [(c + 2, a + "I", s + r[0], (*lines, r + ":")) for c, a, s, lines in inserted for r in ("user", "assistant")]
        if role is None:
            found = inserted
            break
        shown = text.strip(" \t\n\x0b\x0c\r")
        gone = not shown or (role, text) in seen
        seen.add((role, text))
        more = 0 if gone or shown[-1] in ".!?" else 1
        out = [(c + 3, a + "D", s, lines) for c, a, s, lines in inserted]
        if not gone:
            out += [(c + more, a + "K", s + (role[:1] or "?"), (*lines, f"{role}:{text}")) for c, a, s, lines in inserted]
            out += [(c + 2 + more, a + "R", s + r[0], (*lines, f"{r}:{text}")) for c, a, s, lines in inserted for r in ("user", "assistant")]
        # Only what may still become legal; of equal states the best by cost and audit is enough, as longer ones cost more.
        best = {}
        for way in out:
            if re.fullmatch("(s?(ua)*u?)", way[2]):
                state = way[2][-1:]
                if state not in best or way[:2] < best[state][:2]:
                    best[state] = way
        found = list(best.values())
    return min(way[:2] + way[3:] for way in found if LEGAL.fullmatch(way[2]))


def expected(rows):
    """Reports of (conv_id, turn, role, text) rows."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted(((t is not None, t or 0, " " if r is None else r, " " if x is None else x, t) for c, t, r, x in rows if c == conv))
        turns = [(r, x) for _, _, r, x, _ in own]
        known = [t for *_, t in own if t is not None]
        seen, faults = set(), [0, 0, 0]
        for r, x in turns:
            shown = x.strip(" \t\n\x0b\x0c\r")
            fault = 0 if not shown else 1 if (r, x) in seen else 2 if shown[-1] not in ".!?" else None
            seen.add((r, x))
            if fault is not None:
                faults[fault] += 1
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(turns))
        cost, audit, lines = brute(turns)
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        out[conv] = (gaps, *faults, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def conversations(seed, n, longest):
    rng = random.Random(seed)
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "sys", "unknown"]
    texts = ["Yes.", "No", "Why?", "", " \n", None, "a. ", "é!", "x y"] + [f"Text {i}{e}" for i in range(30) for e in (".", "")]
    rows = []
    for conv in [None, *range(n)]:
        for turn in range(rng.randint(1, longest)):
            rows.append((conv, rng.choice([turn, turn, turn, None, 0]), rng.choice(roles), rng.choice(texts)))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("clash") for c in ("pos", "seg", "audit", "n", "fault", "copy", "place", "edit", "long_id", "tie", "own_id")})


@pytest.mark.parametrize(("long_turns", "segment"), [(4_096, 1_024), (3, 4), (1, 1), (6, 2)])
def test_equals_trying_everything(spark, monkeypatch, long_turns, segment):
    monkeypatch.setattr(C, "SEGMENT", segment)
    rows = conversations(long_turns, 60, 12) + [(99, i // 3, "user", "Same.") for i in range(40)]
    got = {r[0]: tuple(r[1:]) for r in C.repair_reports(frame(spark, rows), long_turns=long_turns).collect()}
    assert got == expected(rows)


@pytest.mark.parametrize("long_turns", [4_096, 2])
def test_turns_are_those_of_the_report(spark, long_turns):
    rows = conversations(7, 30, 8)
    turns = C.repaired_turns(frame(spark, rows), long_turns=long_turns).orderBy("conv_id", "place").collect()
    reports = {r.conv_id: r for r in C.repair_reports(frame(spark, rows)).collect()}
    for conv, report in reports.items():
        own = [t for t in turns if t.conv_id == conv]
        assert hashlib.sha256("\n".join(f"{t.role}:{t.text}" for t in own).encode()).hexdigest() == report.repaired_sha256
        assert "".join(t.edit for t in own) == report.audit.replace("D", "")
        assert LEGAL.fullmatch("".join(t.role[0] for t in own))


def test_damage_by_checksum(spark):
    rows = [(c, t, "assistant", "Some text. Really?") for c in range(40) for t in (0, 1, None)]
    got = [tuple(r) for r in C.damaged(frame(spark, rows)).collect()]
    want = []
    for c, t, role, text in rows:
        fault = zlib.crc32(f"{c}:{' ' if t is None else t}".encode()) % 20
        role, text = "user" if fault == 4 else role, {1: "", 2: "Some text Really"}.get(fault, text)
        want += [(c, t, role, text)] * {0: 0, 3: 2}.get(fault, 1)
    assert sorted(got, key=str) == sorted(want, key=str)


def test_long_conversation_in_one_pass_and_in_segments(spark, monkeypatch):
    monkeypatch.setattr(C, "SEGMENT", 64)
    rows = [(1, *r[1:]) for r in conversations(5, 300, 6)]
    rows = [(c, i, r, x) for i, (c, _, r, x) in enumerate(rows)]
    whole = C.repair_reports(frame(spark, rows)).collect()
    cut = C.repair_reports(frame(spark, rows).repartition(5), long_turns=100).collect()
    assert [tuple(r) for r in whole] == [tuple(r) for r in cut]


def test_empty(spark):
    assert C.repair_reports(frame(spark, [])).collect() == []
    assert C.repaired_turns(frame(spark, [])).collect() == []
