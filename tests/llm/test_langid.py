import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.conftest import SMALL
from tests.llm.helpers import documents, empty, odd_rows, prose
from txnrisk.llm import langid as L

SAMPLES = (("aa", "the cat sat on the mat and the dog ran off"), ("bb", "zu dem haus der katze und dem hund da"), ("cc", "el gato y la casa del perro"))
MODEL = (SAMPLES, "abcdefghijklmnopqrstuvwxyz")


def symbols(text, alphabet):
    return alphabet.encode(pa.array([text]))[0].tolist()


def phrases(text, sample):
    """Greedy longest matches, each block on its own; a symbol that the sample lacks is a phrase."""
    count = 0
    for at in range(0, len(text), L.BLOCK):
        block = text[at : at + L.BLOCK]
        i = 0
        while i < len(block):
            n = 1
            while i + n < len(block) and _inside(block[i : i + n + 1], sample):
                n += 1
            count, i = count + 1, i + n
    return count


def _inside(part, sample):
    return any(sample[j : j + len(part)] == part for j in range(len(sample) - len(part) + 1))


def test_entropies_equal_plain_parsing():
    model = L.Model(*MODEL)
    texts = ["the dog and the cat", "Haus! 12 dem  hund", "qqqq", "é ñ Ω", "a", "", "  ", "gato " * 300, "1 2 3", "xyz the"]
    bits, letters = model.entropies(pa.array(texts))
    for text, own in zip(texts, bits, strict=True):
        s = symbols(text, model.alphabet)
        for (_, sample), b in zip(SAMPLES, own, strict=True):
            t = symbols(sample, model.alphabet)
            assert b == pytest.approx(phrases(s, t) * np.log2(len(t)) / max(1, len(s)))
    assert letters.tolist() == [sum(c.isalpha() for c in t) for t in texts]


def test_automaton_knows_exactly_the_substrings():
    rng = np.random.default_rng(1)
    text = rng.integers(0, 3, 60)
    follow, size = L.suffix_automaton(text, 3), 3
    inside = {tuple(text[i:j]) for i in range(60) for j in range(i + 1, min(60, i + 6) + 1)}
    for _ in range(500):
        part = tuple(rng.integers(0, 3, rng.integers(1, 6)))
        state = 2 * size
        for c in part:
            state = follow[state + c]
        assert (state > 0) == (part in inside)


def test_predictions_of_odd_rows(spark):
    rows = odd_rows() + [(20, "the cat ran", None, "en", 1), (21, "12 !?", None, None, None)]
    found = L.predict(documents(spark, rows), MODEL).collect()
    assert len(found) == len(rows)
    by_id = {r.doc_id: r for r in found}
    assert all(by_id[i].lang_pred == "und" and by_id[i].score == 0 for i in (1, 2, 3, 21))
    assert by_id[20].lang_pred == "aa" and all(0 <= r.score <= 1 for r in found)
    kept = L.identified(documents(spark, rows), MODEL)
    known = {r.doc_id for r in found if r.lang_pred != "und"}
    assert kept.columns == documents(spark, rows).columns and {4, 8, 20} <= {r.doc_id for r in kept.collect()} <= known


def test_noise_goes_and_language_stays(spark):
    rng = np.random.default_rng(4)
    letters = list("".join(prose(0, 200).split()))
    noise = ["".join(rng.choice(letters, n)) for n in (60, 300, 3_000)] + [" ".join("".join(rng.choice(letters, 6)) for _ in range(50))]
    rows = [(i, prose(i, 20 + i), "en" if i % 2 else "fr", "a", 0) for i in range(60)]
    rows += [(500 + i, text, None, "a", 0) for i, text in enumerate(noise)] + [(600, "qqqqq", "en", "a", 0), (601, "123", "en", "a", 0)]
    kept = {r.doc_id for r in L.identified(documents(spark, rows)).collect()}
    assert kept == {*range(60), 600}


def test_without_a_label_everything_stays(spark):
    rows = [(i, prose(i, 30), None, "a", 0) for i in range(50)] + [(90, None, None, None, None), (91, "123", None, "a", 0)]
    docs = documents(spark, rows)
    assert sorted(L.identified(docs).collect(), key=str) == sorted(docs.collect(), key=str)


def test_held_out_rows_are_not_learned(spark):
    rows = [(i, f"{'held' if zlib.crc32(str(i).encode()) % 4 == 2 else 'plain'} words {i}", "en" if i % 3 else None, "x", 1) for i in range(200)]
    docs = documents(spark, rows)
    want = {i for i, *_ in rows if zlib.crc32(str(i).encode()) % 4 == 2}
    assert {r.doc_id for r in docs.filter(L.held_out(F.col("doc_id"))).collect()} == want
    sample = L.training_sample(docs, rows=50).collect()
    assert len(sample) == 50 and not any("held" in r.text for r in sample)
    (_, text), = L.fit(docs, chars=100)[0]
    assert len(text) == 100


def test_accuracy_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    found = docs.join(L.predict(docs, L.fit(docs)), "doc_id").filter(L.held_out(F.col("doc_id")) & F.col("lang").isNotNull())
    right = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right >= 0.95


def test_empty_and_without_labels(spark):
    assert L.predict(empty(spark), L.fit(empty(spark))).count() == 0
    unlabelled = documents(spark, [(1, "some text", None, "a", 1)])
    assert [r.lang_pred for r in L.predict(unlabelled, L.fit(unlabelled)).collect()] == ["und"]
    assert L.identified(empty(spark)).count() == 0


def scripts(kinds, rows, letters, seed):
    """(doc_id, text, lang): languages over the same letters of one script differ by the pairs that they use."""
    out = []
    for name, base in kinds:
        for variant in range(2):
            rng = np.random.default_rng(seed + base + variant)
            order = rng.permutation(letters).reshape(-1, 2)
            for i in range(rows):
                picks = order[rng.integers(0, len(order), 60)].ravel()
                out.append((len(out), "".join(chr(base + int(c)) for c in picks), f"{name}{variant}", "x", i))
    return out


KINDS = [("han", 0x4E00), ("hangul", 0xAC00), ("cyrillic", 0x430), ("latin", 0x61)]


@pytest.mark.parametrize("cells", [0, 10**9])
def test_letters_of_large_scripts_stay_apart(monkeypatch, cells):
    monkeypatch.setattr(L, "TABLE_CELLS", cells, raising=False)
    model = L.Model((("aa", "".join(map(chr, range(0x4E00, 0x4E80)))), ("bb", "".join(map(chr, range(0x4E08, 0x4E88))))), "abc")
    # Letters of bb's sample that the first lacks, in order: one phrase there, one each in aa.
    bits = model.entropies(pa.array(["".join(map(chr, range(0x4E80, 0x4E88)))]))[0][0] * 8 / np.log2(128)
    assert bits.tolist() == pytest.approx([8, 1])


@pytest.mark.parametrize("cells", [0, 10**9])
def test_sparse_and_plain_transitions_equal_plain_parsing(monkeypatch, cells):
    monkeypatch.setattr(L, "TABLE_CELLS", cells, raising=False)
    test_entropies_equal_plain_parsing()
    rng = np.random.default_rng(5)
    text = rng.integers(1, 40, 3_000)
    edges = L.suffix_automaton(text, 41)
    keys = np.arange(2 * 41, 2_000 * 41)
    assert (edges[keys] == edges.plain(6_010 * 41)[keys]).all()


def test_accuracy_with_several_scripts(spark):
    sizes = {"han": 2_000, "hangul": 2_000, "cyrillic": 32, "latin": 26}
    rows = [r for name, base in KINDS for r in scripts([(name, base)], 150, sizes[name], 9)]
    rows = [(i, *r[1:]) for i, r in enumerate(rows)]
    assert len({c for r in rows for c in r[1]}) > 1_000
    docs = documents(spark, rows)
    found = {r.doc_id: r.lang_pred for r in L.predict(docs, L.fit(docs)).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]
    assert len(held) > 200 and np.mean([found[r[0]] == r[2] for r in held]) >= 0.95
