import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.helpers import documents, empty, odd_rows
from txnrisk.llm import simple8b, tokenstore

VOCABULARY = "byte_bpe_50k.json"


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 60_000), st.integers(0, 2**64 - 1)), max_size=600))
def test_simple8b_round_trip(values):
    words, offsets = simple8b.encode(np.array(values, dtype=np.uint64))
    assert simple8b.decode(words, offsets, len(values)).tolist() == values


def test_simple8b_packs_small_values():
    words, _ = simple8b.encode(np.zeros(simple8b.BLOCK * 10, dtype=np.uint64))
    assert len(words) <= 10 * -(-simple8b.BLOCK // 60) + 10


def test_any_block_decodes_on_its_own():
    values = np.arange(1000, dtype=np.uint64) ** 2
    words, offsets = simple8b.encode(values)
    one = words[offsets[3] : offsets[4]]
    assert simple8b.decode(one, np.zeros(1, np.uint32), simple8b.BLOCK).tolist() == values[3 * simple8b.BLOCK : 4 * simple8b.BLOCK].tolist()


@pytest.fixture(scope="module")
def encoder():
    return tokenstore.PieceEncoder(VOCABULARY)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab' \n\t\x1c\xa0\x85.,éĠ1<|>", max_size=30), max_size=6))
def test_pieces_give_the_ids_of_whole_texts(texts):
    _compare(_ENCODER, texts)


def test_special_texts(encoder):
    _compare(encoder, [None, "", " ", "a\n", "\n\na", "a.\nB, c", "<|endoftext|> x <|endoftext|>\ny", "don't  I'll", "é.\nÀ, b", "a \nb", "x" * 5000])


_ENCODER = tokenstore.PieceEncoder(VOCABULARY)


def _compare(encoder, texts):
    ids, counts = encoder.encode(pa.array(texts, pa.string()))
    want = [e.ids for e in encoder.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(tokenstore, "REMEMBERED", 3)
    for _ in range(3):
        _compare(_ENCODER, ["one two three four five six", "seven eight nine. Ten,\nEleven"])


@pytest.mark.parametrize("files", [1, 5])
def test_files_hold_all_documents_in_order(spark, files):
    manifest = tokenstore.write_token_files(documents(spark), VOCABULARY, 2, files=files)
    found = sorted(tokenstore.read_token_files(manifest, with_ids=True).collect(), key=lambda r: r.start)
    rows = sorted(odd_rows(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start = 0
    assert len(found) == len(rows)
    for r, (doc, text, *_) in zip(found, rows, strict=True):
        ids = [*_ENCODER.tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids) == (doc, start, len(ids), ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_empty(spark):
    assert tokenstore.read_token_files(tokenstore.write_token_files(empty(spark), VOCABULARY)).count() == 0
