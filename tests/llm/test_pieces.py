"""The token encoder looks a known piece up once."""

import pyarrow as pa

from txnrisk.llm import tokenstore
from txnrisk.llm.tokenstore import PieceEncoder


class Counting(dict):
    looked = 0

    def get(self, key, default=None):
        self.looked += 1
        return super().get(key, default)

    def __getitem__(self, key):
        self.looked += 1
        return super().__getitem__(key)

    def __contains__(self, key):
        self.looked += 1
        return super().__contains__(key)


def test_known_pieces_are_looked_up_once():
    encoder = PieceEncoder("byte_bpe_50k.json")
    texts = pa.array(["one two three. four", None, "", "two\nthree, <s> five one", " x", "a"])
    first = encoder.encode(texts)
    encoder.known = Counting(encoder.known)
    again = encoder.encode(texts)
    assert [v.tolist() for v in first] == [v.tolist() for v in again]
    assert 0 < encoder.known.looked <= 13
    plain = encoder._ids([t or "" for t in texts.to_pylist()])
    assert first[0].tolist() == [i for ids in plain for i in ids]


class Runs:
    """The tokenizer, with the size of what it encodes at once."""

    def __init__(self, tokenizer):
        self.tokenizer, self.texts = tokenizer, []

    def encode_batch_fast(self, texts, **options):
        self.texts.append([len(t) for t in texts])
        return self.tokenizer.encode_batch_fast(texts, **options)


def test_the_library_encodes_bounded_runs(monkeypatch):
    monkeypatch.setattr(tokenstore, "ENCODED", 50)
    encoder = PieceEncoder("byte_bpe_50k.json")
    texts = [" ".join(f"w{i}x{j}" for i in range(20)) + "  end" * (j % 2) for j in range(30)] + [None, "", "  " * 40, "a"]
    plain = [e.ids for e in encoder.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    encoder.tokenizer = runs = Runs(encoder.tokenizer)
    ids, counts = encoder.encode(pa.array(texts))
    assert ids.tolist() == [i for own in plain for i in own] and counts.tolist() == [len(own) for own in plain]
    assert all(len(run) == 1 or sum(run) <= 50 for run in runs.texts) and len(runs.texts) > 10
