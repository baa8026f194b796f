"""Language identification by cross-parsing entropy.

A bounded sample of labelled text of each language is turned into a suffix automaton. A text is cut into phrases, each the
longest match in a language's sample; the language that needs the fewest phrases, normalised by the logarithm of its
sample's length (bits per letter, the cross-parsing entropy), wins. Every letter of the samples is a symbol of its own. Automata are built from the samples inside the
Python workers, once each; texts are parsed in blocks of letters, all blocks of a batch in step.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txnrisk.llm.common import held, small_batches, table, text_slices, trim

#: Bounds of the training sample: rows a language, characters taken of a row, letters a language.
SAMPLE_ROWS, ROW_CHARS, SAMPLE_CHARS = 300, 2_000, 40_000
#: The most frequent labels are learned, up to so many.
LANGUAGES = 500
#: Cells that the transitions of all languages may take as plain tables; beyond, they are hashed.
TABLE_CELLS = 25_000_000
#: Letters parsed on their own: phrases do not cross these blocks.
BLOCK = 512
#: Bytes of text parsed in step.
RUN_BYTES = 2_000_000
UNKNOWN = "und"
#: Pieces of each sample that are shuffled to learn the entropy of noise, and their characters.
NOISE_PIECES, NOISE_CHARS = 20, 400
#: Letters from which on a text can be told from noise.
JUDGED = 50

PREDICTED = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("lang_pred", T.StringType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("entropy", T.DoubleType()),
])


def held_out(doc_id: F.Column) -> F.Column:
    """Rows kept for the test: one in four, by checksum of the id; a null id is not among them."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def training_sample(docs: DataFrame, rows: int = SAMPLE_ROWS, row_chars: int = ROW_CHARS) -> DataFrame:
    """lang, text: up to `rows` labelled rows of each language outside the held-out ones, the start of each text.

    Rows are drawn by a hash of their id. Counts come first, so that only about twice the wanted rows are ever ranked.
    """
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & F.col("text").isNotNull())
    draw = F.pmod(F.xxhash64(F.lit("langid"), "doc_id"), F.lit(1 << 40)) / float(1 << 40)
    # A bounded vocabulary: the model knows at most LANGUAGES languages, so the counts may be broadcast.
    counts = labelled.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(LANGUAGES)
    drawn = labelled.select("doc_id", "lang", F.substring("text", 1, row_chars).alias("text"), draw.alias("draw")).join(F.broadcast(counts), "lang")
    # At least `rows` of a language pass the threshold but with negligible probability.
    few = drawn.filter(F.col("draw") * F.col("n") < 1.5 * rows + 50)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("draw", "doc_id", "text"))
    return few.withColumn("rank", rank).filter(F.col("rank") <= rows).select("lang", "rank", "text")


class Alphabet:
    """Symbols of characters: 0 for everything that is not a letter, one for each known letter, the last for letters of no sample."""

    def __init__(self, letters: str):
        self.size = len(letters) + 2
        low = _lower_letters()
        own = np.where(low > 0, len(letters) + 1, 0).astype(np.int32)
        own[[ord(c) for c in letters]] = 1 + np.arange(len(letters))
        self.symbols = own[low]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(symbols of all texts one after the other, their number for each text); other characters are one break each run."""
        strings = texts.to_pylist()
        codes = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.fromiter((len(s) for s in strings), dtype=np.int64, count=len(strings))
        symbols = self.symbols[codes]
        kept = np.ones(len(symbols), dtype=bool)
        kept[1:] = (symbols[1:] > 0) | (symbols[:-1] > 0)
        starts = np.cumsum(lengths) - lengths
        kept[starts[lengths > 0]] = True
        total = np.concatenate([[0], np.cumsum(kept)])
        return symbols[kept], total[starts + lengths] - total[starts]


@lru_cache(maxsize=1)
def _lower_letters() -> np.ndarray:
    """The code point of the lower case of every letter, 0 for everything else."""
    chars = map(chr, range(0x110000))
    return np.fromiter((ord(c.lower()[0]) if unicodedata.category(c)[0] == "L" else 0 for c in chars), dtype=np.int32, count=0x110000)


class Edges:
    """A hash table from keys (not negative) to values: edges[keys] are the values, 0 for absent keys."""

    MIX = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(4, int(2 * len(keys)).bit_length())  # at most half full
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, dtype=np.int64), np.zeros(1 << bits, dtype=np.int64)
        slot = self._slot(keys)
        todo = np.arange(len(keys))
        while len(todo):
            free = todo[self.keys[slot[todo]] < 0]
            won = free[np.unique(slot[free], return_index=True)[1]]  # one of those that want the same slot
            self.keys[slot[won]], self.values[slot[won]] = keys[won], values[won]
            todo = todo[self.keys[slot[todo]] != keys[todo]]
            slot[todo] = (slot[todo] + 1) & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * self.MIX) >> self.shift).astype(np.int64)

    def __getitem__(self, keys) -> np.ndarray:
        keys = np.asarray(keys, dtype=np.int64)
        flat = keys.reshape(-1)
        slot = self._slot(flat)
        held = self.keys[slot]
        out = np.where(held == flat, self.values[slot], 0)
        todo = np.flatnonzero((held != flat) & (held >= 0))
        slot = slot[todo]
        while len(todo):
            slot = (slot + 1) & self.mask
            held = self.keys[slot]
            hit = held == flat[todo]
            out[todo[hit]] = self.values[slot[hit]]
            on = ~hit & (held >= 0)
            todo, slot = todo[on], slot[on]
        return out.reshape(keys.shape)

    def plain(self, cells: int) -> np.ndarray:
        """The same as an array."""
        used = self.keys >= 0
        out = np.zeros(cells, dtype=np.int32)
        out[self.keys[used]] = self.values[used]
        return out


def suffix_automaton(symbols: np.ndarray, size: int) -> Edges:
    """Transitions of the automaton of all substrings: key state * size + symbol holds the next state * size.

    State 0 is "no match", state 1 has no transitions, state 2 is the root. There are at most three edges a symbol, whatever the size.
    """
    n = len(symbols)
    follow: list[dict[int, int]] = [{} for _ in range(2 * n + 4)]
    link, length = [0] * (2 * n + 4), [0] * (2 * n + 4)
    last, used = 2, 3
    for c in symbols.tolist():
        new, used = used, used + 1
        length[new] = length[last] + 1
        p = last
        while p and c not in follow[p]:
            follow[p][c] = new
            p = link[p]
        if not p:
            link[new] = 2
        else:
            q = follow[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                clone, used = used, used + 1
                follow[clone] = follow[q].copy()
                length[clone], link[clone] = length[p] + 1, link[q]
                while p and follow[p].get(c) == q:
                    follow[p][c] = clone
                    p = link[p]
                link[q] = link[new] = clone
        last = new
    edges = [(state * size + c, to * size) for state, own in enumerate(follow[:used]) for c, to in own.items()]
    keys, values = np.array(edges, dtype=np.int64).reshape(-1, 2).T
    return Edges(keys, values)


class Model:
    """The automata of all languages."""

    def __init__(self, samples: tuple[tuple[str, str], ...], letters: str):
        more = {c for _, text in samples for c in text if c.isalpha()} - set(letters)
        self.alphabet = Alphabet(letters + "".join(sorted(more)))
        self.languages = [lang for lang, _ in samples]
        size = self.alphabet.size
        encoded = [self.alphabet.encode(pa.array([text]))[0] for _, text in samples]
        cells = [(2 * len(symbols) + 4) * size for symbols in encoded]
        self.tables, self.starts, self.bits = [], [], []
        for symbols, n in zip(encoded, cells, strict=True):
            follow = suffix_automaton(symbols, size)
            start = follow[2 * size + np.arange(size)]
            start[start == 0] = size  # a character that the language lacks is a phrase of its own
            plain = sum(cells) <= TABLE_CELLS
            self.tables.append(follow.plain(n) if plain else follow)
            self.starts.append(start.astype(np.int32) if plain else start)
            self.bits.append(np.log2(max(2, len(symbols))))
        self.states = np.int32 if sum(cells) <= TABLE_CELLS else np.int64
        self.noise = self._noise(samples)

    def _noise(self, samples: tuple[tuple[str, str], ...]) -> float:
        """The entropy of what is no language: pieces of the samples with their letters in random order (median)."""
        rng, pieces = np.random.default_rng(1), []
        for _, text in samples:
            for start in range(0, len(text), max(NOISE_CHARS, len(text) // NOISE_PIECES)):
                piece = np.array(list(text[start : start + NOISE_CHARS]))
                letter = np.array([c.isalpha() for c in piece])
                piece[letter] = rng.permutation(piece[letter])
                pieces.append("".join(piece))
        bits, letters = self.entropies(pa.array(pieces))
        best = bits.min(axis=1)[letters >= min(JUDGED, letters.max(initial=0))]
        return float(np.median(best)) if len(best) else np.inf

    def entropies(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(bits per symbol of each text under each language; letters of each text)."""
        symbols, counts = self.alphabet.encode(texts)
        n = len(counts)
        ends = np.cumsum(counts)
        letters = np.concatenate([[0], np.cumsum(symbols > 0)])
        letters = letters[ends] - letters[ends - counts]
        blocks = -(-counts // BLOCK)
        owner = np.repeat(np.arange(n), blocks)
        at = (ends - counts)[owner] + (np.arange(len(owner)) - (np.cumsum(blocks) - blocks)[owner]) * BLOCK
        length = np.minimum(BLOCK, ends[owner] - at)
        order = np.argsort(-length, kind="stable")  # blocks that still go on are always the first ones
        owner, at, length = owner[order], at[order], length[order]
        going = len(length) - np.searchsorted(length[::-1], np.arange(BLOCK), side="right")
        phrases = np.zeros((len(self.tables), len(owner)), dtype=np.int64)
        states = np.zeros((len(self.tables), len(owner)), dtype=self.states)  # nothing matches in state 0: the first phrase opens
        for step in range(int(length.max()) if len(length) else 0):
            live = int(going[step])
            symbol = symbols[at[:live] + step]
            for k, follow in enumerate(self.tables):
                state = follow[states[k, :live] + symbol]
                fails = state == 0
                np.copyto(state, self.starts[k][symbol], where=fails)
                phrases[k, :live] += fails
                states[k, :live] = state
        bits = np.stack([np.bincount(owner, weights=p * b, minlength=n) for p, b in zip(phrases, self.bits, strict=True)], axis=1)
        return bits / np.maximum(counts, 1)[:, None], letters


def _model(samples: tuple[tuple[str, str], ...], letters: str) -> Model:
    return held("langid", (samples, letters), lambda: Model(samples, letters))


def fit(docs: DataFrame, rows: int = SAMPLE_ROWS, row_chars: int = ROW_CHARS, chars: int = SAMPLE_CHARS) -> tuple[tuple[tuple[str, str], ...], str]:
    """(samples, letters) of a model: for each language at most `chars` characters, and all letters of the samples, the most frequent first.

    Reads text, lang and doc_id of the labelled rows that are not held out; the collected sample has at most `rows` rows of at most
    `row_chars` characters a language.
    """
    texts: dict[str, list[tuple[int, str]]] = {}
    for r in training_sample(docs, rows, row_chars).collect():
        texts.setdefault(r["lang"], []).append((r["rank"], r["text"]))
    samples, seen = [], {}
    for lang in sorted(texts):
        text = " ".join(t for _, t in sorted(texts[lang])).lower()[:chars]
        if any(c.isalpha() for c in text):
            samples.append((lang, text))
            for c in text:
                if c.isalpha():
                    seen[c] = seen.get(c, 0) + 1
    letters = sorted(sorted(seen), key=lambda c: -seen[c])
    return tuple(samples), "".join(letters)


def predict(docs: DataFrame, model: tuple[tuple[tuple[str, str], ...], str]) -> DataFrame:
    """One row per document: doc_id, lang_pred, score, entropy (bits per symbol under that language).

    The score is 1 - best / second best entropy (1 if one language is known). Null texts and texts without a letter are
    "und" with score 0, as is everything if no labelled text was found. Ties go to the first language by code point. Texts are
    parsed whole, whatever their length; repeated rows get equal results; an empty table gives an empty result. Only doc_id and
    text are read.
    """
    samples, letters = model

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        built = _model(samples, letters) if samples else None
        for batch in batches:
            for part in text_slices(batch, RUN_BYTES):
                texts = part.column("text").cast(pa.large_string()).fill_null("")
                n = len(texts)
                pred, score, entropy = np.full(n, None, dtype=object), np.zeros(n), np.full(n, np.nan)
                pred[:] = UNKNOWN
                if built:
                    bits, count = built.entropies(texts)
                    best = bits.argmin(axis=1)
                    entropy = bits[np.arange(n), best]
                    second = np.partition(bits, 1, axis=1)[:, 1] if bits.shape[1] > 1 else np.full(n, np.inf)
                    known = count > 0
                    names = np.array(built.languages, dtype=object)
                    pred[known] = names[best[known]]
                    score[known] = 1 - entropy[known] / np.maximum(second[known], 1e-12)
                    entropy[~known] = np.nan
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(pred, pa.string()), pa.array(np.clip(score, 0, 1)), pa.array(entropy, from_pandas=True)], names=PREDICTED.fieldNames())
        trim()

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(parse, PREDICTED)


def identified(docs: DataFrame, model=None) -> DataFrame:
    """The documents, all columns, without those whose language cannot be told; the model is fitted on them if not given.

    Rejected are texts without a letter, nulls included, and texts of JUDGED letters or more whose entropy under the best language is not
    below that of noise: letters of the samples in random order. Where no language could be learned, nothing can be told
    apart and all documents stay.
    """
    samples, letters = model or fit(docs)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        built = _model(samples, letters)
        for batch in batches:
            for part in text_slices(batch, RUN_BYTES):
                bits, count = built.entropies(part.column("text").cast(pa.large_string()).fill_null(""))
                known = (count > 0) & ((count < JUDGED) | (bits.min(axis=1) < built.noise))
                yield part.filter(pa.array(known))
        trim()

    return small_batches(docs).mapInArrow(keep, docs.schema) if samples else docs


def op6_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = predict(docs, fit(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


QUERIES = {"op6_language": op6_language}
#: Longest matches against samples cannot be expressed in SQL: tests compare with a plain parser and check held-out accuracy.
ORACLE = {}
