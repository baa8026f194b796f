"""Documents as token ids in binary files, in ascending doc_id order.

Documents are dealt by ranges of doc_id, so that file k + 1 goes on where file k ends; each task encodes its documents
and writes one file of its own. A file is a row of segments, one per few MB of text: a fixed header, doc ids, null marks,
document lengths, words before each block and the Simple-8b words of all ids. Files carry a random name and only those that a
finished task reports are read, so a lost or repeated attempt leaves nothing behind but an unread file.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txnrisk.llm import simple8b
from txnrisk.llm.common import held, small_batches, table, text_slices
from txnrisk.session import materialise, run_folder

MAGIC = b"TIDSEG01"
#: magic, documents, ids, blocks, words
HEADER = struct.Struct("<8sQQQQ")
#: Encoded pieces that a Python worker remembers.
REMEMBERED = 600_000
#: Bytes of text encoded at once; a longer text is encoded on its own.
SLICE_BYTES = 3_000_000
#: Characters that the library encodes at once; a longer text is encoded on its own.
ENCODED = 1_000_000
#: White space for the tokenizer or for Python; texts are cut only where each character of it stands alone.
_WHITE = r"[\s\p{Z}\x0b\x1c-\x1f\x{85}]"
_UNSAFE = f"(^{_WHITE})|({_WHITE}{_WHITE})|({_WHITE}$)"

MANIFEST = T.StructType([
    T.StructField("file", T.StringType()),
    T.StructField("part", T.IntegerType()),
    T.StructField("n_ids", T.LongType()),
])
TOKENS = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("start", T.LongType()),
    T.StructField("n_tokens", T.LongType()),
    T.StructField("ids_crc32", T.LongType()),
    T.StructField("ids", T.ArrayType(T.LongType())),
])


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class PieceEncoder:
    """Encodes whole texts with a byte-level tokenizer, each distinct piece once.

    Byte-level pre-tokens hold white space at their start only, so a text can be cut before every space or newline that stands
    between two other characters without changing its ids; and a full stop or comma after a word of letters is a
    pre-token of its own. Pieces seen before are looked up. Texts with any other white space are encoded in one go.
    """

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path(vocabulary))
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.opens = np.zeros(self.tokenizer.get_vocab_size(), dtype=bool)  # tokens that begin with a space or newline
        for token, i in self.tokenizer.get_vocab().items():
            self.opens[i] = token[0] in "ĠĊ"
        self.marks = {mark: int(self._ids([mark])[0][0]) for mark in ".,"}
        self.forget()

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text. The library's encodings take many times the text's bytes: they are taken over in runs of texts."""
        out, run, chars = [], [], 0
        for text in [*texts, None]:
            if run and (text is None or chars + len(text) > ENCODED):
                out += [np.array(e.ids, dtype=np.uint32) for e in self.tokenizer.encode_batch_fast(run, add_special_tokens=False)]
                run, chars = [], 0
            if text is not None:
                run.append(text)
                chars += len(text)
        return out

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.starts, self.lengths = np.empty(0, np.uint32), np.empty(0, np.int64), np.empty(0, np.int64)

    def learn(self, pieces: list[str]) -> None:
        """Encodes new pieces: a word or other characters, with the newline before it, or without the space before it."""
        marked = [p for p in pieces if p[-1] in self.marks and p[:-1].lstrip("\n").isalpha()]
        ends = set(marked)
        bare = list(dict.fromkeys([p for p in pieces if p not in ends] + [p[:-1] for p in marked if p[:-1] not in self.known]))
        step, found, odd = 500, [], []
        groups = [bare[i : i + step] for i in range(0, len(bare), step)]
        spaced = [[p if p[0] == "\n" else " " + p for p in g] for g in groups]
        for group, forms, ids in zip(groups, spaced, self._ids(["".join(f) for f in spaced]), strict=True):
            starts = np.flatnonzero(self.opens[ids])
            if len(starts) == len(group):
                found.append((group, ids, starts))
            else:  # a special token, which takes no space before it
                odd += zip(group, forms, strict=True)
        for (p, _), ids in zip(odd, self._ids([form for _, form in odd]), strict=True):
            found.append(([p], ids, np.zeros(1, dtype=np.int64)))
        self._keep(found)
        if marked:
            base = np.array([self.known[p[:-1]] for p in marked], dtype=np.int64)
            mark = np.array([self.marks[p[-1]] for p in marked], dtype=np.uint32)
            length = self.lengths[base] + 1
            end = np.cumsum(length)
            source = np.repeat(self.starts[base] - (end - length), length) + np.arange(end[-1])
            ids = self.ids[np.minimum(source, len(self.ids) - 1)]
            ids[end - 1] = mark
            self._keep([(marked, ids, end - length)])

    def _keep(self, found: list[tuple[list[str], np.ndarray, np.ndarray]]) -> None:
        filled = len(self.ids)
        starts, lengths = [self.starts], [self.lengths]
        for pieces, ids, first in found:
            n = len(self.known)
            self.known.update(zip(pieces, range(n, n + len(pieces)), strict=True))
            starts.append(first + filled)
            lengths.append(np.diff(np.append(first, len(ids))))
            filled += len(ids)
        self.ids = np.concatenate([self.ids, *(ids for _, ids, _ in found)])
        self.starts, self.lengths = np.concatenate(starts), np.concatenate(lengths)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, number of ids of each text)."""
        texts = texts.cast(pa.large_string()).fill_null("")
        unsafe = pc.match_substring_regex(texts, _UNSAFE).to_numpy(zero_copy_only=False)
        if not unsafe.any():
            return self._encode_safe(texts)
        whole = self._ids(texts.filter(pa.array(unsafe)).to_pylist())
        ids, counts = self._encode_safe(texts.filter(pa.array(~unsafe)))
        pieces, at = iter(np.split(ids, np.cumsum(counts)[:-1]) if len(counts) else []), iter(whole)
        parts = [next(at) if u else next(pieces) for u in unsafe]
        return np.concatenate(parts), np.array([len(x) for x in parts], dtype=np.int64)

    def _encode_safe(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if len(self.known) > REMEMBERED:
            self.forget()
        pieces = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        counts = pc.list_value_length(pieces).to_numpy(zero_copy_only=False).astype(np.int64)
        if not counts.sum():
            return np.empty(0, np.uint32), np.zeros(len(texts), np.int64)
        firsts = np.cumsum(counts) - counts
        flat = pieces.flatten()
        # The first piece of a text has no white space before it.
        heads = self._ids(flat.take(pa.array(firsts)).to_pylist())
        coded = flat.dictionary_encode()
        del pieces, flat
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()  # several times faster than to_pylist
        known = self.known
        # One lookup for every distinct piece; only those not known yet are looked at again.
        numbers = np.fromiter(map(known.get, distinct, repeat(-1)), dtype=np.int64, count=len(distinct))
        missing = np.flatnonzero(numbers < 0).tolist()
        self.learn([p for p in (distinct[i] for i in missing) if p])
        for i in missing:
            numbers[i] = known[distinct[i]] if distinct[i] else 0  # an empty one is only ever a first piece
        piece = numbers[coded.indices.to_numpy()]
        if not len(self.ids):
            self.learn(["a"])
        length = self.lengths[piece]
        own = np.array([len(h) for h in heads], dtype=np.int64)
        length[firsts] = own
        ends = np.cumsum(length)
        out = self.ids[np.clip(np.repeat(self.starts[piece] - (ends - length), length) + np.arange(ends[-1]), 0, len(self.ids) - 1)]
        filled = own > 0
        at = np.repeat((ends - length)[firsts[filled]] - (np.cumsum(own[filled]) - own[filled]), own[filled]) + np.arange(own.sum())
        out[at] = np.concatenate(heads)
        return out, np.add.reduceat(length, firsts)


def _encoder(vocabulary: str) -> PieceEncoder:
    return held("tokens", vocabulary, lambda: PieceEncoder(vocabulary))


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def _with_end(ids: np.ndarray, counts: np.ndarray, end_id: int) -> np.ndarray:
    out = np.full(len(ids) + len(counts), end_id, dtype=np.uint32)
    out[np.arange(len(ids)) + np.repeat(np.arange(len(counts)), counts)] = ids
    return out


def segment_bytes(doc_ids: pa.Array, ids: np.ndarray, lengths: np.ndarray) -> list[bytes]:
    words, offsets = simple8b.encode(ids)
    return [
        HEADER.pack(MAGIC, len(lengths), len(ids), len(offsets), len(words)),
        doc_ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes(),
        doc_ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8).tobytes(),
        lengths.astype("<u4").tobytes(),
        offsets.astype("<u4").tobytes(),
        words.astype("<u8").tobytes(),
    ]


def read_segments(stream) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(doc ids, lengths, ids) of each segment of a file."""
    while head := stream.read(HEADER.size):
        magic, docs, n, blocks, words = HEADER.unpack(head)
        if magic != MAGIC:
            raise ValueError("not a token file")
        keys = np.frombuffer(stream.read(8 * docs), "<i8")
        nulls = np.frombuffer(stream.read(docs), np.uint8).astype(bool)
        lengths = np.frombuffer(stream.read(4 * docs), "<u4").astype(np.int64)
        offsets = np.frombuffer(stream.read(4 * blocks), "<u4")
        yield pa.array(keys, mask=nulls), lengths, simple8b.decode(np.frombuffer(stream.read(8 * words), "<u8"), offsets, n)


def write_token_files(docs: DataFrame, vocabulary: str = "byte_bpe_50k.json", end_id: int = 2, folder: str | None = None, files: int | None = None) -> DataFrame:
    """Writes the ids of all documents, each with `end_id` after it, and returns the manifest: file, part, n_ids, start.

    Files follow each other in ascending order of doc_id, null first; documents of one doc_id follow each other by text. A null
    or empty text has the end id alone; texts of any length are encoded whole; an empty table gives no file. Only doc_id
    and text are read of `docs`. There are as many files as the input has splits.
    """
    spark = docs.sparkSession
    folder = folder or run_folder(spark, "token-ids")
    narrow = small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    count = files or max(1, narrow.rdd.getNumPartitions())

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, sink, total = f"{folder}/{uuid.uuid4().hex}.s8b", None, 0
        encoder = _encoder(vocabulary)
        for batch in batches:
            if not batch.num_rows:
                continue
            if sink is None:
                system, name = _open(path)
                system.create_dir(name.rsplit("/", 1)[0], recursive=True)
                sink = system.open_output_stream(name)
            for part in text_slices(batch, SLICE_BYTES):
                ids, counts = encoder.encode(part.column("text"))
                for piece in segment_bytes(part.column("doc_id"), _with_end(ids, counts, end_id), counts + 1):
                    sink.write(piece)
                total += len(ids) + len(counts)
        if sink is not None:
            sink.close()
            yield pa.RecordBatch.from_pydict({"file": [path], "part": pa.array([TaskContext.get().partitionId()], pa.int32()), "n_ids": [total]})

    ordered = narrow.repartitionByRange(count, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    manifest = materialise(ordered.mapInArrow(write, MANIFEST), "token-manifest")
    # One row per file: small, whatever the files hold.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("long"))


def read_token_files(manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """One row per document of the files: doc_id, start, n_tokens, ids_crc32, and ids if asked for (else null)."""
    files = manifest.select("file", "start").repartition(max(1, manifest.count()))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column("file").to_pylist(), batch.column("start").to_pylist(), strict=True):
                system, name = _open(path)
                with system.open_input_stream(name) as stream:
                    for keys, lengths, ids in read_segments(stream):
                        ends = np.cumsum(lengths)
                        small = ids.astype("<u4")
                        crc = [zlib.crc32(small[a:b]) for a, b in zip((ends - lengths).tolist(), ends.tolist(), strict=True)]
                        lists = pa.ListArray.from_arrays(np.append(0, ends).astype(np.int32), ids.astype(np.int64)) if with_ids else pa.nulls(len(keys), pa.list_(pa.int64()))
                        yield pa.RecordBatch.from_arrays([keys, pa.array(start + ends - lengths), pa.array(lengths), pa.array(crc, pa.int64()), lists], names=TOKENS.fieldNames())
                        start += int(ends[-1])

    return files.mapInArrow(read, TOKENS)


def op10_tokens(spark, sf_dir):
    manifest = write_token_files(table(spark, sf_dir, "documents"), vocabulary="byte_bpe_50k.json", end_id=2)
    return read_token_files(manifest).drop("ids")


QUERIES = {"op10_tokens": op10_tokens}
#: Subword merges cannot be expressed in SQL: tests compare with the tokenizers library.
ORACLE = {}
