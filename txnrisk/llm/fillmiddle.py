"""Fill-in-the-middle transformation of whole texts.

A text is cut at two drawn places into prefix, middle and suffix, which are put in another order between sentinels. Texts are cut
between units only. One full match of the repeated unit, ``(unit)*``, keeps every repetition of its group: ``match.ends(1)`` holds
the end of each unit, so its length is the number of units and two of its entries are the cuts. Which documents change, where and into which
form is drawn from a hash of the seed and the document's id, so reruns and any partitioning give the same rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from txnrisk.llm.common import table, text_slices

#: A run of letters, or any other single character.
UNIT = "[A-Za-z]+|[^A-Za-z]"
#: Before prefix, suffix and middle; a text that holds one of them stays plain.
SENTINELS = ("<P>", "<S>", "<M>")
PLAIN, PSM, SPM = "plain", "psm", "spm"
#: Bytes of text that are cut at once; a longer text is cut on its own.
SLICE_BYTES = 2_000_000

CUT = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("n", T.LongType()),
    T.StructField("form", T.StringType()),
    T.StructField("prefix_chars", T.LongType()),
    T.StructField("middle_chars", T.LongType()),
    T.StructField("output", T.StringType()),
])


def draws(seed: int, doc_id: int | None) -> list[int]:
    """Four numbers below 2^32 for a document; a null id counts as the empty string."""
    name = f"{seed}:{'' if doc_id is None else doc_id}"
    digest = hashlib.sha256(name.encode()).hexdigest()
    return [int(digest[i : i + 8], 16) for i in range(0, 32, 8)]


class Cutter:
    def __init__(self, unit: str, sentinels: tuple[str, str, str], seed: int, changed: int, spm: int):
        # Possessive: units are taken from left to right and none is ever given back.
        self.units = regex.compile(f"(?:({unit}))*+", regex.DOTALL)
        self.sentinels, self.seed, self.changed, self.spm = sentinels, seed, changed, spm

    def cut(self, doc_id: int | None, text: str) -> tuple[int, str, int | None, int | None, str]:
        """(units, form, length of the prefix, length of the middle, output)."""
        ends = self.units.fullmatch(text).ends(1)
        n = len(ends)
        h1, h2, h3, h4 = draws(self.seed, doc_id)
        if not text or h3 % 100 >= self.changed or any(mark in text for mark in self.sentinels):
            return n, PLAIN, None, None, text
        first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
        a, b = (ends[i - 1] if i else 0 for i in (first, second))
        p, s, m = self.sentinels
        prefix, middle, suffix = p + text[:a], m + text[a:b], s + text[b:]
        if h4 % 100 < self.spm:
            return n, SPM, a, b - a, suffix + prefix + middle
        return n, PSM, a, b - a, prefix + suffix + middle


def fill_in_middle(docs: DataFrame, seed: int = 1, changed: int = 90, spm: int = 20, unit: str = UNIT, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """One row per document: doc_id, n (units), form (plain, psm, spm), prefix_chars, middle_chars (null if plain), output.

    `changed` percent of the documents change, `spm` percent of those begin with the suffix. Null texts count as empty; empty texts and texts that
    hold a sentinel stay plain. Texts are cut whole; one text at a time is held with the ends of its units. Rows of equal
    id and text get equal results; a null id is drawn like the empty string; an empty table gives an empty result. Only doc_id and
    text are read, so other columns may have any name.
    """

    def transform(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Cutter(unit, sentinels, seed, changed, spm)
        for batch in batches:
            for part in text_slices(batch, SLICE_BYTES):
                ids = part.column("doc_id").to_pylist()
                rows = [(i, *cutter.cut(i, text or "")) for i, text in zip(ids, part.column("text").to_pylist(), strict=True)]
                columns = zip(*rows, strict=True)
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=CUT.fieldNames())

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(transform, CUT)


def restored(output: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text that an output of that form was made of.

    Neither part holds a sentinel and none can arise where a part meets one, so the first occurrence of each is the one put in.
    """
    p, s, m = sentinels

    def between(start: str, end: str | None) -> Column:
        rest = F.substr(output, F.instr(output, start) + len(start))
        return F.substring_index(rest, end, 1) if end else rest

    psm = F.concat(between(p, s), between(m, None), between(s, m))
    spm = F.concat(between(p, m), between(m, None), between(s, p))
    return F.when(form == PSM, psm).when(form == SPM, spm).otherwise(output)


def op11_fill_in_middle(spark, sf_dir):
    cut = fill_in_middle(table(spark, sf_dir, "documents"), seed=1)
    digests = [F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")]
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


QUERIES = {"op11_fill_in_middle": op11_fill_in_middle}

ORACLE = {
    "op11_fill_in_middle": r"""
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u,
         sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
drawn AS (
  SELECT doc_id, text, u, len(u) AS n, ('0x' || h[1:8])::BIGINT % (len(u) + 1) AS a, ('0x' || h[9:16])::BIGINT % (len(u) + 1) AS b,
         CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= 90 THEN 'plain'
              WHEN ('0x' || h[25:32])::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM cut),
parts AS (
  SELECT doc_id, text, n, form, array_to_string(u[1:least(a, b)], '') AS p, array_to_string(u[least(a, b) + 1:greatest(a, b)], '') AS m,
         array_to_string(u[greatest(a, b) + 1:], '') AS s FROM drawn)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
""",
}
