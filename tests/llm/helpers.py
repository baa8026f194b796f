"""Small tables with everything that may go wrong in a column."""

import itertools

from pyspark.sql import functions as F

#: Names that operators use inside.
CLASHES = (
    "size row key target level bucket digest words at len h window set_key hub i j kind gaps hits start end template purity host path "
    "copy_digest first_page payload list vec gone own_id own_rows hit_id hit_digest hit_spans mix_id mix_size mix_repeats rep a b n all first lines body"
).split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

WORDS = [a + b for a, b in itertools.product("ba ke lo mi nu ra se to vi zu".split(), "da fe go hi ju".split())]


def prose(seed: int, n: int) -> str:
    """n words, different for each seed."""
    state, out = seed * 7919 + 17, []
    for _ in range(n):
        state = (state * 1103515245 + 12345) % 2**31
        out.append(WORDS[(state >> 8) % len(WORDS)])
    return " ".join(out)


def odd_rows():
    """(doc_id, text, lang, source, n_chars): nulls in any column, empty, blank, one-word, very long and repeated texts."""
    long = prose(1, 20_000)
    rows = [
        (1, None, "en", "a", None),
        (2, "", None, "b", 0),
        (3, " \t\n ", "en", None, 4),
        (4, "Word", "en", "a", 4),
        (5, long, "en", "a", len(long)),
        (6, prose(2, 60), "fr", "b", 1),
        (6, prose(2, 60), "fr", "b", 1),
        (7, prose(2, 60), "fr", None, 1),
        (None, prose(3, 40), None, "c", 1),
        (8, "12 !? 34\n\n  é 😀  x  ", "en", "c", 1),
    ]
    return rows + [(100 + i, prose(10 + i, 30 + i), "en", "abc"[i % 3], i) for i in range(12)]


def documents(spark, rows=None, clashes=True):
    df = spark.createDataFrame(odd_rows() if rows is None else rows, SCHEMA)
    return df.withColumns({c: F.lit("clash") for c in CLASHES}) if clashes else df


def empty(spark):
    return documents(spark, [])
