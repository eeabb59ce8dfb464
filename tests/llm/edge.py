"""Awkward documents that every operator must take."""

LONG = "lorem ipsum dolor +1 (234) 555-7890 " * 6000
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog and runs away from the big bad wolf in the dark old forest tonight", "en", "a"),
    (2, None, "en", "a"),
    (3, "", None, None),
    (4, " \t\n ", "de", "b"),
    (5, "one", "fr", "a"),
    (6, "the quick brown fox jumps over the lazy dog and runs away from the big bad wolf in the dark old forest tonight", "en", "c"),
    (6, "the quick brown fox jumps over the lazy dog and runs away from the big bad wolf in the dark old forest tonight", "en", "c"),
    (7, LONG, "en", "a"),
    (8, "a" * 70_000, "en", "a"),
    (9, "Ünïcödé ▁ \U0001f600 日本語 a@b.example 1.2.3.4 4111 1111 1111 1111", "es", "a"),
    (None, "no id here at all", "en", "a"),
]
# columns that carry the operators' own names
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n int, base string, spans string, leaks string, node long, component_id long, score double, g int, shard int, digest binary"


def awkward(spark, rows=ROWS):
    return spark.createDataFrame([(i, t, lang, src, None if t is None else len(t), 7, "x", "y", "z", 1, 2, 0.5, 3, 4, b"d") for i, t, lang, src in rows], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
