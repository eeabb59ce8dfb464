"""Text as columns: normal forms, tokens, lengths and junk."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"
TOKEN = r"[\p{L}\p{N}_]+|\s+|[^\p{L}\p{N}_\s]"
JUNK = r"[\p{Co}\x{FFFD}\x{0000}-\x{0008}\x{000B}\x{000C}\x{000E}-\x{001F}\x{007F}]"


def norm_title(text: Column) -> Column:
    """Lower-cased words, one space apart, without punctuation."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_\s]", " "), r"\s+", " "))


def norm_text(text: Column) -> Column:
    """Ligatures spelled out; dashes, quotes and spaces made plain; words broken by a hyphen and a newline joined."""
    out = F.regexp_replace(text, r"(\p{L})-\n(\p{L})", "$1$2")
    for ligature, plain in (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl")):
        out = F.replace(out, F.lit(ligature), F.lit(plain))
    return F.translate(out, "‐‑‒–—−‘’‚“”„   ", "------'''\"\"\"   ")


def tokens(text: Column) -> Column:
    """Words, runs of white space and single other characters; joined, they are the text."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def slug(text: Column, length: int = 40) -> Column:
    """ASCII letters and digits with single hyphens between; ``item`` where nothing is left."""
    s = F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-")
    s = F.regexp_replace(F.substring(F.regexp_replace(s, "^-+|-+$", ""), 1, length), "-+$", "")
    return F.when(s == "", F.lit("item")).otherwise(s)


def utf16_length(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("long")


def collapse_holes(text: Column) -> Column:
    """Runs of no-break spaces become one."""
    return F.regexp_replace(text, " +", " ")


def has_junk(text: Column) -> Column:
    return F.coalesce(text.rlike(JUNK), F.lit(False))


def half_point(x: Column) -> Column:
    """The half-point grid on which places and sizes are compared, rounded half to even."""
    return F.bround(x * 2, 0) / 2


def field_hash(*fields: Column, length: int = 12) -> Column:
    """Hash of one canonical string of fields; null and empty stay apart."""
    return F.substring(F.sha1(F.concat_ws("\x1f", *(F.coalesce(f.cast("string"), F.lit("\x00")) for f in fields))), 1, length)


def prose_share(text: Column) -> Column:
    """Share of words that are two or more letters and nothing else."""
    every = F.regexp_count(text, F.lit(r"\S+"))
    return F.when(every > 0, F.regexp_count(text, F.lit(r"(?<!\S)\p{L}{2,}(?!\S)")) / every).otherwise(0.0)


def first_words(text: Column, n: int) -> Column:
    return F.array_join(F.slice(F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " "), 1, n), " ")


def script_counts(text: Column) -> Column:
    """Letters by script, as a struct."""
    return F.struct(*(F.regexp_count(text, F.lit(rf"\p{{Is{s}}}")).cast("long").alias(s.lower()) for s in ("Latin", "Greek", "Cyrillic", "Han")))


def composed(text: Column) -> Column:
    """Canonical composition, so that a letter and its accent are one character; in Arrow batches."""
    import unicodedata

    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: t if t is None else unicodedata.normalize("NFC", t))

    return F.pandas_udf(run, "string")(text)


def bullet(text: Column) -> Column:
    """The mark that a list item begins with, as struct kind (glyph, number, letter, none), label and rest."""
    glyph = r"^\s*([•◦▪‣∙*–-])\s+(.*)$"
    number = r"^\s*\(?(\d{1,3})[.)]\s+(.*)$"
    letter = r"^\s*\(?([a-z])[.)]\s+(.*)$"
    out = F.lit(None)
    for kind, pattern in (("letter", letter), ("number", number), ("glyph", glyph)):
        out = F.when(text.rlike(pattern), F.struct(F.lit(kind).alias("kind"), F.regexp_extract(text, pattern, 1).alias("label"), F.regexp_extract(text, pattern, 2).alias("rest"))).otherwise(out)
    return F.coalesce(out, F.struct(F.lit("none").alias("kind"), F.lit("").alias("label"), text.alias("rest")))
