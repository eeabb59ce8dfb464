"""Normal forms, tokens, hashes and HTML blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.functions import text as tx
from strata.operators import resolve
from strata.sources import html
from strata.sources.tables import table


def c1_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", tx.tokens(F.col("text")).alias("t"))
    return docs.select("doc_id", F.size("t").cast("long").alias("n_tokens"), (F.array_join("t", "") == F.col("text")).alias("lossless"))


C1 = """
SELECT doc_id, len(t) AS n_tokens, array_to_string(t, '') = text AS lossless FROM (SELECT doc_id, text, regexp_extract_all(text, '[\\p{L}\\p{N}_]+|\\s+|[^\\p{L}\\p{N}_\\s]') AS t FROM documents)
"""


def c2_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's first line as a title: its normal form, a unique slug, and lengths."""
    line = F.split("text", "\n")[0]
    docs = table(spark, sf_dir, "documents").select("doc_id", tx.norm_title(line).alias("title"), tx.slug(line).alias("stem"), F.size(tx.words(F.col("text"))).cast("long").alias("n_words"), tx.utf16_length(F.col("text")).alias("utf16"))
    return resolve.numbered(docs, ["stem"], ["doc_id"], "n").select("doc_id", "title", F.when(F.col("n") == 1, F.col("stem")).otherwise(F.concat_ws("-", "stem", F.col("n").cast("string"))).alias("slug"), "n_words", "utf16")


C2 = """
WITH d AS (SELECT doc_id, text, split_part(text, chr(10), 1) AS line FROM documents),
t AS (SELECT doc_id, trim(regexp_replace(regexp_replace(lower(line), '[^\\p{L}\\p{N}_\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS title,
  coalesce(nullif(regexp_replace(substr(regexp_replace(regexp_replace(lower(line), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 40), '-+$', ''), ''), 'item') AS stem,
  len(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS n_words, length(text) + length(regexp_replace(text, '[^\\x{10000}-\\x{10FFFF}]', '', 'g')) AS utf16 FROM d),
n AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY doc_id) AS n FROM t)
SELECT doc_id, title, CASE WHEN n = 1 THEN stem ELSE stem || '-' || n END AS slug, n_words, utf16 FROM n
"""


def n1_field_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "part")
    place = tx.half_point(F.col("p_size") * 0.7).cast("decimal(12,1)")
    return parts.select("p_partkey", tx.field_hash(F.col("p_name"), F.col("p_brand")).alias("text_hash"), tx.field_hash(F.col("p_type"), place).alias("place_hash"))


N1 = """
SELECT p_partkey, substr(sha1(p_name || chr(31) || p_brand), 1, 12) AS text_hash, substr(sha1(p_type || chr(31) || (round_even(p_size * 0.7::DOUBLE * 2, 0) / 2)::DECIMAL(12,1)::VARCHAR), 1, 12) AS place_hash FROM part
"""


def n2_normal_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.sha2(tx.norm_text(tx.collapse_holes(F.col("text"))), 256).alias("text_sha256"))


N2 = """
SELECT doc_id, sha256(translate(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(text, '\\x{A0}+', chr(160), 'g'), '(\\p{L})-\\n(\\p{L})', '\\1\\2', 'g'), 'ﬀ', 'ff'), 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'ﬃ', 'ffi'), 'ﬄ', 'ffl'),
  '‐‑‒–—−‘’‚“”„' || chr(160) || chr(8239) || chr(8201), '------''''''\"\"\"   ')) AS text_sha256 FROM documents
"""


def h1_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = html.blocks(table(spark, sf_dir, "pages"), "page_id", "html")
    return blocks.select("page_id", "pos", "kind", "level", F.sha2("text", 256).alias("text_sha256"))


def h2_stray_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of a page that no block carries."""
    return html.stray_words(table(spark, sf_dir, "pages"), "page_id", "html")


def h3_tag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tag = lambda name: F.size(F.regexp_extract_all("html", F.lit(f"(?i)<{name}[ >]"), F.lit(0))).cast("long").alias(f"n_{name}")
    return table(spark, sf_dir, "pages").select("page_id", *(tag(x) for x in ("p", "li", "h1", "table", "a")))


H3 = "SELECT page_id, " + ", ".join(f"len(regexp_extract_all(html, '(?i)<{x}[ >]')) AS n_{x}" for x in ("p", "li", "h1", "table", "a")) + " FROM pages"

QUERIES = {f.__name__: f for f in (c1_tokens, c2_titles, n1_field_hashes, n2_normal_text, h1_html_blocks, h2_stray_words, h3_tag_counts)}
ORACLES = {"c1_tokens": C1, "c2_titles": C2, "n1_field_hashes": N1, "n2_normal_text": N2, "h3_tag_counts": H3}
