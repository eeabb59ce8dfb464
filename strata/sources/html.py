"""HTML pages as rows of blocks: headings, paragraphs, list items, table cells and other text.

Text inside scripts and styles is dropped, comments too.  A block's text has its white space
collapsed; inline tags don't break it.  Broken markup never fails a page.
"""

from __future__ import annotations

from html.parser import HTMLParser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BREAKS = frozenset("p div article section header footer main aside nav ul ol li table tr td th h1 h2 h3 h4 h5 h6 pre blockquote figure figcaption form dl dt dd hr title body html head".split())
SILENT = frozenset(("script", "style", "template"))
BLOCKS = "page_id long, pos int, kind string, level int, text string"


class BlockParser(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.blocks: list[tuple[str, int, str]] = []
        self.text: list[str] = []
        self.kind, self.level, self.silent, self.lists = "text", 0, 0, 0

    def flush(self) -> None:
        text = " ".join("".join(self.text).split())
        if text:
            self.blocks.append((self.kind, self.level, text))
        self.text = []

    def handle_starttag(self, tag, attrs):
        if tag in SILENT:
            self.silent += 1
        elif tag == "br":
            self.text.append(" ")
        elif tag in BREAKS:
            self.flush()
            if tag in ("ul", "ol"):
                self.lists += 1
            if len(tag) == 2 and tag[0] == "h" and tag[1].isdigit():
                self.kind, self.level = "heading", int(tag[1])
            elif tag == "li":
                self.kind, self.level = "item", max(1, self.lists)
            elif tag in ("td", "th"):
                self.kind, self.level = "cell", 0
            elif tag == "title":
                self.kind, self.level = "title", 0
            elif tag in ("p", "pre", "blockquote", "dd", "dt"):
                self.kind, self.level = "paragraph", 0
            else:
                self.kind, self.level = "text", 0

    def handle_endtag(self, tag):
        if tag in SILENT:
            self.silent = max(0, self.silent - 1)
        elif tag in BREAKS:
            self.flush()
            if tag in ("ul", "ol"):
                self.lists = max(0, self.lists - 1)
            self.kind, self.level = "text", 0

    def handle_data(self, data):
        if not self.silent:
            self.text.append(data)


def parse(page: str | None) -> list[tuple[str, int, str]]:
    parser = BlockParser()
    parser.feed(page or "")
    parser.close()
    parser.flush()
    return parser.blocks


def blocks(df: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """``page_id, pos, kind, level, text``; a null or empty page has no blocks."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = [(i, pos, *b) for i, h in zip(pdf["page_id"], pdf["html"], strict=True) for pos, b in enumerate(parse(h))]
            yield pd.DataFrame(rows, columns=["page_id", "pos", "kind", "level", "text"])

    return df.select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).alias("html")).mapInPandas(run, BLOCKS)


def stray_words(df: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """Words of the page's visible text, by tags removed with patterns alone, that its blocks lack: ``page_id, word, n``."""
    pages = df.select(F.col(id_col).cast("long").alias("page_id"), F.col(html_col).alias("html"))
    bare = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style|template)\b.*?</\1\s*>|<!--.*?-->|<!doctype[^>]*>", " "), r"(?s)</?(b|i|em|strong|span|a)\b[^>]*>", "")
    bare = F.regexp_replace(bare, r"(?s)<[^>]*>", " ")
    for entity, c in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&nbsp;", " "), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(entity), F.lit(c))
    words = lambda d, c: d.select("page_id", F.explode(F.split(c, r"\s+")).alias("word")).where("word <> ''").groupBy("page_id", "word")
    here = words(pages, bare).agg(F.count("*").alias("n"))
    there = words(blocks(df, id_col, html_col), F.col("text")).agg(F.count("*").alias("m"))
    return here.join(there, ["page_id", "word"], "left").select("page_id", "word", (F.col("n") - F.coalesce("m", F.lit(0))).alias("n")).where("n > 0")


def escape(text):
    for c, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(c), F.lit(entity))
    return text


def write(found: DataFrame) -> DataFrame:
    """Pages from blocks, one block a line, so that text diffs are block diffs: ``page_id, html``."""
    text = escape(F.col("text"))
    tag = lambda name: F.concat(F.lit(f"<{name}>"), text, F.lit(f"</{name}>"))
    level = F.col("level").cast("string")
    line = F.when(F.col("kind") == "heading", F.concat(F.lit("<h"), level, F.lit(">"), text, F.lit("</h"), level, F.lit(">"))).when(F.col("kind") == "title", tag("title"))
    line = line.when(F.col("kind") == "item", F.concat(F.repeat(F.lit("<ul>"), F.col("level")), tag("li"), F.repeat(F.lit("</ul>"), F.col("level")))).when(F.col("kind") == "cell", F.concat(F.lit("<table><tr>"), tag("td"), F.lit("</tr></table>")))
    line = line.when(F.col("kind") == "paragraph", tag("p")).otherwise(tag("div"))
    return found.withColumn("line", line).groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x.line), "\n").alias("html"))
