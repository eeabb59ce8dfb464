"""The engine's verbs, each from DataFrames to DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame

from strata.operators import diff, layout, report, resolve, stats
from strata.operators import merge as merging
from strata.sources import html


def classify(chars: DataFrame, page: str = "page", em: float = 10.0) -> dict[str, DataFrame]:
    """Characters of pages to spans, lines, paragraphs and each page's body size."""
    spans = layout.spans(chars, [page])
    lines = layout.lines(spans, [page])
    return {"spans": spans, "lines": lines, "paragraphs": layout.paragraphs(lines, page, em), "body": layout.body_size(spans, [page])}


def merge(base: DataFrame, ours: DataFrame, theirs: DataFrame, key: str, fields: list[str], take: DataFrame | None = None, kind: str = "row") -> dict[str, DataFrame]:
    """Three versions to the merged rows, decisions, conflicts (settled for ours where ``take`` names them) and a summary."""
    decided = merging.decisions(merging.versions(base, ours, theirs, key, fields), fields)
    found = merging.conflicts(decided, key, fields, kind)
    out = {"merged": merging.merged(decided, key, fields), "decisions": decided, "summary": report.summary(decided, found)}
    if take is None:
        return out | {"conflicts": found}
    settled, unmatched = merging.settle(found, take)
    return out | {"conflicts": settled, "unmatched": unmatched}


def compare(current: DataFrame, target: DataFrame, key: str, numbers: dict[str, float], texts: list[str]) -> dict[str, DataFrame]:
    """Residuals between two versions and how many are open."""
    found = diff.residuals(current, target, key, numbers, texts)
    return {"residuals": found, "open": diff.summary(found)}


def pair(scored: DataFrame, left: str, right: str, score: str, least: float) -> DataFrame:
    """One-to-one pairs, best first."""
    return resolve.greedy_match(scored, left, right, score, least)


def label_survey(items: DataFrame, label: str) -> dict[str, DataFrame]:
    """Labels used more than once, and the usual number of uses."""
    from pyspark.sql import functions as F

    uses = items.groupBy(label).agg(F.count("*").alias("n"))
    return {"repeated": uses.where(F.col(label).isNotNull() & (F.col("n") > 1)), "unlabelled": items.where(F.col(label).isNull()), "uses": stats.majority(uses.where(F.col(label).isNotNull()).select(F.col("n").alias("uses")).withColumn("all", F.lit(1)), ["all"], "uses")}


def html_blocks(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    return html.blocks(pages, id_col, html_col)
