"""Elements of a page: their plain words, canonical form, scripts, writability and what a live version already shows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# A formula's place in plain words, and what a frozen run of each kind of chip must carry to be made again (any one set).
HOLE = "□"
MADE_FROM = {"image": (("uri",), ("src", "present")), "person": (("value",),), "date": (("value",),)}


def run_text(runs: Column) -> Column:
    """The words of an array of runs (text, hole); a hole is one mark."""
    return F.array_join(F.transform(runs, lambda r: F.when(F.coalesce(r.hole, F.lit(False)), F.lit(HOLE)).otherwise(F.coalesce(r.text, F.lit("")))), "")


def plain_text(kind: Column, paragraphs: Column, cells: Column, nodes: Column, number: Column) -> Column:
    """The words of an element by its kind.

    text: ``paragraphs`` (arrays of runs), a line each; table: ``cells`` (rows of arrays of runs), tabs between cells; diagram:
    ``nodes`` (arrays of paragraphs), a line each; image: its number's words.
    """
    row = lambda sep: lambda r: F.array_join(F.transform(r, lambda c: F.trim(run_text(c))), sep)
    words = F.when(kind == "text", F.array_join(F.transform(paragraphs, run_text), "\n")).when(kind == "table", F.array_join(F.transform(cells, row("\t")), "\n"))
    words = words.when(kind == "diagram", F.array_join(F.transform(nodes, row(" ")), "\n")).when(kind == "image", number)
    return F.coalesce(words, F.lit(""))


def script_of(size: Column, baseline: Column, line_size: Column, line_baseline: Column, text: Column) -> Column:
    """``super``, ``sub`` or null: a smaller span raised or lowered from its line's baseline (y grows downwards).

    A superscript is under 0.85 of the line's size and raised over 0.12 of it, or under 0.95 and raised at least 0.3; one that
    begins with an underscore is code.  A subscript is under 0.85 and lowered over 0.10.
    """
    shift = baseline - line_baseline
    small = size < 0.85 * line_size
    raised = (small & (shift < -0.12 * line_size)) | (~small & (size < 0.95 * line_size) & (shift <= -0.3 * line_size))
    return F.when(raised, F.when(~F.ltrim(text).startswith("_"), "super")).when(small & (shift > 0.10 * line_size), "sub")


def writable(run: Column) -> Column:
    """Whether a request can make this run (frozen, chip, value, uri, src, missing): one that isn't frozen, or a chip with what MADE_FROM asks for."""
    has = {c: F.coalesce(F.length(run[c]) > 0, F.lit(False)) for c in ("uri", "src", "value")} | {"present": ~F.coalesce(run.missing, F.lit(False))}
    both, either = lambda p, q: p & q, lambda p, q: p | q
    ways = [(F.coalesce(run.chip, F.lit("")) == chip) & reduce(both, (has[c] for c in way)) for chip, given in MADE_FROM.items() for way in given]
    return reduce(either, ways, ~F.coalesce(run.frozen, F.lit(False)))


def editable_block(kind: Column, runs: Column) -> Column:
    """Whether all of a block's runs can be made again; a table of contents can't."""
    return (F.coalesce(kind, F.lit("")) != "toc") & F.coalesce(F.forall(runs, writable), F.lit(True))


# How far a place, and the four numbers of scale and shear, may be off and still be the same.
NEAR, SCALE_NEAR = 2.0, 1e-3


def converged_fields(
    text: Column, live: Column, want: tuple[Column, Column], place: tuple[Column, Column], edits: Column, near: float = NEAR,
    kind: Column | None = None, alone: Column | None = None, scales: tuple[Column, Column] | None = None,
) -> Column:
    """Which of a row's ``edits`` (text, geometry) the live version already shows as the source wants it: the same words, or a place at most ``near`` off on both axes.

    ``kind``: texts and tables have words to compare (of a table cell by cell, tabs and lines between them), other kinds none; all are
    texts without it.  ``alone``: whether the source left the unit's other members as they were; if not nothing has converged.
    ``scales``: arrays of scale and shear as last written and live, which must agree for a place to count.
    """
    said = lambda t: F.replace(F.coalesce(t, F.lit("")), F.lit(HOLE), F.lit(" "))
    trimmed = lambda t: F.trim(F.regexp_replace(t, r"\s+", " "))
    cells = lambda t: F.transform(F.split(F.coalesce(t, F.lit("")), "\n"), lambda row: F.transform(F.split(row, "\t"), trimmed))
    kind = F.lit("text") if kind is None else kind
    same = F.when(kind == "text", trimmed(said(text)) == trimmed(said(live))).when(kind == "table", cells(text) == cells(live)).otherwise(False)
    off = F.greatest(F.abs(want[0] - place[0]), F.abs(want[1] - place[1]))
    turned = F.lit(True) if scales is None else F.coalesce(F.forall(F.zip_with(*scales, lambda x, y: F.abs(x - y) <= SCALE_NEAR), lambda s: s), F.lit(False))
    told = [F.when(F.array_contains(edits, "text") & same, "text"), F.when(F.array_contains(edits, "geometry") & (off <= near) & turned, "geometry")]
    found = F.array_compact(F.array(*told))
    return found if alone is None else F.when(F.coalesce(alone, F.lit(False)), found).otherwise(F.array().cast("array<string>"))


def edit_plan(edits: DataFrame, by: list[str], start: str, stop: str, order: str) -> DataFrame:
    """Numbers edits back to front, so that the places of those still to come stay valid: later starts first; at one start a deletion before an insertion, and of insertions the last first."""
    w = Window.partitionBy(*by).orderBy(F.desc(start), F.desc(F.col(stop) > F.col(start)), F.desc(order))
    return edits.withColumn("step", F.row_number().over(w).cast("long"))


def compared_texts(df: DataFrame, by: list[str], ignored: list[str], role: str = "role", text: str = "text", x: str = "x", y: str = "y", key: str = "key") -> DataFrame:
    """Texts that a comparison looks at, numbered as they are read: titles first, then by rows of four points and from the left.

    Left out are ignored roles, texts without words, and counters such as ``3 / 9`` that are no title.
    """
    counter = F.col(text).rlike(r"^\s*\d+\s*(/\s*\d+)?\s*$")
    some = F.trim(F.replace(F.coalesce(F.col(text), F.lit("")), F.lit(HOLE), F.lit(""))) != ""
    kept = df.where(~F.col(role).isin(*ignored) & some & ((F.col(role) == "title") | ~counter))
    w = Window.partitionBy(*by).orderBy((F.col(role) != "title"), F.round(F.coalesce(y, F.lit(0.0)) / 4), F.coalesce(x, F.lit(0.0)), key)
    return kept.withColumn("order", (F.row_number().over(w) - 1).cast("long"))
