"""JSON trees as paths: a tree is a map from the path of each leaf to what stands there, and trees are compared as such maps.

Reading is a loop with a stack of its own, so no depth of nesting ends a query; a text that is no JSON, or nested deeper than the
parser goes, counts as no tree.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Keys that name a build rather than a content, and ids that a build numbers.
DROP_KEYS = ("id", "spans", "file", "px", "picture", "drawings", "drawing", "frame_drawings", "tiles")
ID_LIKE = re.compile(r"p\d+([a-z]+\d+.*)")
# How far two numbers may be apart, flat and of the larger: by the key they stand under, with a unit beside it, else.
LENGTH = 6350.0  # half a point in EMU
TOLERANCES = {"translateX": (LENGTH, 0.0), "translateY": (LENGTH, 0.0), "scaleX": (1e-9, 1e-3), "scaleY": (1e-9, 1e-3), "shearX": (1e-9, 1e-3), "shearY": (1e-9, 1e-3)}
MEASURED, OTHER = ("magnitude", "unit", "EMU", (LENGTH, 0.0)), (0.05, 1e-3)

LEAF = "map<string,struct<kind:string,said:string,number:double>>"
ARROW = {LEAF: pa.map_(pa.string(), pa.struct([("kind", pa.string()), ("said", pa.string()), ("number", pa.float64())])), "string": pa.string()}
STRING = re.compile(r'"((?:[^"\\]|\\.)*)"(\s*:)?')  # a key has its colon


def read(text: str | None, **hooks):
    """The tree of a JSON text, or None."""
    try:
        return json.loads(text, **hooks)
    except (TypeError, ValueError, RecursionError):
        return None


def leaves(tree) -> Iterator[tuple[str, tuple[str, str | None, float | None]]]:
    """Paths of a tree's leaves (``/key`` and ``[place]``, slashes in keys doubled), with kind, text and number; an empty object or list is a leaf."""
    stack = [("", tree)]
    while stack:
        path, x = stack.pop()
        if isinstance(x, dict) and x:
            stack += [(f"{path}/{k.replace('/', '//')}", v) for k, v in x.items()]
        elif isinstance(x, list) and x:
            stack += [(f"{path}[{k}]", v) for k, v in enumerate(x)]
        elif isinstance(x, bool) or not isinstance(x, (int, float)):
            yield path, (type(x).__name__, None if x is None else str(x), None)
        else:
            yield path, (type(x).__name__, str(x), float(x) if abs(x) < 1e300 else None)


def _each(f: Callable, kind: str, *columns: Column) -> Column:
    """A column of type ``kind``: ``f`` of the columns' values, in Arrow batches."""

    def run(*arrays: pa.Array) -> pa.Array:
        return pa.array([f(*row) for row in zip(*(x.to_pylist() for x in arrays), strict=True)], ARROW[kind])

    return F.arrow_udf(run, kind)(*columns)


def paths(text: Column) -> Column:
    """The leaves of a JSON text by path (``LEAF``); null where it is no JSON."""

    def of(x):
        tree = read(x)
        return None if tree is None and (x or "").strip() != "null" else [(p, dict(zip(("kind", "said", "number"), leaf, strict=True))) for p, leaf in leaves(tree)]

    return _each(of, LEAF, text)


def paths_agree(a: Column, b: Column, dx: float = 0.0, dy: float = 0.0) -> Column:
    """Whether two path maps say the same but for noise of numbers.

    Leaves must stand at the same paths.  Numbers may differ by TOLERANCES of the key they stand under, a measured length by its own;
    other numbers by OTHER, but two whole ones, which are places in texts, not at all.  ``dx, dy`` is how far translations moved.
    """
    number, unit, what, length = MEASURED

    def same(path: Column, x: Column, y: Column) -> Column:
        name = F.regexp_extract(path, r"/([^/\[\]]*)$", 1)  # empty for an item of a list
        measured = (name == number) & F.coalesce(a[F.concat(F.regexp_replace(path, r"/[^/]*$", ""), F.lit(f"/{unit}"))].said == what, F.lit(False))
        moved = F.when(name == "translateX", dx).when(name == "translateY", dy).otherwise(0.0)
        within = lambda flat, share: F.abs(x.number + moved - y.number) <= flat + share * F.greatest(F.abs(x.number), F.abs(y.number))
        rule = F.when(measured, within(*length))
        for key, tolerance in TOLERANCES.items():
            rule = rule.when(name == key, within(*tolerance))
        rule = rule.when((x.kind == "int") & (y.kind == "int"), x.said == y.said).otherwise(within(*OTHER))
        return F.coalesce(F.when(x.number.isNotNull() & y.number.isNotNull(), rule).otherwise((x.kind == y.kind) & x.said.eqNullSafe(y.said)), F.lit(False))

    return F.forall(F.map_values(F.map_zip_with(a, b, same)), lambda s: s)


def same_trees(df: DataFrame, key: str, a: str, b: str, dx: float = 0.0, dy: float = 0.0) -> DataFrame:
    """``key, same`` of pairs of JSON trees; texts that are no JSON are the same only if equal."""
    found = df.select(F.col(key), F.col(a).eqNullSafe(F.col(b)).alias("equal"), paths(F.col(a)).alias("a"), paths(F.col(b)).alias("b"))
    return found.select(key, (F.col("equal") | F.coalesce(paths_agree(F.col("a"), F.col("b"), dx, dy), F.lit(False))).alias("same"))


def strings_replaced(text: str, change: Callable[[str], str], keys: bool) -> str:
    """A JSON text with its strings, and keys if asked, changed; what isn't changed stays as it is written."""

    def one(m: re.Match) -> str:
        if m[2] and not keys:
            return m[0]
        said = json.loads(f'"{m[1]}"') if "\\" in m[1] else m[1]
        new = change(said)
        return m[0] if new == said else json.dumps(new, ensure_ascii=False) + (m[2] or "")

    return STRING.sub(one, text)


def canonical(text: str | None, anchor: str | None, pages: dict[int, str] | None) -> str | None:
    """A JSON text without what only a build says: see ``canonical_json``."""
    if text is None:
        return None

    def unnumbered(said: str) -> str:
        page = re.fullmatch(r"#page=(\d+)", said) if pages is not None else None
        own = ID_LIKE.fullmatch(said)
        return f"#slide={pages.get(int(page[1]))}" if page else own[1] if own else said

    def kept(pairs: list[tuple]) -> dict:
        return {k: v for k, v in [*(p for p in pairs if p[0] not in DROP_KEYS), *((k, anchor) for k, _ in pairs if k == "anchor")]}

    tree = read(strings_replaced(text, unnumbered, keys=False), object_pairs_hook=kept, parse_float=lambda s: round(float(s), 2))
    try:
        return None if tree is None and text.strip() != "null" else json.dumps(tree, ensure_ascii=False, sort_keys=True, separators=(",", ":"))
    except RecursionError:
        return None


def canonical_json(df: DataFrame, key: str, tree: str, anchor: str, pages: str) -> DataFrame:
    """``key, canonical`` of JSON trees, keys in order: keys of builds dropped, anchors replaced, numbers rounded to hundredths, numbered ids and links to pages unnumbered.

    ``pages`` is a map from page numbers to slides.  Null where the text is no JSON.
    """
    made = _each(lambda t, a, p: canonical(t, a, dict(p or ())), "string", F.col(tree), F.col(anchor), F.col(pages).cast("map<int,string>"))
    return df.select(key, made.alias("canonical"))


def renamed_ids(df: DataFrame, key: str, tree: str, mapping: str) -> DataFrame:
    """``key, renamed``: the strings and keys of a JSON text that are an old id, or one with a suffix that begins with no digit, with the new id instead.

    ``mapping``: a map from old to new ids of each row; the longest old id that fits counts.  A null text or map changes nothing.
    """

    def change(text, pairs):
        new = {k: v for k, v in (pairs or ()) if v is not None}
        if text is None or not new:
            return text
        old = re.compile("(" + "|".join(map(re.escape, sorted(new, key=len, reverse=True))) + r")(?!\d)")

        def one(said: str) -> str:
            m = old.match(said)
            return new[m[1]] + said[m.end() :] if m else said

        return strings_replaced(text, one, keys=True)

    return df.select(key, _each(change, "string", F.col(tree), F.col(mapping).cast("map<string,string>")).alias("renamed"))
