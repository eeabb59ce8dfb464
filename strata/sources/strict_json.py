"""JSON columns against strict schemas: missing, unknown and mistyped keys are told with their paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_PATTERNS = {"integer": r"^-?\d+$", "number": r"^-?\d+(\.\d+)?([eE][+-]?\d+)?$", "string": r'^".*"$', "boolean": "^(true|false)$", "colour": r'^"#[0-9a-f]{6}"$', "array": r"^\[", "object": r"^\{"}


def _checks(raw: Column, schema: dict, where: str) -> list[Column]:
    """An array of problems for each key, and one of unknown keys, of an object given as text."""
    problem = lambda path, what: F.struct(F.lit(path).alias("path"), F.lit(what).alias("problem"))
    parts = F.from_json(raw, "map<string,variant>")
    keys = F.map_keys(parts)
    out = []
    for key, kind in schema.items():
        optional = key.endswith("?")
        name = key.rstrip("?")
        value = F.to_json(F.try_element_at(parts, F.lit(name)))
        path = f"{where}.{name}"
        missing = F.lit(None) if optional else problem(path, "missing")
        pattern = _PATTERNS["object" if isinstance(kind, dict) else kind]
        out.append(F.array(F.when(~F.array_contains(keys, name), missing).when(~value.rlike(pattern), problem(path, "type"))))
        if isinstance(kind, dict):
            out += [F.when(value.rlike(pattern), c) for c in _checks(value, kind, path)]
    known = F.array(*(F.lit(k.rstrip("?")) for k in schema))
    out.append(F.transform(F.array_except(keys, known), lambda k: F.struct(F.concat(F.lit(f"{where}."), k).alias("path"), F.lit("unknown").alias("problem"))))
    return out


def violations(df: DataFrame, key: str, column: str, schema: dict) -> DataFrame:
    """``key, path, problem`` of every departure.

    ``schema`` maps keys to integer, number, string, boolean, colour, array or another schema; a key that ends in ``?`` may be
    absent.  Text that is no JSON object is malformed; null has nothing to check.
    """
    raw = F.col(column)
    broken = F.array(F.struct(F.lit("$").alias("path"), F.lit("malformed").alias("problem")))
    good = F.coalesce(F.substring(F.to_json(F.try_parse_json(raw)), 1, 1) == "{", F.lit(False))
    found = F.when(raw.isNull(), F.array().cast("array<struct<path:string,problem:string>>")).when(~good, broken).otherwise(F.flatten(F.array(*(F.coalesce(c, F.array().cast("array<struct<path:string,problem:string>>")) for c in _checks(raw, schema, "$")))))
    return df.select(key, F.explode(F.array_compact(found)).alias("v")).select(key, "v.path", "v.problem")


def key_paths(df: DataFrame, key: str, column: str, known: tuple[str, ...] = ()) -> DataFrame:
    """``key, path`` of every key in JSON text that is not among the known paths; list items are ``[]``.  Text that is no JSON has none."""
    kind = dict(df.dtypes)[key]

    def run(batches):
        import json

        import pandas as pd

        def walk(value, at, out):
            if isinstance(value, dict):
                for k, v in value.items():
                    out.add(f"{at}.{k}")
                    walk(v, f"{at}.{k}", out)
            elif isinstance(value, list):
                for v in value:
                    walk(v, f"{at}[]", out)

        for pdf in batches:
            rows = []
            for k, text in zip(pdf["k"], pdf["j"], strict=True):
                found: set[str] = set()
                try:
                    walk(json.loads(text or "null"), "$", found)
                except (ValueError, RecursionError):
                    found = set()
                rows += [(k, p) for p in sorted(found.difference(known))]
            yield pd.DataFrame(rows, columns=[key, "path"])

    return df.select(F.col(key).alias("k"), F.col(column).alias("j")).mapInPandas(run, f"{key} {kind}, path string")
