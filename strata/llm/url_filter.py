"""URL filter: prefix rules first, then logistic regression on hashed character n-grams of host and path.

The model is trained from a small labelled table that this module makes by rule.  Scores are
sums over n-grams, so host and path score apart and a host's part is kept while it repeats.
Rules and URL parts use DataFrame functions only.

A null URL or one without ``://`` has an empty host and path, fits no rule and gets the
model's verdict on empty input.  Repeated rows give repeated results.
"""

from __future__ import annotations

import functools
import math
import random
import string
import zlib

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (rule, verdict): a host and the path's beginning.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
BUCKETS, SHORTEST, LONGEST = 1 << 14, 3, 5


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def longest_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict; null where none fits."""
    rule, verdict = None, None
    for text, what in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        h, _, p = text.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith("/" + p)
        rule = F.when(fits, F.lit(text)) if rule is None else rule.when(fits, F.lit(text))
        verdict = F.when(fits, F.lit(what)) if verdict is None else verdict.when(fits, F.lit(what))
    none = F.lit(None).cast("string")
    return (none, none) if rule is None else (rule, verdict)


def training_table(seed: int = 3) -> list[tuple[str, str, int]]:
    """(host, path, 1 if unwanted): 600 rows from word lists."""
    r = random.Random(seed)
    bad = ["spam", "casino", "poker", "pills", "loans", "xxx", "adult", "free-money", "clickfarm", "spam-farm", "warez", "winbig", "cheap-meds", "bet", "phish"]
    good = ["news", "library", "wiki", "school", "museum", "docs", "research", "journal", "city", "garden", "recipes", "weather", "forum", "blog", "history"]
    paths_bad = ["/win", "/bonus", "/free", "/buy-now", "/click", "/offer", "/xxx", "/en/1", "/de/5", ""]
    paths_good = ["/article", "/en/12", "/de/7", "/about", "/2020/05/story.html", "/wiki/page", "/fr/99", "/", ""]
    syllables = ["tion", "er", "th", "an", "lo", "mi", "re", "st", "ed", "ing", "ha", "wh", "or", "sh", "ble", "nt", "in", "on"]
    name = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 3)))
    rows = []
    for k in range(600):
        y = int(k % 3 == 0)
        word = r.choice(bad if y else good)
        host = r.choice([f"{word}.{name()}", f"{word}-{name()}", f"{name()}-{word}", word, f"www.{word}", f"m.{word}-{r.choice(bad)}"] if y else [f"{word}.{name()}", name(), name(), f"www.{name()}", f"m.{name()}", word, f"blog.{name()}"])
        top = r.choice(["com", "net", "org", "example.com", "example.net", "example.org"])
        rows.append((f"{host}.{top}", r.choice(paths_bad if y else paths_good) + r.choice(["", "/", str(r.randint(1, 9999))]), y))
    return rows


def grams(part: str, text: str) -> list[int]:
    raw = f"^{text}$".encode()
    mark = part.encode()
    return [zlib.crc32(mark + raw[i : i + n]) % BUCKETS for n in range(SHORTEST, LONGEST + 1) for i in range(len(raw) - n + 1)]


class UrlModel:
    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias

    def part(self, part: str, text: str) -> float:
        """A part's mean weight, so that long paths don't outweigh hosts."""
        g = grams(part, text)
        return float(self.weights[g].sum()) / math.sqrt(len(g)) if g else 0.0

    def probability(self, host: str, path: str) -> float:
        z = self.bias + self.part("h", host) + self.part("p", path)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


@functools.lru_cache(maxsize=1)
def default_model(epochs: int = 60, rate: float = 0.5, decay: float = 1e-4) -> UrlModel:
    rows = training_table()
    x = np.zeros((len(rows), BUCKETS), np.float32)
    y = np.array([r[2] for r in rows], float)
    for k, (host, path, _) in enumerate(rows):
        for part, text in (("h", host), ("p", path)):
            g = grams(part, text)
            np.add.at(x[k], g, 1 / math.sqrt(len(g)) if g else 0)
    w, b, seen, seen_b = np.zeros(BUCKETS), -0.5, np.full(BUCKETS, 1e-8), 1e-8
    for _ in range(epochs):
        e = 1 / (1 + np.exp(-(x @ w + b))) - y
        g = x.T @ e / len(y) + decay * w
        seen += g**2
        seen_b += e.mean() ** 2
        w -= rate * g / np.sqrt(seen)
        b -= rate * 0.1 * e.mean() / math.sqrt(seen_b)
    return UrlModel(w, float(b))


def judge_urls(df: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, model: UrlModel | None = None, threshold: float = 0.5) -> DataFrame:
    """``page_id, host, path, rule, verdict, probability``: the longest rule's verdict, or the model's where none fits."""
    model = model or default_model()
    host, path = url_parts(F.col("url"))
    parts = df.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url")).select("page_id", host.alias("host"), path.alias("path"))
    kind = dict(parts.dtypes)["page_id"]

    def run(it):
        import pyarrow as pa

        hosts: dict[str, float] = {}
        for batch in it:
            out = []
            for h, p in zip(batch.column("host").to_pylist(), batch.column("path").to_pylist(), strict=True):
                s = hosts.get(h)
                if s is None:
                    if len(hosts) > 100_000:
                        hosts.clear()
                    s = hosts[h] = model.part("h", h)
                z = model.bias + s + model.part("p", p)
                out.append(1 / (1 + math.exp(-max(-30.0, min(30.0, z)))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.float64())], ["page_id", "host", "path", "probability"])

    scored = parts.mapInArrow(run, f"page_id {kind}, host string, path string, probability double")
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    return scored.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("probability") >= threshold, "block").otherwise("allow")).alias("verdict"), "probability")
