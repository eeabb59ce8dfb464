"""Shared pieces: reading tables, batching, vectorised word hashing.

Word hashing works on the bytes of many texts at once.  Each word's 64-bit value is a
polynomial over a fixed table of random 64-bit letters, taken from prefix sums modulo
2**64 and passed through a finaliser, so a word costs a few numpy operations and no
Python call.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strata.plans.lineage import delete, durable, shared_folder, stored, tidy  # noqa: F401

U64 = np.uint64
MULTIPLIER = 0x9E3779B97F4A7C13  # 3 modulo 8, so powers of it differ by few trailing zero bits
SLICE = 1 << 19
GROUP_BYTES, SHARD_BYTES = 8 << 20, 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Exactly the columns ``doc_id`` (long) and ``text`` (null becomes empty)."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def input_bytes(df: DataFrame, text_col: str = "text") -> int:
    """Size of the tables a plan reads, from their statistics; no job runs but where they have none, to add up the texts."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))
    return size if size < 1 << 50 else df.agg(F.sum(F.octet_length(text_col))).first()[0] or 0


def dealt(size: int, groups: int, shards: int) -> tuple[int, int]:
    """How many document groups and hash shards to deal ``size`` input bytes into; ``groups`` and ``shards`` are the numbers at half a gigabyte.

    Both grow as the square root of the input, so the messages between them, one a group and shard, grow with the input and not
    as its square.  Groups grow up to GROUP_BYTES and shards up to SHARD_BYTES, what a task holds; beyond that (32 to 130 GB)
    their numbers follow the input, until a message is down to one value, which is a plain shuffle of the values.
    """
    root = math.sqrt(size / (1 << 29))
    return max(16, round(groups * root), size // GROUP_BYTES), max(8, round(shards * root), size // SHARD_BYTES)


def texts_of(batch, column: str = "text") -> list[bytes]:
    """The UTF-8 bytes of an Arrow string column; null is empty."""
    import pyarrow as pa

    col = batch.column(column)
    if not pa.types.is_binary(col.type):
        col = col.cast(pa.binary())
    return [x or b"" for x in col.to_pylist()]


def pieces(texts: list[bytes], most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive texts of about ``most`` bytes (a longer text stands alone)."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield at, i
            at, size = i, 0
        size += len(t) + 1
    if at < len(texts):
        yield at, len(texts)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply, twice)."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


LETTERS = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, (n - 1).bit_length())
    if size not in _powers:
        inverse = pow(MULTIPLIER, -1, 1 << 64)
        up, down = np.full(size, MULTIPLIER, U64), np.full(size, inverse, U64)
        up[0] = down[0] = 1
        with np.errstate(over="ignore"):
            made = np.cumprod(up, dtype=U64), np.cumprod(down, dtype=U64)
        if size > 1 << 22:
            return made  # rare; not worth keeping
        _powers[size] = made
    return _powers[size]


class Words:
    """The words of several texts: flat hashes, and where each text's words begin.

    ``hashes[first[i]:first[i + 1]]`` are the words of text i in order.
    """

    __slots__ = ("_prefix", "_down", "ends", "first", "hashes", "starts")

    def __init__(self, texts: list[bytes], separators: np.ndarray = SPACES, keep: bool = False):
        joined = b"\n".join(texts) + b"\n"
        buf = np.frombuffer(joined, np.uint8)
        sep = separators[buf]
        edge = np.flatnonzero(np.diff(sep.view(np.int8), prepend=np.int8(1)))
        starts, ends = edge[::2], edge[1::2]
        offsets = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) + 1 for t in texts], out=offsets[1:])
        self.first = np.searchsorted(starts, offsets)
        self.starts, self.ends = starts, ends
        up, down = _power_tables(len(buf))
        prefix = np.zeros(len(buf) + 1, U64)
        with np.errstate(over="ignore"):
            np.cumsum(LETTERS[buf] * up[: len(buf)], out=prefix[1:])
            self.hashes = mix((prefix[ends] - prefix[starts]) * down[starts])
        if keep:
            self._prefix, self._down = prefix, down

    def heads(self, n: int) -> np.ndarray:
        """Hashes of each word's first n bytes, marked apart from whole words."""
        with np.errstate(over="ignore"):
            stop = np.minimum(self.starts + n, self.ends)
            return mix((self._prefix[stop] - self._prefix[self.starts]) * self._down[self.starts] + U64(n))


def rolling(h: np.ndarray, n: int, base: int = 0xD6E8FEB86659FD93) -> np.ndarray:
    """Hashes of all runs of n consecutive values, over the whole flat array."""
    if len(h) < n:
        return np.zeros(0, U64)
    with np.errstate(over="ignore"):
        acc = h[: len(h) - n + 1].copy()
        for k in range(1, n):
            acc *= U64(base)
            acc += h[k : len(h) - n + 1 + k]
        return mix(acc)
