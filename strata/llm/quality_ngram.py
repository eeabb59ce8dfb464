"""Quality by perplexity under an interpolated modified Kneser-Ney trigram model of trusted text.

Counts, continuation counts and discounts are exact.  The model stays in shards of the hash space of
pairs of words, as counts: a triple's, and a pair's or word's with what its followers come to, so
discounts, totals and weights follow from an entry where it is looked up.  Entries lie in a table
in buckets of their shards, which no wave has to shuffle again, sorted and packed.  Documents are
dealt into groups, and a group sends each shard the distinct keys that its texts look up there;
the shard answers with those it has.  So what a group or shard holds does not grow with the corpus,
and of the model only a bitmap of its keys, of ``BITS`` bits whatever its size, is made in the
shards' ranges and broadcast; it only keeps keys from being asked for in vain.  All documents are
scored, in ``WAVES`` one after the other, as the keys asked for take several times the room of the texts.

The model is fitted on all trusted (labelled) rows but those set aside.  One trusted document in five (by a checksum of its id) is never trained on.  A language's
threshold is the ``QUANTILE`` of the perplexities of these (all languages' where it has none;
without any, all is kept).  Quantiles use every such document; their ranks are off by one in ten
thousand of these at most.  Scores cover whole texts.

Tokens are words as written, then an end.  Null texts count as empty, a null language is a
language of its own, repeated rows give repeated results.
"""

from __future__ import annotations

import functools
import uuid
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE, U64, Words, dealt, delete, durable, input_bytes, mix, pieces, shared_folder, texts_of, tidy
from .substring_dedup import _by_shard

QUANTILE, WAVES, BITS, RANGES = 0.98, 12, 1 << 26, 64
BEGIN, END = U64(0x1B873593A5A5A5A5), U64(0x6C62272E07BB0142)
SLICES = 8  # of the shards, trained one after the other
WORD, PAIR, TRIPLE = 1, 2, 3
FIELDS = 5  # of a pair or word: its own count, and as a context its total and how many followers were seen once, twice, more often


def key_of(kind: int, *parts: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        acc = U64(kind) * U64(0x9E3779B97F4A7C15)
        for p in parts:
            acc = mix(acc + p.astype(U64) * U64(0xC2B2AE3D27D4EB4F))
        return acc


def sequences(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all tokens: the one two before, the one before, the token; and where each text begins."""
    w = Words(texts)
    flat = np.insert(w.hashes, w.first[1:], END)
    first = w.first + np.arange(len(w.first))
    one, two = np.empty_like(flat), np.empty_like(flat)
    one[1:], two[2:] = flat[:-1], flat[:-2]
    one[first[:-1]] = BEGIN
    two[first[:-1]] = BEGIN
    second = first[:-1] + 1
    two[second[second < first[1:]]] = BEGIN
    return two, one, flat, first


def pack(rows: np.ndarray) -> bytes:
    """Rows of fixed width, by their bytes' places and compressed: of sorted keys and small numbers the upper bytes take next to no room."""
    import pyarrow as pa

    if not len(rows):
        return b""
    if rows.dtype == np.int64 and rows.min() >= 0 and rows.max() < 1 << 32:
        rows = rows.astype(np.uint32)
    planes = np.ascontiguousarray(rows).view(np.uint8).reshape(len(rows), -1).T.tobytes()
    return rows.itemsize.to_bytes(1, "little") + len(planes).to_bytes(8, "little") + pa.compress(planes, "zstd", asbytes=True)


def unpack(data: bytes, kind=np.uint64, fields: int = 1) -> np.ndarray:
    import pyarrow as pa

    if not data:
        return np.zeros((0, fields) if fields > 1 else 0, kind)
    stored, size = kind if data[0] == np.dtype(kind).itemsize else np.uint32, int.from_bytes(data[1:9], "little")
    planes = np.frombuffer(pa.decompress(data[9:], size, "zstd", asbytes=True), np.uint8).reshape(data[0] * fields, -1)
    rows = np.ascontiguousarray(planes.T).reshape(-1).view(stored).astype(kind, copy=False)
    return rows.reshape(-1, fields) if fields > 1 else rows


def unpacked(column, kind=np.uint64, fields: int = 1) -> np.ndarray:
    return np.concatenate([unpack(b"", kind, fields), *(unpack(b, kind, fields) for b in column.to_pylist())])


def firsts(ordered: np.ndarray) -> np.ndarray:
    """Where each value of an ordered array begins."""
    return np.flatnonzero(np.concatenate([ordered[:1] == ordered[:1], ordered[1:] != ordered[:-1]]))


def distinct(keys: np.ndarray) -> np.ndarray:
    keys = np.sort(keys)  # several times faster here than np.unique
    return keys[firsts(keys)]


def summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys in order, the sums of their values, and a place of each."""
    if not len(keys):
        return keys, values, np.zeros(0, np.int64)
    order = np.argsort(keys)
    keys = keys[order]
    first = firsts(keys)
    return keys[first], np.add.reduceat(values[order], first), order[first]


def shard_of(keys: np.ndarray, n_shards: int) -> np.ndarray:
    return (keys >> U64(32)) * U64(n_shards) >> U64(32)


def _followed(counts: np.ndarray) -> np.ndarray:
    """What each follower of a count adds to the entry of its context."""
    return np.stack([np.zeros_like(counts), counts, counts == 1, counts == 2, counts > 2], 1).astype(np.int64)


def _own(counts: np.ndarray) -> np.ndarray:
    return np.stack([counts, *[np.zeros_like(counts)] * (FIELDS - 1)], 1).astype(np.int64)


def _of_counts(counts: np.ndarray) -> list[int]:
    return [int((counts == k).sum()) for k in (1, 2, 3, 4)]


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney discounts for counts of one, two, and three or more, from how many counts are one, two, three and four."""
    n1, n2, n3, n4 = (max(1, n or 0) for n in (n1, n2, n3, n4))
    y = n1 / (n1 + 2 * n2)
    return tuple(min(k - 1e-3, max(0.05, d)) for k, d in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3)))


class Smoothing(NamedTuple):
    """What of the model is not in its entries: discounts by order, single words' total and the probability of an unknown one, and the number of shards."""

    d1: tuple[float, float, float]
    d2: tuple[float, float, float]
    d3: tuple[float, float, float]
    total: int
    unknown: float
    n_shards: int


class Model:
    """Entries of triples (key, count) and of pairs and words (key, FIELDS numbers), both by key, with their smoothing."""

    def __init__(self, triples: tuple[np.ndarray, np.ndarray], rest: tuple[np.ndarray, np.ndarray], smoothing: Smoothing):
        self.smoothing = smoothing
        self.triples, self.counts = triples[0], np.append(triples[1], 0)
        self.rest, numbers = rest[0], np.concatenate([rest[1], np.zeros((1, FIELDS), np.int64)])
        self.own, self.total = numbers[:, 0].copy(), numbers[:, 1].copy()
        self.cut2, self.cut3 = (numbers[:, 2] * d[0] + numbers[:, 3] * d[1] + numbers[:, 4] * d[2] for d in (smoothing.d2, smoothing.d3))

    @staticmethod
    def _find(known: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """The places of keys among the known ones, or else the place after the last."""
        order = np.argsort(keys)
        ordered = keys[order]
        k = np.searchsorted(known, ordered)  # keys in order find theirs several times faster
        k[np.append(known, ~ordered[-1:])[k] != ordered] = len(known)
        out = np.empty_like(k)
        out[order] = k
        return out

    @staticmethod
    def _left(counts: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
        return counts - np.array([0.0, *d])[np.minimum(counts, 3)]

    def _level(self, counts: np.ndarray, context: np.ndarray, cut: np.ndarray, d: tuple[float, float, float], lower: np.ndarray) -> np.ndarray:
        """One order: what its count leaves after the discount, and the lower order by the context's weight; the lower order alone where the context is new."""
        total = self.total[context]
        return np.where(total > 0, (self._left(counts, d) + cut[context] * lower) / np.maximum(total, 1), lower)

    def log_probabilities(self, two: np.ndarray, one: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Of the tokens of whole texts, in order: each but a text's first has the pair and the word before it for contexts."""
        s, n, begin = self.smoothing, len(token), np.array([BEGIN])
        before = np.arange(n) - 1
        before[one == BEGIN] = n
        words = self._find(self.rest, key_of(WORD, np.append(token, begin)))
        pairs = self._find(self.rest, key_of(PAIR, np.append(one, begin), np.append(token, begin)))
        p = self._left(self.own[words[:n]], s.d1) / s.total + s.unknown
        p = self._level(self.own[pairs[:n]], words[before], self.cut2, s.d2, p)
        return np.log(self._level(self.counts[self._find(self.triples, key_of(TRIPLE, two, one, token))], pairs[before], self.cut3, s.d3, p))

    def perplexities(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        two, one, token, first = sequences(texts)
        total = np.add.reduceat(self.log_probabilities(two, one, token), first[:-1])
        n = np.diff(first)
        return n, np.exp(np.minimum(-total / n, 700.0))


def trusted(labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    return labels.where(F.col(label_col) == 1).select(F.col(id_col).cast("long").alias("doc_id")).where("doc_id is not null").distinct()


def set_aside(doc_id: str = "doc_id") -> F.Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0


def _folder(df: DataFrame) -> str:
    return f"{shared_folder(df.sparkSession)}/quality-{uuid.uuid4().hex}"


def _table_of(folder: str) -> str:
    return folder.rsplit("/", 1)[-1].replace("-", "_")


def fit(texts: DataFrame, at: str | None = None, n_shards: int = 0) -> tuple[DataFrame, Smoothing]:
    """The entries of all rows' triples, pairs and words, ``shard, form, keys, numbers`` (form 0: triples), in a table ``at`` a folder, and their smoothing.

    Triples are counted in the shard of the pair they begin with, and once more in that of the pair they end with, so a shard has all it takes to
    count its pairs.  The shards are made in ``SLICES``, each from the texts anew, as the triples of all take several times the room of the entries.
    """
    spark, at = texts.sparkSession, at or _folder(texts)
    n, name = n_shards or dealt(input_bytes(texts), 256, 64)[1], _table_of(at)

    def triples(part: int):
        def run(it):
            import pyarrow as pa

            low, high = (-(-n * k // SLICES) for k in (part, part + 1))
            for batch in it:
                texts = texts_of(batch)
                for a, b in pieces(texts, 4 * SLICE):
                    u, v, w, _ = sequences(texts[a:b])
                    keys, rows = key_of(TRIPLE, u, v, w), []
                    for ends, pair in enumerate((key_of(PAIR, u, v), key_of(PAIR, v, w))):
                        shard = shard_of(pair, n)
                        mine = np.flatnonzero((shard >= low) & (shard < high))
                        key, times, first = summed(keys[mine], np.ones(len(mine), np.int64))
                        first = mine[first]
                        order = np.argsort(shard[first].astype(np.uint32), kind="stable")
                        key, times, first = key[order], times[order], first[order]
                        for k, i, j in _by_shard(shard[first], n):
                            here = first[i:j]
                            rows.append((int(k), ends, pack(key[i:j]), pack(v[here] if ends else pair[here]), pack(w[here]) if ends else b"", pack(times[i:j])))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) or [[]] * 6, (pa.int32(), pa.int32(), *[pa.binary()] * 4), strict=True)], ["shard", "ends", "key", "x", "y", "times"])

        return run

    def entries(group):
        """A shard's triples, pairs and sums of words, and how many of its counts are one to four."""
        import pyarrow as pa

        shard, ends = group.column("shard")[0].as_py(), group.column("ends").to_numpy()
        of = [group.filter(pa.array(ends == k)) for k in (0, 1)]
        (key, count, place), pair = summed(unpacked(of[0].column("key")), unpacked(of[0].column("times"), np.int64)), unpacked(of[0].column("x"))
        pair = pair[place]
        _, times, place = summed(unpacked(of[1].column("key")), unpacked(of[1].column("times"), np.int64))
        v, w = unpacked(of[1].column("x"))[place], unpacked(of[1].column("y"))[place]
        ended, before, place = summed(key_of(PAIR, v, w), np.where(v == BEGIN, times, 1))
        v, w = v[place], w[place]
        pairs = summed(np.concatenate([pair, ended]), np.concatenate([_followed(count), _own(before)]))
        words = summed(np.concatenate([key_of(WORD, v), key_of(WORD, w)]), np.concatenate([_followed(before), _own(np.ones_like(before))]))
        numbers = np.array([_of_counts(count) + _of_counts(before)])
        rows = [("model", 0, pack(key), pack(count)), ("model", 1, pack(pairs[0]), pack(pairs[1])), ("words", 1, pack(words[0]), pack(words[1])), ("counts", 2, b"", pack(numbers))]
        return pa.table([pa.array([shard] * 4, pa.int32()), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int32(), pa.binary(), pa.binary()), strict=True))], names=["shard", "kind", "form", "keys", "numbers"])

    def dealt_words(it):
        import pyarrow as pa

        for batch in it:
            keys, numbers = unpacked(batch.column("keys")), unpacked(batch.column("numbers"), np.int64, FIELDS)
            keys, numbers, _ = summed(keys, numbers)
            parts = [(int(k), pack(keys[a:b]), pack(numbers[a:b])) for k, a, b in _by_shard(shard_of(keys, n), n)]
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in parts], pa.int32()), pa.array([p[1] for p in parts], pa.binary()), pa.array([p[2] for p in parts], pa.binary())], ["shard", "keys", "numbers"])

    def words(group):
        import pyarrow as pa

        keys, numbers, _ = summed(unpacked(group.column("keys")), unpacked(group.column("numbers"), np.int64, FIELDS))
        own = numbers[:, 0]
        counts = np.array([[*_of_counts(own), int((own > 2).sum()), int(own.sum()), int((own > 0).sum())]])
        shard = group.column("shard").slice(0, 1).to_pylist() * 2
        return pa.table([pa.array(shard, pa.int32()), pa.array(["model", "types"]), pa.array([1, 2], pa.int32()), pa.array([pack(keys), b""], pa.binary()), pa.array([pack(numbers), pack(counts)], pa.binary())], names=["shard", "kind", "form", "keys", "numbers"])

    def counts_of(kind: str, size: int) -> list[int]:
        """The sums of a few numbers of every shard."""

        def run(it):
            import pyarrow as pa

            for batch in it:
                yield pa.RecordBatch.from_arrays([pa.array(unpacked(batch.column("numbers"), np.int64, size).sum(0)[None].tolist(), pa.list_(pa.int64()))], ["n"])

        got = made().where(F.col("kind") == kind).select("numbers").mapInArrow(run, "n array<long>")
        return [x or 0 for x in got.agg(*(F.sum(F.col("n")[k]).alias(f"n{k}") for k in range(size))).first()]

    def write(frame: DataFrame) -> None:
        frame.write.mode("append").partitionBy("kind").bucketBy(n, "shard").option("path", at).saveAsTable(name)

    def made() -> DataFrame:
        return spark.table(name)

    kinds = "shard int, kind string, form int, keys binary, numbers binary"
    for part in range(SLICES):
        write(texts.select("text").mapInArrow(triples(part), "shard int, ends int, key binary, x binary, y binary, times binary").groupBy("shard").applyInArrow(entries, kinds))
    write(made().where("kind = 'words'").select("keys", "numbers").mapInArrow(dealt_words, "shard int, keys binary, numbers binary").groupBy("shard").applyInArrow(words, kinds))
    delete(spark, f"{at}/kind=words")
    counts, (n1, n2, n3, n4, more, total, types) = counts_of("counts", 8), counts_of("types", 7)
    d1 = discounts(n1, n2, n3, n4)
    cut = n1 * d1[0] + n2 * d1[1] + more * d1[2] or 1.0
    total = total or 1
    return made().where("kind = 'model'").select("shard", "form", "keys", "numbers"), Smoothing(d1, discounts(*counts[4:]), discounts(*counts[:4]), total, cut / total / (types + 1), n)


def merged(rows) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """The triples and the rest of an Arrow table of entries."""
    import pyarrow as pa

    form, out = np.array(rows.column("form").to_pylist(), int), []
    for k, fields in enumerate((1, FIELDS)):
        here = rows.filter(pa.array(form == k, pa.bool_()))
        keys, numbers = unpacked(here.column("keys")), unpacked(here.column("numbers"), np.int64, fields)
        if (keys[1:] < keys[:-1]).any():  # a shard's triples come in order
            order = np.argsort(keys)
            keys, numbers = keys[order], numbers[order]
        out.append((keys, numbers))
    return out[0], out[1]


def train(docs: DataFrame, ids: list[int]) -> Model:
    """The model of the rows with these ids as one local object, for small sets; ``docs``: doc_id, text."""
    entries, smoothing = fit(docs.where(F.col("doc_id").isin(ids)))
    return Model(*merged(entries.toArrow()), smoothing)


def _bit(keys: np.ndarray) -> np.ndarray:
    return keys >> U64(64 - BITS.bit_length() + 1)


def bitmap(entries: DataFrame) -> bytes:
    """A bit for each key of the model, found range by range of the keys: ``BITS`` bits reach the driver, however many keys there are."""
    size = BITS // RANGES

    def marks(it):
        import pyarrow as pa

        for batch in it:
            bits = distinct(_bit(unpacked(batch.column("keys"))))
            parts = [(int(k), (bits[a:b] % U64(size)).astype(np.uint32).tobytes()) for k, a, b in _by_shard(bits // U64(size), RANGES)]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in parts], pa.int32()), pa.array([b for _, b in parts], pa.binary())], ["range", "bits"])

    def joined(group):
        import pyarrow as pa

        field = np.zeros(size, bool)
        for b in group.column("bits"):
            field[np.frombuffer(b.as_py(), np.uint32)] = True
        return pa.table([group.column("range").slice(0, 1), pa.array([np.packbits(field).tobytes()], pa.binary())], names=["range", "bits"])

    made = entries.select("keys").mapInArrow(marks, "range int, bits binary").groupBy("range").applyInArrow(joined, "range int, bits binary")
    found = {r.range: bytes(r.bits) for r in made.collect()}
    return b"".join(found.get(k, bytes(size // 8)) for k in range(RANGES))


def wanted(texts: list[bytes], known: bytes, n_shards: int) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """By shard, the distinct keys of triples and of the rest that the perplexities of these texts look up and the bitmap has."""
    field, triples, pairs, rest = np.frombuffer(known, np.uint8), [np.zeros(0, U64)], [np.zeros(0, U64)], [np.zeros(0, U64)]

    def held(keys: np.ndarray) -> np.ndarray:
        bit = _bit(keys)
        return (field[bit >> U64(3)] >> (U64(7) - (bit & U64(7))).astype(np.uint8)) & 1 > 0

    begin = np.array([BEGIN])
    for a, b in pieces(texts):
        two, one, token, _ = sequences(texts[a:b])
        keys = key_of(TRIPLE, two, one, token)
        mine = np.flatnonzero(held(keys))
        triples.append(keys[mine])
        pairs.append(key_of(PAIR, two[mine], one[mine]))
        every = distinct(np.concatenate([key_of(PAIR, np.append(one, begin), np.append(token, begin)), key_of(WORD, np.append(token, begin))]))
        rest.append(every[held(every)])
    keys = np.concatenate(triples)
    order = np.argsort(keys)
    keys = keys[order]
    first = firsts(keys)
    keys, shard = keys[first], shard_of(np.concatenate(pairs)[order[first]], n_shards)
    order = np.argsort(shard.astype(np.uint32), kind="stable")
    every = distinct(np.concatenate(rest))
    out = {int(s): [keys[order[a:b]], every[:0]] for s, a, b in _by_shard(shard[order], n_shards)}
    for s, a, b in _by_shard(shard_of(every, n_shards), n_shards):
        out.setdefault(int(s), [keys[:0], None])[1] = every[a:b]
    return [(s, *both) for s, both in out.items()]


def score(df: DataFrame, entries: DataFrame, smoothing: Smoothing, n_groups: int = 0, n_shards: int = 0, waves: int = WAVES) -> DataFrame:
    """``doc_id, lang, n_tokens, perplexity`` of rows with doc_id, lang and text.  ``n_shards``: how many to put the model's shards together to, if not as they are."""
    n_groups = n_groups or dealt(input_bytes(df), 256, 64)[0]
    docs = df.select("doc_id", "lang", "text", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_groups)).cast("int").alias("g"))
    answered = "g int, form int, keys binary, numbers binary"

    def ask(group):
        import pyarrow as pa

        g, parts = group.column("g")[0].as_py(), wanted(texts_of(group), sent.value, smoothing.n_shards)
        return pa.table([pa.array([p[0] for p in parts], pa.int32()), pa.array([g] * len(parts), pa.int32()), *(pa.array([pack(p[k]) for p in parts], pa.binary()) for k in (1, 2))], names=["shard", "g", "triples", "rest"])

    def answer(asks, held):
        """What the entries hold of the keys that were asked for."""
        import pyarrow as pa

        out = []
        if asks.num_rows and held.num_rows:
            entries = merged(held)
            for g, *asked in zip(*(asks.column(c).to_pylist() for c in ("g", "triples", "rest")), strict=True):
                for form, (keys, numbers) in enumerate(entries):
                    want = unpack(asked[form])
                    if len(want) and len(keys):
                        k = np.searchsorted(keys, want)
                        k[k == len(keys)] = 0
                        found = keys[k] == want
                        out.append((g, form, pack(want[found]), pack(numbers[k[found]])))
        return pa.table([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.binary(), pa.binary()))], names=["g", "form", "keys", "numbers"])

    def run(group, answers):
        import pyarrow as pa

        texts, model = texts_of(group), Model(*merged(answers), smoothing)
        done = [model.perplexities(texts[a:b]) for a, b in pieces(texts)]
        return pa.table([group.column("doc_id"), group.column("lang"), pa.array(np.concatenate([n for n, _ in done]), pa.int64()), pa.array(np.concatenate([p for _, p in done]))], names=["doc_id", "lang", "n_tokens", "perplexity"])

    sent = df.sparkSession.sparkContext.broadcast(bitmap(entries))  # BITS bits, whatever the input
    together = lambda frame: frame.withColumn("shard", F.floor(F.col("shard") * n_shards / smoothing.n_shards).cast("int")) if n_shards else frame
    out = []
    for wave in range(waves):
        part = docs.where(F.pmod("g", F.lit(waves)) == wave)
        asks = part.groupBy("g").applyInArrow(ask, "shard int, g int, triples binary, rest binary")  # of the same rows as below, so that they are dealt once
        answers = together(asks).groupBy("shard").cogroup(together(entries).groupBy("shard")).applyInArrow(answer, answered)
        out.append(durable(part.groupBy("g").cogroup(answers.groupBy("g")).applyInArrow(run, "doc_id long, lang string, n_tokens long, perplexity double")))
    return functools.reduce(DataFrame.unionByName, out)


def classify(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", quantile: float = QUANTILE) -> DataFrame:
    """``doc_id, lang, n_tokens, perplexity, threshold, kept`` of every row."""
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    good = trusted(labels)
    mine = docs.join(good.where(~set_aside()), "doc_id", "left_semi")
    at, top = _folder(df), _folder(df)
    with tidy(df.sparkSession):
        mine.select("text").write.option("compression", "zstd").parquet(f"{top}/text")  # so that texts and labels meet once, not in every slice
        entries, smoothing = fit(df.sparkSession.read.parquet(f"{top}/text"), at, dealt(input_bytes(docs), 256, 64)[1])
        delete(df.sparkSession, top)
        scored = score(docs, entries, smoothing)
    df.sparkSession.sql(f"drop table if exists {_table_of(at)}")
    delete(df.sparkSession, at)
    held = scored.join(good.where(set_aside()), "doc_id", "left_semi")
    own = held.groupBy(F.coalesce("lang", F.lit("")).alias("of")).agg(F.percentile_approx("perplexity", quantile, 10_000).alias("own"))
    every = held.agg(F.percentile_approx("perplexity", quantile, 10_000).alias("q")).first()
    limit = F.coalesce("own", F.lit(every.q if every else None).cast("double"))
    return scored.join(own, F.coalesce("lang", F.lit("")) == F.col("of"), "left").select("doc_id", "lang", "n_tokens", "perplexity", limit.alias("threshold"), F.coalesce(F.col("perplexity") <= limit, F.lit(True)).alias("kept"))
