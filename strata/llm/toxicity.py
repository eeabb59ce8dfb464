"""Toxic spans by a linear-chain conditional random field, summed up to document scores.

Tokens are runs of letters (ASCII letters and all non-ASCII bytes), lower-cased in A-Z.
Only documents carry labels, so token labels are made first: a token of a toxic training
document is toxic if the share of toxic documents among those with its word is high.  The
two-state chain is then trained on these sequences.  Its features are the word and its
first bytes, from a bounded list of informative ones.  Most tokens have none of them and
share one potential, so runs of such tokens enter forward and backward sums as a power of
one 2x2 matrix, in closed form; this is exact.

A document's score is a logistic function, fitted on the training documents, of the
largest and the summed token marginals; toxic tokens give the offending offsets.

Labels are read for training only.  Training documents are at most ``MAX_DOCS`` labelled
rows, picked by a hash of their id.  Without labels of both kinds the score is the smoothed
share of toxic labels.  Null text counts as empty; a null id is never held out; repeated
rows give repeated results, and of a repeated label one is used.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Words, documents, durable, pieces, texts_of

MAX_DOCS, MAX_FEATURES, MAX_TOKENS, HEAD = 20_000, 4_096, 4_000_000, 6
THRESHOLD = 0.3
SEPARATORS = np.ones(256, bool)
SEPARATORS[97:123] = False
SEPARATORS[128:] = False


def held_out(doc_id) -> F.Column:
    """Whether crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("long").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def tokens(texts: list[bytes]) -> tuple[Words, np.ndarray]:
    """Words of lower-cased texts and hashes of their first bytes."""
    w = Words([t.lower() for t in texts], SEPARATORS, keep=True)
    return w, w.heads(HEAD)


# ---------------------------------------------------------------- the chain

class Chain:
    """Two states; state 1 is toxic.  ``start1`` and ``stay`` are the potentials of entering and keeping state 1."""

    def __init__(self, features: np.ndarray, weights: np.ndarray, bias: float = -3.0, start1: float = -1.0, stay: float = 0.0, doc: tuple = (0.0, 0.0, 0.0, -2.0), prior: float | None = None):
        self.features, self.weights = features, weights  # sorted feature hashes
        self.bias, self.start1, self.stay = bias, start1, stay
        self.doc, self.prior = doc, prior

    def emissions(self, w: Words, heads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices of tokens with a feature, and their weight in state 1 beside the bias."""
        total = np.zeros(len(w.hashes))
        hit = np.zeros(len(w.hashes), bool)
        if len(self.features):
            for values in (w.hashes, heads):
                k = np.searchsorted(self.features, values)
                k[k == len(self.features)] = 0
                same = self.features[k] == values
                total[same] += self.weights[k[same]]
                hit |= same
        at = np.flatnonzero(hit)
        return at, total[at]

    def _power(self, gaps: np.ndarray) -> np.ndarray:
        """The neutral matrix to each power, scaled by its larger eigenvalue's."""
        e = np.exp
        n = np.array([[1.0, e(self.start1 + self.bias)], [1.0, e(self.stay + self.bias)]])
        mean, det = (n[0, 0] + n[1, 1]) / 2, np.linalg.det(n)
        root = np.sqrt(max(mean * mean - det, 1e-300))
        big, small = mean + root, mean - root
        r = (small / big) ** gaps.astype(float)
        one = np.eye(2)
        p = (n - small * one) / (big - small)
        q = (n - big * one) / (small - big)
        self.log_big = float(np.log(big))
        return p[None] + r[:, None, None] * q[None]

    def marginals(self, at: np.ndarray, emission: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(toxic) of the tokens ``at``, and the log of each text's normaliser.

        ``first``: where each text's tokens begin in the flat order, and the end.
        """
        begin = np.searchsorted(at, first)
        count = np.diff(begin)
        length = np.diff(first)
        docs, steps = len(count), int(count.max(initial=0))
        prob, logz = np.zeros(len(at)), np.zeros(docs)
        state = np.zeros((docs, 2))
        state[:, 0] = 1.0
        gap = at.copy()
        gap[1:] -= at[:-1] + 1
        if len(at):
            heads = begin[:-1][count > 0]
            gap[heads] = at[heads] - first[:-1][count > 0]
        powers = self._power(gap)
        tail = length.copy()
        some = count > 0
        tail[some] = first[1:][some] - 1 - at[begin[1:][some] - 1]
        tails = self._power(tail)
        logz += (length - count) * self.log_big
        order = np.argsort(-count, kind="stable")
        sorted_count = count[order]
        step = np.array([[1.0, np.exp(self.start1)], [1.0, np.exp(self.stay)]])
        lift = np.exp(np.minimum(emission + self.bias, 60.0))
        before = np.zeros((len(at), 2))
        for k in range(steps):
            live = order[: np.searchsorted(-sorted_count, -k, side="left")]
            i = begin[live] + k
            s = np.einsum("dx,dxy->dy", state[live], powers[i]) @ step
            before[i] = s
            s[:, 1] *= lift[i]
            z = s.sum(axis=1)
            logz[live] += np.log(z)
            state[live] = s / z[:, None]
        z = np.einsum("dx,dxy->d", state, tails)
        logz += np.log(z)
        after = np.einsum("dxy->dx", tails).copy()
        for k in range(steps):  # from each text's last token backwards
            live = order[: np.searchsorted(-sorted_count, -k, side="left")]
            last = count[live] - 1 - k
            i = begin[live] + last
            a = before[i].copy()
            a[:, 1] *= lift[i]
            joint = a * after[live]
            prob[i] = joint[:, 1] / joint.sum(axis=1)
            b = after[live].copy()
            b[:, 1] *= lift[i]
            b = np.einsum("dxy,dy->dx", powers[i], b @ step.T)
            after[live] = b / b.sum(axis=1)[:, None]
        return prob, logz

    def summary(self, prob: np.ndarray, begin: np.ndarray, n_tokens: np.ndarray) -> np.ndarray:
        """Per text: the largest marginal's log-odds, log of the marginals' sum, log length."""
        docs = len(begin) - 1
        top, total = np.zeros(docs), np.zeros(docs)
        owner = np.repeat(np.arange(docs), np.diff(begin))
        np.maximum.at(top, owner, prob)
        np.add.at(total, owner, prob)
        top = np.clip(top, 1e-4, 1 - 1e-4)
        return np.stack([np.log(top / (1 - top)), np.log1p(total), np.log1p(n_tokens)], axis=1)

    def score(self, summary: np.ndarray) -> np.ndarray:
        if self.prior is not None:
            return np.full(len(summary), self.prior)
        z = summary @ np.array(self.doc[:3]) + self.doc[3]
        return 1 / (1 + np.exp(-np.clip(z, -40, 40)))

    def scores(self, texts: list[bytes]) -> np.ndarray:
        w, heads = tokens(texts)
        at, em = self.emissions(w, heads)
        prob, _ = self.marginals(at, em, w.first)
        return self.score(self.summary(prob, np.searchsorted(at, w.first), np.diff(w.first)))

    def spans(self, text: str, least: float = 0.5) -> list[tuple[int, int, float]]:
        """Toxic tokens of a text as (start, end, marginal) in code points."""
        raw = text.encode()
        w, heads = tokens([raw])
        at, em = self.emissions(w, heads)
        prob, _ = self.marginals(at, em, w.first)
        chars = lambda b: len(raw[:b].decode("utf-8", "ignore"))
        return [(chars(int(w.starts[i])), chars(int(w.ends[i])), float(p)) for i, p in zip(at, prob, strict=True) if p >= least]


# ---------------------------------------------------------------- training

def _logistic(x: np.ndarray, y: np.ndarray, decay: float = 1e-2) -> np.ndarray:
    """Newton steps; the last weight is the intercept."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + (decay * len(x) / 100 + 1e-9) * np.eye(len(w))
        w = w - np.linalg.solve(h, x.T @ (p - y) + decay * w * len(x) / 100)
    return w


def fit(sequences: list[tuple[int, int, np.ndarray, np.ndarray]], words: dict[int, tuple[int, int]], epochs: int = 80, rate: float = 0.3, decay: float = 2e-3) -> Chain:
    """``sequences``: label, token count, positions and (two) feature hashes of a document's tokens that have a feature.

    ``words``: by feature, documents with it and toxic ones among them.
    """
    features = np.array(sorted(words), U64)
    share = np.array([words[int(f)][1] / words[int(f)][0] for f in features])
    support = np.array([words[int(f)][1] for f in features])
    strong = (share >= 0.8) & (support >= 3)
    first = np.zeros(len(sequences) + 1, np.int64)
    np.cumsum([s[1] for s in sequences], out=first[1:])
    at = np.concatenate([first[k] + s[2] for k, s in enumerate(sequences)]).astype(np.int64) if sequences else np.zeros(0, np.int64)
    pairs = np.concatenate([s[3] for s in sequences]) if sequences else np.zeros((0, 2), U64)
    label = np.repeat([s[0] for s in sequences], [len(s[2]) for s in sequences])
    y_doc = np.array([s[0] for s in sequences], float)
    cols = np.searchsorted(features, pairs)
    cols[cols == len(features)] = 0
    has = features[cols] == pairs
    y = (label == 1) & ((strong[cols] & has).any(axis=1))
    chain = Chain(features, np.zeros(len(features)))
    theta = np.array([chain.bias, chain.start1, chain.stay])
    linked = np.flatnonzero((np.diff(at) == 1))
    n11 = int((y[linked] & y[linked + 1]).sum())
    n1 = int(y.sum())
    gold = np.array([n1, n1 - n11, n11], float)
    seen, seen_t = np.full(len(features), 1e-6), np.full(3, 1e-6)

    def run(t):
        chain.bias, chain.start1, chain.stay = t
        em = np.where(has, chain.weights[cols], 0).sum(axis=1)
        return chain.marginals(at, em, first)

    for epoch in range(epochs):
        prob, logz = run(theta)
        grad = np.bincount(cols[has], weights=np.broadcast_to((y - prob)[:, None], has.shape)[has], minlength=len(features)) / max(1, n1) - decay * chain.weights
        seen += grad**2
        if epoch % 4 == 0:
            eps, slope = 1e-3, np.zeros(3)
            for k in range(3):
                moved = theta.copy()
                moved[k] += eps
                slope[k] = (gold[k] - (run(moved)[1] - logz).sum() / eps) / max(1, n1) - decay * theta[k]
            seen_t += slope**2
            theta = theta + rate * slope / np.sqrt(seen_t)
        chain.weights = chain.weights + rate * grad / np.sqrt(seen)
    prob, _ = run(theta)
    chain.doc = tuple(_logistic(chain.summary(prob, np.searchsorted(at, first), np.diff(first)), y_doc))
    return chain


def train(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Chain:
    """Trains on at most ``max_docs`` labelled documents that are not held out.

    What reaches the driver is bounded: counts of the MAX_FEATURES best features, and the tokens that have one of them of
    training documents in the order of a hash of their id, up to and with the one that reaches ``MAX_TOKENS``.
    """
    spark = docs.sparkSession
    lab = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out(F.col("doc_id")))
    lab = lab.groupBy("doc_id").agg(F.max("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_docs)
    picked = [(r.doc_id, r.y) for r in lab.collect()]  # at most max_docs rows
    toxic = sum(y for _, y in picked)
    if not 0 < toxic < len(picked):
        return Chain(np.zeros(0, U64), np.zeros(0), prior=(toxic + 0.1) / (len(picked) + 1))
    chosen = F.broadcast(spark.createDataFrame(picked, "doc_id long, y int"))  # bounded by max_docs
    train_docs = documents(docs, id_col, text_col).join(chosen, "doc_id")

    def distinct(it):
        import pyarrow as pa

        for batch in it:
            texts, ys = texts_of(batch), batch.column("y").to_numpy()
            for a, b in pieces(texts):
                w, heads = tokens(texts[a:b])
                owner = np.repeat(np.arange(a, b), np.diff(w.first))
                keys, back = np.unique(np.concatenate([w.hashes, heads]), return_inverse=True)
                pair = np.unique(np.stack([back, np.tile(owner, 2)]), axis=1)
                n, t = np.bincount(pair[0], minlength=len(keys)), np.bincount(pair[0], weights=ys[pair[1]], minlength=len(keys)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n, pa.int64()), pa.array(t, pa.int64())], ["feature", "n", "t"])

    base = toxic / len(picked)
    counts = train_docs.mapInArrow(distinct, "feature long, n long, t long").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("t").alias("t"))
    useful = counts.where((F.col("t") >= 2) & (F.col("t") / F.col("n") >= max(0.5, min(0.9, 3 * base)))).orderBy(F.desc("t"), "n", "feature").limit(MAX_FEATURES)
    words = {r.feature & (1 << 64) - 1: (r.n, r.t) for r in useful.collect()}
    known = np.array(sorted(words), U64)

    def active(it):
        import pyarrow as pa

        for batch in it:
            texts, ys, ids = texts_of(batch), batch.column("y").to_pylist(), batch.column("doc_id").to_pylist()
            rows = []
            for a, b in pieces(texts):
                w, heads = tokens(texts[a:b])
                hit = np.isin(w.hashes, known) | np.isin(heads, known)
                for k in range(b - a):
                    lo, hi = w.first[k], w.first[k + 1]
                    at = np.flatnonzero(hit[lo:hi])
                    rows.append((ids[a + k], ys[a + k], int(hi - lo), at.astype(np.int64).tolist(), w.hashes[lo + at].view(np.int64).tolist(), heads[lo + at].view(np.int64).tolist()))
            yield pa.RecordBatch.from_pylist([dict(zip(("doc_id", "y", "n", "at", "words", "heads"), r, strict=True)) for r in rows], schema=pa.schema([("doc_id", pa.int64()), ("y", pa.int32()), ("n", pa.int64()), ("at", pa.list_(pa.int64())), ("words", pa.list_(pa.int64())), ("heads", pa.list_(pa.int64()))]))

    found = durable(train_docs.mapInArrow(active, "doc_id long, y int, n long, at array<long>, words array<long>, heads array<long>"))
    sizes = {r.doc_id: r.m for r in found.groupBy("doc_id").agg(F.sum(F.size("at") + 1).alias("m")).collect()}  # at most max_docs rows
    left_out, total = [], 0
    for i, _ in picked:
        if total >= MAX_TOKENS:
            left_out.append(i)
        total += sizes.get(i, 0)
    got = (found.where(~F.col("doc_id").isin(left_out)) if left_out else found).drop("doc_id").collect()
    if len({r.y for r in got}) < 2:  # labelled documents of one kind are missing
        return Chain(np.zeros(0, U64), np.zeros(0), prior=(toxic + 0.1) / (len(picked) + 1))
    sequences = [(r.y, r.n, np.array(r["at"], np.int64), np.stack([np.array(r.words, np.int64), np.array(r.heads, np.int64)], axis=1).view(U64).reshape(-1, 2)) for r in got]
    sequences.sort(key=lambda s: (s[0], s[1], s[2].tolist(), s[3].tolist()))
    return fit(sequences, words)


# ---------------------------------------------------------------- DataFrame operators

def score_documents(df: DataFrame, chain: Chain, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, least: float = 0.5) -> DataFrame:
    """``doc_id, score, spans`` of every row; ``spans``: the offending ``start:end`` (code points) of texts from ``threshold`` on, those of marginals from ``least`` on."""

    def run(it):
        import pyarrow as pa

        for batch in it:
            texts = texts_of(batch)
            out = [chain.scores(texts[a:b]) for a, b in pieces(texts)]
            score = np.concatenate(out) if out else np.zeros(0)
            spans = [",".join(f"{a}:{b}" for a, b, _ in chain.spans(t.decode(), least)) if s >= threshold else "" for t, s in zip(texts, score.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score), pa.array(spans, pa.string())], ["doc_id", "score", "spans"])

    return documents(df, id_col, text_col).mapInArrow(run, "doc_id long, score double, spans string")


def toxic_spans(df: DataFrame, chain: Chain, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, spans array<struct<start, end, marginal>>``: offending offsets of every row."""

    def run(it):
        import pyarrow as pa

        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("marginal", pa.float64())]))
        for batch in it:
            spans = [[{"start": a, "end": b, "marginal": p} for a, b, p in chain.spans(t or "", least)] for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, kind)], ["doc_id", "spans"])

    return documents(df, id_col, text_col).mapInArrow(run, "doc_id long, spans array<struct<start:int,end:int,marginal:double>>")


def keep_clean(df: DataFrame, chain: Chain, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows whose score is under the threshold, with all their columns."""
    schema = df.schema

    def run(it):
        import pyarrow as pa

        for batch in it:
            texts = texts_of(batch, text_col)
            out = [chain.scores(texts[a:b]) for a, b in pieces(texts)]
            yield batch.filter(pa.array(np.concatenate(out) < threshold if out else np.zeros(0, bool)))

    return df.mapInArrow(run, schema)
