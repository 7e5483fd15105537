"""Toxicity: averaged subword embeddings and a linear softmax, trained jointly.

A text is the bag of its words' character n-grams (edges marked, as in "<id", "ot>") and of
its whole words.  Each has an embedding by hash; a text is the average of them, and a linear
softmax over two classes gives the score.  Misspellings share n-grams with the words that
training saw.  As averaging and the softmax's logits are linear, scoring reads
one number per n-gram.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .samples import CHUNK, chunks, joined, labelled, pieces, raw_texts, remainder, sums

BITS, GRAMS, DIM = 18, (3, 4, 5), 8
#: Training rows per label value, and the longest text among them in characters.
MOST, LONGEST = 2000, 20_000

_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32
_INNER = np.zeros(256, bool)
_INNER[48:58] = _INNER[97:123] = _INNER[0x80:] = True
_RNG = np.random.default_rng(7)
_MIX = _RNG.integers(1, 1 << 63, 256, np.uint64) | np.uint64(1)
_MIX[0] = 3  # the edge of a word
_STEP = _RNG.integers(1, 1 << 63, 64, np.uint64) | np.uint64(1)


def _bucket(h: np.ndarray, kind: int) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    return ((h * _STEP[60 - kind]) >> np.uint64(64 - BITS)).astype(np.int32)


def features(texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each kind of n-gram (buckets, cuts): those of text k are buckets[cuts[k]:cuts[k + 1]]."""
    raw, begin = joined(texts)
    low = _LOW[raw]
    inner = _INNER[low]
    value = np.where(inner, _MIX[low], _MIX[0])
    outer = np.concatenate(([0], np.cumsum(~inner)))
    out = []
    for n in GRAMS:
        last = len(raw) - n + 1
        if last <= 0:
            out.append((np.zeros(0, np.int32), np.zeros(len(begin), np.int64)))
            continue
        # Within a word, but that the first or last place may be its edge.
        ok = np.flatnonzero(outer[n - 1 : n - 1 + last] == outer[1 : 1 + last])
        h = np.zeros(len(ok), np.uint64)
        for k in range(n):
            h += value[ok + k] * _STEP[k]
        out.append((_bucket(h, n), np.searchsorted(ok, begin - 1)))
    start = np.flatnonzero(inner[1:] & ~inner[:-1]) + 1
    stop = np.flatnonzero(~inner[1:] & inner[:-1]) + 1
    edges = np.concatenate(([0], start))
    inside = np.arange(len(raw)) - np.repeat(edges, np.diff(np.append(edges, len(raw))))
    v = value * _STEP[inside & 31]
    v ^= v >> np.uint64(29)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(v, dtype=np.uint64)))
    out.append((_bucket(total[stop] - total[start], 0), np.searchsorted(start, begin)))
    return out


@dataclass
class Model:
    embedding: np.ndarray  # bucket, dimension
    softmax: np.ndarray  # dimension, class
    bias: np.ndarray  # class

    def __post_init__(self) -> None:
        self.one = (self.embedding @ (self.softmax[:, 1] - self.softmax[:, 0])).astype(np.float32)

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """The probability of class 1; a text without words has the bias alone.  A word of over CHUNK bytes counts as several."""
        out = np.zeros(len(texts))
        for a, b in chunks(texts):
            # Words, and so n-grams, lie within pieces.
            parts = [self._sums([x]) for x in pieces(texts[a], CHUNK)] if b - a == 1 else [self._sums(texts[a:b])]
            out[a:b] = sum(total for total, _ in parts) / np.maximum(sum(n for _, n in parts), 1)
        return 1 / (1 + np.exp(-np.clip(out + self.bias[1] - self.bias[0], -30, 30)))

    def _sums(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Each text's sum over its n-grams, and their number."""
        got = features(texts)
        return sum(sums(self.one[ix], cuts) for ix, cuts in got), sum(np.diff(cuts) for _, cuts in got)


def fit(rows: list[tuple[str, int]], share: float = 0.5, epochs: int = 8, settle: int = 16, rate: float = 20.0, sparse: float = 2e-4, batch: int = 50, least: int = 5) -> Model:
    """AdaGrad on the softmax's cross-entropy, embeddings and output together; classes weigh alike, and
    then the biases are moved to the share of label 1 before sampling.  For the first `epochs` a penalty on each embedding's length
    (`sparse`) brings those to zero that say little; the others then learn on without it for `settle` epochs.  N-grams in fewer than
    `least` rows say nothing that carries over: their embeddings are zero.  Without rows of both classes the score is 0.5 everywhere.
    """
    size, rng = 1 << BITS, np.random.default_rng(0)
    e = rng.normal(0, 0.05, (size, DIM)).astype(np.float32)
    u = rng.normal(0, 0.5, (DIM, 2))
    c = np.zeros(2)
    y = np.array([v for _, v in rows], int)
    if not 0 < y.sum() < len(y):
        return Model(e, u * 0, c)
    xs: list[tuple[np.ndarray, np.ndarray]] = []
    texts = [t.encode() for t, _ in rows]
    for a, b in chunks(texts):
        got = features(texts[a:b])
        for k in range(b - a):
            each = np.concatenate([ix[cuts[k] : cuts[k + 1]] for ix, cuts in got])
            ix, m = np.unique(each, return_counts=True)
            xs.append((ix, (m / max(len(each), 1)).astype(np.float32)))
    e[np.bincount(np.concatenate([ix for ix, _ in xs]), minlength=size) < least] = 0
    weigh = np.where(y == 1, len(y) / 2 / y.sum(), len(y) / 2 / (len(y) - y.sum()))
    ge, gu, gc = np.full(size, 1e-8, np.float32), np.full(u.shape, 1e-8), np.full(2, 1e-8)
    for epoch in range(epochs + settle):
        if epoch in (0, epochs):  # rows of zeros stay
            live = e.any(1)
            xs = [(ix[ok], m[ok]) for ix, m in xs for ok in [live[ix]]]
        order = rng.permutation(len(xs))
        for at in range(0, len(order), batch):
            ks = order[at : at + batch]
            ix = np.concatenate([xs[k][0] for k in ks])
            x = np.concatenate([xs[k][1] for k in ks])
            seg = np.repeat(np.arange(len(ks)), [len(xs[k][0]) for k in ks])
            h = np.stack([np.bincount(seg, e[ix, d] * x, len(ks)) for d in range(DIM)], 1)
            logit = h @ u + c
            p = np.exp(logit - logit.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(ks)), y[ks]] -= 1
            p *= weigh[ks, None]
            dh = p @ u.T
            du, dc = h.T @ p, p.sum(0)
            used, back = np.unique(ix, return_inverse=True)
            grad = np.stack([np.bincount(back, dh[seg, d] * x, len(used)) for d in range(DIM)], 1)
            ge[used] += (grad * grad).mean(1)
            step = rate / np.sqrt(ge[used])
            new = e[used] - step[:, None] * grad
            if epoch < epochs:
                new *= np.maximum(1 - step * sparse / np.maximum(np.linalg.norm(new, axis=1), 1e-12), 0)[:, None]
            e[used] = new.astype(np.float32)
            gu += du * du
            gc += dc * dc
            u -= 0.05 * du / np.sqrt(gu)
            c -= 0.05 * dc / np.sqrt(gc)
    share = min(max(share, 1e-3), 1 - 1e-3)
    c[1] += np.log(share / (1 - share))
    return Model(e, u, c)


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fits labels.toxic on rows whose crc32(doc_id) mod 5 isn't 0."""
    learn = labels.filter(remainder(5) != 0)
    share = learn.agg(F.avg(F.col("toxic").cast("double"))).first()[0]
    return fit(labelled(docs, learn, "toxic", MOST, LONGEST), 0.5 if share is None else share)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """docs, all columns, and toxicity_score, from the whole text; null counts as empty.

    A column toxicity_score that docs has already is replaced.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = pa.array(held.value.scores(raw_texts(b.column("text"))))
            yield pa.RecordBatch.from_arrays([*b.columns, got], [*b.schema.names, "toxicity_score"])

    docs = docs.drop("toxicity_score")
    return docs.mapInArrow(run, docs.select("*", F.lit(0.0).alias("toxicity_score")).schema)
