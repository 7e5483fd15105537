"""Text quality: logistic regression over hashed word n-grams, fitted by FTRL-proximal.

Words are runs of letters and digits, or of other visible signs.  The n-grams are words, word
pairs, and the same over word shapes (case, digits, length, sameness with the words before),
which carry over to words that training never saw.  A text's features are its
n-gram counts over its number of words; the score is one sparse dot product.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .samples import CHUNK, chunks, joined, labelled, pieces, raw_texts, remainder, sums

BITS = 18
#: Training rows per label value, and the longest text among them in characters.
MOST, LONGEST = 3000, 20_000
KEEP = 0.7
#: Bytes of the piece before that a piece of a long text sees: room for the words that shapes compare with.
LOOK = 4096
#: Bytes of short texts scored at a time, and rows of a batch: what they take stays in a worker, beside all else that an executor holds.
AT_ONCE, ROWS = 1 << 18, 1000

_SPACE, _WORD, _SIGN = 0, 1, 2
_CLASS = np.full(256, _SIGN, np.uint8)
_CLASS[: 0x21] = _SPACE
_CLASS[0x7F] = _SPACE
_CLASS[0x80:] = _WORD
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_CLASS[48:58] = _CLASS[65:91] = _CLASS[97:123] = _WORD
_UPPER, _DIGIT = np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91] = _DIGIT[48:58] = True
_RNG = np.random.default_rng(8)
_MIX = _RNG.integers(1, 1 << 63, 256, np.uint64) | np.uint64(1)
_STEP = _RNG.integers(1, 1 << 63, 64, np.uint64) | np.uint64(1)
_KIND = _RNG.integers(1, 1 << 63, 8, np.uint64) | np.uint64(1)


def _bucket(h: np.ndarray, kind: int) -> np.ndarray:
    h = h * _KIND[kind]
    h ^= h >> np.uint64(31)
    return ((h * _KIND[7]) >> np.uint64(64 - BITS)).astype(np.int64)


def features(texts: list[bytes], skip: int = 0) -> tuple[list[np.ndarray], np.ndarray]:
    """(buckets of each kind, one per word; words of text k are cuts[k]:cuts[k + 1]), but for words in the first `skip` bytes."""
    raw, begin = joined(texts)
    cls = _CLASS[raw]
    start = np.flatnonzero((cls[1:] != cls[:-1]) & (cls[1:] != _SPACE)) + 1
    stop = np.flatnonzero((cls[1:] != cls[:-1]) & (cls[:-1] != _SPACE)) + 1
    cuts = np.searchsorted(start, begin + np.where(np.arange(len(begin)) == 0, skip, 0))
    if not len(start):
        return [np.zeros(0, np.int64)] * 4, cuts
    n = stop - start
    low = _LOWER[raw]
    edges = np.concatenate(([0], start))
    inside = np.arange(len(raw)) - np.repeat(edges, np.diff(np.append(edges, len(raw))))
    value = _MIX[low] * _STEP[inside & 63]
    value ^= value >> np.uint64(29)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)))
    word = total[stop] - total[start]
    word ^= word >> np.uint64(32)
    up = np.concatenate(([0], np.cumsum(_UPPER[raw])))
    dig = np.concatenate(([0], np.cumsum(_DIGIT[raw])))
    ups, digs = up[stop] - up[start], dig[stop] - dig[start]
    case = np.where(ups == 0, 0, np.where(ups == n, 2, np.where(_UPPER[raw[start]] & (ups == 1), 1, 3)))
    shape = case + 4 * (digs > 0) + 8 * np.minimum(n, 12)
    first = np.searchsorted(start, begin)
    place = np.arange(len(start)) - np.repeat(first[:-1], np.diff(first))
    before = [np.where(place >= k, np.roll(word, k), np.uint64(0)) for k in (1, 2)]
    shape = shape.astype(np.uint64) + np.where(word == before[0], 128, 0).astype(np.uint64) + np.where(word == before[1], 256, 0).astype(np.uint64)
    shape = np.where(cls[start] == _SIGN, word, shape)
    follow = np.where(place >= 1, np.roll(shape, 1), np.uint64(0))
    return [_bucket(word, 0), _bucket(word + before[0] * _KIND[6], 1), _bucket(shape, 2), _bucket(shape + follow * _KIND[6], 3)], cuts


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """A text without words gets the score of no evidence, from the bias alone.

        Long texts are summed by pieces, which see LOOK bytes of the one before; of a word of over CHUNK bytes the first ones count.
        """
        out = np.zeros(len(texts))
        for a, b in chunks(texts, AT_ONCE):
            if b - a > 1:
                total, n = self._sums(texts[a:b])
            else:
                total, n, before = np.zeros(1), np.zeros(1), b""
                for piece in pieces(texts[a], CHUNK):
                    before = before[before.find(b" ") + 1 :] if len(before) == LOOK else before
                    x, m = self._sums([before + piece], len(before))
                    total, n, before = total + x, n + m, (before + piece)[-LOOK:]
            out[a:b] = total / np.maximum(n, 1)
        return 1 / (1 + np.exp(-np.clip(out + self.bias, -30, 30)))

    def _sums(self, texts: list[bytes], skip: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Each text's sum over its n-grams, and the number of words; of one text, words that begin in its first `skip` bytes don't count."""
        kinds, cuts = features(texts, skip)
        value = sum(self.weights[k] for k in kinds) if len(kinds[0]) else np.zeros(0)
        return sums(value, cuts), np.diff(cuts)


def fit(rows: list[tuple[str, int]], share: float = 0.5, epochs: int = 4, alpha: float = 2.0, beta: float = 1.0, l1: float = 1e-4, l2: float = 1e-3) -> Model:
    """FTRL-proximal, one row at a time in a drawn order; classes weigh alike, and then the bias
    is moved to the share of label 1 that training rows have before sampling.

    Without rows of both classes the score is 0.5 everywhere.
    """
    size = 1 << BITS
    z, n = np.zeros(size), np.zeros(size)
    z0 = n0 = 0.0
    xs = []
    texts = [t.encode() for t, _ in rows]
    for a, b in chunks(texts):
        kinds, cuts = features(texts[a:b])
        for k in range(b - a):
            each = np.concatenate([x[cuts[k] : cuts[k + 1]] for x in kinds])
            ix, c = np.unique(each, return_counts=True)
            xs.append((ix.astype(np.int32), (c / max(cuts[k + 1] - cuts[k], 1)).astype(np.float32)))
    y = np.array([v for _, v in rows], float)
    if not 0 < y.sum() < len(y):
        return Model(np.zeros(size, np.float32), 0.0)
    weigh = np.where(y == 1, len(y) / 2 / y.sum(), len(y) / 2 / (len(y) - y.sum()))
    rng = np.random.default_rng(0)
    for _ in range(epochs):
        for k in rng.permutation(len(xs)):
            ix, x = xs[k]
            zi, ni = z[ix], n[ix]
            w = np.where(np.abs(zi) > l1, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2), 0.0)
            w0 = -z0 / ((beta + n0**0.5) / alpha + l2)
            g = (1 / (1 + np.exp(-np.clip(w @ x + w0, -30, 30))) - y[k]) * weigh[k]
            gi = g * x
            z[ix] = zi + gi - (np.sqrt(ni + gi * gi) - np.sqrt(ni)) / alpha * w
            n[ix] = ni + gi * gi
            z0 += g - ((n0 + g * g) ** 0.5 - n0**0.5) / alpha * w0
            n0 += g * g
    w = np.where(np.abs(z) > l1, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2), 0.0)
    w0 = -z0 / ((beta + n0**0.5) / alpha + l2)
    share = min(max(share, 1e-3), 1 - 1e-3)
    return Model(w.astype(np.float32), float(w0 + np.log(share / (1 - share))))


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fits labels.quality on rows whose crc32(doc_id) mod 4 isn't 2."""
    learn = labels.filter(remainder(4) != 2)
    share = learn.agg(F.avg(F.col("quality").cast("double"))).first()[0]
    return fit(labelled(docs, learn, "quality", MOST, LONGEST), 0.5 if share is None else share)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """docs, all columns, and quality_score, from the whole text; null counts as empty.

    A column quality_score that docs has already is replaced.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS):
                b = whole.slice(at, ROWS)
                got = pa.array(held.value.scores(raw_texts(b.column("text"))))
                yield pa.RecordBatch.from_arrays([*b.columns, got], [*b.schema.names, "quality_score"])

    docs = docs.drop("quality_score")
    return docs.mapInArrow(run, docs.select("*", F.lit(0.0).alias("quality_score")).schema)


def keep_good(docs: DataFrame, model: Model, least: float = KEEP) -> DataFrame:
    """docs, all columns as they were (a quality_score too), with a score of `least` or more.  Null texts count as empty.

    A model that has learned from one label value alone, or from none, can't tell texts apart: everything stays.
    """
    if not model.weights.any():
        return docs
    packed = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), "text")
    return scored(packed, model).filter(F.col("quality_score") >= least).select("row.*")
