"""Language identification by prediction by partial matching (PPM).

Each language has a tree of byte contexts up to ORDER bytes, from a bounded training sample.  A
context predicts the bytes it has been followed by, and otherwise escapes to the context one byte
shorter, down to equal chances of all 256 bytes (method C, with exclusion, so that the
probabilities of a context add up to one).  After training the statistics are frozen, and a text's
code length under each language is exact.  The language with the shortest code wins.

Nothing of a tree is pruned.  Per order, a table has every (context, next byte) that any language of a group of GROUP has shown, with its code
length in each of them, and every context with the length of its escape; a byte is looked up from the longest context on, and
what it escapes through is added up.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .samples import CHUNK, chunks, raw_texts, remainder

ORDER = 3
#: Training texts per language, and the longest of them in characters.
MOST, LONGEST = 400, 20_000
#: Languages in one table, and for how many all training texts have room; of more languages, each gets fewer characters.
GROUP, ROOM = 4, 64
UNKNOWN = "und"


class Table:
    """Rows of numbers by 32-bit key, found by hash; keys must differ."""

    def __init__(self, keys: np.ndarray, rows: np.ndarray):
        self.shift = np.uint32(max(1, 30 - max(len(keys), 1).bit_length()))
        at = self._slot(keys)
        order = np.argsort(at, kind="stable")
        self.keys, self.rows = keys[order], rows[order]
        n = (1 << (32 - int(self.shift))) + 1
        self.begin = np.searchsorted(at[order], np.arange(n)).astype(np.int32)
        self.depth = int(np.diff(self.begin).max(initial=0))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        h = keys * np.uint32(0x9E3779B1)
        return (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA77) >> self.shift

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row number of each key, -1 where there's none."""
        slot = self._slot(keys)
        at, end = self.begin[slot], self.begin[slot + 1]
        out = np.full(len(keys), -1, np.int32)
        if not len(self.keys):
            return out
        first = self.keys[np.minimum(at, len(self.keys) - 1)]
        hit = (at < end) & (first == keys)
        out[hit] = at[hit]
        left = np.flatnonzero(~hit & (at + 1 < end))
        for _ in range(1, self.depth):
            if not len(left):
                break
            at[left] += 1
            hit = self.keys[at[left]] == keys[left]
            out[left[hit]] = at[left[hit]]
            left = left[~hit]
            left = left[at[left] + 1 < end[left]]
        return out


@dataclass
class Model:
    languages: list[str]
    known: list[Table]  # by order: (context, next) -> bits of each language
    escapes: list[Table]  # by order: context -> bits of each language

    def bits(self, code: np.ndarray) -> np.ndarray:
        """Code lengths, byte x language, of codes that hold the last ORDER bytes and then the byte itself."""
        out = np.zeros((len(code), len(self.languages)), np.float32)
        left = np.arange(len(code))
        for k in range(len(self.known) - 1, -1, -1):
            mine = code[left] & np.uint32((1 << 8 * (k + 1)) - 1)
            at = self.known[k].find(mine)
            hit = at >= 0
            out[left[hit]] += self.known[k].rows[at[hit]]
            left, mine = left[~hit], mine[~hit]
            if not len(left):
                break
            at = self.escapes[k].find(mine >> np.uint32(8))
            out[left[at >= 0]] += self.escapes[k].rows[at[at >= 0]]
        return out

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        """Code lengths in bits, text x language.  Long texts are summed by pieces."""
        out = np.zeros((len(texts), len(self.languages)))
        for a, b in chunks(texts):
            if b - a == 1 and len(texts[a]) > CHUNK:
                for at in range(0, len(texts[a]), CHUNK):
                    out[a] += self._sums([texts[a][at : at + CHUNK]], texts[a][max(0, at - ORDER) : at])[0]
            else:
                out[a:b] = self._sums(texts[a:b])
        return out

    def _sums(self, texts: list[bytes], before: bytes = b"") -> np.ndarray:
        code, begin = codes(texts, before)
        bits = self.bits(code)
        total = np.concatenate([np.zeros((1, bits.shape[1])), np.cumsum(bits, 0, dtype=np.float64)])
        ends = begin + np.fromiter(map(len, texts), np.int64, len(texts))
        return total[ends] - total[begin]

    def predict(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(language index, score): the share of the winner's probability, languages being equally likely."""
        bits = self.lengths(texts)
        best = bits.argmin(1)
        return best, 1 / np.exp2(np.minimum(bits.min(1, keepdims=True) - bits, 0)).sum(1)


class Models(Model):
    """Models of further languages side by side."""

    def __init__(self, parts: list[Model]):
        self.parts, self.languages = parts, [x for p in parts for x in p.languages]

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        return np.hstack([p.lengths(texts) for p in self.parts])


def codes(texts: list[bytes], before: bytes = b"") -> tuple[np.ndarray, np.ndarray]:
    """(each byte behind the ORDER bytes before it as one number, where each text begins).

    Zero bytes stand before a text's beginning, or else `before`.
    """
    gap = b"\0" * ORDER
    raw = np.frombuffer((gap + before)[-ORDER:] + b"".join(t + gap for t in texts), np.uint8).astype(np.uint32)
    n = len(raw) - ORDER
    code = np.zeros(n, np.uint32)
    for k in range(ORDER + 1):
        code |= raw[k : k + n] << np.uint32(8 * (ORDER - k))
    sizes = np.fromiter((len(t) + ORDER for t in texts), np.int64, len(texts))
    return code, np.cumsum(sizes) - sizes


def fit(samples: dict[str, list[bytes]]) -> Model:
    """The model of samples by language; languages in sorted order, which breaks ties."""
    languages = sorted(samples)
    if len(languages) > GROUP:
        return Models([fit({k: samples[k] for k in languages[i : i + GROUP]}) for i in range(0, len(languages), GROUP)])
    counts = []  # language: (codes, how often)
    for lang in languages:
        code, begin = codes(samples[lang])
        inside = np.zeros(len(code) + 1, np.int64)
        np.add.at(inside, begin, 1)
        np.add.at(inside, begin + np.fromiter(map(len, samples[lang]), np.int64, len(begin)), -1)
        counts.append(np.unique(code[np.cumsum(inside[:-1]) > 0], return_counts=True))
    known, escapes, lower_keys, lower = [], [], None, None
    for k in range(ORDER + 1):
        own = [_totals(c & np.uint32((1 << 8 * (k + 1)) - 1), n) for c, n in counts]
        keys = np.unique(np.concatenate([c for c, _ in own]))
        prob = np.empty((len(keys), len(languages)))
        contexts = np.unique(keys >> np.uint32(8))
        escape = np.zeros((len(contexts), len(languages)), np.float32)
        for g, (c, n) in enumerate(own):
            shorter = keys & np.uint32((1 << 8 * k) - 1)
            below = np.full(len(keys), 1 / 256) if k == 0 else lower[np.searchsorted(lower_keys, shorter), g]
            ctx, first = np.unique(c >> np.uint32(8), return_index=True)
            at = np.searchsorted(keys, c)
            total, who = np.add.reduceat(n, first), np.diff(np.append(first, len(c)))
            left = 1 - np.add.reduceat(below[at], first)
            full = left <= 1e-12  # every byte has been seen: nothing to escape to
            factor = np.where(full, 1.0, who / (total + who) / np.where(full, 1.0, left))
            i = np.searchsorted(ctx, keys >> np.uint32(8))
            seen_ctx = ctx[np.minimum(i, len(ctx) - 1)] == keys >> np.uint32(8)
            prob[:, g] = below * np.where(seen_ctx, factor[np.minimum(i, len(ctx) - 1)], 1.0)
            j = np.repeat(np.arange(len(ctx)), who)
            prob[at, g] = n / np.where(full, total, total + who)[j]
            escape[np.searchsorted(contexts, ctx), g] = -np.log2(factor)
        known.append(Table(keys, -np.log2(prob).astype(np.float32)))
        escapes.append(Table(contexts, escape))
        lower_keys, lower = keys, prob
        if k == 0:  # below everything, equal chances: all bytes are known at order 0
            missing = np.setdiff1d(np.arange(256, dtype=np.uint32), keys)
            rest = np.repeat(escape + 8, len(missing), 0) if len(contexts) else np.zeros((0, len(languages)), np.float32)
            known[0] = Table(np.concatenate([keys, missing]), np.concatenate([-np.log2(prob), rest]).astype(np.float32))
    return Model(languages, known, escapes)


def _totals(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    got, back = np.unique(keys, return_inverse=True)
    return got, np.bincount(back, n).astype(np.int64)


def train(docs: DataFrame, most: int = MOST, longest: int = LONGEST) -> Model | None:
    """Learns from text and lang of rows whose lang isn't null and crc32(doc_id) mod 4 isn't 2.

    Every language that has a text is learned.  `most` texts of at most `longest` characters are drawn in the order of a hash;
    of a language that has longer ones only, their first `longest` characters.  None if there is no such row.
    """
    rows = docs.filter(F.col("lang").isNotNull() & (remainder(4) != 2) & (F.length("text") > 0))
    short = F.length("text") <= longest
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if(short).alias("short")).collect()
    if not counts:
        return None
    # A drawn share of twice what's needed, then the first of each language.
    reach = 1 << 30
    share = F.create_map(*[x for r in counts for x in (F.lit(r["lang"]), F.lit(min(reach, max(2 * most, most + 50) * reach // (r["short"] or r["n"]))))])
    long = [r["lang"] for r in counts if not r["short"]]
    usable = rows.filter(short | F.col("lang").isin(long)).withColumn("text", F.substring("text", 1, longest)) if long else rows.filter(short)
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(reach))
    drawn = usable.select("doc_id", "lang", "text", draw.alias("draw")).filter(F.col("draw") < F.element_at(share, F.col("lang")))
    order = Window.partitionBy("lang").orderBy("draw", "doc_id", "text")
    first = drawn.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= most)
    if len(counts) > ROOM:
        before = F.sum(F.length("text")).over(order.rowsBetween(Window.unboundedPreceding, -1))
        first = first.withColumn("before", before).filter(F.coalesce("before", F.lit(0)) < most * longest * ROOM // len(counts))
    got = first.select("lang", "text").collect()
    samples: dict[str, list[bytes]] = {}
    for r in got:
        samples.setdefault(r["lang"], []).append(r["text"].encode())
    return fit({k: sorted(v) for k, v in samples.items()})


def predicted(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs, all columns, and lang_pred and lang_score, from the whole text.

    Null texts, texts without a letter, and all texts where nothing could be learned are `und` with score 0.
    Columns lang_pred and lang_score that docs has already are replaced.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m, ok = held.value, b.column("__letter").to_pylist()
            if m is None:
                lang, score = [UNKNOWN] * len(ok), np.zeros(len(ok))
            else:
                best, score = m.predict(raw_texts(b.column("text")))
                lang = [m.languages[i] if k else UNKNOWN for i, k in zip(best, ok, strict=True)]
                score = np.where(np.array(ok, bool), score, 0.0)
            keep = [n for n in b.schema.names if n != "__letter"]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in keep), pa.array(lang, pa.string()), pa.array(score)], [*keep, "lang_pred", "lang_score"])

    docs = docs.drop("lang_pred", "lang_score")
    out = docs.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("lang_score")).schema
    return docs.withColumn("__letter", F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))).mapInArrow(run, out)
