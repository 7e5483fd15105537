"""Word-level BPE ids in bulk, equal to what the `tokenizers` library gives for the same file.

The file's pipeline is: NFC, white space to blanks, lower case; pre-tokens by a pattern
(contractions, letter runs, single digits, runs of anything else); BPE on each pre-token's bytes
with an end-of-word mark.  No pre-token depends on another, so each distinct
one is encoded once per worker, and all of them at a time in numpy; texts are then assembled by
lookup, by hash first and then character by character.  Texts with characters whose treatment depends on Unicode versions or on
neighbours (outside PLAIN, or special tokens spelled out) go through the library itself.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from tokenizers import Tokenizer

#: Code point ranges, both ends included, that need no NFC and whose classes and lower case are settled.
PLAIN = ((0x00, 0x1B), (0x20, 0x12F), (0x132, 0x1C3), (0x1CD, 0x24F), (0x2010, 0x2027), (0x2030, 0x205E))
SPACES = (*range(0x09, 0x0E), 0x20, 0x85, 0xA0)
#: Pre-tokens kept per worker before the memory of them is begun anew.
KEPT = 1_500_000
#: Characters handled at a time.
CHUNK = 1 << 20
#: Longer pre-tokens go through the library.
LONGEST = 48
SLOT_BITS = 21

SPACE, LETTER, NUMBER, OTHER = range(4)
_END = np.uint64(0x9E3779B97F4A7C15)


def _byte_chars() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (b for b in range(256) if b not in shown)
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordBpe:
    def __init__(self, path: str):
        self.lib = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.special = [t["content"] for t in spec["added_tokens"]]
        chars = _byte_chars()
        self.inner = np.array([vocab[chars[b]] for b in range(256)], np.int64)
        self.last = np.array([vocab[chars[b] + "</w>"] for b in range(256)], np.int64)
        key = np.array([vocab[a] << 20 | vocab[b] for a, b in merges], np.int64)
        order = np.argsort(key)
        self.pair_key, self.pair_rank = np.append(key[order], np.iinfo(np.int64).max), np.append(order, len(order)).astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.none = len(merges)
        n = 0x2100
        self.kind = np.full(n, OTHER, np.uint8)
        self.plain = np.zeros(n, bool)
        for lo, hi in PLAIN:
            for c in range(lo, hi + 1):
                self.plain[c] = len(chr(c).lower()) == 1 and ord(chr(c).lower()) < n
        for c in range(n):
            self.kind[c] = {"L": LETTER, "N": NUMBER}.get(unicodedata.category(chr(c))[0], OTHER)
        self.kind[list(SPACES)] = SPACE
        rng = np.random.default_rng(20)
        self.mix = rng.integers(1, 1 << 63, n, np.uint64) | np.uint64(1)
        self.step = rng.integers(1, 1 << 63, LONGEST + 1, np.uint64) | np.uint64(1)
        self._forget()

    def _forget(self) -> None:
        self.hash = np.zeros(0, np.uint64)
        self.place = np.zeros(0, np.int64)  # of the hash, in at and n
        self.at, self.n, self.words = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), 0
        self.flat = np.zeros(1 << 16, np.uint16 if self.lib.get_vocab_size() <= 1 << 16 else np.uint32)
        self.used = 0
        # The pre-tokens themselves, side by side, and where each begins.
        self.spelt, self.spelt_at, self.spelt_used = np.zeros(1 << 16, np.uint16), np.zeros(1 << 12, np.int64), 0
        # A direct-mapped table before the sorted one.
        self.slot_hash = np.zeros(1 << SLOT_BITS, np.uint64)
        self.slot_place = np.zeros(1 << SLOT_BITS, np.int32)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 20 | b
        i = np.searchsorted(self.pair_key, key)
        return np.where(self.pair_key[i] == key, self.pair_rank[i], self.none)

    def merge_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, count of each) of pre-tokens given as UTF-8, at most LONGEST bytes each."""
        n = np.fromiter(map(len, words), np.int64, len(words))
        out = np.zeros(len(words), np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        raw = np.frombuffer(b"".join(words), np.uint8)
        begin = np.cumsum(n) - n
        edges = [0, 4, 8, 12, 16, 24, LONGEST]
        for lo, hi in zip(edges, edges[1:], strict=False):  # like lengths together
            rows = np.flatnonzero((n > lo) & (n <= hi))
            if not len(rows):
                continue
            col = np.arange(hi)
            inside = col < n[rows, None]
            sym = np.where(inside, self.inner[raw[np.minimum(begin[rows, None] + col, len(raw) - 1)]], -1)
            end = n[rows] - 1
            sym[np.arange(len(rows)), end] = self.last[raw[begin[rows] + end]]
            size = n[rows].copy()
            rank = np.full(sym.shape, self.none)
            pairs = inside[:, 1:]
            rank[:, :-1][pairs] = self._rank(sym[:, :-1][pairs], sym[:, 1:][pairs])
            live = np.arange(len(rows))
            full_sym, full_size = sym, size
            while len(live):
                j = rank.argmin(1)
                k = np.arange(len(live))
                best = rank[k, j]
                go = best < self.none
                if not go.all():
                    done = ~go
                    full_sym[live[done]], full_size[live[done]] = sym[done], size[done]
                    live, sym, rank, size, j, best = live[go], sym[go], rank[go], size[go], j[go], best[go]
                    k = np.arange(len(live))
                    if not len(live):
                        break
                after = col[None, :] > j[:, None]
                take = np.minimum(col + after, hi - 1)
                sym, rank = np.take_along_axis(sym, take, 1), np.take_along_axis(rank, take, 1)
                size -= 1
                sym[k, j] = self.merged[best]
                sym[k, size] = -1
                rank[k, size - 1] = self.none
                right = j < size - 1
                rank[k, j] = self.none
                rank[k[right], j[right]] = self._rank(sym[k[right], j[right]], sym[k[right], j[right] + 1])
                left = j > 0
                rank[k[left], j[left] - 1] = self._rank(sym[k[left], j[left] - 1], sym[k[left], j[left]])
            out[rows] = full_size
            parts.append((rows, full_sym))
        flat = np.zeros(int(out.sum()), np.int64)
        place = np.cumsum(out) - out
        for rows, sym in parts:
            inside = np.arange(sym.shape[1]) < out[rows, None]
            flat[(place[rows, None] + np.arange(sym.shape[1]))[inside]] = sym[inside]
        return flat, out

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        """Takes up pre-tokens; hashes are sorted and new."""
        raw = [w.encode() for w in words]
        short = np.array([len(w) <= LONGEST for w in raw])
        n = np.zeros(len(raw), np.int64)
        flat, counts = self.merge_words([w for w, s in zip(raw, short, strict=True) if s]) if short.any() else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        n[short] = counts
        if not short.all():
            long = {i: self.lib.encode(words[i], add_special_tokens=False).ids for i in np.flatnonzero(~short)}
            pieces, at = [], np.cumsum(counts) - counts
            it = iter(range(len(counts)))
            for i in range(len(raw)):
                if i in long:
                    n[i] = len(long[i])
                    pieces.append(np.array(long[i], np.int64))
                else:
                    k = next(it)
                    pieces.append(flat[at[k] : at[k] + counts[k]])
            flat = np.concatenate(pieces)
        while self.used + len(flat) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(flat)] = flat
        while self.words + len(n) > len(self.at):
            self.at, self.n, self.spelt_at = (np.concatenate([x, np.zeros_like(x)]) for x in (self.at, self.n, self.spelt_at))
        own = slice(self.words, self.words + len(n))
        self.at[own], self.n[own] = self.used + np.cumsum(n) - n, n
        chars = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.uint16)
        while self.spelt_used + len(chars) > len(self.spelt):
            self.spelt = np.concatenate([self.spelt, np.zeros_like(self.spelt)])
        self.spelt[self.spelt_used : self.spelt_used + len(chars)] = chars
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        self.spelt_at[own] = self.spelt_used + np.cumsum(sizes) - sizes
        self.spelt_used += len(chars)
        where = np.searchsorted(self.hash, hashes)
        self.hash = np.insert(self.hash, where, hashes)
        self.place = np.insert(self.place, where, np.arange(own.start, own.stop))
        self.words, self.used = own.stop, self.used + len(flat)

    def pretokens(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(kind array, starts, ends) of a lower-cased text of plain characters."""
        code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        kind = self.kind[code]
        start = np.empty(len(kind), bool)
        start[:1] = True
        np.not_equal(kind[1:], kind[:-1], out=start[1:])
        start |= kind == NUMBER
        quote = np.flatnonzero(code == 0x27)
        if len(quote):
            pad = np.concatenate([code, np.zeros(3, np.uint32)])
            a, b = pad[quote + 1], pad[quote + 2]
            one = np.isin(a, [ord(x) for x in "stmd"])
            two = (a == ord("r")) & (b == ord("e")) | (a == ord("v")) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
            ok = start[quote] & (one | two)
            q, n = quote[ok], np.where(one[ok], 1, 2)
            start[q + 1] = False
            cut = q + 1 + n
            cut = cut[cut < len(start)]
            start[cut] = True
        bound = np.flatnonzero(start)
        ends = np.append(bound[1:], len(kind))
        word = kind[bound] != SPACE
        return code, bound[word], ends[word]

    def _lookup(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place of each pre-token in the store, its start, the numbers of pre-tokens that only share a hash with what is stored there)."""
        code, starts, ends = self.pretokens(text)
        if not len(starts):
            return np.zeros(0, np.int64), starts, starts
        n = ends - starts
        value = self.mix[code]
        begin = starts if starts[0] == 0 else np.concatenate(([0], starts))
        inside = np.arange(len(code)) - np.repeat(begin, np.diff(np.append(begin, len(code))))
        value *= self.step[np.minimum(inside, LONGEST)]
        value ^= value >> np.uint64(29)
        sums = np.cumsum(value, dtype=np.uint64)
        h = sums[ends - 1] - sums[starts] + value[starts] + n.astype(np.uint64) * _END
        h ^= h >> np.uint64(32)
        for i in np.flatnonzero(n > LONGEST):  # beyond the table of steps
            h[i] = np.uint64(int.from_bytes(hashlib.blake2b(text[starts[i] : ends[i]].encode(), digest_size=8).digest(), "little"))
        if len(self.hash) > KEPT:
            self._forget()
        slot = (h >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        entry = self.slot_place[slot].astype(np.int64)
        miss = np.flatnonzero((self.slot_hash[slot] != h) | (h == 0))
        if len(miss):
            found, first, back = np.unique(h[miss], return_index=True, return_inverse=True)
            i = np.minimum(np.searchsorted(self.hash, found), max(len(self.hash) - 1, 0))
            new = self.hash[i] != found if len(self.hash) else np.ones(len(found), bool)
            if new.any():
                f = miss[first[new]]
                self._learn(found[new], [text[s:e] for s, e in zip(starts[f].tolist(), ends[f].tolist(), strict=True)])
                i = np.searchsorted(self.hash, found)
            entry[miss] = self.place[i][back]
            self.slot_hash[slot[miss]], self.slot_place[slot[miss]] = h[miss], entry[miss]
        ends_at = np.cumsum(n)
        inside = np.arange(ends_at[-1]) - np.repeat(ends_at - n, n)
        # Beyond the stored characters lies another pre-token, or nothing.
        stored = np.minimum(np.repeat(self.spelt_at[entry], n) + inside, len(self.spelt) - 1)
        other = self.spelt[stored] != code[np.repeat(starts, n) + inside]
        return entry, starts, np.unique(np.searchsorted(ends_at, np.flatnonzero(other), side="right")) if other.any() else starts[:0]

    def _is_plain(self, text: str) -> bool:
        if text.isascii():
            ok = not any(c in text for c in "\x1c\x1d\x1e\x1f")
        else:
            code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
            ok = code.max() < len(self.plain) and bool(self.plain[code].all())
        return ok and not any(s in text for s in self.special)

    def _groups(self, texts: list[str]) -> Iterator[tuple[list[int], np.ndarray, np.ndarray, np.ndarray, list[str]]]:
        """Of the plain texts, some at a time: (which, places in the store, starts, where each begins, the texts).

        A text longer than CHUNK comes in pieces that end after a blank, as no pre-token has one inside.  Pieces in which a
        pre-token has another one's hash are left to the library: their place is the number -1.
        """
        parts = [(k, x) for k, t in enumerate(texts) if self._is_plain(t) for x in self._pieces(t)]
        at = 0
        while at < len(parts):
            ks, size, first = [], 0, at
            while at < len(parts) and (not ks or size + len(parts[at][1]) <= CHUNK):
                ks.append(parts[at][0])
                size += len(parts[at][1]) + 1
                at += 1
            some = [x for _, x in parts[first:at]]
            begin = np.cumsum([0, *(len(x) + 1 for x in some)])
            place, starts, wrong = self._lookup("\n".join(x.lower() for x in some))
            place[wrong] = -1
            yield ks, place, starts, begin, some

    @staticmethod
    def _pieces(text: str) -> list[str]:
        out, at = [], 0
        while len(text) - at > CHUNK:
            end = max(text.rfind(" ", at, at + CHUNK), text.rfind("\n", at, at + CHUNK)) + 1
            if end <= at:
                break
            out.append(text[at:end])
            at = end
        return [*out, text[at:]]

    def pretoken_counts(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """(starts, token counts) of each text's pre-tokens; None for texts that aren't plain."""
        got: dict[int, list] = {}
        for ks, i, starts, begin, some in self._groups(texts):
            n, cut = self.n[i], np.searchsorted(starts, begin)
            for k in np.flatnonzero(i < 0):
                j = np.searchsorted(begin, starts[k], side="right") - 1
                word = self.pretoken_at(some[j].lower(), int(starts[k] - begin[j]))
                n[k] = len(self.lib.encode(word, add_special_tokens=False).ids)
            for j, k in enumerate(ks):
                done = got.setdefault(k, [0, [], []])
                done[1].append(starts[cut[j] : cut[j + 1]] - begin[j] + done[0])
                done[2].append(n[cut[j] : cut[j + 1]])
                done[0] += len(some[j])
        return [(np.concatenate(got[k][1]), np.concatenate(got[k][2])) if k in got else None for k in range(len(texts))]

    def pretoken_at(self, text: str, start: int) -> str:
        """The pre-token of a lower-cased plain text that begins there."""
        _, starts, ends = self.pretokens(text)
        return text[start : int(ends[np.searchsorted(starts, start)])]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, without special tokens, as unsigned integers."""
        got: dict[int, list[np.ndarray]] = {}
        for ks, i, starts, begin, some in self._groups(texts):
            n, place = np.where(i < 0, 0, self.n[i]), self.at[i]
            ends = np.cumsum(n)
            ids = self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(place - (ends - n), n)]
            cut = np.searchsorted(starts, begin)
            at = np.concatenate(([0], ends))[cut]
            wrong = set(np.searchsorted(begin, starts[i < 0], side="right") - 1)
            for j, k in enumerate(ks):
                own = self._by_library(some[j]) if j in wrong else ids[at[j] : at[j + 1]]
                got.setdefault(k, []).append(own)
        return [np.concatenate(got[k]) if k in got else self._by_library(t) for k, t in enumerate(texts)]

    def _by_library(self, text: str) -> np.ndarray:
        return np.array(self.lib.encode(text, add_special_tokens=False).ids, np.uint32)


@lru_cache(maxsize=2)
def word_bpe(path: str) -> WordBpe:
    """One per worker process and file."""
    return WordBpe(path)
