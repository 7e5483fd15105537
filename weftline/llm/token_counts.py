"""Token counts that follow edits without encoding whole texts anew.

A document keeps a segment tree over its pre-tokens: a leaf is a run of some pre-tokens, with its characters and
its tokens, and inner nodes hold sums.  An edit finds the leaves it touches by descending on
characters, encodes those again with CONTEXT characters on either side (whole leaves, as
pre-token boundaries look that far at most), and updates the sums above them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .wordbpe import WordBpe, word_bpe

#: Pre-tokens in a leaf, and characters on either side of an edit that boundaries may depend on.
LEAF, CONTEXT = 32, 4


class Tree:
    """Sums of (characters, tokens) over leaves."""

    def __init__(self, chars: np.ndarray, tokens: np.ndarray):
        n = 1 << max(0, (len(chars) - 1).bit_length())
        self.n, self.leaves = n, len(chars)
        self.sums = np.zeros((2 * n, 2), np.int64)
        self.sums[n : n + len(chars), 0], self.sums[n : n + len(chars), 1] = chars, tokens
        while n > 1:
            n //= 2
            self.sums[n : 2 * n] = self.sums[2 * n : 4 * n : 2] + self.sums[2 * n + 1 : 4 * n : 2]

    @property
    def chars(self) -> int:
        return int(self.sums[1, 0])

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    def find(self, at: int) -> tuple[int, int]:
        """(leaf that holds the character at `at`, its first character); the last leaf with characters from the end on."""
        at = max(0, min(at, self.chars - 1))
        k, begin = 1, 0
        while k < self.n:
            k *= 2
            if at - begin >= self.sums[k, 0]:
                begin += int(self.sums[k, 0])
                k += 1
        return k - self.n, begin

    def set(self, leaf: int, chars: int, tokens: int) -> None:
        k = leaf + self.n
        delta = np.array([chars, tokens]) - self.sums[k]
        while k:
            self.sums[k] += delta
            k //= 2


def build(bpe: WordBpe, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(characters, tokens) of each text's leaves; a text that the library must encode whole is one leaf."""
    out = []
    for text, got in zip(texts, bpe.pretoken_counts(texts), strict=True):
        if got is None:
            out.append((np.array([len(text)]), np.array([len(bpe.lib.encode(text, add_special_tokens=False).ids)])))
        elif not len(got[0]):
            out.append((np.array([len(text)]), np.array([0])))
        else:
            starts, counts = got
            first = starts[::LEAF].copy()
            first[0] = 0
            out.append((np.diff(np.append(first, len(text))), np.add.reduceat(counts, np.arange(0, len(counts), LEAF))))
    return out


def edit_all(bpe: WordBpe, trees: list[Tree], texts: list[str], edits: list[list[tuple[int, int, str]]]) -> list[int]:
    """Applies each text's edits (at, removed, inserted) in order, to trees and texts in place; characters encoded per text.

    The first edits of all texts are encoded together, then the second ones, and so on.
    """
    work = [0] * len(texts)
    for nth in range(max(map(len, edits), default=0)):
        parts, where, whole = [], [], []
        for k, todo in enumerate(edits):
            if len(todo) <= nth:
                continue
            tree, text, (at, removed, inserted) = trees[k], texts[k], todo[nth]
            at = max(0, min(at, len(text)))
            removed = max(0, min(removed, len(text) - at))
            texts[k] = new = text[:at] + inserted + text[at + removed :]
            near = new[max(0, at - 64) : at + len(inserted) + 64]
            if tree.leaves == 1 or any(s in near for s in bpe.special):
                whole.append(k)
                continue
            first, begin = tree.find(at - CONTEXT)
            last, last_begin = tree.find(at + removed + CONTEXT)
            end = last_begin + int(tree.sums[last + tree.n, 0])
            parts.append(new[begin : end + len(inserted) - removed])
            where.append((k, first, last))
        for (k, first, last), part, ids in zip(where, parts, bpe.encode(parts), strict=True):
            for leaf in range(first + 1, last + 1):
                trees[k].set(leaf, 0, 0)
            trees[k].set(first, len(part), len(ids))
            work[k] += len(part)
        for k, leaves in zip(whole, build(bpe, [texts[k] for k in whole]), strict=True):
            trees[k] = Tree(*leaves)
            work[k] += len(texts[k])
    return work


def edit(bpe: WordBpe, tree: Tree, text: str, at: int, removed: int, inserted: str) -> tuple[Tree, str, int]:
    """(tree, new text, characters encoded) after text[at:at + removed] becomes inserted; the tree is changed in place."""
    trees, texts = [tree], [text]
    work = edit_all(bpe, trees, texts, [[(at, removed, inserted)]])
    return trees[0], texts[0], work[0]


def _run(tokenizer: str, kept: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(tokenizer)
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            edits = b.column("edits").to_pylist()
            old = b.column("tree").to_pylist() if kept else [None] * len(texts)
            # A tree that isn't the text's (of another length, or half missing) is built anew.
            fits = [x is not None and None not in x.values() and len(x["leaf_chars"]) == len(x["leaf_tokens"]) > 0 and sum(x["leaf_chars"]) == len(t) for x, t in zip(old, texts, strict=True)]
            missing = [k for k, ok in enumerate(fits) if not ok]
            made = iter([x for k in range(0, len(missing), 256) for x in build(bpe, [texts[i] for i in missing[k : k + 256]])])
            leaves = [(np.array(x["leaf_chars"]), np.array(x["leaf_tokens"])) if ok else next(made) for x, ok in zip(old, fits, strict=True)]
            trees = [Tree(c, t) for c, t in leaves]
            before = [t.tokens for t in trees]
            encoded = edit_all(bpe, trees, texts, [[(e["at"] or 0, e["removed"] or 0, e["inserted"] or "") for e in todo or [] if e] for todo in edits])
            after, news = [t.tokens for t in trees], [len(t) for t in texts]
            own = [t.sums[t.n : t.n + t.leaves] for t in trees]
            chars, tokens = [x[:, 0].tolist() for x in own], [x[:, 1].tolist() for x in own]
            cols = [b.column("doc_id"), *(pa.array(x, pa.int64()) for x in (before, after, news, encoded)), pa.array(chars, pa.list_(pa.int32())), pa.array(tokens, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "tokens", "tokens_after", "chars_after", "chars_encoded", "leaf_chars", "leaf_tokens"])

    return run


def token_counts(docs: DataFrame, tokenizer: str, edits: Column | str | None = None, tree: Column | str | None = None) -> DataFrame:
    """One row per input row: doc_id, tokens, tokens_after, chars_after, chars_encoded, leaf_chars, leaf_tokens.

    edits is array<struct<at, removed, inserted>> (characters; applied in order, each to the text that the ones before have left; places
    beyond the text are moved to its end); tree is struct<leaf_chars, leaf_tokens> of the text from an earlier run, used rather
    than built, but where it is null or not as long as the text.  Both are arguments, so that docs may have columns of any names, which
    aren't read.  Null texts count as empty; null edits are none.  An empty table gives an empty table.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    none = F.array().cast("array<struct<at:int,removed:int,inserted:string>>")
    named = lambda c: F.col(c) if isinstance(c, str) else c
    src = docs.select("doc_id", "text", (none if edits is None else named(edits)).alias("edits"), *([] if tree is None else [named(tree).alias("tree")]))
    out = f"doc_id {kind}, tokens long, tokens_after long, chars_after long, chars_encoded long, leaf_chars array<int>, leaf_tokens array<int>"
    return src.mapInArrow(_run(tokenizer, tree is not None), out)
