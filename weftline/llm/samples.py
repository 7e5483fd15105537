"""Bounded training samples, and features of many texts at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes of text turned into features at a time, but for a single longer text.
CHUNK = 1 << 20


def remainder(n: int) -> Column:
    """crc32 of doc_id as text, modulo n; a null doc_id counts as empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % n


def labelled(docs: DataFrame, labels: DataFrame, label: str, most: int, longest: int) -> list[tuple[str, int]]:
    """(text, label): of each label value 0 and 1, at most `most` rows of labels with their documents.

    Drawn in the order of a hash of doc_id, from texts of at most `longest` characters.  Callers
    filter labels; rows with a null doc_id, label or text don't count.
    """
    out: list[tuple[str, int]] = []
    for value in (0, 1):
        order = F.xxhash64("doc_id")
        drawn = labels.filter(F.col("doc_id").isNotNull() & (F.col(label) == value)).select("doc_id").distinct().orderBy(order, "doc_id").limit(most)
        # At most `most` ids are broadcast.
        rows = docs.select("doc_id", "text").filter(F.length("text") <= longest).join(F.broadcast(drawn), "doc_id")
        rows = rows.orderBy(order, "doc_id", "text").limit(most)
        out += [(r["text"], value) for r in rows.select("text").collect()]
    return out


def chunks(texts: list[bytes], most: int = CHUNK) -> Iterator[tuple[int, int]]:
    """(first, end) of runs of texts, of `most` bytes each or of one text."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) < most):
            size += len(texts[end])
            end += 1
        yield at, end
        at = end


def pieces(text: bytes, size: int) -> list[bytes]:
    """text in pieces of at most `size` bytes, each ending after a blank where there is one."""
    out, at = [], 0
    while len(text) - at > size:
        end = max(text.rfind(b, at + 1, at + size) for b in (b" ", b"\n")) + 1
        end = end if end > at + 1 else at + size
        out.append(text[at:end])
        at = end
    return [*out, text[at:]]


def raw_texts(column: pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.large_binary()).to_pylist()]


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, text starts and the end): each text with a NUL before and after it."""
    begin = np.cumsum([1, *(len(t) + 1 for t in texts)])
    return np.frombuffer(b"\0" + b"\0".join(texts) + b"\0", np.uint8), begin


def sums(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Sums of values[cuts[k]:cuts[k + 1]], 0 where that's empty."""
    total = np.concatenate(([0.0], np.cumsum(values, dtype=np.float64)))
    return total[cuts[1:]] - total[cuts[:-1]]
