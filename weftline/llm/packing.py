"""Best-fit packing with large-item matching.

The plan is a function of the lengths alone, and there are only as many lengths as a sequence
has tokens.  So the corpus is reduced to a count per length, the driver
plans kinds of sequences with how often each occurs, and pieces are
dealt to places by their rank among pieces of their length: no step holds the
documents together, and the plan's size depends on the capacity alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._work import Work
from .wordbpe import word_bpe

CAPACITY, END = 4096, 1


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """(how many sequences, [(length, how many), ...]) for counts of each length.

    Pieces over a third of the capacity go two to a sequence at most: from the longest on, each
    with the longest remaining one that fits beside it.  Then smaller pieces, longest
    first, each into the fullest sequence that has room, or into a new one.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    if any(n < 1 or n > capacity for n in left):
        raise ValueError("lengths must be from 1 to the capacity")
    gaps: dict[int, list[list]] = {}  # room -> [[sequences, content], ...]

    def put(room: int, n: int, content: list[tuple[int, int]]) -> None:
        if n:
            gaps.setdefault(room, []).append([n, content])

    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for n in large:
        while left.get(n):
            beside = next((m for m in large if m <= min(n, capacity - n) and left.get(m, 0) > (m == n)), None)
            if beside is None:
                put(capacity - n, left.pop(n), [(n, 1)])
            elif beside == n:
                put(capacity - 2 * n, left[n] // 2, [(n, 2)])
                left[n] %= 2
            else:
                k = min(left[n], left[beside])
                put(capacity - n - beside, k, [(n, 1), (beside, 1)])
                left[n] -= k
                left[beside] -= k
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        c = left[n]
        for room in sorted(r for r in gaps if r >= n):
            # A sequence with the least room takes as many as fit before the next is begun.
            each, groups = room // n, gaps.pop(room)
            while groups and c:
                size, content = groups.pop()
                full = min(size, c // each)
                put(room - each * n, full, [*content, (n, each)])
                c, size = c - full * each, size - full
                if size and c and c < each:
                    put(room - c * n, 1, [*content, (n, c)])
                    c, size = 0, size - 1
                if size:
                    groups.append([size, content])
                    if not c:
                        break
            if groups:
                gaps.setdefault(room, []).extend(groups)
            if not c:
                break
        each = capacity // n
        put(capacity - each * n, c // each, [(n, each)])
        if c % each:
            put(capacity - c % each * n, 1, [(n, c % each)])
    return [(n, content) for groups in gaps.values() for n, content in groups]


def places(planned: list[tuple[int, list[tuple[int, int]]]]) -> pd.DataFrame:
    """Rows length, rank, sequence, each, offset: pieces of the length from this rank on (up to the next row) go,
    `each` to a sequence, to the sequences from `sequence` on, the first of each at `offset`."""
    rows, used, first = [], {}, 0
    for n, content in planned:
        offset = 0
        for length, each in content:
            rows.append((length, used.get(length, 0), first, each, offset))
            used[length] = used.get(length, 0) + n * each
            offset += length * each
        first += n
    return pd.DataFrame(rows, columns=["length", "rank", "sequence", "each", "offset"]).sort_values(["length", "rank"], ignore_index=True).astype("int64")


def _pieces(tokenizer: str, capacity: int, end: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, bpe = TaskContext.get().partitionId(), word_bpe(tokenizer)
        seen: dict[int, int] = {}
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            doc, piece, start, length, crc, rank = [], [], [], [], [], []
            for at in range(0, len(texts), 512):
                for k, ids in enumerate(bpe.encode(texts[at : at + 512]), at):
                    raw = np.append(ids, end).astype("<u4")
                    for p, s in enumerate(range(0, len(raw), capacity)):
                        part = raw[s : s + capacity]
                        n = len(part)
                        doc.append(k)
                        piece.append(p)
                        start.append(s)
                        length.append(n)
                        crc.append(zlib.crc32(part))
                        rank.append(seen.get(n, 0))
                        seen[n] = rank[-1] + 1
            cols = [b.column("doc_id").take(pa.array(doc, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc)), pa.array([task] * len(doc), pa.int64()), pa.array(rank, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank"])

    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its ids and then `end`; only longer ones than the capacity are cut.  Null
    texts count as empty, and are one piece of one token.  doc_id may be null or repeated; each row
    is a document of its own.  An empty table gives an empty table.
    """
    spark = docs.sparkSession
    work = Work(spark, "pack")
    kind = docs.schema["doc_id"].dataType.simpleString()
    made = docs.select("doc_id", "text").mapInArrow(_pieces(tokenizer, capacity, end), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, task long, rank long")
    made = work.save(made, "pieces")
    # Ranks: a task numbers its own pieces of a length; a running sum over tasks does the rest.
    own = made.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    own = work.save(own.withColumn("before", F.coalesce(before, F.lit(0))), "ranks")
    counts = {r["length"]: r["n"] for r in own.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    if not counts:
        return made.select("doc_id", "piece", "start", "length", "ids_crc32", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    # At most `capacity` lengths: its size has a bound that the corpus doesn't move.
    table = places(plan(counts, capacity))
    key = table["length"].to_numpy() * (1 << 48) + table["rank"].to_numpy()
    held = spark.sparkContext.broadcast((key, *(table[c].to_numpy() for c in ("rank", "sequence", "each", "offset"))))

    @F.pandas_udf("sequence_id long, offset long")
    def placed(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        key, first, sequence, each, offset = held.value
        n, r = length.to_numpy(np.int64), rank.to_numpy(np.int64)
        i = np.searchsorted(key, n * (1 << 48) + r, side="right") - 1
        r = r - first[i]
        return pd.DataFrame({"sequence_id": sequence[i] + r // each[i], "offset": offset[i] + r % each[i] * n})

    # A row per length and task: as this grows with the corpus, it is dealt at every size.
    rows = made.join(own.select("length", "task", "before").hint("merge"), ["length", "task"])
    rows = rows.withColumn("x", placed("length", F.col("rank") + F.col("before")))
    return rows.select("doc_id", "piece", "start", "length", "ids_crc32", "x.sequence_id", "x.offset")


def lower_bound(counts: dict[int, int], capacity: int = CAPACITY) -> int:
    """Sequences that any packing needs at least: by total length, and by pieces of over half."""
    total = sum(n * c for n, c in counts.items())
    return max(-(-total // capacity), sum(c for n, c in counts.items() if 2 * n > capacity), *accumulate([0]))
