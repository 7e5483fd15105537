"""Exact duplicates by deterministic block naming.

Each text is cut into blocks of a fixed number of bytes.  Equal blocks get one
integer name, by sorting the blocks; then adjacent names are paired and the
pairs named in the same way, level by level, until every document is one
integer.  Contents are compared at every level, never digests, so two documents
get one identity if and only if their bytes are the same.

Each task first names its own distinct blocks, so that the shuffle holds a
block at most once per task however many documents repeat it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._work import Work, salt_of

BLOCK_BYTES = 2048
#: Bytes of distinct blocks that a task holds before it begins a new local dictionary.
LOCAL_BYTES = 32 << 20
#: Sort buckets: names are (rank within the bucket, bucket).
BUCKETS = 1 << 16

_LOCAL = "part long, ix int, block binary, row long, doc_id {kind}, sha binary, ixs array<int>"


def _local_names(block_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, epoch, row = TaskContext.get().partitionId(), 0, 0
        names: dict[bytes, int] = {}
        held = 0
        for batch in batches:
            new: list[bytes] = []
            rows, first, part = [], len(names), (task << 24) + epoch
            for text in batch.column("text").cast(pa.large_binary()).to_pylist():
                text = text or b""
                ixs = []
                for at in range(0, max(len(text), 1), block_bytes):
                    block = text[at : at + block_bytes]
                    ix = names.get(block)
                    if ix is None:
                        ix = names[block] = len(names)
                        new.append(block)
                        held += len(block)
                    ixs.append(ix)
                rows.append(ixs)
            n, m = len(new), len(rows)
            lists = pa.array(rows, pa.list_(pa.int32()))
            cols = {
                "part": pa.array([part] * (n + m), pa.int64()),
                "ix": pa.concat_arrays([pa.array(range(first, first + n), pa.int32()), pa.nulls(m, pa.int32())]),
                "block": pa.concat_arrays([pa.array(new, pa.binary()), pa.nulls(m, pa.binary())]),
                "row": pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(range(row, row + m), pa.int64())]),
                "doc_id": pa.concat_arrays([pa.nulls(n, batch.column("doc_id").type), batch.column("doc_id")]),
                "sha": pa.concat_arrays([pa.nulls(n, pa.binary()), batch.column("sha").cast(pa.binary())]),
                "ixs": pa.concat_arrays([pa.nulls(n, lists.type), lists]),
            }
            row += m
            yield pa.RecordBatch.from_pydict(cols)
            if held > LOCAL_BYTES:
                names, held, epoch = {}, 0, epoch + 1

    return run


def _named(df: DataFrame, keys: list[str], carried: list[str]) -> DataFrame:
    """The carried columns and name: the rank of the keys among the distinct keys of a sort bucket, and the bucket.

    Rows are dealt by bucket once; of a hot key the carried columns alone are held together.
    """
    bucket = F.pmod(F.xxhash64(*keys), F.lit(BUCKETS))
    each = df.withColumn("bucket", bucket).repartition("bucket").groupBy("bucket", *keys).agg(F.collect_list(F.struct(*carried)).alias("at"))
    rank = F.row_number().over(Window.partitionBy("bucket").orderBy(*keys)).cast("long")
    named = each.withColumn("name", rank * BUCKETS + F.col("bucket"))
    return named.select("name", F.explode("at").alias("x"), *keys).select("name", "x.*", *keys)


def _paired(work: Work, seq: DataFrame) -> DataFrame:
    """One level: each sequence of names becomes the sequence of its pairs' names."""
    pairs = F.transform(
        F.sequence(F.lit(0), ((F.size("names") + 1) / 2).cast("int") - 1),
        lambda i: F.struct(F.get("names", i * 2).alias("a"), F.coalesce(F.get("names", i * 2 + 1), F.lit(-1)).alias("b")),
    )
    ex = seq.select("part", "row", "blocks", salt_of("part", "row").alias("salt"), F.posexplode(pairs).alias("pos", "pair"))
    ex = ex.select("part", "row", "blocks", "salt", "pos", "pair.a", "pair.b")
    named = _named(ex.select("a", "b", "salt").distinct(), ["a", "b"], ["salt"])
    return _gathered(ex.join(named, ["a", "b", "salt"]))


def _gathered(df: DataFrame) -> DataFrame:
    got = df.groupBy("part", "row", "blocks").agg(F.sort_array(F.collect_list(F.struct("pos", "name"))).alias("x"))
    return got.select("part", "row", "blocks", F.col("x.name").alias("names"))


def identities(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, sha (binary SHA-256 of the text), part and row (the input row), and
    the identity (blocks, name), equal for equal texts alone.

    Null texts count as empty; doc_id may be null or repeated; other columns are not read.
    An empty table gives an empty table.
    """
    work = Work(docs.sparkSession, "exact")
    kind = docs.schema["doc_id"].dataType.simpleString()
    src = docs.select("doc_id", "text", F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)).alias("sha"))
    local = work.save(src.mapInArrow(_local_names(block_bytes), _LOCAL.format(kind=kind)), "local")
    rows = local.filter("row is not null").select("part", "row", "doc_id", "sha", "ixs")
    names = _named(local.filter("row is null").select("part", "ix", "block"), ["block"], ["part", "ix"]).select("part", "ix", "name")
    ex = rows.select("part", "row", F.size("ixs").alias("blocks"), F.posexplode("ixs").alias("pos", "ix"))
    seq = work.save(_gathered(ex.join(names, ["part", "ix"]).drop("ix")), "level0")
    rows = work.save(rows.drop("ixs"), "rows")
    work.drop("local")
    done = [seq.filter("blocks = 1")]
    level, longest = 0, seq.agg(F.max("blocks")).first()[0] or 0
    while longest > 1:
        level, longest = level + 1, (longest + 1) // 2
        seq = work.save(_paired(work, seq.filter("size(names) > 1")), f"level{level}")
        done.append(seq.filter("size(names) = 1"))
    found = done[0]
    for x in done[1:]:
        found = found.unionByName(x)
    found = found.select("part", "row", "blocks", F.get("names", F.lit(0)).alias("name"))
    return work.save(rows.join(found, ["part", "row"]), "identities")


def exact_groups(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, sha.

    Of equal texts the row with the largest doc_id stays (null is the smallest); of
    repeated rows with that doc_id, one.
    """
    work = Work(docs.sparkSession, "exact-groups")
    rows = identities(docs, block_bytes)
    groups = rows.groupBy("blocks", "name").agg(F.max(F.struct("doc_id", "part", "row")).alias("keep"), F.count(F.lit(1)).alias("group_size"))
    # Both sides of this join are written tables dealt by the identity, so that a
    # group with a third of the rows is split at run time.
    groups = work.save(groups, "groups")
    kept = (F.col("keep.part") == F.col("part")) & (F.col("keep.row") == F.col("row"))
    return rows.join(groups, ["blocks", "name"]).select("doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", kept.alias("kept"), "sha")


def drop_exact_copies(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs, all columns, without the rows whose text another kept row has."""
    from .decisions import keep_rows

    verdicts = exact_groups(docs, block_bytes).select("doc_id", "sha", F.col("kept").alias("keep"))
    return keep_rows(docs, verdicts)
