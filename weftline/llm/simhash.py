"""SimHash near-duplicates by covering locality-sensitive hashing.

Radius r needs 2^(r+1) - 1 tables.  Every bit position i carries a vector a(i) of r+1
bits, not all zero; the table of a vector v keeps the bits with a(i).v odd.  If two
fingerprints differ at r positions at most, r equations a(i).v = 0 have a common
solution v other than zero, and in its table both have the same key.  So no pair
within the radius is missed, and each table keeps over half of the bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._work import Work, salt_of
from .components import connected
from .decisions import keep_rows, text_sha

SHINGLE, SEED, RADIUS = 3, 42, 2
#: Buckets of at most so many fingerprints are compared pair by pair; larger ones by midpoints.
SMALL = 24


def fingerprint(text: str | bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """64 bits, each 1 if set in over half of the shingles' XXH64 values; 0 without words.

    A-Z is lower-cased; words are runs without ASCII white space.
    """
    raw = text.encode() if isinstance(text, str) else text or b""
    words = raw.lower().split()  # bytes: ASCII only, in both steps
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), seed)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - shingle + 1].tolist()
    digest = xxhash.xxh64_digest
    total, n = np.zeros(64, np.int64), len(starts)
    ends = ends[shingle - 1 :].tolist()
    for at in range(0, n, 1 << 16):  # bounded memory for very long texts
        h = b"".join([digest(joined[s:e], seed) for s, e in zip(starts[at : at + (1 << 16)], ends[at : at + (1 << 16)], strict=True)])
        total += np.unpackbits(np.frombuffer(h, np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > n).tobytes(), "big")


def _fingerprints(shingle: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [fingerprint(x, shingle, seed) for x in b.column("text").cast(pa.large_binary()).to_pylist()]
            fp = pa.array(np.array(got, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("sha"), fp], ["doc_id", "sha", "fp"])

    return run


def covering_masks(radius: int = RADIUS, bits: int = 64) -> list[int]:
    """The bits that each table keeps; a(i) runs through the vectors other than zero in turn."""
    n = (1 << (radius + 1)) - 1
    return [sum(1 << i for i in range(bits) if bin((i % n + 1) & v).count("1") % 2) for v in range(1, n + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _distance(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def links(fps: DataFrame, radius: int = RADIUS, small: int = SMALL) -> DataFrame:
    """a, b: links between distinct fingerprints (column fp) at no more than radius bits,
    radius 1 or 2, such that any two within the radius are connected.

    Of a table's bucket with a few fingerprints all pairs are compared.  In a larger one each
    fingerprint is put beside every value that differs in one of the bits which the table
    leaves out; two are within two bits exactly if they meet at such a value, and no value
    gathers over 65.  So nothing is capped, and no bucket meets in one task.
    """
    if radius not in (1, 2):
        raise ValueError("radius must be 1 or 2")
    work = Work(fps.sparkSession, "links")
    masks = [_signed(m) for m in covering_masks(radius)]
    tables = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for t, m in enumerate(masks)])
    rows = fps.select("fp", F.explode(tables).alias("x")).select("fp", "x.t", "x.key", salt_of("fp").alias("salt"))
    rows = work.save(rows, "tables")
    part = rows.groupBy("t", "key", "salt").agg(F.count(F.lit(1)).alias("n"))
    size = part.groupBy("t", "key").agg(F.sum("n").alias("n"), F.collect_list("salt").alias("salts")).filter("n > 1")
    size = work.save(size.select("t", "key", "n", F.explode("salts").alias("salt")), "sizes")
    rows = work.save(rows.join(size, ["t", "key", "salt"]).select("fp", "t", "key", "n"), "buckets")
    few = rows.filter(F.col("n") <= small).groupBy("t", "key").agg(F.sort_array(F.collect_list("fp")).alias("fps"))
    few = few.select(F.posexplode("fps").alias("i", "a"), "fps").select("a", F.explode(F.expr("slice(fps, i + 2, size(fps))")).alias("b"))
    few = few.filter(_distance(F.col("a"), F.col("b")) <= radius)
    outside = [[_signed(1 << i) for i in range(64) if not (m >> i) & 1] for m in covering_masks(radius)]
    flips = F.element_at(F.array(*[F.array(F.lit(0).cast("long"), *[F.lit(x).cast("long") for x in o]) for o in outside]), F.col("t") + 1)
    mid = rows.filter(F.col("n") > small).select("fp", F.explode(flips).alias("flip"))
    mid = mid.select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("mid")).groupBy("mid").agg(F.collect_set("fp").alias("fps"))
    # At radius 1 those that meet may be two bits apart: each is linked with the one that the value itself is.
    hub = mid.withColumn("a", F.array_min("fps")) if radius == 2 else mid.filter(F.array_contains("fps", F.col("mid"))).withColumn("a", F.col("mid"))
    many = hub.filter("size(fps) > 1").select("a", F.explode("fps").alias("b")).filter("a <> b")
    many = many.filter(_distance(F.col("a"), F.col("b")) <= radius)
    return work.save(few.unionByName(many).distinct(), "links")


def near_groups(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, radius: int = RADIUS) -> DataFrame:
    """One row per input row: doc_id, sha, fp (signed 64 bits), component_id.

    component_id is the smallest doc_id that links of at most radius differing bits reach,
    itself included; null doc_ids count only where there is no other.  Null or empty texts have
    fingerprint 0, linked like any other.  Repeated rows share a component.
    """
    work = Work(docs.sparkSession, "simhash")
    src = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), text_sha().alias("sha"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = work.save(src.mapInArrow(_fingerprints(shingle, seed), f"doc_id {kind}, sha binary, fp long"), "rows")
    fps = work.save(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "fps")
    roots = connected(links(fps, radius))
    placed = work.save(fps.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp")), "placed")
    least = work.save(placed.groupBy("root").agg(F.min("least").alias("component_id")), "least")
    by_fp = work.save(placed.join(least, "root").select("fp", "component_id"), "by_fp")
    return rows.join(by_fp, "fp").select("doc_id", "sha", "fp", "component_id")


def drop_near_copies(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, radius: int = RADIUS) -> DataFrame:
    """docs with one row of each component: its smallest doc_id, and of equal ones the
    row with the smallest SHA-256 of its text."""
    work = Work(docs.sparkSession, "near")
    rows = work.save(near_groups(docs, shingle, seed, radius).select("doc_id", "sha", "component_id"), "groups")
    first = rows.filter(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy(F.col("component_id").alias("cid")).agg(F.min("sha").alias("first"))
    first = work.save(first, "first")
    kept = F.col("doc_id").eqNullSafe(F.col("component_id")) & (F.col("sha") == F.col("first"))
    # Of rows that repeat both doc_id and text, the first verdict alone keeps.
    judged = rows.join(first, F.col("component_id").eqNullSafe(F.col("cid")), "left").groupBy("doc_id", "sha").agg(F.max(kept).alias("keep"), F.count(F.lit(1)).alias("n"))
    copies = F.transform(F.sequence(F.lit(1), F.col("n").cast("int")), lambda i: F.col("keep") & (i == 1))
    return keep_rows(docs, judged.select("doc_id", "sha", F.explode(copies).alias("keep")))
