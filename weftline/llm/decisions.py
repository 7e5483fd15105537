"""Puts per-document decisions into effect on whole rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._work import Work


def text_sha() -> Column:
    """SHA-256 of the text (null counts as empty), binary."""
    return F.unhex(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256))


def keyed(docs: DataFrame) -> DataFrame:
    """row (all columns of docs, so that none of their names can clash), id and sha."""
    return docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.col("doc_id").alias("id"), text_sha().alias("sha"))


def keep_rows(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """docs without the rows that verdicts (doc_id, sha, keep) reject.

    A row is found by doc_id (null finds null) and text.  Where several rows share
    both, as many stay as there are verdicts that keep them.  Only rejected pairs are
    joined.  Further columns of docs, of any name, stay as they are.
    """
    work = Work(docs.sparkSession, "verdicts")
    keep = F.coalesce("keep", F.lit(False))
    pairs = verdicts.groupBy(F.col("doc_id").alias("rid"), F.col("sha").alias("rsha")).agg(F.count_if(~keep).alias("out"), F.count_if(keep).alias("stay"))
    # Rejected pairs grow with the corpus, so they are dealt at every size and never broadcast.
    pairs = work.save(pairs.filter("out > 0"), "rejected").hint("merge")
    gone, some = pairs.filter("stay = 0"), pairs.filter("stay > 0")
    rows = keyed(docs)

    def on(right: DataFrame) -> Column:
        return rows["id"].eqNullSafe(right["rid"]) & (rows["sha"] == right["rsha"])

    if some.isEmpty():
        return rows.join(gone, on(gone), "left_anti").select("row.*")
    rest = rows.join(pairs, on(pairs), "left_anti").select("row.*")
    rank = F.row_number().over(Window.partitionBy("id", "sha").orderBy("sha"))
    few = rows.join(some, on(some)).withColumn("rn", rank).filter("rn <= stay")
    return rest.unionByName(few.select("row.*"))
