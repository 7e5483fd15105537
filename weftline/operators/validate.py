"""Format rules of submissions (s1, matched: a comma list)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Examples that a report gives per rule.
EXAMPLES = 5


def listed(rows: DataFrame) -> DataFrame:
    ids = F.filter(F.transform(F.split("matched", ","), lambda x: F.trim(x)), lambda x: x != "")
    return rows.select("s1", ids.alias("ids"))


def duplicate_rows(rows: DataFrame) -> DataFrame:
    return rows.groupBy("s1").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def repeated_ids(rows: DataFrame) -> DataFrame:
    return listed(rows).filter(F.size("ids") != F.size(F.array_distinct("ids"))).select("s1")


def wrong_ids(rows: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """s1, cand, rule: ids of the reference's own source, with another prefix than S2- or S3-, or unknown (if known, entity_id, is given)."""
    each = listed(rows).select("s1", F.explode("ids").alias("cand"))
    rule = F.when(F.col("cand").startswith("S1-"), "self").when(~F.col("cand").rlike("^S[23]-"), "prefix")
    out = each.withColumn("rule", rule).filter("rule is not null")
    if known is not None:
        lost = each.join(known.select(F.col("entity_id").alias("cand")), "cand", "left_anti").filter(F.col("cand").rlike("^S[23]-"))
        out = out.unionByName(lost.select("s1", "cand", F.lit("unknown").alias("rule")))
    return out


def missing_and_extra(rows: DataFrame, required: DataFrame) -> DataFrame:
    """s1, rule: required ids without a row, and rows whose id isn't required."""
    need, have = required.select("s1").distinct(), rows.select("s1").distinct()
    return need.join(have, "s1", "left_anti").withColumn("rule", F.lit("missing")).unionByName(have.join(need, "s1", "left_anti").withColumn("rule", F.lit("extra")))


def outside_candidates(matched: DataFrame, candidates: DataFrame) -> DataFrame:
    """s1, cand: matches that the candidate lists don't have."""
    a = listed(matched).select("s1", F.explode("ids").alias("cand"))
    return a.join(listed(candidates).select("s1", F.explode("ids").alias("cand")), ["s1", "cand"], "left_anti").distinct()


def file_errors(spark: SparkSession, path: str, header: tuple[str, str]) -> list[str]:
    """What makes a file unreadable as a submission: missing, empty, not UTF-8, wrong header, rows without a tab."""
    try:
        raw = spark.read.text(path).withColumn("n", F.monotonically_increasing_id())
        first = raw.orderBy("n").limit(1).collect()
    except Exception as e:  # noqa: BLE001
        return [f"can't be read: {str(e).splitlines()[0]}"]
    if not first:
        return ["is empty"]
    found = []
    if first[0]["value"].split("\t") != list(header):
        found.append("is comma-separated" if "," in first[0]["value"] and "\t" not in first[0]["value"] else "has another header")
    if raw.filter(F.col("value").contains("�")).limit(1).count():
        found.append("isn't UTF-8")
    bare = raw.filter(~F.col("value").contains("\t") & (F.col("value") != "")).count()
    return found + ([f"{bare} rows without a tab"] if bare else [])


def check(spark: SparkSession, path: str, required: DataFrame, header: tuple[str, str] = ("source1_entity_id", "matched_entity_ids"), known: DataFrame | None = None) -> tuple[int, list[str]]:
    """(exit code, messages): 0 if every rule holds."""
    found = file_errors(spark, path, header)
    if found:
        return 1, found
    rows = spark.read.options(sep="\t", header=True).csv(path).select(F.col(header[0]).alias("s1"), F.coalesce(header[1], F.lit("")).alias("matched"))
    for name, bad in {"duplicate rows": duplicate_rows(rows), "repeated ids": repeated_ids(rows), "wrong ids": wrong_ids(rows, known), "missing or extra ids": missing_and_extra(rows, required)}.items():
        few = bad.limit(EXAMPLES).collect()
        if few:
            found.append(f"{name}, such as {[r['s1'] for r in few]}")
    return int(bool(found)), found
