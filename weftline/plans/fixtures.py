"""Record-linkage views over `part`, in SQL that Spark and DuckDB both read, and a pair table over `lineitem`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Common table expressions s1, s2, s3 (with decoys), others and truth; {part} is the table.
VIEWS = """
base AS (SELECT p_partkey AS k, p_name || ' ' || lower(p_type) || CASE p_partkey % 4 WHEN 0 THEN ' Inc' WHEN 1 THEN ' L.L.C.' WHEN 2 THEN ' Ltd' ELSE '' END AS name,
  100 + (p_partkey * 37) % 900 AS num, CASE p_partkey % 5 WHEN 0 THEN 'Oak Street' WHEN 1 THEN 'Main Road' WHEN 2 THEN 'Park Avenue' WHEN 3 THEN 'Hill Drive' ELSE 'Rue de la Paix' END AS street,
  'City' || CAST(p_partkey % 50 AS STRING) AS city, 'C' || CAST(p_partkey % 3 AS STRING) AS country, CAST(p_partkey AS STRING) AS ks FROM {part}),
s1 AS (SELECT 'S1-' || ks AS entity_id, name AS business_name, CAST(num AS STRING) || ' ' || street || ', ' || city AS business_address, country FROM base),
s2 AS (SELECT 'S2-' || ks AS entity_id, upper(name) AS business_name, CASE WHEN k % 7 = 0 THEN '' ELSE
  replace(replace(replace(CAST(num AS STRING) || ' ' || street || ', ' || city, 'Street', 'St'), 'Road', 'Rd'), 'Avenue', 'Ave') END AS business_address, country FROM base WHERE k % 4 <> 3),
s3 AS (SELECT 'S3-' || ks AS entity_id, replace(replace(replace(name, ' Inc', ''), ' L.L.C.', ' LLC'), 'e', 'é') AS business_name, city || ', ' || CAST(num AS STRING) || ' ' || street AS business_address, country
  FROM base WHERE k % 5 <> 4 UNION ALL
  SELECT 'S3-D' || ks, name, CAST(num + 1 + k % 25 AS STRING) || ' ' || street || ', ' || city, country FROM base WHERE k % 3 = 1),
others AS (SELECT * FROM s2 UNION ALL SELECT * FROM s3),
recs AS (SELECT * FROM s1 UNION ALL SELECT * FROM others),
truth AS (SELECT 'S1-' || ks AS source1_entity_id, concat_ws(',', CASE WHEN k % 4 <> 3 THEN 'S2-' || ks END, CASE WHEN k % 5 <> 4 THEN 'S3-' || ks END) AS matched_entity_ids FROM base)
"""


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    return spark.sql(f"WITH {VIEWS} SELECT * FROM {name}", part=part)


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """s1, cand, p and eq: one row per order and part."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return rows.groupBy(F.col("l_orderkey").alias("s1"), F.col("l_partkey").alias("cand")).agg((F.max("l_discount") * 9 + 0.05).alias("p"), F.bool_or(F.col("l_linenumber") == 1).alias("eq"))


PAIRS = "pr AS (SELECT l_orderkey AS s1, l_partkey AS cand, max(l_discount) * 9 + 0.05 AS p, bool_or(l_linenumber = 1) AS eq FROM lineitem GROUP BY 1, 2)"
