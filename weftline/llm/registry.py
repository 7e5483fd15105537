"""The corpus queries, each over its whole table, and the SQL that states their results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, exact_dedup, langid, licences, line_dedup, packing, quality, simhash, token_counts, toxicity
from .samples import remainder

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact_dedup.exact_groups(_read(spark, sf_dir, "documents"))
    return rows.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


OP1_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decontaminate.contaminated(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    return rows.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "n_near", "near_sha256")


#: translate() lower-cases A-Z alone.
OP3_SQL = r"""
WITH low AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS u, 'abcdefghijklmnopqrstuvwxyz' AS l),
d AS (SELECT doc_id, coalesce(regexp_extract_all(translate(text, u, l), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents, low),
b AS (SELECT item_id, regexp_extract_all(translate(text, u, l), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark, low),
win AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, greatest(len(w) - 12, 1) + 1), lambda i: array_to_string(w[i:i+12], ' '))) AS said,
               least(len(w), 13) AS n FROM b WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM win),
places AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, w FROM d, sizes WHERE len(w) >= n),
grams AS (SELECT doc_id, n, i, array_to_string(w[i:i+n-1], ' ') AS said FROM places),
hits AS (SELECT g.doc_id, g.i, g.n, win.item_id FROM grams g JOIN win ON g.said = win.said AND g.n = win.n),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hits) GROUP BY doc_id),
pw AS (SELECT DISTINCT said, string_split(said, ' ') AS ph FROM win),
tk AS (SELECT doc_id, unnest(w) AS term, unnest(range(len(w))) AS place FROM d),
df AS (SELECT term, count(*) AS df FROM tk GROUP BY 1),
pt AS (SELECT said, ph, term, min(off) AS off FROM (SELECT said, ph, unnest(ph) AS term, unnest(range(len(ph))) AS off FROM pw) GROUP BY 1, 2, 3),
pr AS (SELECT *, len(list_distinct(ph)) AS k, (4 * len(list_distinct(ph)) + 4) // 5 AS need, row_number() OVER (PARTITION BY said ORDER BY coalesce(df, 0), off) AS rank FROM pt LEFT JOIN df USING (term)),
nr AS (SELECT DISTINCT tk.doc_id, pr.said FROM tk JOIN pr USING (term) JOIN d USING (doc_id) WHERE rank <= k - need + 1
       AND len(list_intersect(w[greatest(place - off - 4, 0) + 1:place - off + len(ph) + 4], ph)) >= need),
ni AS (SELECT doc_id, count(*) AS n_near, string_agg(x, ',' ORDER BY x) AS near FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM nr JOIN win USING (said)) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated,
       CAST(coalesce(n_near, 0) AS BIGINT) AS n_near, sha256(coalesce(near, '')) AS near_sha256
FROM d LEFT JOIN pos USING (doc_id) LEFT JOIN its USING (doc_id) LEFT JOIN ni USING (doc_id)
"""


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_groups(_read(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_token_counts(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    """Counts of every text, and after three edits of it, at places drawn from doc_id: a cut, an insertion and a replacement."""
    docs = _read(spark, sf_dir, "documents")
    n = F.greatest(F.length(F.coalesce("text", F.lit(""))), F.lit(1))
    at = [F.pmod(F.xxhash64("doc_id", F.lit(k)), n).cast("int").alias("at") for k in range(3)]
    edits = F.array(
        F.struct(at[0], F.lit(40).alias("removed"), F.lit("").alias("inserted")),
        F.struct(at[1], F.lit(0).alias("removed"), F.lit(" an inserted passage, it's new").alias("inserted")),
        F.struct(at[2], F.lit(7).alias("removed"), F.lit("replaced").alias("inserted")),
    )
    rows = token_counts.token_counts(docs, tokenizer or tokenizer_path(), edits)
    return rows.select("doc_id", "tokens", "tokens_after", "chars_after", "chars_encoded", F.size("leaf_tokens").alias("leaves"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    rows = langid.predicted(docs.select("doc_id", "text"), langid.train(docs))
    return rows.select("doc_id", (remainder(4) == 2).alias("held_out"), F.col("lang_pred"), F.col("lang_score").alias("score"))


def op6_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan(_read(spark, sf_dir, "documents"))


def _op6_sql() -> str:
    quoted = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in licences.TEMPLATES.items())
    word = r"[a-z0-9\x{80}-\x{10FFFF}]+"
    grams = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    low = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH t0(license_id, text) AS (VALUES {quoted}),
t1 AS (SELECT license_id, regexp_extract_all({low.format("text")}, '{word}') AS w FROM t0),
t AS (SELECT license_id, {grams} AS g FROM t1),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS said FROM documents UNION ALL
      SELECT doc_id, text FROM documents WHERE contains(text, chr(10))),
u0 AS (SELECT doc_id, regexp_extract_all({low.format("said")}, '{word}') AS w FROM l),
u AS (SELECT doc_id, {grams} AS g FROM u0 WHERE len(w) >= 2),
d AS (SELECT doc_id, license_id, 2.0 * len(list_intersect(u.g, t.g)) / (len(u.g) + len(t.g)) AS dice FROM u JOIN t
      ON len(u.g) BETWEEN len(t.g) / 1.5001 AND len(t.g) * 1.5001)
SELECT doc_id, license_id, count(*) AS units, CAST(round(max(dice), 6) AS DOUBLE) AS dice FROM d WHERE dice >= 0.8 - 1e-12 GROUP BY ALL
"""


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    rows = toxicity.scored(docs, toxicity.train(docs, _read(spark, sf_dir, "labels")))
    return rows.select("doc_id", (remainder(5) == 0).alias("held_out"), F.col("toxicity_score").alias("score"), (F.col("toxicity_score") >= 0.5).cast("int").alias("predicted"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    rows = quality.scored(docs, quality.train(docs, _read(spark, sf_dir, "labels")))
    return rows.select("doc_id", (remainder(4) == 2).alias("held_out"), F.col("quality_score").alias("score"), (F.col("quality_score") >= quality.KEEP).cast("int").alias("predicted"))


def op9_packing(spark: SparkSession, sf_dir: str, tokenizer: str | None = None) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"), tokenizer or tokenizer_path())


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup.repeated_lines(_read(spark, sf_dir, "documents"))
    numbers = F.array_join(F.transform("deleted", lambda x: x.cast("string")), ",")
    return rows.select("doc_id", F.col("lines").cast("long").alias("n_lines"), F.size("deleted").cast("long").alias("n_deleted"), F.sha2(numbers, 256).alias("deleted_sha256"))


#: Runs of three lines, and shorter ones of forty words in all, that have begun earlier.  Characters of scripts without blanks count half a word.
OP10_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id NULLS LAST) AS o, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
x AS (SELECT o, unnest(l) AS s, unnest(range(len(l))) AS p FROM d),
v AS (SELECT o, p, s, len(regexp_split_to_array(trim(s, ' '), '[ \t\n\x0B\f\r]+'))
      + length(regexp_replace(s, '[^\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}\p{Tibetan}]+', '', 'g')) // 2 AS n FROM x),
y AS (SELECT o, p, s, n, lead(s, 1) OVER w AS s1, lead(s, 2) OVER w AS s2, lead(n, 1) OVER w AS m FROM v WINDOW w AS (PARTITION BY o ORDER BY p)),
z AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY o, p) AS n1, row_number() OVER (PARTITION BY s, s1 ORDER BY o, p) AS n2, row_number() OVER (PARTITION BY s, s1, s2 ORDER BY o, p) AS n3 FROM y),
gone AS (SELECT o, unnest(range(p, p + 3)) AS p FROM z WHERE s2 IS NOT NULL AND n3 > 1
         UNION SELECT o, unnest(range(p, p + 2)) FROM z WHERE s1 IS NOT NULL AND n2 > 1 AND n + m >= 40
         UNION SELECT o, p FROM z WHERE n1 > 1 AND n >= 40),
g AS (SELECT o, count(*) AS c, string_agg(CAST(p AS VARCHAR), ',' ORDER BY p) AS ps FROM gone GROUP BY o)
SELECT doc_id, CAST(len(l) AS BIGINT) AS n_lines, CAST(coalesce(c, 0) AS BIGINT) AS n_deleted, sha256(coalesce(ps, '')) AS deleted_sha256 FROM d LEFT JOIN g USING (o)
"""

QUERIES: dict[str, Query] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_token_counts": op2_token_counts,
    "op3_decontaminate": op3_decontaminate,
    "op4_simhash": op4_simhash,
    "op5_language_id": op5_language_id,
    "op6_licence_scan": op6_licence_scan,
    "op7_toxicity": op7_toxicity,
    "op8_quality": op8_quality,
    "op9_packing": op9_packing,
    "op10_line_dedup": op10_line_dedup,
}

ORACLE_SQL: dict[str, str] = {"op1_exact_dedup": OP1_SQL, "op3_decontaminate": OP3_SQL, "op6_licence_scan": _op6_sql(), "op10_line_dedup": OP10_SQL}
