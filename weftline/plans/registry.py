"""The linkage queries, and the SQL that states the same results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import similarity as sim
from ..functions import text
from ..operators import adaptive, canon, decide, evaluate, features, lexicon, merge, models, prune, retrieve, stack, validate, vectors
from ..sources import tables
from ..sources.scratch import written
from . import linkage
from .config import Channel, LinkageConfig
from .fixtures import PAIRS, VIEWS, pairs, view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


#: Added before rounding where values can lie halfway between two roundings by their making.
OFF = 1e-8


def r6(c, name: str):
    return F.round(c, 6).alias(name)


# --- Decisions, over the pair table -----------------------------------------------------------------------------

_STATS = f"""WITH {PAIRS} SELECT s1, cand, row_number() OVER (PARTITION BY {{k}} ORDER BY p DESC, {{o}}) - 1 AS rank, count(*) OVER (PARTITION BY {{k}}) AS size,
round(p - max(p) OVER (PARTITION BY {{k}}), 6) AS gap, round(max(p) OVER (PARTITION BY {{k}}) - coalesce(nth_value(p, 2) OVER (PARTITION BY {{k}} ORDER BY p DESC, {{o}}
ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 0), 6) AS margin FROM pr"""


def _stats(rows: DataFrame) -> DataFrame:
    return rows.select("s1", "cand", "rank", "size", r6(F.col("gap"), "gap"), r6(F.col("margin"), "margin"))


@query(_STATS.format(k="s1", o="cand"))
def group_stats_s1(spark, sf):
    return _stats(merge.group_stats(pairs(spark, sf), "s1", "cand", "p"))


@query(_STATS.format(k="cand", o="s1"))
def group_stats_cand(spark, sf):
    return _stats(merge.group_stats(pairs(spark, sf), "cand", "s1", "p"))


@query(f"WITH {PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY s1 ORDER BY p DESC, cand) AS rn FROM pr) SELECT s1, cand, round(p, 6) AS p FROM r WHERE rn <= 3 AND p >= 0.3")
def prune_top_n(spark, sf):
    return merge.prune_top(pairs(spark, sf), "s1", "cand", "p", 3, 0.3).select("s1", "cand", r6(F.col("p"), "p"))


_OWN = f"WITH {PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY cand ORDER BY p DESC, s1) AS rn, lead(p, 1, 0) OVER (PARTITION BY cand ORDER BY p DESC, s1) AS nxt FROM pr)"


@query(f"{_OWN} SELECT s1, cand, round(CASE WHEN rn = 1 THEN p ELSE 0 END, 6) AS p_own FROM r")
def one_to_one(spark, sf):
    return decide.one_to_one(pairs(spark, sf)).select("s1", "cand", r6(F.col("p_own"), "p_own"))


@query(f"{_OWN} SELECT s1, cand, round(CASE WHEN rn = 1 THEN p - nxt ELSE 0 END, 6) AS margin FROM r")
def rival_margin(spark, sf):
    return decide.rival_margin(pairs(spark, sf)).select("s1", "cand", r6(F.col("margin"), "margin"))


@query(f"{_OWN} SELECT s1, cand, round(p, 6) AS p FROM r WHERE rn = 1 AND p >= 0.9")
def confident_pairs(spark, sf):
    return stack.confident_pairs(pairs(spark, sf), 0.9).select("s1", "cand", r6(F.col("p"), "p"))


@query(f"""{_OWN}, m AS (SELECT s1, cand, round(CASE WHEN rn = 1 THEN p - nxt ELSE 0 END, 9) AS margin, CAST(eq AND p >= 0.5 AS INT) AS e FROM r)
SELECT s1, cand, round(margin, 6) AS ctx_margin, round(max(margin) OVER (PARTITION BY s1), 6) AS ctx_best, row_number() OVER (PARTITION BY s1 ORDER BY margin DESC, cand) AS ctx_rank,
count(*) OVER (PARTITION BY s1) AS ctx_n_cand, CAST(sum(e) OVER (PARTITION BY s1) - e AS BIGINT) AS ctx_s1_eq, CAST(sum(e) OVER (PARTITION BY cand) - e AS BIGINT) AS ctx_cand_eq FROM m""")
def context_features(spark, sf):
    rows = decide.add_context(pairs(spark, sf), F.col("eq"))
    return rows.select("s1", "cand", r6(F.col("ctx_margin"), "ctx_margin"), r6(F.col("ctx_best"), "ctx_best"), "ctx_rank", "ctx_n_cand", "ctx_s1_eq", "ctx_cand_eq")


#: Groups as sorted arrays; pb(list) as a fold of convolutions with the two-point distributions of each chance.
_GROUPS = f"""WITH {PAIRS}, own AS (SELECT s1, cand, CASE WHEN row_number() OVER (PARTITION BY cand ORDER BY p DESC, s1) = 1 THEN p ELSE 0 END AS p FROM pr),
g AS (SELECT s1, list(cand ORDER BY p DESC, cand) AS cands, list(least(greatest(p, 1e-9), 1 - 1e-9) ORDER BY p DESC, cand) AS ps FROM {{t}} GROUP BY s1)"""


def _pb(ps: str) -> str:
    return (f"CASE WHEN len({ps}) = 0 THEN [1.0::DOUBLE] ELSE list_reduce(list_transform({ps}, lambda p: [1 - p, p]), lambda a, b: "
            "list_transform(range(1, len(a) + 2), lambda i: coalesce(a[i], 0) * b[1] + CASE WHEN i > 1 THEN a[i - 1] ELSE 0 END * b[2])) END")


_SCORES = f"""ks AS (SELECT s1, cands, unnest(range(len(ps) + 1)) AS k, ps FROM g),
pbs AS (SELECT s1, cands, k, len(ps) AS n, {_pb("ps[1:k]")} AS a, {_pb("ps[k + 1:]")} AS b FROM ks),
sc AS (SELECT s1, cands, k, CASE WHEN k = 0 THEN b[1] ELSE list_sum(list_transform(range(k + 1), lambda t: a[t + 1] * t * list_sum(list_transform(range(n - k + 1), lambda m: b[m + 1] * 1.25 / (0.25 * (t + m) + k))))) END AS score FROM pbs)"""


@query(f"{_GROUPS.format(t='pr')}, d AS (SELECT s1, {_pb('ps')} AS a FROM g) SELECT s1, CAST(i AS INT) AS k, round(a[i + 1] + 1e-8, 6) AS prob FROM (SELECT s1, a, unnest(range(len(a))) AS i FROM d)")
def poisson_binomial(spark, sf):
    g = decide.groups(pairs(spark, sf))
    clipped = F.transform("ps", lambda p: F.greatest(F.least(p, F.lit(1 - 1e-9)), F.lit(1e-9)))
    return g.select("s1", F.posexplode(decide.poisson_binomial(clipped)).alias("k", "prob")).withColumn("prob", F.round(F.col("prob") + OFF, 6))


@query(f"{_GROUPS.format(t='pr')}, {_SCORES} SELECT s1, CAST(k AS INT) AS k, round(score + 1e-8, 6) AS score FROM sc")
def expected_f05(spark, sf):
    g = decide.groups(pairs(spark, sf))
    return g.select("s1", F.posexplode(decide.expected_f05(F.col("ps"))).alias("k", "score")).withColumn("score", F.round(F.col("score") + OFF, 6))


_CHOSEN = f"""{_GROUPS.format(t='own')}, {_SCORES}, best AS (SELECT s1, any_value(cands) AS cands, arg_min(k, (-round(score, 9), k)) AS n FROM sc GROUP BY s1)"""


@query(f"{_CHOSEN} SELECT s1, cands[i + 1] AS cand, CAST(i AS INT) AS place FROM (SELECT s1, cands, unnest(range(n)) AS i FROM best)")
def choose_sets(spark, sf):
    return decide.choose(pairs(spark, sf)).select("s1", "cand", "place")


@query(f"{_CHOSEN} SELECT o_orderkey AS s1, coalesce(array_to_string(cands[1:n], ','), '') AS matched FROM orders LEFT JOIN best ON s1 = o_orderkey")
def submission_lists(spark, sf):
    ids = spark.read.parquet(f"{sf}/orders.parquet").select(F.col("o_orderkey").alias("s1"))
    return decide.to_submission(decide.choose(pairs(spark, sf)), ids)


# --- Records: normalisation ----------------------------------------------------------------------------------------

_V = "WITH " + VIEWS.format(part="part")
_ADDR = "trim(regexp_replace(lower(strip_accents({a})), '[^a-z0-9_]+', ' ', 'g'))"
_NAME = _ADDR.format(a="replace({n}, 'L.L.C.', 'LLC')")
_B = f"""{_V}, b AS (SELECT entity_id, country, {_NAME.format(n="business_name")} AS name_b, {_ADDR.format(a="business_address")} AS addr_b FROM recs)"""
_NUMS = "list_transform(regexp_extract_all({a}, '[0-9]+'), lambda d: CASE WHEN ltrim(d, '0') = '' THEN '0' ELSE ltrim(d, '0') END)"
_C = f"""{_B}, c AS (SELECT entity_id, country, name_b AS name_c, name_b AS name_core, replace(name_b, ' ', '') AS name_sq, addr_b AS addr_c,
  array_to_string(list_filter(string_split(addr_b, ' '), lambda t: t <> '' AND NOT regexp_matches(t, '^[0-9]+$')), ' ') AS addr_core,
  array_to_string({_NUMS.format(a="addr_b")}, ' ') AS nums, array_to_string(list_filter({_NUMS.format(a="addr_b")}, lambda d: len(d) IN (5, 6)), ' ') AS postal FROM b),
i AS (SELECT * FROM c WHERE entity_id LIKE 'S1-%'), q AS (SELECT * FROM c WHERE entity_id NOT LIKE 'S1-%')"""


def canon_of(spark, sf, name: str) -> DataFrame:
    return written(canon.canonical_texts(view(spark, sf, name)), name)


@query(f"{_V} SELECT source1_entity_id AS s1, trim(x) AS cand FROM (SELECT source1_entity_id, unnest(string_split(matched_entity_ids, ',')) AS x FROM truth) WHERE x <> ''")
def truth_explode(spark, sf):
    return tables.truth_pairs(view(spark, sf, "truth"))


@query(f"{_B} SELECT entity_id, name_b, addr_b FROM b")
def normalize_basic(spark, sf):
    return canon.basic(tables.union_sources(*[view(spark, sf, s) for s in ("s1", "s2", "s3")])).select("entity_id", "name_b", "addr_b")


@query(f"{_B} SELECT entity_id, name_b AS name FROM b WHERE entity_id LIKE 'S1-%'")
def name_norm_ascii(spark, sf):
    return view(spark, sf, "s1").select("entity_id", text.name_norm(F.col("business_name"), accents=False).alias("name"))


#: Names in which each rule of name_norm has something to do, by the number of the part.
_RULES = """CASE p_partkey % 9 WHEN 0 THEN concat('O', chr(39), p_name, ' d', chr(39), 'or') WHEN 1 THEN concat('Bo1d 5and ', replace(p_name, 'e', '6'), ' x1 9') WHEN 2 THEN concat(p_name, ' D.B.A. Zeta W0rks')
WHEN 3 THEN concat('Quill a/k/a ', p_name) WHEN 4 THEN concat(p_name, ' Trading As ', p_type) WHEN 5 THEN concat('24x7 3M ', p_name, ' P/L.') WHEN 6 THEN 'Formerly' WHEN 7 THEN concat('Œuf Straße & Façade+', p_name) ELSE concat('Ύδρα ', p_name, ' S.p.A.') END"""


@query(rf"""WITH a AS (SELECT p_partkey, {_RULES} AS x FROM part),
b AS (SELECT p_partkey, regexp_replace(regexp_replace(x, '\b([A-Za-z])[./]([A-Za-z])[./]([A-Za-z])\b\.?', '\1\2\3', 'g'), '\b([A-Za-z])[./]([A-Za-z])\b\.?', '\1\2', 'g') AS x FROM a),
c AS (SELECT p_partkey, replace(replace(replace(strip_accents(regexp_replace(x, '([a-zA-Z])\x27([a-zA-Z])', '\1\2', 'g')), 'Œ', 'oe'), 'ß', 'ss'), '+', ' & ') AS x FROM b),
d AS (SELECT p_partkey, string_split(trim(regexp_replace(lower(replace(x, '&', ' and ')), '[^\p{{L}}\p{{N}}_]+', ' ', 'g')), ' ') AS t FROM c),
e AS (SELECT p_partkey, array_to_string(list_transform(t, lambda w: CASE WHEN regexp_full_match(w, '[a-z0-9]+') AND regexp_matches(w, '[a-z]') AND regexp_matches(w, '[0-9]') THEN translate(w, '01568', 'olsgb') ELSE w END), ' ') AS x FROM d),
f AS (SELECT p_partkey, x, regexp_replace(x, '^.*\b(dba|fka|aka|formerly|doing business as|trading as|ta)\b\s*', '') AS y FROM e)
SELECT p_partkey, CASE WHEN y = '' THEN x ELSE y END AS name, p_partkey % 9 = 8 AS foreign_script FROM f""")
def name_norm_rules(spark, sf):
    rows = spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", F.expr(_RULES).alias("x"))
    return rows.select("p_partkey", text.name_norm(F.col("x")).alias("name"), text.has_non_latin(F.col("x")).alias("foreign_script"))


@query(f"{_B} SELECT entity_id, array_to_string({_NUMS.format(a='addr_b')}, ' ') AS nums FROM b")
def address_numbers(spark, sf):
    rows = view(spark, sf, "recs")
    return rows.select("entity_id", F.array_join(text.numbers(text.basic_norm(F.col("business_address"))), " ").alias("nums"))


@query(f"{_C} SELECT entity_id, name_sq FROM c")
def squash_name(spark, sf):
    return canon_of(spark, sf, "recs").select("entity_id", "name_sq")


_LEXICON = [
    ("C0", "name", "generic", "inc", "", 9.0), ("C0", "name", "generic", "ltd", "", 8.0), ("C0", "addr", "variant", "st", "street", 5.0), ("C0", "addr", "variant", "rd", "road", 5.0),
    ("C1", "addr", "expand", "ave", "avenue way", 4.0), ("C1", "name", "prefix", "old", "", 3.0), ("C1", "addr", "translit", "st", "strasse", 2.0), ("C1", "addr", "variant", "st", "street", 2.0),
]


@query(f"""{_B}, t AS (SELECT *, string_split(name_b, ' ') AS n0, list_filter(string_split(addr_b, ' '), lambda x: x <> '') AS a0 FROM b),
u AS (SELECT entity_id, country, CASE WHEN country = 'C1' AND n0[1] = 'old' AND len(n0) > 1 THEN n0[2:] ELSE n0 END AS n,
 CASE country WHEN 'C0' THEN list_transform(a0, lambda x: CASE x WHEN 'st' THEN 'street' WHEN 'rd' THEN 'road' ELSE x END)
  WHEN 'C1' THEN list_transform(a0, lambda x: CASE x WHEN 'st' THEN 'strasse' WHEN 'ave' THEN 'avenue way' ELSE x END) ELSE a0 END AS a FROM t)
SELECT entity_id, array_to_string(n, ' ') AS name_c, array_to_string(CASE WHEN country = 'C0' THEN list_filter(n, lambda x: x NOT IN ('inc', 'ltd')) ELSE n END, ' ') AS name_core, array_to_string(a, ' ') AS addr_c FROM u""")
def canon_apply(spark, sf):
    maps = canon.field_maps(spark.createDataFrame(_LEXICON, canon.LEXICON))
    return canon.canonical(canon.basic(view(spark, sf, "recs")), maps).select("entity_id", "name_c", "name_core", "addr_c")


# --- Vectors and retrieval -------------------------------------------------------------------------------------------

WORDS = r"[\p{L}\p{M}\p{N}_]+"
_TFD = f"""dt AS (SELECT doc_id AS id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{WORDS}')) AS term FROM documents) GROUP BY 1, 2),
bt AS (SELECT item_id AS id, term, count(*) AS tf FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '{WORDS}')) AS term FROM benchmark) GROUP BY 1, 2)"""


def _words(spark, sf, table: str, key: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/{table}.parquet")
    return vectors.term_counts(rows, key, F.regexp_extract_all(F.lower("text"), F.lit(WORDS), F.lit(0)))


def _vec_sql(src: str, name: str, idf: str, nnz: int | None) -> str:
    """CTEs that end in `name` (id, term, w)."""
    cut = "" if nnz is None else f"WHERE rn <= {nnz}"
    return f"""{name}0 AS (SELECT id, {src}.term, idf * (1 + ln(tf)) AS w FROM {src} JOIN {idf} ON {src}.term = {idf}.term),
{name}1 AS (SELECT id, term, w, round(w / sqrt(sum(w * w) OVER (PARTITION BY id)), 9) AS u FROM {name}0),
{name}2 AS (SELECT id, term, w, row_number() OVER (PARTITION BY id ORDER BY u DESC, term) AS rn FROM {name}1),
{name} AS (SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM {name}2 {cut})"""


_IDF = "{name} AS (SELECT term, df, ln((1 + n) / (1 + df)) + 1 AS idf FROM (SELECT term, count(*) AS df FROM {src} GROUP BY 1), (SELECT count(*)::DOUBLE AS n FROM {of}) WHERE df >= {lo} AND df <= {hi} * n)"


@query(f"WITH {_TFD}, {_IDF.format(name='ii', src='dt', of='documents', lo=2, hi=0.2)} SELECT term, df, round(idf, 6) AS idf FROM ii")
def token_df_idf(spark, sf):
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    return vectors.idf(_words(spark, sf, "documents", "doc_id"), n, 2, 0.2).select("term", "df", r6(F.col("idf"), "idf"))


@query(f"WITH {_TFD}, {_IDF.format(name='ii', src='bt', of='benchmark', lo=1, hi=1.0)}, {_vec_sql('bt', 'v', 'ii', None)} SELECT id, term, round(w, 6) AS w FROM v")
def tfidf_vectors(spark, sf):
    t = _words(spark, sf, "benchmark", "item_id")
    n = spark.read.parquet(f"{sf}/benchmark.parquet").count()
    return vectors.weigh(t, vectors.idf(t, n)).select("id", "term", r6(F.col("w"), "w"))


@query(f"WITH {_TFD}, {_IDF.format(name='ii', src='bt', of='benchmark', lo=1, hi=1.0)}, {_vec_sql('dt', 'v', 'ii', 28)} SELECT id, term, round(w, 6) AS w FROM v")
def row_nnz_prune(spark, sf):
    n = spark.read.parquet(f"{sf}/benchmark.parquet").count()
    idf = vectors.idf(_words(spark, sf, "benchmark", "item_id"), n)
    return vectors.weigh(_words(spark, sf, "documents", "doc_id"), idf, 28).select("id", "term", r6(F.col("w"), "w"))


_TOPK = """s AS (SELECT a.id AS q, b.id AS d, round(sum(a.w * b.w), 6) AS s FROM {qv} a JOIN {dv} b ON a.term = b.term GROUP BY 1, 2),
top AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, d) AS rn FROM s WHERE s >= {least})"""


@query(f"""WITH {_TFD}, {_IDF.format(name='ii', src='bt', of='benchmark', lo=2, hi=0.5)}, {_vec_sql('dt', 'qv', 'ii', 28)}, {_vec_sql('bt', 'dv', 'ii', 28)},
{_TOPK.format(qv='qv', dv='dv', least=0.1)} SELECT q, d, s FROM top WHERE rn <= 5""")
def topk_cosine(spark, sf):
    b, d = _words(spark, sf, "benchmark", "item_id"), _words(spark, sf, "documents", "doc_id")
    idf = vectors.idf(b, spark.read.parquet(f"{sf}/benchmark.parquet").count(), 2, 0.5)
    return retrieve.topk_cosine(vectors.weigh(d, idf, 28), vectors.weigh(b, idf, 28), 5, 0.1)


_CONFIG = LinkageConfig()
#: The channels as they ship.
_SHIPPED = _CONFIG.channels


def _terms_sql(table: str, col: str, how: str, name: str) -> str:
    """CTE name (id, term, tf), terms with their country."""
    if how == "word":
        cut = f"list_filter(string_split({col}, ' '), lambda t: t <> '')"
    else:  # within words, a blank on either side
        grams = [f"CASE WHEN len(w) + 2 < {n} THEN [] ELSE list_transform(range(1, len(w) + 4 - {n}), lambda i: substr(' ' || w || ' ', i, {n})) END" for n in (3, 4)]
        cut = f"flatten(list_transform(list_filter(string_split({col}, ' '), lambda w: w <> ''), lambda w: list_concat({', '.join(grams)})))"
    return f"{name} AS (SELECT id, term, count(*) AS tf FROM (SELECT entity_id AS id, unnest(list_transform({cut}, lambda t: country || '|' || t)) AS term FROM {table}) GROUP BY 1, 2)"


def _channel_sql(c: Channel, tag: str) -> str:
    return f"""{_terms_sql('i', c.column, c.analyzer, tag + 'it')}, {_terms_sql('q', c.column, c.analyzer, tag + 'qt')}, {_IDF.format(name=tag + 'ii', src=tag + 'it', of='i', lo=2, hi=c.max_df)},
{_vec_sql(tag + 'qt', tag + 'qv', tag + 'ii', 28)}, {_vec_sql(tag + 'it', tag + 'dv', tag + 'ii', 28)}"""


def _sides(spark, sf) -> tuple[DataFrame, DataFrame]:
    return canon_of(spark, sf, "s1"), canon_of(spark, sf, "others")


@query(f"{_C}, {_channel_sql(_SHIPPED['name_sq'], 'n')}, {_TOPK.format(qv='nqv', dv='ndv', least=0.32)} SELECT q, d, s FROM top WHERE rn <= 14")
def char_ngram_topk(spark, sf):
    index, other = _sides(spark, sf)
    d, q = linkage.view_vectors(index, other, _SHIPPED["name_sq"], _CONFIG, 28)
    return retrieve.topk_cosine(q, d, 14, 0.32)


def _tok_topk(name: str):
    c = _SHIPPED[name]

    @query(f"{_C}, {_channel_sql(c, 'n')}, {_TOPK.format(qv='nqv', dv='ndv', least=c.threshold)} SELECT q, d, s FROM top WHERE rn <= {c.k}")
    def run(spark, sf):
        index, other = _sides(spark, sf)
        d, q = linkage.view_vectors(index, other, c, _CONFIG, 28)
        return retrieve.topk_cosine(q, d, c.k, c.threshold)

    QUERIES[f"{name}_topk"], ORACLE_SQL[f"{name}_topk"] = QUERIES.pop("run"), ORACLE_SQL.pop("run")


for _name in ("addr", "name_tok", "addr_core"):
    _tok_topk(_name)


def _joint_sql(side: str) -> str:
    return f"""j{side}0 AS (SELECT id, 'n ' || term AS term, w FROM n{side}v UNION ALL SELECT id, 'a ' || term, w FROM a{side}v),
j{side} AS (SELECT id, term, w / sqrt(h) AS w FROM j{side}0 JOIN (SELECT id, count(DISTINCT substr(term, 1, 1)) AS h FROM j{side}0 GROUP BY 1) USING (id))"""


@query(f"{_C}, {_channel_sql(_SHIPPED['name_sq'], 'n')}, {_channel_sql(_SHIPPED['addr'], 'a')}, {_joint_sql('q')}, {_joint_sql('d')}, {_TOPK.format(qv='jq', dv='jd', least=0.25)} SELECT q, d, s FROM top WHERE rn <= 20")
def joint_topk(spark, sf):
    index, other = _sides(spark, sf)
    folded, have = zip(*(linkage.folded_view_ids(index, other, _SHIPPED[c], _CONFIG, 28) for c in ("name_sq", "addr")), strict=True)
    q, d = zip(*have, strict=True)
    return retrieve.topk_joint(list(q), list(d), 20, 0.25, (linkage.grouped(other), linkage.grouped(index)), list(folded))


def _exact_sql(cap: int) -> str:
    each = " UNION ".join(f"SELECT q.entity_id AS q, i.entity_id AS d FROM q JOIN i ON q.country = i.country AND q.{k} = i.{k} AND q.{k} <> '' WHERE (i.country, i.{k}) IN (SELECT (country, {k}) FROM i GROUP BY country, {k} HAVING count(*) <= {cap})" for k in ("name_c", "name_sq", "addr_c"))
    return f"ex AS ({each})"


_E = f"{_C}, {_exact_sql(40)}"


def _exact(index: DataFrame, other: DataFrame) -> DataFrame:
    keys = ["name_c", "name_sq", "addr_c"]
    return retrieve.exact_join(linkage.keyed(index, *keys), linkage.keyed(other, *keys), keys, 40)


@query(f"{_E} SELECT q, d FROM ex")
def exact_capped_join(spark, sf):
    return _exact(*_sides(spark, sf))


_M = f"""{_E}, {_channel_sql(_SHIPPED['name_sq'], 'n')}, {_channel_sql(_SHIPPED['addr'], 'a')},
sn AS (SELECT a.id AS q, b.id AS d, round(sum(a.w * b.w), 6) AS s FROM nqv a JOIN ndv b ON a.term = b.term GROUP BY 1, 2),
sa AS (SELECT a.id AS q, b.id AS d, round(sum(a.w * b.w), 6) AS s FROM aqv a JOIN adv b ON a.term = b.term GROUP BY 1, 2),
tn AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, d) AS rn FROM sn WHERE s >= 0.32) WHERE rn <= 14),
ta AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, d) AS rn FROM sa WHERE s >= 0.30) WHERE rn <= 12),
un AS (SELECT q, d, 'exact' AS ch, 1.0::DOUBLE AS s FROM ex UNION ALL SELECT q, d, 'name', s FROM tn UNION ALL SELECT q, d, 'addr', s FROM ta),
m AS (SELECT q, d, coalesce(max(s) FILTER (ch = 'exact'), 0) AS exact, coalesce(max(s) FILTER (ch = 'name'), 0) AS name, coalesce(max(s) FILTER (ch = 'addr'), 0) AS addr FROM un GROUP BY 1, 2),
r AS (SELECT m.*, coalesce(sn.s, 0) AS name_cos, coalesce(sa.s, 0) AS addr_cos FROM m LEFT JOIN sn USING (q, d) LEFT JOIN sa USING (q, d))"""


def _merged(spark, sf) -> tuple[DataFrame, dict, DataFrame]:
    """(pairs of the other sources' classes of equal records, the folded vectors of both views, the classes' members)."""
    index, other = _sides(spark, sf)
    other, members = canon.classes(other)
    found, folded = {"exact": _exact(index, other).withColumn("s", F.lit(1.0))}, {}
    for name, view_of in (("name", "name_sq"), ("addr", "addr")):
        c = _SHIPPED[view_of]
        folded[f"{name}_cos"] = linkage.folded_view(index, other, c, _CONFIG, 28)
        found[name] = retrieve.topk_cosine(*folded[f"{name}_cos"], c.k, c.threshold)
    return written(merge.merge_channels(found), "pairs"), folded, members


def _rescored(spark, sf) -> tuple[DataFrame, DataFrame]:
    """(the classes' pairs with both views' cosines, the classes' members)."""
    m, folded, members = _merged(spark, sf)
    return written(vectors.pair_cosines(m, folded), "rescored"), members


@query(f"{_M} SELECT * FROM m")
def channel_union_max(spark, sf):
    m, _, members = _merged(spark, sf)
    return canon.each_member(m, members)


@query(f"{_M} SELECT q, d, name_cos, addr_cos FROM r")
def pair_rescore(spark, sf):
    rows, members = _rescored(spark, sf)
    return canon.each_member(rows.select("q", "d", "name_cos", "addr_cos"), members)


@query(f"""{_M} SELECT q, d, round(name_cos + addr_cos + 0.2 * exact + 1e-8, 6) AS sum, round(0.62 * name_cos + 0.38 * addr_cos + 0.2 * exact + 1e-8, 6) AS weighted,
round(sqrt(greatest(name_cos, 0) * greatest(addr_cos, 0)) + 0.2 * exact + 1e-8, 6) AS geometric, round(greatest(name_cos, addr_cos) + 0.5 * least(name_cos, addr_cos) + 0.25 * exact + 1e-8, 6) AS robust FROM r""")
def combine_modes(spark, sf):
    c = F.col("name_cos"), F.col("addr_cos"), F.col("exact")
    rows, members = _rescored(spark, sf)
    combined = rows.select("q", "d", *[r6(merge.combine(*c, mode) + OFF, mode) for mode in ("sum", "weighted", "geometric", "robust")])
    return canon.each_member(written(combined, "combined"), members)


@query(f"""{_E}, {_channel_sql(_SHIPPED['name_sq'], 'n')}, {_channel_sql(_SHIPPED['addr'], 'a')},
sn AS (SELECT a.id AS q, b.id AS d, round(sum(a.w * b.w), 6) AS s FROM nqv a JOIN ndv b ON a.term = b.term GROUP BY 1, 2),
sa AS (SELECT a.id AS q, b.id AS d, round(sum(a.w * b.w), 6) AS s FROM aqv a JOIN adv b ON a.term = b.term GROUP BY 1, 2),
un AS (SELECT q, d, 'exact' AS ch FROM ex UNION ALL SELECT q, d, 'name' FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, d) AS rn FROM sn WHERE s >= 0.32) WHERE rn <= 1
 UNION ALL SELECT q, d, 'addr' FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, d) AS rn FROM sa WHERE s >= 0.30) WHERE rn <= 1),
t AS (SELECT source1_entity_id AS d, unnest(string_split(matched_entity_ids, ',')) AS q FROM truth),
h AS (SELECT q, d, min(ch) AS channel FROM un SEMI JOIN t USING (q, d) GROUP BY 1, 2 HAVING count(*) = 1) SELECT channel, count(*) AS n FROM h GROUP BY 1""")
def sole_channel(spark, sf):
    index, other = _sides(spark, sf)
    (dn, qn), (da, qa) = (linkage.view_vectors(index, other, _SHIPPED[c], _CONFIG, 28) for c in ("name_sq", "addr"))
    found = {"exact": _exact(index, other).withColumn("s", F.lit(1.0)), "name": retrieve.topk_cosine(qn, dn, 1, 0.32), "addr": retrieve.topk_cosine(qa, da, 1, 0.30)}
    return merge.sole_channel(merge.merge_channels(found), tables.truth_pairs(view(spark, sf, "truth")), ["exact", "name", "addr"])


@query(f"""{_M}, p AS (SELECT q, d, round(name_cos + addr_cos + 0.2 * exact, 6) AS s FROM r),
tp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY d ORDER BY s DESC, q) AS rn FROM p) WHERE rn <= 3),
l AS (SELECT x.entity_id AS a, y.entity_id AS b, 0.5::DOUBLE + 0.5 * CAST(x.addr_c = y.addr_c AS INT) AS s FROM q x JOIN q y ON x.country = y.country AND x.name_c = y.name_c AND x.entity_id <> y.entity_id)
SELECT l.b AS q, tp.d, max(l.s) AS link FROM tp JOIN l ON tp.q = l.a WHERE (l.b, tp.d) NOT IN (SELECT (q, d) FROM p) GROUP BY 1, 2""")
def link_expansion(spark, sf):
    rows, members = _rescored(spark, sf)
    scored = written(rows.select("q", "d", F.round(merge.combine(F.col("name_cos"), F.col("addr_cos"), F.col("exact")), 6).alias("s")), "scored")
    # A class's members have the same pairs, so none of them is new where another is found, and links are the classes'.
    best = canon.each_member(retrieve.top(scored, 3, "d", "q").withColumn("class", F.col("q")), canon.first_members(members, 3))
    best = written(retrieve.top(best, 3, "d", "q").select(F.col("class").alias("q"), "d").distinct(), "best")
    own = _sides(spark, sf)[1].join(members.select(F.col("same").alias("entity_id")).distinct(), "entity_id", "left_semi")
    a, b = (own.select("country", "name_c", F.col("entity_id").alias(n), F.col("addr_c").alias(f"{n}n")) for n in ("a", "b"))
    a = a.join(best.select(F.col("q").alias("a")).distinct(), "a", "left_semi")
    links = a.join(b, ["country", "name_c"]).filter("a <> b").select("a", "b", (0.5 + 0.5 * (F.col("an") == F.col("bn")).cast("int")).alias("s"))
    return canon.each_member(written(retrieve.expand_links(scored, links, 3, best), "links"), members)


_DOT = "list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


@query(f"""WITH s AS (SELECT a.vec_id AS q, b.vec_id AS d, round({_DOT}, 6) AS s FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id)
SELECT q, d, s FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, d) AS rn FROM s) WHERE rn <= 10""")
def dense_topk(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))
    return retrieve.knn(rows.filter("id % 100 = 0"), rows, 10, exclude_same=True)


@query(f"""WITH s AS (SELECT a.vec_id AS q, b.vec_id AS d, round({_DOT}, 6) AS s FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
k AS (SELECT q, d FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s DESC, d) AS rn FROM s) WHERE rn <= 10), t AS (SELECT a.vec_id AS q, b.vec_id AS d FROM embeddings a JOIN embeddings b ON a.label = b.label AND b.vec_id BETWEEN a.vec_id + 1 AND a.vec_id + 99 WHERE a.vec_id % 100 = 0)
SELECT (SELECT count(*) FROM t SEMI JOIN k USING (q, d)) AS found, count(*) AS true_pairs, round((SELECT count(*) FROM t SEMI JOIN k USING (q, d)) / count(*), 6) AS recall FROM t""")
def dense_recall(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")
    found = retrieve.knn(rows.filter("id % 100 = 0"), rows, 10, exclude_same=True)
    a, b = rows.filter("id % 100 = 0").select(F.col("id").alias("q"), "label"), rows.select(F.col("id").alias("d"), "label")
    return retrieve.recall_at(found, a.join(b, "label").filter("d between q + 1 and q + 99").select("q", "d"))


@query(f"""WITH o AS (SELECT vec_id AS id, embedding, vec_id % 3 AS src, label FROM embeddings WHERE vec_id % 20 < 3),
s AS (SELECT a.id AS a, b.id AS b, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS s FROM o a JOIN o b ON a.label = b.label AND ((a.src = 1 AND b.src = 2) OR (a.src = 2 AND b.src = 1)))
SELECT a, b, s FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY s DESC, b) AS rn FROM s) WHERE rn <= 3""")
def dense_twins(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet").filter("vec_id % 20 < 3").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")
    return retrieve.twins(rows.filter("id % 3 = 1"), rows.filter("id % 3 = 2"), 3, by="label")


@query(f"SELECT a.vec_id AS q, b.vec_id AS d, round({_DOT}, 6) AS dot FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def pair_dot(spark, sf):
    rows = spark.read.parquet(f"{sf}/embeddings.parquet")
    a, b = rows.select(F.col("vec_id").alias("q"), F.col("embedding").alias("x")), rows.select((F.col("vec_id") - 1).alias("q"), F.col("vec_id").alias("d"), F.col("embedding").alias("y"))
    return a.join(b, "q").select("q", "d", r6(retrieve.dot(F.col("x"), F.col("y")), "dot"))


# --- Pair features ---------------------------------------------------------------------------------------------------

_P = f"{_E}, p AS (SELECT ex.q, ex.d, i.country, {', '.join(f'i.{c} AS a_{c}, q.{c} AS b_{c}' for c in ('name_c', 'name_core', 'name_sq', 'addr_c', 'addr_core', 'nums', 'postal'))} FROM ex JOIN i ON ex.d = i.entity_id JOIN q ON ex.q = q.entity_id)"


def _feature_pairs(spark, sf) -> DataFrame:
    index, other = _sides(spark, sf)
    return features.paired(_exact(index, other), index, other)


def _toks(c: str) -> str:
    return f"list_distinct(list_filter(string_split({c}, ' '), lambda t: t <> ''))"


_OV = "len(list_intersect({a}, {b}))"


@query(f"""{_P}, t AS (SELECT q, d, {_toks('a_addr_c')} AS a, {_toks('b_addr_c')} AS b FROM p), o AS (SELECT q, d, len(list_intersect(a, b)) AS n, len(a) AS na, len(b) AS nb FROM t)
SELECT q, d, round(CASE WHEN na + nb - n = 0 THEN 0 ELSE n / (na + nb - n) END, 6) AS jac, round(CASE WHEN least(na, nb) = 0 THEN 0 ELSE n / least(na, nb) END, 6) AS cont, CAST(na AS INT) AS n_a, CAST(nb AS INT) AS n_b FROM o""")
def overlap_features(spark, sf):
    rows = features.overlap_features(_feature_pairs(spark, sf), {"addr": ("addr_c", "word")})
    return rows.select("q", "d", r6(F.col("addr_jac"), "jac"), r6(F.col("addr_cont"), "cont"), F.col("addr_n_a").alias("n_a"), F.col("addr_n_b").alias("n_b"))


@query(f"""{_P}, f AS (SELECT t, ln((SELECT count(*) + 1 FROM c)::DOUBLE / (count(*) + 1)) AS w FROM (SELECT unnest({_toks('addr_c')}) AS t FROM c) GROUP BY 1),
s AS (SELECT q, d, unnest(list_intersect({_toks('a_addr_c')}, {_toks('b_addr_c')})) AS t FROM p)
SELECT p.q, p.d, round(coalesce(x.w, 0), 6) AS rare FROM p LEFT JOIN (SELECT q, d, max(w) AS w FROM s JOIN f USING (t) GROUP BY 1, 2) x USING (q, d)""")
def rare_shared_token(spark, sf):
    both = canon_of(spark, sf, "recs")
    n = both.count()
    df = both.select(F.explode(F.array_distinct(vectors.analyze(F.col("addr_c"), "word"))).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df"))
    shared = _feature_pairs(spark, sf).select("q", "d", F.array_intersect(vectors.analyze(F.col("a_addr_c"), "word"), vectors.analyze(F.col("b_addr_c"), "word")).alias("ts"))
    rare = shared.select("q", "d", F.explode_outer("ts").alias("t")).join(df.withColumn("w", F.log(F.lit(n + 1.0) / (F.col("df") + 1))), "t", "left")
    return rare.groupBy("q", "d").agg(r6(F.coalesce(F.max("w"), F.lit(0.0)), "rare"))


@query(f"""{_P}, n AS (SELECT q, d, nullif(substr(split_part(a_nums, ' ', 1), 1, 9), '') AS ta, nullif(substr(split_part(b_nums, ' ', 1), 1, 9), '') AS tb FROM p),
m AS (SELECT *, ta::DOUBLE AS a, tb::DOUBLE AS b FROM n)
SELECT q, d, b - a AS hn_delta, abs(b - a) AS hn_abs, CAST(a = b AS DOUBLE) AS hn_eq, CAST(b - a >= 1 AND b - a <= 25 AS DOUBLE) AS hn_small_pos,
CASE WHEN a IS NOT NULL AND b IS NOT NULL AND greatest(a, b) > 0 THEN round(least(a, b) / greatest(a, b), 6) END AS hn_ratio, CAST(len(ta) AS DOUBLE) AS hn_len_a, CAST(levenshtein(ta, tb) AS DOUBLE) AS hn_lev FROM m""")
def house_number_features(spark, sf):
    rows = features.number_features(_feature_pairs(spark, sf))
    return rows.select("q", "d", r6(F.col("hn_ratio"), "hn_ratio"), *[F.col(f"hn_{c}").cast("double").alias(f"hn_{c}") for c in ("delta", "abs", "eq", "small_pos", "len_a", "lev")])


def _view_sql(tag: str, column: str, terms: str) -> str:
    """CTEs {tag}a and {tag}b (id, term, w): the unpruned unit vectors of index and query, of terms that the country's index knows."""
    tf = lambda side: f"SELECT entity_id AS id, country, term, count(*) AS tf FROM (SELECT entity_id, country, unnest({terms.format(c=column)}) AS term FROM {side}) GROUP BY 1, 2, 3"
    unit = lambda side: f"SELECT id, term, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS w FROM (SELECT x.id, x.term, idf * (1 + ln(tf)) AS w FROM {tag}{side}0 x JOIN {tag}f f ON x.country = f.country AND x.term = f.term)"
    return f"""{tag}a0 AS ({tf('i')}), {tag}b0 AS ({tf('q')}),
{tag}f AS (SELECT country, term, ln((1 + any_value(n)) / (1 + count(*))) + 1 AS idf FROM {tag}a0 JOIN (SELECT country, count(*)::DOUBLE AS n FROM i GROUP BY 1) USING (country) GROUP BY 1, 2),
{tag}a AS ({unit('a')}), {tag}b AS ({unit('b')}),
{tag}s AS (SELECT ex.q, ex.d, sum(a.w * b.w) AS cos, count(*) AS n FROM ex JOIN {tag}a a ON a.id = ex.d JOIN {tag}b b ON b.id = ex.q AND b.term = a.term GROUP BY 1, 2),
{tag}n AS (SELECT id, count(*) AS n FROM {tag}a GROUP BY 1 UNION ALL SELECT id, count(*) FROM {tag}b GROUP BY 1)"""


_LONG = "regexp_extract_all({c}, '[\\p{{L}}\\p{{N}}_]{{2,}}')"
_CHARS = "list_concat(CASE WHEN len({c}) < 3 THEN [] ELSE list_transform(range(1, len({c}) - 1), lambda i: substr({c}, i, 3)) END, CASE WHEN len({c}) < 4 THEN [] ELSE list_transform(range(1, len({c}) - 2), lambda i: substr({c}, i, 4)) END)"


def _counted_sql(tag: str, view: str) -> str:
    x, y, n = f"coalesce({tag}x.n, 0)", f"coalesce({tag}y.n, 0)", f"coalesce({tag}s.n, 0)"
    return f"""round(CASE WHEN {x} + {y} - {n} = 0 THEN 0 ELSE {n} / ({x} + {y} - {n}) END, 6) AS jac_{view}, round(CASE WHEN least({x}, {y}) = 0 THEN 0 ELSE {n} / least({x}, {y}) END, 6) AS cont_{view},
CAST({x} AS INT) AS n_{view}_a, CAST({y} AS INT) AS n_{view}_b"""


@query(f"""{_E}, {_view_sql('u', 'name_c', _LONG)}, {_view_sql('v', 'addr_c', _LONG)}, {_view_sql('z', 'name_sq', _CHARS)}
SELECT ex.q, ex.d, round(coalesce(us.cos, 0), 6) AS cos_name_tok, round(coalesce(vs.cos, 0), 6) AS cos_addr_tok, round(coalesce(zs.cos, 0), 6) AS cos_name_ch, {_counted_sql('u', 'name_tok')}, {_counted_sql('v', 'addr_tok')}
FROM ex LEFT JOIN us USING (q, d) LEFT JOIN vs USING (q, d) LEFT JOIN zs USING (q, d) LEFT JOIN un ux ON ux.id = ex.d LEFT JOIN un uy ON uy.id = ex.q LEFT JOIN vn vx ON vx.id = ex.d LEFT JOIN vn vy ON vy.id = ex.q""")
def view_features(spark, sf):
    index, other = _sides(spark, sf)
    rows = features.view_features(_exact(index, other), index, other)
    return rows.select("q", "d", "cos_name_tok", "cos_addr_tok", "cos_name_ch", *[c for v in ("name_tok", "addr_tok") for c in (r6(F.col(f"jac_{v}"), f"jac_{v}"), r6(F.col(f"cont_{v}"), f"cont_{v}"), f"n_{v}_a", f"n_{v}_b")])


def _rich_sql(f: str) -> str:
    t = "list_distinct(list_filter(string_split({x}, ' '), lambda t: t <> ''))"
    return f"""{f}t AS (SELECT entity_id AS id, country, {t.format(x=f)} AS t FROM c), {f}f AS (SELECT country, term, ln((any_value(n) + 1) / (count(*) + 1)) AS w FROM (SELECT country, unnest(t) AS term FROM {f}t) JOIN (SELECT country, count(*)::DOUBLE AS n FROM c GROUP BY 1) USING (country) GROUP BY 1, 2),
{f}x AS (SELECT ex.q, ex.d, a.country, len(list_intersect(a.t, b.t)) AS n, len(a.t) AS na, len(b.t) AS nb, list_intersect(a.t, b.t) AS sh FROM ex JOIN {f}t a ON a.id = ex.d JOIN {f}t b ON b.id = ex.q),
{f}m AS (SELECT q, d, max(w) AS w FROM (SELECT q, d, country, unnest(sh) AS term FROM {f}x) JOIN {f}f USING (country, term) GROUP BY 1, 2),
{f}r AS (SELECT q, d, CAST(n AS INT) AS {f}_inter, round(CASE WHEN na + nb - n = 0 THEN 0 ELSE n / (na + nb - n) END, 6) AS {f}_jac, round(CASE WHEN least(na, nb) = 0 THEN 0 ELSE n / least(na, nb) END, 6) AS {f}_cont, round(coalesce(w, 0), 6) AS {f}_maxidf FROM {f}x LEFT JOIN {f}m USING (q, d))"""


@query(f"{_E}, {', '.join(_rich_sql(f) for f in features.RICH_FIELDS)} SELECT * FROM name_cr JOIN addr_cr USING (q, d) JOIN addr_corer USING (q, d) JOIN numsr USING (q, d)")
def rich_features(spark, sf):
    index, other = _sides(spark, sf)
    rows, names = features.rich_features(_exact(index, other), index, other)
    return rows.select("q", "d", *[r6(F.col(c), c) if not c.endswith("_inter") else c for c in names if not c.startswith("fz_")])


def _stat_sql(side: str, key: str, other: str) -> str:
    w = f"PARTITION BY {key} ORDER BY block_score DESC, {other}"
    return f"""row_number() OVER ({w}) - 1 AS {side}_rank, count(*) OVER (PARTITION BY {key}) AS {side}_size, round(block_score - max(block_score) OVER (PARTITION BY {key}), 6) AS {side}_gap,
round(max(block_score) OVER (PARTITION BY {key}) - coalesce(nth_value(block_score, 2) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 0), 6) AS {side}_margin"""


@query(f"""{_M}, k AS (SELECT q, d, name_cos, addr_cos, exact AS exact_hit, round(name_cos + addr_cos + 0.2 * exact, 6) AS block_score, name AS ch_name_sq, addr AS ch_addr, exact AS ch_exact FROM r)
SELECT *, {_stat_sql('s1', 'd', 'q')}, {_stat_sql('cand', 'q', 'd')} FROM k""")
def pruner_features(spark, sf):
    zero = {c: F.lit(0.0) for c in ("dense_cos", *(f"ch_{c}" for c in ("name_tok", "addr_core", "joint", "dense", "link")))}
    score = F.round(merge.combine(F.col("name_cos"), F.col("addr_cos"), F.col("exact")), 6)
    rows, members = _rescored(spark, sf)
    rows = rows.withColumns({"exact_hit": F.col("exact"), "block_score": score, "ch_name_sq": F.col("name"), "ch_addr": F.col("addr"), "ch_exact": F.col("exact"), **zero})
    got = merge.pruner_features(rows, members).drop(*zero)
    return got.withColumns({f"{p}_{k}": F.round(f"{p}_{k}", 6) for p in ("s1", "cand") for k in ("gap", "margin")})


@query(f"""WITH {PAIRS}, h AS (SELECT s1, cand, p, eq, row_number() OVER (PARTITION BY s1 ORDER BY p DESC, cand) - 1 AS rk FROM pr WHERE CAST(CAST('0x' || substr(sha256(CAST(s1 AS VARCHAR)), 1, 8) AS BIGINT) % 10 AS INT) = 0),
c AS (SELECT unnest([0.1, 0.3, 0.6]::DOUBLE[]) AS cut) SELECT cut, count(*) AS pairs, count(*) FILTER (eq) AS found, round(count(*) / (SELECT count(DISTINCT s1) FROM h), 6) AS cands_per_s1, round(count(*) FILTER (eq) / (SELECT count(*) FROM h WHERE eq), 6) AS recall FROM h JOIN c ON p >= cut WHERE rk < 4 GROUP BY 1""")
def prune_size_recall(spark, sf):
    rows = pairs(spark, sf)
    return prune.size_recall(rows, rows.filter("eq"), "p", 4, (0.1, 0.3, 0.6))


@query(f"{_C} SELECT entity_id, count(*) OVER (PARTITION BY country, name_c) AS n FROM i")
def name_multiplicity(spark, sf):
    return features.multiplicity(canon_of(spark, sf, "s1"), "name_c", "n").select("entity_id", "n")


@query(f"{_P}, t AS (SELECT q, d, {_toks('a_postal')} AS a, {_toks('b_postal')} AS b FROM p) SELECT q, d, CAST(len(list_intersect(a, b)) > 0 AS INT) AS postal_match, CAST(len(a) > 0 AND len(b) > 0 AS INT) AS postal_known FROM t")
def postal_match(spark, sf):
    return features.postal_features(_feature_pairs(spark, sf)).select("q", "d", "postal_match", "postal_known")


@query(f"""{_P} SELECT q, d, CAST(len(a_addr_c) AS INT) AS addr_c_len_a, CAST(len(b_addr_c) AS INT) AS addr_c_len_b,
round(CASE WHEN greatest(len(a_addr_c), len(b_addr_c)) = 0 THEN 0 ELSE least(len(a_addr_c), len(b_addr_c)) / greatest(len(a_addr_c), len(b_addr_c)) END, 6) AS addr_c_len_ratio, CAST(b_addr_c = '' AS INT) AS addr_c_empty_b, CAST(q[2] = '3' AS INT) AS src_is_s3 FROM p""")
def len_features(spark, sf):
    rows = features.length_features(_feature_pairs(spark, sf), ("addr_c",))
    return rows.select("q", "d", "addr_c_len_a", "addr_c_len_b", r6(F.col("addr_c_len_ratio"), "addr_c_len_ratio"), "addr_c_empty_b", features.source_flag(F.col("q")).alias("src_is_s3"))


_NAMES = "WITH n AS (SELECT DISTINCT p_name AS x FROM part), p AS (SELECT a.x AS a, b.x AS b FROM n a JOIN n b ON split_part(a.x, ' ', 1) = split_part(b.x, ' ', 1) OR split_part(a.x, ' ', 2) = split_part(b.x, ' ', 2))"


def _name_pairs(spark, sf) -> DataFrame:
    """Distinct names that share a word in the same place."""
    n = spark.read.parquet(f"{sf}/part.parquet").select("p_name").distinct()
    words = n.select("p_name", F.posexplode(F.split("p_name", " ")).alias("i", "w"))
    a, b = words.select(F.col("p_name").alias("a"), "i", "w"), words.select(F.col("p_name").alias("b"), "i", "w")
    return a.join(b, ["i", "w"]).select("a", "b").distinct()


@query(f"{_NAMES} SELECT a, b, round(jaro_winkler_similarity(a, b), 6) AS jw FROM p")
def jaro_winkler_ascii(spark, sf):
    return _name_pairs(spark, sf).select("a", "b", r6(sim.jaro_winkler_udf("a", "b"), "jw"))


@query(f"{_NAMES} SELECT a, b, CAST(levenshtein(a, b) AS INT) AS lev FROM p")
def levenshtein_ascii(spark, sf):
    return _name_pairs(spark, sf).select("a", "b", F.levenshtein("a", "b").alias("lev"))


@query()
def fuzz_scores(spark, sf):
    rows = features.fuzzy_features(_feature_pairs(spark, sf))
    return rows.select("q", "d", *[r6(F.col(c), c) for c in rows.columns if c.startswith(("name_c_", "addr_c_", "sq_"))])


# --- Folds, scores, calibration ----------------------------------------------------------------------------------------

_FOLD = "CAST(CAST('0x' || substr(sha256(CAST({x} AS VARCHAR)), 1, 8) AS BIGINT) % {n} AS INT)"


@query(f"SELECT p_partkey, {_FOLD.format(x='p_partkey', n=10)} AS fold FROM part")
def entity_fold(spark, sf):
    return spark.read.parquet(f"{sf}/part.parquet").select("p_partkey", models.entity_fold(F.col("p_partkey")).alias("fold"))


_T = "t AS (SELECT source1_entity_id AS s1, unnest(string_split(matched_entity_ids, ',')) AS cand FROM truth)"


@query(f"{_E}, {_T} SELECT d AS s1, q AS cand, CAST((d, q) IN (SELECT (s1, cand) FROM t) AS INT) AS label FROM ex")
def label_join(spark, sf):
    rows = _exact(*_sides(spark, sf)).select(F.col("d").alias("s1"), F.col("q").alias("cand"))
    return features.label(rows, tables.truth_pairs(view(spark, sf, "truth")))


_LP = f"WITH {PAIRS}, x AS (SELECT round(p, 6) AS p, CAST(eq AS INT) AS y FROM pr)"


def _scored(spark, sf) -> DataFrame:
    return pairs(spark, sf).select(r6(F.col("p"), "p"), F.col("eq").cast("int").alias("y"))


@query(f"""{_LP}, c AS (SELECT list_sort(list_distinct(list_transform(quantile_cont(p, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]), lambda v: round(v, 9)))) AS cuts FROM x)
SELECT CAST(greatest(least(len(list_filter(cuts, lambda v: v <= p)) - 1, len(cuts) - 2), 0) AS INT) AS bin, count(*) AS n, round(avg(p), 6) AS mean_p, round(avg(y), 6) AS rate FROM x, c GROUP BY 1""")
def calibration_bins(spark, sf):
    return evaluate.calibration(_scored(spark, sf))


@query(f"{_LP} SELECT round(avg(CAST((p >= 0.5) = (y = 1) AS INT)), 6) AS accuracy FROM x")
def accuracy(spark, sf):
    return _scored(spark, sf).agg(r6(evaluate.accuracy(F.col("p"), F.col("y")), "accuracy"))


_CLIP = "least(greatest({p}, 1e-6), 1 - 1e-6)"
_LOGIT = f"ln({_CLIP} / (1 - {_CLIP}))"


@query(f"WITH {PAIRS} SELECT s1, cand, round(1 / (1 + exp(-({_LOGIT.format(p='p')} + {_LOGIT.format(p='(p * p)')}) / 2)), 6) AS p FROM pr")
def logit_blend(spark, sf):
    return pairs(spark, sf).select("s1", "cand", r6(models.blend(F.col("p"), F.col("p") * F.col("p")), "p"))


@query(f"{_LP} SELECT round(avg(-(y * ln({_CLIP.format(p='p')}) + (1 - y) * ln(1 - {_CLIP.format(p='p')}))), 6) AS log_loss FROM x")
def log_loss(spark, sf):
    return _scored(spark, sf).agg(r6(evaluate.log_loss(F.col("p"), F.col("y")), "log_loss"))


@query(f"{_LP}, g AS (SELECT p, sum(y)::DOUBLE AS pos, sum(1 - y)::DOUBLE AS neg FROM x GROUP BY 1), h AS (SELECT *, coalesce(sum(neg) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g) SELECT round(sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)), 6) AS auc FROM h")
def auc(spark, sf):
    return evaluate.auc(_scored(spark, sf))


@query()
def isotonic(spark, sf):
    rows = pairs(spark, sf).select("s1", "cand", "p", F.col("eq").cast("double").alias("label"))
    return models.fit_calibrator(rows).transform(rows).select("s1", "cand", "p", "calibrated")


def _model_rows(spark, sf) -> tuple[DataFrame, list[str]]:
    rows = features.length_features(features.overlap_features(features.number_features(_feature_pairs(spark, sf)), {"addr": ("addr_c", "word"), "name": ("name_c", "word")}))
    rows = features.label(rows.withColumnsRenamed({"d": "s1", "q": "cand"}), tables.truth_pairs(view(spark, sf, "truth")))
    keep = [c for c in models.feature_columns(rows)]
    # Training passes over them again and again.
    return written(rows.select("s1", "cand", "country", "label", *keep), "model_rows"), keep


@query()
def pruner_gbt(spark, sf):
    rows, columns = _model_rows(spark, sf)
    rows = rows.withColumn("validation", models.entity_fold(F.col("s1")) == 0)
    model = models.train_trees(rows, columns, rounds=10, depth=4)
    return merge.prune_top(models.predict(model, rows, columns), "s1", "cand", "p", 12, 0.01).select("s1", "cand", "label", r6(F.col("p"), "p"))


# --- Match sets against the truth ----------------------------------------------------------------------------------------

_SETS = f"{_E}, {_T}, pd AS (SELECT d AS s1, list(q) AS pred FROM ex GROUP BY 1), td AS (SELECT source1_entity_id AS s1, list_filter(string_split(matched_entity_ids, ','), lambda x: x <> '') AS truth FROM truth), z AS (SELECT i.country, coalesce(pred, []) AS pred, truth FROM td JOIN i ON i.entity_id = td.s1 LEFT JOIN pd ON pd.s1 = td.s1), f AS (SELECT country, len(truth) AS nt, CASE WHEN len(pred) = 0 AND len(truth) = 0 THEN 1.0::DOUBLE WHEN len(list_intersect(pred, truth)) = 0 THEN 0 ELSE 1.25 * len(list_intersect(pred, truth)) / (0.25 * len(truth) + len(pred)) END AS f FROM z)"


def _sets(spark, sf) -> DataFrame:
    index, other = _sides(spark, sf)
    pred = _exact(index, other).groupBy(F.col("d").alias("s1")).agg(F.collect_set("q").alias("pred"))
    truth = view(spark, sf, "truth").select(F.col("source1_entity_id").alias("s1"), F.filter(F.split("matched_entity_ids", ","), lambda x: x != "").alias("truth"))
    rows = truth.join(index.select(F.col("entity_id").alias("s1"), "country"), "s1").join(pred, "s1", "left")
    return rows.withColumn("pred", F.coalesce("pred", F.array().cast("array<string>"))).withColumn("n_true", F.size("truth"))


@query(f"{_SETS} SELECT round(avg(f), 6) AS f05, count(*) AS n FROM f")
def macro_f05(spark, sf):
    return evaluate.macro_f05(_sets(spark, sf))


@query(f"{_SETS} SELECT country, CAST(nt AS INT) AS n_true, round(avg(f), 6) AS f05, count(*) AS n FROM f GROUP BY ALL")
def f05_breakdown(spark, sf):
    return evaluate.macro_f05(_sets(spark, sf), "country", "n_true")


@query(f"""{_E}, {_T}, z AS (SELECT (SELECT count(*) FROM i) AS ni, (SELECT count(*) FROM q) AS nq, (SELECT count(*) FROM t WHERE cand <> '') AS true_pairs, (SELECT count(*) FROM t WHERE (s1, cand) IN (SELECT (d, q) FROM ex)) AS found, (SELECT count(*) FROM ex) AS pairs)
SELECT pairs, true_pairs, found, round(found / true_pairs, 6) AS completeness, round(pairs / ni, 6) AS cands_per_s1, round(1 - pairs / (ni::DOUBLE * nq), 6) AS reduction_ratio FROM z""")
def pair_completeness(spark, sf):
    index, other = _sides(spark, sf)
    cands = _exact(index, other).select(F.col("d").alias("s1"), F.col("q").alias("cand"))
    return evaluate.pair_completeness(cands, tables.truth_pairs(view(spark, sf, "truth")), index.count(), other.count())


# --- Stop words and lexicon ------------------------------------------------------------------------------------------------

_TOK = f"tk AS (SELECT lang AS country, doc_id AS doc, generate_subscripts(w, 1) - 1 AS pos, unnest(w) AS token, len(w) AS n FROM (SELECT lang, doc_id, regexp_extract_all(lower(text), '{WORDS}') AS w FROM documents))"
_ST = f"WITH {_TOK}, st AS (SELECT country, token, count(*) AS tf, count(DISTINCT doc) AS df FROM tk GROUP BY 1, 2)"


def _docs(spark, sf) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/documents.parquet")
    return rows.select(F.col("lang").alias("country"), F.col("doc_id").alias("doc"), F.array_join(F.regexp_extract_all(F.lower("text"), F.lit(WORDS), F.lit(0)), " ").alias("text"))


@query(f"{_ST} SELECT * FROM st")
def token_stats(spark, sf):
    return adaptive.token_stats(adaptive.tokenized(_docs(spark, sf)))


_STOPS = f"""{_ST}, hd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY country ORDER BY tf DESC, token) AS rk FROM st) WHERE rk <= 1000),
xy AS (SELECT *, ln(rk) AS x, ln(tf) AS y, count(*) OVER (PARTITION BY country) AS n FROM hd),
un AS (SELECT country, rk, n, round((y - min(y) OVER c) / (max(y) OVER c - min(y) OVER c) - (1 - (x - min(x) OVER c) / (max(x) OVER c - min(x) OVER c)), 9) AS o FROM xy WINDOW c AS (PARTITION BY country)),
kn AS (SELECT country, arg_min(rk, (-o, rk)) AS knee FROM un GROUP BY 1),
nn AS (SELECT *, row_number() OVER (PARTITION BY country ORDER BY tf DESC, token) AS r2 FROM hd WHERE NOT regexp_matches(token, '^[0-9]+$')),
sw AS (SELECT country, token, tf, df FROM nn JOIN kn USING (country) WHERE r2 <= knee AND df >= 5 AND r2 <= 300)"""


@query(f"{_STOPS} SELECT * FROM sw")
def stop_words_knee(spark, sf):
    return adaptive.stop_words(adaptive.token_stats(adaptive.tokenized(_docs(spark, sf))))


@query(f"""{_STOPS}, lr AS (SELECT country, token, coalesce(lag(token) OVER w, '<s>') AS l, coalesce(lead(token) OVER w, '</s>') AS r FROM tk WINDOW w AS (PARTITION BY country, doc ORDER BY pos)),
nb AS (SELECT country, token, 'l' AS side, l AS neighbour FROM lr UNION ALL SELECT country, token, 'r', r FROM lr),
kw AS (SELECT country, token AS neighbour FROM hd WHERE rk <= 100 UNION ALL SELECT DISTINCT country, unnest(['<s>', '</s>']) FROM st)
SELECT country, token, side, neighbour, count(*) AS n FROM nb SEMI JOIN sw USING (country, token) SEMI JOIN kw USING (country, neighbour) GROUP BY ALL""")
def neighbour_profiles(spark, sf):
    t = adaptive.tokenized(_docs(spark, sf))
    s = adaptive.token_stats(t)
    return adaptive.neighbours(t, s, adaptive.stop_words(s))


@query()
def hac_roles(spark, sf):
    t = adaptive.tokenized(_docs(spark, sf))
    s = adaptive.token_stats(t)
    stops = adaptive.stop_words(s)
    return adaptive.roles(stops, adaptive.neighbours(t, s, stops), adaptive.positions(t, stops))


_AL = f"""{_B}, {_T}, al AS (SELECT t.s1, t.cand, x.country, string_split(x.addr_b, ' ') AS c, string_split(y.addr_b, ' ') AS n FROM t JOIN b x ON x.entity_id = t.s1 JOIN b y ON y.entity_id = t.cand WHERE y.addr_b <> ''),
rs AS (SELECT *, list_filter(c, lambda x, i: len(list_filter(c[1:i], lambda y: y = x)) > len(list_filter(n, lambda y: y = x))) AS rc,
 list_filter(n, lambda x, i: len(list_filter(n[1:i], lambda y: y = x)) > len(list_filter(c, lambda y: y = x))) AS rn FROM al)"""


def _aligned(spark, sf) -> DataFrame:
    b = canon.basic(view(spark, sf, "recs")).select("entity_id", "country", F.filter(F.split("addr_b", " "), lambda x: x != "").alias("t"))
    t = tables.truth_pairs(view(spark, sf, "truth"))
    rows = t.join(b.select(F.col("entity_id").alias("s1"), "country", F.col("t").alias("clean")), "s1").join(b.select(F.col("entity_id").alias("cand"), F.col("t").alias("noisy")), "cand")
    return written(lexicon.align(written(rows.withColumn("field", F.lit("addr")), "sides")), "aligned")


@query(f"{_AL} SELECT country, noisy, clean, count(*) AS n FROM (SELECT country, unnest(rn) AS noisy, unnest(rc) AS clean FROM rs WHERE len(rc) = len(rn)) GROUP BY ALL")
def lexicon_pair_counts(spark, sf):
    return lexicon.collect(_aligned(spark, sf))["pair"].select("country", "noisy", "clean", "n")


@query(f"""{_B}, {_T}, al AS (SELECT t.s1, x.country, string_split(x.name_b, ' ') AS c, CASE WHEN CAST(substr(t.s1, 4) AS BIGINT) % 4 = 0 THEN list_prepend('messrs', string_split(y.name_b, ' ')) ELSE string_split(y.name_b, ' ') END AS n FROM t JOIN b x ON x.entity_id = t.s1 JOIN b y ON y.entity_id = t.cand),
ld AS (SELECT country, n[1] AS token, count(*) AS n FROM al GROUP BY 1, 2), cl AS (SELECT country, token, count(*) AS m FROM (SELECT country, unnest(list_distinct(c)) AS token FROM al) GROUP BY 1, 2)
SELECT country, token, n FROM ld LEFT JOIN cl USING (country, token) WHERE n >= 25 AND coalesce(m, 0) < 0.1 * n""")
def junk_prefix(spark, sf):
    b = canon.basic(view(spark, sf, "recs")).select("entity_id", "country", F.split("name_b", " ").alias("t"))
    rows = tables.truth_pairs(view(spark, sf, "truth")).join(b.select(F.col("entity_id").alias("s1"), "country", F.col("t").alias("clean")), "s1").join(b.select(F.col("entity_id").alias("cand"), F.col("t").alias("noisy")), "cand")
    led = F.when(F.substring("s1", 4, 20).cast("long") % 4 == 0, F.array_prepend("noisy", F.lit("messrs"))).otherwise(F.col("noisy"))
    c = lexicon.collect(lexicon.align(written(rows.withColumn("noisy", led).withColumn("field", F.lit("name")), "sides")))
    return lexicon.junk_prefix(c["lead"], c["clean"]).select("country", "token", "n")


_USE = """{t}r AS (SELECT entity_id AS doc, country, generate_subscripts(w, 1) AS pos, unnest(w) AS token FROM (SELECT entity_id, country, list_filter(string_split(addr_b, ' '), lambda x: x <> '') AS w FROM b WHERE {where})),
{t}n AS (SELECT country, token, count(*) AS n, count(*)::DOUBLE / sum(count(*)) OVER (PARTITION BY country) AS p FROM {t}r GROUP BY 1, 2),
{t}l AS (SELECT country, token, coalesce(lag(token) OVER w, '^') AS l, coalesce(lead(token) OVER w, '$') AS r FROM {t}r WINDOW w AS (PARTITION BY doc ORDER BY pos)),
{t}c AS (SELECT country, token, side, nb, count(*)::DOUBLE AS n FROM (SELECT country, token, 'l' AS side, l AS nb FROM {t}l UNION ALL SELECT country, token, 'r', r FROM {t}l) GROUP BY ALL),
{t}h AS (SELECT country, token, sqrt(sum(n * n)) AS h FROM {t}c GROUP BY 1, 2)"""

_LF = f"""{_B}, {_USE.format(t='c', where="entity_id LIKE 'S1-%'")}, {_USE.format(t='n', where="entity_id NOT LIKE 'S1-%'")},
bo AS (SELECT country, token, coalesce(nn.n, 0) AS nn, coalesce(nn.p, 0) AS pn, coalesce(cn.n, 0) AS nc, coalesce(cn.p, 0) AS pc FROM nn FULL JOIN cn USING (country, token) WHERE NOT regexp_matches(token, '^[0-9]+$')),
pp AS (SELECT k.country, k.token AS key, v.token AS value FROM bo k JOIN bo v ON k.country = v.country AND substr(k.token, 1, 1) = substr(v.token, 1, 1) AND len(k.token) < len(v.token) AND regexp_matches(v.token, array_to_string(string_split(k.token, ''), '.*'))
  WHERE k.pn > 2e-4 AND k.pn > 3 * k.pc AND v.pc > 2e-4 AND v.pc > 1.15 * v.pn),
cs AS (SELECT pp.country, key, value, round(sum(a.n * b.n) / (any_value(x.h) * any_value(y.h)), 6) AS cos FROM pp JOIN nc a ON a.country = pp.country AND a.token = key JOIN cc b ON b.country = pp.country AND b.token = value AND a.side = b.side AND a.nb = b.nb
  JOIN nh x ON x.country = pp.country AND x.token = key JOIN ch y ON y.country = pp.country AND y.token = value GROUP BY 1, 2, 3),
vr AS (SELECT country, key, value, cos FROM (SELECT *, row_number() OVER (PARTITION BY country, key ORDER BY cos DESC, value DESC) AS rn FROM cs) WHERE rn = 1 AND cos >= 0.9)"""


def _unpaired(spark, sf) -> tuple[DataFrame, DataFrame]:
    own = lambda n: written(canon.basic(view(spark, sf, n)).select("country", F.col("entity_id").alias("doc"), F.col("addr_b").alias("text")), n)
    return own("s1"), own("others")


@query(f"{_LF} SELECT * FROM vr")
def label_free_variants(spark, sf):
    return lexicon.label_free_variants(*_unpaired(spark, sf))


@query(f"""{_LF}, mp AS (SELECT country, key AS token FROM vr UNION SELECT country, value FROM vr),
ge AS (SELECT country, token, round(abs(pc - pn), 9) AS gap FROM bo WHERE greatest(pc, pn) > 2e-4 AND greatest(pc, pn) > 2 * least(pc, pn) AND (country, token) NOT IN (SELECT (country, token) FROM mp))
SELECT country, token, round(gap, 6) AS gap FROM (SELECT *, row_number() OVER (PARTITION BY country ORDER BY gap DESC, token) AS rn FROM ge) WHERE rn <= 600""")
def label_free_generic(spark, sf):
    clean, noisy = _unpaired(spark, sf)
    return lexicon.label_free_generic(clean, noisy, lexicon.label_free_variants(clean, noisy)).select("country", "token", r6(F.col("gap"), "gap"))


@query(f"""{_B}, nd AS (SELECT country, string_split(name_b, ' ') AS w FROM b WHERE entity_id NOT LIKE 'S1-%'), cd AS (SELECT country, string_split(addr_b, ' ') AS w FROM b WHERE entity_id LIKE 'S1-%'),
sc AS (SELECT country, count(*) AS nn, (SELECT count(*) FROM cd WHERE cd.country = nd.country) AS nc FROM nd GROUP BY 1), ld AS (SELECT country, w[1] AS token, count(*) AS n FROM nd WHERE w[1] <> '' GROUP BY 1, 2),
sd AS (SELECT country, token, count(*) AS m FROM (SELECT country, unnest(list_distinct(w)) AS token FROM cd) GROUP BY 1, 2)
SELECT ld.country, ld.token, ld.n FROM ld JOIN sc USING (country) LEFT JOIN sd USING (country, token) WHERE n >= 25 AND coalesce(m, 0) * nn / nc < 0.1 * n""")
def label_free_prefix(spark, sf):
    b = canon.basic(view(spark, sf, "recs"))
    side = lambda like, c: b.filter(like).select("country", F.col("entity_id").alias("doc"), F.col(c).alias("text"))
    return lexicon.label_free_prefix(side(F.col("entity_id").like("S1-%"), "addr_b"), side(~F.col("entity_id").like("S1-%"), "name_b"))


@query(f"{_V} SELECT DISTINCT country FROM recs WHERE country NOT IN ('C0', 'C1')")
def unlabelled_countries(spark, sf):
    lex = spark.createDataFrame(_LEXICON, canon.LEXICON)
    return stack.unlabelled_countries(lexicon.unlabelled(view(spark, sf, "recs"), lex), lex)


@query()
def lexicon_distil(spark, sf):
    return lexicon.distil(lexicon.collect(_aligned(spark, sf)))


# --- Stacking, validation, the whole pipeline --------------------------------------------------------------------------------

_STK = f"WITH {PAIRS}, sc AS (SELECT s1, cand, p * p AS ce FROM pr WHERE cand % 7 <> 0), k AS (SELECT pr.*, {_LOGIT.format(p='coalesce(ce, 0.5)')} AS l FROM pr LEFT JOIN sc USING (s1, cand))"


def _stacked(spark, sf) -> DataFrame:
    p = pairs(spark, sf)
    return stack.with_scores(p, p.filter("cand % 7 <> 0").select("s1", "cand", (F.col("p") * F.col("p")).alias("ce")), "ce", check=False)


@query(f"{_STK} SELECT s1, cand, round(l, 6) AS ce_logit FROM k")
def stack_left_join(spark, sf):
    return _stacked(spark, sf).select("s1", "cand", r6(F.col("ce_logit"), "ce_logit"))


@query(f"{_STK}, c AS (SELECT *, 'C' || CAST(s1 % 3 AS VARCHAR) AS country FROM k) SELECT s1, cand, round(CASE country WHEN 'C2' THEN 1 / (1 + exp(-(1.4 * {_LOGIT.format(p='p')} - 1))) WHEN 'C0' THEN 1 / (1 + exp(-l)) ELSE p END, 6) AS p FROM c")
def country_override_shift(spark, sf):
    rows = _stacked(spark, sf).withColumn("country", F.concat(F.lit("C"), (F.col("s1") % 3).cast("string")))
    out = stack.override(F.col("p"), models.sigmoid(F.col("ce_logit")), F.col("country"), ["C0"], {"C2": (1.4, -1.0)})
    return rows.select("s1", "cand", r6(out, "p"))


#: A submission with every kind of fault, by the number in the id.
_BAD = f"""{_V}, sb AS (SELECT source1_entity_id AS s1, CASE CAST(substr(source1_entity_id, 4) AS BIGINT) % 11 WHEN 1 THEN matched_entity_ids || ',' || matched_entity_ids WHEN 2 THEN source1_entity_id
WHEN 3 THEN 'X9-1' WHEN 4 THEN 'S2-unknown' ELSE matched_entity_ids END AS matched FROM truth WHERE CAST(substr(source1_entity_id, 4) AS BIGINT) % 11 <> 5
UNION ALL SELECT source1_entity_id, '' FROM truth WHERE CAST(substr(source1_entity_id, 4) AS BIGINT) % 11 = 6 UNION ALL SELECT 'S1-extra', ''),
ls AS (SELECT s1, list_filter(string_split(matched, ','), lambda x: x <> '') AS ids FROM sb)"""


def _bad(spark, sf) -> DataFrame:
    n = F.substring("source1_entity_id", 4, 20).cast("long") % 11
    m = F.col("matched_entity_ids")
    t = view(spark, sf, "truth").withColumn("n", n)
    matched = F.when(F.col("n") == 1, F.concat(m, F.lit(","), m)).when(F.col("n") == 2, F.col("source1_entity_id")).when(F.col("n") == 3, "X9-1").when(F.col("n") == 4, "S2-unknown").otherwise(m)
    rows = t.filter("n <> 5").select(F.col("source1_entity_id").alias("s1"), matched.alias("matched"))
    more = t.filter("n = 6").select(F.col("source1_entity_id").alias("s1"), F.lit("").alias("matched"))
    return rows.unionByName(more).unionByName(spark.createDataFrame([("S1-extra", "")], "s1 string, matched string"))


@query(f"{_BAD} SELECT s1, count(*) AS n FROM sb GROUP BY 1 HAVING count(*) > 1")
def validate_duplicate_rows(spark, sf):
    return validate.duplicate_rows(_bad(spark, sf))


@query(f"{_BAD} SELECT s1 FROM ls WHERE len(ids) <> len(list_distinct(ids))")
def validate_repeated_ids(spark, sf):
    return validate.repeated_ids(_bad(spark, sf))


@query(f"""{_BAD}, e AS (SELECT s1, unnest(ids) AS cand FROM ls) SELECT s1, cand, CASE WHEN starts_with(cand, 'S1-') THEN 'self' WHEN NOT regexp_matches(cand, '^S[23]-') THEN 'prefix' ELSE 'unknown' END AS rule FROM e
WHERE starts_with(cand, 'S1-') OR NOT regexp_matches(cand, '^S[23]-') OR cand NOT IN (SELECT entity_id FROM recs)""")
def validate_wrong_ids(spark, sf):
    return validate.wrong_ids(_bad(spark, sf), view(spark, sf, "recs"))


@query(f"{_BAD} SELECT source1_entity_id AS s1, 'missing' AS rule FROM truth WHERE source1_entity_id NOT IN (SELECT s1 FROM sb) UNION ALL SELECT DISTINCT s1, 'extra' FROM sb WHERE s1 NOT IN (SELECT source1_entity_id FROM truth)")
def validate_missing_extra(spark, sf):
    return validate.missing_and_extra(_bad(spark, sf), view(spark, sf, "truth").select(F.col("source1_entity_id").alias("s1")))


@query(f"{_BAD}, e AS (SELECT DISTINCT s1, unnest(ids) AS cand FROM ls), t AS (SELECT source1_entity_id AS s1, unnest(string_split(matched_entity_ids, ',')) AS cand FROM truth) SELECT s1, cand FROM e WHERE (s1, cand) NOT IN (SELECT (s1, cand) FROM t)")
def validate_outside_candidates(spark, sf):
    truth = view(spark, sf, "truth").select(F.col("source1_entity_id").alias("s1"), F.col("matched_entity_ids").alias("matched"))
    return validate.outside_candidates(_bad(spark, sf), truth)


@query()
def linkage_end_to_end(spark, sf):
    return linkage.link(view(spark, sf, "s1"), view(spark, sf, "others"))


@query()
def linkage_trained(spark, sf):
    """The whole run with training: match sets of all S1 records, and F0.5 of each; entities of fold 0 taught nothing."""
    s1, others, truth = view(spark, sf, "s1"), view(spark, sf, "others"), tables.truth_pairs(view(spark, sf, "truth"))
    matcher, scored = linkage.train(s1, others, truth, LinkageConfig(rounds=16, prune_rounds=10, depth=4))
    sets = decide.to_submission(linkage.matched(matcher, scored), s1.select(F.col("entity_id").alias("s1")))
    rows = linkage.score_sets(sets, truth)
    held = models.entity_fold(F.col("s1")) == 0
    return rows.select("s1", F.array_join("pred", ",").alias("matched"), held.alias("held_out"), r6(evaluate.f05(F.col("pred"), F.col("truth")), "f05"))


@query(f"""{_M}, x AS (SELECT d AS s1, q AS cand, least(1.0, round(name_cos + addr_cos + 0.2 * exact, 6) / 2) AS p FROM r),
pr AS (SELECT s1, cand, p FROM (SELECT *, row_number() OVER (PARTITION BY s1 ORDER BY p DESC, cand) AS rn FROM x) WHERE rn <= 8 AND p >= 0.1),
own AS (SELECT s1, cand, CASE WHEN row_number() OVER (PARTITION BY cand ORDER BY p DESC, s1) = 1 THEN p ELSE 0 END AS p FROM pr),
g AS (SELECT s1, list(cand ORDER BY p DESC, cand) AS cands, list(least(greatest(p, 1e-9), 1 - 1e-9) ORDER BY p DESC, cand) AS ps FROM own GROUP BY s1),
mi AS (SELECT unnest({list(_CONFIG.miss_priors)}::DOUBLE[]) AS miss), pe AS (SELECT unnest({list(_CONFIG.penalties)}::DOUBLE[]) AS penalty),
ks AS (SELECT s1, cands, unnest(range(len(ps) + 1)) AS k, ps FROM g), pbs AS (SELECT s1, cands, k, len(ps) AS n, {_pb("ps[1:k]")} AS a, {_pb("ps[k + 1:]")} AS b FROM ks),
sc AS (SELECT s1, cands, k, miss, CASE WHEN k = 0 THEN CASE WHEN miss = 0 THEN b[1] ELSE 0 END ELSE list_sum(list_transform(range(k + 1), lambda t: a[t + 1] * t * list_sum(list_transform(range(n - k + 1), lambda m: b[m + 1] * 1.25 / (0.25 * (t + m + miss) + k))))) END AS score FROM pbs, mi),
bk AS (SELECT s1, miss, penalty, any_value(cands) AS cands, arg_min(k, (-round(score - penalty * k, 9), k)) AS n FROM sc, pe GROUP BY 1, 2, 3),
tr AS (SELECT source1_entity_id AS s1, list_filter(string_split(matched_entity_ids, ','), lambda x: x <> '') AS truth FROM truth),
z AS (SELECT miss, penalty, truth, coalesce(cands[1:n], []) AS pred FROM tr CROSS JOIN mi CROSS JOIN pe LEFT JOIN bk USING (s1, miss, penalty))
SELECT miss, penalty, round(avg(CASE WHEN len(pred) = 0 AND len(truth) = 0 THEN 1.0 WHEN len(list_intersect(pred, truth)) = 0 THEN 0 ELSE 1.25 * len(list_intersect(pred, truth)) / (0.25 * len(truth) + len(pred)) END), 6) AS f05 FROM z GROUP BY 1, 2""")
def decision_grid(spark, sf):
    index, other = _sides(spark, sf)
    rows, members = _rescored(spark, sf)
    rows = rows.select("q", "d", F.least(F.lit(1.0), F.round(merge.combine(F.col("name_cos"), F.col("addr_cos"), F.col("exact")), 6) / 2).alias("p"))
    rows = canon.each_member(merge.prune_top(rows, "d", "q", "p", 8, 0.1), canon.first_members(members, 8))
    rows = written(merge.prune_top(rows, "d", "q", "p", 8, 0.1).withColumnsRenamed({"d": "s1", "q": "cand"}), "grid_pairs")
    truth = view(spark, sf, "truth").select(F.col("source1_entity_id").alias("s1"), F.filter(F.split("matched_entity_ids", ","), lambda x: x != "").alias("matched"))
    return decide.grid_search(rows, truth, index.select(F.col("entity_id").alias("s1")), _CONFIG.miss_priors, _CONFIG.penalties)
