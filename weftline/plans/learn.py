"""What is learned about texts before linking: lexicons, from true pairs, sure pairs or without labels, and stop words."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import adaptive, canon, lexicon, stack
from ..sources.scratch import written

#: Fields of basic records and their names in a lexicon.
FIELDS = {"name": "name_b", "addr": "addr_b"}
#: Records of one country and source that stop words are learned from.
SAMPLE = 300_000


def resolved(pairs: DataFrame, s1: DataFrame, others: DataFrame, all_known: bool = True) -> DataFrame:
    """pairs (s1, cand) with the basic records of both sides: country (of s1), clean_* and noisy_* per field.

    With all_known an id that neither side has fails the run; else such pairs are dropped.
    """
    a = s1.select(F.col("entity_id").alias("s1"), "country", *[F.col(c).alias(f"clean_{f}") for f, c in FIELDS.items()])
    b = others.select(F.col("entity_id").alias("cand"), *[F.col(c).alias(f"noisy_{f}") for f, c in FIELDS.items()])
    rows = pairs.select("s1", "cand").join(a, "s1", "left" if all_known else "inner").join(b, "cand", "left" if all_known else "inner")
    if not all_known:
        return rows
    lost = F.raise_error(F.concat(F.lit("unknown id in pair "), "s1", F.lit(" "), "cand")).cast("string")
    known = F.col("clean_name").isNotNull() & F.col("noisy_name").isNotNull()
    return rows.withColumn("country", F.when(known, F.col("country")).otherwise(lost))


def from_pairs(rows: DataFrame) -> DataFrame:
    """The lexicon of resolved pairs; leading junk is learned of names alone."""
    tokens = lambda c: F.filter(F.split(c, " "), lambda t: t != "")
    sides = None
    for f in FIELDS:
        got = rows.select("country", F.lit(f).alias("field"), tokens(F.col(f"clean_{f}")).alias("clean"), tokens(F.col(f"noisy_{f}")).alias("noisy"))
        sides = got if sides is None else sides.unionByName(got)
    counts = lexicon.collect(written(lexicon.align(written(sides, "sides")), "aligned"))
    return lexicon.distil({k: written(v, "counts") for k, v in counts.items()}).filter(~((F.col("field") == "addr") & (F.col("kind") == "prefix")))


def without_labels(s1: DataFrame, others: DataFrame, known: DataFrame) -> DataFrame:
    """The lexicon of the countries of s1 that the lexicon known doesn't have, from texts alone; leading junk is learned of names alone."""
    new = lexicon.unlabelled(s1, known)
    out = None
    for f, c in FIELDS.items():
        side = lambda rows: rows.join(F.broadcast(new), "country", "left_semi").select("country", F.col("entity_id").alias("doc"), F.col(c).alias("text"))  # noqa: B023, E731
        got = lexicon.induce(side(s1), side(others), f, prefixes=f == "name")
        out = got if out is None else out.unionByName(got)
    return out


def learn(s1: DataFrame, others: DataFrame, truth: DataFrame, holdout: str | None = None) -> DataFrame:
    """The lexicon of all countries of basic records: by true pairs where there are any, else without labels.  The country
    holdout is treated as if it had none, to see what an unseen one would get."""
    rows = written(resolved(truth, s1, others), "true_sides")
    taught = from_pairs(rows if holdout is None else rows.filter(F.col("country") != holdout))
    taught = written(taught, "lexicon")
    return taught.unionByName(without_labels(s1, others, taught))


def from_predicted(pairs: DataFrame, s1: DataFrame, others: DataFrame, country: str) -> DataFrame:
    """The lexicon of one country from predicted pairs; pairs with unknown ids are dropped."""
    return from_pairs(written(resolved(pairs, s1, others, all_known=False).filter(F.col("country") == country), "predicted_sides"))


def stop_groups(records: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """country, field, token, group, role of the stop words of basic records (entity_id, country, src and the fields) of all sources and splits.

    A drawn share of each country and source's records teaches, of about `sample` records.
    """
    n = records.groupBy("country", "src").agg(F.count(F.lit(1)).alias("n"))
    draw = F.pmod(F.xxhash64(F.lit(0), "entity_id"), F.lit(1 << 30)) * F.greatest(F.col("n"), F.lit(1))
    drawn = written(records.join(F.broadcast(n), ["country", "src"]).filter(draw < (1 << 30) * sample), "stop_sample")
    out = None
    for f, c in FIELDS.items():
        tokens = written(adaptive.tokenized(drawn.filter(F.col(c) != "").select("country", F.col("entity_id").alias("doc"), F.col(c).alias("text"))), "stop_tokens")
        stats = written(adaptive.token_stats(tokens), "stop_stats")
        stops = written(adaptive.stop_words(stats), "stops")
        got = adaptive.roles(stops, adaptive.neighbours(tokens, stats, stops), adaptive.positions(tokens, stops)).withColumn("field", F.lit(f))
        out = got if out is None else out.unionByName(got)
    return out.select("country", "field", "token", "group", "role")


def stop_lexicon(groups: DataFrame) -> DataFrame:
    """Stop words as rows of a lexicon."""
    return groups.select("country", "field", F.lit("stop").alias("kind"), F.col("token").alias("key"), F.lit("").alias("value"), F.lit(0.0).alias("weight"))


def load_maps(*lexicons: DataFrame | None) -> DataFrame:
    """What canonical() takes, of one or several lexicons; a missing one (None) is an error, countries without entries get none."""
    if not lexicons or any(x is None for x in lexicons):
        raise ValueError("a lexicon that is switched on is missing")
    rows = lexicons[0]
    for x in lexicons[1:]:
        rows = rows.unionByName(x)
    return canon.field_maps(rows)


def self_train(scored: DataFrame, s1: DataFrame, others: DataFrame, known: DataFrame, relink: Callable[[DataFrame, list[str]], DataFrame], least: float, min_pairs: int) -> tuple[DataFrame, DataFrame | None]:
    """(lexicon, what relink makes of it): countries that known lacks learn from their own sure pairs (scored: s1, cand, p, country), and relink(lexicon,
    countries) is called to block, score and decide those countries anew.  (known, None) if none has min_pairs of them.
    """
    new = lexicon.unlabelled(s1, known)
    sure = stack.self_train(scored, new, lambda x: x, least, min_pairs)
    if sure is None:
        return known, None
    sure = written(sure, "sure")
    countries = sorted(r["country"] for r in sure.select("country").distinct().collect())  # a few names
    merged = known
    for country in countries:
        merged = lexicon.upsert(merged, from_predicted(sure, s1, others, country))
    merged = written(merged, "lexicon")
    return merged, relink(merged, countries)
