"""Outside scores beside the matcher's, per-country overrides, and self-training."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .decide import owners
from .models import logit, sigmoid

MOST_MISSING = 0.001


def with_scores(pairs: DataFrame, scores: DataFrame, name: str, check: bool = True) -> DataFrame:
    """pairs with the outside chance `name` (of scores s1, cand, name) as a logit; missing ones count as 0.5.

    Raises ValueError if a thousandth or more is missing.
    """
    rows = pairs.join(scores.select("s1", "cand", name), ["s1", "cand"], "left")
    if check:
        n, missing = rows.agg(F.count(F.lit(1)), F.count_if(F.col(name).isNull())).first()
        if n and missing >= MOST_MISSING * n:
            raise ValueError(f"{missing} of {n} pairs have no {name}")
    return rows.withColumn(f"{name}_logit", logit(F.coalesce(name, F.lit(0.5)))).drop(name)


def override(p: Column, stacked: Column, country: Column, chosen: list[str], shift: dict[str, tuple[float, float]]) -> Column:
    """The stacked chance in chosen countries and p elsewhere; sigmoid(a logit p + b) in the countries of shift."""
    out = F.when(country.isin(chosen), stacked).otherwise(p)
    for name, (a, b) in shift.items():
        out = F.when(country == name, sigmoid(a * logit(p) + b)).otherwise(out)
    return out


def unlabelled_countries(test: DataFrame, train: DataFrame) -> DataFrame:
    return test.select("country").subtract(train.select("country"))


def confident_pairs(pairs: DataFrame, least: float = 0.99) -> DataFrame:
    """One-to-one first, then sure ones."""
    return owners(pairs).filter(F.col("p") >= least)


def self_train(pairs: DataFrame, countries: DataFrame, relearn: Callable[[DataFrame], DataFrame], least: float, min_pairs: int) -> DataFrame | None:
    """The lexicon that relearn makes of the sure pairs (s1, cand, country) of countries without labels that have
    min_pairs of them; None if there's no such country."""
    sure = confident_pairs(pairs, least).join(countries.select("country"), "country", "left_semi")
    enough = sure.groupBy("country").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_pairs)
    sure = sure.join(enough.select("country"), "country", "left_semi")
    return None if sure.isEmpty() else relearn(sure)
