"""Stop words and their roles, found without labels.  Documents are (country, doc, text) with one blank between tokens."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HEAD, CONTEXT, MOST, LEAST_DF = 1000, 100, 300, 5


def tokenized(docs: DataFrame) -> DataFrame:
    """country, doc, pos, token, n."""
    t = F.filter(F.split("text", " "), lambda x: x != "")
    rows = docs.select("country", "doc", t.alias("t"))
    return rows.select("country", "doc", F.size("t").alias("n"), F.posexplode("t").alias("pos", "token"))


def token_stats(tokens: DataFrame) -> DataFrame:
    """country, token, tf, df; occurrences are counted per document first."""
    per = tokens.groupBy("country", "token", "doc").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy("country", "token").agg(F.sum("n").alias("tf"), F.count(F.lit(1)).alias("df"))


def knee(stats: DataFrame) -> DataFrame:
    """country, knee: the rank where the log-log curve of the HEAD most frequent tokens lies furthest above its chord."""
    head = stats.withColumn("rank", F.row_number().over(Window.partitionBy("country").orderBy(F.desc("tf"), "token"))).filter(F.col("rank") <= HEAD)
    w = Window.partitionBy("country")
    x, y = F.log("rank"), F.log("tf")
    rows = head.withColumns({"x": x, "y": y, "n": F.count(F.lit(1)).over(w)})

    def unit(c: str):
        low, high = F.min(c).over(w), F.max(c).over(w)
        return F.when(high > low, (F.col(c) - low) / (high - low)).otherwise(0.0)

    rows = rows.withColumn("over", F.round(unit("y") - (1 - unit("x")), 9))
    best = rows.groupBy("country", "n").agg(F.max(F.struct("over", (-F.col("rank")).alias("r"))).alias("m"))
    return best.select("country", F.when(F.col("n") < 3, F.col("n")).otherwise(-F.col("m.r")).cast("int").alias("knee"))


def stop_words(stats: DataFrame) -> DataFrame:
    """country, token, tf, df of the frequent head up to the knee, without numbers; MOST at most."""
    rank = F.row_number().over(Window.partitionBy("country").orderBy(F.desc("tf"), "token"))
    head = stats.withColumn("rank", rank).filter(F.col("rank") <= HEAD)
    rows = head.filter(~F.col("token").rlike(r"^\d+$")).drop("rank")
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("country").orderBy(F.desc("tf"), "token")))
    rows = rows.join(F.broadcast(knee(stats)), "country").filter((F.col("rank") <= F.col("knee")) & (F.col("df") >= LEAST_DF) & (F.col("rank") <= MOST))
    return rows.select("country", "token", "tf", "df")


def neighbours(tokens: DataFrame, stats: DataFrame, stops: DataFrame) -> DataFrame:
    """country, token, side, neighbour, n: what stands left and right of stop words, among the CONTEXT most
    frequent tokens and the edges <s> and </s>."""
    w = Window.partitionBy("country", "doc").orderBy("pos")
    rows = tokens.withColumns({"l": F.coalesce(F.lag("token").over(w), F.lit("<s>")), "r": F.coalesce(F.lead("token").over(w), F.lit("</s>"))})
    rows = rows.join(F.broadcast(stops.select("country", "token")), ["country", "token"])
    rows = rows.select("country", "token", F.explode(F.array(F.struct(F.lit("l").alias("side"), F.col("l").alias("neighbour")), F.struct(F.lit("r").alias("side"), F.col("r").alias("neighbour")))).alias("x")).select("country", "token", "x.*")
    top = stats.withColumn("rank", F.row_number().over(Window.partitionBy("country").orderBy(F.desc("tf"), "token"))).filter(F.col("rank") <= CONTEXT)
    known = top.select("country", F.col("token").alias("neighbour"))
    edges = stats.select("country").distinct().select("country", F.explode(F.array(F.lit("<s>"), F.lit("</s>"))).alias("neighbour"))
    rows = rows.join(F.broadcast(known.unionByName(edges)), ["country", "neighbour"])
    return rows.groupBy("country", "token", "side", "neighbour").agg(F.count(F.lit(1)).alias("n"))


def positions(tokens: DataFrame, stops: DataFrame) -> DataFrame:
    """country, token, start, middle, end: where stop words stand in texts of several tokens."""
    rows = tokens.filter("n > 1").join(F.broadcast(stops.select("country", "token")), ["country", "token"])
    first, last = F.col("pos") == 0, F.col("pos") == F.col("n") - 1
    rate = lambda c: F.round(F.avg(c.cast("double")), 6)
    return rows.groupBy("country", "token").agg(rate(first).alias("start"), rate(~first & ~last).alias("middle"), rate(last).alias("end"))


def cluster(x: np.ndarray) -> np.ndarray:
    """Average-linkage clusters by cosine distance, cut in the middle of the largest jump of merge
    heights in their upper half; one cluster if that jump ends below 0.3 or there are under four rows."""
    n = len(x)
    if n < 4:
        return np.zeros(n, int)
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    d = 1 - unit @ unit.T
    np.fill_diagonal(d, np.inf)
    size, alive = np.ones(n), np.ones(n, bool)
    heights, merges = [], []
    for _ in range(n - 1):
        i, j = sorted(np.unravel_index(np.argmin(d), d.shape))
        heights.append(d[i, j])
        merges.append((i, j))
        row = (size[i] * d[i] + size[j] * d[j]) / (size[i] + size[j])
        row[~alive] = np.inf
        row[[i, j]] = np.inf
        d[i], d[:, i] = row, row
        d[j], d[:, j] = np.inf, np.inf
        alive[j] = False
        size[i] += size[j]
    h = np.array(heights)
    jumps = np.diff(h)
    lo = len(jumps) // 2
    k = lo + int(np.argmax(jumps[lo:]))
    group = np.arange(n)
    if h[k + 1] < 0.3:
        return np.zeros(n, int)
    for (i, j), height in zip(merges, h, strict=True):
        if height <= (h[k] + h[k + 1]) / 2:
            group[group == group[j]] = group[i]
    return np.unique(group, return_inverse=True)[1]


def roles(stops: DataFrame, near: DataFrame, at: DataFrame) -> DataFrame:
    """country, token, group, role: groups of stop words that are used alike; role trail, lead or mid.

    One task per country, over MOST words and 2 (CONTEXT + 2) + 3 numbers of each.
    """
    own = near.groupBy("country", "token").agg(F.collect_list(F.struct("side", "neighbour", "n")).alias("near"))
    rows = stops.join(own, ["country", "token"], "left").join(at, ["country", "token"], "left")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("token", ignore_index=True)
        cols: dict[tuple[str, str], int] = {}
        cells = [(i, cols.setdefault((e["side"], e["neighbour"]), len(cols)), e["n"]) for i, near in enumerate(pdf.near) if near is not None for e in near]
        x = np.zeros((len(pdf), max(len(cols), 1)))
        for i, j, n in cells:
            x[i, j] = n
        x = np.sqrt(x / np.maximum(x.sum(1, keepdims=True), 1))
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        where = pdf[["start", "middle", "end"]].fillna(0).to_numpy(float)
        group = cluster(np.hstack([x, 2 * np.sqrt(where)]) + 1e-6)
        pdf = pdf.assign(group=group)
        mean = pdf.assign(s=pdf.start.fillna(0) * pdf.df, e=pdf.end.fillna(0) * pdf.df).groupby("group")[["s", "e", "df"]].sum()
        role = {g: "trail" if r.e >= 0.5 * r.df else "lead" if r.s >= 0.5 * r.df else "mid" for g, r in mean.iterrows()}
        return pd.DataFrame({"country": pdf.country, "token": pdf.token, "group": pdf.group.astype("int32"), "role": pdf.group.map(role)})

    return rows.groupBy("country").applyInPandas(run, "country string, token string, group int, role string")
