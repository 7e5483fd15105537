"""Candidate pairs (q, d): top-k similarity joins, bounded exact joins, vector neighbours, links."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import together, written
from .vectors import Folded, fold, folded_cosine, term_numbers

#: Rows of an index block that one task holds.
KNN_BLOCK = 8192
#: Index vectors that a query's first look meets, times k, and the most that its rarest term may have to be looked up.
LOOK, RAREST = 4, 256


def top(rows: DataFrame, k: int, key: str = "q", other: str = "d") -> DataFrame:
    """Each key's k best by s, then by id.  Nothing but the rank's bound is computed, so Spark trims before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("s"), other))
    return rows.withColumn("rn", rank).filter(F.col("rn") <= k).drop("rn")


def _first(x: Folded, k: int) -> DataFrame:
    """vid and id: the k smallest ids of each distinct vector."""
    return x.ids.withColumn("rn", F.row_number().over(Window.partitionBy("vid").orderBy("id"))).filter(F.col("rn") <= k).drop("rn")


def _postings(x: Folded) -> DataFrame:
    """vid, n, t, rest: each term of a vector and the length of the vector from this term on, rarest terms first."""
    # Rounded up: rest only ever bounds a product from above.
    rest = F.transform(F.sequence(F.lit(1), F.size("ws")), lambda i: F.sqrt(F.aggregate(F.slice("ws", i, F.size("ws")), F.lit(0.0), lambda s, w: s + w * w)) + 2e-6)
    return x.rows.select("vid", "n", "ts", F.posexplode(rest).alias("i", "rest")).select("vid", "n", F.get("ts", F.col("i")).alias("t"), "rest", "i")


def topk_cosine(q: DataFrame | Folded, d: DataFrame | Folded, k: int, threshold: float, about: DataFrame | None = None) -> DataFrame:
    """q, d, s: of vectors (id, term, w), each query's k nearest of at least the threshold (over 0).  Exact, ties by id.
    With about (d and further columns), these columns too.

    Equal vectors are searched once.  A first look at each query's rarest terms gives a lower bound of its k-th best
    score.  Then, with terms in the order of their frequency, a pair can only reach the bound if the two vectors from
    their first common term on are long enough, as the product of these lengths is the most that the cosine can be: so frequent terms,
    which stand at the vectors' ends, hardly ever bring a pair up.
    """
    if not isinstance(q, Folded):
        numbers = term_numbers(d)
        q, d = fold(q, numbers), fold(d, numbers)
    a, b = together(
        q.rows.sparkSession,
        lambda: written(_postings(q).drop("n").withColumnRenamed("vid", "q"), "query_postings"),
        lambda: written(_postings(d).withColumnRenamed("vid", "d"), "index_postings"),
    )
    common = b.groupBy("t").agg(F.count(F.lit(1)).alias("df"))
    # The first look: the rarest term, and further ones while few index vectors have them.
    met = F.sum("df").over(Window.partitionBy("q").orderBy("i"))
    look = a.join(common, "t").withColumn("met", met).filter((F.col("met") <= LOOK * k) | (F.col("i") == 0)).filter(F.col("df") <= RAREST * k)
    near = look.select("q", "t").join(b.select("d", "n", "t"), "t").groupBy("q", "d").agg(F.first("n").alias("n"))
    near = folded_cosine(near, q, d).filter(F.col("s") >= threshold)
    before = F.sum("n").over(Window.partitionBy("q").orderBy(F.desc("s"), "d")) - F.col("n")
    bound = near.withColumn("before", before).filter(F.col("before") < k).groupBy("q").agg(F.min("s").alias("least"), F.sum("n").alias("n"))
    bound = written(bound.filter(F.col("n") >= k).select("q", "least"), "bounds")
    a = a.join(bound, "q", "left").withColumn("least", F.coalesce("least", F.lit(threshold)))
    a = a.filter(F.col("rest") >= F.col("least"))
    pairs = a.select("q", "t", "rest", "least").join(b.filter(F.col("rest") >= threshold).select("d", "t", F.col("rest").alias("more")), "t")
    pairs = pairs.filter(F.col("rest") * F.col("more") >= F.col("least")).groupBy("q", "d").agg(F.first("least").alias("least"))
    found = folded_cosine(pairs, q, d).filter(F.col("s") >= F.col("least"))
    # A vector's smallest id stands for it: where k vectors come before it, none of its ids is among the first k.
    best = written(top(found.select("q", "d", "s"), k), "best_vectors")
    each = best.join(_first(d, k).withColumnRenamed("vid", "d"), "d").select("q", F.col("id").alias("d"), "s")
    each = top(each, k)
    each = written(each if about is None else each.join(about, "d"), "best")
    return q.ids.withColumnRenamed("vid", "q").join(each, "q").select(F.col("id").alias("q"), *each.drop("q").columns)


def _combined(vecs: list[DataFrame], views: list[Folded], groups: DataFrame, bits: int) -> tuple[DataFrame, DataFrame]:
    """(one row per distinct combination of vectors: c, block of 2**bits at most, g, id (the smallest), v0, v1, ... (vids), has; ids: id, c)."""
    keys = [f"v{i}" for i in range(len(views))]
    own = None
    for i, (long, x) in enumerate(zip(vecs, views, strict=True)):
        # A record can have a view without a term that the other side knows: it counts all the same.
        one = long.select("id").distinct().join(x.ids.withColumnRenamed("vid", f"v{i}"), "id", "left").withColumn(f"h{i}", F.lit(1))
        own = one if own is None else own.join(one, "id", "full")
    has = sum((F.coalesce(f"h{i}", F.lit(0)) for i in range(len(views))), F.lit(0)).alias("has")
    own = written(own.filter(F.coalesce(*keys).isNotNull()).join(groups.select("id", "g"), "id").select("id", "g", *keys, has), "views_of_ids")
    one = own.groupBy("g", *keys, "has").agg(F.min("id").alias("id"))
    # In order of their vectors, so that a block has few distinct ones.
    one = one.repartitionByRange("g", *keys).sortWithinPartitions("g", *keys).withColumn("c", F.monotonically_increasing_id())
    one = written(one.withColumn("block", F.shiftright("c", bits)), "combinations")
    alike = [F.col(c).eqNullSafe(F.col(f"x_{c}")) for c in ("g", *keys, "has")]
    ids = own.join(one.select("c", *[F.col(c).alias(f"x_{c}") for c in ("g", *keys, "has")]), alike).select("id", "c")
    return one, written(ids, "combined_ids")


def _search_blocks(pdf: pd.DataFrame, views: int, k: int, threshold: float) -> pd.DataFrame:
    """q, d, s: the k best index combinations (d: their ids) of each query combination (q: c) of one pair of blocks."""
    # Numbers with nulls among them come as floats, of which no NaN equals another.
    pdf = pdf.fillna({f"v{i}": -1 for i in range(views) if pdf[f"v{i}"].dtype.kind == "f"})
    asks, own = pdf[pdf.kind == 0].sort_values([f"v{i}" for i in range(views)]), pdf[pdf.kind == 1].sort_values("id")
    if not len(asks) or not len(own):
        return pd.DataFrame({"q": pdf.c[:0], "d": pdf.id[:0], "s": pd.Series(dtype="float64")})
    rows_of, place, of_query = [], [], []
    for i in range(views):
        q, d = (pdf[(pdf.kind == kind) & (pdf.view == i)] for kind in (2, 3))
        known, n = {v: j for j, v in enumerate(d.id)}, len(d)
        place.append(np.array([known.get(v, n) for v in own[f"v{i}"]]))
        of_query.append({v: x for v, x in zip(q.id, zip(q.ts, q.ws, strict=True), strict=True)})
        postings = {}
        if n:
            t, w = np.concatenate(d.ts.to_list()), np.concatenate(d.ws.to_list())
            at = np.repeat(np.arange(n), [len(x) for x in d.ts])
            order = np.argsort(t, kind="stable")
            t, w, at = t[order], w[order], at[order]
            starts = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
            postings = {t[a]: (at[a:b], w[a:b]) for a, b in zip(starts, np.r_[starts[1:], len(t)], strict=True)}
        rows_of.append((postings, n, {}))

    def cosines(i: int, vid) -> np.ndarray:
        """Of a query vector with each distinct index vector of the view; 0 in the last place, which stands for none."""
        postings, n, seen = rows_of[i]
        if vid not in seen:
            if len(seen) * (n + 1) > 1 << 22:
                seen.clear()
            row = np.zeros(n + 1)
            for t, w in zip(*of_query[i].get(vid, ((), ())), strict=True):
                if t in postings:
                    row[postings[t][0]] += w * postings[t][1]
            seen[vid] = row
        return seen[vid]

    scale, ids, out = 1 / np.sqrt(own.has.to_numpy()), own.id.to_numpy(), []
    # The k-th best of the maxima of over k runs of columns is at most the k-th best of all.
    starts = np.arange(0, len(ids), max(1, len(ids) // (8 * k)))
    first, last = None, None
    for c, has, *vids in asks[["c", "has", *[f"v{i}" for i in range(views)]]].itertuples(index=False, name=None):
        if last is None or vids[0] != first:  # neighbours share the first view's vector
            first, last = vids[0], cosines(0, vids[0])[place[0]]
        s = last.copy()
        for i in range(1, views):
            s += cosines(i, vids[i])[place[i]]
        s *= scale
        s /= np.sqrt(has)
        least = threshold
        if len(starts) > k:
            least = max(least, np.partition(np.maximum.reduceat(s, starts), -k)[-k])
        near = np.flatnonzero(s >= least - 2e-6)
        got = np.round(s[near], 6)
        near, got = near[got >= threshold], got[got >= threshold]
        best = np.argsort(-got, kind="stable")[:k]
        if len(best):
            out.append((np.full(len(best), c), ids[near[best]], got[best]))
    if not out:
        return pd.DataFrame({"q": pdf.c[:0], "d": pdf.id[:0], "s": pd.Series(dtype="float64")})
    return pd.DataFrame({n: np.concatenate(x) for n, x in zip("qds", zip(*out, strict=True), strict=True)})


def topk_joint(q: list[DataFrame], d: list[DataFrame], k: int, threshold: float, groups: tuple[DataFrame, DataFrame], folded: list[tuple[Folded, Folded]] | None = None, bits: tuple[int, int] = (13, 14), about: DataFrame | None = None) -> DataFrame:
    """q, d, s: topk_cosine of joint vectors, from each view's vectors (query and index: a list of id, term, w; folded: the same, folded; ids are strings, or numbers from 0).

    A record's joint vector has its unit vectors of all views side by side, each weight over the root of how many there are.
    With folded, an id is enough in q and d: those that have the view.  groups (query, index: id, g) says which records can meet, those with one g.  The joint cosine is made of the views' cosines, which are
    computed once per pair of a block's distinct vectors; each query combination is then looked up against all index combinations of its group,
    block by block, and only its k best leave a task.  So no pair is written, and work is the product of the numbers of distinct combinations in a group.
    """
    if folded is None:
        numbers = [term_numbers(x) for x in d]
        folded = [(fold(x, n), fold(y, n)) for x, y, n in zip(q, d, numbers, strict=True)]
    combine = lambda side, vecs: _combined(vecs, [f[side] for f in folded], groups[side], bits[side])
    (a, a_ids), (b, b_ids) = together(groups[0].sparkSession, lambda: combine(0, q), lambda: combine(1, d))
    keys, kind = [f"v{i}" for i in range(len(folded))], b.schema["id"].dataType.simpleString()
    both = a.select("g", F.col("block").alias("m")).distinct().join(b.select("g", F.col("block").alias("n")).distinct(), "g")
    both = written(both, "block_pairs")
    rows = None
    for side, (x, name) in enumerate(((a, "m"), (b, "n"))):
        nothing = {c: F.lit(None).cast(t) for c, t in (("c", "long"), ("has", "int"), *((v, kind) for v in keys))}
        parts = [x.select("g", F.col("block").alias(name), F.lit(side).alias("kind"), F.lit(None).cast("int").alias("view"), "id", "c", "has", *keys, F.lit(None).cast("array<bigint>").alias("ts"), F.lit(None).cast("array<double>").alias("ws"))]
        for i, v in enumerate(keys):
            got = x.select("g", F.col("block").alias(name), F.col(v).alias("vid")).distinct().join(folded[i][side].rows.select("vid", "ts", "ws"), "vid")
            got = got.withColumns({"kind": F.lit(side + 2), "view": F.lit(i), "id": F.col("vid"), **nothing})
            parts.append(got.select(parts[0].columns))
        for p in parts:
            p = p.withColumn("id", F.col("id").cast(kind)).withColumns({v: F.col(v).cast(kind) for v in keys}).join(both, ["g", name])
            rows = p if rows is None else rows.unionByName(p)
    n = len(keys)
    search = lambda pdf: _search_blocks(pdf, n, k, threshold)
    found = rows.repartition("g", "m", "n").groupBy("g", "m", "n").applyInPandas(search, f"q long, d {kind}, s double")
    best = written(top(written(found, "block_best"), k), "best_combinations")
    first = b_ids.withColumn("rn", F.row_number().over(Window.partitionBy("c").orderBy("id"))).filter(F.col("rn") <= k)
    first = first.join(b.select("c", F.col("id").alias("d")), "c").select("d", "id")
    first = first if about is None else first.join(about.withColumnRenamed("d", "id"), "id")
    each = best.join(first, "d").drop("d").withColumnRenamed("id", "d")
    each = written(top(each, k), "best")
    return a_ids.withColumnRenamed("c", "q").join(each, "q").select(F.col("id").alias("q"), "d", "s", *(about.drop("d").columns if about is not None else []))


def exact_join(index: DataFrame, query: DataFrame, keys: list[str], cap: int) -> DataFrame:
    """q, d: pairs that agree in any of the keys (columns of both; ids in id).  Empty keys match nothing; a key
    that more than cap index rows have is left to the other channels."""
    out = None
    for key in keys:
        few = index.filter(F.col(key) != "").groupBy(F.col(key).alias("k")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") <= cap).select("k")
        own = index.select(F.col("id").alias("d"), F.col(key).alias("k")).join(few, "k")
        got = query.filter(F.col(key) != "").select(F.col("id").alias("q"), F.col(key).alias("k")).join(own, "k").select("q", "d")
        out = got if out is None else out.unionByName(got)
    return out.distinct()


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays, in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def knn(q: DataFrame, d: DataFrame, k: int, exclude_same: bool = False, blocks: int | None = None, by: str | None = None) -> DataFrame:
    """q, d, s: exact k nearest by inner product of vectors (id of any type, v); nulls have no neighbours.

    Queries and index rows are each dealt into blocks; every pair of blocks is one matrix
    product in one task, which passes on each query's k best alone.  With by, a column of both sides, only rows that agree in it
    meet.  Work is the product of the sizes, as for any exact search; for few queries against all rows that is one pass.
    """
    d, q = (x.filter("v is not null").select("id", "v", (F.col(by).cast("string") if by else F.lit("")).alias("g")) for x in (d, q))
    kind = q.schema["id"].dataType.simpleString()
    if d.schema["id"].dataType.simpleString() != kind:
        raise ValueError("ids of both sides must have one type")
    n = blocks or max(1, -(-d.count() // KNN_BLOCK))
    m = max(1, -(-q.count() // KNN_BLOCK))
    every = lambda k: F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    own = lambda k: F.pmod(F.xxhash64("id"), F.lit(k)).cast("int")
    left = q.select("g", F.lit(True).alias("asks"), "id", "v", own(m).alias("m"), every(n).alias("n"))
    right = d.select("g", F.lit(False).alias("asks"), "id", "v", every(m).alias("m"), own(n).alias("n"))

    def best(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = pdf[pdf.asks], pdf[~pdf.asks].sort_values("id")
        if not len(a) or not len(b):
            return pd.DataFrame({"q": pdf.id[:0], "d": pdf.id[:0], "s": pd.Series(dtype="float64")})
        x, y = np.stack(a.v.to_numpy()).astype(np.float64), np.stack(b.v.to_numpy()).astype(np.float64)
        ids, out = b.id.to_numpy(), []
        for at in range(0, len(x), 512):
            s = np.round(x[at : at + 512] @ y.T, 6)
            own = a.id.to_numpy()[at : at + 512]
            if exclude_same:
                s[own[:, None] == ids[None, :]] = -np.inf
            order = np.argsort(-s, axis=1, kind="stable")[:, :k]
            out.append(pd.DataFrame({"q": np.repeat(own, order.shape[1]), "d": ids[order].ravel(), "s": np.take_along_axis(s, order, 1).ravel()}))
        got = pd.concat(out)
        return got[np.isfinite(got.s)]

    parts = left.unionByName(right).groupBy("g", "m", "n").applyInPandas(best, f"q {kind}, d {kind}, s double")
    return top(parts, k)


def known(pairs: DataFrame, index: DataFrame, query: DataFrame) -> DataFrame:
    """pairs (q, d, s) whose ids index (d) and query (q) have; others are dropped."""
    return pairs.join(index.select("d"), "d", "left_semi").join(query.select("q"), "q", "left_semi").select("q", "d", "s")


def twins(a: DataFrame, b: DataFrame, k: int, by: str | None = None) -> DataFrame:
    """a, b, s: each vector's k nearest of the other source, both ways."""
    there, back = knn(a, b, k, by=by), knn(b, a, k, by=by)
    return there.unionByName(back).select(F.col("q").alias("a"), F.col("d").alias("b"), "s")


def vector_cosine(pairs: DataFrame, embeddings: DataFrame, name: str = "dense_cos") -> DataFrame:
    """pairs (q, d) with the inner product of both ids' embeddings (id, v).  An id without one fails the run, as a silent 0 would pass for a score."""
    e = embeddings.select("id", "v")
    rows = pairs.join(e.select(F.col("id").alias("q"), F.col("v").alias("x")), "q", "left").join(e.select(F.col("id").alias("d"), F.col("v").alias("y")), "d", "left")
    lost = F.raise_error(F.concat(F.lit("no embedding for "), F.when(F.col("x").isNull(), F.col("q").cast("string")).otherwise(F.col("d").cast("string"))))
    return rows.withColumn(name, F.when(F.col("x").isNull() | F.col("y").isNull(), lost.cast("double")).otherwise(F.round(dot(F.col("x"), F.col("y")), 6))).drop("x", "y")


def recall_at(found: DataFrame, truth: DataFrame) -> DataFrame:
    """found, true_pairs, recall: how many true pairs (q, d) a search has found."""
    true = truth.select("q", "d").distinct()
    hit = true.join(found.select("q", "d").distinct().withColumn("hit", F.lit(1)), ["q", "d"], "left")
    return hit.agg(F.count("hit").alias("found"), F.count(F.lit(1)).alias("true_pairs"), F.round(F.count("hit") / F.greatest(F.count(F.lit(1)), F.lit(1)), 6).alias("recall"))


def expand_links(pairs: DataFrame, links: DataFrame, n: int, best: DataFrame | None = None) -> DataFrame:
    """q, d, link: for each d's n best pairs (by s; best: q, d, these already found), the twins of q that aren't its pairs yet, with the best link score.

    links has a, b and s.
    """
    best = top(pairs.select("q", "d", "s"), n, "d", "q") if best is None else best
    new = best.select("q", "d").join(links.select(F.col("a").alias("q"), "b", F.col("s").alias("link")), "q").select(F.col("b").alias("q"), "d", "link")
    new = new.join(pairs.select("q", "d"), ["q", "d"], "left_anti")
    return new.groupBy("q", "d").agg(F.max("link").alias("link"))
