"""Connected components by repeated contraction towards random local minima."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._work import Work


def connected(edges: DataFrame) -> DataFrame:
    """node, root: one root per component of the graph of edges (a, b), both of one type.

    In a round every node points to whichever of itself and its neighbours comes first in an
    order that is drawn anew each round, and edges are carried over to what their ends
    point to.  A fixed share of the nodes goes in a round, whatever the shape of the
    components, so that long chains take few rounds too.  Tables are written each
    round; both sides of each join are such tables, so that Spark can split a root that
    many nodes point to.  Null ends and loops are ignored; no edges give no rows.
    """
    work = Work(edges.sparkSession, "components")
    edges = work.save(edges.filter("a <> b").select("a", "b").union(edges.filter("a <> b").select("b", "a")).distinct(), "edges0")
    roots, k = None, 0
    while not edges.isEmpty():
        order = lambda c: F.struct(F.xxhash64(c, F.lit(k)).alias("at"), F.col(c).alias("node"))  # noqa: E731, B023
        least = edges.groupBy("a").agg(F.min(order("b")).alias("m"))
        step = least.select(F.col("a").alias("node"), F.least("m", order("a"))["node"].alias("to"))
        step = work.save(step, f"step{k}")
        if roots is None:
            roots = work.save(step.select("node", F.col("to").alias("root")), f"roots{k}")
        else:
            near = step.select(F.col("node").alias("root"), "to")
            roots = work.save(roots.join(near, "root", "left").select("node", F.coalesce("to", "root").alias("root")), f"roots{k}")
        ends = edges.join(step.withColumnsRenamed({"node": "a", "to": "x"}), "a").join(step.withColumnsRenamed({"node": "b", "to": "y"}), "b")
        edges = work.save(ends.filter("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), f"edges{k + 1}")
        for x in ("edges", "roots", "step"):
            if k > 0 or x == "edges":
                work.drop(f"{x}{k if x == 'edges' else k - 1}")
        k += 1
    if roots is None:
        none = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        return none.limit(0)
    return roots
