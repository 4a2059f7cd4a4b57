"""Connected components by alternating large-star and small-star rounds over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.session import cut, release


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to its smallest neighbour, itself included."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.filter(F.col("b") > F.col("a")).join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the smallest of them. Edges run from the larger node."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").filter(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b")))


def _settled(edges: DataFrame) -> bool:
    """Whether every edge leads straight to a root: no node has two neighbours below it, or one below and one above."""
    below = edges.select(F.col("a").alias("n"), F.lit(1).alias("down"), F.lit(0).alias("up"))
    above = edges.select(F.col("b").alias("n"), F.lit(0).alias("down"), F.lit(1).alias("up"))
    nodes = below.unionByName(above).groupBy("n").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return not nodes.filter((F.col("down") > 1) | ((F.col("down") > 0) & (F.col("up") > 0))).limit(1).count()


def connected_components(edges: DataFrame, *, rounds: int = 50) -> DataFrame:
    """id, component of every node of `edges` (a, b): component is the smallest id reachable.

    A round costs two joins on node ids, and rounds grow with the logarithm of the longest chain. Each one is written to the
    shared folder, so a lost executor never costs more than the current round. Self-loops, nulls and repeated edges don't matter.
    """
    edges = edges.filter(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = cut(edges, "edges")
    for _ in range(rounds):
        if _settled(edges):
            break
        before, edges = edges, cut(_small_star(_large_star(edges)).distinct(), "edges")
        release(before)
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = edges.select(F.col("b").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)


def updated_components(comps: DataFrame, edges: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """id, component after a change, from those before (`comps`), the edges after it and the edges (a, b) that came and went.

    Components that lost an edge are split: worked out anew from what is left of their edges. Then what came is contracted: components are the
    nodes of a graph that has the added edges only, and take the least id of those that they join. Other components are passed on as they are;
    their edges aren't read.
    """
    came = cut(added.filter(F.col("a") != F.col("b")).select("a", "b").distinct(), "came")
    went = removed.select(F.col("a").alias("id")).unionByName(removed.select(F.col("b").alias("id"))).distinct()
    hurt = comps.join(went, "id", "left_semi").select("component").distinct()
    inside = cut(comps.join(hurt, "component", "left_semi").select("id"), "inside")
    new = came.select(F.least("a", "b").alias("_a"), F.greatest("a", "b").alias("_b"))
    left = edges.join(inside, edges["a"] == inside["id"], "left_semi").join(inside, edges["b"] == inside["id"], "left_semi").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    left = left.join(new, (left["a"] == new["_a"]) & (left["b"] == new["_b"]), "left_anti")
    base = cut(comps.join(hurt, "component", "left_anti").select("id", "component").unionByName(connected_components(left)), "base")
    ends = came.select(F.col("a").alias("id")).unionByName(came.select(F.col("b").alias("id"))).distinct()
    known = cut(ends.join(base, "id", "left").select("id", F.coalesce("component", "id").alias("component")), "ends")
    one, two = known.withColumnsRenamed({"id": "a", "component": "ca"}), known.withColumnsRenamed({"id": "b", "component": "cb"})
    joined = connected_components(came.join(one, "a").join(two, "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")))
    moved = joined.select(F.col("id").alias("component"), F.col("component").alias("_least"))
    every = base.unionByName(known.join(base, "id", "left_anti"))
    return every.join(moved, "component", "left").select("id", F.coalesce("_least", "component").alias("component"))
