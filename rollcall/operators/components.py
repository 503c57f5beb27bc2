"""Connected components of an edge list: the equivalence closure behind every linking step.

Alternating large-star and small-star rounds.  Each round is a grouped minimum and
an equi-join, so no vertex's neighbourhood is ever gathered in one row, and the
number of rounds grows with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rollcall.stage import drop_stage, staged

MAX_ROUNDS = 64


def _star(edges: DataFrame) -> DataFrame:
    """Point every vertex, and its neighbours, at the least vertex of its neighbourhood."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    onward = both.join(least, "a")
    moved = onward.select(F.col("b").alias("a"), F.col("m").alias("b"))
    own = least.select("a", F.col("m").alias("b"))
    return moved.union(own).where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """Vertices of ``edges`` with the least vertex of their component.

    Returns ``(id, component)``, a stage table, for every vertex that has an edge to another one.
    Null ends, loops and repeated edges carry no information and are dropped.
    """
    typed = edges.select(F.col(src).alias("a"), F.col(dst).alias("b"))
    current = staged(
        typed.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges"
    )
    for _ in range(MAX_ROUNDS):
        # A star forest: no lesser end has a lesser end itself, and no vertex has two.
        parents = current.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.min("b").alias("b"))
        several = parents.where("n > 1").select(F.lit(1).alias("x")).limit(1)
        chained = current.join(current.select(F.col("a").alias("b")), "b", "left_semi").select(F.lit(1).alias("x")).limit(1)
        if not several.union(chained).take(1):
            break
        following = staged(_star(current), "edges")
        drop_stage(current)
        current = following
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    own = current.select(F.col("a").alias("id"), F.col("b").alias("component"))
    roots = current.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    out = staged(own.union(roots), "components")
    drop_stage(current)
    return out
