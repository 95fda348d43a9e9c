"""Connected components of a distributed edge list by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronomesh.llm.common import discard, materialize


def _large_stars(edges: DataFrame) -> DataFrame:
    """Link ``a`` of each edge (a > b) to the least neighbour of ``b``.

    The least neighbours are written, so that the join's sides are plain: a small
    one is broadcast, and of a large one adaptive execution splits the edges of a
    node that very many others are linked to.
    """
    least = materialize(edges.groupBy(F.col("a").alias("c")).agg(F.min("b").alias("m")), "least")
    return edges.join(least, F.col("b") == F.col("c"), "left").select("a", F.coalesce("m", "b").alias("b")).distinct()


def _small_stars(edges: DataFrame) -> DataFrame:
    """Link each ``a``, and all that it is linked to, to the least of these."""
    least = edges.groupBy(F.col("a").alias("c")).agg(F.min("b").alias("m"))
    joined = edges.join(least, F.col("a") == F.col("c")).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
    return joined.select("e.*").where("a <> b").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """Rows (node, component) for every node of ``edges`` (a, b); component is its least node.

    Large stars and small stars alternate until nothing changes, which takes some
    log(n) rounds for n nodes in a row; each round is written to the shared folder.
    Loops, repeated edges and nulls in an edge are ignored.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a is not null and b is not null and a <> b").distinct()
    current = materialize(edges, "edges")
    seen = None
    while True:
        following = materialize(_small_stars(_large_stars(current)), "edges")
        now = following.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        discard(current)
        current = following
        if now == seen:
            break
        seen = now
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).union(current.select("b", "b")).distinct()
