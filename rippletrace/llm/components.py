"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rippletrace.llm.common import drop_steps, materialise


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step: the neighbours of each node are linked to the smallest of them instead.

    The large star does so for neighbours above the node, looking at all its
    neighbours; the small star for the neighbours below it, and the node itself.
    """
    if large:
        near = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        near = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = near.groupBy("a").agg(F.min("b").alias("m"))
    # The key of this side is a new expression, so that both sides of the join
    # are shuffled for it and Spark may split the rows of a hot node.
    least = least.select((F.col("a") + F.lit(0)).alias("k"), F.least("a", "m").alias("m"))
    met = near.join(least, F.col("a") == F.col("k"))
    if large:
        out = met.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = met.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select(F.col("k").alias("a"), F.col("m").alias("b")))
    return out.where(F.col("a") != F.col("b")).distinct()


def _sum(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for each node of an edge; the component is its smallest node.

    Stars alternate until the edges stop changing, which takes a number of
    rounds logarithmic in the size of components. Each step is a partially
    aggregated minimum and a join, and writes its edges, never more than there
    were before. Loops, repeated edges and edges with a null end are ignored;
    no edge gives no row.
    """
    edges = edges.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b"))
    edges = materialise(edges.where(F.col("a") != F.col("b")).distinct(), "edges")
    before = _sum(edges)
    while before[0]:
        large = materialise(_star(edges, large=True), "large-star")
        small = materialise(_star(large, large=False), "small-star")
        drop_steps(edges, large)
        edges, now = small, _sum(small)
        if now == before:
            break
        before = now
    # Now each edge leads from a node to the smallest one of its component.
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)
