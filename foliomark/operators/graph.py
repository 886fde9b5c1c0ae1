"""Connected components of an edge table, without collecting it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.session import staged


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of an edge; the component is its smallest node.

    Alternates the large-star and small-star steps, which need a number of rounds that grows with the
    logarithm of the longest path and keep the number of edges. Every round is written to the shared
    folder, so a lost executor costs no earlier round. Null ends and loops to a node itself are
    allowed: an edge with a null end is ignored, a loop makes a component of one node.
    """
    both = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).filter("u is not null and v is not null")
    current = staged(both.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    nodes = current.select(F.col("u").alias("node")).union(current.select(F.col("v").alias("node"))).distinct()
    current = current.filter("u <> v")
    before = None
    for _ in range(most_rounds):
        # large star: every larger neighbour is linked to the smallest of the neighbourhood
        sides = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = sides.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = sides.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # small star: every node and its smaller neighbours are linked to the smallest of them
        smallest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(smallest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(smallest.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        current = staged(small, "edges")
        state = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if before == state:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    labels = current.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    return nodes.join(labels, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
