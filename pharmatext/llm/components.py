"""Connected components of a large graph by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pharmatext.llm.storage import written


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node on an edge; the root is the least node of its component.

    Each round points every node to the least of itself and its neighbours, replaces the ends of all
    edges by what they point to, and drops edges that became loops: stars and chains of any size
    shrink in a few rounds. All of it is grouping and equi-joins; each round is written.
    """
    both = lambda e: e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    left = written(edges.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a != b").distinct(), "edges")
    roots = written(both(left).select(F.col("a").alias("node")).distinct().select("node", F.col("node").alias("root")), "roots")
    while not left.isEmpty():
        step = both(left).groupBy(F.col("a").alias("from")).agg(F.min("b").alias("least")).select("from", F.least("from", "least").alias("to"))
        step = written(step, "step")
        moved = left.join(step, left["a"] == step["from"]).select(F.col("to").alias("a"), "b")
        moved = moved.join(step, moved["b"] == step["from"]).select("a", F.col("to").alias("b"))
        left = written(moved.filter("a != b").distinct(), "edges")
        joined = roots.join(step, roots["root"] == step["from"], "left")
        roots = written(joined.select("node", F.coalesce("to", "root").alias("root")), "roots")
    return roots
