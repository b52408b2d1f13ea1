"""Connected components by repeated contraction, all in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvid.session import scratch, shared_table


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, root for every node of the undirected edges; nodes of one component share a root.

    Each round lets every node follow its neighbour of least priority twice, then replaces the
    ends of all edges by where their nodes went and drops loops and repeats. Priorities are
    hashes, so a round removes a constant share of the nodes whatever the shape of the graph
    and the number of rounds grows with the logarithm of the longest chain. A node with very
    many neighbours is pre-aggregated (min), never gathered. Rows with a null end and loops are
    ignored; repeated edges count once; no edges give no nodes. The result is a shared table.
    """
    rank = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("id"))
    one = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u != v")
    with scratch(edges.sparkSession) as keep:
        both = shared_table(one.unionByName(one.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
        steps: list[DataFrame] = []
        while both.limit(1).count():
            least = both.groupBy("u").agg(F.min(rank("v")).alias("m"))
            parent = shared_table(least.select("u", F.least(F.col("m"), rank("u"))["id"].alias("p")), "parents")
            jumped = shared_table(parent.join(parent.select(F.col("u").alias("p"), F.col("p").alias("q")), "p").select("u", F.col("q").alias("p")), "jumps")
            steps.append(jumped)
            moved = both.join(jumped.withColumnRenamed("p", "pu"), "u").join(jumped.select(F.col("u").alias("v"), F.col("p").alias("pv")), "v")
            both = shared_table(moved.where("pu != pv").select(F.col("pu").alias("u"), F.col("pv").alias("v")).distinct(), "edges")
        if not steps:
            return one.select(F.col("u").alias("node"), F.col("v").alias("root")).limit(0)
        labels = steps[-1].select(F.col("u").alias("node"), F.col("p").alias("root"))
        for step in reversed(steps[:-1]):
            later = labels.select(F.col("node").alias("p"), F.col("root"))
            labels = step.join(later, "p", "left").select(F.col("u").alias("node"), F.coalesce("root", "p").alias("root"))
        return keep(shared_table(labels, "components"))
