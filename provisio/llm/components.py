"""Connected components of a link table, without gathering it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provisio.llm import storage


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) of all nodes that have a link; component: the smallest node reachable.

    Alternates large-star and small-star steps until no edge changes.  Each step groups edges by
    node with partial aggregation and joins the minima back; steps are written to the shared
    folder, so lost executors cost their own tasks only.  Self links and repeated links are
    allowed; nodes are long numbers and never null.
    """
    edges = links.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).where("u != v").distinct()
    held = storage.Scratch(edges, "links")
    nodes = None
    while True:
        # large star: every neighbour above a node points to the smallest node around it
        both = held.df.unionByName(held.df.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        # small star: every node below a node, and the node itself, point to the smallest one
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where("u != v").distinct()
        done = storage.Scratch(small, "links")
        if nodes is None:
            nodes = held
        changed = done.df.join(held.df, ["u", "v"], "left_anti").limit(1).count() + held.df.join(done.df, ["u", "v"], "left_anti").limit(1).count()
        if held is not nodes:
            held.drop()
        held = done
        if not changed:
            break
    # stars: each node points to its smallest one
    label = held.df.groupBy("u").agg(F.min("v").alias("component"))
    roots = held.df.select(F.col("v").alias("u")).distinct().select("u", F.col("u").alias("component"))
    return label.unionByName(roots).groupBy(F.col("u").alias("node")).agg(F.min("component").alias("component"))
