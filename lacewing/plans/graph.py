"""Connected components of an edge table, by minimum labels with hooking and shortcuts, in logarithmically many rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacewing.plans.tables import settle


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component) for each node of an edge; component is the smallest node that can be reached.

    Each round, a node's parent becomes the least of: its grandparent; the grandparents of its neighbours; and, for a
    parent, those of its children's neighbours. A hub's edges meet a broadcast or skew-split join and a partial minimum, so
    no task gathers them. Null ends and loops are ignored; repeated edges change nothing; no edges give no rows.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    e = settle(e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    f = settle(e.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("f")).select(F.col("u").alias("node"), "f", F.lit(True).alias("new")))
    while f.where("new").limit(1).count():
        up = f.select(F.col("node").alias("f"), F.col("f").alias("gp"))
        g = settle(f.join(up, "f").select("node", "f", "gp"))
        near = e.join(g.select(F.col("node").alias("v"), "gp"), "v").groupBy("u").agg(F.min("gp").alias("m")).withColumnRenamed("u", "node")
        seen = settle(g.join(near, "node").select("node", "f", F.least("gp", "m").alias("m")))
        hooks = seen.select("node", "m").union(seen.select(F.col("f").alias("node"), "m")).groupBy("node").agg(F.min("m").alias("m"))
        f = settle(g.join(hooks, "node").select("node", F.least("f", "m").alias("f"), (F.least("f", "m") < F.col("f")).alias("new")))
    return f.select("node", F.col("f").alias("component"))
