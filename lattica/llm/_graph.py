"""Connected components of a table of links, by contraction."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import stage


def components(links: DataFrame) -> DataFrame:
    """Links (a, b) to (v, component): the smallest vertex reachable.  Every vertex of a link is listed once.

    Each round every vertex points to its smallest neighbour, or itself if smaller; pointers are doubled to the roots, and
    the links between roots go on.  A round at least halves the vertices of each component, and stars need one."""
    e = stage(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    label = None
    while not e.isEmpty():
        p = stage(e.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("up")))
        while True:
            q = p.select(F.col("v").alias("up"), F.col("up").alias("top"))
            p = stage(p.join(q, "up", "left").select("v", F.coalesce("top", "up").alias("up"), (F.coalesce("top", "up") != F.col("up")).alias("moved")))
            if p.where("moved").isEmpty():
                break
        p = p.select("v", "up")
        label = p if label is None else stage(label.withColumnRenamed("v", "_v").withColumnRenamed("up", "v").join(p, "v", "left").select(F.col("_v").alias("v"), F.coalesce("up", "v").alias("up")))
        a, b = p.select(F.col("v").alias("a"), F.col("up").alias("ra")), p.select(F.col("v").alias("b"), F.col("up").alias("rb"))
        e = stage(e.join(a, "a").join(b, "b").where("ra <> rb").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct())
    if label is None:
        label = e.select(F.col("a").alias("v"), F.col("b").alias("up"))
    return label.select("v", F.col("up").alias("component"))
