"""Connected components where one vertex or one component may hold a third of all edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellward.llm.sparkops import salted_join, stored


#: Most vertices whose labels are broadcast.
FEW = 1 << 17


def components(edges: DataFrame, few: int = FEW) -> DataFrame:
    """(v, label): the smallest vertex that edges (a, b) connect each vertex with; vertices without another one are left out.

    Rounds of the smallest label among neighbours and of a label's own label go on until nothing changes.  Labels of up
    to ``few`` vertices are broadcast; beyond that both joins part the keys that hold more than a task's share: a vertex
    by its edges, a label by the vertices that have it.
    """
    both = stored(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct())
    labels = stored(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.col("a")).alias("label"), F.count(F.lit(1)).alias("degree")))
    total, small = None, labels.count() <= few
    while True:
        now = labels.agg(F.sum(F.col("label").cast("decimal(38,0)"))).first()[0]
        if now == total:
            return labels.select("v", "label")
        total = now
        ends = labels.select(F.col("v").alias("b"), "label", "degree")
        near = both.join(F.broadcast(ends), "b") if small else salted_join(both, ends, "b", "degree", ["a"], "inner")
        step = stored(labels.join(near.groupBy(F.col("a").alias("v")).agg(F.min("label").alias("m")), "v").select("v", F.least("label", "m").alias("label"), "degree"))
        own = step.select(F.col("v").alias("label"), F.col("label").alias("next"))
        if small:
            labels = step.join(F.broadcast(own), "label", "left")
        else:
            labels = salted_join(step, step.groupBy("label").agg(F.count(F.lit(1)).alias("used")).join(own, "label", "left"), "label", "used", ["v"])
        labels = stored(labels.select("v", F.least("label", F.coalesce("next", "label")).alias("label"), "degree"))
