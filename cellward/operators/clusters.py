"""Density clusters of points, and their summaries."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellward.operators.tabular import ordinal
from cellward.sources.storage import cut, shuffled, sized


#: Labels that may be broadcast.
MANY = 1 << 16


def spread_labels(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """(id, label): smallest id that the undirected edges (id, other) connect each vertex with.

    Labels are lowered over edges and then through their own labels, until none changes; each round is cut off
    by a checkpoint in the shared folder.  More than ``MANY`` labels meet the edges by shuffle.
    """
    edges = cut(edges.where("id <> other"))
    labels = cut(vertices.select("id", F.col("id").alias("label")))
    total = None
    while True:
        now, n = labels.agg(F.sum(F.col("label").cast("decimal(38,0)")), F.count(F.lit(1))).first()
        if now == total:
            return labels
        total = now
        known = shuffled(labels) if n > MANY else labels
        near = edges.join(known.select(F.col("id").alias("other"), "label"), "other").groupBy("id").agg(F.min("label").alias("near"))
        step = known.join(near, "id", "left").select("id", F.least("label", F.coalesce("near", "label")).alias("label"))
        through = step.select(F.col("id").alias("label"), F.col("label").alias("next"))
        labels = cut(step.join(through, "label", "left").select("id", F.least("label", F.coalesce("next", "label")).alias("label")))


#: Points of a grid cell that go to one piece of it.
PIECE = 1 << 16


def _beside(df: DataFrame, steps: list[tuple[int, int]]) -> DataFrame:
    """Each row once for each step, with the cell that lies there."""
    s = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in steps)))
    return df.withColumn("s", s).withColumns({"cx": F.col("cx") + F.col("s.a"), "cy": F.col("cy") + F.col("s.b")}).drop("s")


def _pieced(cells: DataFrame) -> DataFrame:
    """Each cell once for each of its pieces."""
    return cells.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pieces") - 1)))


def _apart(ax, ay, bx, by) -> Column:
    dx, dy = ax - bx, ay - by
    return F.sqrt(dx * dx + dy * dy)


def dbscan(points: DataFrame, eps: float, least: int) -> DataFrame:
    """(id, cluster): the smallest core id of the cluster, null for noise.

    A point of (id, x, y) with ``least`` points within ``eps``, itself included, is core.  A border point goes to the cluster of
    its smallest core neighbour.  Points without finite coordinates are noise; ids are unique.

    No pairs are listed.  All points of a grid cell of side eps / sqrt 2 are neighbours, so a cell of ``least`` points is core as it
    is, and only points of emptier cells count their neighbours: fewer than ``least`` of them ask each of a cell's points.
    Cells, not points, are connected: by eight outermost core points of each; points are only compared between
    cells that this leaves in different clusters, and of these only those within eps of the other cell's points' bounds.
    A cell of very many points is parted, so no task holds one whole; tables of points or cells meet by shuffle.
    """
    side = eps / math.sqrt(2) * 0.999999
    number = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    placed = points.where(number("x") & number("y")).select("id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    placed = placed.withColumns({c: F.floor(F.col(v) / side).cast("long") for c, v in (("cx", "x"), ("cy", "y"))})
    cells = cut(placed.groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("n")).withColumn("pieces", F.ceil(F.col("n") / PIECE)))
    hot = sized(cells.where("pieces > 1").select("cx", "cy", "pieces"))
    dealt = placed.join(hot, ["cx", "cy"], "left").withColumn("pieces", F.coalesce("pieces", F.lit(1).cast("long")))
    dealt = cut(dealt.withColumn("piece", F.pmod(F.xxhash64("id"), F.col("pieces"))))
    key = ["cx", "cy", "piece"]
    around = [(a, b) for a in range(-2, 3) for b in range(-2, 3)]

    sparse = cut(dealt.join(shuffled(_pieced(cells.where(F.col("n") < least)).select(*key)), key, "left_semi"))
    asked = _beside(sparse.select("id", F.col("x").alias("x0"), F.col("y").alias("y0"), "cx", "cy"), around)
    within = _apart(F.col("x0"), F.col("y0"), F.col("x"), F.col("y")) <= eps
    met = _pieced(asked.join(shuffled(cells.select("cx", "cy", "pieces")), ["cx", "cy"])).join(shuffled(dealt.select(*key, "x", "y")), key).where(within)
    enough = met.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("id")
    core = cut(dealt.join(shuffled(_pieced(cells.where(F.col("n") >= least)).select(*key)), key, "left_semi").unionByName(sparse.join(enough, "id", "left_semi")))

    place = F.struct("x", "y")
    ways = [F.col("x"), F.col("y"), F.col("x") + F.col("y"), F.col("x") - F.col("y")]
    outer = F.array_distinct(F.array(*(f(place, w) for w in ways for f in (F.min_by, F.max_by))))
    bounds = [f(c).alias(f"{n}{c}") for c in ("x", "y") for f, n in ((F.min, "low_"), (F.max, "high_"))]
    held = cut(core.groupBy("cx", "cy").agg(F.min("id").alias("own"), F.max("pieces").alias("pieces"), outer.alias("outer"), F.struct(*bounds).alias("box")))
    left = _beside(held.select(F.struct("own", "pieces", "outer", "box", "cx", "cy").alias("a"), "cx", "cy"), [s for s in around if s > (0, 0)])
    pairs = left.join(shuffled(held.select("cx", "cy", F.struct("own", "pieces", "outer", "box", "cx", "cy").alias("b"))), ["cx", "cy"]).select("a", "b")
    gap = lambda c: F.greatest(F.col(f"a.box.low_{c}") - F.col(f"b.box.high_{c}"), F.col(f"b.box.low_{c}") - F.col(f"a.box.high_{c}"), F.lit(0.0))
    pairs = pairs.where(F.sqrt(gap("x") * gap("x") + gap("y") * gap("y")) <= eps)
    sure = F.exists("a.outer", lambda p: F.exists("b.outer", lambda q: _apart(p["x"], p["y"], q["x"], q["y"]) <= eps))
    pairs = cut(pairs.withColumn("sure", sure))

    both = lambda e: e.union(e.select(F.col("other").alias("id"), F.col("id").alias("other")))
    first = spread_labels(both(pairs.where("sure").select(F.col("a.own").alias("id"), F.col("b.own").alias("other"))), held.select(F.col("own").alias("id")))
    open_ = pairs.where("not sure").select("a", "b", F.col("a.own").alias("ao"), F.col("b.own").alias("bo"))
    for one, label in (("ao", "la"), ("bo", "lb")):
        open_ = open_.join(shuffled(first.select(F.col("id").alias(one), F.col("label").alias(label))), one)
    open_ = cut(open_.where("la <> lb"))

    def frontier(one: str, other: str) -> DataFrame:
        """The core points of one cell of each open pair that lie near the other's bounds, each place once."""
        asked = _pieced(open_.select("ao", "bo", "la", "lb", F.col(f"{other}.box").alias("box"), F.col(f"{one}.cx").alias("cx"), F.col(f"{one}.cy").alias("cy"), F.col(f"{one}.pieces").alias("pieces")))
        off = lambda c: F.greatest(F.col(f"box.low_{c}") - F.col(c), F.col(c) - F.col(f"box.high_{c}"), F.lit(0.0))
        near = asked.join(shuffled(core.select(*key, "x", "y")), key).where(F.sqrt(off("x") * off("x") + off("y") * off("y")) <= eps)
        return near.select("ao", "bo", "la", "lb", F.col("x").alias(f"{one}x"), F.col("y").alias(f"{one}y")).distinct()

    labels = first.withColumnRenamed("id", "own")
    if open_.limit(1).count():
        touching = frontier("a", "b").join(frontier("b", "a"), ["ao", "bo", "la", "lb"]).where(_apart(F.col("ax"), F.col("ay"), F.col("bx"), F.col("by")) <= eps)
        second = spread_labels(both(touching.select(F.col("la").alias("id"), F.col("lb").alias("other")).distinct()), first.select(F.col("label").alias("id")).distinct())
        labels = first.select(F.col("id").alias("own"), F.col("label").alias("id")).join(second, "id").select("own", "label")
    named = cut(_pieced(held.select("cx", "cy", "own", "pieces")).join(shuffled(labels), "own").select(*key, "label"))

    inner = core.join(shuffled(named), key).select("id", "label")
    rest = asked.join(shuffled(core.select("id")), "id", "left_anti")
    border = rest.join(shuffled(named), ["cx", "cy"]).join(shuffled(core.select(*key, "x", "y", F.col("id").alias("other"))), key).where(within).groupBy("id").agg(F.min_by("label", "other").alias("label"))
    return shuffled(points.select("id")).join(inner.unionByName(border), "id", "left").select("id", F.col("label").alias("cluster"))


def _label_tile(diagonal: bool):
    steps = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if diagonal else [])

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        at = {(r, c): i for i, (r, c) in enumerate(zip(frame["row"].tolist(), frame["col"].tolist()))}
        parent = list(range(len(frame)))

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        for (r, c), i in at.items():
            for dr, dc in steps:
                j = at.get((r + dr, c + dc))
                if j is not None:
                    a, b = root(i), root(j)
                    parent[max(a, b)] = min(a, b)
        ids = frame["id"].to_numpy()
        low = pd.Series(ids).groupby([root(i) for i in range(len(frame))]).transform("min")
        return frame[["row", "col"]].assign(part=low.to_numpy())

    return run


def connected_cells(cells: DataFrame, diagonal: bool = False, tile: int = 64) -> DataFrame:
    """(row, col, cluster): edge-connected (or also corner-connected) groups of cells.

    Each tile of cells is labelled in a task; only the parts that touch across tile borders are connected by
    rounds of joins, so their number grows with the borders and not with the cells.
    """
    key = F.col("row").cast("long") * F.lit(1 << 32) + F.col("col")
    over = lambda c: F.floor(F.col(c) / tile).cast("long")
    own = cells.select("row", "col", key.alias("id"), over("row").alias("tr"), over("col").alias("tc"))
    parts = cut(own.groupBy("tr", "tc").applyInPandas(_label_tile(diagonal), "row int, col int, part long"))
    steps = [(0, 1), (1, 0)] + ([(1, 1), (1, -1)] if diagonal else [])
    edge = F.col("row") % tile == tile - 1, F.col("col") % tile == tile - 1, F.col("col") % tile == 0
    near = parts.where(edge[0] | edge[1] | (edge[2] if diagonal else F.lit(False))).withColumn("s", F.explode(F.array(*(F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r, c in steps))))
    near = near.select(F.col("part").alias("id"), (F.col("row") + F.col("s.r")).alias("row"), (F.col("col") + F.col("s.c")).alias("col"))
    forth = near.join(parts.withColumnRenamed("part", "other"), ["row", "col"]).where("id <> other").select("id", "other")
    edges = cut(forth.union(forth.select(F.col("other").alias("id"), F.col("id").alias("other"))).distinct())
    labels = spread_labels(edges, edges.select("id").distinct()).select(F.col("id").alias("part"), "label")
    return parts.join(labels, "part", "left").select("row", "col", F.coalesce("label", "part").alias("cluster"))


def numbered(stats: DataFrame, least_area: float, order: list[str]) -> DataFrame:
    """Large enough clusters, numbered from 0 in a stable order."""
    return ordinal(stats.where(F.col("area") >= least_area), order, "risk_cluster_id").withColumn("risk_cluster_id", F.col("risk_cluster_id").cast("int"))


def summary(stats: DataFrame, by: str) -> DataFrame:
    """Clusters of each file or scenario."""
    return stats.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_clusters"),
        (F.sum("area") / 1e6).alias("total_km2"),
        F.avg("area").alias("mean_area"),
        F.max("area").alias("max_area"),
        F.avg("mean_risk").alias("mean_risk"),
        F.max("max_risk").alias("max_risk"),
        F.sum("pixel_count").alias("pixels"),
    )
