"""Outlines of groups of cells: rings with holes, convex hulls, filled holes, finished clusters.

A group is what the column ``label`` says; cells of one label that touch along an edge are one region.  A region's
border is made of directed edges, each with the region on its right when row numbers grow downwards.  The cells around
an edge's end say which edge follows, so the edges are a permutation, and its cycles are the rings.

Edges are strung to pieces tile by tile, a task holding one tile and its rim.  Only the pieces that leave their tile are
linked across tiles, by pointer jumping: rounds in which each piece learns of twice as many followers, first the
smallest piece of its ring, then how far the ring's end is.  No ring, region or border is gathered whole, but where the
ring itself is the wanted row (``polygons``).  Areas and lengths are sums over pieces.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellward.operators.clusters import spread_labels
from cellward.operators.tabular import ordinal
from cellward.sources.storage import cut, sized

TILE = 256
#: Sides of a cell in turn (top, right, bottom, left): the way to the neighbour beyond it, and the way along it.
BEYOND = ((-1, 0), (0, 1), (1, 0), (0, -1))
#: From a cell's top left corner to the corner at which the side begins, in half cells for the side's middle.
CORNER = ((0, 0), (0, 1), (1, 1), (1, 0))


def edge_key(row, col, side):
    """One number for a side of a cell; rows and columns below 2 ** 30."""
    return (row * (1 << 30) + col) * 4 + side


def _regions(tile: int):
    """Of a tile's cells the edge-connected parts of one label: runs of each row, then runs that touch from row to row."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["row", "col"], ignore_index=True)
        row, col, label = (frame[c].to_numpy() for c in ("row", "col", "label"))
        starts = np.ones(len(frame), bool)
        starts[1:] = (row[1:] != row[:-1]) | (col[1:] != col[:-1] + 1) | (label[1:] != label[:-1])
        piece = np.cumsum(starts) - 1
        at = row.astype(np.int64) * (1 << 32) + col
        below = np.minimum(np.searchsorted(at, at + (1 << 32)), len(at) - 1)
        touch = np.flatnonzero((at[below] == at + (1 << 32)) & (label[below] == label))
        root = list(range(piece[-1] + 1))

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for a, b in np.unique(np.stack([piece[touch], piece[below[touch]]], 1), axis=0).tolist():
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
        first = at[starts]
        return frame.assign(part=first[[find(i) for i in range(len(root))]][piece])[["row", "col", "label", "part"]]

    return run


def regions(cells: DataFrame, tile: int = TILE) -> DataFrame:
    """(row, col, label, region): edge-connected cells of one label, named by their first cell in row order.

    Cells with a null label belong to no region and are left out; a cell that is listed twice counts once, with its smallest label.
    """
    own = cells.where("label is not null").groupBy("row", "col").agg(F.min(F.col("label").cast("long")).alias("label"))
    over = lambda c: F.floor(F.col(c) / tile)
    parts = own.select(F.col("row").cast("int").alias("row"), F.col("col").cast("int").alias("col"), "label", over("row").alias("tr"), over("col").alias("tc"))
    parts = cut(parts.groupBy("tr", "tc").applyInPandas(_regions(tile), "row int, col int, label long, part long"))
    edge = [parts.where(F.pmod(F.col(c), F.lit(tile)) == tile - 1).select(F.col("part").alias("id"), "label", (F.col("row") + int(c == "row")).alias("row"), (F.col("col") + int(c == "col")).alias("col")) for c in ("row", "col")]
    first = [parts.where(F.pmod(F.col(c), F.lit(tile)) == 0).select(F.col("part").alias("other"), "label", "row", "col") for c in ("row", "col")]
    forth = edge[0].join(first[0], ["row", "col", "label"]).select("id", "other").union(edge[1].join(first[1], ["row", "col", "label"]).select("id", "other"))
    edges = cut(forth.union(forth.select(F.col("other").alias("id"), F.col("id").alias("other"))).distinct())
    labels = spread_labels(edges, edges.select("id").distinct()).select(F.col("id").alias("part"), F.col("label").alias("region"))
    return parts.join(labels, "part", "left").select("row", "col", "label", F.coalesce("region", "part").alias("region"))


def _string(tile: int, middles: bool):
    """Of a tile with a rim of one cell the pieces of its cells' border edges."""

    def run(key, frame: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = key[0] * tile, key[1] * tile
        names, own = np.unique(frame["region"].to_numpy(), return_inverse=True)
        field = np.full((tile + 2, tile + 2), -1, np.int64)
        field[frame["row"].to_numpy() - r0 + 1, frame["col"].to_numpy() - c0 + 1] = own
        inner = np.zeros(field.shape, bool)
        inner[1:-1, 1:-1] = field[1:-1, 1:-1] >= 0
        edges: dict[tuple[int, int, int], tuple[int, int, int]] = {}
        for side, (dr, dc) in enumerate(BEYOND):
            r, c = np.nonzero(inner)
            open_ = field[r + dr, c + dc] != field[r, c]
            r, c = r[open_], c[open_]
            ar, ac = BEYOND[(side + 1) % 4]  # along the side, which is where the next side's neighbour lies
            along = field[r + ar, c + ac] == field[r, c]
            ahead = along & (field[r + ar + dr, c + ac + dc] == field[r, c])
            nr, nc = r + np.where(along, ar, 0) + np.where(ahead, dr, 0), c + np.where(along, ac, 0) + np.where(ahead, dc, 0)
            ns = (side + np.where(ahead, 3, np.where(along, 0, 1))) % 4
            edges.update(zip(zip(r.tolist(), c.tolist(), [side] * len(r)), zip(nr.tolist(), nc.tolist(), ns.tolist())))
        absolute = lambda e: edge_key(e[0] + r0 - 1, e[1] + c0 - 1, e[2])

        def points(chain: list[tuple[int, int, int]]) -> list[dict]:
            if middles:
                return [{"x": c + c0 - 0.5 + BEYOND[s][1] / 2, "y": r + r0 - 0.5 + BEYOND[s][0] / 2} for r, c, s in chain]
            # a straight line needs its first corner only
            kept = [e for k, e in enumerate(chain) if not k or chain[k - 1][2] != e[2]]
            return [{"x": float(c + c0 - 1 + CORNER[s][1]), "y": float(r + r0 - 1 + CORNER[s][0])} for r, c, s in kept]

        inside = lambda e: 1 <= e[0] <= tile and 1 <= e[1] <= tile
        entered = {e for e in edges.values() if e in edges}
        out = []
        seen: set[tuple[int, int, int]] = set()
        for start in [*(e for e in edges if e not in entered), *edges]:
            if start in seen:
                continue
            chain, e = [], start
            while e in edges and e not in seen:
                seen.add(e)
                chain.append(e)
                e = edges[e]
            assert e == start or not inside(e), "an edge that no other cell's border goes on with"
            out.append((int(names[field[start[0], start[1]]]), absolute(start), absolute(e), min(map(absolute, chain)), len(chain), points(chain)))
        return pd.DataFrame(out, columns=["region", "piece", "next", "least", "n", "points"])

    return run


def pieces(cells: DataFrame, tile: int = TILE, middles: bool = False) -> DataFrame:
    """Of (row, col, region) the border pieces (region, piece, next, least, n, points): edge numbers at which a piece and its follower begin, and its smallest one.

    Points are corners of cells (x by columns, y by rows), or with ``middles`` the middles of the edges, which cuts corners off
    as marching squares at a half do.
    """
    over = lambda c: F.explode(F.array_distinct(F.array(*(F.floor((F.col(c) + k) / tile) for k in (-1, 0, 1)))))
    dealt = cells.select("row", "col", "region").withColumn("tr", over("row")).withColumn("tc", over("col"))
    return dealt.groupBy("tr", "tc").applyInPandas(_string(tile, middles), "region long, piece long, next long, least long, n long, points array<struct<x: double, y: double>>")


def string_rings(parts: DataFrame) -> DataFrame:
    """The pieces with ``ring``, the smallest edge of their ring, and ``place``, how many pieces of the ring come before."""
    whole = parts.where("piece = next").withColumns({"ring": F.col("least"), "place": F.lit(0).cast("long")}).drop("least")
    linked = parts.where("piece <> next")
    state = cut(linked.select("piece", "next", F.col("next").alias("to"), F.least("piece", "next").alias("least")))
    while True:  # least: over the piece and its next 2 ** k ones; to: the 2 ** k-th of them
        ahead = state.select(F.col("piece").alias("to"), F.col("to").alias("on"), F.col("least").alias("further"))
        state = cut(state.join(ahead, "to").select("piece", "next", F.col("on").alias("to"), F.least("least", "further").alias("new"), (F.col("further") < F.col("least")).alias("moved")).withColumnRenamed("new", "least"))
        if not state.where("moved").limit(1).count():
            break
    # the ring is cut open before its smallest piece: each piece counts the pieces up to the end
    rest = cut(state.select("piece", F.col("least").alias("ring"), F.when(F.col("next") != F.col("least"), F.col("next")).alias("to"), F.lit(1).cast("long").alias("left")))
    while rest.where("to is not null").limit(1).count():
        ahead = rest.select(F.col("piece").alias("to"), F.col("to").alias("on"), F.col("left").alias("more"))
        rest = cut(rest.join(ahead, "to", "left").select("piece", "ring", F.col("on").alias("to"), (F.col("left") + F.coalesce("more", F.lit(0))).alias("left")))
    head = rest.where("piece = ring").select("ring", F.col("left").alias("all"))
    placed = linked.join(rest, "piece").join(head, "ring").withColumn("place", F.col("all") - F.col("left"))
    names = placed.groupBy("ring").agg(F.min("least").alias("name"))
    placed = placed.join(names, "ring").withColumn("ring", F.col("name"))
    return placed.select(*whole.columns).unionByName(whole)


def _shoelace(points: str, start: str) -> Column:
    """Twice the signed area between the origin and the piece with the follower's first point behind it; positive around a region."""
    return F.expr(f"aggregate(zip_with({points}, concat(slice({points}, 2, size({points})), array({start})), (a, b) -> a.x * b.y - b.x * a.y), 0D, (s, v) -> s + v)")


def ring_pieces(cells: DataFrame, tile: int = TILE, middles: bool = False) -> DataFrame:
    """All border pieces of (row, col, region) with ring, place, n edges, points, and ``doubled``, their share of twice the ring's area."""
    found = cut(string_rings(cut(pieces(cells, tile, middles))))
    first = found.select(F.col("piece").alias("next"), F.element_at("points", 1).alias("start"))
    return found.join(first, "next").withColumn("doubled", _shoelace("points", "start")).drop("start")


def rings(found: DataFrame, res: float = 1.0) -> DataFrame:
    """Of ring pieces each ring: region, ring, area (negative for a hole), length, n_pieces, closed (every piece's follower is in the ring)."""
    follower = found.select(F.col("piece").alias("next"), F.col("ring").alias("own"), F.col("place").alias("after"))
    joined = found.join(follower, "next", "left")
    right = (F.col("own") == F.col("ring")) & ((F.col("after") == F.col("place") + 1) | (F.col("after") == 0))
    return joined.groupBy("region", "ring").agg(
        (F.sum("doubled") / 2 * res * res).alias("area"), (F.sum("n") * res).alias("length"), F.count(F.lit(1)).alias("n_pieces"), F.coalesce(F.bool_and(right), F.lit(False)).alias("closed")
    )


def tidy(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """A ring without the points on straight lines, from its smallest point by y and x on."""
    n = len(points)
    kept = [p for k, p in enumerate(points) if (p[0] - points[k - 1][0]) * (points[(k + 1) % n][1] - p[1]) != (p[1] - points[k - 1][1]) * (points[(k + 1) % n][0] - p[0])]
    at = min(range(len(kept)), key=lambda k: (kept[k][1], kept[k][0]))
    return kept[at:] + kept[:at]


def _tidy(batches):
    for frame in batches:
        frame["points"] = [[{"x": x, "y": y} for x, y in tidy([(p["x"], p["y"]) for p in ring])] for ring in frame["points"]]
        yield frame


def polygons(found: DataFrame) -> DataFrame:
    """region, outer ring and array of holes in the order of their first edges; rings are array<struct<x, y>>, tidy, without the first point repeated.

    Here a ring is a row, and what it takes is its own points.
    """
    whole = found.groupBy("region", "ring").agg(F.sum("doubled").alias("doubled"), F.array_sort(F.collect_list(F.struct("place", "points"))).alias("parts"))
    ring = whole.select("region", "ring", "doubled", F.flatten(F.col("parts.points")).alias("points"))
    ring = ring.mapInPandas(_tidy, ring.schema)
    outer = ring.where("doubled > 0").select("region", F.col("points").alias("outer"))
    holes = ring.where("doubled < 0").groupBy("region").agg(F.transform(F.array_sort(F.collect_list(F.struct("ring", "points"))), lambda h: h["points"]).alias("holes"))
    none = F.expr("cast(array() as array<array<struct<x: double, y: double>>>)")
    return outer.join(holes, "region", "left").select("region", "outer", F.coalesce("holes", none).alias("holes"))


def interior(found: DataFrame) -> DataFrame:
    """(row, col) of all cells inside rings, from the pieces of their cell borders: between the first and second, third and fourth ... upright edge of each row."""
    step = F.expr("zip_with(points, concat(slice(points, 2, size(points)), array(start)), (a, b) -> struct(a.x as x, least(a.y, b.y) as low, greatest(a.y, b.y) as high, a.x = b.x as upright))")
    first = found.select(F.col("piece").alias("next"), F.element_at("points", 1).alias("start"))
    lines = found.join(first, "next").select("ring", F.explode(step).alias("e")).where("e.upright and e.low < e.high")
    marks = lines.select("ring", F.col("e.x").cast("int").alias("col"), F.explode(F.sequence(F.col("e.low").cast("int"), F.col("e.high").cast("int") - 1)).alias("row"))
    in_row = Window.partitionBy("ring", "row").orderBy("col")
    spans = marks.withColumns({"k": F.row_number().over(in_row), "until": F.lead("col").over(in_row)}).where("k % 2 = 1")
    return spans.select("row", F.explode(F.sequence(F.col("col"), F.col("until") - 1)).alias("col")).distinct()


def fill_holes(cells: DataFrame, threshold: float = 0.1, res: float = 30.0, tile: int = TILE) -> DataFrame:
    """(row, col, region) after holes that are small beside their region have been filled, with what lies inside them.

    A hole is filled if its area is under ``threshold * sqrt(scale)`` of the region's, where the scale is the side in kilometres of
    a square of the region's area, but at least 1.  Regions inside a filled hole become part of the one around it.
    """
    own = cut(regions(cells.select("row", "col", F.lit(0).alias("label")), tile))
    found = cut(ring_pieces(own, tile))
    ring = rings(found, res)
    whole = ring.groupBy("region").agg(F.sum("area").alias("whole"))
    scale = F.greatest(F.lit(1.0), F.sqrt("whole") / 1000)
    small = ring.where("area < 0").join(whole, "region").where(-F.col("area") / F.col("whole") < threshold * F.sqrt(scale)).select("ring")
    inside = interior(found.join(small, "ring", "left_semi"))
    return regions(own.select("row", "col").union(inside).distinct().withColumn("label", F.lit(0)), tile).select("row", "col", "region")


def finalised(cells: DataFrame, threshold: float = 0.1, least_area: float = 0.0, res: float = 30.0, tile: int = TILE) -> DataFrame:
    """Filled, large enough clusters (row, col, risk_cluster_id, area), numbered from 0 by their first cell in row order."""
    filled = cut(fill_holes(cells, threshold, res, tile))
    large = filled.groupBy("region").agg((F.count(F.lit(1)) * res * res).alias("area")).where(F.col("area") >= least_area)
    numbered = sized(ordinal(large, ["region"], "risk_cluster_id").withColumn("risk_cluster_id", F.col("risk_cluster_id").cast("int")))
    return filled.join(numbered, "region").select("row", "col", "risk_cluster_id", "area")


def hull_of(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Corners of the convex hull, counter-clockwise from the smallest, without points on its sides."""
    points = sorted(set(points))
    if len(points) < 3:
        return points
    half = []
    for order in (points, points[::-1]):
        side: list[tuple[float, float]] = []
        for p in order:
            while len(side) > 1 and (side[-1][0] - side[-2][0]) * (p[1] - side[-2][1]) - (side[-1][1] - side[-2][1]) * (p[0] - side[-2][0]) <= 0:
                side.pop()
            side.append(p)
        half += side[:-1]
    return half


def convex_hulls(points: DataFrame, by: str, fold: int = 64, tile: float = 1024.0) -> DataFrame:
    """(by, hull): corners of each group's convex hull, counter-clockwise from the smallest (x, y).

    Each tile's part of a group is reduced to its hull in a task of its own; hulls of ``fold`` parts are merged until one is left, so
    a task holds the corners of so many hulls and never a group.  A group of fewer than three different points, or of points
    on one line, has its ends; rows with a null coordinate are left out.
    """
    kind = points.schema[by].dataType.simpleString()
    schema = f"{by} {kind}, part long, x double, y double"

    def reduce(frame: pd.DataFrame) -> pd.DataFrame:
        corners = hull_of(list(zip(frame["x"].tolist(), frame["y"].tolist())))
        return pd.DataFrame({by: frame[by].iloc[0], "part": frame["part"].iloc[0], "x": [p[0] for p in corners], "y": [p[1] for p in corners]})

    here = points.where("x is not null and y is not null").select(by, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).distinct()
    part = F.pmod(F.xxhash64(F.floor(F.col("x") / tile), F.floor(F.col("y") / tile)), F.lit(fold**3))
    found = here.withColumn("part", part).groupBy(by, "part").applyInPandas(reduce, schema)
    for _ in range(3):
        found = found.withColumn("part", F.floor(F.col("part") / fold)).groupBy(by, "part").applyInPandas(reduce, schema)
    corners = found.groupBy(by).applyInPandas(lambda frame: pd.DataFrame({by: [frame[by].iloc[0]], "hull": [[{"x": x, "y": y} for x, y in hull_of(list(zip(frame["x"].tolist(), frame["y"].tolist())))]]}), f"{by} {kind}, hull array<struct<x: double, y: double>>")
    return corners
