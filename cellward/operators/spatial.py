"""Vector geometry as ring arrays, and joins of shapes with cells.

A ring is array<struct<x, y>> without a repeated last point.  Shapes meet cells by way of tiles: a shape is
exploded to the tiles that its bounding box (grown by the distance asked for) touches, cells carry the key of
their tile, and only equal tiles are joined before the exact test.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _following(ring: str) -> str:
    return f"concat(slice({ring}, 2, size({ring}) - 1), slice({ring}, 1, 1))"


def area(ring: str) -> Column:
    """G1: by the shoelace formula."""
    return F.expr(f"abs(aggregate(zip_with({ring}, {_following(ring)}, (a, b) -> a.x * b.y - b.x * a.y), 0D, (s, v) -> s + v)) / 2")


def bounds(ring: str) -> list[Column]:
    """min_x, min_y, max_x, max_y."""
    return [F.expr(f"array_{f}(transform({ring}, p -> p.{c}))").alias(f"{f}_{c}") for f in ("min", "max") for c in ("x", "y")]


def total_bounds(df: DataFrame, buffer: float = 0.0) -> DataFrame:
    """Extent of all rows with min_x to max_y, grown by a share of its size."""
    box = df.agg(*(getattr(F, f)(f"{f}_{c}").alias(f"{f}_{c}") for f in ("min", "max") for c in ("x", "y")))
    w, h = F.col("max_x") - F.col("min_x"), F.col("max_y") - F.col("min_y")
    return box.select((F.col("min_x") - buffer * w).alias("min_x"), (F.col("min_y") - buffer * h).alias("min_y"), (F.col("max_x") + buffer * w).alias("max_x"), (F.col("max_y") + buffer * h).alias("max_y"))


def contains(ring: str, x: str, y: str) -> Column:
    """Whether a point lies inside, by the parity of crossings."""
    crossing = f"(a.y > {y}) <> (b.y > {y}) and {x} < (b.x - a.x) * ({y} - a.y) / (b.y - a.y) + a.x"
    return F.expr(f"aggregate(zip_with({ring}, {_following(ring)}, (a, b) -> if({crossing}, 1, 0)), 0, (s, v) -> s + v) % 2 = 1")


def boxes_meet(a: str, b: str) -> Column:
    """Whether two rows' bounding boxes overlap."""
    return F.expr(f"{a}.min_x <= {b}.max_x and {b}.min_x <= {a}.max_x and {a}.min_y <= {b}.max_y and {b}.min_y <= {a}.max_y")


def segment_distance(x: Column, y: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance of a point from a segment."""
    dx, dy = bx - ax, by - ay
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.try_divide((x - ax) * dx + (y - ay) * dy, dx * dx + dy * dy), F.lit(0.0))))
    return F.sqrt(F.pow(x - (ax + t * dx), F.lit(2.0)) + F.pow(y - (ay + t * dy), F.lit(2.0)))


def _tile(c: str, tile: float) -> Column:
    return F.floor(F.col(c) / tile).cast("int")


def _tiled(df: DataFrame, tile: float, grow: float = 0.0) -> DataFrame:
    span = lambda c: F.explode(F.sequence(F.floor((F.col(f"min_{c}") - grow) / tile).cast("int"), F.floor((F.col(f"max_{c}") + grow) / tile).cast("int")))
    return df.withColumn("tile_x", span("x")).withColumn("tile_y", span("y"))


def rasterise(cells: DataFrame, shapes: DataFrame, ring: str, value: str, order: str, tile: float, out: str = "burned") -> DataFrame:
    """Cells (with centre x, y) get the value of the last shape that holds their centre, else null."""
    boxed = shapes.select(ring, value, order, *bounds(ring))
    near = cells.withColumn("tile_x", _tile("x", tile)).withColumn("tile_y", _tile("y", tile)).join(_tiled(boxed, tile), ["tile_x", "tile_y"])
    hit = near.where(F.col("x").between(F.col("min_x"), F.col("max_x")) & F.col("y").between(F.col("min_y"), F.col("max_y")) & contains(ring, "x", "y"))
    burned = hit.groupBy("row", "col").agg(F.max_by(value, order).alias(out))
    return cells.join(burned, ["row", "col"], "left")


def distances(cells: DataFrame, segments: DataFrame, limit: float, tile: float, out: str = "distance") -> DataFrame:
    """Distance of cell centres from the nearest segment (ax, ay, bx, by), null beyond ``limit``."""
    box = segments.select("*", F.least("ax", "bx").alias("min_x"), F.greatest("ax", "bx").alias("max_x"), F.least("ay", "by").alias("min_y"), F.greatest("ay", "by").alias("max_y"))
    near = cells.select("row", "col", "x", "y").withColumn("tile_x", _tile("x", tile)).withColumn("tile_y", _tile("y", tile)).join(_tiled(box, tile, limit), ["tile_x", "tile_y"])
    d = segment_distance(*(F.col(c) for c in ("x", "y", "ax", "ay", "bx", "by")))
    best = near.groupBy("row", "col").agg(F.min(d).alias(out)).where(F.col(out) <= limit)
    return cells.join(best, ["row", "col"], "left")


def spread_area(cells: DataFrame, shapes: DataFrame, ring: str, value: str, res: float, tile: float, parts: int = 2, out: str = "burned") -> DataFrame:
    """Cells (with centre x, y) with what shapes bring to them, each its value by area, added up where shapes overlap.

    A cell is tried at the centres of ``parts`` by ``parts`` smaller ones; each that lies in a shape gets the shape's value for a square metre
    times its own area.  Shapes without area or with a value of 0, less or null bring nothing; cells without a shape get 0.
    """
    shift = lambda k: (k + 0.5) / parts - 0.5
    fine = F.explode(F.array(*(F.struct(F.lit(shift(i) * res).alias("x"), F.lit(shift(j) * res).alias("y")) for i in range(parts) for j in range(parts))))
    tried = cells.select("row", "col", "x", "y", fine.alias("s")).select("row", "col", (F.col("x") + F.col("s.x")).alias("x"), (F.col("y") + F.col("s.y")).alias("y"))
    dense = shapes.where(F.col(value) > 0).select(ring, (F.col(value) / F.nullif(area(ring), F.lit(0.0))).alias("__dense"), *bounds(ring)).where("__dense is not null")
    near = tried.withColumn("tile_x", _tile("x", tile)).withColumn("tile_y", _tile("y", tile)).join(_tiled(dense, tile), ["tile_x", "tile_y"])
    hit = near.where(F.col("x").between(F.col("min_x"), F.col("max_x")) & F.col("y").between(F.col("min_y"), F.col("max_y")) & contains(ring, "x", "y"))
    sums = hit.groupBy("row", "col").agg(F.sum(F.col("__dense") * (res / parts) ** 2).alias(out))
    return cells.join(sums, ["row", "col"], "left").withColumn(out, F.coalesce(out, F.lit(0.0)))


def square_distance(x: Column, y: Column, half: float, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance of the square around (x, y) from a segment, 0 if they touch."""
    gap = lambda px, py: F.sqrt(F.pow(F.greatest(F.abs(px - x) - half, F.lit(0.0)), F.lit(2.0)) + F.pow(F.greatest(F.abs(py - y) - half, F.lit(0.0)), F.lit(2.0)))
    corners = [(x + i * half, y + j * half) for i in (-1, 1) for j in (-1, 1)]
    sides = [(bx - ax) * (cy - ay) - (by - ay) * (cx - ax) for cx, cy in corners]
    boxes = (F.least(ax, bx) <= x + half) & (F.greatest(ax, bx) >= x - half) & (F.least(ay, by) <= y + half) & (F.greatest(ay, by) >= y - half)
    meet = boxes & (F.least(*sides) <= 0) & (F.greatest(*sides) >= 0)
    return F.when(meet, 0.0).otherwise(F.least(gap(ax, ay), gap(bx, by), *(segment_distance(cx, cy, ax, ay, bx, by) for cx, cy in corners)))


def touched(cells: DataFrame, shapes: DataFrame, ring: str, limit: float, res: float, tile: float, out: str = "touched") -> DataFrame:
    """Whether a cell's square comes within ``limit`` of a shape, or lies in one: every cell that the shape's buffer touches."""
    x, y = F.col("x"), F.col("y")
    at = cells.select("row", "col", "x", "y").withColumn("tile_x", _tile("x", tile)).withColumn("tile_y", _tile("y", tile))
    pairs = F.zip_with(ring, F.expr(_following(ring)), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    sides = shapes.select(F.explode(pairs).alias("s")).select(F.col("s.a.x").alias("ax"), F.col("s.a.y").alias("ay"), F.col("s.b.x").alias("bx"), F.col("s.b.y").alias("by"))
    box = sides.select("*", F.least("ax", "bx").alias("min_x"), F.greatest("ax", "bx").alias("max_x"), F.least("ay", "by").alias("min_y"), F.greatest("ay", "by").alias("max_y"))
    by_rim = at.join(_tiled(box, tile, limit + res), ["tile_x", "tile_y"]).where(square_distance(x, y, res / 2, *(F.col(c) for c in ("ax", "ay", "bx", "by"))) <= limit).select("row", "col")
    inside = at.join(_tiled(shapes.select(ring, *bounds(ring)), tile), ["tile_x", "tile_y"]).where(contains(ring, "x", "y")).select("row", "col")
    hit = by_rim.union(inside).distinct().withColumn(out, F.lit(True))
    return cells.join(hit, ["row", "col"], "left").withColumn(out, F.coalesce(out, F.lit(False)))


def zonal(cells: DataFrame, zone: str, value: str, res: float = 30.0) -> DataFrame:
    """Size, mean, maximum and density of each zone's positive cells."""
    v = F.when(F.col(value) > 0, F.col(value))
    return cells.groupBy(zone).agg(
        F.count(v).alias("pixel_count"),
        F.coalesce(F.avg(v), F.lit(0.0)).alias("mean_risk"),
        F.coalesce(F.max(v), F.lit(0.0)).alias("max_risk"),
        (F.count(F.lit(1)) * res * res).alias("area"),
        F.coalesce(F.sum(v) / (F.count(F.lit(1)) * res * res), F.lit(0.0)).alias("density"),
    )


def tile_bounds(z: Column, x: Column, y: Column) -> list[Column]:
    """West, south, east, north of a Web Mercator tile."""
    n = F.pow(F.lit(2.0), z)
    lat = lambda v: F.degrees(F.atan(F.sinh(F.lit(3.141592653589793) * (1 - 2 * v / n))))
    return [(x / n * 360 - 180).alias("west"), lat(y + 1).alias("south"), ((x + 1) / n * 360 - 180).alias("east"), lat(y).alias("north")]


def tile_of(lon: Column, lat: Column, z: Column) -> list[Column]:
    """the tile that holds a point."""
    n = F.pow(F.lit(2.0), z)
    rad = F.radians(lat)
    return [F.floor((lon + 180) / 360 * n).cast("long").alias("x"), F.floor((1 - F.log(F.tan(rad) + 1 / F.cos(rad)) / 3.141592653589793) / 2 * n).cast("long").alias("y")]


def tms_flip(z: Column, y: Column) -> Column:
    """row numbers from the bottom instead of the top."""
    return (F.pow(F.lit(2.0), z) - 1 - y).cast("long")
