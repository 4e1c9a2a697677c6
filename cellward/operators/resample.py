"""Reprojection and resampling of cell tables between any two grids."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellward.functions import crs
from cellward.operators.raster import KEY, masked
from cellward.operators.spatial import rasterise
from cellward.plans.config import GridSpec
from cellward.sources.storage import cut


def frame(spark: SparkSession, grid: GridSpec) -> DataFrame:
    """All cells (row, col) of a grid with their centres x and y; made in tasks, by number."""
    rows = spark.range(grid.width * grid.height).select(F.floor(F.col("id") / grid.width).cast("int").alias("row"), (F.col("id") % grid.width).cast("int").alias("col"))
    return rows.select(*KEY, (F.lit(grid.x0) + (F.col("col") + 0.5) * grid.res).alias("x"), (F.lit(grid.y0) - (F.col("row") + 0.5) * grid.res).alias("y"))


def grid_for(source: GridSpec, target: str) -> GridSpec:
    """The grid in another system that covers a source grid, with as many cells along its diagonal."""
    w, s, e, n = crs.transform_bounds(source.extent(), source.crs, target)
    res = math.hypot(e - w, n - s) / math.hypot(source.width, source.height)
    return GridSpec.covering(w, s, e, n, res, target)


def warp(cells: DataFrame, value: str, source: GridSpec, target: GridSpec, method: str = "bilinear", out: str = "v") -> DataFrame:
    """Every cell of the target grid with the value at its centre in the source grid, null where there is none.

    The target's centres are mapped back; ``nearest`` takes the cell in which they lie, ``bilinear`` the four cells around them,
    weighted by distance over those that have a value.  The source is joined by cell, in one shuffle of both sides.
    """
    x, y = crs.transform(F.col("x"), F.col("y"), target.crs, source.crs)
    at = frame(cells.sparkSession, target).select(*KEY, ((x - source.x0) / source.res).alias("__x"), ((source.y0 - y) / source.res).alias("__y"))
    values = cells.where(F.col(value).isNotNull()).select(F.col("row").alias("__r"), F.col("col").alias("__c"), F.col(value).alias("__v"))
    near = lambda c: F.floor(c).cast("int")
    if method == "nearest":
        return at.withColumns({"__r": near(F.col("__y")), "__c": near(F.col("__x"))}).join(values, ["__r", "__c"], "left").select(*KEY, F.col("__v").alias(out))
    if method != "bilinear":
        raise ValueError(f"unknown method {method}")
    at = at.withColumns({"__x": F.col("__x") - 0.5, "__y": F.col("__y") - 0.5})
    corners = F.explode(F.array(*(F.struct(F.lit(r).alias("r"), F.lit(c).alias("c")) for r in (0, 1) for c in (0, 1))))
    dx, dy = F.col("__x") - F.floor("__x"), F.col("__y") - F.floor("__y")
    weight = F.when(F.col("s.r") == 1, dy).otherwise(1 - dy) * F.when(F.col("s.c") == 1, dx).otherwise(1 - dx)
    asked = at.withColumn("s", corners).select(*KEY, (near(F.col("__y")) + F.col("s.r")).alias("__r"), (near(F.col("__x")) + F.col("s.c")).alias("__c"), weight.alias("__w"))
    sums = asked.join(values, ["__r", "__c"], "left").groupBy(*KEY).agg(F.sum(F.col("__w") * F.col("__v")).alias("__s"), F.sum(F.when(F.col("__v").isNotNull(), F.col("__w"))).alias("__t"))
    return sums.select(*KEY, F.try_divide("__s", "__t").alias(out))


def to_target(cells: DataFrame, value: str, source: GridSpec, target: GridSpec, method: str = "bilinear", between: str = "ESRI:54009", out: str = "v") -> DataFrame:
    """A layer on the target grid; one in degrees goes by way of an equal-area grid.  A result without any value is an error."""
    if source.crs == "EPSG:4326":
        middle = grid_for(source, between)
        cells, value, source = cut(warp(cells, value, source, middle, method)), "v", middle
    done = cut(warp(cells, value, source, target, method, out))
    if not done.where(F.col(out).isNotNull()).limit(1).count():
        raise ValueError("the transformed layer has no value at all")
    return done


def overlap_sum(cells: DataFrame, value: str, ratio: float, rows: int, cols: int, top: float = 0.0, left: float = 0.0, out: str = "v") -> DataFrame:
    """Mass on a grid of ``rows`` by ``cols`` whose cells are ``ratio`` source cells wide, from source place (top, left) on.

    Each source cell's mass is split by the areas that it shares with target cells; what lies beyond the target grid is left
    out.  Null masses count as none.  Target cells without a source cell are not there.
    """

    def shares(c: str, first: float, n: int):
        low, high = (F.col(c) - first) / ratio, (F.col(c) + 1 - first) / ratio
        spans = F.sequence(F.greatest(F.floor(low), F.lit(0)).cast("int"), F.least(F.ceil(high) - 1, F.lit(n - 1)).cast("int"))
        part = lambda k: (F.least(high, k + 1.0) - F.greatest(low, k.cast("double"))) * ratio
        some = F.transform(spans, lambda k: F.struct(k.alias("k"), part(k).alias("w")))
        return F.explode(F.filter(F.when((high > 0) & (low < n), some), lambda s: s["w"] > 0))

    split = cells.where(F.col(value).isNotNull()).select(*KEY, value).withColumn("__r", shares("row", top, rows)).withColumn("__c", shares("col", left, cols))
    return split.groupBy(F.col("__r.k").alias("row"), F.col("__c.k").alias("col")).agg(F.sum(F.col(value) * F.col("__r.w") * F.col("__c.w")).alias(out))


def _cubic(t):
    t = np.abs(t)
    return np.where(t <= 1, 1.5 * t**3 - 2.5 * t**2 + 1, np.where(t < 2, -0.5 * t**3 + 2.5 * t**2 - 4 * t + 2, 0.0))


def _spline(t):
    t = np.abs(t)
    return np.where(t <= 1, 2 / 3 - t**2 + t**3 / 2, np.where(t < 2, (2 - t) ** 3 / 6, 0.0))


def _lanczos(t):
    return np.where(np.abs(t) < 3, np.sinc(t) * np.sinc(t / 3), 0.0)


#: Kernels by name with their radius in cells.
KERNELS = {"cubic": (_cubic, 2), "cubic_spline": (_spline, 2), "lanczos": (_lanczos, 3)}


def kernel(cells: DataFrame, value: str, rows: int, cols: int, ratio: float, how: str, tile: int = 256, out: str = "v") -> DataFrame:
    """Cells ``ratio`` source cells wide from a separable kernel, stretched by the ratio where the target is coarser.

    The target grid covers what it can of ``rows`` by ``cols``.  Cells without a value, and those beyond the grid, have no weight, and the
    others' weights are scaled to 1; a target cell whose weights add up to less than 1e-6 is not there.  Source cells go to their own
    tile and to those on whose rim they lie: one shuffle, and a task holds one tile.
    """
    shape, radius = KERNELS[how]
    stretch = max(1.0, ratio)
    rim = math.ceil(radius * stretch) + 1
    high, wide = int(rows / ratio), int(cols / ratio)
    over = lambda c, n: F.explode(F.sequence(F.greatest(F.floor((F.col(c) - rim) / tile), F.lit(0)), F.least(F.floor((F.col(c) + rim) / tile), F.lit((n - 1) // tile))))
    dealt = cells.where(F.col(value).isNotNull()).select(*KEY, F.col(value).cast("double").alias("v")).withColumn("tr", over("row", rows)).withColumn("tc", over("col", cols))

    def weights(first: int, n: int, low: int, size: int):
        """Target numbers with centres from ``first`` to ``first + tile``, and their weights over source places from ``low`` on."""
        k = np.arange(max(0, math.floor(first / ratio) - 1), min(n, math.ceil((first + tile) / ratio) + 1))
        centre = (k + 0.5) * ratio
        k = k[(centre >= first) & (centre < first + tile)]
        gap = (k[:, None] + 0.5) * ratio - (np.arange(low, low + size)[None, :] + 0.5)
        return k, shape(gap / stretch)

    def run(key, frame: pd.DataFrame) -> pd.DataFrame:
        top, left, size = key[0] * tile - rim, key[1] * tile - rim, tile + 2 * rim
        field, there = np.zeros((size, size)), np.zeros((size, size))
        at = frame["row"].to_numpy() - top, frame["col"].to_numpy() - left
        field[at], there[at] = frame["v"].to_numpy(), 1.0
        r, wr = weights(key[0] * tile, high, top, size)
        c, wc = weights(key[1] * tile, wide, left, size)
        total, weight = wr @ field @ wc.T, wr @ there @ wc.T
        i, j = np.nonzero(weight > 1e-6)
        return pd.DataFrame({"row": r[i], "col": c[j], out: total[i, j] / weight[i, j]})

    return dealt.groupBy("tr", "tc").applyInPandas(run, f"row int, col int, {out} double")


#: Metres of a cell of the population layer, west to east and north to south.
POPULATION_CELL = (57.1, 92.8)


def population(cells: DataFrame, value: str, source: GridSpec, target: GridSpec, area: DataFrame, native: tuple[float, float] = POPULATION_CELL, out: str = "population") -> DataFrame:
    """People on the target grid, 0 outside the study area's cells (row, col).

    Where the layer's own cells are wider than the target's, each target cell takes the interpolated people of a cell by the ratio of the
    areas; where they aren't, shared areas are added up, for which both grids must be of one system.
    """
    if native[0] > target.res:
        scaled = to_target(cells, value, source, target, "bilinear", out=out).withColumn(out, F.col(out) * (target.res * target.res / (native[0] * native[1])))
    elif source.crs != target.crs:
        raise ValueError("sums need both grids in one system")
    else:
        place = (source.y0 - target.y0) / source.res, (target.x0 - source.x0) / source.res
        scaled = overlap_sum(cells, value, target.res / source.res, target.height, target.width, *place, out=out)
    return masked(scaled, area, [out])


def census_grid(shapes: DataFrame, ring: str, value: str, order: str, coarse: GridSpec, target: GridSpec, tile: float, out: str = "v") -> DataFrame:
    """Squares of a census on a coarse grid (the last of a cell in the given order, 0 where there is none), and bilinear from there to the target grid."""
    burned = rasterise(frame(shapes.sparkSession, coarse), shapes, ring, value, order, tile, "__burned")
    filled = burned.select(*KEY, F.coalesce(F.col("__burned").cast("double"), F.lit(0.0)).alias("__burned"))
    return to_target(filled, "__burned", coarse, target, "bilinear", out=out)
