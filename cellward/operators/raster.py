"""Map algebra on cell tables with integer ``row`` and ``col``.

Neighbourhoods of a few cells are equi-joins on shifted keys.  Larger ones are worked out tile by tile: each cell goes
to its own tile and to the tiles whose rim it lies on, one shuffle of the layer and its rims, and a task holds one tile.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cells of a tile's side.
TILE = 256
KEY = ["row", "col"]


def centre(x0: float, y0: float, res: float) -> tuple[Column, Column]:
    """Coordinates of the cell's centre."""
    return F.lit(x0) + (F.col("col") + 0.5) * res, F.lit(y0) - (F.col("row") + 0.5) * res


def _shifts(pairs: list[tuple[int, int, float]]) -> Column:
    return F.explode(F.array(*(F.struct(F.lit(r).alias("r"), F.lit(c).alias("c"), F.lit(w).alias("w")) for r, c, w in pairs)))


def tiled(df: DataFrame, value: Column, rows: int, cols: int, rim: int, work: Callable, out: str, kind: str, tile: int = TILE, by: tuple[str, ...] = ()) -> DataFrame:
    """(by, row, col, out): ``work`` maps a tile with its rim, as an array of doubles (0 where there is no cell), to an array of the same shape.

    It is called with the array and, for its four sides (top, bottom, left, right), how many cells of the rim lie beyond
    the grid and are missing from the array.  Each value of the columns ``by`` is a layer of its own.
    """
    over = lambda c, n: F.explode(F.sequence(F.greatest(F.floor((F.col(c) - rim) / tile), F.lit(0)), F.least(F.floor((F.col(c) + rim) / tile), F.lit((n - 1) // tile))))
    dealt = df.select(*by, *KEY, F.coalesce(value.cast("double"), F.lit(0.0)).alias("v")).withColumn("tr", over("row", rows)).withColumn("tc", over("col", cols))

    def run(key, frame: pd.DataFrame) -> pd.DataFrame:
        r0, c0 = key[-2] * tile, key[-1] * tile
        top, left = max(0, r0 - rim), max(0, c0 - rim)
        bottom, right = min(rows, r0 + tile + rim), min(cols, c0 + tile + rim)
        r, c = frame["row"].to_numpy(), frame["col"].to_numpy()
        field = np.zeros((bottom - top, right - left))
        field[r - top, c - left] = frame["v"].to_numpy()
        done = work(field, (rim - (r0 - top), rim - max(0, bottom - min(rows, r0 + tile)), rim - (c0 - left), rim - max(0, right - min(cols, c0 + tile))))
        own = (r >= r0) & (r < r0 + tile) & (c >= c0) & (c < c0 + tile)
        return pd.DataFrame({**dict(zip(by, key)), "row": r[own], "col": c[own], out: done[r[own] - top, c[own] - left]})

    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = ", ".join(f"{c} {types[c]}" for c in (*by, *KEY))
    return dealt.groupBy(*by, "tr", "tc").applyInPandas(run, f"{schema}, {out} {kind}")


def gaussian(df: DataFrame, value: str, rows: int, cols: int, sigma: float = 1.0, edge: str = "reflect", out: str = "smooth", tile: int = TILE, by: tuple[str, ...] = ()) -> DataFrame:
    """Separable Gaussian of radius int(4 sigma + 0.5) over a grid; nulls and missing cells count as 0.

    Beyond the edges the grid is mirrored with the edge cell repeated (``reflect``) or the edge goes on (``nearest``).
    """
    radius = int(4 * sigma + 0.5)
    taps = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    taps /= taps.sum()
    mode = "symmetric" if edge == "reflect" else "edge"

    def work(field, beyond):
        a = np.pad(field, ((beyond[0], beyond[1]), (beyond[2], beyond[3])), mode=mode)
        for axis in (0, 1):
            a = np.pad(a, [(radius, radius) if i == axis else (0, 0) for i in (0, 1)])
            n = a.shape[axis] - 2 * radius
            a = sum(w * np.take(a, range(k, k + n), axis=axis) for k, w in enumerate(taps))
        return a[beyond[0] : a.shape[0] - beyond[1], beyond[2] : a.shape[1] - beyond[3]]

    return tiled(df, F.col(value), rows, cols, radius, work, out, "double", tile, by)


def disk(radius: int) -> list[tuple[int, int]]:
    return [(r, c) for r in range(-radius, radius + 1) for c in range(-radius, radius + 1) if r * r + c * c <= radius * radius]


def closing(df: DataFrame, mask: str, rows: int, cols: int, radius: int = 1, out: str = "closed", tile: int = TILE, by: tuple[str, ...] = ()) -> DataFrame:
    """Binary dilation and erosion with a disk; beyond the grid is empty for the first and full for the second."""
    reach = disk(radius)

    def work(field, beyond):
        h, w = field.shape
        padded = np.pad(field > 0, radius)
        grown = np.zeros((h, w), bool)
        for r, c in reach:
            grown |= padded[radius + r : radius + r + h, radius + c : radius + c + w]
        padded, left = np.pad(grown, radius, constant_values=True), np.ones((h, w), bool)
        for r, c in reach:
            left &= padded[radius + r : radius + r + h, radius + c : radius + c + w]
        return left

    return tiled(df, F.when(F.col(mask), 1.0).otherwise(0.0), rows, cols, 2 * radius, work, out, "boolean", tile, by)


def nearest(df: DataFrame, value: str, targets: DataFrame, ratio: float, out: str = "v") -> DataFrame:
    """Value of the source cell in which a target cell's centre lies; a target cell is ``ratio`` source cells wide."""
    at = lambda c: F.floor((F.col(c) + 0.5) * ratio).cast("int")
    asked = targets.select(*KEY, at("row").alias("__r"), at("col").alias("__c"))
    return asked.join(df.select(F.col("row").alias("__r"), F.col("col").alias("__c"), F.col(value).alias(out)), ["__r", "__c"], "left").select(*KEY, out)


def bilinear(df: DataFrame, value: str, targets: DataFrame, ratio: float, out: str = "v") -> DataFrame:
    """R2: from the four source cells around a target's centre, by distance, over those that hold a value."""
    at = lambda c: (F.col(c) + 0.5) * ratio - 0.5
    asked = targets.select(*KEY, at("row").alias("__y"), at("col").alias("__x"))
    asked = asked.withColumn("s", _shifts([(0, 0, 0.0), (0, 1, 0.0), (1, 0, 0.0), (1, 1, 0.0)]))
    dy, dx = F.col("__y") - F.floor("__y"), F.col("__x") - F.floor("__x")
    weight = F.when(F.col("s.r") == 1, dy).otherwise(1 - dy) * F.when(F.col("s.c") == 1, dx).otherwise(1 - dx)
    asked = asked.select(*KEY, (F.floor("__y") + F.col("s.r")).cast("int").alias("__r"), (F.floor("__x") + F.col("s.c")).cast("int").alias("__c"), weight.alias("__w"))
    source = df.select(F.col("row").alias("__r"), F.col("col").alias("__c"), F.col(value).alias("__v")).where("__v is not null")
    joined = asked.join(source, ["__r", "__c"]).groupBy(*KEY).agg(F.sum(F.col("__w") * F.col("__v")).alias("__s"), F.sum("__w").alias("__w"))
    return targets.select(*KEY).join(joined, KEY, "left").select(*KEY, F.try_divide("__s", "__w").alias(out))


def split_sum(df: DataFrame, value: str, parts: int, out: str = "v") -> DataFrame:
    """To cells ``parts`` times finer, each with an even part of the mass."""
    fine = F.explode(F.sequence(F.lit(0), F.lit(parts * parts - 1)))
    rows = df.select(*KEY, (F.col(value) / (parts * parts)).alias(out), fine.alias("__i"))
    return rows.select((F.col("row") * parts + F.floor(F.col("__i") / parts)).cast("int").alias("row"), (F.col("col") * parts + F.col("__i") % parts).cast("int").alias("col"), out)


#: Aggregates by name, for coarser grids.
REDUCERS = {
    "average": lambda v: F.avg(v),
    "sum": lambda v: F.sum(v),
    "min": lambda v: F.min(v),
    "max": lambda v: F.max(v),
    "mode": lambda v: F.mode(v, True),
    "med": lambda v: F.percentile(v, F.lit(0.5)),
    "q1": lambda v: F.percentile(v, F.lit(0.25)),
    "q3": lambda v: F.percentile(v, F.lit(0.75)),
    "rms": lambda v: F.sqrt(F.avg(v * v)),
}


def coarser(df: DataFrame, value: str, k: int, how: list[str]) -> DataFrame:
    """K by k cells in one, a column for each of the ways, all in one pass."""
    part = lambda c: F.floor(F.col(c) / k).cast("int").alias(c)
    return df.select(part("row"), part("col"), F.col(value).alias("__v")).groupBy(*KEY).agg(*(REDUCERS[h](F.col("__v")).alias(h) for h in how))


def pyramid(df: DataFrame, value: str, levels: list[int], out: str = "v") -> DataFrame:
    """Averages at each level, all from the full layer in one pass."""
    part = lambda c: F.floor(F.col(c) / F.col("level")).cast("int").alias(c)
    rows = df.withColumn("level", F.explode(F.array(*map(F.lit, levels))))
    return rows.select("level", part("row"), part("col"), F.col(value).alias("__v")).groupBy("level", *KEY).agg(F.avg("__v").alias(out))


def overview_levels(width: int, height: int, least: int = 256) -> list[int]:
    """2, 4, 8 and so on while the reduced side is longer than ``least``."""
    out, level = [], 2
    while max(width, height) // level > least:
        out.append(level)
        level *= 2
    return out


def masked(df: DataFrame, area: DataFrame, values: list[str]) -> DataFrame:
    """0 outside the study area's cells."""
    marked = df.join(area.select(*KEY).distinct().withColumn("__in", F.lit(True)), KEY, "left")
    return marked.withColumns({v: F.when(F.col("__in"), F.col(v)).otherwise(0.0) for v in values}).drop("__in")
