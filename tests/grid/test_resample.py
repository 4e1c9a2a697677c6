"""Projections against published points and round trips; resampling against plain arrays."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellward.functions import crs
from cellward.operators import resample
from cellward.plans.config import GridSpec


def test_published_points():
    assert crs.laea(5.0, 50.0, math) == pytest.approx((3962799.45, 2999718.85), abs=0.01)  # the registry's worked example
    assert crs.laea(10.0, 52.0, math) == pytest.approx((4321000.0, 3210000.0), abs=1e-6)
    assert crs.mercator(-100.33333333, 24.46358028, math)[0] == pytest.approx(-11169055.58, abs=0.5)
    assert crs.mollweide(180.0, 0.0, math) == pytest.approx((2 * math.sqrt(2) * crs.A, 0.0))
    assert crs.mollweide(77.0, 90.0, math) == pytest.approx((0.0, math.sqrt(2) * crs.A), abs=100)


def test_columns_and_numbers_agree_and_come_back(spark):
    draw = random.Random(1)
    points = [(draw.uniform(-25, 45), draw.uniform(30, 72)) for _ in range(80)] + [(10.0, 52.0), (0.0, 0.0), (4.5, 52.25)]
    df = spark.createDataFrame(points, "lon double, lat double")
    for name in crs.SYSTEMS:
        x, y = crs.transform(F.col("lon"), F.col("lat"), "EPSG:4326", name)
        there = df.select("lon", "lat", x.alias("x"), y.alias("y"))
        back = crs.transform(F.col("x"), F.col("y"), name, "EPSG:4326")
        for r in there.select("*", back[0].alias("u"), back[1].alias("v")).collect():
            assert (r.x, r.y) == pytest.approx(crs.transform(r.lon, r.lat, "EPSG:4326", name, math), rel=1e-12, abs=1e-6)
            assert (r.u, r.v) == pytest.approx((r.lon, r.lat), abs=1e-6)
    with pytest.raises(ValueError, match="unknown"):
        crs.transform(F.col("lon"), F.col("lat"), "EPSG:4326", "EPSG:1")


def plain_warp(values, source, target, method):
    out = {}
    for r in range(target.height):
        for c in range(target.width):
            x, y = crs.transform(target.x0 + (c + 0.5) * target.res, target.y0 - (r + 0.5) * target.res, target.crs, source.crs, math)
            x, y = (x - source.x0) / source.res, (source.y0 - y) / source.res
            if method == "nearest":
                out[r, c] = values.get((math.floor(y), math.floor(x)))
                continue
            x, y = x - 0.5, y - 0.5
            near = [(abs(1 - i - (y - math.floor(y))) * abs(1 - j - (x - math.floor(x))), values.get((math.floor(y) + i, math.floor(x) + j))) for i in (0, 1) for j in (0, 1)]
            total = sum(w for w, v in near if v is not None)
            out[r, c] = sum(w * v for w, v in near if v is not None) / total if total else None
    return out


def test_two_steps_to_the_target(spark):
    draw = random.Random(4)
    source = GridSpec(4.0, 53.0, 0.05, 40, 24, "EPSG:4326")
    values = {(r, c): draw.random() for r in range(24) for c in range(40) if draw.random() < 0.8}
    df = spark.createDataFrame([(*k, v) for k, v in values.items()], "row int, col int, e double")
    target = GridSpec.covering(3_900_000, 3_170_000, 4_050_000, 3_330_000, 9_000)
    middle = resample.grid_for(source, "ESRI:54009")
    for method in ("nearest", "bilinear"):
        first = {k: v for k, v in plain_warp(values, source, middle, method).items() if v is not None}
        want = plain_warp(first, middle, target, method)
        got = {(r.row, r.col): r.v for r in resample.to_target(df, "e", source, target, method).collect()}
        assert got.keys() == want.keys() and any(v is None for v in got.values())
        assert all((got[k] is None) == (v is None) and (v is None or got[k] == pytest.approx(v, abs=1e-9)) for k, v in want.items())
    with pytest.raises(ValueError, match="no value"):
        resample.to_target(df, "e", source, GridSpec.covering(0, 0, 50_000, 50_000, 10_000), "nearest")


@pytest.mark.parametrize(("ratio", "top", "left"), [(1.5, 0.0, 0.0), (0.7, 0.0, 0.0), (2.0, -0.25, 1.5), (0.3, 0.1, -2.0)])
def test_overlaps_keep_the_mass(spark, ratio, top, left):
    draw = random.Random(2)
    values = np.array([[draw.random() for _ in range(11)] for _ in range(9)])
    df = spark.createDataFrame([(r, c, float(values[r, c])) for r in range(9) for c in range(11)] + [(3, 20, None)], "row int, col int, e double")
    rows, cols = math.ceil((9 - top) / ratio), math.ceil((11 - left) / ratio)
    part = lambda n, m, first: np.array([[max(0.0, min(i + 1, first + (k + 1) * ratio) - max(i, first + k * ratio)) for i in range(m)] for k in range(n)])
    want = part(rows, 9, top) @ values @ part(cols, 11, left).T
    got = np.zeros((rows, cols))
    for r in resample.overlap_sum(df, "e", ratio, rows, cols, top, left).collect():
        got[r.row, r.col] = r.v
    assert np.allclose(got, want, atol=1e-12)
    if top <= 0 and left <= 0:
        assert got.sum() == pytest.approx(values.sum(), rel=1e-9)


@pytest.mark.parametrize(("how", "ratio"), [("cubic", 1.5), ("cubic_spline", 0.6), ("lanczos", 2.3)])
def test_kernels_by_their_formula(spark, how, ratio):
    draw = random.Random(7)
    values = {(r, c): draw.random() for r in range(23) for c in range(31) if draw.random() < 0.85 and not (r < 9 and c < 9)}
    df = spark.createDataFrame([(*k, v) for k, v in values.items()], "row int, col int, e double")

    def weight(t):
        t = abs(t)
        if how == "cubic":
            return 1.5 * t**3 - 2.5 * t**2 + 1 if t <= 1 else -0.5 * t**3 + 2.5 * t**2 - 4 * t + 2 if t < 2 else 0
        if how == "cubic_spline":
            return (4 - 6 * t**2 + 3 * t**3) / 6 if t <= 1 else (2 - t) ** 3 / 6 if t < 2 else 0
        return 1 if t == 0 else 3 * math.sin(math.pi * t) * math.sin(math.pi * t / 3) / (math.pi * t) ** 2 if t < 3 else 0

    want = {}
    for r in range(int(23 / ratio)):
        for c in range(int(31 / ratio)):
            w = {k: weight(((r + 0.5) * ratio - k[0] - 0.5) / max(1, ratio)) * weight(((c + 0.5) * ratio - k[1] - 0.5) / max(1, ratio)) for k in values}
            if sum(w.values()) > 1e-6:
                want[r, c] = sum(w[k] * values[k] for k in values) / sum(w.values())
    for tile in (7, 256):
        got = {(r.row, r.col): r.v for r in resample.kernel(df, "e", 23, 31, ratio, how, tile).collect()}
        assert got.keys() == want.keys() and all(got[k] == pytest.approx(v, abs=1e-9) for k, v in want.items())


def test_population_by_ratio_or_by_sums(spark):
    cells = spark.createDataFrame([(r, c, float(r + c)) for r in range(6) for c in range(6)], "row int, col int, e double")
    target = GridSpec(0.0, 300.0, 30.0, 10, 10)
    area = resample.frame(spark, target).where("row < 9")
    wide = {(r.row, r.col): r.population for r in resample.population(cells, "e", GridSpec(0.0, 300.0, 50.0, 6, 6), target, area).collect()}
    assert wide[9, 3] == 0.0 and wide[4, 4] == pytest.approx((4.5 * 0.6 * 2 - 1) * 900 / (57.1 * 92.8))
    narrow = resample.population(cells, "e", GridSpec(0.0, 300.0, 20.0, 6, 6), target, area, native=(20.0, 20.0)).collect()
    assert sum(r.population for r in narrow) == pytest.approx(sum(r + c for r in range(6) for c in range(6)))
    with pytest.raises(ValueError, match="one system"):
        resample.population(cells, "e", GridSpec(4.0, 53.0, 0.1, 6, 6, "EPSG:4326"), target, area, native=(20.0, 20.0))
