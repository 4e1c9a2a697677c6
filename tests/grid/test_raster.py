"""Tiles and percentiles against plain versions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellward.operators import normalise, raster


def field(spark, rows, cols, seed=1):
    rng = random.Random(seed)
    a = np.array([[rng.random() for _ in range(cols)] for _ in range(rows)])
    return a, spark.createDataFrame([(r, c, float(a[r, c])) for r in range(rows) for c in range(cols)], "row int, col int, v double")


def grid_of(df, name, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        assert np.isnan(out[r.row, r.col])  # each cell once
        out[r.row, r.col] = r[name]
    return out


@pytest.mark.parametrize("edge, mode", [("reflect", "symmetric"), ("nearest", "edge")])
def test_gaussian_over_tiles(spark, edge, mode):
    a, df = field(spark, 23, 37)
    radius, sigma = 6, 1.5
    taps = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    padded = np.pad(a, radius, mode=mode)
    want = sum(x * y * padded[i : i + 23, j : j + 37] for i, x in enumerate(taps) for j, y in enumerate(taps)) / taps.sum() ** 2
    for tile in (8, 16, 256):
        got = grid_of(raster.gaussian(df, "v", 23, 37, sigma, edge, tile=tile), "smooth", a.shape)
        assert np.allclose(got, want)


def test_closing_over_tiles(spark):
    a, df = field(spark, 21, 30, 5)
    mask, reach = a > 0.93, raster.disk(3)
    grown = np.zeros_like(mask)
    for r, c in zip(*np.nonzero(mask)):
        for y, x in reach:
            if 0 <= r + y < 21 and 0 <= c + x < 30:
                grown[r + y, c + x] = True
    want = np.array([[all(not (0 <= r + y < 21 and 0 <= c + x < 30) or grown[r + y, c + x] for y, x in reach) for c in range(30)] for r in range(21)])
    for tile in (7, 256):
        got = grid_of(raster.closing(df.withColumn("m", F.col("v") > 0.93), "m", 21, 30, 3, tile=tile), "closed", a.shape)
        assert (got == want).all()


@pytest.mark.parametrize("bins", [3, normalise.BINS])
def test_percentiles(spark, monkeypatch, bins):
    monkeypatch.setattr(normalise, "BINS", bins)
    rng = random.Random(9)
    groups = {"a": [rng.gauss(0, 1) for _ in range(201)], "b": [3.0] * 50, "c": [1.0], "d": [rng.choice([0.0, 0.0, 0.0, 5.0]) for _ in range(80)], "e": [1e9, -1e9, 1.0, 2.0, None]}
    rows = [(g, v) for g, vs in groups.items() for v in vs] + [("f", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    shares = {"lo": 0.0, "q": 0.25, "m": 0.5, "p": 0.99, "hi": 1.0}
    got = {r.g: r for r in normalise.percentiles(df, F.col("v"), shares, ["g"]).collect()}
    assert set(got) == set(groups)
    for g, vs in groups.items():
        for name, share in shares.items():
            assert got[g][name] == pytest.approx(np.quantile([v for v in vs if v is not None], share)), (g, name)
    whole = normalise.percentiles(df, F.col("v"), shares).first()
    for name, share in shares.items():
        assert whole[name] == pytest.approx(np.quantile([v for _, v in rows if v is not None], share))
    assert normalise.percentiles(df.where("g = 'f'"), F.col("v"), shares).count() == 0
