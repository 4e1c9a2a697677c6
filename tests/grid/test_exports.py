import json

from cellward.operators import catalog, web

RING = "id long, layer string, ring array<struct<x: double, y: double>>"


def square(x, y, side=1.0):
    return [(x, y), (x + side, y), (x + side, y + side), (x, y + side)]


def test_exportable(spark):
    bow = [(0.0, 40.0), (2.0, 42.0), (2.0, 40.0), (0.0, 42.0)]
    rows = [
        (1, "good", square(100.0, 10.0)), (2, "good", bow), (3, "good", None),
        (4, "bad", square(200.0, 10.0)), (5, "bad", square(0.0, 50.0)), (6, "bad", bow), (7, "bad", square(-100.0, -60.0, 190.0)), (8, "bad", square(44.5, 74.5)), (9, "bad", square(46.0, 50.0)), (10, "bad", None), (11, "bad", []),
        (12, "gone", square(200.0, 10.0)), (13, None, square(10.0, 40.0, 0.0)), (14, None, square(10.0, 40.0, 0.0005)),
    ]
    made = web.exportable(spark.createDataFrame(rows, RING), "layer", 20.0)
    assert made.columns == ["id", "layer", "ring"]
    assert sorted(r.id for r in made.collect()) == [1, 2, 3, 5, 7, 8, 14]
    assert web.exportable(spark.createDataFrame([], RING), "layer", 20.0).count() == 0


def test_tile_coverage(spark):
    tiles = spark.createDataFrame([("clusters_SLR-1-Very_High_GDP.mbtiles", 2, x, 1) for x in (3, 0, 1, 2)] + [("other", 0, 0, 0)], "file string, z int, x long, y long")
    given = [("other", "1,2,3,4"), ("a", "1, 2,3,4"), ("b", None), ("c", "1,2,3"), ("d", "1,2,NaN,4")]
    got = catalog.tile_coverage(tiles, spark.createDataFrame(given, "file string, bounds string"), most=3).orderBy("file", "k").collect()
    assert [(r.file, r.n_tiles, r.k, r.x) for r in got if r.n_tiles] == [("clusters_SLR-1-Very_High_GDP.mbtiles", 4, k, k - 1) for k in (1, 2, 3)] + [("other", 1, 1, 0)]
    assert {r.file: r.bounds for r in got if not r.n_tiles} == {"a": [1, 2, 3, 4], "b": [-180, -90, 180, 90], "c": [-180, -90, 180, 90], "d": [-180, -90, 180, 90]}
    assert {(r.file[:8], r.scenario, r.risk_type) for r in got} == {("clusters", "very_high", "gdp")} | {(f, "unknown", "unknown") for f in ("other", "a", "b", "c", "d")}
    shape = next(json.loads(r.feature) for r in got if r.file == "a")
    assert shape["geometry"]["coordinates"] == [[[1, 4], [3, 4], [3, 2], [1, 2], [1, 4]]] and shape["properties"]["file"] == "a"
