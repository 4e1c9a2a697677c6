import json
import random

import numpy as np
from pyspark.sql import functions as F

from cellward.operators import clusterfiles
from cellward.plans.config import CLUSTERS, ClusterSettings

ROWS, COLS = 30, 40
SCHEMA = "file string, row int, col int, value double"


def plain_mask(field, settings):
    hot = np.nan_to_num(field) >= settings.risk_threshold
    radius = settings.morphological_closing_disk_size
    if settings.use_contour_method:
        radius = max(radius, int(np.ceil(np.sqrt(hot.sum() * settings.cell_size_meters**2) / 600)))
    reach = [(r, c) for r in range(-radius, radius + 1) for c in range(-radius, radius + 1) if r * r + c * c <= radius * radius]
    inside = lambda r, c: 0 <= r < ROWS and 0 <= c < COLS
    grown = np.array([[any(inside(r - a, c - b) and hot[r - a, c - b] for a, b in reach) for c in range(COLS)] for r in range(ROWS)])
    closed = np.array([[all(not inside(r + a, c + b) or grown[r + a, c + b] for a, b in reach) for c in range(COLS)] for r in range(ROWS)])
    if not settings.use_contour_method:
        return closed
    reach = range(-2 * radius, 2 * radius + 1)
    taps = np.exp(-0.5 * (np.array(reach) / (radius / 2)) ** 2)
    taps /= taps.sum()
    rows, cols = np.arange(ROWS), np.arange(COLS)
    smooth = sum(w * closed[np.clip(rows + d, 0, ROWS - 1)] for d, w in zip(reach, taps))
    return sum(w * smooth[:, np.clip(cols + d, 0, COLS - 1)] for d, w in zip(reach, taps)) >= 0.5


def parts(mask):
    seen, out = set(), []
    for start in zip(*np.nonzero(mask)):
        if start not in seen:
            seen.add(start)
            todo, own = [start], []
            while todo:
                r, c = todo.pop()
                own.append((int(r), int(c)))
                for n in ((r + 1, c), (r - 1, c), (r, c + 1), (r, c - 1)):
                    if 0 <= n[0] < ROWS and 0 <= n[1] < COLS and mask[n] and n not in seen:
                        seen.add(n)
                        todo.append(n)
            out.append(sorted(own))
    return sorted(out)


def layers(spark):
    rng = random.Random(5)
    fields = {n: np.array([[rng.random() for _ in range(COLS)] for _ in range(ROWS)]) for n in ("risk_SLR-1-A_gdp", "risk_SLR-2-B_population", "risk_SLR-2-B_freight_unloading", "risk_SLR-0-C_freight")}
    fields["risk_SLR-2-B_population"][5:20, 8:30] = 0.95  # far larger, so it is closed with a wider disk
    fields["risk_SLR-0-C_freight"] *= 0.5  # nothing over the threshold
    rows = [(n, r, c, float(f[r, c])) for n, f in fields.items() for r in range(ROWS) for c in range(COLS)]
    return fields, spark.createDataFrame(rows, SCHEMA)


def test_outlined_clusters_are_the_parts_of_each_files_mask(spark):
    fields, frame = layers(spark)
    settings = ClusterSettings.of({"risk_threshold": 0.88, "morphological_closing_disk_size": 1, "hole_area_threshold": 0.0, "minimum_polygon_area_square_meters": 1_800.0, "use_contour_method": True})
    got = {}
    for r in clusterfiles.extracted(frame, ROWS, COLS, settings, 16).collect():
        got.setdefault(r.file, {}).setdefault(r.risk_cluster_id, []).append((r.row, r.col))
    want = {n: [p for p in parts(plain_mask(fields[n], settings)) if len(p) > 1] for n in ("risk_SLR-1-A_gdp", "risk_SLR-2-B_population")}
    assert {n: [sorted(c[i]) for i in range(len(c))] for n, c in got.items()} == want


def test_files_without_clusters(spark):
    _, frame = layers(spark)
    few = ClusterSettings.of({"risk_threshold": 0.88, "minimum_samples": ROWS * COLS + 1, "use_contour_method": True})
    assert clusterfiles.extracted(frame, ROWS, COLS, few, 16).count() == 0
    assert clusterfiles.extracted(frame.limit(0), ROWS, COLS, few, 16).count() == 0
    none = spark.createDataFrame([(None, 0, 0, 1.0), ("risk_gdp", 0, 0, None), ("notes", 0, 0, 1.0)], SCHEMA)
    assert clusterfiles.extracted(none, ROWS, COLS, ClusterSettings(), 16).count() == 0


def test_names_and_settings(spark):
    names = [("risk_SLR-1-2050_gdp.tif",), ("risk_SLR-1-2050_gdp_loading",), ("risk_SLR-1-2050_freight_LOADING",), ("risk_COMBINED",), ("risk_freight",), (None,)]
    frame = spark.createDataFrame(names, "n string").select(clusterfiles.wanted(F.col("n")).alias("w"), *(c.alias(a) for c, a in zip(clusterfiles.parts_of(F.col("n")), "si")))
    assert [tuple(r) for r in frame.collect()] == [(True, "SLR-1-2050", "gdp"), (True, "SLR-1-2050", "gdp_loading"), (False, "SLR-1-2050", "freight_LOADING"), (False, "COMBINED", ""), (True, "freight", ""), (False, None, None)]
    assert ClusterSettings.of(None) == ClusterSettings() and ClusterSettings.of({"minimum_samples": 10, "export_formats": []}).minimum_samples == 10
    assert (CLUSTERS.cluster_epsilon_multiplier * CLUSTERS.cell_size_meters, CLUSTERS.minimum_samples) == (180.0, 10)


def test_features_of_clusters_in_parts_and_with_holes(spark):
    block = [(r, c) for r in range(3) for c in range(3) if (r, c) != (1, 1)]
    rows = [("b", r, c, 0) for r, c in block] + [("b", 6, 6, 0), ("a", 2, 1, 0), ("b", 9, 0, 1)]
    found = spark.createDataFrame(rows, "file string, row int, col int, risk_cluster_id int")
    got = {(r.file, r.risk_cluster_id): json.loads(r.feature) for r in clusterfiles.features(found, 100.0, 200.0, 10.0, 10, 4).collect()}
    assert {k: (v["geometry"]["type"], v["properties"]) for k, v in got.items()} == {k: (t, {"file": k[0], "risk_cluster_id": k[1]}) for k, t in ((("b", 0), "MultiPolygon"), (("a", 0), "Polygon"), (("b", 1), "Polygon"))}
    assert [len(p) for p in got["b", 0]["geometry"]["coordinates"]] == [2, 1]
    ring = got["a", 0]["geometry"]["coordinates"][0]
    assert ring[0] == ring[-1] and sorted(map(tuple, ring[1:])) == [(110.0, 170.0), (110.0, 180.0), (120.0, 170.0), (120.0, 180.0)]
