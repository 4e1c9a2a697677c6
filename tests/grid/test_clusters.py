import math
import random

from cellward.operators import clusters


def groups(cells, diagonal):
    cells, out = set(cells), {}
    steps = [(0, 1), (1, 0), (0, -1), (-1, 0)] + ([(1, 1), (1, -1), (-1, 1), (-1, -1)] if diagonal else [])
    for start in sorted(cells):
        if start in out:
            continue
        todo, out[start] = [start], start
        while todo:
            r, c = todo.pop()
            for dr, dc in steps:
                n = (r + dr, c + dc)
                if n in cells and n not in out:
                    out[n] = start
                    todo.append(n)
    return out


def test_connected_cells(spark):
    rng = random.Random(2)
    cells = [(r, c) for r in range(20) for c in range(20) if rng.random() < 0.55]
    frame = spark.createDataFrame(cells, "row int, col int")
    for diagonal in (False, True):
        got = {(r.row, r.col): (r.cluster >> 32, r.cluster & 0xFFFFFFFF) for r in clusters.connected_cells(frame, diagonal, tile=7).collect()}
        assert got == groups(cells, diagonal)


def plain_dbscan(points, eps, least):
    near = {i: [j for j, a, b in points if math.sqrt((a - x) ** 2 + (b - y) ** 2) <= eps] for i, x, y in points}
    core = {i for i in near if len(near[i]) >= least}
    label = {}
    for i in sorted(core):
        if i not in label:
            todo, label[i] = [i], i
            while todo:
                for j in near[todo.pop()]:
                    if j in core and j not in label:
                        label[j] = i
                        todo.append(j)
    return {i: label.get(i) if i in core else next((label[j] for j in sorted(near[i]) if j in core), None) for i in near}


def found_dbscan(spark, points, eps, least):
    return {r.id: r.cluster for r in clusters.dbscan(spark.createDataFrame(points, "id long, x double, y double"), eps, least).collect()}


def test_dbscan(spark):
    rng = random.Random(3)
    points = [(i, rng.gauss(c, 0.1), rng.gauss(-c, 0.1)) for i, c in enumerate([0] * 12 + [1] * 12)] + [(30, 5.0, 5.0), (31, 0.5, -0.5)]
    assert found_dbscan(spark, points, 0.15, 4) == plain_dbscan(points, 0.15, 4)


def test_dbscan_of_spread_points_and_raster_cells(spark):
    rng = random.Random(4)
    spread = [(i, rng.random() * 6, rng.random() * 6) for i in range(250)]
    cells = [(i, 30.0 * (i % 25), 30.0 * (i // 25)) for i in rng.sample(range(625), 260)]
    assert found_dbscan(spark, spread, 0.5, 4) == plain_dbscan(spread, 0.5, 4)
    assert found_dbscan(spark, cells, 45.0, 5) == plain_dbscan(cells, 45.0, 5)


def test_dbscan_with_a_hot_place_and_cells_joined_by_inner_points(spark, monkeypatch):
    """A spot of many copies is parted; arcs that bend away meet at points that are none of the outermost eight."""
    monkeypatch.setattr(clusters, "PIECE", 16)
    hot = [(i, 0.001 * (i % 7), 0.0) for i in range(300)]
    arc = [(1000 + i, 3 + 0.3 * math.cos(a), 0.3 * math.sin(a)) for i, a in enumerate(k * 0.04 for k in range(-20, 21))]
    other = [(2000 + i, 4.3 - 0.3 * math.cos(a), 0.3 * math.sin(a) + 0.11) for i, a in enumerate(k * 0.04 for k in range(-20, 21))]
    odd = [(3000, float("nan"), 0.0), (3001, None, 0.0), (3002, 0.9, 0.0)]
    points = hot + arc + other + odd
    for eps in (0.699, 0.71):
        want = {**plain_dbscan([p for p in points if p[0] not in (3000, 3001)], eps, 6), 3000: None, 3001: None}
        assert found_dbscan(spark, points, eps, 6) == want
    assert clusters.dbscan(spark.createDataFrame([], "id long, x double, y double"), 1.0, 3).count() == 0
