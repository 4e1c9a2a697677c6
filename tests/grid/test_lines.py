"""Lines and rings against plain loops."""

import math
import random

import numpy as np
import pytest

from cellward.operators import lines, outlines

KIND = "id long, ring array<struct<x: double, y: double>>"


def area(ring):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, [*ring[1:], ring[0]])) / 2


def peucker(line, tolerance):
    """By recursion, as the method is usually written."""
    if len(line) < 3:
        return line
    (ax, ay), (bx, by) = line[0], line[-1]
    size = (bx - ax) ** 2 + (by - ay) ** 2

    def gap(p):
        t = max(0, min(1, ((p[0] - ax) * (bx - ax) + (p[1] - ay) * (by - ay)) / size)) if size else 0
        return math.hypot(p[0] - ax - t * (bx - ax), p[1] - ay - t * (by - ay))

    far = max(range(1, len(line) - 1), key=lambda k: gap(line[k]))
    if gap(line[far]) <= tolerance:
        return [line[0], line[-1]]
    return peucker(line[: far + 1], tolerance)[:-1] + peucker(line[far:], tolerance)


def test_weights_are_the_tolerances_at_which_points_go():
    draw = random.Random(3)
    for closed in (False, True):
        line = [(draw.random() * 9, draw.random() * 9) for _ in range(60)]
        line = [*line, line[0]] if closed else line
        w = lines.weights(np.array(line))
        for tolerance in (0.0, 0.5, 1.0, 2.0, 4.0, 20.0):
            assert [p for p, x in zip(line, w) if x > tolerance] == peucker(line, tolerance)
    assert len(lines.weights(np.array([(k, (k * k * 7919) % 10007) for k in range(20_000)], float))) == 20_000  # no recursion


def zones(spark, n=18, seed=5):
    draw = random.Random(seed)
    seeds = [(draw.random() * n, draw.random() * n, k) for k in range(7)]
    cells = [(r, c, min(seeds, key=lambda s: (s[0] - r) ** 2 + (s[1] - c) ** 2)[2]) for r in range(n) for c in range(n)]
    found = outlines.ring_pieces(outlines.regions(spark.createDataFrame(cells, "row int, col int, label int"), 8), 8)
    return [(r.region, [(p.x, p.y) for p in r.outer]) for r in outlines.polygons(found).collect()]


def frame(spark, rings):
    return spark.createDataFrame([(k, [{"x": float(x), "y": float(y)} for x, y in ring]) for k, ring in rings], KIND)


def test_neighbours_keep_one_border_within_the_budget(spark):
    rings = zones(spark)
    df = frame(spark, rings)
    nodes = {r.id: [(p.x, p.y) for p in r.ring] for r in lines.noded(df, 4.0).collect()}
    assert all(area(nodes[k]) == area(ring) for k, ring in rings)
    got = lines.simplified(df, 0.8, 9, 4.0, coarsest=3.0).collect()
    out = {r.id: [(p.x, p.y) for p in r.ring] for r in got}
    with pytest.raises(ValueError, match="positive"):
        lines.simplified(df, 0.0, 9, 4.0)
    directed = [(a, b) for ring in out.values() for a, b in zip(ring, [*ring[1:], ring[0]])]
    assert len(directed) == len(set(directed))
    rim = [(a, b) for a, b in directed if (b, a) not in set(directed)]  # all others have their counterpart
    assert all(0 in (a[0], a[1]) or 18 in (a[0], a[1]) for edge in rim for a in edge)
    for r in got:
        assert len(out[r.id]) >= 3 and set(out[r.id]) <= set(nodes[r.id])
        assert len(out[r.id]) <= 9 or r.tolerance >= 3.0
    assert any(len(out[k]) < len(ring) for k, ring in rings)
    fine = {r.id: [(p.x, p.y) for p in r.ring] for r in lines.simplified(df, 1e-6, 10**6, 4.0).collect()}
    for k, ring in rings:
        assert area(fine[k]) == area(ring)


def test_single_rings_follow_the_plain_method(spark):
    draw = random.Random(1)
    ring = [(10 * math.cos(a) * (1 + draw.random() / 5), 10 * math.sin(a) * (1 + draw.random() / 5)) for a in np.linspace(0, 2 * math.pi, 80, endpoint=False)]
    start = min(range(80), key=lambda k: (ring[k][1], ring[k][0]))
    line = [*ring[start:], *ring[: start + 1]]
    want = peucker(min(line, line[::-1]), 0.9)
    got = lines.simplified(frame(spark, [(1, ring)]), 0.9, 500, 5.0).first()
    assert sorted((p.x, p.y) for p in got.ring) == sorted(want[:-1]) and got.tolerance == 0.9
    small = lines.simplified(frame(spark, [(1, ring), (2, [(50, 50), (51, 50), (51, 51)])]), 5.0, 500, 5.0, coarsest=5.0).collect()
    assert {r.id: len(r.ring) for r in small}[2] == 3


def test_dissolving_leaves_the_outlines(spark):
    rings = zones(spark, 14, 9)
    df = frame(spark, rings).withColumn("part", lines.F.col("id") % 2 * 0)
    got = lines.dissolved(df, "part", 4.0).collect()
    assert sum(r.area for r in got) == 14 * 14 and len(got) == 1
    # a frame of four rectangles with a hole, and a square that only touches it in a corner
    parts = [(1, [(0, 0), (9, 0), (9, 2), (0, 2)]), (2, [(0, 7), (9, 7), (9, 9), (0, 9)]), (3, [(0, 2), (2, 2), (2, 7), (0, 7)]), (4, [(7, 2), (9, 2), (9, 7), (7, 7)]), (5, [(9, 9), (11, 9), (11, 11), (9, 11)])]
    df = frame(spark, parts).withColumn("part", lines.F.lit("x"))
    assert sorted(r.area for r in lines.dissolved(df, "part", 3.0).collect()) == [-25.0, 4.0, 81.0]


def test_faults_and_crossings(spark):
    rings = [(1, [(0, 0), (4, 0), (4, 4), (0, 4)]), (2, [(10, 0), (14, 4), (14, 0), (10, 4)]), (3, [(1, 1), (2, 2)]), (4, [(0, 0), (2, 2), (4, 4)]), (5, [(1, 1), (3, 1), (3, 3), (1, 3)]), (6, [(3, -1), (6, -1), (6, 2), (3, 2)])]
    df = frame(spark, rings)
    for tile in (1.5, 100.0):
        assert {(r.id, r.problem) for r in lines.faults(df, tile).collect()} == {(2, "crosses itself"), (3, "too few points"), (4, "no area")}
        met = {(r.id, r.other) for r in lines.crossings(df, tile).collect()}
        assert met == {(1, 6), (2, 2)}  # 5 lies in 1, and 6 touches 5 and the line 4 at most
