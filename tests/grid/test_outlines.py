"""Rings, hulls and filled holes against plain counts over cells."""

import random

import pytest

from cellward.operators import outlines


def flood(cells, start, steps=((0, 1), (1, 0), (0, -1), (-1, 0))):
    todo, seen = [start], {start}
    while todo:
        r, c = todo.pop()
        for dr, dc in steps:
            n = (r + dr, c + dc)
            if n in cells and n not in seen:
                seen.add(n)
                todo.append(n)
    return seen


def components(cells, steps=((0, 1), (1, 0), (0, -1), (-1, 0))):
    left, out = set(cells), []
    while left:
        part = flood(left, min(left), steps)
        out.append(part)
        left -= part
    return out


ALL = tuple((r, c) for r in (-1, 0, 1) for c in (-1, 0, 1) if r or c)


def holes_of(part):
    """Groups of other cells (touching by corners, too) that the part encloses."""
    rows, cols = [r for r, _ in part], [c for _, c in part]
    box = {(r, c) for r in range(min(rows) - 1, max(rows) + 2) for c in range(min(cols) - 1, max(cols) + 2)} - part
    outside = flood(box, (min(rows) - 1, min(cols) - 1), ALL)
    return components(box - outside, ALL)


def random_cells(seed, n=22, share=0.6):
    draw = random.Random(seed)
    return {(r, c) for r in range(n) for c in range(n) if draw.random() < share} | {(r, c) for r in (30, 34) for c in range(30, 45)} | {(r, c) for r in range(30, 35) for c in (30, 44)}


def area(ring):
    return sum(a["x"] * b["y"] - b["x"] * a["y"] for a, b in zip(ring, [*ring[1:], ring[0]])) / 2


def frame(spark, cells):
    return spark.createDataFrame([(r, c, 0) for r, c in cells], "row int, col int, label int")


def test_rings_enclose_their_cells_whatever_the_tile(spark):
    cells = random_cells(1)
    want = {min(p)[0] << 32 | min(p)[1]: p for p in components(cells)}
    seen = []
    for tile in (5, 64):
        own = outlines.regions(frame(spark, cells), tile).cache()
        assert {(r.row, r.col): r.region for r in own.collect()} == {cell: k for k, p in want.items() for cell in p}
        found = outlines.ring_pieces(own, tile).cache()
        rings = outlines.rings(found).collect()
        assert all(r.closed for r in rings)
        for k, part in want.items():
            mine = [r for r in rings if r.region == k]
            holes = holes_of(part)
            assert sum(r.area for r in mine) == len(part)
            assert sorted(-r.area for r in mine if r.area < 0) == sorted(map(len, holes)) and sum(r.area > 0 for r in mine) == 1
            edges = sum((r + dr, c + dc) not in part for r, c in part for dr, dc in ((0, 1), (1, 0), (0, -1), (-1, 0)))
            assert sum(r.length for r in mine) == edges
        polygons = {r.region: (r.outer, r.holes) for r in outlines.polygons(found).collect()}
        for k, part in want.items():
            assert area(polygons[k][0]) + sum(map(area, polygons[k][1])) == len(part)
            for ring in (polygons[k][0], *polygons[k][1]):
                assert all((a["x"] == b["x"]) != (a["y"] == b["y"]) for a, b in zip(ring, [*ring[1:], ring[0]]))
        seen.append((polygons, sorted((r.region, r.ring, r.area, r.length) for r in rings)))
    assert seen[0] == seen[1]


def test_middles_cut_corners_as_marching_squares_do(spark):
    cells = random_cells(3, 12)
    own = outlines.regions(frame(spark, cells), 5)
    found = outlines.ring_pieces(own, 5, middles=True)
    got = {r.region: r.area for r in outlines.rings(found).groupBy("region").agg({"area": "sum"}).withColumnRenamed("sum(area)", "area").collect()}
    for part in components(cells):
        total = 0.0
        for r, c in {(r + a, c + b) for r, c in part for a in (-1, 0) for b in (-1, 0)}:
            corners = [(r, c) in part, (r, c + 1) in part, (r + 1, c + 1) in part, (r + 1, c) in part]
            n = sum(corners)
            total += {0: 0, 1: 1 / 8, 2: 1 / 2, 3: 7 / 8, 4: 1}[n] if n != 2 or corners[0] == corners[1] or corners[1] == corners[2] else 1 / 4
        assert got[min(part)[0] << 32 | min(part)[1]] == pytest.approx(total)


def test_labels_part_regions(spark):
    rows = [(r, c, (c // 3 + r // 4) % 2) for r in range(9) for c in range(9)] + [(0, 0, 1), (20, 20, None)]
    own = outlines.regions(spark.createDataFrame(rows, "row int, col int, label int"), 4)
    got = {(r.row, r.col): r.region for r in own.collect()}
    label = {(r, c): (c // 3 + r // 4) % 2 for r in range(9) for c in range(9)}
    want = {cell: min(p)[0] << 32 | min(p)[1] for v in (0, 1) for p in components({k for k, x in label.items() if x == v}) for cell in p}
    assert got == want
    rings = outlines.rings(outlines.ring_pieces(own, 4)).collect()
    assert sum(r.area for r in rings) == 81 and all(r.closed for r in rings)


def test_holes_are_filled_by_their_share(spark):
    block = {(r, c) for r in range(30) for c in range(30)}
    small, large = {(3, 3), (4, 4)}, {(r, c) for r in range(10, 26) for c in range(10, 26)}
    island = {(r, c) for r in range(14, 20) for c in range(14, 20)}
    pit = {(16, 16)}
    cells = block - small - large | island - pit
    for threshold, want in ((0.1, [block - large, island]), (0.9, [block])):
        got = outlines.fill_holes(frame(spark, cells), threshold, 30.0, tile=7).collect()
        assert components({(r.row, r.col) for r in got}) == components(set().union(*want)) and len({r.region for r in got}) == len(want)
    big = outlines.fill_holes(frame(spark, cells), 0.001, 3000.0, tile=16)  # without the scale, two of 642 cells were too many
    assert {(r.row, r.col) for r in big.collect()} == cells | small


def test_finished_clusters(spark):
    cells = {(r, c) for r in range(6) for c in range(6)} - {(2, 2)} | {(9, 9)} | {(9, c) for c in range(20, 28)}
    got = outlines.finalised(frame(spark, cells), 0.5, 5 * 900.0, 30.0, tile=4).collect()
    assert {(r.risk_cluster_id, r.area) for r in got} == {(0, 36 * 900.0), (1, 8 * 900.0)} and len(got) == 44
    none = spark.createDataFrame([], "row int, col int, label int")
    assert outlines.finalised(none).count() == 0 and outlines.polygons(outlines.ring_pieces(outlines.regions(none))).count() == 0


def test_hulls(spark):
    draw = random.Random(8)
    groups = {k: [(draw.randrange(-9, 10) * 1.0, draw.randrange(-9, 10) * 1.0) for _ in range(n)] for k, n in enumerate((400, 60, 12, 1))}
    groups[7] = [(float(k), 2.0 * k) for k in range(9)] * 2
    rows = [(k, x, y) for k, points in groups.items() for x, y in points] + [(1, None, 3.0)]
    got = {r.k: [(p.x, p.y) for p in r.hull] for r in outlines.convex_hulls(spark.createDataFrame(rows, "k int, x double, y double"), "k", fold=4, tile=3.0).collect()}
    cross = lambda a, b, p: (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])
    for k, points in groups.items():
        hull = got[k]
        assert set(hull) <= set(points) and len(hull) == len(set(hull)) and hull[0] == min(points)
        if len(hull) > 2:
            assert all(cross(hull[i - 2], hull[i - 1], hull[i]) > 0 for i in range(len(hull)))
        assert all(cross(hull[i - 1], hull[i], p) >= 0 for i in range(len(hull)) for p in points) or len(hull) == 1
    assert got[7] == [(0.0, 0.0), (8.0, 16.0)] and len(got[3]) == 1
