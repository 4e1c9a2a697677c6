"""Rings as tables of segments: noding, simplification with one border between neighbours, dissolving, validity.

A ring is array<struct<x, y>> without its first point repeated.  Segments and points meet by tiles, as shapes and cells
do elsewhere: a segment is exploded to the tiles that its box touches, and only equal tiles are joined.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellward.operators.outlines import string_rings
from cellward.sources.storage import cut

POINT = "struct<x: double, y: double>"
#: Metres of a degree for tolerances, the factor between tolerances, and the largest one, in degrees.
METRES, GROWTH, COARSEST = 111_000, 1.5, 0.01


def segments(rings: DataFrame, key: str = "id", ring: str = "ring") -> DataFrame:
    """(key, k, a, b): the k-th segment of each ring, from point a to point b; points that repeat the one before are passed over."""
    following = F.expr(f"concat(slice({ring}, 2, size({ring})), slice({ring}, 1, 1))")
    pairs = F.zip_with(ring, following, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return rings.select(key, F.posexplode(pairs).alias("k", "s")).select(key, "k", F.col("s.a").alias("a"), F.col("s.b").alias("b")).where("a.x <> b.x or a.y <> b.y")


def _tiles(df: DataFrame, tile: float) -> DataFrame:
    span = lambda c: F.explode(F.sequence(F.floor(F.least(f"a.{c}", f"b.{c}") / tile), F.floor(F.greatest(f"a.{c}", f"b.{c}") / tile)))
    return df.withColumn("tx", span("x")).withColumn("ty", span("y"))


def noded(rings: DataFrame, tile: float, key: str = "id", ring: str = "ring") -> DataFrame:
    """(key, ring) with a point wherever a point of any ring lies on one of its segments, so that rings that touch share points."""
    seg = cut(segments(rings, key, ring))
    points = seg.select(F.col("a").alias("p")).distinct().select("p", F.floor(F.col("p.x") / tile).alias("tx"), F.floor(F.col("p.y") / tile).alias("ty"))
    on = "(b.x - a.x) * (p.y - a.y) = (b.y - a.y) * (p.x - a.x) and (p.x - a.x) * (p.x - b.x) + (p.y - a.y) * (p.y - b.y) < 0"
    hit = _tiles(seg, tile).join(points, ["tx", "ty"]).where(on).select(key, "k", F.struct(F.expr("abs(p.x - a.x) + abs(p.y - a.y)").alias("way"), "p").alias("h"))
    more = hit.groupBy(key, "k").agg(F.array_sort(F.collect_set("h")).alias("more"))
    full = seg.join(more, [key, "k"], "left").select(key, F.struct("k", F.concat(F.array("a"), F.coalesce(F.transform("more", lambda h: h["p"]), F.expr(f"cast(array() as array<{POINT}>)"))).alias("points")).alias("part"))
    return full.groupBy(key).agg(F.array_sort(F.collect_list("part")).alias("parts")).select(key, F.flatten(F.col("parts.points")).alias(ring))


def weights(line: np.ndarray) -> np.ndarray:
    """For each point of a line the tolerance from which on Douglas and Peucker drop it: the least gap of its own and all enclosing splits.

    Lines are split at the point that is farthest from the segment between the ends (the first of several), with a stack in
    place of recursion.  The ends have infinite weight.  A closed line has equal ends, and gaps are distances from that point.
    """
    out = np.full(len(line), np.inf)
    stack = [(0, len(line) - 1, np.inf)]
    while stack:
        a, b, above = stack.pop()
        if b - a < 2:
            continue
        along, mid = line[b] - line[a], line[a + 1 : b] - line[a]
        size = along @ along
        t = np.clip(mid @ along / size, 0, 1)[:, None] if size else 0.0
        gap = np.sqrt(((mid - t * along) ** 2).sum(1))
        k = int(gap.argmax())
        out[a + 1 + k] = least = min(above, float(gap[k]))
        stack += [(a, a + 1 + k, least), (a + 1 + k, b, least)]
    return out


def _weigh(batches):
    for frame in batches:
        frame["weights"] = [weights(np.array([(p["x"], p["y"]) for p in line])).tolist() for line in frame["line"]]
        yield frame


def arcs(rings: DataFrame, key: str = "id", ring: str = "ring") -> DataFrame:
    """(key, arc, line, turned): noded rings cut at their junctions, points with other than two different neighbours in all rings.

    A line runs in its own direction or back (``turned``), whichever is smaller, so neighbours have the same line.  A ring without
    junctions is one line from its smallest point back to it.
    """
    seg = cut(segments(rings, key, ring))
    ends = seg.select(F.col("a").alias("p"), F.col("b").alias("q")).union(seg.select(F.col("b").alias("p"), F.col("a").alias("q"))).distinct()
    junctions = ends.groupBy("p").agg(F.count(F.lit(1)).alias("n")).where("n <> 2").select(F.col("p").alias("a"), F.lit(1).alias("cut"))
    marked = seg.join(junctions, "a", "left")
    whole = marked.groupBy(key).agg(F.max("cut").alias("any"), F.min_by("k", F.struct("a.y", "a.x")).alias("least"))
    marked = marked.join(whole, key).withColumn("cut", F.when(F.col("any").isNull(), (F.col("k") == F.col("least")).cast("int")).otherwise(F.coalesce("cut", F.lit(0))))
    along = Window.partitionBy(key).orderBy("k")
    marked = marked.withColumn("arc", F.sum("cut").over(along)).withColumn("arc", F.when(F.col("arc") == 0, F.max("arc").over(Window.partitionBy(key))).otherwise(F.col("arc")))
    # the points before the first cut belong behind those of the last line
    late = F.struct((F.sum("cut").over(along) == 0).alias("wrapped"), "k", "a", "b")
    lines = marked.select(key, "arc", late.alias("s")).groupBy(key, "arc").agg(F.array_sort(F.collect_list("s")).alias("s"))
    line = F.concat(F.col("s.a"), F.array(F.element_at("s", -1)["b"]))
    back = F.reverse(F.col("line"))
    return lines.select(key, "arc", line.alias("line")).select(key, "arc", F.least("line", back).alias("line"), (back < F.col("line")).alias("turned"))


def simplified(rings: DataFrame, tolerance: float, most: int, tile: float, key: str = "id", ring: str = "ring", growth: float = GROWTH, coarsest: float = COARSEST) -> DataFrame:
    """(key, ring, tolerance) of rings that keep one border between neighbours.

    Rings are noded and cut into lines at junctions, and each line is weighed once.  Tolerances grow by ``growth`` until a ring has
    at most ``most`` points or the tolerance has reached ``coarsest``; a line takes the coarsest tolerance of the rings that it
    belongs to, so both sides stay equal and no ring has more points than its own tolerance leaves.  A ring's three
    heaviest points always stay.  The column ``tolerance`` is the ring's own.
    """
    if tolerance <= 0 or growth <= 1:
        raise ValueError("tolerances must be positive and grow")
    steps = [tolerance]
    while steps[-1] < coarsest:
        steps.append(steps[-1] * growth)
    parts = cut(arcs(noded(rings, tile, key, ring), key, ring).withColumn("name", F.sha2(F.to_json("line"), 256)))
    weighed = cut(parts.groupBy("name").agg(F.any_value("line").alias("line")).mapInPandas(_weigh, f"name string, line array<{POINT}>, weights array<double>"))
    # a line's last point is the next line's first one
    inner = parts.select(key, "name").join(weighed.select("name", "weights"), "name").select(key, "name", F.posexplode(F.slice("weights", F.lit(1), F.size("weights") - 1)).alias("i", "w"))
    inner = cut(inner)
    left = [F.count_if(F.col("w") > step).alias(f"n{k}") for k, step in enumerate(steps)]
    fits = F.coalesce(*(F.when(F.col(f"n{k}") <= most, F.lit(k)) for k in range(len(steps) - 1)), F.lit(len(steps) - 1))
    level = cut(inner.groupBy(key).agg(*left).select(key, fits.alias("level")))
    coarse = parts.select(key, "name").join(level, key).groupBy("name").agg(F.max("level").alias("level"))
    heavy = inner.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("w"), "name", "i"))).where("place <= 3").groupBy("name").agg(F.collect_set("i").alias("anchors"))
    limits = F.array(*map(F.lit, steps))
    thin = weighed.join(coarse, "name").join(heavy, "name", "left").withColumn("limit", F.element_at(limits, F.col("level") + 1))
    keep = "filter(transform(line, (p, i) -> if(weights[i] > limit or coalesce(array_contains(anchors, i), false), p, null)), p -> p is not null)"
    thin = thin.select("name", F.expr(keep).alias("line"))
    own = parts.select(key, "arc", "name", "turned").join(thin, "name").withColumn("line", F.when(F.col("turned"), F.reverse("line")).otherwise(F.col("line")))
    body = own.select(key, F.struct("arc", F.expr("slice(line, 1, size(line) - 1)").alias("line")).alias("part"))
    out = body.groupBy(key).agg(F.array_sort(F.collect_list("part")).alias("parts")).join(level, key)
    return out.select(key, F.flatten(F.col("parts.line")).alias(ring), F.element_at(limits, F.col("level") + 1).alias("tolerance"))


def _angle(dx: Column, dy: Column) -> Column:
    return F.atan2(dy, dx)


def dissolved(rings: DataFrame, group: str, tile: float, key: str = "id", ring: str = "ring") -> DataFrame:
    """Q-C11: (group, ring_id, area, n): the outlines of each group's touching rings without their inner borders.

    Rings of one group run the same way round and don't overlap.  After noding, a segment that the group also has in the other
    direction is an inner border and goes.  Where several segments go on from a point, the one with the sharpest turn to the side
    on which the shape lies is next, so shapes that meet in a point stay apart.  Segments are strung to rings by pointer jumping.
    """
    sides = noded(rings, tile, key, ring).join(rings.select(key, group), key)
    seg = segments(sides, key, ring).join(sides.select(key, group), key).select(group, "a", "b")
    both = seg.select(group, F.least("a", "b").alias("p"), F.greatest("a", "b").alias("q"), (F.col("a") < F.col("b")).alias("forth"))
    once = both.groupBy(group, "p", "q").agg(F.count(F.lit(1)).alias("n"), F.max("forth").alias("forth")).where("n = 1")
    edge = cut(once.select(group, F.when(F.col("forth"), F.col("p")).otherwise(F.col("q")).alias("a"), F.when(F.col("forth"), F.col("q")).otherwise(F.col("p")).alias("b")).withColumn("piece", F.monotonically_increasing_id()))
    on = edge.select(group, F.col("a").alias("b"), F.col("b").alias("c"), F.col("piece").alias("next"))
    way = F.pmod(_angle(F.col("c.x") - F.col("b.x"), F.col("c.y") - F.col("b.y")) - _angle(F.col("a.x") - F.col("b.x"), F.col("a.y") - F.col("b.y")), F.lit(2 * math.pi))
    # the shape lies on the left of rings with positive area: the next segment is the last one met turning left from where we came
    step = edge.join(on, [group, "b"]).groupBy(group, "piece").agg(F.max_by("next", way).alias("next"), F.any_value("a").alias("a"), F.any_value("b").alias("b"))
    parts = step.select(F.col(group).alias("region"), "piece", "next", F.col("piece").alias("least"), F.lit(1).cast("long").alias("n"), F.array("a").alias("points"))
    found = cut(string_rings(cut(parts)))
    area = found.join(step.select("piece", "a", "b"), "piece").groupBy(F.col("region").alias(group), F.col("ring").alias("ring_id"))
    return area.agg((F.sum(F.expr("a.x * b.y - b.x * a.y")) / 2).alias("area"), F.count(F.lit(1)).alias("n"))


def crossings(rings: DataFrame, tile: float, key: str = "id", ring: str = "ring", own: bool = False) -> DataFrame:
    """(key, other, k, m): segments that properly cross, of one ring or of two (key <= other), each pair once; with ``own`` of one ring only."""
    seg = cut(_tiles(segments(rings, key, ring), tile))
    one, two = (seg.select(*([key] if own else []), "tx", "ty", *(F.col(c).alias(f"{c}{n}") for c in ("k", "a", "b")), F.col(key).alias(f"__{n}")) for n in (1, 2))
    side = lambda p, q, r: f"sign(({q}.x - {p}.x) * ({r}.y - {p}.y) - ({q}.y - {p}.y) * ({r}.x - {p}.x))"
    cross = f"{side('a1', 'b1', 'a2')} * {side('a1', 'b1', 'b2')} < 0 and {side('a2', 'b2', 'a1')} * {side('a2', 'b2', 'b1')} < 0"
    met = one.join(two, [*([key] if own else []), "tx", "ty"]).where(f"(__1 < __2 or (__1 = __2 and k1 < k2)) and {cross}")
    return met.select(F.col("__1").alias(key), F.col("__2").alias("other"), F.col("k1").alias("k"), F.col("k2").alias("m")).distinct()


def faults(rings: DataFrame, tile: float, key: str = "id", ring: str = "ring") -> DataFrame:
    """(key, problem) of rings that are no simple polygons: segments that cross, too few points, or no area.  A ring may touch itself in a point."""
    shape = rings.select(key, F.size(F.array_distinct(ring)).alias("n"), F.expr(f"aggregate(zip_with({ring}, concat(slice({ring}, 2, size({ring})), slice({ring}, 1, 1)), (a, b) -> a.x * b.y - b.x * a.y), 0D, (s, v) -> s + v)").alias("doubled"))
    plain = shape.select(key, F.when(F.coalesce("n", F.lit(0)) < 3, "too few points").when(F.col("doubled") == 0, "no area").alias("problem")).where("problem is not null")
    crossed = cut(crossings(rings, tile, key, ring, own=True).select(key, F.lit("crosses itself").alias("problem")).distinct())
    return crossed.union(plain.join(crossed.select(key), key, "left_anti"))
