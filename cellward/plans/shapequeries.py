"""Queries on outlines, hulls, projections, overlaps and lines, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellward.functions import crs, risk
from cellward.operators import clusterfiles, lines, outlines, resample, spatial, tabular, web
from cellward.plans.config import ClusterSettings, GridSpec
from cellward.plans.gridqueries import CELLS, COLS, cells, height, order_rings
from cellward.sources.storage import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query, and the SQL that checks it if there is any."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


#: Edge-connected parts of the cells of hot(row, col, id), named by their first cell.
_LAB = """e AS (SELECT a.id, b.id AS other FROM hot a JOIN hot b ON abs(a.row - b.row) + abs(a.col - b.col) = 1 AND b.row BETWEEN a.row - 1 AND a.row + 1),
reach(id, root) AS (SELECT id, id FROM hot UNION SELECT e.other, reach.root FROM reach JOIN e ON e.id = reach.id),
lab AS (SELECT hot.*, region FROM hot JOIN (SELECT id, min(root) AS region FROM reach GROUP BY 1) USING (id))"""
_HOT = f"""{CELLS}, hot AS (SELECT row, col, row::BIGINT * 4294967296 + col AS id FROM cells WHERE e > 3500),
{_LAB}"""


def _hot(spark, d):
    return cells(spark, d).where("e > 3500").select("row", "col", F.lit(0).alias("label"))


@query(f"""WITH RECURSIVE {_HOT}, n AS (SELECT region, count(*) AS n FROM lab GROUP BY 1),
p AS (SELECT a.region, count(*) AS p FROM lab a JOIN hot b ON (b.row = a.row AND b.col = a.col + 1) OR (b.row = a.row + 1 AND b.col = a.col) GROUP BY 1),
q AS (SELECT a.region, count(*) AS q FROM lab a JOIN hot b ON b.row = a.row AND b.col = a.col + 1 JOIN hot c ON c.row = a.row + 1 AND c.col = a.col JOIN hot x ON x.row = a.row + 1 AND x.col = a.col + 1 GROUP BY 1)
SELECT region, n * 900.0::DOUBLE AS area, (4 * n - 2 * coalesce(p, 0)) * 30.0::DOUBLE AS length, 1 - (n - coalesce(p, 0) + coalesce(q, 0)) AS n_holes, true AS closed FROM n LEFT JOIN p USING (region) LEFT JOIN q USING (region)""")
def cluster_outlines(spark, d):
    """Outlines of the clusters over the threshold; the SQL counts cells, neighbours and blocks of four (Euler)."""
    found = outlines.ring_pieces(outlines.regions(_hot(spark, d), 32), 32)
    return outlines.rings(found, 30.0).groupBy("region").agg(F.sum("area").alias("area"), F.sum("length").alias("length"), F.count_if(F.col("area") < 0).alias("n_holes"), F.bool_and("closed").alias("closed"))


#: Tree of the parts and the holes in them, and the parts (row, col, region) with small holes filled.
_FILL = """k AS (SELECT a AS dr, b AS dc FROM range(-1, 2) s(a), range(-1, 2) t(b)), box AS (SELECT max(row) + 1 AS bottom FROM cells),
bg AS (SELECT r AS row, c AS col, (r + 2) * 4294967296::BIGINT + c + 2 AS id FROM box, range(-1, 101) t(c), LATERAL (SELECT unnest(range(-1, bottom + 1)) AS r) a WHERE NOT EXISTS (SELECT 1 FROM hot WHERE hot.row = r AND hot.col = c)),
be AS (SELECT a.id, b.id AS other FROM bg a CROSS JOIN k JOIN bg b ON b.row = a.row + dr AND b.col = a.col + dc WHERE a.id <> b.id),
open(id) AS (SELECT min(id) FROM bg UNION SELECT be.other FROM open JOIN be ON be.id = open.id),
br(id, root) AS (SELECT id, id FROM bg WHERE id NOT IN (SELECT id FROM open) UNION SELECT be.other, br.root FROM br JOIN be ON be.id = br.id),
bl AS (SELECT bg.*, root AS hole FROM bg JOIN (SELECT id, min(root) AS root FROM br GROUP BY 1) USING (id)),
node AS (SELECT 'r' AS kind, region AS id, count(*) AS n, min(id) AS first FROM lab GROUP BY 2 UNION ALL SELECT 'h', hole, count(*), min(id) FROM bl GROUP BY 2),
up AS (SELECT node.kind, node.id, 'h' AS pk, o.hole AS pid FROM node JOIN lab f ON f.id = node.first JOIN bl o ON o.row = f.row - 1 AND o.col = f.col WHERE kind = 'r'
 UNION ALL SELECT node.kind, node.id, 'r', o.region FROM node JOIN bl f ON f.id = node.first JOIN lab o ON o.row = f.row - 1 AND o.col = f.col WHERE kind = 'h'),
anc(kind, id, ak, aid, depth) AS (SELECT kind, id, kind, id, 0 FROM node UNION ALL SELECT anc.kind, anc.id, pk, pid, depth + 1 FROM anc JOIN up ON up.kind = ak AND up.id = aid),
inside AS (SELECT ak, aid, sum(n) AS n FROM anc JOIN node USING (kind, id) GROUP BY 1, 2),
net AS (SELECT i.aid AS region, i.n - coalesce(sum(j.n), 0) AS own FROM inside i LEFT JOIN up ON up.pk = 'r' AND up.pid = i.aid LEFT JOIN inside j ON j.ak = 'h' AND j.aid = up.id WHERE i.ak = 'r' GROUP BY 1, i.n),
filled AS (SELECT up.id AS hole, up.pid AS region FROM up JOIN inside ON ak = 'h' AND aid = up.id JOIN net ON net.region = up.pid WHERE up.kind = 'h' AND inside.n / own::DOUBLE < 0.1 * sqrt(greatest(1.0, sqrt(own * 900.0) / 1000))),
outer_ AS (SELECT anc.kind, anc.id, arg_max(filled.region, depth) AS region FROM anc JOIN filled ON ak = 'h' AND aid = filled.hole GROUP BY 1, 2),
done AS (SELECT row, col, coalesce(o.region, lab.region) AS region FROM lab LEFT JOIN outer_ o ON o.kind = 'r' AND o.id = lab.region UNION ALL SELECT row, col, o.region FROM bl JOIN outer_ o ON o.kind = 'h' AND o.id = bl.hole)"""


@query(f"""WITH RECURSIVE {_HOT}, {_FILL},
t AS (SELECT region, count(*) AS n_cells, sum(row) AS rows, sum(col) AS cols FROM done GROUP BY 1)
SELECT CAST(row_number() OVER (ORDER BY region) - 1 AS INTEGER) AS risk_cluster_id, n_cells, n_cells * 900.0::DOUBLE AS area, CAST(rows AS BIGINT) AS rows, CAST(cols AS BIGINT) AS cols FROM t WHERE n_cells >= 3""")
def cluster_finalised(spark, d):
    """Holes filled by their share of the cluster, then relabelled, filtered by area and numbered; the SQL works on the tree of nested regions."""
    done = outlines.finalised(_hot(spark, d), 0.1, 2700.0, 30.0, 32)
    return done.groupBy("risk_cluster_id").agg(F.count(F.lit(1)).alias("n_cells"), F.max("area").alias("area"), F.sum("row").alias("rows"), F.sum("col").alias("cols"))


#: Names of risk files and their values by cell; some get no clusters, by name or by value.
RISK_FILES = (("risk_SLR-1-2050_gdp.tif", "h"), ("risk_SLR-2-2100_freight", "w"), ("risk_SLR-2-2100_freight_loading", "h"), ("risk_SLR-3-Severe_POPULATION", "e / 9973"), ("risk_SLR-3-Severe_COMBINED", "h"), ("risk_population", "h / 2"))
OUTLINED = ClusterSettings.of({"risk_threshold": 0.9, "morphological_closing_disk_size": 1, "minimum_polygon_area_square_meters": 2_700.0, "use_contour_method": True, "export_formats": ["gpkg"]})
DENSE = ClusterSettings.of({"risk_threshold": 0.9, "morphological_closing_disk_size": 1})


def _risk_files(spark, d):
    own = cells(spark, d)
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("file"), F.expr(v).cast("double").alias("value")) for n, v in RISK_FILES)))
    return own.select("row", "col", each.alias("f")).select("f.file", "row", "col", "f.value"), height(own)


_FILES = "fv AS (" + " UNION ALL ".join(f"SELECT {i} AS no, '{n}' AS file, row, col, ({v})::DOUBLE AS v FROM cells" for i, (n, v) in enumerate(RISK_FILES) if i in (0, 1, 3, 5)) + "), hh AS (SELECT max(row) + 1 AS rows FROM cells)"
_MASKS = """kk AS (SELECT r, c, r * r + c * c AS d2 FROM range(-12, 13) s(r), range(-12, 13) t(c)), m AS (SELECT no, row, col FROM fv WHERE v >= 0.9),
dl AS (SELECT DISTINCT m.no, row + kk.r AS row, col + kk.c AS col FROM m JOIN rad ON rad.no = m.no JOIN kk ON d2 <= rad.r * rad.r CROSS JOIN hh WHERE row + kk.r BETWEEN 0 AND rows - 1 AND col + kk.c BETWEEN 0 AND 99),
er AS (SELECT f.no, f.row, f.col, bool_and(NOT (f.row + kk.r BETWEEN 0 AND rows - 1 AND f.col + kk.c BETWEEN 0 AND 99) OR dl.no IS NOT NULL) AS closed
 FROM fv f JOIN rad ON rad.no = f.no JOIN kk ON d2 <= rad.r * rad.r CROSS JOIN hh LEFT JOIN dl ON dl.no = f.no AND dl.row = f.row + kk.r AND dl.col = f.col + kk.c GROUP BY 1, 2, 3)"""
_OUTLINED = f"""WITH RECURSIVE {CELLS}, {_FILES}, rad AS (SELECT no, CAST(greatest(1, ceil(sqrt(count(*) * 900.0::DOUBLE) / 600)) AS INTEGER) AS r FROM fv WHERE v >= 0.9 GROUP BY 1), {_MASKS},
taps AS (SELECT no, d, g / sum(g) OVER (PARTITION BY no) AS w FROM (SELECT no, d, exp(-0.5 * power(d / (r / 2.0::DOUBLE), 2)) AS g FROM rad, range(-24, 25) t(d) WHERE abs(d) <= 2 * r)),
f0 AS (SELECT rad.no, x.r AS row, y.c AS col, CASE WHEN er.closed THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS v FROM rad CROSS JOIN (SELECT unnest(range(0, rows)) AS r FROM hh) x CROSS JOIN range(0, 100) y(c) LEFT JOIN er ON er.no = rad.no AND er.row = x.r AND er.col = y.c),
p1 AS (SELECT a.no, a.row, a.col, sum(w * b.v) AS v FROM f0 a JOIN taps ON taps.no = a.no JOIN f0 b ON b.no = a.no AND b.row = a.row AND b.col = least(greatest(a.col + d, 0), 99) GROUP BY 1, 2, 3),
p2 AS (SELECT a.no, a.row, a.col, sum(w * b.v) AS v FROM p1 a JOIN taps ON taps.no = a.no CROSS JOIN hh JOIN p1 b ON b.no = a.no AND b.col = a.col AND b.row = least(greatest(a.row + d, 0), rows - 1) GROUP BY 1, 2, 3),
masked AS (SELECT er.no, er.row, er.col FROM er JOIN p2 ON p2.no = er.no AND p2.row = er.row AND p2.col = er.col WHERE p2.v >= 0.5),
hot AS (SELECT row + no * (rows + 3) AS row, col, (row + no * (rows + 3)) * 4294967296::BIGINT + col AS id FROM masked, hh WHERE no IN (SELECT no FROM masked GROUP BY no HAVING count(*) >= 4)),
{_LAB}, {_FILL.replace("bottom FROM cells", "bottom FROM hot")},
big AS (SELECT region, CAST(region // 4294967296 // (rows + 3) AS INTEGER) AS no FROM done, hh GROUP BY 1, 2 HAVING count(*) >= 3), ids AS (SELECT *, CAST(row_number() OVER (PARTITION BY no ORDER BY region) - 1 AS INTEGER) AS risk_cluster_id FROM big)"""
_NAMED = "(VALUES " + ", ".join(f"({i}, '{n}', '{s}', '{k}')" for i, n, s, k in ((0, RISK_FILES[0][0], "SLR-1-2050", "gdp"), (1, RISK_FILES[1][0], "SLR-2-2100", "freight"), (3, RISK_FILES[3][0], "SLR-3-Severe", "POPULATION"), (5, RISK_FILES[5][0], "population", ""))) + ") n(no, file, scenario, indicator)"


def _described(spark, d, settings):
    layers, rows = _risk_files(spark, d)
    out = clusterfiles.described(clusterfiles.extracted(layers, rows, COLS, settings, 32), layers, settings.cell_size_meters)
    return out.select("file", "risk_cluster_id", "scenario", "indicator", "pixel_count", F.round("mean_risk", 6).alias("mean_risk"), "max_risk", "area", F.round("density", 9).alias("density"))


@query(f"""{_OUTLINED} SELECT n.file, ids.risk_cluster_id, n.scenario, n.indicator, count(*) FILTER (v > 0) AS pixel_count, round(coalesce(avg(v) FILTER (v > 0), 0), 6) AS mean_risk, coalesce(max(v) FILTER (v > 0), 0) AS max_risk,
count(*) * 900.0::DOUBLE AS area, round(coalesce(sum(v) FILTER (v > 0) / (count(*) * 900.0::DOUBLE), 0), 9) AS density
FROM ids JOIN done ON done.region = ids.region JOIN {_NAMED} ON n.no = ids.no CROSS JOIN hh LEFT JOIN fv ON fv.no = ids.no AND fv.row = done.row - ids.no * (rows + 3) AND fv.col = done.col GROUP BY 1, 2, 3, 4""")
def cluster_files(spark, d):
    """Outlined clusters of all risk files, with statistics; the closing's radius follows each file's area."""
    return _described(spark, d, OUTLINED)


@query(f"""WITH RECURSIVE {CELLS}, {_FILES}, rad AS (SELECT DISTINCT no, 1 AS r FROM fv WHERE v >= 0.9), {_MASKS}, pts AS (SELECT no, row, col, row * 4294967296::BIGINT + col AS id FROM er WHERE closed),
nb AS (SELECT a.no, a.id, b.id AS other FROM pts a JOIN pts b ON a.no = b.no AND b.row BETWEEN a.row - 1 AND a.row + 1 AND b.col BETWEEN a.col - 1 AND a.col + 1), core AS (SELECT no, id FROM nb GROUP BY 1, 2 HAVING count(*) >= 4),
ce AS (SELECT nb.* FROM nb SEMI JOIN core USING (no, id) WHERE (no, other) IN (SELECT (no, id) FROM core)), reach(no, id, root) AS (SELECT no, id, id FROM core UNION SELECT ce.no, ce.other, reach.root FROM reach JOIN ce ON ce.no = reach.no AND ce.id = reach.id),
lab AS (SELECT no, id, min(root) AS label FROM reach GROUP BY 1, 2), edge AS (SELECT nb.no, nb.id, arg_min(label, nb.other) AS label FROM nb JOIN lab ON lab.no = nb.no AND lab.id = nb.other ANTI JOIN core ON core.no = nb.no AND core.id = nb.id GROUP BY 1, 2),
done AS (SELECT * FROM lab UNION ALL SELECT * FROM edge), big AS (SELECT no, label, min(id) AS first FROM done GROUP BY 1, 2 HAVING count(*) >= 3 AND count(*) * 900.0 >= 5000), ids AS (SELECT no, label, CAST(row_number() OVER (PARTITION BY no ORDER BY first) - 1 AS INTEGER) AS risk_cluster_id FROM big)
SELECT n.file, risk_cluster_id, n.scenario, n.indicator, count(*) FILTER (v > 0) AS pixel_count, round(coalesce(avg(v) FILTER (v > 0), 0), 6) AS mean_risk, coalesce(max(v) FILTER (v > 0), 0) AS max_risk, count(*) * 900.0::DOUBLE AS area,
round(coalesce(sum(v) FILTER (v > 0) / (count(*) * 900.0::DOUBLE), 0), 9) AS density FROM ids JOIN done ON done.no = ids.no AND done.label = ids.label JOIN {_NAMED} ON n.no = ids.no LEFT JOIN fv ON fv.no = ids.no AND fv.row = done.id // 4294967296 AND fv.col = done.id % 4294967296 GROUP BY 1, 2, 3, 4""")
def density_cluster_files(spark, d):
    """Density clusters of all risk files, by the parameters that hold where none are given."""
    return _described(spark, d, DENSE)


@query(f"""{_OUTLINED}, mine AS (SELECT ids.no, risk_cluster_id, row, col FROM ids JOIN done ON done.region = ids.region), s AS (SELECT no, risk_cluster_id, count(*) AS n FROM mine GROUP BY 1, 2),
pp AS (SELECT a.no, a.risk_cluster_id, count(*) AS p FROM mine a JOIN mine b ON a.no = b.no AND a.risk_cluster_id = b.risk_cluster_id AND ((b.row = a.row AND b.col = a.col + 1) OR (b.row = a.row + 1 AND b.col = a.col)) GROUP BY 1, 2),
q AS (SELECT a.no, a.risk_cluster_id, count(*) AS q FROM mine a JOIN mine b ON b.no = a.no AND b.row = a.row AND b.col = a.col + 1 AND b.risk_cluster_id = a.risk_cluster_id JOIN mine c ON c.no = a.no AND c.row = a.row + 1 AND c.col = a.col AND c.risk_cluster_id = a.risk_cluster_id
 JOIN mine x ON x.no = a.no AND x.row = a.row + 1 AND x.col = a.col + 1 AND x.risk_cluster_id = a.risk_cluster_id GROUP BY 1, 2),
box AS (SELECT no, risk_cluster_id, 4000000 + min(col) * 30.0::DOUBLE AS west, 3000000 - min(row - no * (rows + 3)) * 30.0::DOUBLE AS north FROM mine, hh GROUP BY 1, 2)
SELECT n.file, s.risk_cluster_id, 'Polygon' AS kind, n * 900.0::DOUBLE AS area, 2 - (n - coalesce(p, 0) + coalesce(q, 0)) AS n_rings, west, north FROM s LEFT JOIN pp USING (no, risk_cluster_id) LEFT JOIN q USING (no, risk_cluster_id) JOIN box USING (no, risk_cluster_id) JOIN {_NAMED} ON n.no = s.no""".replace("box AS (SELECT no,", "ends AS (SELECT no,").replace("JOIN box USING", "JOIN ends USING"))
def cluster_features(spark, d):
    """Features of the outlined clusters, read back from their JSON; the SQL counts cells, neighbours and blocks of four."""
    layers, rows = _risk_files(spark, d)
    made = clusterfiles.features(clusterfiles.extracted(layers, rows, COLS, OUTLINED, 32), 4_000_000.0, 3_000_000.0, 30.0, rows, 32)
    read = F.from_json("feature", "geometry struct<type: string, coordinates: array<array<array<double>>>>, properties struct<file: string, risk_cluster_id: int>")
    rings = made.select(read.alias("f")).select("f.properties.*", F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("rings"))
    area = F.expr("aggregate(rings, 0D, (t, g) -> t + aggregate(zip_with(slice(g, 1, size(g) - 1), slice(g, 2, size(g) - 1), (a, b) -> (a[0] - 4000000) * (b[1] - 3000000) - (a[1] - 3000000) * (b[0] - 4000000)), 0D, (s, v) -> s + v)) / 2")
    outer = F.element_at("rings", 1)
    return rings.select("file", "risk_cluster_id", "kind", F.abs(area).alias("area"), F.size("rings").cast("long").alias("n_rings"), F.array_min(F.transform(outer, lambda p: p[0])).alias("west"), F.array_max(F.transform(outer, lambda p: p[1])).alias("north"))


@query(f"""WITH {CELLS}, p AS (SELECT DISTINCT zone, col::DOUBLE AS x, row::DOUBLE AS y FROM cells),
s AS (SELECT a.zone, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_ FROM p a JOIN p b ON a.zone = b.zone AND (a.x <> b.x OR a.y <> b.y)
 WHERE NOT EXISTS (SELECT 1 FROM p c WHERE c.zone = a.zone AND ((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) < 0
  OR ((b.x - a.x) * (c.y - a.y) = (b.y - a.y) * (c.x - a.x) AND (c.x - a.x) * (c.x - b.x) + (c.y - a.y) * (c.y - b.y) > 0))))
SELECT zone, count(*) AS n_corners, sum(ax * by_ - bx * ay) / 2 AS area, min(ax) AS first_x FROM s GROUP BY 1""")
def convex_hulls(spark, d):
    """Hulls of each zone's cells; the SQL takes the sides that all points lie left of."""
    hulls = outlines.convex_hulls(cells(spark, d).select("zone", F.col("col").alias("x"), F.col("row").alias("y")), "zone", tile=16.0)
    twice = F.expr("aggregate(zip_with(hull, concat(slice(hull, 2, size(hull)), slice(hull, 1, 1)), (a, b) -> a.x * b.y - b.x * a.y), 0D, (s, v) -> s + v)")
    return hulls.select("zone", F.size("hull").cast("long").alias("n_corners"), (twice / 2).alias("area"), F.element_at("hull", 1)["x"].alias("first_x"))


#: Sixty columns and forty rows of degrees; several customers share a cell.
DEGREES = GridSpec(4.0, 53.0, 0.05, 60, 40, "EPSG:4326")
TARGET = GridSpec.covering(3_950_000, 3_130_000, 4_080_000, 3_330_000, 8_000)
_MIDDLE = resample.grid_for(DEGREES, "ESRI:54009")
_DEGREES = "src AS (SELECT CAST((c_custkey // 60) % 40 AS INTEGER) AS row, CAST(c_custkey % 60 AS INTEGER) AS col, avg(c_acctbal) AS v FROM customer GROUP BY 1, 2)"
#: Constants of the ellipsoid and of the equal-area projection.
_K = """k0 AS (SELECT 6378137.0::DOUBLE AS a, 1 / 298.257222101::DOUBLE AS f, radians(52::DOUBLE) AS p0), k1 AS (SELECT *, f * (2 - f) AS e2, sqrt(f * (2 - f)) AS e FROM k0),
k2 AS (SELECT *, (1 - e2) * (1 / (1 - e2) - ln((1 - e) / (1 + e)) / (2 * e)) AS qp, (1 - e2) * (sin(p0) / (1 - e2 * power(sin(p0), 2)) - ln((1 - e * sin(p0)) / (1 + e * sin(p0))) / (2 * e)) AS q0 FROM k1),
k AS (SELECT *, a * sqrt(qp / 2) AS rq, asin(q0 / qp) AS b0, a * cos(p0) / sqrt(1 - e2 * power(sin(p0), 2)) / (a * sqrt(qp / 2) * cos(asin(q0 / qp))) AS d FROM k2)"""


def _moll_sql(name: str, source: str) -> str:
    """The rows of ``source`` (with lon and lat) and their Mollweide x and y, the angle found by halving intervals."""
    return f"""{name}_it(id, lo, hi, n) AS (SELECT id, -pi() / 2, pi() / 2, 0 FROM {source} UNION ALL SELECT i.id, CASE WHEN (lo + hi) + sin(lo + hi) < pi() * sin(radians(lat)) THEN (lo + hi) / 2 ELSE lo END,
CASE WHEN (lo + hi) + sin(lo + hi) < pi() * sin(radians(lat)) THEN hi ELSE (lo + hi) / 2 END, n + 1 FROM {name}_it i JOIN {source} s ON s.id = i.id WHERE n < 52),
{name} AS (SELECT s.*, 2 * sqrt(2) / pi() * 6378137 * radians(lon) * cos((lo + hi) / 2) AS mx, sqrt(2) * 6378137 * sin((lo + hi) / 2) AS my FROM {source} s JOIN {name}_it i ON i.id = s.id WHERE n = 52)"""


def _four_sql(name: str, at: str, values: str) -> str:
    """Bilinear values at the places (y, x) of ``at``, in cells, over those of ``values`` that are there."""
    return f"""{name} AS (SELECT p.row, p.col, sum(w * s.v) / sum(w) FILTER (s.v IS NOT NULL) AS v FROM (SELECT p.row, p.col, y, x, r, c, CASE WHEN r = 1 THEN y - 0.5 - floor(y - 0.5) ELSE 1 - (y - 0.5 - floor(y - 0.5)) END
 * CASE WHEN c = 1 THEN x - 0.5 - floor(x - 0.5) ELSE 1 - (x - 0.5 - floor(x - 0.5)) END AS w FROM {at} p, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) t(r, c)) p
 LEFT JOIN {values} s ON s.row = floor(p.y - 0.5) + r AND s.col = floor(p.x - 0.5) + c GROUP BY 1, 2)"""


@query(f"""WITH RECURSIVE pts AS (SELECT c_custkey AS id, 3 + (c_custkey % 900) / 50.0::DOUBLE AS lon, 40 + (c_custkey * 7 % 1000) / 50.0::DOUBLE AS lat FROM customer), {_K}, {_moll_sql("m", "pts")},
q AS (SELECT m.*, k.*, asin((1 - e2) * (sin(radians(lat)) / (1 - e2 * power(sin(radians(lat)), 2)) - ln((1 - e * sin(radians(lat))) / (1 + e * sin(radians(lat)))) / (2 * e)) / qp) AS b, radians(lon - 10) AS l FROM m, k),
z AS (SELECT *, rq * sqrt(2 / (1 + sin(b0) * sin(b) + cos(b0) * cos(b) * cos(l))) AS bb FROM q)
SELECT id, round(4321000 + bb * d * cos(b) * sin(l), 2) AS east, round(3210000 + bb / d * (cos(b0) * sin(b) - sin(b0) * cos(b) * cos(l)), 2) AS north, round(mx, 2) AS moll_x, round(my, 2) AS moll_y,
round(a * radians(lon), 2) AS merc_x, round(a * asinh(tan(radians(lat))), 2) AS merc_y FROM z""")
def projected_points(spark, d):
    """Degrees in the equal-area, Mollweide and Web Mercator systems."""
    k = F.col("c_custkey")
    points = table(spark, d, "customer").select(k.alias("id"), (3 + (k % 900) / 50.0).alias("lon"), (40 + (k * 7 % 1000) / 50.0).alias("lat"))
    pairs = {"east": "EPSG:3035", "moll_x": "ESRI:54009", "merc_x": "EPSG:3857"}
    names = {"east": ("east", "north"), "moll_x": ("moll_x", "moll_y"), "merc_x": ("merc_x", "merc_y")}
    columns = [F.round(v, 2).alias(n) for key, system in pairs.items() for n, v in zip(names[key], crs.transform(F.col("lon"), F.col("lat"), "EPSG:4326", system))]
    return points.select("id", *columns)


@query(f"""WITH RECURSIVE {_DEGREES}, {_K}, mid0 AS (SELECT CAST(i // {_MIDDLE.width} AS INTEGER) AS row, CAST(i % {_MIDDLE.width} AS INTEGER) AS col, {_MIDDLE.x0!r}::DOUBLE + (i % {_MIDDLE.width} + 0.5) * {_MIDDLE.res!r}::DOUBLE AS x,
 {_MIDDLE.y0!r}::DOUBLE - (i // {_MIDDLE.width} + 0.5) * {_MIDDLE.res!r}::DOUBLE AS y FROM range({_MIDDLE.width * _MIDDLE.height}) t(i)),
mid1 AS (SELECT row, col, x, asin(y / (sqrt(2) * 6378137)) AS t FROM mid0), mid2 AS (SELECT row, col, degrees(x * pi() / (2 * sqrt(2) * 6378137 * cos(t))) AS lon, degrees(asin((2 * t + sin(2 * t)) / pi())) AS lat FROM mid1),
mid3 AS (SELECT row, col, (lon - 4) / 0.05::DOUBLE AS x, (53 - lat) / 0.05::DOUBLE AS y FROM mid2), {_four_sql("mid", "mid3", "src")},
t0 AS (SELECT i AS id, CAST(i // {TARGET.width} AS INTEGER) AS row, CAST(i % {TARGET.width} AS INTEGER) AS col, ({TARGET.x0} + (i % {TARGET.width} + 0.5) * {TARGET.res} - 4321000) / d AS x, ({TARGET.y0} - (i // {TARGET.width} + 0.5) * {TARGET.res} - 3210000) * d AS y, k.* FROM range({TARGET.width * TARGET.height}) t(i), k),
t1 AS (SELECT *, sqrt(x * x + y * y) AS rho, 2 * asin(sqrt(x * x + y * y) / (2 * rq)) AS c FROM t0),
t2 AS (SELECT *, asin(cos(c) * sin(b0) + y * sin(c) * cos(b0) / rho) AS b, 10 + degrees(atan2(x * sin(c), rho * cos(b0) * cos(c) - y * sin(b0) * sin(c))) AS lon FROM t1),
t3 AS (SELECT id, row, col, lon, degrees(b + (e2 / 3 + 31 * e2 * e2 / 180 + 517 * power(e2, 3) / 5040) * sin(2 * b) + (23 * e2 * e2 / 360 + 251 * power(e2, 3) / 3780) * sin(4 * b) + 761 * power(e2, 3) / 45360 * sin(6 * b)) AS lat FROM t2),
{_moll_sql("t4", "t3")}, t5 AS (SELECT row, col, (mx - {_MIDDLE.x0!r}::DOUBLE) / {_MIDDLE.res!r}::DOUBLE AS x, ({_MIDDLE.y0!r}::DOUBLE - my) / {_MIDDLE.res!r}::DOUBLE AS y FROM t4), {_four_sql("done", "t5", "(SELECT * FROM mid WHERE v IS NOT NULL)")}
SELECT row, col, round(v, 4) AS v FROM done""")
def reprojected_layer(spark, d):
    """A layer in degrees by way of Mollweide to the equal-area target grid, bilinear twice."""
    k = F.col("c_custkey")
    layer = table(spark, d, "customer").groupBy((F.floor(k / 60) % 40).cast("int").alias("row"), (k % 60).cast("int").alias("col")).agg(F.avg("c_acctbal").alias("e"))
    return resample.to_target(layer, "e", DEGREES, TARGET).select("row", "col", F.round("v", 4).alias("v"))


def _share_sql(target: str, source: str, ratio: str) -> str:
    return f"(least({source} + 1, ({target} + 1) * {ratio}) - greatest({source}, {target} * {ratio}))"


@query(f"""WITH {CELLS}, w AS (SELECT l AS ratio, r AS row, c AS col, sum(e * {_share_sql("r", "row", "l")} * {_share_sql("c", "col", "l")}) AS v FROM cells, (VALUES (1.5::DOUBLE), (0.7::DOUBLE)) t(l),
 LATERAL (SELECT unnest(range(CAST(floor(row / l) AS BIGINT), CAST(ceil((row + 1) / l) AS BIGINT))) AS r) x, LATERAL (SELECT unnest(range(CAST(floor(col / l) AS BIGINT), CAST(ceil((col + 1) / l) AS BIGINT))) AS c) y
 WHERE {_share_sql("r", "row", "l")} > 0 AND {_share_sql("c", "col", "l")} > 0 GROUP BY 1, 2, 3)
SELECT ratio, CAST(row AS INTEGER) AS row, CAST(col AS INTEGER) AS col, round(v, 4) AS v FROM w""")
def overlap_resample(spark, d):
    """Mass over cells one and a half, and seven tenths, as wide, by shared areas."""
    own = cells(spark, d)
    parts = [resample.overlap_sum(own, "e", ratio, int(height(own) / ratio) + 1, int(COLS / ratio) + 1).select(F.lit(ratio).alias("ratio"), "row", "col", F.round("v", 4).alias("v")) for ratio in (1.5, 0.7)]
    return parts[0].union(parts[1])


_LOBES = "CASE WHEN {t} = 0 THEN 1 WHEN abs({t}) < 3 THEN 3 * sin(pi() * {t}) * sin(pi() * {t} / 3) / power(pi() * {t}, 2) ELSE 0 END"


@query(f"""WITH {CELLS}, hh AS (SELECT max(row) + 1 AS rows FROM cells), tg AS (SELECT r AS row, c AS col FROM hh, range(0, 66) b(c), LATERAL (SELECT unnest(range(0, CAST(floor(rows / 1.5) AS BIGINT))) AS r) a),
j AS (SELECT tg.row, tg.col, cells.h, ((tg.row + 0.5::DOUBLE) * 1.5 - cells.row - 0.5) / 1.5 AS ty, ((tg.col + 0.5::DOUBLE) * 1.5 - cells.col - 0.5) / 1.5 AS tx FROM tg JOIN cells ON cells.row BETWEEN tg.row * 1.5 - 5 AND tg.row * 1.5 + 6 AND cells.col BETWEEN tg.col * 1.5 - 5 AND tg.col * 1.5 + 6),
w AS (SELECT row, col, h, ({_LOBES.format(t="ty")}) * ({_LOBES.format(t="tx")}) AS w FROM j)
SELECT CAST(row AS INTEGER) AS row, CAST(col AS INTEGER) AS col, round(sum(w * h) / sum(w), 6) AS v FROM w GROUP BY 1, 2 HAVING sum(w) > 1e-6""")
def lanczos_resample(spark, d):
    """Lanczos on cells one and a half as wide."""
    own = cells(spark, d)
    return resample.kernel(own, "h", height(own), COLS, 1.5, "lanczos", 32).select("row", "col", F.round("v", 6).alias("v"))


@query("""WITH p AS (SELECT l_orderkey AS id, list(struct_pack(x := l_quantity::DOUBLE, y := l_extendedprice::DOUBLE) ORDER BY l_linenumber, l_quantity, l_extendedprice) AS ring FROM lineitem GROUP BY 1),
u AS (SELECT id, len(ring) AS n, unnest(range(1, len(ring) + 1)) AS k, ring FROM p), s AS (SELECT id, k, ring[k].x AS ax, ring[k].y AS ay, ring[CASE WHEN k = n THEN 1 ELSE k + 1 END].x AS bx, ring[CASE WHEN k = n THEN 1 ELSE k + 1 END].y AS by_ FROM u),
z AS (SELECT id, sum(ax * by_ - bx * ay) AS doubled, count(DISTINCT (ax, ay)) AS n FROM s GROUP BY 1),
c AS (SELECT DISTINCT s.id FROM s JOIN s t ON s.id = t.id AND s.k < t.k WHERE sign((s.bx - s.ax) * (t.ay - s.ay) - (s.by_ - s.ay) * (t.ax - s.ax)) * sign((s.bx - s.ax) * (t.by_ - s.ay) - (s.by_ - s.ay) * (t.bx - s.ax)) < 0
 AND sign((t.bx - t.ax) * (s.ay - t.ay) - (t.by_ - t.ay) * (s.ax - t.ax)) * sign((t.bx - t.ax) * (s.by_ - t.ay) - (t.by_ - t.ay) * (s.bx - t.ax)) < 0)
SELECT z.id, CASE WHEN c.id IS NOT NULL THEN 'crosses itself' WHEN n < 3 THEN 'too few points' ELSE 'no area' END AS problem FROM z LEFT JOIN c ON c.id = z.id WHERE c.id IS NOT NULL OR n < 3 OR doubled = 0""")
def ring_faults(spark, d):
    """Each order's items as the corners of a ring (quantity, price), and what keeps it from being a polygon."""
    return lines.faults(order_rings(spark, d), 20_000.0)


#: Shapes of the export in degrees, scaled by a power of two so that their sides turn as the items' do.
_RING = "SELECT l_orderkey AS id, l_orderkey % 2003 AS layer, list(struct_pack(x := l_quantity::DOUBLE - 25, y := l_extendedprice::DOUBLE / 1024) ORDER BY l_linenumber, l_quantity, l_extendedprice) AS ring FROM lineitem GROUP BY 1"


@query(f"""WITH p AS ({_RING}), u AS (SELECT id, layer, len(ring) AS n, unnest(range(1, len(ring) + 1)) AS k, ring FROM p),
s AS (SELECT id, layer, k, ring[k].x AS ax, ring[k].y AS ay, ring[CASE WHEN k = n THEN 1 ELSE k + 1 END].x AS bx, ring[CASE WHEN k = n THEN 1 ELSE k + 1 END].y AS by_ FROM u),
lay AS (SELECT layer, min(ax) BETWEEN -180 AND 180 AND max(ax) BETWEEN -180 AND 180 AND min(ay) BETWEEN -90 AND 90 AND max(ay) BETWEEN -90 AND 90 AND max(ax) - min(ax) BETWEEN 0.001 AND 350 AND max(ay) - min(ay) BETWEEN 0.001 AND 170 AS ok FROM s GROUP BY 1),
c AS (SELECT DISTINCT s.id FROM s JOIN s t ON s.id = t.id AND s.k < t.k WHERE sign((s.bx - s.ax) * (t.ay - s.ay) - (s.by_ - s.ay) * (t.ax - s.ax)) * sign((s.bx - s.ax) * (t.by_ - s.ay) - (s.by_ - s.ay) * (t.bx - s.ax)) < 0
 AND sign((t.bx - t.ax) * (s.ay - t.ay) - (t.by_ - t.ay) * (s.ax - t.ax)) * sign((t.bx - t.ax) * (s.by_ - t.ay) - (t.by_ - t.ay) * (s.bx - t.ax)) < 0),
f AS (SELECT id FROM s GROUP BY 1 HAVING count(DISTINCT (ax, ay)) < 3 OR sum(ax * by_ - bx * ay) = 0 UNION SELECT id FROM c),
w AS (SELECT id, greatest(0, CASE WHEN bx = ax THEN CASE WHEN ax BETWEEN -20 AND 45 THEN 0 ELSE 2 END ELSE least((-20 - ax) / (bx - ax), (45 - ax) / (bx - ax)) END, CASE WHEN by_ = ay THEN CASE WHEN ay BETWEEN 30 AND 75 THEN 0 ELSE 2 END ELSE least((30 - ay) / (by_ - ay), (75 - ay) / (by_ - ay)) END)
 <= least(1, CASE WHEN bx = ax THEN 1 ELSE greatest((-20 - ax) / (bx - ax), (45 - ax) / (bx - ax)) END, CASE WHEN by_ = ay THEN 1 ELSE greatest((30 - ay) / (by_ - ay), (75 - ay) / (by_ - ay)) END) AS touches,
 (ay > 30) <> (by_ > 30) AND -20 < (bx - ax) * (30 - ay) / (by_ - ay) + ax AS passes FROM s),
meet AS (SELECT id FROM w GROUP BY 1 HAVING bool_or(touches) OR count(*) FILTER (passes) % 2 = 1)
SELECT p.id, p.layer FROM p JOIN lay USING (layer) WHERE ok OR (p.id NOT IN (SELECT id FROM f) AND p.id IN (SELECT id FROM meet))""")
def exported_shapes(spark, d):
    """K5: the shapes that may be exported of layers with good and with bad bounds; the SQL clips each side by the box."""
    turned = F.transform("ring", lambda p: F.struct((p["x"] - 25).alias("x"), (p["y"] / 1024).alias("y")))
    shapes = order_rings(spark, d).select("id", (F.col("id") % 2003).alias("layer"), turned.alias("ring"))
    made = web.exportable(shapes, "layer", 20.0)
    return made.select("id", "layer")


def _squares(spark, d):
    corner = lambda c, r: F.struct((F.col("col") + c).cast("double").alias("x"), (F.col("row") + r).cast("double").alias("y"))
    return cells(spark, d).select("id", F.col("zone"), F.array(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1)).alias("ring"))


@query(f"""WITH {CELLS}, n AS (SELECT zone, count(*) AS n FROM cells GROUP BY 1), p AS (SELECT a.zone, count(*) AS p FROM cells a JOIN cells b ON a.zone = b.zone AND ((b.row = a.row AND b.col = a.col + 1) OR (b.row = a.row + 1 AND b.col = a.col)) GROUP BY 1)
SELECT zone, n::DOUBLE AS area, 4 * n - 2 * coalesce(p, 0) AS length FROM n LEFT JOIN p USING (zone)""")
def dissolved_zones(spark, d):
    """Q-C11: each zone's cells, given as squares, dissolved to outlines; the SQL counts cells and pairs of neighbours."""
    found = lines.dissolved(_squares(spark, d), "zone", 32.0)
    return found.groupBy("zone").agg(F.sum("area").alias("area"), F.sum("n").alias("length"))


@query()
def simplified_zones(spark, d):
    """Outlines of grouped cells with one border between neighbours, simplified to at most twelve points; no SQL, tests hold it against plain loops."""
    zones = cells(spark, d).select("row", "col", (F.floor(F.col("dem") / 12) + F.floor(F.col("col") / 9) * 10).cast("int").alias("label"))
    shapes = outlines.polygons(outlines.ring_pieces(outlines.regions(zones, 32), 32)).select(F.col("region").alias("id"), F.col("outer").alias("ring"))
    done = lines.simplified(shapes, 0.5, 12, 32.0, coarsest=4.0)
    return done.join(shapes.select("id", F.size("ring").alias("n_before")), "id").select("id", "n_before", F.size("ring").alias("n_points"), "tolerance")


#: A triangle for each supplier, whose balance is its value.
_PORTS = """ports AS (SELECT s_suppkey AS id, s_acctbal AS value, (s_suppkey * 37 % 97)::DOUBLE AS ax, (s_suppkey * 13 % 11)::DOUBLE AS ay, (s_suppkey * 37 % 97 + 3 + s_suppkey % 5)::DOUBLE AS bx, (s_suppkey * 13 % 11 + s_suppkey % 2)::DOUBLE AS by_,
 s_suppkey * 37 % 97 + 1.25::DOUBLE AS cx, s_suppkey * 13 % 11 + 2.5 + (s_suppkey % 3)::DOUBLE AS cy FROM supplier)"""


def ports(spark, d):
    k = F.col("s_suppkey")
    x, y = k * 37 % 97, k * 13 % 11
    point = lambda px, py: F.struct(px.cast("double").alias("x"), py.cast("double").alias("y"))
    return table(spark, d, "supplier").select(k.alias("id"), F.col("s_acctbal").alias("value"), F.array(point(x, y), point(x + 3 + k % 5, y + k % 2), point(x + 1.25, y + 2.5 + k % 3)).alias("ring"))


def _centres(spark, d):
    half = lambda c: (F.col(c) + 0.5).cast("double")
    return cells(spark, d).select("id", "row", "col", half("col").alias("x"), half("row").alias("y"))


@query(f"""WITH {CELLS}, {_PORTS}, s AS (SELECT id, col + i AS x, row + j AS y FROM cells, (VALUES (0.25::DOUBLE), (0.75::DOUBLE)) a(i), (VALUES (0.25::DOUBLE), (0.75::DOUBLE)) b(j)),
hit AS (SELECT s.id, value / (abs((bx - ax) * (cy - ay) - (by_ - ay) * (cx - ax)) / 2) / 4 AS v FROM s JOIN ports ON value > 0 AND (bx - ax) * (y - ay) - (by_ - ay) * (x - ax) > 0 AND (cx - bx) * (y - by_) - (cy - by_) * (x - bx) > 0 AND (ax - cx) * (y - cy) - (ay - cy) * (x - cx) > 0)
SELECT cells.id, round(coalesce(sum(v), 0), 3) AS burned FROM cells LEFT JOIN hit USING (id) GROUP BY 1""")
def port_density(spark, d):
    """ports' values by area at half the resolution, added up where ports overlap."""
    return spatial.spread_area(_centres(spark, d), ports(spark, d), "ring", "value", 1.0, 16.0).select("id", F.round("burned", 3).alias("burned"))


@query(f"""WITH {CELLS}, {_PORTS}, seg AS (SELECT id, ax, ay, bx, by_ FROM ports WHERE id % 9 = 0 UNION ALL SELECT id, bx, by_, cx, cy FROM ports WHERE id % 9 = 0 UNION ALL SELECT id, cx, cy, ax, ay FROM ports WHERE id % 9 = 0),
pts AS (SELECT seg.*, k / 256.0::DOUBLE AS t FROM seg, range(0, 257) r(k)), c AS (SELECT id, col::DOUBLE AS x0, row::DOUBLE AS y0, col + 1::DOUBLE AS x1, row + 1::DOUBLE AS y1 FROM cells),
near AS (SELECT c.id, min(power(greatest(x0 - (ax + t * (bx - ax)), (ax + t * (bx - ax)) - x1, 0), 2) + power(greatest(y0 - (ay + t * (by_ - ay)), (ay + t * (by_ - ay)) - y1, 0), 2)) AS d2 FROM c, pts GROUP BY 1),
inn AS (SELECT DISTINCT c.id FROM c JOIN ports ON ports.id % 9 = 0 AND (bx - ax) * (y0 + 0.5 - ay) - (by_ - ay) * (x0 + 0.5 - ax) > 0 AND (cx - bx) * (y0 + 0.5 - by_) - (cy - by_) * (x0 + 0.5 - bx) > 0 AND (ax - cx) * (y0 + 0.5 - cy) - (ay - cy) * (x0 + 0.5 - cx) > 0)
SELECT c.id, d2 <= 0.49 OR inn.id IS NOT NULL AS touched FROM c JOIN near USING (id) LEFT JOIN inn USING (id)""")
def port_touched(spark, d):
    """Cells whose squares a port's surroundings touch; the SQL walks along the sides in small steps."""
    return spatial.touched(_centres(spark, d), ports(spark, d).where("id % 9 = 0"), "ring", 0.7, 1.0, 16.0).select("id", "touched")


_COARSE, _FINE = GridSpec(0.0, 18.0, 1.0, 106, 18), GridSpec(0.0, 18.0, 0.3, 353, 60)


@query(f"""WITH {_PORTS}, k AS (SELECT CAST(i // 106 AS INTEGER) AS row, CAST(i % 106 AS INTEGER) AS col, i % 106 + 0.5::DOUBLE AS x, 18 - (i // 106 + 0.5::DOUBLE) AS y FROM range(1908) t(i)),
src AS (SELECT k.row, k.col, coalesce(arg_max(value, ports.id), 0) AS v FROM k LEFT JOIN ports ON (bx - ax) * (y - ay) - (by_ - ay) * (x - ax) > 0 AND (cx - bx) * (y - by_) - (cy - by_) * (x - bx) > 0 AND (ax - cx) * (y - cy) - (ay - cy) * (x - cx) > 0 GROUP BY 1, 2),
tg AS (SELECT CAST(i // 353 AS INTEGER) AS row, CAST(i % 353 AS INTEGER) AS col, (i % 353 + 0.5::DOUBLE) * 0.3::DOUBLE AS x, (i // 353 + 0.5::DOUBLE) * 0.3::DOUBLE AS y FROM range(21180) t(i)), {_four_sql("done", "tg", "src")} SELECT row, col, round(v, 6) AS v FROM done""")
def census_resampled(spark, d):
    """Shapes on a coarse grid, then on cells three tenths as wide."""
    return resample.census_grid(ports(spark, d), "ring", "value", "id", _COARSE, _FINE, 16.0).select("row", "col", F.round("v", 6).alias("v"))


_PEOPLE, _CELLS30 = GridSpec(0.0, 3000.0, 75.0, 60, 40), GridSpec(0.0, 3000.0, 30.0, 150, 100)


@query(f"""WITH {_DEGREES}, tg AS (SELECT CAST(i // 150 AS INTEGER) AS row, CAST(i % 150 AS INTEGER) AS col, (i % 150 + 0.5::DOUBLE) * 0.4::DOUBLE AS x, (i // 150 + 0.5::DOUBLE) * 0.4::DOUBLE AS y FROM range(15000) t(i)), {_four_sql("done", "tg", "src")}
SELECT row, col, CASE WHEN (row + col) % 5 > 0 THEN round(v * 900 / (57.1::DOUBLE * 92.8::DOUBLE), 4) ELSE 0.0::DOUBLE END AS people FROM done""")
def population_scan(spark, d):
    """People by the ratio of the areas, in a study area."""
    k = F.col("c_custkey")
    layer = table(spark, d, "customer").groupBy((F.floor(k / 60) % 40).cast("int").alias("row"), (k % 60).cast("int").alias("col")).agg(F.avg("c_acctbal").alias("e"))
    area = resample.frame(spark, _CELLS30).where("(row + col) % 5 > 0")
    return resample.population(layer, "e", _PEOPLE, _CELLS30, area).select("row", "col", F.round("population", 4).alias("people"))


@query("""WITH t AS (SELECT s_nationkey AS zone, sum(s_acctbal) / 20000 AS v FROM supplier GROUP BY 1), s AS (SELECT max(v) AS top, quantile_cont(v, 0.99) AS p99 FROM t WHERE v > 0),
o AS (SELECT zone, v, CASE WHEN v > 0 THEN CASE WHEN top > 1 THEN CASE WHEN p99 > 1 THEN v / p99 ELSE least(v, 1.0) END WHEN top < 0.8 THEN v * 0.9 / top ELSE v END END AS o FROM t, s)
SELECT zone, round(CASE WHEN o IS NULL THEN 0.0 ELSE greatest(CASE WHEN o > 1 THEN 1 + 0.02 * tanh((o - 1) / 0.1) ELSE o END, 0.01) END, 6) AS value FROM o""")
def freight_normalised(spark, d):
    """A table of regional values rescaled."""
    totals = table(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("zone")).agg((F.sum("s_acctbal") / 20000).alias("v"))
    return tabular.normalised_table(totals, "v", "value").select("zone", F.round("value", 6).alias("value"))


@query("""WITH t AS (SELECT s_nationkey AS zone, sum(s_acctbal) AS v FROM supplier WHERE s_nationkey % 4 > 0 GROUP BY 1), h AS (SELECT c_nationkey AS zone, avg(c_acctbal) / 10000 AS urban FROM customer WHERE c_nationkey % 3 > 0 GROUP BY 1)
SELECT n_nationkey AS zone, n_name, round(v, 2) AS v, CASE WHEN 0.7 * urban + 0.3 * (1 - urban) >= 0.6 THEN 1.15::DOUBLE WHEN 0.7 * urban + 0.3 * (1 - urban) >= 0.4 THEN 1.05::DOUBLE ELSE 0.5::DOUBLE END AS multiplier
FROM nation JOIN h ON h.zone = n_nationkey LEFT JOIN t ON t.zone = n_nationkey""")
def zones_with_values(spark, d):
    """Zones with shares (inner) and values (left)."""
    zones = table(spark, d, "nation").select(F.col("n_nationkey").alias("zone"), "n_name")
    shares = table(spark, d, "customer").where("c_nationkey % 3 > 0").groupBy(F.col("c_nationkey").alias("zone")).agg((F.avg("c_acctbal") / 10000).alias("urban"))
    values = table(spark, d, "supplier").where("s_nationkey % 4 > 0").groupBy(F.col("s_nationkey").alias("zone")).agg(F.sum("s_acctbal").alias("v"))
    found = tabular.with_values(tabular.with_shares(zones, shares, "zone"), values, "zone", "v")
    return found.select("zone", "n_name", F.round("v", 2).alias("v"), risk.urban_multiplier(F.col("urban"), 1 - F.col("urban")).alias("multiplier"))
