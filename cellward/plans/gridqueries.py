"""Queries on grids: risk curves, rescaling, distribution, focal and zonal steps.

The star tables stand for the model: a customer is a cell (row and column from its key), its nation a zone, its
balance above 0 an exposure weight, and order totals are regional values.  Elevation is a fixed integer formula.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellward.functions import risk as r
from cellward.operators import clusters, normalise, raster, spatial, tabular
from cellward.plans.config import CLASS_WEIGHTS, SCENARIOS, Settings
from cellward.sources.storage import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
COLS = 100


def query(sql: str | None = None):
    """Registers a query, and the SQL that checks it if there is any."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def cells(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, d, "customer").select(
        k.alias("id"),
        F.floor(k / 100).cast("int").alias("row"),
        (k % 100).cast("int").alias("col"),
        F.col("c_nationkey").alias("zone"),
        F.greatest(F.col("c_acctbal"), F.lit(0.0)).alias("e"),
        (F.pmod(k * 37, F.lit(4000)) / 100.0 - 5).alias("dem"),
        (F.pmod(k * 13, F.lit(1000)) / 1000.0).alias("h"),
        (F.pmod(k * 29, F.lit(1000)) / 1000.0).alias("w"),
        (F.pmod(k * 7, F.lit(10)) > 0).alias("land"),
    )


CELLS = """cells AS (SELECT c_custkey AS id, CAST(c_custkey // 100 AS INTEGER) AS row, CAST(c_custkey % 100 AS INTEGER) AS col, c_nationkey AS zone,
  greatest(c_acctbal, 0.0) AS e, ((c_custkey * 37) % 4000) / 100.0::DOUBLE - 5 AS dem, ((c_custkey * 13) % 1000) / 1000.0::DOUBLE AS h,
  ((c_custkey * 29) % 1000) / 1000.0::DOUBLE AS w, (c_custkey * 7) % 10 > 0 AS land FROM customer)"""
TOTALS = "totals AS (SELECT c_nationkey AS zone, sum(o_totalprice) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1)"


def totals(spark, d):
    return table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).groupBy(F.col("c_nationkey").alias("zone")).agg(F.sum("o_totalprice").alias("total"))


def scenarios(spark):
    return F.broadcast(spark.createDataFrame(list(SCENARIOS), "scenario string, rise double"))


SCEN = "scen AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', {m}::DOUBLE)" for n, m in SCENARIOS) + ") v(scenario, rise))"
CURVE = """CASE WHEN dem > 25 THEN 0.001 + 0.009 * exp(-(dem - 25) / 10) WHEN dem - rise <= 0 THEN 0.8 + 0.19 * (1 - exp(-abs(dem - rise) / 2))
  WHEN dem - rise <= 13.5 THEN 0.6 * exp(-(dem - rise) / 1.4::DOUBLE) ELSE 0.05 + 0.1 * exp(-((dem - rise) - 13.5) / 5) END"""


@query(f"""WITH {CELLS}, {TOTALS}, z AS (SELECT zone, sum(e) AS se, count(*) AS n FROM cells GROUP BY 1)
SELECT id, zone, round(CASE WHEN se > 0 THEN total * e / se ELSE total / n END, 3) AS value FROM cells JOIN z USING (zone) JOIN totals USING (zone)""")
def dasymetric_share(spark, d):
    """Regional totals over cells by exposure."""
    return tabular.share_out(cells(spark, d), "zone", "e", totals(spark, d), "total", "value").select("id", "zone", F.round("value", 3).alias("value"))


@query("""WITH s AS (SELECT s_suppkey AS id, s_nationkey AS zone, CASE WHEN s_nationkey % 2 = 0 THEN 0.0 ELSE greatest(s_acctbal, 0.0) END AS e FROM supplier),
z AS (SELECT zone, sum(e) AS se, count(*) AS n FROM s GROUP BY 1)
SELECT id, zone, round(CASE WHEN se > 0 THEN n_nationkey * 100.0::DOUBLE * e / se ELSE n_nationkey * 100.0::DOUBLE / n END, 4) AS value FROM s JOIN z USING (zone) JOIN nation ON n_nationkey = zone""")
def dasymetric_equal_fallback(spark, d):
    """W1 where a zone's weights are all 0."""
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("zone"), F.when(F.col("s_nationkey") % 2 == 0, 0.0).otherwise(F.greatest("s_acctbal", F.lit(0.0))).alias("e"))
    t = table(spark, d, "nation").select(F.col("n_nationkey").alias("zone"), (F.col("n_nationkey") * 100.0).alias("total"))
    return tabular.share_out(s, "zone", "e", t, "total", "value").select("id", "zone", F.round("value", 4).alias("value"))


@query(f"""WITH {CELLS}, {TOTALS}, v AS (SELECT id, zone, round(e, 0) AS v FROM cells), s AS (SELECT zone, sum(v) FILTER (v > 0) AS sv FROM v GROUP BY 1)
SELECT id, v.zone, round(CASE WHEN abs(total - sv) >= 1e-6 AND v > 0 THEN v + (total - sv) * v / sv ELSE v END, 3) AS value FROM v JOIN s USING (zone) JOIN totals USING (zone)""")
def mass_conservation(spark, d):
    """A zone's missing mass over its positive cells."""
    v = cells(spark, d).select("id", "zone", F.round("e", 0).alias("v"))
    return normalise.conserve(v, "v", totals(spark, d), "total", ["zone"]).select("id", "zone", F.round("conserved", 3).alias("value"))


@query(f"WITH {CELLS} SELECT round(sum(DISTINCT v), 2) AS total, count(DISTINCT v) AS n_values FROM (SELECT floor(e / 100) AS v FROM cells) WHERE v <> 0")
def original_total_by_value(spark, d):
    """A4, Q1: equal values count once."""
    return tabular.distinct_total(cells(spark, d).select(F.floor(F.col("e") / 100).cast("double").alias("v")), "v").select(F.round("total", 2).alias("total"), "n_values")


def _norm_sql(kind: str, value: str, mask: str) -> str:
    n = normalise.NORMALISERS[kind]
    small = "CASE WHEN top < 0.8 THEN v * 0.9 / top ELSE v END" if n.boost else "v"
    weak = "CASE WHEN top < 0.95 THEN v / top ELSE v END" if n.boost else "v"
    return f"""WITH {CELLS}, x AS (SELECT id, zone, CASE WHEN {mask} THEN {value} END AS v FROM cells),
s AS (SELECT zone, max(v) AS top, quantile_cont(v, 0.99) AS p99 FROM x GROUP BY 1),
y AS (SELECT id, v, CASE WHEN v IS NULL THEN NULL WHEN NOT top > 0 THEN {n.floor} WHEN top > 1 THEN CASE WHEN p99 > {n.ceiling} THEN v * {n.ceiling} / p99 ELSE least(v, 1.0) END ELSE {small if n.preserve else weak} END AS o FROM x JOIN s USING (zone))
SELECT id, round(CASE WHEN v IS NULL THEN 0.0 ELSE greatest(CASE WHEN o > {n.ceiling} THEN {n.ceiling} + 0.02 * tanh((o - {n.ceiling}) / 0.1) ELSE o END, {n.floor}) END, 6) AS value FROM y"""


def _norm(kind: str, value: str, mask: str, docs: str):
    def f(spark, d):
        own = cells(spark, d).withColumn("v", F.expr(value))
        return normalise.normalise(own, "v", kind, F.expr(mask), by=["zone"]).select("id", F.round("normalised", 6).alias("value"))

    f.__name__, f.__doc__ = f"normalise_{kind}", docs
    QUERIES[f.__name__], ORACLES[f.__name__] = f, _norm_sql(kind, value, mask)


_norm("hazard", "h * 0.9", "land", "N1 by zone.")
_norm("exposition", "h * 0.7", "dem > 0", "N2 by zone.")
_norm("economic", "e / 1000", "e > 0", "N3 by zone.")
_norm("risk", "w * 1.3", "w > 0", "N4 by zone.")
_norm("full_range", "w * 0.6", "land", "N5, N6 by zone.")


@query("""SELECT l_returnflag, count(l_discount) AS n, round(avg(l_discount), 6) AS mean, round(median(l_discount), 6) AS median, round(stddev_pop(l_discount), 6) AS std,
min(l_discount) AS min, max(l_discount) AS max, round(quantile_cont(l_discount, 0.95), 6) AS p95, round(quantile_cont(l_discount, 0.99), 6) AS p99 FROM lineitem GROUP BY 1""")
def normaliser_stats(spark, d):
    """A6, A29."""
    s = normalise.statistics(table(spark, d, "lineitem"), F.col("l_discount"), ["l_returnflag"])
    return s.select("l_returnflag", "n", *(F.round(c, 6).alias(c) for c in ("mean", "median", "std")), "min", "max", *(F.round(c, 6).alias(c) for c in ("p95", "p99")))


@query("""SELECT p_partkey, CASE p_size % 30 WHEN 5 THEN 0.5::DOUBLE WHEN 11 THEN 0.05::DOUBLE WHEN 12 THEN 0.1::DOUBLE WHEN 13 THEN 0.1::DOUBLE WHEN 14 THEN 0.15::DOUBLE WHEN 15 THEN 0.15::DOUBLE
WHEN 21 THEN 0.25::DOUBLE WHEN 22 THEN 0.7::DOUBLE WHEN 23 THEN 0.7::DOUBLE WHEN 24 THEN 0.9::DOUBLE WHEN 25 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS weight FROM part""")
def class_lookup(spark, d):
    """R15."""
    return table(spark, d, "part").select("p_partkey", r.class_weight(F.col("p_size") % 30, CLASS_WEIGHTS).alias("weight"))


@query(f"WITH {CELLS} SELECT id, CASE WHEN f >= 0.6 THEN 1.15::DOUBLE WHEN f >= 0.4 THEN 1.05::DOUBLE ELSE 0.5::DOUBLE END AS multiplier FROM (SELECT id, 0.7 * h + 0.3 * w AS f FROM cells)")
def urban_multiplier(spark, d):
    """R18, J1."""
    return cells(spark, d).select("id", r.urban_multiplier(F.col("h"), F.col("w")).alias("multiplier"))


@query("SELECT s_suppkey AS id, CASE WHEN s_acctbal > 5000 THEN 1.15::DOUBLE WHEN s_acctbal > 0 THEN 1.05::DOUBLE ELSE 1.0::DOUBLE END AS multiplier FROM supplier")
def port_multiplier(spark, d):
    """R19."""
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), r.port_multiplier(F.col("s_acctbal") > 5000, F.col("s_acctbal") > 0).alias("multiplier"))


_W = Settings().exposition_weights


@query(f"""WITH {CELLS} SELECT id, round((0.30 * h + 0.30 * w + 0.13 * h * w + 0.12 * (1 - h) + 0.15 * (1 - w))
 * CASE WHEN 0.7 * h + 0.3 * w >= 0.6 THEN 1.15 WHEN 0.7 * h + 0.3 * w >= 0.4 THEN 1.05 ELSE 0.5 END, 6) AS exposition FROM cells""")
def weighted_exposition(spark, d):
    """Five layers in one wide row, weighted and multiplied in one projection."""
    Settings().check()
    h, w = F.col("h"), F.col("w")
    total = _W["class"] * h + _W["volume"] * w + _W["population"] * h * w + _W["power"] * (1 - h) + _W["census"] * (1 - w)
    return cells(spark, d).select("id", F.round(total * r.urban_multiplier(h, w), 6).alias("exposition"))


@query(f"WITH {CELLS}, {SCEN} SELECT id, scenario, round({CURVE}, 6) AS risk FROM cells, scen")
def elevation_risk_scenarios(spark, d):
    """All scenarios in one plan; the six scenario rows go to every task."""
    return cells(spark, d).crossJoin(scenarios(spark)).select("id", "scenario", F.round(r.elevation_risk(F.col("dem"), F.col("rise"), F.lit(13.5)), 6).alias("risk"))


RIVER = [(0.0, 0.0, 60.0, 8.0), (60.0, 8.0, 99.0, 2.0)]
_SEG = "seg AS (SELECT * FROM (VALUES " + ", ".join(f"({', '.join(f'{v}::DOUBLE' for v in s)})" for s in RIVER) + ") v(px, py, qx, qy))"
_DIST = """dist AS (SELECT id, min(sqrt(power(x - (px + t * (qx - px)), 2) + power(y - (py + t * (qy - py)), 2))) AS distance FROM
 (SELECT id, x, y, px, py, qx, qy, least(1.0, greatest(0.0, ((x - px) * (qx - px) + (y - py) * (qy - py)) / ((qx - px) * (qx - px) + (qy - py) * (qy - py)))) AS t FROM (SELECT id, (col + 0.5)::DOUBLE AS x, (row + 0.5)::DOUBLE AS y FROM cells), seg) GROUP BY 1)"""


def _river_distance(spark, d, limit):
    xy = cells(spark, d).withColumn("x", F.col("col") + F.lit(0.5).cast("double")).withColumn("y", F.col("row") + F.lit(0.5).cast("double"))
    return spatial.distances(xy, spark.createDataFrame(RIVER, "ax double, ay double, bx double, by double"), limit, 8.0)


@query(f"WITH {CELLS}, {_SEG}, {_DIST} SELECT id, CASE WHEN distance <= 0.5 THEN 1.15::DOUBLE WHEN distance <= 2 THEN 1.10::DOUBLE WHEN distance <= 5 THEN 1.05::DOUBLE ELSE 1.0::DOUBLE END AS multiplier FROM dist")
def river_bands(spark, d):
    """Nested distance bands of a river, in hundreds of metres."""
    return _river_distance(spark, d, 5.0).select("id", r.river_band(F.coalesce(F.col("distance") * 100, F.lit(1e9))).alias("multiplier"))


@query(f"WITH {CELLS}, {_SEG}, {_DIST} SELECT id, CASE WHEN distance <= 5 AND land THEN 1.1::DOUBLE ELSE 1.0::DOUBLE END AS multiplier FROM dist JOIN cells USING (id)")
def coast_band(spark, d):
    """A coastline's band on land, in kilometres."""
    return _river_distance(spark, d, 5.0).select("id", r.coast_band(F.coalesce(F.col("distance") * 1000, F.lit(1e9)), F.col("land")).alias("multiplier"))


@query(f"WITH {CELLS}, {_SEG}, {_DIST} SELECT id, round(CASE WHEN distance <= 7.5 THEN greatest(0.6 * exp(-h * 10 / 1.4::DOUBLE), 0.6 * exp(-h * 10 / 6.0::DOUBLE)) ELSE 0.6 * exp(-h * 10 / 1.4::DOUBLE) END, 6) AS risk FROM dist JOIN cells USING (id)")
def river_proximity(spark, d):
    """The slower decay near rivers."""
    near = F.coalesce(F.col("distance") <= 7.5, F.lit(False))
    return _river_distance(spark, d, 7.5).select("id", F.round(r.near_river(0.6 * F.exp(-F.col("h") * 10 / 1.4), 0.6 * F.exp(-F.col("h") * 10 / 6.0), near), 6).alias("risk"))


_LOWHIGH = "lh AS (SELECT min(dem) AS lo, max(dem) AS hi FROM cells WHERE land)"


@query(f"WITH {CELLS}, {_LOWHIGH} SELECT id, round(CASE WHEN land THEN 1 + 0.2 * (1 - (dem - lo) / (hi - lo)) - 0.1 * (dem - lo) / (hi - lo) ELSE 0.0 END, 6) AS factor FROM cells, lh")
def context_adjust(spark, d):
    """By place in the land's elevation range."""
    own = cells(spark, d)
    stats = own.where("land").agg(F.min("dem").alias("lo"), F.max("dem").alias("hi"))
    return normalise.beside(own, stats, None).select("id", F.round(F.when(F.col("land"), r.context(F.col("dem"), F.col("lo"), F.col("hi"))).otherwise(0.0), 6).alias("factor"))


@query(f"""WITH {CELLS}, c AS (SELECT id, zone, h * CASE WHEN w > 0.5 THEN 1.15 ELSE 1.0 END * CASE WHEN land THEN 1.1 ELSE 1.0 END AS v, dem FROM cells),
s AS (SELECT zone, quantile_cont(v, 0.99) AS p FROM c GROUP BY 1) SELECT id, round(CASE WHEN dem > 0 THEN CASE WHEN p > 1 THEN v / p ELSE v END ELSE 0.0 END, 6) AS hazard FROM c JOIN s USING (zone)""")
def hazard_combine(spark, d):
    """Factors multiplied, rescaled by the 99th percentile, masked."""
    own = cells(spark, d).withColumn("v", F.col("h") * F.when(F.col("w") > 0.5, 1.15).otherwise(1.0) * F.when(F.col("land"), 1.1).otherwise(1.0))
    full = normalise.beside(own, normalise.percentiles(own, F.col("v"), {"p": 0.99}, ["zone"]), ["zone"])
    return full.select("id", F.round(F.when(F.col("dem") > 0, F.when(F.col("p") > 1, F.col("v") / F.col("p")).otherwise(F.col("v"))).otherwise(0.0), 6).alias("hazard"))


@query(f"WITH {CELLS} SELECT id, round(CASE WHEN hz > 0 AND w > 0.05 AND land THEN 0.1 * hz + 0.9 * w ELSE 0.0 END, 6) AS risk FROM (SELECT id, w, land, CASE WHEN h > 0.3 THEN h ELSE 0.0 END AS hz FROM cells)")
def risk_integrated(spark, d):
    """R26, P12, P13."""
    hz = F.when(F.col("h") > 0.3, F.col("h")).otherwise(0.0)
    return cells(spark, d).select("id", F.round(r.integrated_risk(hz, F.col("w"), F.col("land")), 6).alias("risk"))


@query(f"WITH {CELLS} SELECT id, round(CASE WHEN h > 0 AND p > 0.01 AND land THEN 0.1 * h + 0.9 * p ELSE 0.0 END, 9) AS risk FROM (SELECT id, h, land, coalesce(CASE WHEN e > 0 THEN e / 10000 END, w) AS p FROM cells)")
def risk_population(spark, d):
    """R27, R30, P14."""
    return cells(spark, d).select("id", F.round(r.population_risk(F.col("h"), F.when(F.col("e") > 0, F.col("e") / 10000), F.col("w"), F.col("land")), 9).alias("risk"))


@query(f"""WITH {CELLS}, {SCEN}, x AS (SELECT id, scenario, {CURVE} AS hz, w, h FROM cells, scen),
i AS (SELECT id, scenario, hz, 'gdp' AS indicator, w AS v FROM x UNION ALL SELECT id, scenario, hz, 'freight', h FROM x UNION ALL SELECT id, scenario, hz, 'combined', (w + h) / 2 FROM x)
SELECT scenario, indicator, count(*) AS n, round(sum(CASE WHEN hz > 0 AND v > 0.05 THEN 0.1 * hz + 0.9 * v ELSE 0.0 END), 3) AS total FROM i GROUP BY 1, 2""")
def risk_matrix(spark, d):
    """Scenarios by indicators in one scan."""
    x = cells(spark, d).crossJoin(scenarios(spark)).withColumn("hz", r.elevation_risk(F.col("dem"), F.col("rise"), F.lit(13.5)))
    values = F.create_map(F.lit("gdp"), F.col("w"), F.lit("freight"), F.col("h"), F.lit("combined"), (F.col("w") + F.col("h")) / 2)
    rows = x.select("scenario", "hz", F.explode(values).alias("indicator", "v"))
    return rows.groupBy("scenario", "indicator").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(r.integrated_risk(F.col("hz"), F.col("v"), F.lit(True))), 3).alias("total"))


@query(f"""WITH {CELLS}, {SCEN}, x AS (SELECT scenario, {CURVE} AS v FROM cells, scen)
SELECT scenario, count(*) * 0.0009::DOUBLE AS total_km2, count(*) FILTER (v > 0.7) AS high, count(*) FILTER (v > 0.3 AND v <= 0.7) AS moderate, count(*) FILTER (v > 0.1 AND v <= 0.3) AS low,
round(100.0::DOUBLE * count(*) FILTER (v > 0.7) / count(*), 4) AS high_percent, round(avg(v), 6) AS mean, round(max(v), 6) AS max FROM x GROUP BY 1""")
def hazard_summary(spark, d):
    """A13, Q13."""
    v = r.elevation_risk(F.col("dem"), F.col("rise"), F.lit(13.5))
    n = lambda c: F.count_if(c)
    x = cells(spark, d).crossJoin(scenarios(spark)).select("scenario", v.alias("v"))
    return x.groupBy("scenario").agg(
        (F.count(F.lit(1)) * 0.0009).alias("total_km2"),
        n(F.col("v") > 0.7).alias("high"),
        n((F.col("v") > 0.3) & (F.col("v") <= 0.7)).alias("moderate"),
        n((F.col("v") > 0.1) & (F.col("v") <= 0.3)).alias("low"),
        F.round(r.percent(n(F.col("v") > 0.7), F.count(F.lit(1))), 4).alias("high_percent"),
        F.round(F.avg("v"), 6).alias("mean"),
        F.round(F.max("v"), 6).alias("max"),
    )


@query(f"""WITH {CELLS}, b AS (SELECT quantile_cont(dem, 0.02) - 30 AS lo, quantile_cont(dem, 0.98) + 100 AS hi FROM cells)
SELECT CAST(floor((dem - lo) / (hi - lo) * 100) AS BIGINT) + 1 AS bin, count(*) AS n FROM cells, b GROUP BY 1""")
def elevation_histogram(spark, d):
    """100 bins between padded percentiles."""
    own = cells(spark, d)
    edge = normalise.percentiles(own, F.col("dem"), {"lo": 0.02, "hi": 0.98}).select((F.col("lo") - 30).alias("lo"), (F.col("hi") + 100).alias("hi"))
    return normalise.beside(own, edge, None).groupBy(F.width_bucket("dem", "lo", "hi", F.lit(100)).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT CASE WHEN v > 0.8 THEN 'very_high' WHEN v > 0.6 THEN 'high' WHEN v > 0.3 THEN 'medium' WHEN v > 0.1 THEN 'low' ELSE 'minimal' END AS class, count(*) AS n FROM (SELECT l_discount * 10 AS v FROM lineitem) GROUP BY 1")
def risk_classes(spark, d):
    """A16."""
    return table(spark, d, "lineitem").groupBy(r.risk_class(F.col("l_discount") * 10).alias("class")).agg(F.count(F.lit(1)).alias("n"))


_IMPACT = f"{CELLS}, {SCEN}, x AS (SELECT scenario, {CURVE} AS hz, e, w FROM cells, scen), i AS (SELECT scenario, hz, 'gdp' AS indicator, e AS v FROM x UNION ALL SELECT scenario, hz, 'freight', w FROM x)"


def _impact(spark, d):
    x = cells(spark, d).crossJoin(scenarios(spark)).withColumn("hz", r.elevation_risk(F.col("dem"), F.col("rise"), F.lit(13.5)))
    return x.select("scenario", "hz", F.explode(F.create_map(F.lit("gdp"), F.col("e"), F.lit("freight"), F.col("w"))).alias("indicator", "v"))


@query(f"""WITH {_IMPACT} SELECT scenario, indicator, round(sum(v), 3) AS total, round(sum(CASE WHEN hz > 0.3 THEN v ELSE 0 END), 3) AS at_risk, round(100 * sum(CASE WHEN hz > 0.3 THEN v ELSE 0 END) / sum(v), 4) AS percent,
round(count(*) FILTER (hz > 0.3) * 0.0009::DOUBLE, 6) AS risk_km2 FROM i GROUP BY 1, 2""")
def impact_metrics(spark, d):
    """Value at risk by scenario and indicator."""
    risky = F.sum(F.when(F.col("hz") > 0.3, F.col("v")).otherwise(0.0))
    return _impact(spark, d).groupBy("scenario", "indicator").agg(
        F.round(F.sum("v"), 3).alias("total"), F.round(risky, 3).alias("at_risk"), F.round(r.percent(risky, F.sum("v")), 4).alias("percent"), F.round(F.count_if(F.col("hz") > 0.3) * 0.0009, 6).alias("risk_km2")
    )


@query(f"WITH {_IMPACT} SELECT scenario, round(sum(v) FILTER (indicator = 'gdp' AND hz > 0.3), 3) AS gdp, round(sum(v) FILTER (indicator = 'freight' AND hz > 0.3), 3) AS freight FROM i GROUP BY 1")
def impact_pivot(spark, d):
    """Indicators side by side."""
    out = _impact(spark, d).groupBy("scenario").pivot("indicator", ["gdp", "freight"]).agg(F.sum(F.when(F.col("hz") > 0.3, F.col("v"))))
    return out.select("scenario", F.round("gdp", 3).alias("gdp"), F.round("freight", 3).alias("freight"))


@query(f"""WITH {CELLS} SELECT zone, count(*) FILTER (h > 0.35) AS pixel_count, round(coalesce(avg(h) FILTER (h > 0.35), 0), 6) AS mean_risk, coalesce(max(h) FILTER (h > 0.35), 0) AS max_risk, count(*) * 900.0::DOUBLE AS area,
round(coalesce(sum(h) FILTER (h > 0.35) / (count(*) * 900.0::DOUBLE), 0), 9) AS density FROM cells GROUP BY 1""")
def zonal_stats(spark, d):
    """A8, A9, J9, C4."""
    own = cells(spark, d).withColumn("v", F.when(F.col("h") > 0.35, F.col("h")).otherwise(0.0))
    return spatial.zonal(own, "zone", "v").select("zone", "pixel_count", F.round("mean_risk", 6).alias("mean_risk"), "max_risk", "area", F.round("density", 9).alias("density"))


@query(f"""WITH {CELLS}, {SCEN}, x AS (SELECT scenario, {CURVE} AS v FROM cells, scen WHERE land)
SELECT scenario, round(100.0::DOUBLE * count(*) FILTER (v > 0.3) / count(*), 4) AS percent, round(count(*) FILTER (v > 0.3) * 0.0009::DOUBLE, 6) AS km2 FROM x GROUP BY 1""")
def flood_coverage(spark, d):
    """A32."""
    x = cells(spark, d).where("land").crossJoin(scenarios(spark)).select("scenario", r.elevation_risk(F.col("dem"), F.col("rise"), F.lit(13.5)).alias("v"))
    return x.groupBy("scenario").agg(F.round(r.percent(F.count_if(F.col("v") > 0.3), F.count(F.lit(1))), 4).alias("percent"), F.round(F.count_if(F.col("v") > 0.3) * 0.0009, 6).alias("km2"))


_GRID = "g AS (SELECT row, col, h AS v FROM cells), hh AS (SELECT max(row) + 1 AS rows FROM g)"


def grid(spark, d):
    return cells(spark, d).select("row", "col", F.col("h").alias("v"))


def height(df):
    return (df.agg(F.max("row")).first()[0] or 0) + 1


_TAPS = "taps AS (SELECT d, exp(-0.5 * d * d) / (SELECT sum(exp(-0.5 * k * k)) FROM range(-4, 5) t(k)) AS w FROM range(-4, 5) s(d))"
#: Over the whole rectangle: cells that aren't there are 0, and the mirrored edges repeat as often as the radius asks.
_GSQL = """f AS (SELECT x.r AS row, y.c AS col, coalesce(g.v, 0.0::DOUBLE) AS v FROM (SELECT unnest(range(0, rows)) AS r FROM hh) x CROSS JOIN range(0, 100) y(c) LEFT JOIN g ON g.row = x.r AND g.col = y.c),
p1 AS (SELECT a.row, a.col, sum(w * b.v) AS v FROM f a CROSS JOIN taps JOIN f b ON b.row = a.row AND b.col = CASE WHEN (a.col + d + 200) % 200 >= 100 THEN 199 - (a.col + d + 200) % 200 ELSE (a.col + d + 200) % 200 END GROUP BY 1, 2),
m AS (SELECT a.row, a.col, w, (a.row + d + 8 * rows) % (2 * rows) AS q, rows FROM p1 a CROSS JOIN taps CROSS JOIN hh),
p2 AS (SELECT m.row, m.col, sum(w * b.v) AS v FROM m JOIN p1 b ON b.col = m.col AND b.row = CASE WHEN q >= m.rows THEN 2 * m.rows - 1 - q ELSE q END GROUP BY 1, 2)"""


@query(f"WITH {CELLS}, {_GRID}, {_TAPS}, {_GSQL} SELECT g.row, g.col, round(p2.v, 6) AS smooth FROM g JOIN p2 ON g.row = p2.row AND g.col = p2.col")
def gaussian_smooth(spark, d):
    """R5."""
    g = grid(spark, d)
    return raster.gaussian(g, "v", height(g), COLS).select("row", "col", F.round("smooth", 6).alias("smooth"))


@query(f"""WITH {CELLS}, {_GRID}, k AS (SELECT * FROM (VALUES (0, 0), (0, 1), (1, 0), (0, -1), (-1, 0)) v(r, c)), m AS (SELECT row, col FROM g WHERE v > 0.6),
dl AS (SELECT DISTINCT row + r AS row, col + c AS col FROM m, k, hh WHERE row + r BETWEEN 0 AND rows - 1 AND col + c BETWEEN 0 AND 99),
er AS (SELECT g.row, g.col, bool_and(NOT (g.row + r BETWEEN 0 AND rows - 1 AND g.col + c BETWEEN 0 AND 99) OR dl.row IS NOT NULL) AS closed FROM g CROSS JOIN k CROSS JOIN hh LEFT JOIN dl ON dl.row = g.row + r AND dl.col = g.col + c GROUP BY 1, 2) SELECT row, col, closed FROM er""")
def binary_closing(spark, d):
    """R6 with a disk of radius 1."""
    own = grid(spark, d).withColumn("m", F.col("v") > 0.6)
    return raster.closing(own, "m", height(own), COLS, 1, tile=32)


_CLOSED = """k AS (SELECT r, c FROM range(-12, 13) s(r), range(-12, 13) t(c) WHERE r * r + c * c <= 144), m AS (SELECT row, col FROM g WHERE v > 0.995),
dl AS (SELECT DISTINCT row + r AS row, col + c AS col FROM m, k, hh WHERE row + r BETWEEN 0 AND rows - 1 AND col + c BETWEEN 0 AND 99),
er AS (SELECT g.row, g.col, bool_and(NOT (g.row + r BETWEEN 0 AND rows - 1 AND g.col + c BETWEEN 0 AND 99) OR dl.row IS NOT NULL) AS closed FROM g CROSS JOIN k CROSS JOIN hh LEFT JOIN dl ON dl.row = g.row + r AND dl.col = g.col + c GROUP BY 1, 2)"""


def _closed(spark, d):
    own = grid(spark, d).withColumn("m", F.col("v") > 0.995)
    return raster.closing(own, "m", height(own), COLS, 12, tile=32), height(own)


@query(f"WITH {CELLS}, {_GRID}, {_CLOSED} SELECT row, col, closed FROM er")
def closing_of_radius_12(spark, d):
    """R6 with the least radius that outlines use."""
    return _closed(spark, d)[0]


@query(f"""WITH {CELLS}, {_GRID}, {_CLOSED}, taps AS (SELECT d, exp(-0.5 * d * d / 36) / (SELECT sum(exp(-0.5 * k * k / 36)) FROM range(-24, 25) t(k)) AS w FROM range(-24, 25) s(d)),
f AS (SELECT x.r AS row, y.c AS col, CASE WHEN er.closed THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS v FROM (SELECT unnest(range(0, rows)) AS r FROM hh) x CROSS JOIN range(0, 100) y(c) LEFT JOIN er ON er.row = x.r AND er.col = y.c),
p1 AS (SELECT a.row, a.col, sum(w * b.v) AS v FROM f a CROSS JOIN taps JOIN f b ON b.row = a.row AND b.col = least(greatest(a.col + d, 0), 99) GROUP BY 1, 2),
p2 AS (SELECT a.row, a.col, sum(w * b.v) AS v FROM p1 a CROSS JOIN taps CROSS JOIN hh JOIN p1 b ON b.col = a.col AND b.row = least(greatest(a.row + d, 0), rows - 1) GROUP BY 1, 2)
SELECT er.row, er.col, round(p2.v, 6) AS smooth, p2.v >= 0.5 AS inside FROM er JOIN p2 ON er.row = p2.row AND er.col = p2.col""")
def closed_mask_smoothed(spark, d):
    """Gaussian of half the radius over the closed mask with the edges going on, cut at a half."""
    mask, rows = _closed(spark, d)
    smooth = raster.gaussian(mask.withColumn("v", F.col("closed").cast("double")), "v", rows, COLS, 6.0, "nearest", tile=32)
    return smooth.select("row", "col", F.round("smooth", 6).alias("smooth"), (F.col("smooth") >= 0.5).alias("inside"))


_TARGETS = "tg AS (SELECT r AS row, c AS col FROM hh, range(0, 66) b(c), LATERAL (SELECT unnest(range(0, CAST(floor(rows / 1.5) AS BIGINT))) AS r) a)"


def targets(spark, source):
    return spark.range(int(height(source) / 1.5) * 66).select(F.floor(F.col("id") / 66).cast("int").alias("row"), (F.col("id") % 66).cast("int").alias("col"))


@query(f"WITH {CELLS}, {_GRID}, {_TARGETS} SELECT CAST(tg.row AS INTEGER) AS row, CAST(tg.col AS INTEGER) AS col, g.v FROM tg LEFT JOIN g ON g.row = CAST(floor((tg.row + 0.5) * 1.5) AS INTEGER) AND g.col = CAST(floor((tg.col + 0.5) * 1.5) AS INTEGER)")
def nearest_resample(spark, d):
    """R1, J11."""
    return raster.nearest(grid(spark, d), "v", targets(spark, grid(spark, d)), 1.5)


@query(f"""WITH {CELLS}, {_GRID}, {_TARGETS}, a AS (SELECT row, col, (row + 0.5::DOUBLE) * 1.5 - 0.5 AS y, (col + 0.5::DOUBLE) * 1.5 - 0.5 AS x FROM tg), k AS (SELECT * FROM (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) v(r, c)),
j AS (SELECT a.row, a.col, sum(w * g.v) / sum(w) AS v FROM (SELECT a.*, r, c, (CASE WHEN r = 1 THEN y - floor(y) ELSE 1 - (y - floor(y)) END) * (CASE WHEN c = 1 THEN x - floor(x) ELSE 1 - (x - floor(x)) END) AS w FROM a, k) a
JOIN g ON g.row = floor(y) + r AND g.col = floor(x) + c GROUP BY 1, 2) SELECT CAST(tg.row AS INTEGER) AS row, CAST(tg.col AS INTEGER) AS col, round(v, 6) AS v FROM tg LEFT JOIN j USING (row, col)""")
def bilinear_resample(spark, d):
    """R2, S2."""
    return raster.bilinear(grid(spark, d), "v", targets(spark, grid(spark, d)), 1.5).select("row", "col", F.round("v", 6).alias("v"))


@query(f"WITH {CELLS}, {_GRID} SELECT CAST(row * 3 + a AS INTEGER) AS row, CAST(col * 3 + b AS INTEGER) AS col, round(v / 9, 9) AS v FROM g, range(0, 3) s(a), range(0, 3) t(b)")
def sum_resample(spark, d):
    """Mass kept on a finer grid."""
    return raster.split_sum(grid(spark, d), "v", 3).select("row", "col", F.round("v", 9).alias("v"))


@query(f"WITH {CELLS}, {_GRID} SELECT CAST(level AS INTEGER) AS level, CAST(row // level AS INTEGER) AS row, CAST(col // level AS INTEGER) AS col, round(avg(v), 6) AS v FROM g, (VALUES (2), (4), (8)) l(level) GROUP BY 1, 2, 3")
def overview_pyramid(spark, d):
    """R8, K3."""
    return raster.pyramid(grid(spark, d), "v", [2, 4, 8]).select("level", "row", "col", F.round("v", 6).alias("v"))


@query(f"""WITH {CELLS}, {_GRID} SELECT CAST(row // 4 AS INTEGER) AS row, CAST(col // 4 AS INTEGER) AS col, round(quantile_cont(v, 0.5), 6) AS med, round(quantile_cont(v, 0.25), 6) AS q1, round(quantile_cont(v, 0.75), 6) AS q3, min(v) AS min, max(v) AS max, round(sqrt(avg(v * v)), 6) AS rms FROM g GROUP BY 1, 2""")
def coarser_reducers(spark, d):
    """R3b."""
    out = raster.coarser(grid(spark, d), "v", 4, ["med", "q1", "q3", "min", "max", "rms"])
    return out.select("row", "col", *(F.round(c, 6).alias(c) for c in ("med", "q1", "q3")), "min", "max", F.round("rms", 6).alias("rms"))


SHAPES = [(1, [(0.0, 0.0), (40.0, 0.0), (0.0, 14.0)]), (2, [(10.0, 2.0), (30.0, 2.0), (30.0, 9.0), (10.0, 9.0)]), (3, [(60.0, 1.0), (90.0, 7.0), (60.0, 13.0)])]


def shapes(spark):
    return spark.createDataFrame(SHAPES, "seq int, ring array<struct<x:double,y:double>>").withColumn("value", F.col("seq") * 10.0)


@query(f"""WITH {CELLS}, c AS (SELECT id, (col + 0.5)::DOUBLE AS x, (row + 0.5)::DOUBLE AS y FROM cells)
SELECT id, CASE WHEN x > 60 AND y > 1 + (x - 60) * 0.2 AND y < 13 - (x - 60) * 0.2 THEN 30.0::DOUBLE WHEN x > 10 AND x < 30 AND y > 2 AND y < 9 THEN 20.0::DOUBLE WHEN x > 0 AND y > 0 AND y < 14 - x * 0.35 THEN 10.0::DOUBLE END AS burned FROM c""")
def point_in_polygon(spark, d):
    """Cells burned by shapes, the last one wins."""
    xy = cells(spark, d).select("id", "row", "col", (F.col("col") + F.lit(0.5).cast("double")).alias("x"), (F.col("row") + F.lit(0.5).cast("double")).alias("y"))
    return spatial.rasterise(xy, shapes(spark), "ring", "value", "seq", 8.0).select("id", "burned")


def order_rings(spark, d):
    """Each order's items as the corners (quantity, price) of a ring."""
    point = F.struct(F.col("l_linenumber").alias("k"), F.col("l_quantity").cast("double").alias("x"), F.col("l_extendedprice").cast("double").alias("y"))
    ring = F.transform(F.array_sort(F.collect_list(point)), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    return table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(ring.alias("ring"))


@query("""WITH p AS (SELECT l_orderkey AS id, l_quantity::DOUBLE AS x, l_extendedprice::DOUBLE AS y, row_number() OVER w AS k, first_value(l_quantity::DOUBLE) OVER w AS fx, first_value(l_extendedprice::DOUBLE) OVER w AS fy,
lead(l_quantity::DOUBLE) OVER w AS nx, lead(l_extendedprice::DOUBLE) OVER w AS ny FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_extendedprice))
SELECT id, round(abs(sum(x * coalesce(ny, fy) - coalesce(nx, fx) * y)) / 2, 3) AS area FROM p GROUP BY 1""")
def polygon_area(spark, d):
    """Areas of rings of items."""
    return order_rings(spark, d).select("id", F.round(spatial.area("ring"), 3).alias("area"))


@query("""SELECT round(min(x) - 0.01 * (max(x) - min(x)), 6) AS min_x, round(min(y) - 0.01 * (max(y) - min(y)), 6) AS min_y, round(max(x) + 0.01 * (max(x) - min(x)), 6) AS max_x, round(max(y) + 0.01 * (max(y) - min(y)), 6) AS max_y FROM (SELECT l_quantity::DOUBLE AS x, l_extendedprice::DOUBLE AS y FROM lineitem)""")
def bbox_total(spark, d):
    """The extent of all rings, grown by a hundredth."""
    box = spatial.total_bounds(order_rings(spark, d).select(*spatial.bounds("ring")), 0.01)
    return box.select(*(F.round(c, 6).alias(c) for c in box.columns))


@query(f"""WITH {CELLS}, m AS (SELECT row, col FROM cells WHERE h > 0.98), k AS (SELECT a AS r, b AS c FROM range(-2, 3) s(a), range(-2, 3) t(b) WHERE a * a + b * b <= 4)
SELECT DISTINCT cells.row, cells.col FROM cells JOIN (SELECT row + r AS row, col + c AS col FROM m, k) b ON b.row = cells.row AND b.col = cells.col WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.row = cells.row AND m.col = cells.col)""")
def buffer_minus_port(spark, d):
    """Cells near ports without the ports."""
    own = cells(spark, d).select("row", "col", "h")
    port = own.where("h > 0.98").select("row", "col")
    around = F.explode(F.array(*(F.struct(F.lit(a).alias("r"), F.lit(b).alias("c")) for a, b in raster.disk(2))))
    buffered = port.withColumn("s", around).select((F.col("row") + F.col("s.r")).alias("row"), (F.col("col") + F.col("s.c")).alias("col")).distinct()
    return own.select("row", "col").join(buffered, ["row", "col"], "left_semi").join(port, ["row", "col"], "left_anti")


_STOPS = [(0.0, "#0000ff"), (0.5, "#ffff00"), (1.0, "#ff0000")]


@query(f"""WITH {CELLS}, p AS (SELECT id, h, least(1.0, greatest(0.0, (h - 0.1::DOUBLE) / (0.9::DOUBLE - 0.1::DOUBLE))) AS p FROM cells),
q AS (SELECT id, h, CASE WHEN p <= 0 THEN 0.0 WHEN p <= 0.5 THEN p / 0.5 * 255 ELSE 255 + 0 * p END AS r, CASE WHEN p <= 0.5 THEN p / 0.5 * 255 ELSE 255 + (p - 0.5) / 0.5 * -255 END AS g, CASE WHEN p <= 0.5 THEN 255 + p / 0.5 * -255 ELSE 0.0 END AS b FROM p)
SELECT id, CASE WHEN h <> 0 THEN printf('#%02x%02x%02x', CAST(floor(r + 0.5) AS INTEGER), CAST(floor(g + 0.5) AS INTEGER), CAST(floor(b + 0.5) AS INTEGER)) END AS colour FROM q""")
def colour_ramp(spark, d):
    """F18, R32."""
    return cells(spark, d).select("id", r.colour(F.col("h"), 0.1, 0.9, _STOPS).alias("colour"))


@query(f"WITH {CELLS} SELECT id, CASE WHEN dem < 0 THEN 0 WHEN land THEN 2 ELSE 1 END AS zone_class FROM cells")
def zone_classes(spark, d):
    """R29."""
    return cells(spark, d).select("id", r.zone_class(F.col("dem") < 0, F.col("land")).alias("zone_class"))


@query("""WITH RECURSIVE p AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings), n AS (SELECT a.id, b.id AS other FROM p a JOIN p b ON sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) <= 0.02),
core AS (SELECT id FROM n GROUP BY id HAVING count(*) >= 4), e AS (SELECT n.id, n.other FROM n WHERE n.id IN (SELECT id FROM core) AND n.other IN (SELECT id FROM core) AND n.id <> n.other),
reach(id, root) AS (SELECT id, id FROM core UNION SELECT e.other, reach.root FROM reach JOIN e ON e.id = reach.id), lab AS (SELECT id, min(root) AS label FROM reach GROUP BY 1),
border AS (SELECT n.id, arg_min(label, n.other) AS label FROM n JOIN lab ON lab.id = n.other WHERE n.id NOT IN (SELECT id FROM core) GROUP BY 1)
SELECT p.id, coalesce(lab.label, border.label, -1) AS cluster FROM p LEFT JOIN lab ON lab.id = p.id LEFT JOIN border ON border.id = p.id""")
def dbscan_clusters(spark, d):
    """Points from the first two dimensions of the embeddings; noise is -1."""
    points = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.element_at("embedding", 1).cast("double").alias("x"), F.element_at("embedding", 2).cast("double").alias("y"))
    return clusters.dbscan(points, 0.02, 4).na.fill(-1)


def _risk_clusters(spark, d):
    hot = cells(spark, d).where("h > 0.35").select("row", "col", "h")
    found = clusters.connected_cells(hot)
    return hot.join(found, ["row", "col"]).groupBy("cluster").agg(F.count(F.lit(1)).alias("pixel_count"), F.avg("h").alias("mean_risk"), F.max("h").alias("max_risk"), (F.count(F.lit(1)) * 900.0).alias("area"))


@query(f"""WITH RECURSIVE {CELLS}, hot AS (SELECT row, col, h, row::BIGINT * 4294967296 + col AS id FROM cells WHERE h > 0.35),
e AS (SELECT a.id, b.id AS other FROM hot a JOIN hot b ON abs(a.row - b.row) + abs(a.col - b.col) = 1 AND b.row BETWEEN a.row - 1 AND a.row + 1), reach(id, root) AS (SELECT id, id FROM hot UNION SELECT e.other, reach.root FROM reach JOIN e ON e.id = reach.id),
lab AS (SELECT id, min(root) AS cluster FROM reach GROUP BY 1), t AS (SELECT cluster, count(*) AS pixel_count, avg(h) AS mean_risk, max(h) AS max_risk, count(*) * 900.0::DOUBLE AS area FROM hot JOIN lab ON lab.id = hot.id GROUP BY 1)
SELECT CAST(row_number() OVER (ORDER BY cluster) - 1 AS INTEGER) AS risk_cluster_id, pixel_count, round(mean_risk, 6) AS mean_risk, max_risk, area FROM t WHERE area >= 2700""")
def cluster_table(spark, d):
    """Connected groups of cells over the threshold, numbered."""
    out = clusters.numbered(_risk_clusters(spark, d), 2700.0, ["cluster"])
    return out.select("risk_cluster_id", "pixel_count", F.round("mean_risk", 6).alias("mean_risk"), "max_risk", "area")


@query(f"""WITH RECURSIVE {CELLS}, hot AS (SELECT row, col, h, row::BIGINT * 4294967296 + col AS id FROM cells WHERE h > 0.35),
e AS (SELECT a.id, b.id AS other FROM hot a JOIN hot b ON abs(a.row - b.row) + abs(a.col - b.col) = 1 AND b.row BETWEEN a.row - 1 AND a.row + 1), reach(id, root) AS (SELECT id, id FROM hot UNION SELECT e.other, reach.root FROM reach JOIN e ON e.id = reach.id),
lab AS (SELECT id, min(root) AS cluster FROM reach GROUP BY 1), t AS (SELECT cluster, count(*) AS pixel_count, avg(h) AS mean_risk, max(h) AS max_risk, count(*) * 900.0::DOUBLE AS area FROM hot JOIN lab ON lab.id = hot.id GROUP BY 1)
SELECT 'gdp' AS file, count(*) AS n_clusters, round(sum(area) / 1e6, 6) AS total_km2, round(avg(area), 3) AS mean_area, max(area) AS max_area, round(avg(mean_risk), 6) AS mean_risk, max(max_risk) AS max_risk, CAST(sum(pixel_count) AS BIGINT) AS pixels FROM t""")
def cluster_summary(spark, d):
    """A15."""
    out = clusters.summary(_risk_clusters(spark, d).withColumn("file", F.lit("gdp")), "file")
    return out.select("file", "n_clusters", F.round("total_km2", 6).alias("total_km2"), F.round("mean_area", 3).alias("mean_area"), "max_area", F.round("mean_risk", 6).alias("mean_risk"), "max_risk", "pixels")
