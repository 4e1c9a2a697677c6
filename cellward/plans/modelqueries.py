"""The composed steps over the star tables, each against SQL of its own that repeats no constant of the code."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellward.operators import model
from cellward.plans.gridqueries import CELLS, COLS, SCEN, cells, height, scenarios

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    """Registers a query and the SQL that checks it."""

    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def _scaled(source: str, value: str, mask: str, by: str, kind: str) -> str:
    """SQL for the columns of a table with ``out``: value rescaled under the mask, by the rules of a kind."""
    preserve, boost, ceiling, floor = {"hazard": (True, False, 0.95, 0.05), "exposition": (False, True, 1.0, 0.01), "economic": (True, True, 1.0, 0.01), "risk": (False, True, 1.0, 0.01), "full": (False, True, 1.0, 0.001)}[kind]
    low = ("CASE WHEN top < 0.8 THEN v * 0.9 / top ELSE v END" if boost else "v") if preserve else ("CASE WHEN top < 0.95 THEN v / top ELSE v END" if boost else "v")
    group = f"GROUP BY {by}" if by else ""
    join = f"JOIN s USING ({by})" if by else "CROSS JOIN s"
    return f"""(WITH x AS (SELECT *, CASE WHEN {mask} THEN ({value})::DOUBLE END AS v FROM {source}), s AS (SELECT {by + ", " if by else ""}max(v) AS top, quantile_cont(v, 0.99) AS p99 FROM x {group}),
y AS (SELECT *, CASE WHEN v IS NULL THEN NULL WHEN NOT top > 0 THEN {floor} WHEN top > 1 THEN CASE WHEN p99 > {ceiling} THEN v * {ceiling} / p99 ELSE least(v, 1.0) END ELSE {low} END AS o FROM x {join})
SELECT * EXCLUDE (v, top, p99, o), CASE WHEN v IS NULL THEN 0.0::DOUBLE ELSE greatest(CASE WHEN o > {ceiling} THEN {ceiling} + 0.02 * tanh((o - {ceiling}) / 0.1) ELSE o END, {floor})::DOUBLE END AS out FROM y)"""


def _smoothed(source: str, value: str, by: str) -> str:
    """SQL for (by, row, col, smooth): Gaussian of sigma 1 over the whole rectangle with mirrored edges."""
    return f"""(WITH taps AS (SELECT d, exp(-0.5 * d * d) / (SELECT sum(exp(-0.5 * k * k)) FROM range(-4, 5) t(k)) AS w FROM range(-4, 5) s(d)), h AS (SELECT max(row) + 1 AS rows FROM cells),
f AS (SELECT b.{by}, x.r AS row, y.c AS col, coalesce(g.v, 0.0)::DOUBLE AS v FROM (SELECT DISTINCT {by} FROM {source}) b CROSS JOIN (SELECT unnest(range(0, rows)) AS r FROM h) x CROSS JOIN range(0, 100) y(c) LEFT JOIN (SELECT {by}, row, col, {value} AS v FROM {source}) g ON g.{by} = b.{by} AND g.row = x.r AND g.col = y.c),
p AS (SELECT a.{by}, a.row, a.col, sum(w * b.v) AS v FROM f a CROSS JOIN taps JOIN f b ON a.{by} = b.{by} AND b.row = a.row AND b.col = CASE WHEN (a.col + d + 200) % 200 >= 100 THEN 199 - (a.col + d + 200) % 200 ELSE (a.col + d + 200) % 200 END GROUP BY 1, 2, 3),
m AS (SELECT p.{by}, p.row, p.col, w, (p.row + d + 8 * rows) % (2 * rows) AS q, rows FROM p CROSS JOIN taps CROSS JOIN h)
SELECT m.{by}, m.row, m.col, sum(w * p.v) AS smooth FROM m JOIN p ON p.{by} = m.{by} AND p.col = m.col AND p.row = CASE WHEN q >= rows THEN 2 * rows - 1 - q ELSE q END GROUP BY 1, 2, 3)"""


def _model_cells(spark, d):
    """cells with what the model takes: a zone for all but every eleventh, distances from columns, no elevation in every 17th."""
    own = cells(spark, d)
    return own.select(
        "id", "row", "col", "zone", "land", "e", "h", "w", F.when(F.col("id") % 17 != 0, F.col("dem")).alias("dem"), (F.col("id") % 11 != 0).alias("zoned"), (F.col("col") * 20.0).alias("river"),
        F.when(F.col("col") < 60, F.col("col") * 20.0).alias("big_river"), F.when(F.col("row") < 10, F.col("row") * 900.0).alias("coast"),
    )


_MODEL = f"""{CELLS}, mc AS (SELECT id, row, col, zone, land, e, h, w, CASE WHEN id % 17 <> 0 THEN dem END AS dem, id % 11 <> 0 AS zoned, col * 20.0::DOUBLE AS river, CASE WHEN col < 60 THEN col * 20.0::DOUBLE END AS big_river,
CASE WHEN row < 10 THEN row * 900.0::DOUBLE END AS coast, (id % 17 <> 0 AND land AND id % 11 <> 0) AS study FROM cells)"""


def _curve(decay: float) -> str:
    return f"""CASE WHEN dem > 25 THEN 0.001 + 0.009 * exp(-(dem - 25) / 10) WHEN dem - rise <= 0 THEN 0.8 + 0.19 * (1 - exp(-abs(dem - rise) / 2)) WHEN dem - rise <= reach THEN 0.6 * exp(-(dem - rise) / {decay}::DOUBLE)
ELSE 0.05 + 0.1 * exp(-(dem - rise - reach) / 5) END"""


_HAZARD = f"""{_MODEL}, {SCEN}, lh AS (SELECT min(dem) AS lo, max(dem) AS hi, greatest(10.0, 0.3 * (max(dem) - min(dem))) AS reach FROM mc WHERE study),
c AS (SELECT scenario, row, col, study, CASE WHEN study THEN CASE WHEN big_river <= 750 THEN greatest({_curve(1.4)}, {_curve(6.0)}) ELSE {_curve(1.4)} END * (1 + 0.2 * (1 - (dem - lo) / (hi - lo)) - 0.1 * (dem - lo) / (hi - lo))
* CASE WHEN river <= 50 THEN 1.15 WHEN river <= 200 THEN 1.10 WHEN river <= 500 THEN 1.05 ELSE 1.0 END * CASE WHEN coast <= 5000 AND land THEN 1.1 ELSE 1.0 END END AS v FROM mc CROSS JOIN scen CROSS JOIN lh),
t AS (SELECT scenario, quantile_cont(v, 0.99) AS p FROM c GROUP BY 1), u AS (SELECT scenario, row, col, study, coalesce(CASE WHEN p > 1 THEN v / p ELSE v END, 0.0) AS v FROM c JOIN t USING (scenario)),
sm AS {_smoothed("u", "v", "scenario")}, j AS (SELECT u.scenario, u.row, u.col, study, smooth FROM u JOIN sm ON u.scenario = sm.scenario AND u.row = sm.row AND u.col = sm.col),
hz AS (SELECT scenario, row, col, out AS hazard FROM {_scaled("j", "smooth", "study", "scenario", "hazard")})"""


def _hazard(spark, d):
    own = _model_cells(spark, d)
    return model.hazard(own, scenarios(spark), height(own), COLS, tile=32)


@query(f"WITH {_HAZARD} SELECT scenario, row, col, round(hazard, 5) AS hazard FROM hz")
def hazard_end_to_end(spark, d):
    """R9 to R13, R5 and N1 in one plan for all scenarios."""
    return _hazard(spark, d).withColumn("hazard", F.round("hazard", 5))


_LAYERS = ("class", "volume", "population", "power", "census")
_VALUES = {"class": "h", "volume": "w * 2", "population": "e / 50", "power": "1 - h", "census": "CASE WHEN id % 5 > 0 THEN w * h END"}


def _exposed_cells(spark, d):
    own = _model_cells(spark, d)
    urban = F.when(F.col("h") >= 0.6, 1.15).when(F.col("h") >= 0.4, 1.05).otherwise(0.5)
    port = F.when(F.col("id") % 23 == 0, 1.15).when(F.col("id") % 23 < 4, 1.05).otherwise(1.0)
    study = (F.col("id") % 17 != 0) & F.col("land") & F.col("zoned")
    return own.select("id", "row", "col", "zone", "land", study.alias("study"), urban.alias("urban"), port.alias("port"), *(F.expr(v).alias(k) for k, v in _VALUES.items()))


_EXPOSITION = f"""{_MODEL}, l0 AS (SELECT id, row, col, zone, land, study, CASE WHEN h >= 0.6 THEN 1.15::DOUBLE WHEN h >= 0.4 THEN 1.05::DOUBLE ELSE 0.5::DOUBLE END AS urban,
CASE WHEN id % 23 = 0 THEN 1.15::DOUBLE WHEN id % 23 < 4 THEN 1.05::DOUBLE ELSE 1.0::DOUBLE END AS port, {", ".join(f"{v} AS {k}" for k, v in _VALUES.items())} FROM mc),
""" + ",\n".join(f"l{i + 1} AS (SELECT * EXCLUDE (out), out AS n_{name} FROM {_scaled(f'l{i}', name, f'{name} IS NOT NULL', '', 'exposition')})" for i, name in enumerate(_LAYERS)) + """,
w(use, w1, w2, w3, w4, w5) AS (VALUES ('exposition', 0.30, 0.30, 0.13, 0.12, 0.15), ('gdp', 0.25, 0.34, 0.13, 0.18, 0.10), ('freight', 0.32, 0.34, 0.06, 0.18, 0.10), ('hrst', 0.27, 0.36, 0.09, 0.18, 0.10)),
us AS (SELECT use, row, col, study, (w1 * n_class + w2 * n_volume + w3 * n_population + w4 * n_power + w5 * n_census) * urban * port AS v FROM l5 CROSS JOIN w),
es AS """ + _smoothed("us", "v", "use") + """, ej AS (SELECT us.use, us.row, us.col, CASE WHEN study THEN smooth ELSE 0.0 END AS smooth FROM us JOIN es ON us.use = es.use AND us.row = es.row AND us.col = es.col),
ex AS (SELECT use, row, col, out AS exposition FROM """ + _scaled("ej", "smooth", "smooth > 0", "use", "full") + ")"


def _exposition(spark, d):
    own = _exposed_cells(spark, d)
    return own, model.exposition(own, height(own), COLS, tile=32)


@query(f"WITH {_EXPOSITION} SELECT use, row, col, round(exposition, 5) AS exposition FROM ex")
def exposition_end_to_end(spark, d):
    """Five rescaled layers, weights by use, both multipliers, smoothing, full range."""
    return _exposition(spark, d)[1].withColumn("exposition", F.round("exposition", 5))


@query("""WITH a AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 6 > 0 THEN greatest(c_acctbal, 0.0) END AS i, c_nationkey::DOUBLE / 30 AS k, 7.0::DOUBLE AS p FROM customer), b AS (SELECT id, coalesce(i, 0.0)::DOUBLE AS i, k::DOUBLE AS k, p FROM a),
n1 AS (SELECT * EXCLUDE (out), out AS n1 FROM """ + _scaled("b", "i", "i > 0", "", "exposition") + "), n2 AS (SELECT * EXCLUDE (out), out AS n2 FROM " + _scaled("n1", "k", "k > 0", "", "exposition") + ") SELECT id, round(1.05 * n1 + 1.05 * n2, 5) AS census FROM n2")
def census_index(spark, d):
    """The third attribute is constant, so it adds nothing."""
    own = cells(spark, d).select("id", F.when(F.col("id") % 6 > 0, F.col("e")).alias("inhabitants"), (F.col("zone") / 30.0).alias("household"), F.lit(7.0).alias("price"))
    return model.census(own, ("inhabitants", "household", "price")).select("id", F.round("census", 5).alias("census"))


_RELEVANCE = f"""{_EXPOSITION}, ez AS (SELECT ex.*, zone, land, id FROM ex JOIN mc USING (row, col) WHERE use <> 'exposition'), zs AS (SELECT use, zone, sum(exposition) AS se, count(*) AS n FROM ez GROUP BY 1, 2),
rv AS (SELECT use, row, col, CASE WHEN se > 0 THEN exposition / se ELSE 1.0 / n END * (zone + 1) * CASE use WHEN 'gdp' THEN 100 WHEN 'freight' THEN 7 ELSE 1 END + CASE WHEN use = 'freight' AND id % 50 = 0 THEN 2.5 ELSE 0 END AS value FROM ez JOIN zs USING (use, zone)),
r1 AS (SELECT use AS indicator, row, col, out AS relevance FROM {_scaled("rv", "value", "value > 0", "use", "economic")}), r2 AS (SELECT row, col, avg(out) AS relevance FROM {_scaled("r1", "relevance", "relevance > 0", "indicator", "economic")} GROUP BY 1, 2),
rl AS (SELECT indicator, row, col, relevance FROM r1 UNION ALL SELECT 'combined', row, col, relevance FROM r2)"""


def _relevance(spark, d):
    own, exposed = _exposition(spark, d)
    exposed = exposed.where("use <> 'exposition'").join(own.select("row", "col", "zone"), ["row", "col"])
    uses = spark.createDataFrame([("gdp", 100.0), ("freight", 7.0), ("hrst", 1.0)], "use string, factor double")
    totals = own.select("zone").distinct().crossJoin(F.broadcast(uses)).select("use", "zone", ((F.col("zone") + 1) * F.col("factor")).alias("total"))
    added = own.where("id % 50 = 0").select(F.lit("freight").alias("use"), "row", "col", F.lit(2.5).alias("added"))
    return own, model.relevance(exposed, totals, added)


@query(f"WITH {_RELEVANCE} SELECT indicator, row, col, round(relevance, 5) AS relevance FROM rl")
def relevance_end_to_end(spark, d):
    """R23, R24, R30's rescaling: shares by exposition, single cells' own values, N3, and the mean of the layers rescaled again."""
    return _relevance(spark, d)[1].withColumn("relevance", F.round("relevance", 5))


_RISK = f"""{_RELEVANCE}, {_HAZARD.removeprefix(_MODEL + ", ")}, k AS (SELECT scenario, indicator, row, col, CASE WHEN hazard > 0.3 THEN hazard ELSE 0.0 END AS hazard, relevance, land FROM hz JOIN rl USING (row, col) JOIN mc USING (row, col)),
kr AS (SELECT scenario || '|' || indicator AS layer, scenario, indicator, row, col, hazard > 0 AND relevance > 0.05 AND land AS inside, 0.1 * hazard + 0.9 * relevance AS v0 FROM k)"""


@query(f"WITH {_RISK} SELECT scenario, indicator, count(*) AS n, count(*) FILTER (out > 0) AS n_risk, round(sum(out), 2) AS total, round(max(out), 4) AS top FROM {_scaled('kr', 'v0', 'inside', 'layer', 'risk')} GROUP BY 1, 2")
def risk_end_to_end(spark, d):
    """All scenarios by all indicators with their mean, from the hazard and relevance queries."""
    own, relevances = _relevance(spark, d)
    out = model.risk(_hazard(spark, d), relevances, own.select("row", "col", "land"))
    return out.groupBy("scenario", "indicator").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("risk") > 0).alias("n_risk"), F.round(F.sum("risk"), 2).alias("total"), F.round(F.max("risk"), 4).alias("top"))
