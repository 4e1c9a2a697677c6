"""The assessment from end to end: hazard by scenario, exposition by use, relevance by indicator, and risk.

Layers are columns of one cell table; variants (scenarios, uses, indicators) are rows beside a key column, so each
step is one plan for all of them.  Steps that need a whole layer are aggregates by variant or tiled filters; a layer that
several later steps read is cut off by a checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellward.functions import risk as r
from cellward.operators import normalise, raster, tabular
from cellward.plans.config import CENSUS, EXPOSITION_WEIGHTS, Settings
from cellward.sources.storage import cut, sized

LAYERS = ("class", "volume", "population", "power", "census")


def hazard(cells: DataFrame, scenarios: DataFrame, rows: int, cols: int, sigma: float = 1.0, settings: Settings | None = None, tile: int = raster.TILE) -> DataFrame:
    """(scenario, row, col, hazard) from cells (row, col, dem, land, zoned, river, coast) and scenarios (scenario, rise).

    river and coast are distances in metres, null where far; ``big_river`` is that to a river of the least area or more.
    Cells outside the study area (no elevation, no land, no zone) have hazard 0.
    """
    s = settings or Settings()
    own = cells.withColumn("study", F.col("dem").isNotNull() & F.coalesce(F.col("land") & F.col("zoned"), F.lit(False)))
    stats = own.where("study").agg(F.min("dem").alias("lo"), F.max("dem").alias("hi"))
    full = normalise.beside(own, stats, None).crossJoin(F.broadcast(scenarios))  # six rows
    dem, rise, lo, hi = map(F.col, ("dem", "rise", "lo", "hi"))
    reach = r.reach_of(lo, hi)
    curve = lambda decay: F.when(hi == lo, r.uniform_risk(lo, s.safe_elevation)).otherwise(r.elevation_risk(dem, rise, reach, decay, s.safe_elevation))
    near = F.coalesce(F.col("big_river") <= s.river_distance, F.lit(False))
    far = F.lit(1e12)
    v = r.near_river(curve(s.decay), curve(s.river_decay), near) * r.context(dem, lo, hi)
    v = v * r.river_band(F.coalesce("river", far)) * r.coast_band(F.coalesce("coast", far), F.col("land"))
    full = full.withColumn("v", F.when(F.col("study"), v)).select("scenario", *raster.KEY, "study", "v")
    full = cut(full)
    top = sized(normalise.percentiles(full, F.col("v"), {"p": 0.99}, ["scenario"]))
    full = full.join(top, "scenario", "left").withColumn("v", F.coalesce(F.when(F.col("p") > 1, F.col("v") / F.col("p")).otherwise(F.col("v")), F.lit(0.0)))
    smooth = raster.gaussian(full, "v", rows, cols, sigma, tile=tile, by=("scenario",))
    joined = cut(full.select("scenario", *raster.KEY, "study").join(smooth, ["scenario", *raster.KEY]))
    return cut(normalise.normalise(joined, "smooth", "hazard", F.col("study"), "hazard", ["scenario"]).select("scenario", *raster.KEY, "hazard"))


def census(cells: DataFrame, columns: tuple[str, str, str], out: str = "census") -> DataFrame:
    """Weighted sum of three attributes, each rescaled over its positive values; nulls are 0, a constant column gives 0."""
    filled = cells.withColumns({f"__{name}": F.coalesce(F.col(name).cast("double"), F.lit(0.0)) for name in columns})
    spans = cut(filled.agg(*((F.max(f"__{name}") > F.min(f"__{name}")).alias(f"__{name}_span") for name in columns)))
    scaled = normalise.normalise_all(filled, "exposition", {f"__{name}_scaled": (f"__{name}", F.col(f"__{name}") > 0) for name in columns})
    full = normalise.beside(scaled, spans, None)
    parts = [F.when(F.col(f"__{name}_span"), weight * F.col(f"__{name}_scaled")).otherwise(0.0) for name, weight in zip(columns, CENSUS.values())]
    return full.withColumn(out, sum(parts[1:], parts[0])).select(*cells.columns, out)


def exposition(cells: DataFrame, rows: int, cols: int, sigma: float = 1.0, weights: dict[str, dict[str, float]] = EXPOSITION_WEIGHTS, tile: int = raster.TILE) -> DataFrame:
    """(use, row, col, exposition) from cells (row, col, the five layers, urban, port: multipliers, study).

    Each layer is rescaled once; the weights of each use are one row of a small table beside them.
    """
    cells = cut(normalise.normalise_all(cells, "exposition", {f"n_{name}": (name, F.col(name).isNotNull()) for name in LAYERS}))
    total = lambda w: sum((w[x] * F.col(f"n_{x}") for x in LAYERS[1:]), w[LAYERS[0]] * F.col(f"n_{LAYERS[0]}"))
    uses = F.explode(F.array(*(F.struct(F.lit(use).alias("use"), (total(w) * F.col("urban") * F.col("port")).alias("v")) for use, w in weights.items())))
    rows_of = cells.select(*raster.KEY, "study", uses.alias("u")).select("u.use", *raster.KEY, "study", "u.v")
    smooth = raster.gaussian(rows_of, "v", rows, cols, sigma, tile=tile, by=("use",))
    full = cut(smooth.join(cells.select(*raster.KEY, "study"), raster.KEY).withColumn("smooth", F.when(F.col("study"), F.col("smooth")).otherwise(0.0)))
    return cut(normalise.normalise(full, "smooth", "full_range", F.col("smooth") > 0, "exposition", ["use"]).select("use", *raster.KEY, "exposition"))


def relevance(exposed: DataFrame, totals: DataFrame, added: DataFrame) -> DataFrame:
    """(indicator, row, col, relevance) from exposition (use, row, col, zone, exposition), regional totals
    (use, zone, total) and single cells' own values (use, row, col, added), with the mean of all as indicator ``combined``.
    """
    keyed = exposed.withColumn("__zone", F.concat_ws("|", "use", "zone"))
    given = totals.select(F.concat_ws("|", "use", "zone").alias("__zone"), "total")
    shared = tabular.share_out(keyed, "__zone", "exposition", given, "total", "value").select("use", *raster.KEY, "value")
    value = cut(shared.join(added, ["use", *raster.KEY], "left").withColumn("value", F.col("value") + F.coalesce("added", F.lit(0.0))))
    one = cut(normalise.normalise(value, "value", "economic", F.col("value") > 0, "relevance", ["use"]).select(F.col("use").alias("indicator"), *raster.KEY, "relevance"))
    again = normalise.normalise(one, "relevance", "economic", F.col("relevance") > 0, "again", ["indicator"])
    return one.unionByName(again.groupBy(*raster.KEY).agg(F.avg("again").alias("relevance")).withColumn("indicator", F.lit("combined")))


def risk(hazards: DataFrame, relevances: DataFrame, land: DataFrame, settings: Settings | None = None) -> DataFrame:
    """(scenario, indicator, row, col, risk) for every scenario and indicator; hazard counts above its threshold."""
    s = settings or Settings()
    h = hazards.withColumn("hazard", F.when(F.col("hazard") > s.hazard_threshold, F.col("hazard")).otherwise(0.0))
    full = h.join(relevances, raster.KEY).join(land, raster.KEY)
    inside = r.at_risk(F.col("hazard"), F.col("relevance"), F.col("land"), s.economic_threshold)
    full = full.withColumn("inside", inside).withColumn("v", r.integrated_risk(F.col("hazard"), F.col("relevance"), F.col("land"), **{f"w_{k}": w for k, w in s.risk_weights.items()}))
    full = cut(full)
    return normalise.normalise(full, "v", "risk", F.col("inside"), "risk", ["scenario", "indicator"]).select("scenario", "indicator", *raster.KEY, "risk")
