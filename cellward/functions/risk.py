"""Column expressions of the risk curves."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def percent(part: Column, whole: Column) -> Column:
    """100 * part / whole, 0 where the whole is 0 or null (F2)."""
    return F.coalesce(F.try_divide(part * 100.0, whole), F.lit(0.0))


def elevation_risk(dem: Column, rise: Column, reach: Column, decay: float = 1.4, safe: float = 25.0) -> Column:
    """Four bands of height above the risen sea; land above ``safe`` overrides the others."""
    h = dem - rise
    return (
        F.when(dem > safe, 0.001 + 0.009 * F.exp(-(dem - safe) / 10))
        .when(h <= 0, 0.8 + 0.19 * (1 - F.exp(-F.abs(h) / 2)))
        .when(h <= reach, 0.6 * F.exp(-h / decay))
        .when(h > reach, 0.05 + 0.1 * F.exp(-(h - reach) / 5))
    )


def uniform_risk(low: Column, safe: float = 25.0) -> Column:
    """R9 where all of the study area has one elevation."""
    return F.when(low <= safe, 0.3).otherwise(0.05)


def reach_of(low: Column, high: Column) -> Column:
    """Vulnerable height: three tenths of the elevation range, 10 m at least (A5)."""
    return F.greatest(F.lit(10.0), 0.3 * (high - low))


def near_river(plain: Column, slow: Column, near: Column) -> Column:
    """Near rivers the slower of two decays holds where it is larger."""
    return F.when(near, F.greatest(plain, slow)).otherwise(plain)


def context(dem: Column, low: Column, high: Column) -> Column:
    """1 + 0.2(1 - p) - 0.1p with p the place in the elevation range."""
    p = F.coalesce(F.try_divide(dem - low, high - low), F.lit(0.0))
    return 1 + 0.2 * (1 - p) - 0.1 * p


def river_band(distance: Column) -> Column:
    """Nested distance bands, the nearest wins."""
    return F.when(distance <= 50, 1.15).when(distance <= 200, 1.10).when(distance <= 500, 1.05).otherwise(1.0)


def coast_band(distance: Column, land: Column) -> Column:
    """A tenth more on land within 5 km of the coast."""
    return F.when((distance <= 5000) & land, 1.1).otherwise(1.0)


def urban_multiplier(urban: Column, semi: Column) -> Column:
    """Three classes of the weighted urban share, first match wins."""
    factor = 0.7 * urban + 0.3 * semi
    return F.when(factor >= 0.6, 1.15).when(factor >= 0.4, 1.05).otherwise(0.5)


def port_multiplier(inside: Column, buffered: Column) -> Column:
    """Port area before its surroundings before the rest."""
    return F.when(inside, 1.15).when(buffered, 1.05).otherwise(1.0)


def at_risk(hazard: Column, weight: Column, land: Column, least: float = 0.05) -> Column:
    """Hazard positive, the weight above its threshold, on land."""
    return F.coalesce((hazard > 0) & (weight > least) & land, F.lit(False))


def integrated_risk(hazard: Column, economic: Column, land: Column, w_hazard: float = 0.1, w_economic: float = 0.9) -> Column:
    """Weighted sum where ``at_risk``, else 0."""
    return F.when(at_risk(hazard, economic, land), w_hazard * hazard + w_economic * economic).otherwise(0.0)


def population_risk(hazard: Column, population: Column, economic: Column, land: Column) -> Column:
    """As integrated_risk with population, or the economic weight where population is missing, and a lower threshold."""
    people = F.coalesce(population, economic)
    return F.when(at_risk(hazard, people, land, 0.01), 0.1 * hazard + 0.9 * people).otherwise(0.0)


def class_weight(cls: Column, weights: dict[int, float]) -> Column:
    """Weight of a built-up class from a sparse table, 0 if it isn't listed."""
    pairs = [F.lit(x) for k, v in weights.items() for x in (k, v)]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), cls.cast("int")), F.lit(0.0))


def risk_class(v: Column, threshold: float = 0.3) -> Column:
    """Five classes."""
    return F.when(v > 0.8, "very_high").when(v > 0.6, "high").when(v > threshold, "medium").when(v > 0.1, "low").otherwise("minimal")


def zone_class(water: Column, land: Column) -> Column:
    """0 water, 2 land, 1 outside; water first."""
    return F.when(water, 0).when(land, 2).otherwise(1)


def colour(v: Column, low: float, high: float, stops: list[tuple[float, str]]) -> Column:
    """#rrggbb between the stops of a ramp; null for 0 or null."""
    p = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (v - low) / (high - low)))

    def channel(i: int) -> Column:
        at = lambda c: int(c[1 + 2 * i : 3 + 2 * i], 16)
        out = F.lit(float(at(stops[-1][1])))
        for (p0, c0), (p1, c1) in reversed(list(zip(stops, stops[1:]))):
            out = F.when(p <= p1, at(c0) + (p - p0) / (p1 - p0) * (at(c1) - at(c0))).otherwise(out)
        return F.lower(F.lpad(F.hex(F.floor(out + 0.5).cast("long")), 2, "0"))

    return F.when(v.isNotNull() & (v != 0), F.concat(F.lit("#"), channel(0), channel(1), channel(2)))
