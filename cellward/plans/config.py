"""Default configuration of the analysis, with the checks that its weights must pass."""

from __future__ import annotations

import math
from dataclasses import dataclass, field, fields


@dataclass(frozen=True)
class GridSpec:
    """A north-up grid of square cells; x and y are cell centres."""

    x0: float
    y0: float
    res: float
    width: int
    height: int
    crs: str = "EPSG:3035"

    @staticmethod
    def covering(x0: float, y0: float, x1: float, y1: float, res: float, crs: str = "EPSG:3035") -> GridSpec:
        """The smallest grid from the top left corner that covers the extent."""
        return GridSpec(x0, y1, res, math.ceil((x1 - x0) / res), math.ceil((y1 - y0) / res), crs)

    def extent(self) -> tuple[float, float, float, float]:
        return self.x0, self.y0 - self.height * self.res, self.x0 + self.width * self.res, self.y0

    def aligned_with(self, other: GridSpec) -> bool:
        return self == other


#: The default scenarios (name, metres of sea-level rise).
SCENARIOS = (("Current", 0.0), ("Conservative", 1.0), ("Moderate", 2.0), ("Severe", 3.0), ("Very Severe", 10.0), ("Extreme", 15.0))

#: Built-up class to weight; classes that aren't listed weigh 0.
CLASS_WEIGHTS = {1: 0.0, 2: 0.0, 3: 0.0, 4: 0.0, 5: 0.5, 11: 0.05, 12: 0.1, 13: 0.1, 14: 0.15, 15: 0.15, 21: 0.25, 22: 0.7, 23: 0.7, 24: 0.9, 25: 1.0}

#: Weights of the five exposition layers, for the plain layer and by economic indicator.
EXPOSITION_WEIGHTS = {
    "exposition": {"class": 0.30, "volume": 0.30, "population": 0.13, "power": 0.12, "census": 0.15},
    "gdp": {"class": 0.25, "volume": 0.34, "population": 0.13, "power": 0.18, "census": 0.10},
    "freight": {"class": 0.32, "volume": 0.34, "population": 0.06, "power": 0.18, "census": 0.10},
    "hrst": {"class": 0.27, "volume": 0.36, "population": 0.09, "power": 0.18, "census": 0.10},
}

#: Multipliers of the census index.
CENSUS = {"inhabitants": 1.05, "household": 1.05, "price": 1.5}


@dataclass(frozen=True)
class Normaliser:
    """Parameters of one kind of rescaling."""

    preserve: bool = False
    boost: bool = True
    ceiling: float = 1.0
    floor: float = 0.001


NORMALISERS = {
    "hazard": Normaliser(True, False, 0.95, 0.05),
    "exposition": Normaliser(False, True, 1.0, 0.01),
    "economic": Normaliser(True, True, 1.0, 0.01),
    "risk": Normaliser(False, True, 1.0, 0.01),
    "full_range": Normaliser(),
}


@dataclass(frozen=True)
class Settings:
    safe_elevation: float = 25.0
    decay: float = 1.4
    river_decay: float = 6.0
    river_distance: float = 750.0
    min_river_area: float = 50_000.0
    hazard_threshold: float = 0.3
    economic_threshold: float = 0.05
    population_threshold: float = 0.01
    cluster_threshold: float = 0.35
    exposition_weights: dict[str, float] = field(default_factory=lambda: dict(EXPOSITION_WEIGHTS["exposition"]))
    risk_weights: dict[str, float] = field(default_factory=lambda: {"hazard": 0.1, "economic": 0.9})

    def check(self) -> None:
        """Each family of weights sums to 1."""
        for name in ("exposition_weights", "risk_weights"):
            total = sum(getattr(self, name).values())
            if abs(total - 1) > 1e-6:
                raise ValueError(f"{name} sum to {total}, not 1")


@dataclass(frozen=True)
class ClusterSettings:
    """Parameters of clusters of risk; the values here are those of a mapping that doesn't name them."""

    risk_threshold: float = 0.25
    cell_size_meters: float = 30.0
    morphological_closing_disk_size: int = 3
    cluster_epsilon_multiplier: float = 1.5
    minimum_samples: int = 4
    hole_area_threshold: float = 0.10
    minimum_polygon_area_square_meters: float = 5_000.0
    use_contour_method: bool = False

    @staticmethod
    def of(given: dict | None) -> ClusterSettings:
        """From a mapping; names that aren't parameters of clusters say nothing."""
        names = {f.name for f in fields(ClusterSettings)}
        return ClusterSettings(**{k: v for k, v in (given or {}).items() if k in names})


#: The default configuration's cluster parameters.
CLUSTERS = ClusterSettings(0.35, 30.0, 12, 6.0, 10, 0.10, 12_000_000.0, True)
