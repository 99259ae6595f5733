"""Typed settings with the defaults of a study: no DataFrames here."""

from __future__ import annotations

from dataclasses import dataclass, field

# LULC class codes and their labels (0 is only used for display).
CLASSES = (1, 2, 3, 4)
URBAN, VEGETATION, BARE, WATER = CLASSES
LABELS = {0: "Other/NoData", 1: "Urban", 2: "Vegetation", 3: "Bare Soil", 4: "Water"}

# Wedge names clockwise from north, 45 degrees each.
SECTORS = ("N", "NE", "E", "SE", "S", "SW", "W", "NW")

# Layer names of a raw scene, by sensor.
SCENE_LAYERS = {
    "sentinel": ("B02", "B03", "B04", "B08", "B11", "B12", "SCL"),
    "landsat": ("SR_B2", "SR_B3", "SR_B4", "SR_B5", "SR_B6", "SR_B7", "QA_PIXEL"),
}


@dataclass(frozen=True)
class Grid:
    """Geometry of a regular north-less grid: cell (r, c) has its centre at
    ``(x0 + (c + 0.5) * res, y0 + (r + 0.5) * res)``."""

    res: float
    nrows: int
    ncols: int
    x0: float = 0.0
    y0: float = 0.0

    @property
    def cell_km2(self) -> float:
        return self.res * self.res / 1e6


@dataclass(frozen=True)
class Geometry:
    """What a stored raster is laid on: its grid and the name of its reference system."""

    grid: Grid
    crs: str

    def same(self, other: Geometry, tolerance: float = 1e-6) -> bool:
        """Equal reference system and size, and resolution and origin equal to a millionth of a cell."""
        a, b = self.grid, other.grid
        near = lambda x, y: abs(x - y) <= tolerance * a.res
        return (self.crs == other.crs and (a.nrows, a.ncols) == (b.nrows, b.ncols)
                and near(a.res, b.res) and near(a.x0, b.x0) and near(a.y0, b.y0))


# The defaults below are the settings of a study (seasons, cloud ladders, ring steps, patch and
# sample sizes, forest and grid of the classifiers); results depend on them.
@dataclass(frozen=True)
class SceneSearch:
    sentinel_collection: str = "sentinel-2-l2a"
    landsat_collection: str = "landsat-c2-l2"
    season: tuple[int, int] = (1, 3)
    sentinel_ladder: tuple[float, ...] = (10.0, 20.0)
    landsat_ladder: tuple[float, ...] = (10.0, 20.0, 40.0, 60.0, 80.0, 100.0, float("inf"))
    limit: int | None = None


@dataclass(frozen=True)
class Sprawl:
    centre_xy: tuple[float, float]
    ring_step: float = 5_000.0
    ring_max: float = 30_000.0
    fringe_km: float = 10.0
    sector_radius: float = 80_000.0


@dataclass(frozen=True)
class Change:
    patch_size: int = 64
    stride_train: int = 32
    stride_infer: int = 32
    centre: int = 8
    centre_threshold: float = 0.1
    negatives_per_positive: int = 3
    seeds: tuple[int, ...] = (42, 101, 202, 303)
    min_component: int = 9
    blocks: int = 4
    train_blocks: int = 11
    val_blocks: int = 3


@dataclass(frozen=True)
class Classification:
    n_per_class: int = 400
    train_share: float = 0.7
    trees: int = 500
    depth: int = 30
    features_per_split: int = 4
    min_samples: int = 100
    svm_cost: float = 1.0
    tune_costs: tuple[float, ...] = (0.1, 1.0, 10.0, 100.0)
    tune_gammas: tuple[float, ...] = (0.001, 0.01, 0.1, 1.0)
    tune_folds: int = 5
    seed: int = 42


@dataclass(frozen=True)
class Drivers:
    coarsen: int = 8
    per_stratum: int = 1_000
    knn: int = 8
    flat_fill: float = 50_000.0
    seed: int = 42


@dataclass(frozen=True)
class Study:
    grid: Grid
    sprawl: Sprawl
    transitions: tuple[tuple[int, int], ...]
    years: tuple[int, ...]
    change: Change = field(default_factory=Change)
    classification: Classification = field(default_factory=Classification)
    drivers: Drivers = field(default_factory=Drivers)
    search: SceneSearch = field(default_factory=SceneSearch)
