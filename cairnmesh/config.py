"""Run parameters and fixed values of the domain."""

from __future__ import annotations

from dataclasses import dataclass

EUCLIDEAN, LEAST_COST = "EuclideanDistance", "LCPDistance"

#: The taxonomic groups and the distance that each is analysed with.
GROUPS = {
    "amphibians": EUCLIDEAN,
    "bees": LEAST_COST,
    "birds": EUCLIDEAN,
    "bryophytes": EUCLIDEAN,
    "coleoptera": LEAST_COST,
    "fishes": LEAST_COST,
    "fungi": EUCLIDEAN,
    "lepidoptera": LEAST_COST,
    "lichens": EUCLIDEAN,
    "mammals": LEAST_COST,
    "may_stone_caddis_flies": LEAST_COST,
    "molluscs": LEAST_COST,
    "odonata": LEAST_COST,
    "orthoptera": LEAST_COST,
    "reptiles": LEAST_COST,
    "spiders": LEAST_COST,
    "vascular_plants": EUCLIDEAN,
}
#: Names under which the groups are shown.
DISPLAY_NAMES = {
    "mammals": "Mammals",
    "reptiles": "Reptiles",
    "amphibians": "Amphibians",
    "birds": "Birds",
    "fishes": "Fishes",
    "vascular_plants": "Vascular_plants",
    "bryophytes": "Bryophytes",
    "spiders": "Spiders",
    "coleoptera": "Beetles",
    "odonata": "Dragonflies",
    "orthoptera": "Grasshoppers",
    "lepidoptera": "Butterflies",
    "bees": "Bees",
    "fungi": "Fungi",
    "molluscs": "Molluscs",
    "lichens": "Lichens",
    "may_stone_caddis_flies": "May_stone_caddisflies",
}
HABITATS = ("aquatic", "terrestrial")
SENSITIVITIES = ("permeability", "quality")


@dataclass(frozen=True)
class Config:
    """Constants of an analysis run; distances in metres."""

    resolution: float = 25.0
    #: Share of the dispersal distance that a coarse cell measures.
    precision: float = 0.2
    #: Interaction range in dispersal distances.
    reach: float = 3.0
    #: What stands for a quality of zero, and what is added before a logarithm.
    floor: float = 1e-5
    #: Name under which results are written.
    run_id: str = "run"
    #: Where traits, rasters and layers are read and results are written; None: paths are given by the caller.
    data_root: str | None = None
    results_root: str | None = None

    def path(self, *parts: str, results: bool = False) -> str:
        root = self.results_root if results else self.data_root
        if root is None:
            raise ValueError("set results_root" if results else "set data_root")
        return "/".join([root.rstrip("/"), *([self.run_id] if results else []), *parts])


@dataclass(frozen=True)
class Grid:
    """Rows from north to south, columns from west to east; (x0, y0) is the north-west corner."""

    height: int
    width: int
    resolution: float = 25.0
    x0: float = 0.0
    y0: float = 800.0
    #: Height of a cell where cells aren't square.
    resolution_y: float | None = None
    #: Tag of the coordinate reference system; rasters are combined only if theirs agree.
    crs: str = "EPSG:2056"

    def square(self) -> float:
        """The cells' size; raises where they aren't square."""
        if self.resolution_y is not None and abs(self.resolution_y) != abs(self.resolution):
            raise ValueError(f"cells of {self.resolution} x {self.resolution_y} are not square")
        return abs(self.resolution)

    def require(self, crs: str, resolution: float) -> None:
        """Raises where a raster's tag or cell size isn't this grid's."""
        if crs != self.crs:
            raise ValueError(f"raster is in {crs}, the grid in {self.crs}")
        if resolution != self.square():
            raise ValueError(f"raster has cells of {resolution}, the grid of {self.square()}")


DEFAULT = Config()
#: The grid of the adapters' tables.
FRAME = Grid(32, 32)
