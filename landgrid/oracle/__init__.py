"""Independent SQL for DuckDB, one statement per registered query."""

from landgrid.oracle import grids, pixels, samples, scenes, zones

ORACLES: dict[str, str] = {}
for _module in (scenes, pixels, grids, zones, samples):
    ORACLES.update(_module.SQL)
