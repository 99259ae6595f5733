"""All registered queries by name."""

from __future__ import annotations

from landgrid.plans import queries_grids, queries_pixels, queries_samples, queries_scenes, queries_zones

QUERIES = {}
for _module in (queries_scenes, queries_pixels, queries_grids, queries_zones, queries_samples):
    QUERIES.update(_module.QUERIES)
