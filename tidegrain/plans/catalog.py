"""The patterns by their names."""

from __future__ import annotations

from . import patterns, spatial
from .results import register_pattern

for _name, _pattern in {
    "static_areal": patterns.static_areal, "yearly_areal": patterns.yearly_areal, "yearly_areal_bg_vintage": patterns.yearly_areal_vintage, "gridded": patterns.gridded, "acag_multi": patterns.many_pollutants,
    "cbp_fallback": patterns.fallback, "fara_tract": patterns.food_access, "faqsd_daily_areal": patterns.daily_pair, "precomputed_areal": patterns.precomputed_yearly, "precomputed_static": patterns.precomputed_static,
    "proximity": spatial.proximity, "boundary_overlap": spatial.boundary_overlap, "boundary_overlap_fast": spatial.boundary_overlap_fast, "grid_weights": spatial.buffer_grid, "tiger_proximity": spatial.road_distances,
    "nhd_proximity": spatial.water_distances,
}.items():
    register_pattern(_name)(_pattern)
