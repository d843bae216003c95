"""Skyline (Pareto-optimality) queries on Spark DataFrames."""

from pareto_frame.plans.grouped import skyline_by
from pareto_frame.plans.jobs import (
    compare_strategies,
    grid_of,
    phase_counts,
    run_grid,
    skyline_with_phases,
    sweep_sizes,
)
from pareto_frame.plans.seeded import seeded_skyline
from pareto_frame.plans.skyline import STRATEGIES, skyline

__all__ = [
    "STRATEGIES",
    "compare_strategies",
    "grid_of",
    "phase_counts",
    "run_grid",
    "seeded_skyline",
    "skyline",
    "skyline_by",
    "skyline_with_phases",
    "sweep_sizes",
]
