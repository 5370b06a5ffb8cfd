"""Latent block co-clustering: plain, conditional and functional, from one core."""

from .estimator import BlockEstimator, CoClustering, ConvergenceError
from .model import BlockModel
from .selection import best_after_grid, greedy_search, grid_search, size_vectors

__all__ = ["BlockEstimator", "BlockModel", "CoClustering", "ConvergenceError", "best_after_grid", "greedy_search", "grid_search", "size_vectors"]
