"""Choice of the numbers of clusters by integrated complete likelihood."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import replace

import numpy as np
from pyspark.sql import functions as F

from chronolattice.functions.probability import size_combinations

from .estimator import BlockEstimator, CoClustering, ConvergenceError, Matrix


def size_vectors(most: int, columns: Sequence[int]) -> list[tuple[int, ...]]:
    """Candidates for the conditional model: all multisets of sizes 1..most for each number of column clusters."""
    return [v for n in columns for v in size_combinations(most, n)]


def grid_search(data: Matrix, base: BlockEstimator, candidates: Iterable[Sequence[int]], **run) -> tuple[CoClustering, dict[tuple[int, ...], float]]:
    """The best result over candidate sizes, and the criterion of each; candidates that never fill are skipped."""
    best, found = None, {}
    for sizes in candidates:
        try:
            got = replace(base, sizes=tuple(sizes)).run(data, **run)
        except ConvergenceError:
            continue
        found[tuple(sizes)] = got.icl[-1]
        if best is None or got.icl[-1] > best.icl[-1]:
            best = got
    if best is None:
        raise ConvergenceError("no candidate kept all clusters filled")
    return best, found


def best_after_grid(data: Matrix, base: BlockEstimator, ks: Sequence[int], plain_ks: Sequence[int], plain_ls: Sequence[int], **run) -> CoClustering:
    """A plain grid finds the column clusters; then each one's rows are clustered on their own, and the whole is refined."""
    plain = replace(base, conditional=False, sizes=(1,))
    start, _ = grid_search(data, plain, [(k,) * n for n in plain_ls for k in plain_ks], **run)
    sizes = []
    for c in range(len(start.model.sizes)):
        own = np.flatnonzero(start.col_partition == c)
        part = Matrix(data.df.select("rid", F.array(*[F.get("cells", F.lit(int(j))) for j in own]).alias("cells"))) if len(own) else None
        if part is None:
            sizes.append(1)
            continue
        _, found = grid_search(part, replace(plain, initial_columns=None), [(k,) for k in ks], **run)
        sizes.append(max(found, key=found.get)[0])
        part.close()
    return replace(base, conditional=True, sizes=tuple(sizes), initial_columns=start.col_partition).run(data, **run)


def greedy_search(data: Matrix, base: BlockEstimator, max_k: int, max_l: int, **run) -> CoClustering:
    """From one block, adds a row or a column cluster, whichever is better, while the criterion grows.

    The conditional model adds a row cluster to one column cluster at a time.
    """
    sizes: tuple[int, ...] = (1,)
    best = replace(base, sizes=sizes).run(data, **run)
    while True:
        if base.conditional:
            options = [(*sizes[:c], s + 1, *sizes[c + 1 :]) for c, s in enumerate(sizes) if s < max_k] + ([(*sizes, 1)] if len(sizes) < max_l else [])
        else:
            options = ([(sizes[0] + 1,) * len(sizes)] if sizes[0] < max_k else []) + ([(sizes[0],) * (len(sizes) + 1)] if len(sizes) < max_l else [])
        try:
            got, _ = grid_search(data, base, options, **run)
        except ConvergenceError:
            return best
        if not got.icl[-1] > best.icl[-1]:
            return best
        best, sizes = got, tuple(got.model.sizes)
