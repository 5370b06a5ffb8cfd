"""Co-clustering methods of the series set; rows must be grouped (a cell array per row)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronolattice.sources.writers import write_coclustering

from .estimator import BlockEstimator, CoClustering, Matrix, row_id
from .selection import best_after_grid, greedy_search, grid_search, size_vectors


class CoClusteringOps:
    def _matrix(self, source: str, key: str) -> tuple[Matrix, DataFrame]:
        """Cells by :func:`row_id`; rows of equal key and cells share one, and get the same label."""
        keyed = self.df.select(row_id(self.column(key), self.column(source)).alias("rid"), self.column(source).alias("cells"))
        return Matrix(keyed), keyed

    def _attach(self, out: str, source: str, key: str, result: CoClustering, plain: bool, exhaustive: bool = False):
        labels = result.row_labels.select(F.col("rid").alias("label_rid"), "labels").dropDuplicates(["label_rid"])
        one = F.get("labels", F.lit(0))
        if not plain:
            one = F.array(*[F.get("labels", F.lit(int(c))) for c in result.col_partition]) if exhaustive else F.col("labels")
        joined = self.df.join(labels, row_id(self.column(key), self.column(source)) == labels["label_rid"], "left")
        return self._of(joined.withColumn(out, one).drop("label_rid", "labels"))

    def _clustered(self, out: str, source: str, key: str, estimate, plain: bool, exhaustive: bool, folder: str | None, series: str | None):
        data, keyed = self._matrix(source, key)
        result = estimate(data)
        if folder:
            write_coclustering(result, self.df, key, source, folder, series)
        return self._attach(out, source, key, result, plain, exhaustive), result

    def add_lbm(self, out: str, source: str, key: str = "gkey", k: int = 2, l: int = 2, max_iterations: int = 10, burn_in: int = 10, init: str = "randomPartition", method: str = "SEMGibbs", runs: int = 1, tries: int = 10, seed: int = 0, folder: str | None = None, series: str | None = None, **options):  # noqa: E741
        """Row cluster of each multivariate row; returns (set, result)."""
        e = BlockEstimator.plain(k, l, max_iterations=max_iterations, burn_in=burn_in, seed=seed, **options)
        return self._clustered(out, source, key, lambda d: e.run(d, method, init, runs, tries), True, False, folder, series)

    def add_fun_lbm(self, out: str, source: str, key: str = "gkey", k: int = 2, l: int = 2, max_iterations: int = 10, burn_in: int = 10, init: str = "randomPartition", runs: int = 1, tries: int = 10, seed: int = 0, folder: str | None = None, series: str | None = None, **options):  # noqa: E741
        e = BlockEstimator.functional_plain(k, l, max_iterations=max_iterations, burn_in=burn_in, seed=seed, **options)
        return self._clustered(out, source, key, lambda d: e.run(d, "SEMGibbs", init, runs, tries), True, False, folder, series)

    def add_clbm(self, out: str, source: str, key: str = "gkey", sizes: Sequence[int] = (2, 2), max_iterations: int = 10, burn_in: int = 10, init: str = "randomPartition", runs: int = 1, tries: int = 10, seed: int = 0, exhaustive: bool = False, folder: str | None = None, series: str | None = None, **options):
        """Labels of each row, one per column cluster, or one per feature (``exhaustive``); returns (set, result)."""
        e = BlockEstimator.conditional_on(tuple(sizes), max_iterations=max_iterations, burn_in=burn_in, seed=seed, **options)
        return self._clustered(out, source, key, lambda d: e.run(d, "SEMGibbs", init, runs, tries), False, exhaustive, folder, series)

    def add_fun_clbm(self, out: str, source: str, key: str = "gkey", sizes: Sequence[int] = (2, 2), max_iterations: int = 10, burn_in: int = 10, init: str = "randomPartition", runs: int = 1, tries: int = 10, seed: int = 0, exhaustive: bool = False, folder: str | None = None, series: str | None = None, **options):
        e = BlockEstimator.functional_conditional(tuple(sizes), max_iterations=max_iterations, burn_in=burn_in, seed=seed, **options)
        return self._clustered(out, source, key, lambda d: e.run(d, "SEMGibbs", init, runs, tries), False, exhaustive, folder, series)

    def add_auto_lbm_grid(self, out: str, source: str, key: str = "gkey", ks: Sequence[int] = (2, 3), ls: Sequence[int] = (2, 3), functional: bool = False, folder: str | None = None, series: str | None = None, runs: int = 1, tries: int = 10, **options):
        """The grid's best plain (or functional) model."""
        base = BlockEstimator.functional_plain(1, 1, **options) if functional else BlockEstimator.plain(1, 1, **options)
        return self._clustered(out, source, key, lambda d: grid_search(d, base, [(k,) * n for n in ls for k in ks], runs=runs, tries=tries)[0], True, False, folder, series)

    def add_auto_fun_lbm_grid(self, out: str, source: str, key: str = "gkey", ks: Sequence[int] = (2, 3), ls: Sequence[int] = (2, 3), **options):
        return self.add_auto_lbm_grid(out, source, key, ks, ls, True, **options)

    def add_auto_clbm_grid(self, out: str, source: str, key: str = "gkey", max_k: int = 2, ls: Sequence[int] = (1, 2), functional: bool = False, exhaustive: bool = False, runs: int = 1, tries: int = 10, **options):
        base = BlockEstimator.functional_conditional((1,), **options) if functional else BlockEstimator.conditional_on((1,), **options)
        return self._clustered(out, source, key, lambda d: grid_search(d, base, size_vectors(max_k, ls), runs=runs, tries=tries)[0], False, exhaustive, None, None)

    def add_auto_clbm_after_lbm_grid(self, out: str, source: str, key: str = "gkey", ks: Sequence[int] = (1, 2, 3), plain_ks: Sequence[int] = (2, 3), plain_ls: Sequence[int] = (2, 3), functional: bool = False, exhaustive: bool = False, folder: str | None = None, series: str | None = None, runs: int = 1, tries: int = 10, **options):
        base = BlockEstimator.functional_conditional((1,), **options) if functional else BlockEstimator.conditional_on((1,), **options)
        return self._clustered(out, source, key, lambda d: best_after_grid(d, base, ks, plain_ks, plain_ls, runs=runs, tries=tries), False, exhaustive, folder, series)

    def add_auto_fun_clbm_after_fun_lbm_grid(self, out: str, source: str, key: str = "gkey", **options):
        return self.add_auto_clbm_after_lbm_grid(out, source, key, functional=True, **options)

    def add_auto_greedy(self, out: str, source: str, key: str = "gkey", max_k: int = 4, max_l: int = 4, conditional: bool = False, functional: bool = True, exhaustive: bool = False, runs: int = 1, tries: int = 10, **options):
        """Greedy search of the numbers of clusters."""
        base = BlockEstimator(sizes=(1,), conditional=conditional, functional=functional, **options)
        return self._clustered(out, source, key, lambda d: greedy_search(d, base, max_k, max_l, runs=runs, tries=tries), not conditional, exhaustive, None, None)
