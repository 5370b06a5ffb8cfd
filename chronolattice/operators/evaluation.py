"""Clustering evaluation from one contingency table, in DataFrame aggregates.

External indices count pairs of rows: tp together in both clusterings, fp in
the prediction only, fn in the truth only, tn in neither.  Logarithms are
natural.  A zero divisor gives null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronolattice.functions import arrays

from .aggregation import barycenters


def contingency(df: DataFrame, pred: str, truth: str) -> DataFrame:
    """truth, pred, n."""
    return df.select(F.col(truth).alias("truth"), F.col(pred).alias("pred")).where("truth is not null and pred is not null").groupBy("truth", "pred").agg(F.count(F.lit(1)).alias("n"))


def _pairs(n: Column) -> Column:
    n = n.cast("double")
    return n * (n - 1) / 2


def _entropy(n: Column, all_: Column) -> Column:
    return -F.sum(n / all_ * F.ln(n / all_))


def pair_counts(table: DataFrame) -> DataFrame:
    """One row: n, tp, fp, fn, tn, sums A and B of pairs per class and cluster, mi, h_truth, h_pred, purity."""
    rows = table.groupBy("truth").agg(F.sum("n").alias("a"))
    cols = table.groupBy("pred").agg(F.sum("n").alias("b"), F.max("n").alias("most"))
    one = table.agg(F.sum("n").cast("double").alias("n"), F.sum(_pairs(F.col("n"))).alias("tp"))
    total = F.broadcast(one)  # one row
    a = rows.crossJoin(total.select(F.col("n").alias("all"))).agg(F.sum(_pairs(F.col("a"))).alias("A"), _entropy(F.col("a"), F.col("all")).alias("h_truth"))
    b = cols.crossJoin(total.select(F.col("n").alias("all"))).agg(F.sum(_pairs(F.col("b"))).alias("B"), _entropy(F.col("b"), F.col("all")).alias("h_pred"), (F.sum("most") / F.first("all")).alias("purity"))
    joined = table.join(rows, "truth").join(cols, "pred").crossJoin(total.select(F.col("n").alias("all")))
    mi = joined.agg(F.sum(F.col("n") / F.col("all") * F.ln(F.col("n") * F.col("all") / (F.col("a") * F.col("b")))).alias("mi"))
    out = one.crossJoin(F.broadcast(a)).crossJoin(F.broadcast(b)).crossJoin(F.broadcast(mi))
    out = out.withColumn("fp", F.col("B") - F.col("tp")).withColumn("fn", F.col("A") - F.col("tp"))
    return out.withColumn("tn", _pairs(F.col("n")) - F.col("tp") - F.col("fp") - F.col("fn"))




def _indices() -> dict[str, Column]:
    tp, fp, fn, tn, n, a, b, mi = (F.col(c) for c in ("tp", "fp", "fn", "tn", "n", "A", "B", "mi"))
    div = F.try_divide
    every = _pairs(n)
    expected = div(a * b, every)
    return {
        "tp": tp, "fp": fp, "fn": fn, "tn": tn,
        "accuracy": div(tp + tn, tp + tn + fp + fn),
        "precision": div(tp, tp + fp),
        "recall": div(tp, tp + fn),
        "f1": div(2 * tp, 2 * tp + fp + fn),
        "mcc": div(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))),
        "mcnemar": div(fn - fp, F.sqrt(fn + fp)),
        "rand": div(tp + tn, every),
        "adjusted_rand": div(tp - expected, (a + b) / 2 - expected),
        "jaccard": div(tp, tp + fp + fn),
        "fowlkes_mallows": div(tp, F.sqrt((tp + fp) * (tp + fn))),
        "kulczynski": (div(tp, tp + fp) + div(tp, tp + fn)) / 2,
        "rogers_tanimoto": div(tp + tn, tp + tn + 2 * (fp + fn)),
        "russel_rao": div(tp, every),
        "sokal_sneath_1": div(tp, tp + 2 * (fp + fn)),
        "sokal_sneath_2": div(tp + tn, tp + tn + (fp + fn) / 2),
        "mutual_information": mi,
        "nmi_max": div(mi, F.greatest("h_truth", "h_pred")),
        "nmi_sqrt": div(mi, F.sqrt(F.col("h_truth") * F.col("h_pred"))),
        "purity": F.col("purity"),
    }




def external_indices(df: DataFrame, pred: str, truth: str) -> DataFrame:
    """All external indices in one row."""
    return pair_counts(contingency(df, pred, truth)).select(*[c.alias(k) for k, c in _indices().items()])


def _scatter(df: DataFrame, representation: str, cluster: str, squared: bool) -> tuple[DataFrame, DataFrame]:
    centres = barycenters(df, representation, cluster)
    rows = df.select(F.col(cluster).alias("cluster"), F.col(representation).alias("x")).join(centres, "cluster")
    d = arrays.euclidean(F.col("x"), F.col("barycenter"), squared)
    return centres, rows.groupBy("cluster").agg(F.avg(d).alias("scatter"))


def davies_bouldin(df: DataFrame, representation: str, cluster: str) -> DataFrame:
    """One row, ``davies_bouldin``: mean over clusters of the worst (S_i + S_j) / d(c_i, c_j)."""
    centres, scatter = _scatter(df, representation, cluster, False)
    s = centres.join(scatter, "cluster")
    other = s.select(F.col("cluster").alias("c2"), F.col("barycenter").alias("b2"), F.col("scatter").alias("s2"))
    worst = s.join(other, F.col("cluster") != F.col("c2")).groupBy("cluster").agg(F.max(F.try_divide(F.col("scatter") + F.col("s2"), arrays.euclidean(F.col("barycenter"), F.col("b2"), False))).alias("worst"))
    return worst.agg(F.avg("worst").alias("davies_bouldin"))


def ball_hall(df: DataFrame, representation: str, cluster: str) -> DataFrame:
    """One row, ``ball_hall``: mean over clusters of the mean squared distance to the barycenter."""
    return _scatter(df, representation, cluster, True)[1].agg(F.avg("scatter").alias("ball_hall"))


class EvaluationOps:
    def external_evaluation(self, pred: str, truth: str) -> DataFrame:
        return external_indices(self.df, pred, truth)

    def contingency_table(self, pred: str, truth: str) -> DataFrame:
        return contingency(self.df, pred, truth)

    def contingency_matrix(self, pred: str, truth: str) -> list[list[int]]:
        """Counts by sorted truth and prediction, on the driver: one cell per pair of clusters."""
        rows = contingency(self.df, pred, truth).collect()
        truths, preds = sorted({r.truth for r in rows}), sorted({r.pred for r in rows})
        found = {(r.truth, r.pred): r.n for r in rows}
        return [[found.get((t, p), 0) for p in preds] for t in truths]

    def _index(self, name: str, pred: str, truth: str) -> float | None:
        return pair_counts(contingency(self.df, pred, truth)).select(_indices()[name]).first()[0]

    def f_beta(self, pred: str, truth: str) -> Callable[[float], float]:
        """The F index for any beta; null, as all indices, for a zero divisor."""
        r = pair_counts(contingency(self.df, pred, truth)).first()
        tp, fn, fp = (x or 0 for x in (r.tp, r.fn, r.fp)) if r else (0, 0, 0)

        def f(beta: float) -> float | None:
            divisor = (1 + beta**2) * tp + beta**2 * fn + fp
            return (1 + beta**2) * tp / divisor if divisor else None

        return f

    def davies_bouldin(self, representation: str, cluster: str) -> float | None:
        return davies_bouldin(self.df, representation, cluster).first()[0]

    def ball_hall(self, representation: str, cluster: str) -> float | None:
        return ball_hall(self.df, representation, cluster).first()[0]


def _method(name: str) -> Callable:
    def f(self, pred: str, truth: str) -> float | None:
        return self._index(name, pred, truth)

    f.__name__ = name
    f.__doc__ = f"The {name.replace('_', ' ')} index of two clusterings."
    return f


INDEX_NAMES = ("tp", "fp", "fn", "tn", "accuracy", "precision", "recall", "f1", "mcc", "mcnemar", "rand", "adjusted_rand", "jaccard", "fowlkes_mallows", "kulczynski", "rogers_tanimoto", "russel_rao", "sokal_sneath_1", "sokal_sneath_2", "mutual_information", "nmi_max", "nmi_sqrt", "purity")
for _name in INDEX_NAMES:
    setattr(EvaluationOps, _name, _method(_name))
