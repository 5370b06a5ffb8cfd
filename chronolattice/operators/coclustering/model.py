"""The block model and its one kernel.

Rows of n observations hold p cells, each a vector of d numbers.  There are L
column clusters; the plain model has one partition of the rows into K clusters,
the conditional model one for each column cluster l, into K_l clusters.  Every
block (l, k) is Gaussian; the functional variants first project a block's
cells on principal axes of their own.

:func:`sweep` does all the work on one batch of rows, for given column weights:
it draws (or weighs, or takes the best of) the rows' clusters and returns sums
over the batch.  Row labels are never stored: they are drawn by hashing the row
id with the seed, so any pass can draw them again.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from chronolattice.functions.probability import log_sum_exp


@dataclass
class BlockModel:
    """row_props: L x K (rows equal in the plain model, 0 beyond K_l); col_props: L; means: L x K x d; covariances: L x K x d x d.

    Functional models have loadings[l][k] (axes x d) and centres (L x K x d);
    their Gaussians are centred on the projection.
    """

    row_props: np.ndarray
    col_props: np.ndarray
    means: np.ndarray
    covariances: np.ndarray
    sizes: list[int]
    conditional: bool
    loadings: list[list[np.ndarray]] | None = None
    _factors: list | None = field(default=None, repr=False, compare=False)

    @property
    def functional(self) -> bool:
        return self.loadings is not None

    @property
    def gaussians(self) -> list[list[tuple[np.ndarray, np.ndarray]]]:
        return [[(self.means[c, k], self.covariances[c, k]) for k in range(self.sizes[c])] for c in range(len(self.sizes))]

    def factors(self) -> list:
        """Per block: whitening matrix (d x rank), centre, log normaliser."""
        if self._factors is None:
            self._factors = []
            for c, size in enumerate(self.sizes):
                row = []
                for k in range(size):
                    mean, cov = self.means[c, k], self.covariances[c, k]
                    axes = self.loadings[c][k] if self.functional else None
                    inner = axes @ cov @ axes.T if self.functional else cov
                    values, vectors = np.linalg.eigh(inner)
                    keep = values > max(values.max(), 0.0) * max(len(inner), 1) * 2.2e-16
                    if not keep.any():
                        raise np.linalg.LinAlgError("a block's covariance has rank 0")
                    white = vectors[:, keep] / np.sqrt(values[keep])
                    row.append((axes.T @ white if self.functional else white, mean, np.log(values[keep]).sum() + len(inner) * np.log(2 * np.pi)))
                self._factors.append(row)
        return self._factors

    def log_density(self, x: np.ndarray) -> np.ndarray:
        """n x p x L x K log densities of cells (n x p x d), -inf beyond K_l."""
        n, p, _ = x.shape
        out = np.full((n, p, len(self.sizes), max(self.sizes)), -np.inf)
        for c, row in enumerate(self.factors()):
            for k, (white, mean, log_norm) in enumerate(row):
                z = (x - mean) @ white
                out[:, :, c, k] = -0.5 * ((z * z).sum(-1) + log_norm)
        return out

    def parameters(self, literal: bool = False) -> tuple[int, int, float]:
        """Free row shares, free column shares, block parameters."""
        d = self.means.shape[-1]
        if self.functional:
            per = sum((q := len(self.loadings[c][k])) + q * (q + 1) / 2 for c, s in enumerate(self.sizes) for k in range(s))
        else:
            blocks = sum(self.sizes)
            per = blocks * (d + d * (d + 1) / 2) * (len(self.sizes) if literal and self.conditional else 1)
        rows = sum(s - 1 for s in self.sizes) if self.conditional else self.sizes[0] - 1
        return rows, len(self.sizes) - 1, per


def uniform_of(ids: np.ndarray, *salts: int) -> np.ndarray:
    """A number in (0, 1) for each id, from its hash with the salts."""
    h = ids.astype(np.int64).view(np.uint64).copy()
    for s in salts:
        h = (h ^ np.uint64(s * 0x9E3779B97F4A7C15 % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(32)
    return ((h >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53


def row_weights(log_weights: np.ndarray, ids: np.ndarray, mode: str, salts: tuple[int, ...]) -> np.ndarray:
    """n x L x K weights from log weights: one-hot draws ("sample"), one-hot best ("best") or posteriors ("soft")."""
    total = log_sum_exp(log_weights, axis=2)
    p = np.exp(log_weights - total[..., None])
    if mode == "soft":
        return p
    if mode == "best":
        pick = p.argmax(2)
    else:
        u = np.stack([uniform_of(ids, *salts, c) for c in range(p.shape[1])], axis=1)
        last = (p > 0).cumsum(2).argmax(2)
        pick = np.minimum((p.cumsum(2) < u[..., None]).sum(2), last)
    return np.eye(p.shape[2])[pick]


def row_log_weights(model: BlockModel, density: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """n x L x K log weights of the rows' clusters given column weights (p x L); equal over l in the plain model."""
    safe = np.where(np.isfinite(density), density, 0.0)
    own = np.einsum("jc,njck->nck", columns, safe)
    with np.errstate(divide="ignore"):
        log_props = np.log(model.row_props)
    if model.conditional:
        return log_props[None] + own
    return np.repeat(log_props[:1][None] + own.sum(1, keepdims=True), len(model.sizes), axis=1)


def sums_of(x: np.ndarray, t: np.ndarray, columns: np.ndarray) -> dict[str, np.ndarray]:
    """Weighted counts, sums and outer products of the cells per block, and counts of rows per cluster."""
    w = np.einsum("nck,jc->njck", t, columns)
    flat, cells = w.reshape(-1, w.shape[2] * w.shape[3]), x.reshape(-1, x.shape[2])
    shape = w.shape[2:]
    d = x.shape[2]
    outer = np.stack([(cells * flat[:, [b]]).T @ cells for b in range(flat.shape[1])]) if len(cells) else np.zeros((flat.shape[1], d, d))
    return {"n": flat.sum(0).reshape(shape), "s": (flat.T @ cells).reshape(*shape, d), "q": outer.reshape(*shape, d, d), "rows": t.sum(0), "count": np.array(float(len(x)))}


def sweep(x: np.ndarray, ids: np.ndarray, model: BlockModel, columns: np.ndarray, mode: str, salts: tuple[int, ...] = ()) -> dict[str, np.ndarray]:
    """Sums over a batch: block moments, ``cols`` (p x L log weights of the columns), ``ll`` and row counts."""
    density = model.log_density(x)
    t = row_weights(row_log_weights(model, density, columns), ids, mode, salts)
    safe = np.where(np.isfinite(density), density, 0.0)
    per_cell = np.einsum("nck,njck->jc", t, safe)
    out = sums_of(x, t, columns)
    with np.errstate(divide="ignore", invalid="ignore"):
        log_props = np.where(model.row_props > 0, np.log(model.row_props), 0.0)
    shares = (t * log_props[None]).sum() if model.conditional else (t[:, 0] * log_props[0]).sum()
    entropy = 0.0
    if mode == "soft":
        one = t if model.conditional else t[:, :1]
        entropy = -(one * np.log(np.maximum(one, 1e-300))).sum()
    return out | {"cols": per_cell, "densities": np.array((per_cell * columns).sum()), "ll": np.array((per_cell * columns).sum() + shares + entropy)}


def random_sums(x: np.ndarray, ids: np.ndarray, sizes: list[int], conditional: bool, columns: np.ndarray, salts: tuple[int, ...]) -> dict[str, np.ndarray]:
    """Sums for row clusters drawn evenly at random."""
    k = max(sizes)
    pick = np.stack([(uniform_of(ids, *salts, c if conditional else 0) * sizes[c]).astype(int) for c in range(len(sizes))], axis=1)
    return sums_of(x, np.eye(k)[pick], columns)


def principal_axes(cov: np.ndarray, most: int, share: float = 0.99) -> np.ndarray:
    """Leading eigenvectors (axes x d) up to a share of the variance, between 1 and ``most``."""
    values, vectors = np.linalg.eigh(cov)
    values, vectors = np.maximum(values[::-1], 0.0), vectors[:, ::-1]
    reached = np.flatnonzero(np.cumsum(values) >= share * max(values.sum(), 1e-300))
    keep = int(np.clip(reached[0] + 1 if len(reached) else len(values), 1, most))
    axes = vectors[:, :keep].T
    return axes * np.where(axes[np.arange(keep), np.abs(axes).argmax(1)] < 0, -1.0, 1.0)[:, None]


def maximised(sums: dict[str, np.ndarray], columns: np.ndarray, sizes: list[int], conditional: bool, full: bool, axes: int | None, old: BlockModel | None, refresh: bool, soft: bool, ridge: float) -> BlockModel:
    """The model of greatest likelihood for given sums; an error if a cluster is empty."""
    n, s, q = sums["n"], sums["s"], sums["q"]
    d, means, covs = s.shape[-1], np.zeros_like(s), np.zeros_like(q)
    if (columns.sum(0) <= (1e-5 if soft else 0.5)).any():
        raise np.linalg.LinAlgError("a column cluster is empty")
    for c, size in enumerate(sizes):
        for k in range(size):
            weight = n[c, k]
            if weight <= (1e-5 if soft else 1.0):
                raise np.linalg.LinAlgError("a block is empty")
            mean = s[c, k] / weight
            cov = (q[c, k] - weight * np.outer(mean, mean)) / (weight if soft else weight - 1)
            means[c, k], covs[c, k] = mean, (cov if full else np.diag(np.diag(cov))) + ridge * np.eye(d)
    rows = sums["rows"] / max(float(sums["count"]), 1.0)
    loadings = None
    if axes is not None:
        if old is not None and old.functional and not refresh:
            loadings = old.loadings
        else:
            loadings = [[principal_axes(covs[c, k], axes) for k in range(sizes[c])] for c in range(len(sizes))]
    return BlockModel(rows, columns.mean(0), means, covs, list(sizes), conditional, loadings)


def averaged(models: list[BlockModel]) -> BlockModel:
    """Means of proportions, means and covariances; loadings of the last."""
    last = models[-1]
    mean = lambda name: np.mean([getattr(m, name) for m in models], axis=0)
    return BlockModel(mean("row_props"), mean("col_props"), mean("means"), mean("covariances"), last.sizes, last.conditional, last.loadings)


def icl(model: BlockModel, ll: float, n: int, p: int, literal: bool = False) -> float:
    """Integrated complete likelihood: log-likelihood less penalties in ln n, ln p and ln np."""
    rows, cols, blocks = model.parameters(literal)
    return ll - rows / 2 * np.log(n) - cols / 2 * np.log(p) - blocks / 2 * np.log(n * p)
