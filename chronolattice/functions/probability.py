"""Small numeric helpers of the model-based methods (numpy, on the driver or in a task)."""

from __future__ import annotations

from itertools import combinations_with_replacement

import numpy as np


def log_sum_exp(values: np.ndarray, axis: int | None = None) -> np.ndarray:
    """log of the sum of exponentials, -inf for nothing but -inf."""
    v = np.asarray(values, float)
    top = v.max(axis=axis, keepdims=True)
    safe = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        out = np.log(np.exp(v - safe).sum(axis=axis, keepdims=True)) + safe
    return out.reshape(()) if axis is None else np.squeeze(out, axis)


def sample(probabilities: np.ndarray, rng: np.random.Generator, threshold: float = 1e-12) -> int:
    """An index drawn with the given (unnormalised) probabilities; an error if their sum is under ``threshold``."""
    p = np.asarray(probabilities, float)
    if not p.sum() > threshold:
        raise ValueError("probabilities sum to nothing")
    return int(min(np.searchsorted(np.cumsum(p / p.sum()), rng.random(), side="right"), len(p) - 1))


def sample_rows(log_weights: np.ndarray, uniform: np.ndarray) -> np.ndarray:
    """An index for each row of log weights, by inversion of the row's uniform number."""
    p = np.exp(log_weights - log_sum_exp(log_weights, axis=1)[:, None])
    return np.minimum((np.cumsum(p, axis=1) < uniform[:, None]).sum(1), log_weights.shape[1] - 1)


def mean_in_order(values: np.ndarray) -> float:
    """Mean of a sum in the order of the values, as SQL adds them: numpy's own sums go by pairs and may differ in the last bit."""
    return float(np.add.accumulate(np.asarray(values, float))[-1] / len(values))


def variance(values: np.ndarray) -> float:
    return float(np.var(values, ddof=1))


def covariance(x: np.ndarray, y: np.ndarray) -> float:
    """Unbiased covariance of two samples."""
    return float(((x - x.mean()) * (y - y.mean())).sum() / (len(x) - 1))


def covariance_about(rows: np.ndarray, mode: np.ndarray, diagonal: bool = False) -> np.ndarray:
    """Second moments about a given mode (divided by n)."""
    d = rows - mode
    c = d.T @ d / len(rows)
    return np.diag(np.diag(c)) if diagonal else c


def weighted_covariance(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    mx, my = np.average(x, weights=w), np.average(y, weights=w)
    return float((w * (x - mx) * (y - my)).sum() / w.sum())


def weighted_covariance_about(rows: np.ndarray, w: np.ndarray, mode: np.ndarray, diagonal: bool = False) -> np.ndarray:
    d = rows - mode
    c = (d * w[:, None]).T @ d / w.sum()
    return np.diag(np.diag(c)) if diagonal else c


def weighted_mean(rows: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.average(rows, axis=0, weights=w)


def soft_labels(labels: np.ndarray, k: int, log: bool = False, floor: float = 1e-8) -> np.ndarray:
    """Rows near one-hot: 1 at the label, ``floor`` elsewhere, normalised."""
    out = np.full((len(labels), k), floor)
    out[np.arange(len(labels)), labels] = 1.0
    out /= out.sum(1, keepdims=True)
    return np.log(out) if log else out


def map_labels(probabilities: np.ndarray) -> np.ndarray:
    return np.asarray(probabilities).argmax(1)


def labels_of_sizes(sizes: list[int]) -> np.ndarray:
    """0 repeated sizes[0] times, then 1, and so on."""
    return np.repeat(np.arange(len(sizes)), sizes)


def proportions(labels: np.ndarray, k: int | None = None) -> np.ndarray:
    n = np.bincount(labels, minlength=k or 0).astype(float)
    return n / n.sum()


def joint_labels(partitions: np.ndarray) -> np.ndarray:
    """One label for each distinct row of labels, in order of first appearance."""
    seen: dict[tuple, int] = {}
    return np.array([seen.setdefault(tuple(r), len(seen)) for r in np.asarray(partitions)])


def same_partition(a: np.ndarray, b: np.ndarray) -> bool:
    """Equal up to names of the labels."""
    pairs = set(zip(map(int, a), map(int, b)))
    return len(a) == len(b) and len(pairs) == len({p for p, _ in pairs}) == len({q for _, q in pairs})


def split_label(labels: np.ndarray, old: int, inner: np.ndarray) -> np.ndarray:
    """Splits label ``old`` by the inner labels of its members; the new parts are numbered last."""
    labels = np.asarray(labels).copy()
    members = np.flatnonzero(labels == old)
    fresh = labels.max() + 1
    labels[members] = np.where(np.asarray(inner) == 0, old, fresh + np.asarray(inner) - 1)
    return labels


def size_combinations(most: int, length: int) -> list[tuple[int, ...]]:
    """All multisets of ``length`` numbers from 1 to ``most``."""
    return list(combinations_with_replacement(range(1, most + 1), length))


def round_half_up(value: float, digits: int) -> float:
    return float(np.floor(value * 10**digits + 0.5) / 10**digits)


def gaussian_log_density(x: np.ndarray, mean: np.ndarray, cov: np.ndarray, ridge: float = 0.0) -> np.ndarray:
    """Log density of rows; a singular covariance is used through its pseudo-inverse and pseudo-determinant."""
    values, vectors = np.linalg.eigh(cov + ridge * np.eye(len(cov)))
    keep = values > max(values.max(), 0.0) * len(cov) * 2.2e-16
    if not keep.any():
        raise np.linalg.LinAlgError("covariance of rank 0")
    z = (x - mean) @ vectors[:, keep] / np.sqrt(values[keep])
    return -0.5 * ((z * z).sum(1) + np.log(values[keep]).sum() + len(mean) * np.log(2 * np.pi))
