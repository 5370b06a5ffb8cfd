"""Near-duplicate vectors by an inverted multi-index.

Each half of the (normalised) vectors has a codebook of its own; the product of
the two is a grid of cells.  Codebooks are fitted by k-means on at most
``SAMPLE`` vectors (those of least hash; a parameter), and every vector is
indexed.  A vector visits the cells nearest to it in the order of the
multi-sequence algorithm.  How many is measured on the sample: enough that the
sample's own pairs, and pairs made at the threshold itself, are found with at
least ``TARGET_RECALL``, be it the whole grid.  Candidates are verified by cosine
in double precision.  Codebooks grow with the square root of the table, to a
sixteenth of the sample: for more than about 3e9 vectors raise ``sample``.

Only vectors of equal label meet.  Cells of any size are dealt in blocks of
``BLOCK`` stored vectors by ``CHUNK`` visiting ones, so no task gets a whole hot
cell, and a block returns one row per vector (its number of links, the root of
its local component), never pairs.  A pair found from both sides is counted
once: stored vectors carry their own visits, and count a visitor only if they
will not find it themselves.  Components are joined across blocks by
:func:`components`.

Edge cases.  A null label, a null or zero vector, one with null or non-finite
components or none: no links, its own component.  Vectors of different lengths
do not link; each length has its own index.  Rows that repeat an id are vectors
of their own that share the smallest id.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialise
from ._graph import components

COSINE = 0.93
SAMPLE = 20_000
TARGET_RECALL = 0.995
BLOCK, CHUNK = 1024, 2048


def normalised(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def matrix(column: pa.Array | pa.ChunkedArray, kind: type) -> np.ndarray:
    """Lists of one length, without nulls, as the rows of a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(column), -1)


def k_means(x: np.ndarray, k: int, rounds: int = 12, seed: int = 1) -> np.ndarray:
    centres = x[np.random.default_rng(seed).choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        nearest = np.concatenate([distances(x[i : i + 4096], centres).argmin(1) for i in range(0, len(x), 4096)])
        for c in np.unique(nearest):
            centres[c] = x[nearest == c].mean(0)
    return centres


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x * x).sum(1)[:, None] + (centres * centres).sum(1) - 2 * x @ centres.T


def nearest_cells(one: np.ndarray, two: np.ndarray, count: int) -> np.ndarray:
    """For each row, the ``count`` cells (all, if fewer) of least distance one[i] + two[j], nearest first.

    What the multi-sequence algorithm visits, for many rows at once: among the first ``count``
    cells, the i-th nearest centre of one half meets the j-th of the other only if i * j <= count,
    for the i * j cells of nearer or equal centres go before or with it.
    """
    a, b = np.argsort(one, axis=1, kind="stable"), np.argsort(two, axis=1, kind="stable")
    count = min(count, one.shape[1] * two.shape[1])
    i, j = np.nonzero(np.arange(1, one.shape[1] + 1)[:, None] * np.arange(1, two.shape[1] + 1) <= count)
    order = np.argsort((i + 1) * (j + 1), kind="stable")
    i, j = i[order], j[order]
    out, step = np.empty((len(one), count), np.int32), max(1, (1 << 21) // len(i))
    p, q = np.take_along_axis(one, a, 1), np.take_along_axis(two, b, 1)
    for k in range(0, len(one), step):
        rows = slice(k, k + step)
        sums = p[rows][:, i] + q[rows][:, j]
        best = np.argpartition(sums, count - 1, axis=1)[:, :count] if count < len(i) else np.broadcast_to(np.arange(count), (len(sums), count))
        best = np.take_along_axis(best, np.argsort(np.take_along_axis(sums, best, 1), axis=1, kind="stable"), 1)
        out[rows] = np.take_along_axis(a[rows], i[best], 1) * two.shape[1] + np.take_along_axis(b[rows], j[best], 1)
    return out


class MultiIndex:
    def __init__(self, sample: np.ndarray, labels: np.ndarray, total: int, cosine: float, recall: float) -> None:
        self.half = sample.shape[1] // 2
        k = int(np.clip(round(np.sqrt(total / 2000)), 8, max(8, len(sample) // 16)))
        self.books = [k_means(h, k) for h in (sample[:, : self.half], sample[:, self.half :])]
        self.visits = self._needed(sample, labels, cosine, recall)

    def visited(self, x: np.ndarray, count: int) -> np.ndarray:
        """Cells nearest to each vector, its own first."""
        return nearest_cells(distances(x[:, : self.half], self.books[0]), distances(x[:, self.half :], self.books[1]), count)

    def ranks(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        """As which of its cells, of the whole grid, each vector of u visits that of its partner in v."""
        (a, b), (c, d) = ([distances(h, book) for h, book in zip((x[:, : self.half], x[:, self.half :]), self.books)] for x in (u, v))
        return np.array([(p[:, None] + q <= p[i] + q[j]).sum() for p, q, i, j in zip(a, b, c.argmin(1), d.argmin(1))])

    def _needed(self, x: np.ndarray, labels: np.ndarray, cosine: float, recall: float) -> int:
        """Cells to visit, so that of either kind of pairs at least ``recall`` is found from one side or the other."""
        rng = np.random.default_rng(2)
        base = x[rng.choice(len(x), min(len(x), 1500), replace=False)]
        z = rng.normal(size=base.shape)
        z -= (z * base).sum(1, keepdims=True) * base
        made = cosine * base + np.sqrt(1 - cosine * cosine) * z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)
        sides = [(base, made)]
        firsts, seconds = [], []
        for label in np.unique(labels):
            own = np.flatnonzero(labels == label)
            for k in range(0, len(own), 500):
                p, q = np.nonzero(x[own[k : k + 500]] @ x[own].T >= cosine)
                firsts.append(own[p + k][p + k < q])
                seconds.append(own[q][p + k < q])
        firsts, seconds = np.concatenate(firsts), np.concatenate(seconds)
        pick = rng.permutation(len(firsts))[:1500]
        sides.append((x[firsts[pick]], x[seconds[pick]]))
        ranks = [np.sort(np.minimum(self.ranks(u, v), self.ranks(v, u))) for u, v in sides if len(u)]
        need = max([1, *(int(r[min(len(r) - 1, int(np.ceil(recall * len(r))))]) for r in ranks)])
        self.recalls = [float((r <= need).mean()) for r in ranks]
        return need


def _block(table: pa.Table, cosine: float) -> pa.Table:
    """uid, n, root of the vectors that have a link in one block."""
    stored = table.column("stored").to_numpy().astype(bool)
    uid = table.column("uid").to_numpy()
    x = normalised(matrix(table.column("embedding"), np.float64))
    visits = matrix(table.column("visits"), np.int64)
    du, pu = uid[stored], uid[~stored]
    near = x[~stored] @ x[stored].T >= cosine
    near &= pu[:, None] != du
    n_visitor = near.sum(1)
    n_stored = np.zeros(len(du), np.int64)
    own, seen = visits[~stored, 0], visits[stored]
    for cell in np.unique(own):
        n_stored += near[own == cell].sum(0) * ~(seen == cell).any(1)
    roots_p, roots_d = pu.copy(), du.copy()
    big = np.iinfo(np.int64).max
    while near.size:
        p = np.minimum(roots_p, np.where(near, roots_d, big).min(1))
        d = np.minimum(roots_d, np.where(near, p[:, None], big).min(0))
        if (p == roots_p).all() and (d == roots_d).all():
            break
        roots_p, roots_d = p, d
    u, n, root = np.concatenate((pu, du)), np.concatenate((n_visitor, n_stored)), np.concatenate((roots_p, roots_d))
    some = (n > 0) | (u != root)
    return pa.table({"uid": u[some], "n": n[some], "root": root[some]})


def _linked(rows: DataFrame, cosine: float, recall: float, sample: int) -> DataFrame:
    """uid, n, root of rows (uid, label, embedding) of one length."""
    total = rows.count()
    chosen = rows.orderBy(F.xxhash64(F.lit(3), "uid"), "uid").limit(sample).select("label", "embedding").collect()
    x = normalised(np.array([r.embedding for r in chosen], np.float64))
    _, codes = np.unique([str(r.label) for r in chosen], return_inverse=True)
    index = MultiIndex(x, codes, total, cosine, recall)
    shared = rows.sparkSession.sparkContext.broadcast(index)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                v = normalised(matrix(b.column("embedding"), np.float64))
                cells = shared.value.visited(v, shared.value.visits)
                cells = pa.ListArray.from_arrays(np.arange(len(cells) + 1, dtype=np.int32) * cells.shape[1], cells.ravel())
                yield pa.RecordBatch.from_arrays([*b.columns, cells], [*b.schema.names, "visits"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)
    placed = materialise(rows.mapInArrow(assign, f"{kinds}, visits array<int>"), "vector-cells")
    stored = placed.withColumn("cell", F.get("visits", F.lit(0)))
    visiting = placed.withColumn("cell", F.explode("visits"))
    n_stored = stored.groupBy("label", "cell").agg(F.count(F.lit(1)).alias("n_stored"))
    n_visiting = visiting.groupBy("label", "cell").agg(F.count(F.lit(1)).alias("n_visiting"))
    grid = n_stored.join(n_visiting, ["label", "cell"]).select("label", "cell", F.ceil(F.col("n_stored") / BLOCK).cast("int").alias("blocks"), F.ceil(F.col("n_visiting") / CHUNK).cast("int").alias("parts"))
    grid = materialise(grid, "vector-grid")
    side = lambda of: F.pmod(F.xxhash64(F.lit(9), "uid"), F.col(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    base = ["label", "cell", "uid", "embedding", "visits"]
    a = stored.join(grid, ["label", "cell"]).withColumn("block", side("blocks")).withColumn("part", every("parts")).select(*base, "block", "part", F.lit(1).alias("stored"))
    b = visiting.join(grid, ["label", "cell"]).withColumn("part", side("parts")).withColumn("block", every("blocks")).select(*base, "block", "part", F.lit(0).alias("stored"))
    return a.unionByName(b).groupBy("label", "cell", "block", "part").applyInArrow(lambda t: _block(t, cosine), "uid long, n long, root long")


def vector_classes(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", cosine: float = COSINE, recall: float = TARGET_RECALL, sample: int = SAMPLE) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    v = vectors[vector_col]
    fine = lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf"))
    usable = vectors[label_col].isNotNull() & v.isNotNull() & F.forall(v, fine) & F.exists(v, lambda e: e != 0)
    slim = vectors.select(vectors[id_col].alias("vec_id"), vectors[label_col].alias("label"), v.alias("embedding"), F.coalesce(usable, F.lit(False)).alias("usable"))
    slim = materialise(slim.withColumn("uid", F.monotonically_increasing_id()), "vectors")
    rows = slim.where("usable").select("uid", "label", "embedding")
    found = None
    for length in sorted(r[0] for r in rows.select(F.size("embedding")).distinct().collect()):
        part = _linked(rows.where(F.size("embedding") == length), cosine, recall, sample)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return slim.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = materialise(found, "vector-links")
    groups = components(found.select(F.col("uid").alias("u"), F.col("root").alias("v")))
    counts = found.groupBy("uid").agg(F.sum("n").alias("n_links"))
    placed = slim.select("vec_id", "uid").join(counts, "uid", "left").join(groups.withColumnRenamed("node", "uid"), "uid", "left")
    placed = placed.withColumn("component", F.coalesce("component", "uid"))
    least = placed.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    out = placed.join(least, "component")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
