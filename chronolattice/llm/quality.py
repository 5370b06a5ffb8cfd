"""Quality classifier: random-indexing word vectors, pooled per document, into a two-layer network.

Words and runs of signs are hashed into 2**``BITS`` buckets.  Every bucket has a
sparse ternary index vector; its context vector is the sum of the index vectors
of its neighbours over the whole corpus.  Partitions add up what their own words
meet, as exact integers, and send the entries that are not zero; two rounds of
salted shuffles add those up, so what reaches the driver is one matrix of 2**BITS
rows at any input size.  A word's vector is its context vector at length 1.  A
document's is pooled from its words': their mean, their deviation, and the root
mean square step from each to the next, dimension by dimension.  A network of one
hidden layer is trained with numpy on at most ``SAMPLE`` labelled documents (those
of least hash; a parameter), a fifth of them kept aside to fit the temperature
that calibrates its probabilities.  Labels come only from rows whose crc32(id)
mod 4 is not 2; id, language, source and label are no inputs.

Edge cases.  Null and empty texts have the zero vector and get its score.  Null
labels are left out; an id labelled twice counts by its mean.  Without labels of
both kinds every score is the share of label 1 (0.5 without labels).  Rows that
repeat an id are scored one by one.  Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._common import give_back
from ._words import SIGNS, chunks, mix, word_hashes

BITS = 18
BUCKETS = 1 << BITS
DIM = 64
NONZERO = 4
HIDDEN = 32
#: Inputs of the network.
WIDTH = 3 * DIM
#: Most labelled documents that the network is trained on.
SAMPLE = 20_000
THRESHOLD = 0.7
EPOCHS = 40
_ROWS = 256
_SALTS = 4
#: Words whose vectors are in hand at once.
_PIECE = 1 << 12


@cache
def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Of each bucket's index vector: where it is not zero (one place in each of NONZERO parts), and the signs there."""
    b = np.arange(BUCKETS, dtype=np.uint64)[:, None] * np.uint64(NONZERO) + np.arange(NONZERO, dtype=np.uint64)
    h, part = mix(b + np.uint64(0x5851F42D4C957F2D)), DIM // NONZERO
    places = np.arange(NONZERO) * part + (h % np.uint64(part)).astype(np.int64)
    return places.astype(np.int8), np.where(h >> np.uint64(63), 1, -1).astype(np.int32)


def buckets_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    h, doc = word_hashes(texts, SIGNS)
    return (h >> np.uint64(64 - BITS)).astype(np.int64), doc


def add_contexts(sums: np.ndarray, texts: list[bytes]) -> None:
    """Adds to each bucket's row its neighbours' index vectors, and in the last column how often it occurs."""
    w, doc = buckets_of(texts)
    places, signs = index_vectors()
    flat, together = sums.reshape(-1), doc[1:] == doc[:-1]
    for of, other in ((w[:-1][together], w[1:][together]), (w[1:][together], w[:-1][together])):
        for k in range(NONZERO):
            np.add.at(flat, of * (DIM + 1) + places[other, k], signs[other, k])
    np.add.at(flat, w * (DIM + 1) + DIM, 1)


def context_sums(docs: DataFrame, text_col: str) -> Iterator[tuple[int, np.ndarray]]:
    """First bucket and rows of each part that occurs: sums of neighbours' index vectors, and counts, over all documents."""
    texts = docs.select(docs[text_col].alias("text"))
    #: Entries under 128 are sent as a byte, all others as 8.
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("salt", T.IntegerType()), *[T.StructField(c, T.BinaryType()) for c in ("small", "few", "large", "many")]])

    def batch(part: int, salt: int, sums: np.ndarray) -> pa.RecordBatch:
        places = np.flatnonzero(sums)
        small = np.abs(sums[places]) < 128
        packed = [x.tobytes() for x in (places[small].astype(np.uint16), sums[places[small]].astype(np.int8), places[~small].astype(np.uint16), sums[places[~small]])]
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([salt], pa.int32()), *[pa.array([x], pa.binary()) for x in packed]], schema.names)

    def parse(small: bytes, few: bytes, large: bytes, many: bytes) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate((np.frombuffer(small, np.uint16), np.frombuffer(large, np.uint16))), np.concatenate((np.frombuffer(few, np.int8).astype(np.int64), np.frombuffer(many, np.int64)))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((BUCKETS, DIM + 1), np.int32)
        for b in batches:
            for _, part in chunks(t.encode() for t in b.column(0).to_pylist() if t):
                add_contexts(sums, part)
        salt = int(sums[:, DIM].sum()) % _SALTS
        for k in np.flatnonzero(sums[:, DIM].reshape(-1, _ROWS).any(1)):
            yield batch(int(k), salt, sums[k * _ROWS : (k + 1) * _ROWS].ravel().astype(np.int64))
        del sums
        give_back()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, np.zeros(0, np.int64)
        for b in batches:
            for part, salt, *raw in zip(*[c.to_pylist() for c in b.columns]):
                if (part, salt) != key:
                    if key:
                        yield batch(key[0], 0, held)
                    key, held = (part, salt), np.zeros(_ROWS * (DIM + 1), np.int64)
                places, values = parse(*raw)
                held[places] += values
        if key:
            yield batch(key[0], 0, held)

    partial = texts.mapInArrow(count, schema).repartition("part", "salt").sortWithinPartitions("part", "salt").mapInArrow(add, schema)
    for row in partial.repartition("part").sortWithinPartitions("part").mapInArrow(add, schema).toLocalIterator(prefetchPartitions=True):
        places, values = parse(*row[2:])
        sums = np.zeros(_ROWS * (DIM + 1), np.int64)
        sums[places] = values
        yield row.part * _ROWS, sums.reshape(_ROWS, DIM + 1)


def word_vectors(parts: Iterable[tuple[int, np.ndarray]]) -> np.ndarray:
    """BUCKETS x DIM: context vectors of length 1."""
    out = np.zeros((BUCKETS, DIM), np.float16)
    for first, sums in parts:
        norm = np.linalg.norm(sums[:, :DIM], axis=1, keepdims=True)
        out[first : first + len(sums)] = sums[:, :DIM] / np.maximum(norm, 1)
    return out


def _pooled(w: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Mean, deviation and step of the vectors of one text's words, a piece of the text at a time."""
    total, squares, steps = np.zeros((3, DIM))
    n = len(w)
    for k in range(0, n, _PIECE):
        v = vectors[w[max(k - 1, 0) : k + _PIECE]].astype(np.float32, copy=False)
        d = v[1:] - v[:-1]
        steps += np.einsum("ij,ij->j", d, d)
        v = v[min(k, 1) :]
        total += v.sum(0)
        squares += np.einsum("ij,ij->j", v, v)
    mean = total / n
    return np.concatenate((mean, np.sqrt(np.maximum(squares / n - mean**2, 0)), np.sqrt(steps / max(n - 1, 1))))


def features(texts: list[bytes], vectors: np.ndarray) -> np.ndarray:
    """WIDTH inputs of each text: mean, deviation and step of its words' vectors."""
    out = np.zeros((len(texts), WIDTH))
    for start, part in chunks(texts):
        w, doc = buckets_of(part)
        edges = np.searchsorted(doc, np.arange(len(part) + 1)).tolist()
        for k, (a, b) in enumerate(zip(edges, edges[1:])):
            if a < b:
                out[start + k] = _pooled(w[a:b], vectors)
    return out


@dataclass
class Network:
    """Standardised inputs, one hidden layer, a temperature."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum((x - self.mean) / self.scale @ self.w1 + self.b1, 0) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -60, 60)))


def train(x: np.ndarray, y: np.ndarray, seed: int = 3) -> Network:
    """Adam on the logistic loss; the temperature is fitted to a fifth of the rows, which the weights have not seen."""
    n, d = x.shape
    rng = np.random.default_rng(seed)
    net = Network(np.zeros(d), np.ones(d), rng.normal(0, np.sqrt(2 / d), (d, HIDDEN)), np.zeros(HIDDEN), np.zeros(HIDDEN), 0.0)
    share = float(np.clip(y.mean(), 1e-3, 1 - 1e-3)) if n else 0.5
    net.b2 = float(np.log(share / (1 - share)))
    order = rng.permutation(n)
    aside, used = order[: n // 5], order[n // 5 :]
    if len(np.unique(y[used])) < 2:
        return net
    net.mean, net.scale = x[used].mean(0), x[used].std(0) + 1e-6
    z = (x - net.mean) / net.scale
    net.w2 = rng.normal(0, np.sqrt(1 / HIDDEN), HIDDEN)
    params = [net.w1, net.b1, net.w2, np.array([net.b2])]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    t = 0
    for epoch in range(EPOCHS):
        rate = 3e-3 * (1 - epoch / EPOCHS)
        shuffled = rng.permutation(used)
        for k in range(0, len(shuffled), 256):
            rows = shuffled[k : k + 256]
            h = np.maximum(z[rows] @ params[0] + params[1], 0)
            p = 1 / (1 + np.exp(-np.clip(h @ params[2] + params[3], -60, 60)))
            e = (p - y[rows]) / len(rows)
            back = np.outer(e, params[2]) * (h > 0)
            grads = [z[rows].T @ back + 1e-4 * params[0], back.sum(0), h.T @ e, np.array([e.sum()])]
            t += 1
            for q, g, (m, v) in zip(params, grads, moments):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                q -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = *params[:3], float(params[3][0])
    if len(aside):
        logits, truth = net.logits(x[aside]), y[aside]
        losses = {t: np.logaddexp(0, -np.where(truth > 0.5, 1, -1) * logits / t).mean() for t in np.geomspace(0.25, 8, 61)}
        net.temperature = float(min(losses, key=losses.get))
    return net


def held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string")) % 4 == 2, F.lit(False))


@dataclass
class QualityModel:
    #: The word vectors, sent to every executor once.
    vectors: Broadcast
    network: Network


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> QualityModel:
    shared = docs.sparkSession.sparkContext.broadcast(word_vectors(context_sums(docs, text_col)))
    known = labels.where(labels[label_col].isNotNull() & labels[id_col].isNotNull() & ~held_out(labels[id_col]))
    known = known.groupBy(labels[id_col].alias("known_id")).agg((F.avg(label_col) >= 0.5).cast("double").alias("truth"))
    known = known.orderBy(F.xxhash64(F.lit(1), "known_id"), "known_id").limit(sample)
    chosen = docs.select(docs[id_col].alias("own_id"), docs[text_col].alias("text")).join(F.broadcast(known), F.col("own_id") == F.col("known_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in batches:
            x = features([(t or "").encode() for t in b.column(2).to_pylist()], own)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([r.tobytes() for r in x], pa.binary())], ["id", "truth", "x"])
        del own
        give_back(shared)

    rows = chosen.select(F.col("own_id").cast("string").alias("id"), "truth", "text").mapInArrow(run, "id string, truth double, x binary").collect()
    rows.sort(key=lambda r: (r.id, r.x))
    x = np.array([np.frombuffer(r.x) for r in rows]).reshape(len(rows), WIDTH)
    return QualityModel(shared, train(x, np.array([r.truth for r in rows])))


def score(docs: DataFrame, model: QualityModel, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """``docs`` with the score of each whole text in ``out_col`` (which replaces a column of that name)."""
    kept = docs.drop(out_col) if text_col != out_col else docs
    shared, network = model.vectors, model.network
    at = kept.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in batches:
            s = network.scores(features([(t or "").encode() for t in b.column(at).to_pylist()], own))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(s, pa.float64())], [*b.schema.names, out_col])
        del own
        give_back(shared)

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField(out_col, T.DoubleType())]))


def assess(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    model = fit(docs, labels, id_col, text_col, sample=sample)
    scored = score(docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")), model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """The documents that the classifier does not reject, with the columns they came with."""
    model = fit(docs, labels, id_col, text_col, sample=sample)
    name = "quality_score"
    while name in docs.columns:
        name += "_"
    return score(docs, model, text_col, name).where(F.col(name) >= threshold).drop(name)
