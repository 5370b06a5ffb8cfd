"""Near-duplicate documents by DartMinHash over weighted word shingles.

A document is its multiset of five-word shingles (lower case; a shorter text is
one shingle); similarity is weighted Jaccard, links need 0.8 or more.  Copy c
of a shingle is a unit of weight; darts of a unit arrive as a Poisson process on
the rank axis, derived from the unit's hash alone, so all documents share them.
A document looks at ranks up to (k ln k + 2k) / weight, each dart hits one of k
coordinates, and the earliest dart per coordinate is the signature: two
documents agree in a coordinate with probability equal to their similarity.
Documents with an empty coordinate look twice as far.  ``BANDS`` bands of
``BAND_ROWS`` coordinates are joined; at similarity 0.8 a pair shares no band
with probability (1 - 0.8**5)**32 = 3e-6.

Pairs are screened before they are checked: 4 bits of every coordinate are kept
beside a text, and a pair goes on if at most ``MOST_BITS`` of the 640 differ.  A
pair at similarity 0.8 differs in 64 bits on average, with a deviation of 11.6;
it fails the screen with probability 3e-7.  The screen is part of the join
condition, so texts that share a common passage emit no pairs.

Exact copies are joined first, by digest; the rest works on one representative
of each text.  No join emits the pairs of a bucket.  (1) Every member is screened
against the least member of each of its buckets; components of what passes are
clusters.  A cluster is dealt in blocks of about ``BLOCK`` texts or ``BLOCK_UNITS``
units; each compares all of its pairs and its texts with the cluster's least one,
exactly, by products of unit matrices, and returns at most one link per text.
Texts that this links with the least one, in a hot cluster nearly all, need no
more; the rest are compared with the whole cluster, block by block.  (2) Members
of one bucket in different clusters are joined under the screen, which lets few
pairs through, and those are checked; a bucket of more than ``DEAL`` members is
dealt in blocks of that many by as many.  All checks are exact (on the whole
multisets); classes are the components of the links.

Edge cases.  Null text links with nothing; its id is its class.  Texts without
words are linked only if equal.  A null id sorts first.  Rows that repeat id and
text get one answer, and only one of them is kept by :func:`keep_first`.  An
empty table gives an empty result.  Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._common import discard, give_back, materialise, packed, redealt, unpacked
from ._graph import components
from ._words import SPACES, chunks, mix, word_hashes

WORDS = 5
SIMILARITY = 0.8
BANDS, BAND_ROWS = 32, 5
COORDINATES = BANDS * BAND_ROWS
#: Longs that hold 4 bits of each coordinate, and the most bits in which a pair may differ.
SKETCH = COORDINATES // 16
MOST_BITS = 122
#: Texts, or units in all, of a block in which all pairs are compared, and shared units that one matrix product takes.
BLOCK, BLOCK_UNITS, COLUMNS = 512, 1 << 21, 4096
#: Members of a bucket that one task screens against as many.
DEAL = 1024
DARTS = COORDINATES * np.log(COORDINATES) + 2 * COORDINATES

_U = np.uint64
_ODD = np.random.default_rng(77).integers(1, 1 << 62, WORDS, dtype=np.uint64) * _U(2) + _U(1)


def units(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Units of weight, sorted by text: hash of (shingle, copy), and text number."""
    w, doc = word_hashes([t.lower() for t in texts], SPACES)
    n = len(w)
    if not n:
        return w, doc
    first = np.searchsorted(doc, doc, side="left")
    last = np.searchsorted(doc, doc, side="right")
    at = np.arange(n)
    s = np.zeros(n, np.uint64)
    for k in range(WORDS):
        inside = at + k < last
        s[inside] += w[at[inside] + k] * _ODD[k]
    starts = (at + WORDS <= last) | (at == first)
    s, doc = mix(s[starts]), doc[starts]
    order = np.lexsort((s, doc))
    s, doc = s[order], doc[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (doc[1:] != doc[:-1])
    at = np.arange(len(s))
    copy = at - np.maximum.accumulate(np.where(new, at, 0))
    return np.where(copy > 0, mix(s + copy.astype(np.uint64) * _U(0x9E3779B97F4A7C15)), s), doc


def _uniform(h: np.ndarray) -> np.ndarray:
    return ((h >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53


def signatures(unit: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Rank of the earliest dart in each coordinate, inf throughout for a text without units."""
    out = np.full((n, COORDINATES), np.inf)
    weight = np.bincount(doc, minlength=n)
    todo, reach = np.flatnonzero(weight), DARTS / np.maximum(weight, 1)
    flat = out.reshape(-1)
    while len(todo):
        open_ = np.zeros(n, bool)
        open_[todo] = True
        e, d = unit[open_[doc]], doc[open_[doc]]
        rank, dart = np.zeros(len(e)), 0
        while len(e):
            dart += 1
            h = mix(e + _U(dart * 0xD1342543DE82EF95 % (1 << 64)))
            rank = rank - np.log(_uniform(h))
            hit = rank <= reach[d]
            e, d, rank, h = e[hit], d[hit], rank[hit], h[hit]
            where = d * COORDINATES + (mix(h ^ _U(0x5851F42D4C957F2D)) % _U(COORDINATES)).astype(np.int64)
            np.minimum.at(flat, where, rank)
        todo = todo[np.isinf(out[todo]).any(1)]
        reach[todo] *= 2
    return out


def band_hashes(signature: np.ndarray) -> np.ndarray:
    """n x BANDS signed 64-bit hashes of the bands."""
    raw = signature.view(np.uint64).reshape(len(signature), BANDS, BAND_ROWS)
    h = np.zeros(raw.shape[:2], np.uint64) + np.arange(1, BANDS + 1, dtype=np.uint64)
    for k in range(BAND_ROWS):
        h = mix(h * _U(0x9E3779B97F4A7C15) + raw[:, :, k])
    return h.view(np.int64)


def bit_sketches(signature: np.ndarray) -> np.ndarray:
    """n x SKETCH longs: 4 hashed bits of every coordinate."""
    nibbles = (mix(signature.view(np.uint64) + _U(0xA0761D6478BD642F)) & _U(15)).reshape(len(signature), SKETCH, 16)
    return (nibbles << (_U(4) * np.arange(16, dtype=np.uint64))).sum(2, dtype=np.uint64).view(np.int64)


def _bits(side: str) -> list[str]:
    return [f"{side}{k}" for k in range(SKETCH)]


def _alike() -> Column:
    """The screen, on columns u0.. and v0.."""
    differing = F.lit(0)
    for a, b in zip(_bits("u"), _bits("v")):
        differing = differing + F.bit_count(F.col(a).bitwiseXOR(F.col(b)))
    return differing <= MOST_BITS


def screened(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Those of the pairs (u, v) that pass the screen."""
    for side in ("u", "v"):
        pairs = pairs.join(reps.select(F.col("node").alias(side), *[F.col(f"b{k}").alias(c) for k, c in enumerate(_bits(side))]), side)
    return pairs.where(_alike()).select("u", "v")


def _digest(text: str) -> str:
    return md5(text.encode(), usedforsecurity=False).hexdigest()


def sketch(docs: DataFrame) -> DataFrame:
    """doc_id, digest, bands (empty without words), sketch of docs (doc_id, text); null texts are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts, bands, sketches = b.column(1).to_pylist(), [], []
            for _, part in chunks(t.encode() for t in texts):
                unit, doc = units(part)
                s = signatures(unit, doc, len(part))
                have = np.bincount(doc, minlength=len(part)) > 0
                bands += [x if ok else x[:0] for x, ok in zip(band_hashes(s), have)]
                sketches += list(bit_sketches(s))
            lists = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(map(_digest, texts), pa.string()), pa.array(bands, lists), pa.array(sketches, lists)], ["doc_id", "digest", "bands", "sketch"])
        give_back()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.where("text is not null").select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, digest string, bands array<long>, sketch array<long>")


def unit_sets(chosen: DataFrame) -> DataFrame:
    """node, units (sorted 64-bit numbers) of (node, digest, text), one row per node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            nodes, sets = [], []
            rows = [(n, t) for n, d, t in zip(*[c.to_pylist() for c in b.columns]) if _digest(t) == d]
            for start, part in chunks(t.encode() for _, t in rows):
                unit, doc = units(part)
                edges = np.searchsorted(doc, np.arange(len(part) + 1))
                nodes += [n for n, _ in rows[start : start + len(part)]]
                sets += [np.sort(unit[x:y]).tobytes() for x, y in zip(edges, edges[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(sets, pa.binary())], ["node", "units"])

    return chosen.select("node", "digest", "text").mapInArrow(run, "node long, units binary").dropDuplicates(["node"])


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Those of the pairs (u, v) whose exact weighted Jaccard similarity is high enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            us, vs = [], []
            for u, v, x, y in zip(*[c.to_pylist() for c in b.columns]):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                if min(len(p), len(q)) < similarity * max(len(p), len(q)):
                    continue
                both = len(p) + len(q) - len(np.union1d(p, q))
                if both >= similarity * (len(p) + len(q) - both):
                    us.append(u)
                    vs.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    dealt = sets.select(redealt("node"), "units")
    joined = pairs.join(dealt.select(F.col("node").alias("u"), F.col("units").alias("p")), "u").join(dealt.select(F.col("node").alias("v"), F.col("units").alias("q")), "v")
    return joined.select("u", "v", "p", "q").mapInArrow(run, "u long, v long")


def _texts_of(docs: DataFrame, reps: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, digest, text of the representatives."""
    wanted = reps.join(nodes, "node").select("node", "digest", F.col("first_id").alias("own_id"))
    text = docs.select("doc_id", "text").where("text is not null")
    return text.join(wanted, F.col("doc_id").eqNullSafe(F.col("own_id"))).select("node", "digest", "text")


def _close(units: list[np.ndarray], others: list[np.ndarray] | None, similarity: float) -> np.ndarray:
    """Which pairs of unit sets are similar enough; ``others`` None: of one list with itself."""
    sets = units + (others or [])
    size = np.fromiter(map(len, sets), float, len(sets))
    _, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), size.astype(np.int64))
    shared = times > 1  # the others are in no intersection
    number = np.cumsum(shared) - 1
    used = shared[column]
    row, column = row[used], number[column[used]]
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    n = len(units)
    both = np.zeros((n, len(others) if others is not None else n), np.float32)
    for first in range(0, int(shared.sum()), COLUMNS):
        lo, hi = np.searchsorted(column, (first, first + COLUMNS))
        m = np.zeros((len(sets), min(COLUMNS, int(shared.sum()) - first)), np.float32)
        m[row[lo:hi], column[lo:hi] - first] = 1
        both += m[:n] @ (m[n:] if others is not None else m).T
    all_ = size[:n, None] + (size[n:] if others is not None else size) - both
    return both >= similarity * all_


def _block_links(t: pa.Table, similarity: float) -> pa.Table:
    """u, v: links that join a block's nodes as all of its pairs of sufficient similarity do, at most one per node and side.

    The pairs are those of side 0 with side 1, or, if there is no side 1, those of side 0.
    """
    side = t.column("side").to_numpy()
    node = t.column("node").to_numpy()
    sets = [np.frombuffer(x, np.uint64) for x in t.column("units").to_pylist()]
    a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    if not len(a):
        return pa.table({"u": pa.array([], pa.int64()), "v": pa.array([], pa.int64())})
    near = _close([sets[k] for k in a], [sets[k] for k in b] if len(b) else None, similarity)
    if not len(b):
        b = a
    x, y, far = node[a].copy(), node[b].copy(), np.iinfo(np.int64).max
    while True:
        p = np.minimum(x, np.where(near, y, far).min(1))
        q = np.minimum(y, np.where(near, p[:, None], far).min(0))
        if (p == x).all() and (q == y).all():
            break
        x, y = p, q
    u, v = np.concatenate((node[a], node[b])), np.concatenate((x, y))
    return pa.table({"u": u[u != v], "v": v[u != v]})


def _with_blocks(sets: DataFrame, block: str, blocks: str) -> DataFrame:
    """Adds a block of each node, by hash, and the number of blocks of its cluster."""
    units = F.octet_length("units") / 8
    counts = sets.groupBy("component").agg(F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum(units) / BLOCK_UNITS), F.lit(1)).cast("int").alias(blocks))
    return sets.join(counts.select(redealt("component"), blocks), "component").withColumn(block, F.pmod(F.xxhash64(F.lit(5), "node"), F.col(blocks)).cast("int"))


def cluster_links(sets: DataFrame, similarity: float) -> DataFrame:
    """Links (u, v) that join the nodes of each cluster as all its pairs of sufficient similarity do.

    ``sets`` has node, component (the least node of its cluster) and units, and is read several times.
    """

    def every(of: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(of) - 1))

    def compared(cells: DataFrame) -> DataFrame:
        # Dealt by all three keys: a join by the cluster alone would leave all of its blocks in one task.
        return cells.withColumn("component", redealt("component")).groupBy("component", "p", "q").applyInArrow(lambda t: _block_links(t, similarity), "u long, v long")

    placed = materialise(_with_blocks(sets, "block", "blocks"), "near-sets")
    cell = ["component", "node", "units", "p", "q", "side"]
    own = placed.select("component", "node", "units", F.col("block").alias("p"), F.lit(0).alias("q"), F.lit(0).alias("side"))
    leader = placed.where("node = component").select("*", every("blocks").alias("p")).where("p <> block").withColumns({"q": F.lit(0), "side": F.lit(0)})
    first = materialise(compared(own.unionByName(leader.select(*cell))), "near-links")
    linked = first.where("v is not null").select(F.col("u").alias("node"), F.col("v").alias("component")).distinct()
    rest = placed.where("node <> component").join(linked, ["node", "component"], "left_anti").select("node", "component", "units")
    rest = materialise(_with_blocks(rest, "p", "ps"), "near-rest")
    if rest.isEmpty():
        return first
    some = rest.select("component", "ps").distinct()
    wide = rest.join(placed.select("component", "blocks").distinct().select(redealt("component"), "blocks"), "component").select("component", "node", "units", "p", every("blocks").alias("q"), F.lit(0).alias("side"))
    others = placed.join(some.select(redealt("component"), "ps"), "component").select("component", "node", "units", every("ps").alias("p"), F.col("block").alias("q"), F.lit(1).alias("side"))
    return first.unionByName(compared(wide.unionByName(others)))


def links(docs: DataFrame, reps: DataFrame, similarity: float) -> DataFrame:
    """Links (u, v) that join the same representatives into classes as all links of that similarity do."""
    buckets = reps.select("node", F.posexplode("bands").alias("band", "hash")).select("node", F.xxhash64("band", "hash").alias("key"))
    shared = buckets.groupBy("key").agg(F.min("node").alias("leader"), F.max("node").alias("other")).where("leader <> other").select(redealt("key"), "leader")
    members = materialise(buckets.join(shared, "key"), "near-members")
    star = members.where("node <> leader").select(F.col("node").alias("u"), F.col("leader").alias("v")).distinct()
    clusters = materialise(components(screened(star, reps)), "near-clusters")
    sets = clusters.join(unit_sets(_texts_of(docs, reps, clusters.select("node"))), "node")
    found = materialise(cluster_links(sets, similarity), "near-links")

    apart = members.join(clusters, "node", "left").select("key", "node", F.coalesce("component", "node").alias("cluster"))
    mixed = apart.groupBy("key").agg(F.min("cluster").alias("a"), F.max("cluster").alias("b"), F.ceil(F.count(F.lit(1)) / DEAL).cast("int").alias("blocks")).where("a <> b").select(redealt("key"), "blocks")
    apart = apart.join(mixed, "key").withColumn("block", F.pmod(F.xxhash64(F.lit(6), "node"), F.col("blocks")).cast("int"))
    apart = materialise(apart.join(reps.select("node", *[f"b{k}" for k in range(SKETCH)]), "node"), "near-mixed")

    def side_of(s: str, own: str, other: str) -> DataFrame:
        dealt = apart.withColumn(own, F.col("block")).withColumn(other, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        return dealt.select("key", "p", "q", F.col("node").alias(s), F.col("cluster").alias(f"{s}_cluster"), *[F.col(f"b{k}").alias(c) for k, c in enumerate(_bits(s))])

    across = side_of("u", "p", "q").join(side_of("v", "q", "p"), ["key", "p", "q"]).where((F.col("u_cluster") < F.col("v_cluster")) & _alike()).select("u", "v").distinct()
    across = materialise(across, "near-across")
    discard(members, clusters, apart)
    nodes = across.select(F.col("u").alias("node")).unionByName(across.select(F.col("v").alias("node"))).distinct()
    return materialise(found.unionByName(verified(across, unit_sets(_texts_of(docs, reps, nodes)), similarity)), "near-links")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row per document: doc_id, digest (null for a null text), class_id, class_digest, kept.

    class_id is the least id of the class, ``kept`` true for its first (id, digest).
    """
    slim = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    sketches = materialise(sketch(slim), "near-sketches")
    reps = sketches.groupBy("digest").agg(F.min(F.struct("doc_id")).alias("first"), F.any_value("bands").alias("bands"), F.any_value("sketch").alias("sketch"))
    reps = materialise(reps.select("digest", F.col("first.doc_id").alias("first_id"), "bands", *[F.get("sketch", F.lit(k)).alias(f"b{k}") for k in range(SKETCH)], F.monotonically_increasing_id().alias("node")), "near-texts")
    found = components(links(slim, reps, similarity))
    placed = reps.select("digest", "first_id", "node").join(found, "node", "left").withColumn("class", F.coalesce("component", "node"))
    least = placed.groupBy("class").agg(F.min(F.struct("first_id", "digest")).alias("least"))
    placed = materialise(placed.join(least.select(redealt("class"), "least"), "class").select("digest", "least"), "near-classes")
    out = sketches.select("doc_id", "digest").join(placed, "digest").select("doc_id", "digest", F.col("least.first_id").alias("class_id"), F.col("least.digest").alias("class_digest"))
    out = out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("digest") == F.col("class_digest")))
    nulls = slim.where("text is null").select("doc_id", F.lit(None).cast("string").alias("digest"), F.col("doc_id").alias("class_id"), F.lit(None).cast("string").alias("class_digest"), F.lit(True).alias("kept"))
    return out.unionByName(nulls)


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One document of each class, with all its columns; null texts stay."""
    found = classes(docs, id_col, text_col, similarity).where("kept and digest is not null").select(F.col("doc_id").alias("own_id"), F.col("digest").alias("own_digest")).distinct()
    whole = docs.select(packed(docs), docs[id_col].alias("id"), docs[text_col].alias("text"))
    first = whole.where("text is not null").withColumn("digest", F.md5("text")).drop("text")
    first = first.join(found, F.col("id").eqNullSafe(F.col("own_id")) & (F.col("digest") == F.col("own_digest")))
    once = F.row_number().over(Window.partitionBy("id", "digest").orderBy("id"))
    first = first.withColumn("once", once).where("once = 1")
    rest = whole.where("text is null")
    return first.select(*unpacked(first, docs.columns)).unionByName(rest.select(*unpacked(rest, docs.columns)))
