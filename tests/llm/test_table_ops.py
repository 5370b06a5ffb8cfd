"""Mixing, packing, sharding, media, vectors, quality: brute force and edge cases."""

import random
import re
import struct
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolattice.llm import media, mixing, packing, quality, queries, sharding, vector_dedup

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def mixed(spark):
    rng = random.Random(3)
    rows = []
    for i in range(300):
        t = " ".join("w" * rng.randrange(1, 5) for _ in range(rng.choice([0, 1, 5, 40, 300])))
        rows.append((i, t, rng.choice(["en", "fr", None]), rng.choice(["a", "a", "a", "a", "b", "c", "é", None]), len(t)))
    rows += [(300, None, None, "b", None), (301, None, "en", None, 0), (5, "again", "en", "a", 5), (5, "again", "en", "a", 5), (None, "null id", "en", "zero", 7)]
    return rows, spark.createDataFrame(rows, DOCS)


# --- mixing

def brute_targets(sizes, share=1.5, repeats=2):
    keys = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: [3, 1, 2][k % 3] for k, s in enumerate(keys)}
    left, out, open_ = share * sum(sizes.values()), {}, list(keys)
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if level * weight[s] > repeats * sizes[s]]
        if not over:
            return out | {s: level * weight[s] for s in open_}
        for s in over:
            out[s] = repeats * sizes[s]
            left -= out[s]
            open_.remove(s)
    return out


def test_mix_plan(spark, mixed):
    rows, df = mixed
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += size(r[1])
    want = brute_targets(dict(sizes))
    got = mixing.mix_plan(df.withColumn("size", F.lit("clash")).withColumn("bucket", F.lit(0))).collect()
    assert len(got) == len(rows) and Counter((r.doc_id, r.size) for r in got) == Counter((r[0], size(r[1])) for r in rows)
    by_size = defaultdict(set)
    for r in got:
        assert 0 <= r.taken <= 2 * r.size and (r.first_position is None) == (r.taken == 0)
        by_size[r.source_size].add(round(r.target, 4))
    for s, n in sizes.items():
        assert round(want[s], 4) in by_size[n]
    assert sum(r.taken for r in got) == sum(int(t + 0.5) for t in want.values())
    positions = [r.first_position for r in got if r.first_position is not None]
    assert positions == sorted(positions) and 0 <= positions[0] and positions[-1] <= 1
    assert Counter(map(tuple, got)) == Counter(map(tuple, mixing.mix_plan(df).collect()))


def test_mix_emits_what_the_plan_takes(spark, mixed):
    _, df = mixed
    out = mixing.mix(df)
    assert out.columns == df.columns
    words = out.select(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")))).first()[0]
    assert words == mixing.mix_plan(df).agg(F.sum("taken")).first()[0]
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.mix_plan(df.where("text is null")).agg(F.sum("taken")).first()[0] == 0


def test_schedules():
    assert [mixing.integral(s) for s in mixing.SCHEDULES] == [3.0, 1.0, 2.0]


def test_time_inverts_demand(spark):
    s = ((0.0, 1.0), (0.5, 1.0), (1.0, 5.0))
    got = spark.range(11).select(mixing.time_of(F.col("id") / 10.0, s).alias("t")).collect()
    demand = lambda t: t if t <= 0.5 else 0.5 + (t - 0.5) + 4 * (t - 0.5) ** 2
    for k, r in enumerate(got):
        assert demand(r.t) / 2 == pytest.approx(k / 10, abs=1e-9)


def test_mixing_sql(spark, mixed):
    rows, df = mixed
    unique = df.where("doc_id is not null and doc_id <> 5")
    c = duckdb.connect()
    c.register("documents", unique.toPandas())
    want = Counter((r[0], r[4]) for r in c.execute(mixing.oracle()).fetchall())
    assert want == Counter((r.doc_id, r.taken) for r in mixing.mix_plan(unique).collect())


# --- sharding

def test_shards(spark, mixed):
    rows, df = mixed
    got = sharding.kd_shards(df.withColumn("node", F.lit("clash"))).collect()
    assert len(got) == len(rows)
    total, biggest = sum(r.size for r in got), max(r.size for r in got)
    size = lambda t: len((t or "").encode()) + 1
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((r[0], size(r[1]), zlib.crc32((r[1] or "").encode())) for r in rows)
    for s in range(8):
        own = [r for r in got if r.shard == s]
        assert sorted(r.slot for r in own) == list(range(len(own)))
        assert abs(sum(r.size for r in own) - total / 8) <= 4 * biggest
    assert sharding.kd_shards(df.limit(0)).count() == 0


def brute_kd(rows, leaves, spans, first=0):
    """Shard of each row (size, axes, tie, number): the sorted keys are cut at the boundary nearest to the goal."""
    if leaves == 1:
        return {r[3]: first for r in rows}
    lows = [min(r[1][k] for r in rows) for k in range(len(spans))]
    widths = [(max(r[1][k] for r in rows) - lows[k]) / (spans[k] or 1.0) for k in range(len(spans))]
    axis = widths.index(max(widths))
    span = widths[axis] * spans[axis]
    goal = sum(r[0] for r in rows) * (leaves // 2) // leaves
    key = lambda r: (min(int((r[1][axis] - lows[axis]) / span * sharding.BINS), sharding.BINS - 1) if span > 0 else 0, r[2])
    keys, sums = sorted({key(r) for r in rows}), Counter()
    for r in rows:
        sums[key(r)] += r[0]
    below = [sum(sums[k] for k in keys[:n]) for n in range(len(keys) + 1)]
    cut = min(range(len(keys) + 1), key=lambda n: (abs(below[n] - goal), n))
    small = set(keys[:cut])
    left, right = [r for r in rows if key(r) in small], [r for r in rows if key(r) not in small]
    return (brute_kd(left, leaves // 2, spans, first) if left else {}) | (brute_kd(right, leaves - leaves // 2, spans, first + leaves // 2) if right else {})


def test_shards_against_brute_force(spark, mixed):
    df = mixed[1].where("doc_id is not null").dropDuplicates(["doc_id"]).coalesce(1).sortWithinPartitions("doc_id")
    df = spark.createDataFrame(df.collect(), df.schema).coalesce(1)
    keyed = sharding.keyed_rows(df, "doc_id", "text", ("lang", "source"), 8).collect()
    spans = [max(r.axes[k] for r in keyed) - min(r.axes[k] for r in keyed) for k in range(3)]
    for n in (8, 5):
        want = brute_kd([(r.size, r.axes, r.tie, r.doc_id) for r in keyed], n, spans)
        assert {r.doc_id: r.shard for r in sharding.kd_shards(df, shards=n).collect()} == want


def test_rows_of_one_id_are_dealt_out(spark):
    df = spark.range(640).selectExpr("7L AS doc_id", "'same text' AS text", "'en' AS lang", "'web' AS source")
    counts = [r[1] for r in sharding.kd_shards(df).groupBy("shard").count().collect()]
    assert len(counts) == 8 and max(counts) - min(counts) <= 2


def test_hot_value_is_split_evenly(spark):
    df = spark.range(2000).selectExpr("id AS doc_id", "'same text' AS text", "'en' AS lang", "if(id < 1800, 'hot', 'x') AS source")
    sizes = sharding.kd_shards(df).groupBy("shard").agg(F.sum("size")).collect()
    assert len(sizes) == 8 and max(r[1] for r in sizes) - min(r[1] for r in sizes) <= 40 * 10
    assert sharding.kd_shards(df, shards=5).select("shard").distinct().count() == 5
    assert sharding.kd_shards(df, shards=None, target_bytes=5000).select("shard").distinct().count() == 4


# --- packing

def test_packing_is_whole(spark, mixed):
    from tokenizers import Tokenizer

    rows, df = mixed
    path = queries.vocabulary()
    t = Tokenizer.from_file(path)
    texts = [r for r in rows if r[0] is not None and r[0] != 5] + [(900, "a<|endoftext|>b. c! d?\n\ne", None, None, 0), (901, "long words. " * 9000, None, None, 0)]
    d = spark.createDataFrame(texts, DOCS).withColumn("start", F.lit("clash"))
    got = packing.pack(d, path).collect()
    ids = {r[0]: np.array([*t.encode(r[1] or "", add_special_tokens=False).ids, 0], "<u4") for r in texts}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        assert r.doc_tokens == len(ids[r.doc_id]) and r.length > 0
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for key, parts in [*((k, v) for k, v in pieces.items()), *((None, v) for v in sequences.values())]:
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        assert at == len(ids[key]) if key is not None else at <= 1024
    assert set(pieces) == set(ids)
    assert packing.pack(d.limit(0), path).count() == 0


def test_windows_are_optimal():
    rng = random.Random(8)
    for _ in range(60):
        positions = sorted(rng.sample(range(1, 60), rng.randrange(6, 30)) + [60])
        positions = [p for k, p in enumerate(positions) if k == 0 or p != positions[k - 1]]
        gaps = np.diff([0, *positions])
        length = max(12, int(gaps.max()))
        penalties = [rng.randrange(0, 9) for _ in positions]
        g, back = packing.best_cuts(positions, penalties, length)
        best = {0: 0}
        for p, q in zip(positions, penalties):
            best[p] = min(best[j] + length - (p - j) + q for j in best if 0 < p - j <= length)
        assert [x - p for x, p in zip(g, positions)] == [best[p] for p in positions]


def test_blocks_cut_as_the_whole_stream_does(monkeypatch):
    for seed in range(30):
        rng = np.random.default_rng(seed)
        sentence = rng.random(50) < (0.1, 0.03, 0.002)[seed % 3]
        docs = [rng.integers(0, 50, rng.integers(1, 300)).astype(np.uint32) for _ in range(80)]
        found = []
        for block in (1 << 30, 256, 700):
            monkeypatch.setattr(packing, "BLOCK", block)
            p, rows = packing.Packer(sentence, 0, 64), []
            for k, v in enumerate(docs):
                if p.add(k, v):
                    rows += list(zip(*p.flush(False).values()))
            found.append(rows + list(zip(*p.flush(True).values())))
        assert found[0] == found[1] == found[2]
        ends = np.cumsum([len(v) for v in docs])
        stops = np.flatnonzero(sentence[np.concatenate(docs)]) + 1
        at, penalties = packing.candidates(int(ends[-1]), ends, stops, 64)
        natural = {*ends.tolist(), *stops.tolist()}
        assert natural <= set(at.tolist())
        forced = sorted(set(at.tolist()) - natural)
        assert all(not any(x - 64 < e <= x for e in natural) for x in forced)
        best = {0: 0}
        for x, q in zip(at.tolist(), penalties.tolist()):
            best[x] = min(best[j] + 64 - (x - j) + q for j in best if 0 < x - j <= 64)
        spent = defaultdict(int)
        for _, _, length, _, _, seq, _ in found[0]:
            spent[seq] += length
        cuts = np.cumsum([spent[k] for k in sorted(spent)])
        cost = sum(64 - spent[k] for k in spent) + sum(dict(zip(at.tolist(), penalties.tolist()))[c] for c in cuts.tolist())
        assert cost == best[int(ends[-1])]


def test_blocks_join_without_loss(monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 500)
    rng = np.random.default_rng(0)
    sentence = rng.random(50) < 0.1
    p = packing.Packer(sentence, 7, 64)
    ids = {k: rng.integers(0, 50, rng.integers(1, 700)).astype(np.uint32) for k in range(60)}
    rows = []
    for k, v in ids.items():
        if p.add(k, v):
            rows += list(zip(*p.flush(False).values()))
    rows += list(zip(*p.flush(True).values()))
    seen = defaultdict(int)
    used = Counter()
    for doc, start, length, crc, total, seq, _ in rows:
        assert seen[doc] == start and total == len(ids[doc]) and crc == zlib.crc32(ids[doc][start : start + length].astype("<u4").tobytes())
        seen[doc] += length
        used[seq] += length
    assert seen == {k: len(v) for k, v in ids.items()} and min(used) == 7 and max(used.values()) <= 64
    # The fill that cuts at ends alone allow; that it is the best one is tested against brute force above.
    assert sum(used.values()) / (64 * len(used)) > 0.85


# --- media

@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 1024, 1025, 5000])
def test_media_round_trip(n):
    raw = np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8).tobytes()
    payload = media.pad(raw)
    assert len(payload) % 64 == 0 and len(payload) >= 64 and payload.startswith(raw)
    stored = media.encode_avi(payload)
    assert stored[:4] == b"RIFF" and struct.unpack_from("<I", stored, 4)[0] == len(stored) - 8
    back, frames = media.decode_avi(stored)
    assert back == payload and frames.shape[1] == min(16, len(payload) // 64) * 64


def test_frames_are_baseline_jpeg():
    samples = np.random.default_rng(1).integers(0, 256, 128)
    steps = np.diff(samples, prepend=0)
    steps[0] = samples[0] - 128
    jpeg = media._jpeg(2, media._TO[steps + 255].tobytes().replace(b"\xff", b"\xff\x00"))
    blocks = media.decode_baseline(jpeg)
    assert (blocks[:, 0] // 8 + 128 == samples).all() and not blocks[:, 1:].any()
    assert (media.decode_frame(jpeg) == samples).all()
    other = jpeg.replace(b"\xff\xdb\x00\x43\x00" + bytes([8]), b"\xff\xdb\x00\x43\x00" + bytes([8]), 1).replace(b"\xff\xda", b"\xff\xfe\x00\x04hi\xff\xda", 1)
    assert (media.decode_frame(other) == samples).all()


def test_shots():
    dark, light = np.full((10, 64), 10, np.uint8), np.full((5, 64), 200, np.uint8)
    assert media.shots(np.concatenate((dark, light, dark))) == [(0, 9), (10, 14), (15, 24)]
    assert media.shots(dark) == [(0, 9)] and media.clip_list(dark[:1])[0]["end_s"] == 0.04


def test_media_digests(spark, mixed):
    rows, df = mixed
    got = media.digests(df.withColumn("media", F.lit("clash"))).collect()
    want = Counter()
    for r in rows:
        raw = (r[1] or "").encode()
        p = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        want[r[0], len(raw), len(p), sha256(p).hexdigest(), zlib.crc32(p[-64:])] += 1
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == want
    stored = media.to_media(df)
    assert stored.count() == len(rows) and media.clips(stored).select("doc_id", "clip").count() >= len(rows)
    assert media.digests(df.limit(0)).count() == 0


# --- vectors

def test_vectors_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vector_dedup, "BLOCK", 20)
    monkeypatch.setattr(vector_dedup, "CHUNK", 30)
    rng = np.random.default_rng(2)
    rows = []
    for g in range(30):
        base = rng.normal(size=16)
        for _ in range(rng.integers(1, 12)):
            rows.append(((base + rng.normal(size=16) * rng.choice([0.05, 0.2, 0.25])).tolist(), int(g % 3)))
    hot = rng.normal(size=16)
    rows += [((hot + rng.normal(size=16) * 0.05).tolist(), 1) for _ in range(90)]
    rows = [(i, v, k) for i, (v, k) in enumerate(rows)]
    odd = [(1000, None, 1), (1001, [0.0] * 16, 1), (1002, [float("nan")] * 16, 1), (1003, [None] * 16, 1), (1004, rows[0][1], None), (1005, [], 1), (1006, [1.0, 2.0], 1), (1007, [1.0, 2.0], 1), (1008, [float("inf")] * 16, 1)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>, label int").withColumn("uid", F.lit("clash"))
    got = {r.vec_id: r for r in vector_dedup.vector_classes(df).collect()}
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r[2] for r in rows])
    near = (x @ x.T >= 0.93) & (label[:, None] == label)
    np.fill_diagonal(near, False)
    reach = near | np.eye(len(x), dtype=bool)
    for _ in range(8):
        reach = (reach.astype(int) @ reach.astype(int)) > 0
    found, all_ = sum(got[i].n_links for i in range(len(x))), near.sum()
    assert found >= 0.98 * all_ and all(got[i].n_links <= near[i].sum() for i in range(len(x)))
    if found == all_:
        assert all(got[i].component_id == int(np.flatnonzero(reach[i])[0]) for i in range(len(x)))
    for i, _, _ in odd:
        if i not in (1006, 1007):
            assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert got[1007].n_links == 1 and got[1007].component_id == 1006 and not got[1007].kept
    assert vector_dedup.vector_classes(df.limit(0)).count() == 0


def test_nearest_cells_are_in_order():
    rng = np.random.default_rng(0)
    a, b = rng.random(6), rng.random(6)
    want = np.argsort((a[:, None] + b).ravel(), kind="stable")[:10]
    assert vector_dedup.nearest_cells(a[None], b[None], 10)[0].tolist() == want.tolist() and vector_dedup.nearest_cells(a[None], b[None], 99).shape == (1, 36)
    a, b = rng.random((500, 40)), rng.random((500, 30))
    for count in (1, 7, 200, 1200):
        sums = (a[:, :, None] + b[:, None, :]).reshape(500, -1)
        got = np.take_along_axis(sums, vector_dedup.nearest_cells(a, b, count).astype(int), 1)
        np.testing.assert_array_equal(got, np.sort(sums, axis=1)[:, :count])


def test_as_many_cells_as_the_recall_needs():
    rng = np.random.default_rng(3)
    x = vector_dedup.normalised(rng.normal(size=(1500, 64)))
    index = vector_dedup.MultiIndex(x, np.zeros(len(x)), 2000 * 40**2, 0.5, 0.995)
    u, z = x[:400], rng.normal(size=(400, 64))
    z -= (z * u).sum(1, keepdims=True) * u
    c = rng.uniform(0.5, 1, 400)[:, None]
    v = c * u + np.sqrt(1 - c * c) * vector_dedup.normalised(z)
    a, b = index.visited(u, index.visits), index.visited(v, index.visits)
    assert index.visits > 64 and ((a == b[:, :1]) | (b == a[:, :1])).any(1).mean() >= 0.98


# --- quality

@pytest.fixture(scope="module")
def graded(spark):
    rng = random.Random(6)
    rows, labels = [], []
    for i in range(900):
        good = rng.random() < 0.7
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7))) for _ in range(rng.randrange(5, 60))]
        rows.append((i, " ".join(words if good else [w.upper() + "!!" for w in words])))
        if i % 3:
            labels.append((i, int(good)))
    truth = dict(labels) | {i: int("!!" not in t) for i, t in rows}
    return truth, spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")


def test_held_out_accuracy(spark, graded):
    truth, df, labels = graded
    got = quality.assess(df, labels).collect()
    held = [r for r in got if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got) and len(held) > 100
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got)
    kept = quality.keep_good(df.withColumn("quality_score", F.lit("clash")), labels)
    assert kept.columns == ["doc_id", "text", "quality_score"] and kept.count() == sum(r.predicted for r in got)


def test_labels_of_held_out_rows_do_not_matter(spark, graded):
    _, df, labels = graded
    other = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = (sorted(map(tuple, quality.assess(df, x).collect())) for x in (labels, other))
    assert one == two


def test_quality_edges(spark, graded):
    _, df, labels = graded
    odd = spark.createDataFrame([(5000, None), (5001, ""), (None, "word word"), (5002, "a " * 60_000)], "doc_id long, text string")
    got = quality.assess(df.unionByName(odd), labels.unionByName(spark.createDataFrame([(5000, None), (1, 1)], "doc_id long, quality int")))
    assert got.where("score is null or held_out is null").count() == 0 and got.count() == 904
    assert quality.assess(df, labels.limit(0)).select("score").distinct().collect()[0][0] == 0.5
    assert quality.assess(df.limit(0), labels).count() == 0


def test_pooling_against_brute_force(monkeypatch):
    v = np.random.default_rng(0).normal(size=(quality.BUCKETS, quality.DIM)).astype(np.float16)
    texts = [b"a b, c", b"", b"a b " * 5000, b" ", b"x!", b"one"] * 40
    for piece in (1 << 12, 7):
        monkeypatch.setattr(quality, "_PIECE", piece)
        some = texts if piece > 7 else texts[:2] + texts[3:6] + [b"a b c d e f g h i j k l m n o p"] * 3
        for t, g in zip(some, quality.features(some, v)):
            x = v[quality.buckets_of([t])[0]].astype(np.float64)
            step = np.sqrt((np.diff(x, axis=0) ** 2).mean(0)) if len(x) > 1 else np.zeros(quality.DIM)
            want = np.concatenate((x.mean(0), x.std(0), step)) if len(x) else np.zeros(quality.WIDTH)
            np.testing.assert_allclose(g, want, atol=2e-3)


def test_context_sums_against_brute_force(spark, graded):
    df = graded[1].unionByName(spark.createDataFrame([(7000, None), (7001, ""), (7002, "w " * 300)], "doc_id long, text string"))
    want = np.zeros((quality.BUCKETS, quality.DIM + 1))
    places, signs = quality.index_vectors()
    assert (np.abs(signs) == 1).all() and all(len(set(row)) == quality.NONZERO for row in places[:500].tolist())
    for r in df.collect():
        w = quality.buckets_of([(r.text or "").encode()])[0]
        for k, b in enumerate(w):
            want[b, quality.DIM] += 1
            for n in (k - 1, k + 1):
                if 0 <= n < len(w):
                    want[b, places[w[n]]] += signs[w[n]]
    got = np.zeros_like(want)
    for first, sums in quality.context_sums(df.repartition(5), "text"):
        got[first : first + len(sums)] = sums
    np.testing.assert_array_equal(got, want)
