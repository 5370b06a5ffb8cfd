import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolattice.functions import probability as prob
from chronolattice.operators import distances as dist
from chronolattice.operators import evaluation, reduction
from chronolattice.operators.clustering import agglomerate
from chronolattice.operators.coclustering import BlockEstimator, grid_search, size_vectors
from chronolattice.operators.coclustering.estimator import Matrix
from chronolattice.operators.coclustering.model import icl
from chronolattice.operators.kmeans import KMeans
from chronolattice.operators.series_set import SeriesSet
from chronolattice.plans import catalogue, steps
from chronolattice.sources import synthetic


@pytest.fixture(scope="module")
def points(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(c, 0.2, (20, 3)) for c in ([0, 0, 0], [5, 0, 0], [0, 5, 5])])
    rows = [(i, v.tolist(), i // 20) for i, v in enumerate(x)]
    return x, SeriesSet(spark.createDataFrame(rows, "id long, x array<double>, truth int"))


def test_pairwise_in_blocks(points, monkeypatch):
    x, d = points
    monkeypatch.setattr(dist, "BLOCK", 13)
    s = d.row_distances("x", dist.euclidean(False))
    m = s.to_matrix()
    np.testing.assert_allclose(m, np.sqrt(((x[:, None] - x[None]) ** 2).sum(-1)), atol=1e-12)
    assert s.count() == 3600
    whole = d.row_distances("x", lambda a, b: dist.euclidean()(a, b), symmetric=False)
    np.testing.assert_allclose(whole.to_matrix(), m**2, atol=1e-9)


def test_distances_by_column_and_targets(points):
    from chronolattice.functions import arrays

    x, d = points
    small = d.where("id < 7")
    s = small.row_distances("x", by_column=arrays.euclidean)
    np.testing.assert_allclose(s.to_matrix(), ((x[:7, None] - x[None, :7]) ** 2).sum(-1), atol=1e-9)
    best = small.closest_to_targets("x", d.df.where("id = 3").select("id", "x"), arrays.euclidean).first()
    assert (best.refId, best.closestPoint, best.distance) == (3, 3, 0.0)
    got = {r.refId: r.distances for r in s.grouped_lists().collect()}
    assert [z.id for z in got[0]] == list(range(7))


def test_label_distances():
    m = [[0, 2], [3, 1]]
    a, b = np.array([[0, 1]]), np.array([[1, 1], [0, 0]])
    assert dist.prototypes(m)(a, b).tolist() == [[3.0, 3.0]]
    assert dist.hamming(a, b).tolist() == [[1.0, 1.0]]


def test_pca(points):
    x, d = points
    v = d.add_vector("v", "x")
    p, model = v.add_pca_with_model("p", "v", 3, 0.8)
    assert model.loadings.shape[1] < 3 and np.cumsum(model.explained)[-1] >= 0.8
    q, detail = d.add_pca_detailed("p", "x", cos2="cos2")
    np.testing.assert_allclose(detail.explained, reduction.Components(None, np.sort(np.linalg.eigvalsh(np.cov(x.T, bias=True)))[::-1] / np.cov(x.T, bias=True).trace()).explained, atol=1e-9)
    assert all(sum(r.cos2) == pytest.approx(1.0) for r in q.take(5))


def test_scaling_reproduces_distances(points):
    x, d = points
    got, model = d.add_mds_with_model("m", "x", 3)
    y = np.array([r.m for r in got.df.orderBy("id").collect()])
    np.testing.assert_allclose(((y[:, None] - y[None]) ** 2).sum(-1), ((x[:, None] - x[None]) ** 2).sum(-1), atol=1e-6)
    assert model.stress < 1e-9


def test_large_scaling_equals_small(spark, monkeypatch):
    """Distances far from Euclidean: eigenvalues below zero that exceed the positive ones in size."""
    rng, n = np.random.default_rng(4), 30
    b = rng.normal(size=(n, n)) + np.outer(*[np.where(np.arange(n) < 15, 1.0, -1.0)] * 2) * 3
    d = np.sqrt(np.maximum(b + b.T - (b + b.T).min() + 0.5, 0)) * (1 - np.eye(n))
    rows = spark.createDataFrame([(i, j, float(d[i, j])) for i in range(n) for j in range(n)], "id1 long, id2 long, distance double")
    values = np.linalg.eigvalsh(-0.5 * (np.eye(n) - 1 / n) @ d**2 @ (np.eye(n) - 1 / n))
    assert -values[0] > values[-1] > 0
    small = reduction.classical_scaling(dist.DistanceSet(rows), 3)
    monkeypatch.setattr(reduction, "DRIVER_POINTS", 0)
    large = reduction.classical_scaling(dist.DistanceSet(rows), 3, runs=3, noise=0.5)
    np.testing.assert_allclose(large.eigenvalues, small.eigenvalues, rtol=1e-7)
    np.testing.assert_allclose(large.explained, small.explained, rtol=1e-6)
    np.testing.assert_allclose(np.abs(large.coordinates), np.abs(small.coordinates), atol=1e-5)
    assert large.stress == pytest.approx(small.stress, rel=1e-6)
    with pytest.raises(ValueError):
        reduction.classical_scaling(dist.DistanceSet(rows), 3, additive=True)


def ari(d, pred, truth="truth"):
    return d.adjusted_rand(pred, truth)


def test_clusterings_recover_groups(points):
    _, d = points
    k, centres = d.add_kmeans("k", "x", 3, runs=2)
    assert ari(k, "k") == 1.0 and centres.shape == (3, 3)
    g, model = d.add_mixture("g", "x", 3, probabilities="p", log_likelihood="l")
    assert ari(g, "g") == 1.0 and sum(g.take(1)[0].p) == pytest.approx(1.0) and model.weights.sum() == pytest.approx(1.0)
    auto, _, best = d.add_auto_mixture("a", "x", [2, 3])
    assert best == 3
    s, _ = d.add_som("s", "x", 1, 3, 12)
    assert ari(s, "s") > 0.5
    for linkage in ("single", "complete", "average", "wpgma", "centroid", "median", "ward"):
        h, tree = d.add_hierarchical("x", [3], linkage)
        assert ari(h, "hclust_3") == 1.0 and len(tree.merges) == 59
    t, metrics, _ = d.add_decision_tree("t", "x", "truth", seed=2)
    assert metrics["accuracy"] >= 0.8 and t.count() == 60


def test_agglomeration_heights():
    t = agglomerate(np.array([[0, 1, 4.0], [1, 0, 3], [4, 3, 0]]), [0, 1, 2], "average")
    assert [m[2] for m in t.merges] == [1.0, 3.5] and t.cut(2).tolist() == [0, 0, 1]


def test_indices_of_equal_and_single_clusterings(spark):
    d = SeriesSet(spark.createDataFrame([(i, i % 3, (i % 3 + 1) % 3, 0) for i in range(30)], "id long, a int, b int, one int"))
    r = evaluation.external_indices(d.df, "a", "b").first()
    assert r.accuracy == r.adjusted_rand == r.nmi_sqrt == r.purity == 1.0 and r.fp == r.fn == 0
    single = evaluation.external_indices(d.df, "one", "one").first()
    assert single.tn == 0 and single.adjusted_rand is None
    assert d.contingency_matrix("a", "b") == [[0, 0, 10], [10, 0, 0], [0, 10, 0]]
    assert d.f_beta("a", "b")(2.0) == 1.0


def test_helpers():
    assert prob.log_sum_exp(np.array([-np.inf, -np.inf])) == -np.inf
    assert prob.log_sum_exp(np.log([1.0, 3.0])) == pytest.approx(np.log(4))
    assert prob.joint_labels(np.array([[0, 1], [1, 1], [0, 1]])).tolist() == [0, 1, 0]
    assert prob.same_partition(np.array([0, 0, 1]), np.array([5, 5, 2])) and not prob.same_partition(np.array([0, 0, 1]), np.array([1, 1, 1]))
    assert prob.size_combinations(2, 2) == [(1, 1), (1, 2), (2, 2)] and size_vectors(2, [1]) == [(1,), (2,)]
    assert prob.split_label(np.array([0, 1, 1]), 1, np.array([0, 1])).tolist() == [0, 1, 2]
    x = np.random.default_rng(1).normal(size=(50, 2))
    dens = prob.gaussian_log_density(x, np.zeros(2), np.eye(2))
    np.testing.assert_allclose(dens, -0.5 * (x**2).sum(1) - np.log(2 * np.pi))


@pytest.fixture(scope="module")
def blocks(spark):
    rng = np.random.default_rng(3)
    means = np.array([[[0, 0], [4, 0]], [[0, 4], [-4, -4]]])
    rows = [(i, [(means[j // 3, i // 15] + rng.normal(0, 0.5, 2)).tolist() for j in range(6)], i // 15) for i in range(30)]
    return spark.createDataFrame(rows, "rid long, cells array<array<double>>, truth int")


def recovered(spark, blocks, result, column=0):
    d = SeriesSet(blocks.join(result.row_labels, "rid").withColumn("k", F.get("labels", F.lit(column))).withColumnRenamed("rid", "id"))
    return d.adjusted_rand("k", "truth")


@pytest.mark.parametrize("estimator", [BlockEstimator.plain(2, 2), BlockEstimator.conditional_on((2, 2)), BlockEstimator.functional_plain(2, 2, max_iterations=5, burn_in=5), BlockEstimator.functional_conditional((2, 2))])
def test_block_models_recover(spark, blocks, estimator):
    got = estimator.run(blocks, runs=3, init="kmeans" if estimator.conditional else "randomPartition")
    assert recovered(spark, blocks, got) >= 0.95
    assert prob.same_partition(got.col_partition, np.repeat([0, 1], 3))
    assert got.icl[-1] < got.log_likelihood[-1]


def test_variational(spark, blocks):
    got = BlockEstimator.plain(2, 2, max_iterations=10, burn_in=5).run(blocks, "VariationalEM", runs=6)
    assert recovered(spark, blocks, got) >= 0.95


def test_distributed_sums_equal_local_ones(spark, blocks, monkeypatch):
    from chronolattice.operators.coclustering import estimator as est

    local = BlockEstimator.plain(2, 2, max_iterations=1, burn_in=0, sweeps=1, seed=4).run(blocks)
    monkeypatch.setattr(est, "LOCAL_ROWS", 0)
    far = BlockEstimator.plain(2, 2, max_iterations=1, burn_in=0, sweeps=1, seed=4).run(blocks)
    np.testing.assert_allclose(local.log_likelihood, far.log_likelihood)


def test_selection(spark, blocks):
    data = Matrix(blocks)
    best, found = grid_search(data, BlockEstimator.plain(1, 1, max_iterations=4, burn_in=3), [(k,) * n for k in (1, 2) for n in (1, 2)], runs=2)
    assert best.model.sizes == [2, 2] and len(found) == 4
    assert icl(best.model, 0.0, 30, 6) < 0


def test_generator_is_seeded(spark):
    a = synthetic.clusters(spark, [["sine"], ["rectangle"]], 0.01, [2], [1, 1], length=10, seed=5)
    assert a.count() == 4 and a.orderBy("id").collect() == synthetic.clusters(spark, [["sine"], ["rectangle"]], 0.01, [2], [1, 1], length=10, seed=5).orderBy("id").collect()
    assert {r.trueFeatureCluster for r in a.collect()} == {0, 1}


def test_readme_pipeline(spark):
    d = catalogue._demo(spark)
    got, result = d.add_lbm("cluster", "pca", k=2, l=2, max_iterations=5, burn_in=3, runs=2, seed=3)
    assert got.adjusted_rand("cluster", "trueCluster") >= 0.95


def test_steps(spark, points):
    _, d = points
    e = steps.ClusteringEvaluation("truth", "x")
    p = steps.FunctionStep(lambda s: s.with_column("decorators", F.create_map(F.lit("k"), F.col("truth").cast("string")))) + (steps.PartitionStep(2) + steps.PersistStep()) + e + steps.GlobalUnpersist()
    assert isinstance(p, steps.Pipeline) and len(p.steps) == 5 and p(d).count() == 60
    assert e.davies_bouldin < 0.5 and e.contingency.count() == 3
    labels = d.with_column("labels", F.array(F.col("truth"), F.col("truth")))
    out = steps.PrototypeScaling("m", "labels", np.array([[0.0], [1.0], [5.0]]), 2)(labels)
    assert out.count() == 60


def test_coclustering_files(spark, tmp_path):
    d = catalogue._demo(spark, 6)
    d.add_lbm("cluster", "pca", k=2, l=2, max_iterations=3, burn_in=2, seed=3, folder=str(tmp_path / "o"), series="series")
    lines = (tmp_path / "o" / "model.csv").read_text().splitlines()
    assert lines[0].startswith("id,rowCluster,colCluster") and len(lines) == 5
    assert spark.read.csv(str(tmp_path / "o" / "dataAndCluster")).count() == 12 * 6


def _grouped(spark, keys):
    rng = np.random.default_rng(0)
    rows = [(k, [[float(3 * (i % 2) + rng.normal(0, 0.1)), float(rng.normal(0, 0.1))] for _ in range(4)]) for i, k in enumerate(keys)]
    return SeriesSet(spark.createDataFrame(rows, "gkey string, cells array<array<double>>"))


@pytest.mark.parametrize("keys", [[str(i // 2) for i in range(20)], [None] * 10 + ["a"] * 10])
def test_repeated_and_null_keys_keep_their_rows(spark, keys):
    d, result = _grouped(spark, keys).add_lbm("cluster", "cells", k=2, l=1, max_iterations=4, burn_in=2, seed=1)
    assert d.df.count() == 20 and d.df.where("cluster is null").count() == 0


def test_starts(spark):
    d = _grouped(spark, [str(i) for i in range(20)])
    for init in ("randomPartition", "KMeans", "FunLBM"):
        got, _ = d.add_lbm("cluster", "cells", k=2, l=1, max_iterations=4, burn_in=2, seed=1, init=init)
        found = {r.gkey: r.cluster for r in got.df.collect()}
        assert len({found[str(i)] for i in range(0, 20, 2)}) == 1 and found["0"] != found["1"], init
    with pytest.raises(ValueError):
        d.add_lbm("cluster", "cells", init="nonsense")


def test_f_beta_of_one_and_of_no_rows(spark):
    one = SeriesSet(spark.createDataFrame([(1, 1)], "a int, b int"))
    assert one.f_beta("a", "b")(1.0) is None
    assert SeriesSet(one.df.limit(0)).f_beta("a", "b")(2.0) is None
    some = SeriesSet(spark.createDataFrame([(1, 1), (1, 1), (2, 1), (2, 2)], "a int, b int"))
    assert some.f_beta("a", "b")(1.0) == pytest.approx(some.f1("a", "b"))


def test_scaling_and_components_of_no_rows(spark):
    none = SeriesSet(spark.createDataFrame([], "id long, x array<double>"))
    assert none.add_mds("out", "x", 2).df.count() == 0
    assert none.pca_correlation_circle("x", "x").count() == 0


@pytest.mark.parametrize("init", ["random", "k-means++"])
def test_k_means_of_all_rows(spark, init):
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 20, (4, 3))
    x = np.concatenate([c + rng.normal(0, 0.5, (50, 3)) for c in centres])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(999, None)], "id long, x array<double>").repartition(3)
    model = min((KMeans(4, 30, seed, init).fit(df, "x") for seed in range(4)), key=lambda m: m.inertia[-1])
    assert model.inertia == sorted(model.inertia, reverse=True)
    got = {r.id: r.label for r in model.assign(df, "x", "label").collect()}
    assert got.pop(999) is None and [len({got[i] for i in range(k, k + 50)}) for k in range(0, 200, 50)] == [1] * 4 and len(set(got.values())) == 4
    same = KMeans(4, 30, 0, init).fit(df.repartition(5), "x").centres
    np.testing.assert_allclose(same, KMeans(4, 30, 0, init).fit(df, "x").centres)
    assert len(KMeans(5, 3, 0, init).fit(df.where("id < 2"), "x").centres) == 2
    with pytest.raises(ValueError):
        KMeans(2).fit(df.limit(0), "x")


@pytest.mark.parametrize("start", [True, False])
def test_mixture_of_many_dimensions_copies_and_nulls(spark, start):
    """Groups far apart in 64 dimensions, one of them of equal rows (a covariance of rank 0), and a row without values."""
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(0, 1, (100, 64)) + 30 * (np.arange(64) == 40 + g) for g in range(2)] + [np.full((40, 64), -9.0)])
    d = SeriesSet(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(999, None)], "id long, x array<double>").repartition(3))
    got, model = d.add_mixture("g", "x", 3, 10, start, runs=1 if start else 4, seed=1, probabilities="p", log_likelihood="l")
    found = {r.id: r for r in got.df.collect()}
    assert found[999].g is None and found[999].p is None and found[999].l is None and len(found) == 241
    assert all(sum(found[i].p) == pytest.approx(1.0) and np.isfinite(found[i].l) for i in range(240))
    if start:
        assert [len({found[i].g for i in part}) for part in (range(100), range(100, 200), range(200, 240))] == [1, 1, 1]
        assert len({found[i].g for i in (0, 100, 200)}) == 3 and sorted(model.weights) == pytest.approx([40 / 240, 100 / 240, 100 / 240])


def test_gaussian_mixture_takes_all_components(spark, tmp_path):
    rng = np.random.default_rng(3)
    # Only component 40 tells the groups apart.
    rows = [(i, (rng.normal(0, 1, 64) + 30 * (i % 3) * (np.arange(64) == 40)).tolist(), i % 3) for i in range(600)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = catalogue.QUERIES["gaussian_mixture"](spark, str(tmp_path)).collect()
    assert len({(r.id % 3, r.cluster) for r in got}) == 3 and len({r.cluster for r in got}) == 3


def test_summaries_centring_and_targets_in_blocks(spark, monkeypatch):
    """Many small blocks against brute force, and a vector that is null: its distances are null and count for nothing."""
    monkeypatch.setattr(dist, "BLOCK", 7)
    monkeypatch.setattr(dist, "BLOCKS", 2)
    monkeypatch.setattr(dist, "STRIP", 3)
    x = np.random.default_rng(5).integers(0, 3, (40, 5)).astype(float)
    d = SeriesSet(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>"))
    off = ((x[:, None] - x[None]) ** 2).sum(-1)
    got = {r.id: r for r in d.distance_summaries("x").collect()}
    for i in range(40):
        others = np.where(np.arange(40) == i, np.inf, off[i])
        assert (got[i].n, got[i].total, got[i].nearest, got[i].least) == (40, off[i].sum(), others.argmin(), others.min())
    b = -0.5 * off
    b = b - b.mean(0) - b.mean(1)[:, None] + b.mean()
    rows = reduction.centred_rows(d.df, "id", "x", dist.euclidean(False), 40).collect()
    assert len(rows) == 1600 and max(abs(r.b - b[r.id1, r.id2]) for r in rows) < 1e-9
    plan = dist.pairwise(d.df, "id", "x", dist.euclidean(), rows=40)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Generate" not in plan
    targets = d.df.where("id % 10 = 0")
    pairs = d.distances_to("x", targets, {"h": dist.hamming, "d": dist.euclidean()}).df.collect()
    assert len(pairs) == 160 and all(r.h == (x[r.id1] != x[r.id2]).sum() and r.d == off[r.id1, r.id2] for r in pairs)
    near = {r.refId: (r.closestPoint, r.distance) for r in d.closest_to_targets("x", targets, itself=False, in_blocks=dist.euclidean()).collect()}
    assert near == {i: (got[i].nearest, got[i].least) for i in (0, 10, 20, 30)}
    some = SeriesSet(d.df.union(spark.createDataFrame([(99, None)], d.df.schema)))
    assert some.row_distances("x").df.where("distance is null").count() == 81
    assert {r.id: r.least for r in some.distance_summaries("x").collect()} == {**{i: got[i].least for i in range(40)}, 99: None}


def test_ward_of_many_rows_equals_small(spark, monkeypatch):
    from chronolattice.operators import clustering

    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(c, 1.0, (60, 4)) for c in (0, 3, 9)] + [np.full((20, 4), 5.5)])
    d = SeriesSet(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, x array<double>"))
    small, tree = d.add_hierarchical("x", [2, 10])
    monkeypatch.setattr(clustering, "DRIVER_POINTS", 0)
    monkeypatch.setattr(clustering, "PAIRS_ON_DRIVER", 2000)
    monkeypatch.setattr(clustering, "PAIRS_AT_A_TIME", 500)
    large, rounds = d.add_hierarchical("x", [2, 10])
    np.testing.assert_allclose([m[2] for m in rounds.merges], [m[2] for m in tree.merges], atol=1e-6)
    assert large.df.orderBy("id").select("hclust_2", "hclust_10").collect() == small.df.orderBy("id").select("hclust_2", "hclust_10").collect()
    with pytest.raises(ValueError):
        d.add_hierarchical("x", [2], "single")


def test_scaling_of_many_vectors_equals_small(points, monkeypatch):
    _, d = points
    got, small = d.add_mds_with_model("m", "x", 3)
    monkeypatch.setattr(reduction, "DRIVER_POINTS", 0)
    monkeypatch.setattr(reduction, "pairwise", None)
    far, large = d.add_mds_with_model("m", "x", 3)
    np.testing.assert_allclose(large.eigenvalues, small.eigenvalues, rtol=1e-9)
    np.testing.assert_allclose(large.explained, small.explained, rtol=1e-9)
    np.testing.assert_allclose(np.abs([r.m for r in far.df.orderBy("id").collect()]), np.abs(small.coordinates), atol=1e-8)
    assert large.ids == small.ids and large.stress == pytest.approx(small.stress, abs=1e-9)
