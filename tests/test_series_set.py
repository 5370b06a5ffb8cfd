import numpy as np
import pytest
from pyspark.sql import functions as F

from chronolattice.operators.series_set import SeriesSet
from chronolattice.sources import readers, writers


@pytest.fixture(scope="module")
def data(spark):
    rows = [(i, {"simulationId": str(s), "varName": v}, [float(i), i + 1.0], i % 2) for i, (s, v) in enumerate([(2, "b"), (10, "a"), (2, "a"), (10, "b")])]
    return SeriesSet(spark.createDataFrame(rows, "id long, decorators map<string,string>, series array<double>, c int"))


def test_ids(spark):
    d = SeriesSet(spark.createDataFrame([(1.0,)], "x double"))
    assert "id" in d.columns and d.regenerate_ids().count() == 1 and "id" in d.drop("id").columns


def test_select_falls_back_to_decorators(data):
    got = data.select("varName", "c").order_by("varName", "c")
    assert [(r.varName, r.c) for r in got.collect()] == [("a", 0), ("a", 1), ("b", 0), ("b", 1)]


def test_filter_union_limit_constant(data):
    assert data.filter_decorator("varName", "a").count() == 2
    assert data.filter_decorator("missing", "a").count() == 0
    assert data.union(data).count() == 8
    assert data.add_constant("k", [1, 2]).take(1)[0].k == [1, 2]
    assert data.with_column_renamed("c", "d").limit(3).count() == 3
    assert data.sample(1.0).count() == 4


def test_group_orders_keys_as_text(data):
    g = data.group("varName", "simulationId").order_by("gkey").collect()
    assert [(r.gkey, r.inGKey, r.c) for r in g] == [("a", ["10", "2"], [1, 0]), ("b", ["10", "2"], [1, 0])]
    assert g[0].series == [[1.0, 2.0], [2.0, 3.0]] and g[0].decorators[0]["simulationId"] == "10"


def test_map_groups_and_folds(data):
    out = data.map_decorator_groups(["varName"], lambda f: f.groupby("group_varName", as_index=False)["c"].sum(), "group_varName string, c long")
    assert {(r[0], r[1]) for r in out.collect()} == {("a", 1), ("b", 1)}
    folded = data.aggregate_by_key_then_map(F.col("c"), F.col("id"), 0, lambda a, x: a + x, lambda a, b: a + b, str)
    assert dict(folded.collect()) == {0: "2", 1: "4"}
    assert {(r.key, r["mean"]) for r in data.mean_by_key(F.col("c"), F.col("id")).collect()} == {(0, 1.0), (1, 2.0)}


def test_metadata_and_warnings(spark, data):
    meta = spark.createDataFrame([("2", "x")], "k string, colour string")
    d = data.add_metadata_decorators(meta, data.decorator("simulationId"), "k")
    got = {r.id: r.decorators.get("colour") for r in d.collect()}
    assert got == {0: "x", 1: None, 2: "x", 3: None} and all("varName" in r.decorators for r in d.collect())
    old = data.add_metadata_text_decorators(meta.withColumnRenamed("k", "Test Case "))
    assert {r.id: r.decorators.get("colour") for r in old.collect()} == got
    w = spark.createDataFrame([("2", "name", "w", "i", "1"), ("2", "name", "w", "i", "3")], "scenario_id string, scenario_name string, warning_name string, indicator_name string, value string")
    r = {x.id: x.decorators for x in data.add_warning_decorators(w).collect()}
    assert r[0]["w::i"] == "3" and r[0]["simulationName"] == "name" and "w::i" not in r[1]


def test_statistics(data):
    assert data.column_mean("c") == 0.5 and data.column_deviation("c") == pytest.approx(np.std([0, 1, 0, 1], ddof=1))
    assert data.column_quantiles("id") == [0.0, 1.0, 2.0]
    assert data.decorator_names() == ["simulationId", "varName"] and data.decorator_domain("varName") == ["a", "b"]
    assert data.series_length("series") == 2 and data.to_matrix("series").shape == (4, 2)
    assert sorted(r.step for r in data.first_steps("series").collect()) == [1.0] * 4


def test_save_and_csv(spark, data, tmp_path):
    data.save(str(tmp_path / "p"))
    assert SeriesSet.load(spark, str(tmp_path / "p")).count() == 4
    with pytest.raises(Exception):
        data.save(str(tmp_path / "p"))
    data.save_csv(str(tmp_path / "c"), overwrite=True)
    r = spark.read.csv(str(tmp_path / "c"), header=True).orderBy("id").first()
    assert r.series == "0.0;1.0" and r.decorators_simulationId == "2"


def test_scenario_files(spark, tmp_path):
    for k in (7, 8):
        (tmp_path / f"run_{k}_x.txt").write_text("time\tspeed\tname\tgear\n0\t9\ta\t9\n1\t1.5\tb\t2\n3\tnull\tc\t4\n")
    d = SeriesSet.read_scenario_folder(spark, str(tmp_path))
    got = {(r.decorators["simulationId"], r.decorators["varName"]): r for r in d.collect()}
    assert set(got) == {(s, v) for s in "78" for v in ("time", "speed", "gear")}
    r = got["7", "speed"]
    assert (r.timeFrom, r.timeTo, r.timeGranularity, r.series) == (1.0, 3.0, 2.0, [1.5, None])
    one = SeriesSet.read_scenario(spark, str(tmp_path / "run_7_x.txt"), decorators={"a": "b"})
    assert one.count() == 3 and one.take(1)[0].decorators["a"] == "b"


def test_wide_table_and_points(spark):
    raw = spark.createDataFrame([("s", "p", 2.0, 5.0), ("s", "p", 1.0, 4.0)], "scenarioId string, simulationPlanId string, time double, v double")
    warnings = spark.createDataFrame([("s", 1)], "scenario_id string, `w.i` int")
    r = SeriesSet.read_wide(raw, metadata=spark.createDataFrame([("s", "m")], "_id string, tag string"), warnings=warnings).take(1)[0]
    assert r.series == [4.0, 5.0] and r.timeGranularity == 1.0 and r.decorators["tag"] == "m" and r.decorators["w::i"] == "1" and r.decorators["planId"] == "p"
    p = SeriesSet.from_points(spark.createDataFrame([(1, "v", [0.0, 0.5], [3.0, 4.0])], "simulation int, variable string, times array<double>, values array<double>")).take(1)[0]
    assert (p.timeFrom, p.timeTo, p.timeGranularity) == (0.0, 0.5, 0.5)


def test_sparse_text_and_writers(spark, tmp_path):
    (tmp_path / "d.txt").write_text('header\n"0:1.5;1:2.5"\n')
    assert readers.read_sparse_text(spark, str(tmp_path / "d.txt")).first()["values"] == [1.5, 2.5]
    writers.write_matrix(str(tmp_path / "m.csv"), [[1, 2], [3, 4]])
    assert (tmp_path / "m.csv").read_text().split() == ["id,0,1", "1,1,2", "2,3,4"]
    assert [r["values"] for r in readers.transposed(spark.createDataFrame([("x", 2.0, 5), ("y", 1.0, 4)], "n string, time double, v int")).where("name = 'v'").collect()] == [[4.0, 5.0]]


def test_empty_set(spark):
    d = SeriesSet(spark.createDataFrame([], "id long, decorators map<string,string>, series array<double>"))
    assert d.add_z_normalized("z", "series", 1e-9).add_dft("f", "z").count() == 0
    assert d.group("varName", "simulationId").count() == 0 and d.decorator_names() == []
