"""The pipeline, stage by stage, on a small corpus."""

import random

import pytest

import corpus_pipeline


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(1)
    out = tmp_path_factory.mktemp("sf")
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8)))
    rows, labels = [], []
    for i in range(240):
        good = rng.random() < 0.8
        lines = [" ".join(word() if good else word().upper() + "!!" for _ in range(rng.randrange(5, 30))) for _ in range(rng.randrange(1, 5))]
        rows.append((i, "\n".join(lines), "en", f"s{i % 4}", 0))
        labels.append((i, int(good), 0))
    rows += [(300 + k, rows[k][1], "en", "s0", 0) for k in range(0, 60, 2)]
    shared = " ".join(word() for _ in range(60))
    rows += [(400 + k, shared + "\n" + " ".join(word() for _ in range(40)), "fr", "s9", 0) for k in range(10)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    return str(out)


def test_stages_take_effect(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialise(stage(spark, docs, folder), "test-stage")
        assert docs.columns == columns, name
        seen[name] = {r.doc_id: r.text for r in docs.collect()}
    bad = {r.doc_id for r in spark.read.parquet(f"{folder}/documents.parquet").where("text like '%!!%'").collect()}
    first = seen["quality classifier"]
    assert len(bad & set(first)) <= 0.1 * len(bad) and len(set(first) - bad) > 200
    lines = seen["line dedup"]
    assert not set(range(300, 360)) & set(lines)
    whole = [t.split("\n")[0] for k, t in lines.items() if 400 <= k < 410]
    assert sum(len(t.split()) == 60 for t in whole) == 1
    assert set(seen["near dedup"]) <= set(lines) and set(seen["source mixing"]) <= set(seen["near dedup"])
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert pieces.count() > 0 and [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "line dedup", "near dedup", "source mixing", "packing"]


def test_run_is_the_stages(spark, folder):
    got = corpus_pipeline.run(spark, folder)
    assert {"doc_id", "start", "length", "sequence_id", "offset"} <= set(got.columns) and got.count() > 0
