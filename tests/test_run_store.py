"""The run store: publication, faults between its steps, retention, readers and second writers."""

import os

import pytest
from pyspark.sql import functions as F

from regolith.operators.run_store import RunStore

RESULTS = "sensor string, mineral string, method string, threshold double, high_pixels long"
LAYERS = "sensor string, mineral string, method string, y int, x int, index_value double, is_anomaly boolean"


@pytest.fixture
def store(spark, tmp_path):
    return RunStore(spark, str(tmp_path / "store"))


def run(run_id, created="2024-01-01T00:00:00", project="p", deposit="gold", **more):
    return {"run_id": run_id, "created_at": created, "project": project, "deposit": deposit, **more}


def tables(spark, value=1.0):
    results = spark.createDataFrame([("ASTER", "clay", "ratio", value, 2), ("ASTER", "iron", "pca", value, 1), ("08", "clay", "ratio", value, None)], RESULTS)
    layers = spark.createDataFrame([("ASTER", "clay", "ratio", y, 0, value, y > 1) for y in range(4)] + [("08", "clay", "ratio", 0, 0, value, True)], LAYERS)
    return results, layers


def test_a_published_run_is_found_by_its_id(spark, store):
    found = store.publish(run("a/b_1", usable_sensors=["ASTER"], params={"k": 2}, structural={"strike": 30, "rose_diagram": "xyz"}), *tables(spark))
    assert found == {"run_id": "a/b_1", "n_results": 3, "n_layers": 2, "n_pixels": 5, "warnings": ["no layer for ASTER iron pca"], "removed": []}
    own = store.load("a/b_1")
    assert own.manifest["usable_sensors"] == ["ASTER"] and own.manifest["params"] == {"k": "2"} and own.manifest["high_pixels"] == 3
    assert own.manifest["structural"] == {"strike": "30", "rose_diagram_present": "true"}
    assert own.results.count() == 3 and {r.sensor for r in own.layers.collect()} == {"ASTER", "08"}
    assert own.layers.where("sensor = 'ASTER' AND mineral = 'clay'").agg(F.sum("y")).first()[0] == 6
    files = own.layers.where("sensor = '08'")._jdf.queryExecution().executedPlan().toString()
    assert "a%2Fb_1" in files.replace("%25", "%") or "PartitionFilters" in files
    seen = store.visible().first()
    assert (seen.run_id, seen.n_results, seen.n_layers, seen.warnings) == ("a/b_1", 3, 2, ["no layer for ASTER iron pca"])
    assert store.load("a") is None and store.load("../a/b_1") is None


def test_who_stops_before_the_manifest_leaves_nothing_visible(spark, store, monkeypatch):
    results, layers = tables(spark)
    with pytest.raises(Exception, match="stopped in the layers"):
        store.publish(run("r1"), results, layers.withColumn("index_value", F.raise_error(F.lit("stopped in the layers")).cast("double")))
    assert store.visible().count() == 0 and os.listdir(f"{store.root}/attempts") == []

    def stopped(*args):
        raise KeyboardInterrupt

    monkeypatch.setattr(RunStore, "_show", stopped)
    with pytest.raises(KeyboardInterrupt):
        store.publish(run("r1"), results, layers)
    monkeypatch.undo()
    assert store.visible().count() == 0 and store.load("r1") is None and os.listdir(f"{store.root}/data") == []
    # A process that dies between the tables and the manifest cannot clean up: sweep() does, once they are old.
    monkeypatch.setattr(RunStore, "_show", stopped)
    monkeypatch.setattr(type(store.files), "remove", lambda self, name: None)
    with pytest.raises(KeyboardInterrupt):
        store.publish(run("r1"), results, layers)
    monkeypatch.undo()
    assert len(os.listdir(f"{store.root}/data")) == 1 and store.load("r1") is None
    assert store.sweep() == [] and len(store.sweep(grace=0.0)) == 1
    assert store.publish(run("r1"), results, layers)["n_layers"] == 2 and store.visible().count() == 1
    assert store.sweep(grace=0.0) == [] and store.load("r1").layers.count() == 5


def test_the_second_writer_of_an_id_is_refused(spark, store, monkeypatch):
    store.publish(run("r1"), *tables(spark, 1.0))
    with pytest.raises(FileExistsError):
        store.publish(run("r1"), *tables(spark, 2.0))
    # One that checked before the first one published.
    monkeypatch.setattr(type(store.files), "exists", lambda self, name, exists=type(store.files).exists, first=[]: False if name.endswith(".json") and not first and not first.append(1) else exists(self, name))
    with pytest.raises(FileExistsError):
        store.publish(run("r1"), *tables(spark, 2.0))
    monkeypatch.undo()
    assert store.load("r1").results.first().threshold == 1.0 and len(os.listdir(f"{store.root}/data")) == 1


def test_retention_keeps_the_newest_by_time_and_name(spark, store):
    results, layers = tables(spark)
    times = {"r1": "2024-01-01", "r3": "2024-01-02", "r2": "2024-01-02", "r4": "2023-01-01"}
    for name, at in times.items():
        store.publish(run(name, at), results, layers, keep=0)
    store.publish(run("other", "2020-01-01", deposit="gold_b"), results, layers, keep=0)
    reader = store.load("r1")
    assert store.prune(2, "p", "gold") == ["r1", "r4"]
    assert {r.run_id for r in store.visible().collect()} == {"r2", "r3", "other"} and store.load("r1") is None
    assert {(r.deposit, r.run_id) for r in store.latest().collect()} == {("gold", "r3"), ("gold_b", "other")}
    assert store.prune(2) == [] and store.prune(0) == []
    # Who has a run open goes on reading it until it is swept.
    assert store.sweep() == [] and reader.layers.count() == 5
    assert len(store.sweep(grace=0.0)) == 2 and len(os.listdir(f"{store.root}/data")) == 3 and os.listdir(f"{store.root}/removed") in ([], sorted(os.listdir(f"{store.root}/removed")))
    found = store.publish(run("r5", "2025-01-01"), results, layers, keep=2)
    assert found["removed"] == ["r2"] and {r.run_id for r in store.visible().collect()} == {"r3", "r5", "other"}


def test_an_empty_store_and_damaged_manifests(spark, store, tmp_path):
    assert store.visible().count() == 0 and store.load("x") is None and store.prune(1) == [] and store.sweep(0.0) == []
    results, layers = tables(spark)
    found = store.publish(run("r"), results.limit(0), layers.limit(0))
    assert (found["n_results"], found["n_layers"], found["n_pixels"]) == (0, 0, 0)
    with open(f"{store.root}/manifests/run-broken.json", "w") as file:
        file.write("{not json")
    assert [r.run_id for r in store.visible().collect()] == ["r"]
    with pytest.raises(ValueError, match="needs an id"):
        store.load("")
