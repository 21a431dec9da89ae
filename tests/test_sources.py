"""Readers and writers on files."""

import json

from pyspark.sql import functions as F

from tickloom.operators import validate as V
from tickloom.sources import runs, tables


def test_bars_round_trip(spark, make_bars, tmp_path):
    bars = make_bars([1, 2, 3]).unionByName(make_bars([5, 6], key="B"))
    tables.write_bars(bars, str(tmp_path / "b"), buckets=4)
    back = tables.read_bars(spark, str(tmp_path / "b"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, bars.collect()))


def test_shared_folder_follows_the_session(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    folder = tables.shared_folder(spark)
    assert folder == named if named else "tickloom-" in folder


def test_trial_files(spark, tmp_path):
    folder = tmp_path / "phase6a_2M_h1_threshold_1pct" / "trials"
    folder.mkdir(parents=True)
    record = {"trial_number": 0, "value": 0.3634, "params": {"learning_rate": 0.0005, "epochs": 100},
              "state": "COMPLETE", "architecture": {"d_model": 64, "n_layers": 32},
              "user_attrs": {"arch_idx": 2, "learning_curve": [{"epoch": 0, "train_loss": 0.48, "val_loss": 0.49},
                                                               {"epoch": 1, "train_loss": 0.46, "val_loss": 0.44}]}}
    (folder / "trial_0000.json").write_text(json.dumps(record, indent=1))
    (folder / "trial_0001.json").write_text("{ not json")
    got = runs.read_trials(spark, str(tmp_path)).collect()
    assert len(got) == 1 and got[0]["budget"] == "2M" and got[0]["horizon"] == "h1"
    assert got[0]["epochs_config"] == 100 and len(got[0]["learning_curve"]) == 2 and got[0]["d_model"] == 64


def test_run_log_keeps_its_columns(spark, tmp_path):
    path = str(tmp_path / "log")
    runs.append_log(spark.createDataFrame([("a", {"lr": 0.1})], "experiment string, hyperparameters map<string,double>"), path)
    runs.append_log(spark.createDataFrame([("b", "success")], "experiment string, status string"), path)
    rows = {r["experiment"]: r for r in runs.read_log(spark, path).collect()}
    assert tuple(rows["a"].asDict()) == runs.LOG_COLUMNS
    assert rows["a"]["hyperparameters"] == {"lr": 0.1} and rows["b"]["status"] == "success" and rows["b"]["val_loss"] is None


def test_training_log_over_several_blocks(spark, tmp_path):
    s = "[I 2025-12-30 19:33:09,101] "
    lines = ["[1/12] Starting: hpo_2M_h1_threshold_1pct.py"]
    for i in range(200):
        lines += [f"{s}Trial {i}: arch_idx=1, d_model=64, n_layers=2, n_heads=4, params=1,234, lr=1e-4, epochs=5, batch_size=32",
                  f"{s}Trial {i} finished with value: 0.{i + 100} and parameters: {{'dropout': 0.1, 'epochs': 5}}"]
    lines += ["[1/12] PASSED: hpo_2M_h1_threshold_1pct.py", "[2/12] Starting: hpo_20M_h1_threshold_1pct.py",
              f"{s}Trial 0: arch_idx=3, d_model=32, n_layers=2, params=99, lr=0.5, epochs=5, batch_size=8",
              f"{s}Trial 0 finished with value: 0.5 and parameters: {{'dropout': 0.3}}", "[2/12] FAILED: hpo_20M_h1_threshold_1pct.py"]
    (tmp_path / "run.log").write_text("\n".join(lines) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        log = runs.read_training_log(spark, str(tmp_path / "run.log"))
        assert log.select("block").distinct().count() > 3
        got = runs.parse_training_log(log).collect()
        status = {r["experiment"]: r["status"] for r in runs.experiment_status(log).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert len(got) == 201 and status == {"2M_h1": "PASSED", "20M_h1": "FAILED"}
    last = [r for r in got if r["experiment"] == "20M_h1"]
    assert len(last) == 1 and last[0]["d_model"] == 32 and last[0]["n_heads"] is None and last[0]["params"]["dropout"] == 0.3
    first = [r for r in got if r["experiment"] == "2M_h1" and r["trial_number"] == 0]
    assert first[0]["arch_idx"] == 1 and first[0]["param_count"] == 1234


def test_fingerprint_ignores_order_but_not_content(spark):
    a = spark.range(100).select("id", (F.col("id") * 2).alias("v"))
    one, two = V.fingerprint(a).first(), V.fingerprint(a.orderBy(F.col("id").desc())).first()
    assert one == two
    assert V.fingerprint(a.withColumn("v", F.col("v") + 1)).first() != one
