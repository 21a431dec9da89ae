"""Registered queries against DuckDB on the smallest tables (a sample of them;
``compare.py`` runs all)."""

import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from compare import TABLES, canonical
from conftest import TESTDATA

SAMPLE = ("F005_weekly_oscillators", "F006_other_indicators", "F021_klinger", "F036_trend", "F064_entropy_regime",
          "F087_volume_indicators", "F110_reversal", "F132_hurst", "R01_resample_3d", "R05_weekly_to_daily",
          "D10_chunk_split_scattered", "G04_time_warp", "E06_precision_recall_summary", "E13_temperature",
          "T17_suspicious_counts", "Q14_removal_round", "V07_lookahead_found", "S08_training_log")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{TESTDATA}/{t}.parquet'")
    return con


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_registration_needs_no_session():
    root = os.path.dirname(os.path.abspath(entry.__file__))
    subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; e.queries(); e.oracle_sql()"], cwd=root, check=True, timeout=120)


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_duckdb(spark, duck, name):
    got = canonical(entry.queries()[name](spark, TESTDATA).toPandas())
    want = canonical(duck.execute(entry.oracle_sql()[name]).fetchdf())
    assert list(got.columns) == list(want.columns) and len(got) == len(want)
    assert got.equals(want)


def test_report_computes_its_features_once(spark, tmp_path):
    """Three checks read the features; none of them computes them again."""
    spark.sql("""SELECT id AS l_orderkey, id % 7 AS l_partkey, id % 3 AS l_suppkey, 1 AS l_linenumber, 1.0D + id % 5 AS l_quantity,
        100.0D + id % 11 AS l_extendedprice, 0.01D * (id % 4) AS l_discount, 0.01D * (id % 3) AS l_tax,
        timestamp '1998-01-01' + make_interval(0, 0, 0, int(id div 3)) AS l_shipdate FROM range(180)""").write.parquet(
        f"{tmp_path}/lineitem.parquet")
    got = entry.queries()["V12_report"](spark, str(tmp_path))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "FlatMapGroupsInArrow" not in plan
    rows = {(r.chunk, r.check): r.passed for r in got.collect()}
    assert len(rows) == 9 and rows[("bounds", "rsi_daily")] and rows[("rules", "rsi_bounded")]
