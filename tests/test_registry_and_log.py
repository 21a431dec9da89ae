"""Pairwise correlations with gaps, hash tree of a table, run log that is appended once."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.operators import quality as Q
from tickloom.operators import validate as V
from tickloom.sources import runs


def test_correlations_of_columns_with_different_gaps(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(0, 1, (900, 5))
    x[:, 1] += x[:, 0]
    x[:, 2] = 1e9 + x[:, 0] * 1e-2                    # a small spread on a large level
    x[:, 3] = 4.25
    pdf = pd.DataFrame(x, columns=list("abcde"))
    for i, c in enumerate("abde"):
        pdf.loc[rng.random(900) < 0.1 * (i + 1), c] = np.nan
    pdf["f"] = np.nan
    got = Q.redundancy(spark.createDataFrame(pdf).repartition(5), list("abcdef")).toPandas()
    assert len(got) == 36
    want = pdf.corr().abs()
    for a, b, r in got.itertuples(index=False):
        if "d" in (a, b) or "f" in (a, b):
            assert r is None or np.isnan(r)
        else:
            assert r == pytest.approx(want.loc[a, b], abs=1e-6)
    assert Q.redundancy(spark.createDataFrame(pdf).limit(0), ["a", "b"]).filter("correlation is not null").count() == 0


def test_hash_tree_names_the_changed_bucket(spark):
    df = spark.range(5000).select("id", (F.col("id") * 7 % 101).alias("v"), F.concat(F.lit("t"), F.col("id") % 13).alias("t"))
    leaves = V.content_leaves(df, ["id"])
    assert V.changed_buckets(leaves, V.content_leaves(df.orderBy(F.col("id").desc()), ["id"])).count() == 0
    root = V.content_root(leaves).first()
    assert root.rows == 5000
    one = df.withColumn("v", F.when(F.col("id") == 4321, F.col("v").bitwiseXOR(F.lit(1))).otherwise(F.col("v")))
    found = V.changed_buckets(leaves, V.content_leaves(one, ["id"])).collect()
    home = V.content_leaves(df.filter("id = 4321"), ["id"]).first().bucket
    assert [(r.bucket, r.problem) for r in found] == [(home, "changed")]
    assert V.content_root(V.content_leaves(one, ["id"])).first().root != root.root
    # values of two rows exchanged: same rows of values, another table
    swap = df.withColumn("v", F.when(F.col("id") == 1, 14).when(F.col("id") == 2, 7).otherwise(F.col("v")))
    assert V.changed_buckets(leaves, V.content_leaves(swap, ["id"])).count() == 2
    assert V.fingerprint(swap).first() != V.fingerprint(df).first()
    fewer = V.changed_buckets(V.content_leaves(df.limit(0), ["id"]), V.content_leaves(df.filter("id = 3"), ["id"])).collect()
    assert [r.problem for r in fewer] == ["added"] and V.content_root(leaves.limit(0)).first().rows == 0


def test_a_batch_is_appended_once(spark, tmp_path):
    path = str(tmp_path / "log")
    one = spark.createDataFrame([("a", "F", 0.5)], "experiment string, phase string, val_loss double")
    two = spark.createDataFrame([("b", "O", 0.25)], "experiment string, phase string, val_loss double")
    assert runs.committed(spark, path) == {}
    runs.append_log(one, path, "first")
    runs.append_log(one, path, "first")               # a retry
    runs.append_log(two, path, "second/odd name")
    runs.append_log(one, path)                        # a batch of its own
    # an attempt that ended before its record was written
    runs.align_log(two).write.option("header", True).csv(f"{path}/data/lost")
    got = sorted((r.experiment, r.phase, r.val_loss) for r in runs.read_log(spark, path).collect())
    assert got == [("a", "F", 0.5), ("a", "F", 0.5), ("b", "O", 0.25)]
    assert len(runs.committed(spark, path)) == 3
