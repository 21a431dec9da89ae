"""Running totals in the order of a group, for groups of any size.

Rows are range-partitioned by (group, order) and sorted inside their partition: one
shuffle, and a group that holds all rows is spread over all tasks.  Each task totals
its own rows; a group that goes on in the next partition hands its total on, which
takes two rows a partition."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.sources.tables import stored

PART, RUN = "__part", "__run"


def _starts(batch: pa.RecordBatch, last: list | None, n_keys: int) -> np.ndarray:
    """Whether a row's key differs from the one before it (null is a key of its own)."""
    out = np.zeros(batch.num_rows, bool)
    for i in range(n_keys):
        column = batch.column(i)
        if batch.num_rows > 1:
            a, b = column.slice(1), column.slice(0, batch.num_rows - 1)
            same = pc.if_else(pc.and_(a.is_valid(), b.is_valid()), pc.fill_null(pc.equal(a, b), False),
                              pc.and_(a.is_null(), b.is_null()))
            out[1:] |= ~same.to_numpy(zero_copy_only=False)
        if last is not None:
            out[0] |= not column[0].equals(last[i])
    return out


def _totalled(n_keys: int, n_values: int, out_schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last, run_no, held = None, 0, [0] * n_values
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            first = _starts(batch, last, n_keys)
            last = [batch.column(i)[n - 1] for i in range(n_keys)]
            run = np.cumsum(first)
            begin = np.maximum.accumulate(np.where(first, np.arange(n), 0))
            columns = list(batch.columns[:batch.num_columns])
            for k in range(n_values):
                v = batch.column(batch.num_columns - n_values + k).to_numpy(zero_copy_only=False)
                before = np.cumsum(v) - v
                total = before - np.where(run > 0, before[begin], 0)
                total[run == 0] += held[k]
                held[k] = (total[-1] + v[-1])
                columns.append(pa.array(total))
            run += run_no
            run_no = int(run[-1])
            columns += [pa.array(np.full(n, part, np.int32)), pa.array(run.astype(np.int64))]
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, out_schema)], schema=out_schema)

    return run


def running_totals(df: DataFrame, by: list[str], order: list[Column], values: dict[str, Column],
                   partitions: int | None = None) -> DataFrame:
    """df with one column per name: the sum of its whole-number value over the rows of
    the group that come before in `order`.

    `order` should tell the rows of a group apart, else ties are placed in any order.
    `by` are columns that compare by equality (no floating point); null is a group.
    A null value counts 0.  Columns of df named like a result give way.  No rows: none."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rest = [c for c in df.columns if c not in by and c not in values]
    counted = [F.coalesce(v.cast("long"), F.lit(0).cast("long")).alias(f"__v_{name}") for name, v in values.items()]
    rows = df.select(*by, *rest, *counted)
    sort = [F.col(c) for c in by] + list(order)
    rows = rows.repartitionByRange(n, *sort).sortWithinPartitions(*sort) if sort else rows
    schema = T.StructType([*rows.schema.fields, *[T.StructField(name, T.LongType()) for name in values],
                           T.StructField(PART, T.IntegerType()), T.StructField(RUN, T.LongType())])
    # equal to the schema that Spark gives the function's result
    out_schema = to_arrow_schema(schema)
    local = stored(rows.mapInArrow(_totalled(len(by), len(values), out_schema), schema))
    return _carried(local, by, list(values)).select(*[c for c in df.columns if c not in values], *values)


def _carried(local: DataFrame, by: list[str], names: list[str]) -> DataFrame:
    """The totals that a group has from earlier partitions, added.  A partition gives
    its first key and its last key with totals: as many rows as there are partitions."""
    spark = local.sparkSession
    runs = local.groupBy(PART, RUN).agg(
        F.min(F.struct(F.lit(0), *by)).alias("key"), F.struct(*[F.sum(f"__v_{n}").alias(n) for n in names]).alias("sums"))
    ends = runs.groupBy(PART).agg(
        F.min_by("key", RUN).alias("first"), F.max_by("key", RUN).alias("last"), F.max_by("sums", RUN).alias("sums"),
        F.max(RUN).alias("runs")).orderBy(PART).collect()
    carry, before, key = [], [0] * len(names), None
    for e in ends:
        got = before if key is not None and e["first"] == key else [0] * len(names)
        if any(got):
            carry.append((e[PART], *map(int, got)))
        sums = [int(s) for s in e["sums"]]
        before = [a + b for a, b in zip(got, sums)] if e["runs"] == 0 else sums
        key = e["last"]
    if not carry:
        return local
    more = spark.createDataFrame(carry, f"{PART} int, " + ", ".join(f"__c_{n} long" for n in names))
    first = F.col(RUN) == 0
    return local.join(F.broadcast(more), PART, "left").withColumns(
        {n: F.col(n) + F.when(first, F.coalesce(F.col(f"__c_{n}"), F.lit(0))).otherwise(0) for n in names})
