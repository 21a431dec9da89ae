"""Recorded trials, results, run logs and training logs."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CURVE = "array<struct<epoch:int,train_loss:double,val_loss:double>>"
TRIAL_SCHEMA = (
    "trial_number long, value double, params map<string,double>, state string, datetime_start string, "
    "datetime_complete string, duration_seconds double, "
    "architecture struct<d_model:int,n_layers:int,n_heads:int,d_ff:int,param_count:long>, "
    f"user_attrs struct<arch_idx:int,learning_curve:{CURVE},val_accuracy:double,train_accuracy:double>")
BEST_SCHEMA = (
    "experiment string, budget string, best_params map<string,double>, best_value double, "
    "n_trials_completed int, n_trials_pruned int, timestamp string, study_name string")
RESULT_SCHEMA = "experiment string, budget string, status string, val_loss double, duration_seconds double"

# fixed column order of the run log
LOG_COLUMNS = (
    "timestamp", "experiment", "phase", "budget", "task", "horizon", "timescale", "script_path", "run_type",
    "status", "duration_seconds", "val_loss", "test_accuracy", "hyperparameters", "error_message",
    "thermal_max_temp", "data_md5", "d_model", "n_layers", "n_heads", "d_ff", "param_count")
_LOG_NUMBERS = {"duration_seconds": "double", "val_loss": "double", "test_accuracy": "double",
                "thermal_max_temp": "double", "horizon": "int", "d_model": "int", "n_layers": "int",
                "n_heads": "int", "d_ff": "int", "param_count": "long"}
LOG_SCHEMA = ", ".join(f"{c} {_LOG_NUMBERS.get(c, 'string')}" for c in LOG_COLUMNS)

# fixed text formats of studies and training logs
STUDY = r"phase6a_(\d+[MB])_h(\d+)_"
EXPERIMENT_START = r"\[(\d+)/12\] Starting: hpo_(\w+)_threshold_1pct\.py"
EXPERIMENT_END = r"\[(\d+)/12\] (PASSED|FAILED): hpo_(\w+)_threshold_1pct\.py"
STAMP = r"\[I (\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2},\d+)\] "
TRIAL_START = (STAMP + r"Trial (\d+): arch_idx=(\d+), d_model=(\d+), n_layers=(\d+),(?: n_heads=(\d+),)? "
               r"params=([\d,]+), lr=([\d.e-]+), epochs=(\d+), batch_size=(\d+)")
TRIAL_FINISH = STAMP + r"Trial (\d+) finished with value: ([\d.]+) and parameters: \{([^}]+)\}"


def _valid_json(spark: SparkSession, path: str, schema: str, recursive: bool = False,
                multi_line: bool = False, with_path: bool = False) -> DataFrame:
    """Records of JSON files; unreadable ones are skipped."""
    reader = spark.read.schema(schema + ", _bad string").option("mode", "PERMISSIVE") \
        .option("columnNameOfCorruptRecord", "_bad").option("multiLine", multi_line)
    if recursive:
        reader = reader.option("recursiveFileLookup", True)
    df = reader.json(path)
    if with_path:
        df = df.withColumn("_path", F.col("_metadata.file_path"))
    return df.filter("_bad is null").drop("_bad")


def study_parts(name: Column) -> tuple[Column, Column]:
    """Budget and horizon of a study name, ``unknown`` when it has another form."""
    budget, horizon = F.regexp_extract(name, "^" + STUDY, 1), F.regexp_extract(name, "^" + STUDY, 2)
    return (F.when(budget == "", "unknown").otherwise(budget),
            F.when(horizon == "", "unknown").otherwise(F.concat(F.lit("h"), horizon)))


def read_trials(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """Flat trial rows from ``<study>/trials/*.json``; the study is a folder name.

    A file holds one record, or one per line without ``multi_line`` (which lets
    large files be split)."""
    raw = _valid_json(spark, path, TRIAL_SCHEMA, recursive=True, multi_line=multi_line, with_path=True)
    study = F.element_at(F.split("_path", "/"), -3)
    budget, horizon = study_parts(study)
    ua = F.col("user_attrs")
    curve = F.coalesce(ua["learning_curve"], F.array().cast(CURVE))
    return raw.select(
        study.alias("study"), budget.alias("budget"), horizon.alias("horizon"),
        F.coalesce("trial_number", F.lit(0)).alias("trial_number"),
        F.coalesce("value", F.lit(100.0)).alias("val_loss"), "state", "duration_seconds",
        F.col("architecture.d_model"), F.col("architecture.n_layers"), F.col("architecture.n_heads"),
        F.col("architecture.d_ff"), F.col("architecture.param_count"),
        F.coalesce(ua["arch_idx"], F.try_element_at("params", F.lit("arch_idx")).cast("int")).alias("arch_idx"),
        F.coalesce(F.try_element_at("params", F.lit("epochs")), F.lit(100.0)).cast("int").alias("epochs_config"),
        "params", curve.alias("learning_curve"), ua["val_accuracy"].alias("val_accuracy"))


def read_best_results(spark: SparkSession, path: str, experiment: str | None = None) -> DataFrame:
    df = _valid_json(spark, path, BEST_SCHEMA).fillna({"best_value": 0.0, "budget": "", "experiment": ""})
    return df.filter(F.col("experiment") == experiment) if experiment is not None else df


def read_training_results(spark: SparkSession, path: str, schema: str = RESULT_SCHEMA) -> DataFrame:
    return _valid_json(spark, path, schema, recursive=True)


def align_log(rows: DataFrame) -> DataFrame:
    """The run-log columns in their order; missing ones are null, and a map of
    hyperparameters becomes JSON text."""
    kinds = dict(rows.dtypes)
    out = []
    for c in LOG_COLUMNS:
        if c not in kinds:
            col = F.lit(None)
        elif kinds[c].startswith(("map", "struct")):
            col = F.to_json(c)
        else:
            col = F.col(c)
        out.append(col.cast(_LOG_NUMBERS.get(c, "string")).alias(c))
    return rows.select(*out)


COMMIT = "batch string, folder string"


def committed(spark: SparkSession, path: str) -> dict[str, str]:
    """The folder of each committed batch: one small record a batch."""
    try:
        records = spark.read.schema(COMMIT).json(f"{path}/commits")
    except AnalysisException as missing:
        if "PATH_NOT_FOUND" not in str(missing):
            raise
        return {}
    return {r.batch: r.folder for r in records.collect()}


def append_log(rows: DataFrame, path: str, batch: str | None = None) -> None:
    """Appends a batch once, however often it is tried.  An attempt writes to a folder of
    its own; the batch counts when its record, which names that folder, is written.  A
    batch that has a record is left alone, and an attempt without one is never read."""
    spark, batch = rows.sparkSession, batch or uuid.uuid4().hex
    if batch in committed(spark, path):
        return
    folder = f"data/{uuid.uuid4().hex}"
    align_log(rows).write.option("header", True).option("escape", '"').csv(f"{path}/{folder}")
    # one place for the record of a batch: of two attempts at once the later one holds
    place = hashlib.sha256(batch.encode()).hexdigest()
    spark.createDataFrame([(batch, folder)], COMMIT).coalesce(1).write.mode("overwrite").json(f"{path}/commits/record={place}")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all committed batches."""
    folders = [f"{path}/{f}" for f in sorted(committed(spark, path).values())]
    df = spark.read.schema(LOG_SCHEMA).option("header", True).option("escape", '"').csv(folders) if folders \
        else spark.createDataFrame([], LOG_SCHEMA)
    return df.withColumn("hyperparameters", F.from_json("hyperparameters", "map<string,double>"))


def log_params(text: Column) -> Column:
    """``'key': value`` pairs of a finish line as a map."""
    keys = F.regexp_extract_all(text, F.lit(r"'(\w+)': [\d.e-]+"), F.lit(1))
    values = F.regexp_extract_all(text, F.lit(r"'\w+': ([\d.e-]+)"), F.lit(1))
    return F.map_from_arrays(keys, F.transform(values, lambda v: v.cast("double")))


def read_training_log(spark: SparkSession, path: str) -> DataFrame:
    """Lines of training logs in file order: file, block, line and text.

    A file may be read in several blocks.  Lines are numbered inside a block,
    and blocks are ordered by their start, so no file is held by one task."""
    df = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("line"), F.col("value").alias("text"))
    return df


def parse_training_log(lines: DataFrame) -> DataFrame:
    """Finished trials with the experiment they belong to and their start line.

    The experiment is the latest start line above: found inside the block, or
    carried over from the last block that has one."""
    def get(pattern, i):
        x = F.regexp_extract("text", pattern, i)
        return F.when(x != "", x)

    d = lines.select("file", "block", "line", "text", get(EXPERIMENT_START, 2).alias("_exp"),
                     get(TRIAL_START, 2).cast("long").alias("_started"),
                     get(TRIAL_FINISH, 2).cast("long").alias("_finished"))
    here = F.struct("block", "line")
    ends = d.groupBy("file", "block").agg(F.max_by("_exp", F.when(F.col("_exp").isNotNull(), F.col("line"))).alias("_e"),
                                          F.max(F.when(F.col("_exp").isNotNull(), F.col("line"))).alias("_l"))
    carry = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select("file", "block", F.last(F.when(F.col("_e").isNotNull(), F.struct(
        F.col("_e").alias("e"), F.col("block").alias("b"), F.col("_l").alias("l"))), ignorenulls=True).over(carry).alias("_c"))
    inside = Window.partitionBy("file", "block").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    own = F.last(F.when(F.col("_exp").isNotNull(), F.struct(
        F.col("_exp").alias("e"), F.col("block").alias("b"), F.col("line").alias("l"))), ignorenulls=True).over(inside)
    d = d.withColumn("_own", own).join(ends, ["file", "block"]).withColumn("_x", F.coalesce("_own", "_c"))
    d = d.filter(F.col("_x").isNotNull()).select("*", F.col("_x.e").alias("experiment"), F.struct(
        F.col("_x.b"), F.col("_x.l")).alias("_run"), here.alias("_at"))
    starts = d.filter(F.col("_started").isNotNull()).select(
        "file", "_run", F.col("_started").alias("trial_number"), F.col("_at").alias("_start_at"),
        get(TRIAL_START, 1).alias("start_time"), get(TRIAL_START, 3).cast("int").alias("arch_idx"),
        get(TRIAL_START, 4).cast("int").alias("d_model"), get(TRIAL_START, 5).cast("int").alias("n_layers"),
        get(TRIAL_START, 6).cast("int").alias("n_heads"),
        F.regexp_replace(get(TRIAL_START, 7), ",", "").cast("long").alias("param_count"),
        get(TRIAL_START, 8).cast("double").alias("lr"), get(TRIAL_START, 9).cast("int").alias("epochs"),
        get(TRIAL_START, 10).cast("int").alias("batch_size"))
    # the latest start of a trial inside its experiment run
    starts = starts.groupBy("file", "_run", "trial_number").agg(F.max_by(F.struct(
        "start_time", "arch_idx", "d_model", "n_layers", "n_heads", "param_count", "lr", "epochs", "batch_size"),
        "_start_at").alias("s"))
    done = d.filter(F.col("_finished").isNotNull()).select(
        "file", "_run", "experiment", F.col("_finished").alias("trial_number"), get(TRIAL_FINISH, 1).alias("end_time"),
        get(TRIAL_FINISH, 3).cast("double").alias("val_loss"), log_params(get(TRIAL_FINISH, 4)).alias("params"))
    out = done.join(starts, ["file", "_run", "trial_number"], "left")
    arch = F.coalesce("s.arch_idx", F.try_element_at("params", F.lit("arch_idx")).cast("int"))
    return out.select("experiment", "trial_number", "s.start_time", "end_time", "val_loss", arch.alias("arch_idx"),
                      "s.d_model", "s.n_layers", "s.n_heads", "s.param_count", "s.lr", "s.epochs", "s.batch_size", "params")


def experiment_status(lines: DataFrame) -> DataFrame:
    """Final status line per experiment."""
    end = F.regexp_extract("text", EXPERIMENT_END, 3)
    return lines.select("file", "block", "line", end.alias("experiment"),
                        F.regexp_extract("text", EXPERIMENT_END, 2).alias("status")).filter("experiment <> ''").groupBy(
        "experiment").agg(F.max_by("status", F.struct("file", "block", "line")).alias("status"))


def patch_params(trials: DataFrame, metrics: DataFrame, columns: list[str]) -> DataFrame:
    """Fill empty parameter maps from the metrics table by trial number."""
    built = F.create_map(*[x for c in columns for x in (F.lit(c), F.col(f"m.{c}").cast("double"))])
    j = trials.alias("t").join(metrics.alias("m"), F.col("t.trial_number") == F.col("m.trial_number"), "left")
    empty = F.col("t.params").isNull() | (F.size("t.params") == 0)
    fixed = F.when(empty & F.col("m.trial_number").isNotNull(), built).otherwise(F.col("t.params"))
    return j.select(*[fixed.alias("params") if c == "params" else F.col(f"t.{c}") for c in trials.columns])
