"""Audit tables partitioned by ``run_id``, the run catalogue, run summary and evidence.

Every audit artefact is a table with a ``run_id`` column, written with
``partitionBy("run_id")`` and dynamic partition overwrite, so rewriting one
run leaves the others alone and reading one run prunes to its folder.
"latest" is ``max(run_id)``, never a mirrored copy.
"""

from __future__ import annotations

import time
import uuid
from typing import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from equiaudit import constants as C
from equiaudit.functions import fixed4
from equiaudit.operators.cube import accuracy_from_cube


def write_audit_table(df: DataFrame, root: str, name: str) -> str:
    """Write one audit table under ``root/name``, one folder per run."""
    if "run_id" not in df.columns:
        raise ValueError("audit tables need a run_id column")
    path = f"{root.rstrip('/')}/{name}"
    (df.withColumn("run_id", F.col("run_id").cast("string")).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path))
    return path


def read_audit_table(spark: SparkSession, root: str, name: str, run_id: str | None = None) -> DataFrame:
    """Read an audit table; a run filter prunes to that run's folder.  Run ids stay text ("007").

    Of tables that a :class:`RunWriter` wrote, only committed runs are seen, each as of its last commit."""
    path = f"{root.rstrip('/')}/{name}"
    found = spark.read.parquet(path).schema
    as_text = StructType([StructField(f.name, StringType()) if f.name in ("run_id", _ATTEMPT) else f
                          for f in found.fields])
    df = spark.read.schema(as_text).parquet(path)
    if run_id is not None:
        df = df.where(F.col("run_id") == F.lit(str(run_id)))
    if _ATTEMPT not in df.columns:
        return df
    last = committed_runs(spark, root).select("run_id", _ATTEMPT)  # one row per run
    return df.join(last, ["run_id", _ATTEMPT], "left_semi").drop(_ATTEMPT)


_ATTEMPT, _COMMITS = "attempt", "commits"


class RunWriter:
    """The tables of one run, seen by readers all at once or not at all.

    Each attempt writes its tables into folders of its own; ``commit`` then writes one record that names the attempt
    and its tables, after which readers see them.  A run that is interrupted is never listed, and one that is written
    again is seen as it was until the new attempt is committed."""

    def __init__(self, spark: SparkSession, root: str, run_id: str):
        self.spark, self.root, self.run_id = spark, root.rstrip("/"), str(run_id)
        self.attempt = f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"  # attempts follow each other by name
        self.tables: list[str] = []

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Write a table of the run; returns it as it was written, before the commit too."""
        path = f"{self.root}/{name}"
        own = df.drop("run_id")
        own.withColumns({"run_id": F.lit(self.run_id), _ATTEMPT: F.lit(self.attempt)}).write.mode("append").partitionBy(
            "run_id", _ATTEMPT).parquet(path)
        self.tables.append(name)
        fields = StructType([*own.schema.fields, StructField("run_id", StringType()), StructField(_ATTEMPT, StringType())])
        return self.spark.read.schema(fields).parquet(path).where(
            (F.col("run_id") == self.run_id) & (F.col(_ATTEMPT) == self.attempt)).drop(_ATTEMPT)

    def commit(self) -> None:
        row = [(self.run_id, self.attempt, sorted(set(self.tables)))]
        self.spark.createDataFrame(row, f"run_id string, {_ATTEMPT} string, tables array<string>").coalesce(1).write.mode(
            "append").parquet(f"{self.root}/{_COMMITS}")


def committed_runs(spark: SparkSession, root: str) -> DataFrame:
    """(run_id, attempt, tables): the last commit of every run."""
    schema = f"run_id string, {_ATTEMPT} string, tables array<string>"
    try:
        rows = spark.read.schema(schema).parquet(f"{root.rstrip('/')}/{_COMMITS}")
    except AnalysisException:  # no run is committed yet
        return spark.createDataFrame([], schema)
    return rows.groupBy("run_id").agg(F.max(F.struct(_ATTEMPT, "tables")).alias("c")).select("run_id", "c.*")


def stored_catalogue(spark: SparkSession, root: str, names: Sequence[str]) -> DataFrame:
    """A12 from the commits: (run_id, has_<name>...), newest first; no table of a run is read."""
    return committed_runs(spark, root).select(
        "run_id", *[F.array_contains("tables", n).alias(f"has_{n}") for n in names]).orderBy(F.desc("run_id"))




def write_rates_csv(rates: DataFrame, path: str) -> str:
    """Group rates as CSV with a header (small table; one file per run folder)."""
    rates.write.mode("overwrite").option("header", True).csv(path)
    return path


def run_metrics(scored: DataFrame, *, label_col: str, positive_label: str, sensitive_cols: Sequence[str],
                model_type: str | None = None, n_train: DataFrame | None = None,
                model_classes: Sequence[str] = (),
                cube: DataFrame | None = None) -> DataFrame:
    """One metrics row per run (accuracy, test size, spec fields).

    With the run's confusion cube (keyed by run_id) the counts come from it, so the
    scored rows are not read a second time."""
    has_score = "y_score" in scored.columns
    if cube is not None:
        m = accuracy_from_cube(cube, sensitive_cols[0], ["run_id"]).withColumnRenamed("n", "n_test")
    else:
        hit = F.coalesce(F.col("y_true").cast("string") == F.col("y_pred").cast("string"), F.lit(False)).cast("int")
        m = scored.groupBy("run_id").agg(F.avg(hit).alias("accuracy"), F.count(F.lit(1)).alias("n_test"))
    if n_train is not None:
        m = m.join(n_train, "run_id", "left")
    else:
        m = m.withColumn("n_train", F.lit(None).cast("long"))
    return m.select(
        "run_id", "accuracy", "n_train", "n_test",
        F.lit(model_type).cast("string").alias("model_type"),
        F.lit(label_col).alias("label_col"),
        F.lit(str(positive_label)).alias("positive_label"),
        F.array(*[F.lit(c) for c in sensitive_cols]).alias("sensitive_cols"),
        F.array(*[F.lit(c) for c in model_classes]).cast("array<string>").alias("model_classes"),
        F.lit(has_score).alias("has_y_score"),
    )


def run_catalogue(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(run_id, has_<table>...) over every run present in any audit table."""
    names = list(tables)
    present = None
    for name, df in tables.items():
        part = df.select("run_id").distinct().withColumn("table", F.lit(name))
        present = part if present is None else present.unionByName(part)
    return present.groupBy("run_id").agg(
        *[F.bool_or(F.col("table") == F.lit(n)).alias(f"has_{n}") for n in names]
    ).orderBy(F.desc("run_id"))  # newest first (one row per run)


def run_summary(run_id: str, metrics: DataFrame, flags: DataFrame, issues: DataFrame) -> DataFrame:
    """One row for ``run_id``: metrics plus counts of flagged disparities and issues (left joins)."""
    rid = F.lit(str(run_id))
    m = metrics.where(F.col("run_id") == rid).select("run_id", "accuracy", "n_test")
    f = flags.where(F.col("run_id") == rid).groupBy("run_id").agg(
        F.sum(F.col("flag").cast("long")).alias("n_flagged"))
    i = issues.where(F.col("run_id") == rid).groupBy("run_id").agg(F.count(F.lit(1)).alias("n_issues"))
    return m.join(f, "run_id", "left").join(i, "run_id", "left").select(
        "run_id", "accuracy", "n_test",
        F.coalesce("n_flagged", F.lit(0)).cast("long").alias("n_flagged"),
        F.coalesce("n_issues", F.lit(0)).cast("long").alias("n_issues"),
    )


def latest_run(metrics: DataFrame) -> str | None:
    return metrics.agg(F.max("run_id").alias("r")).first()["r"]


def evidence_table(metrics: DataFrame, disparity: DataFrame, sizes: DataFrame,
                   catalogue: DataFrame, required: Sequence[str], rates: DataFrame | None = None) -> DataFrame:
    """(run_id, path, value, number) for every run: value as text with four places, number as it is.  Holds
    metrics, differences, ratios, group sizes, with ``rates`` also the rates by group, and ``missing`` rows for
    required tables that a run lacks (anti join of required names with the catalogue)."""
    def rows(df: DataFrame, path: Column, x: str, text: Column) -> DataFrame:
        return df.select("run_id", path.alias("path"), text.alias("value"), F.col(x).cast("double").alias("number"))

    dot = F.lit(".")
    parts = [
        rows(metrics, F.lit("metrics.accuracy"), "accuracy", fixed4("accuracy")),
        rows(metrics, F.lit("metrics.n_test"), "n_test", F.col("n_test").cast("string")),
        rows(disparity, F.concat(F.lit("fairness_report."), "attribute", F.lit(".difference."), "metric"), "difference",
             fixed4("difference")),
        rows(disparity, F.concat(F.lit("fairness_report."), "attribute", F.lit(".ratio."), "metric"), "ratio",
             fixed4("ratio")),
        rows(sizes, F.concat(F.lit("group_sizes."), "attribute", dot, "group"), "n", F.col("n").cast("string")),
    ]
    if rates is not None:
        long = rates.unpivot(ids=["run_id", "attribute", "group"], values=list(C.METRICS),
                             variableColumnName="metric", valueColumnName="x")
        parts.append(rows(long, F.concat(F.lit("fairness_report."), "attribute", F.lit(".by_group."), "metric", dot, "group"),
                          "x", fixed4("x")))
    have = catalogue.unpivot(ids=["run_id"], values=[c for c in catalogue.columns if c.startswith("has_")],
                             variableColumnName="flag", valueColumnName="present")
    have = have.where("present").select("run_id", F.expr("substring(flag, 5)").alias("name"))
    wanted = catalogue.select("run_id", F.explode(F.array(*[F.lit(r) for r in required])).alias("name"))
    missing = wanted.join(have, ["run_id", "name"], "left_anti").select(
        "run_id", F.lit("missing").alias("path"), F.col("name").alias("value"), F.lit(None).cast("double").alias("number"))
    for part in parts:
        missing = missing.unionByName(part)
    return missing


def _by_metric(c: str) -> Column:
    """A map from metric to ``c`` in the report's order, whatever order the shuffle brings."""
    found = F.map_from_entries(F.collect_list(F.struct("metric", c)))
    order = F.array(*[F.lit(m) for m in C.METRICS])
    return F.transform(F.array(found), lambda m: F.map_from_entries(F.transform(
        F.filter(order, lambda k: F.map_contains_key(m, k)), lambda k: F.struct(k, F.element_at(m, k)))))[0]


def report_json(rates: DataFrame, flags: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """A10: nested export per (…by, attribute) as JSON text: by_group, difference, ratio, flags."""
    long = rates.unpivot(ids=[*by, "attribute", "group"], values=list(C.METRICS), variableColumnName="metric",
                         valueColumnName="value")
    by_group = long.groupBy(*by, "attribute", "metric").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("group", "value")))).alias("g")
    ).groupBy(*by, "attribute").agg(_by_metric("g").alias("by_group"))
    per = flags.groupBy(*by, "attribute").agg(
        _by_metric("difference").alias("difference"), _by_metric("ratio").alias("ratio"), _by_metric("flag").alias("flags"))
    j = by_group.join(per, [*by, "attribute"])
    return j.select(*by, "attribute", F.to_json(F.struct("by_group", "difference", "ratio", "flags")).alias("json"))
