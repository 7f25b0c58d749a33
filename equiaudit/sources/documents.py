"""One nested document for each run, written as JSON, read back with its schema, and flattened.

A document holds what a run has: metrics, the fairness report, group sizes,
the plan, which diagnostics ran and which failed, issues and the configuration.
Documents of all runs come from grouped joins over the (small) audit tables; a
document's size follows the run's attributes and groups, not its records.
Lists and maps are in a fixed order, so equal runs give equal text.
"""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (ArrayType, BooleanType, DataType, MapType, NumericType, StringType, StructField,
                               StructType)

from equiaudit import constants as C
from equiaudit.functions import fixed4
from equiaudit.operators.keyed import join_by
from equiaudit.spec import AuditSpec

#: What a document holds, whatever of it a run has.
SCHEMA = (
    "metrics struct<accuracy double, n_train bigint, n_test bigint, model_type string, label_col string, "
    "positive_label string, sensitive_cols array<string>, model_classes array<string>, has_y_score boolean>, "
    "fairness_report map<string, struct<by_group map<string, map<string, double>>, difference map<string, double>, "
    "ratio map<string, double>, flags map<string, boolean>>>, "
    "group_sizes map<string, map<string, bigint>>, "
    "plan array<struct<tool string, attribute string, reason string>>, "
    "diagnostics_run_summary struct<executed array<struct<tool string, attribute string, status string, n_rows bigint>>, "
    "errors array<struct<tool string, attribute string, error string>>>, "
    "issues array<struct<attribute string, metric string, issue_type string, severity string, evidence array<string>>>, "
    "audit_config struct<label_col string, positive_label string, sensitive_cols array<string>, min_group_size int, "
    "fairness_threshold double, test_size double, random_state int, model struct<type string, max_iter int>, "
    "dataset struct<path string, format string, sep string, header boolean, source string>>")
RUN = ["run_id"]


def _listed(df: DataFrame, fields: Sequence[str], name: str) -> DataFrame:
    """(run_id, name): a sorted list of structs for each run."""
    have = [F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in fields]
    return df.select(*RUN, F.struct(*have).alias("x")).groupBy(*RUN).agg(F.array_sort(F.collect_list("x")).alias(name))


def _mapped(df: DataFrame, keys: Sequence[str], value: str, ids: Sequence[str] = ()) -> DataFrame:
    """Maps nested by ``keys``, (run_id, …ids, value), each in the order of its keys."""
    keys = list(keys)
    while keys:
        key = keys.pop()
        pairs = F.collect_list(F.struct(F.col(key).alias("k"), F.col(value).alias("v")))
        ordered = F.array_sort(pairs, lambda a, b: F.when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1).otherwise(0))
        df = df.groupBy(*RUN, *ids, *keys).agg(F.map_from_entries(ordered).alias(value))
    return df


def _report(rates: DataFrame, disparity: DataFrame) -> DataFrame:
    long = rates.unpivot(ids=[*RUN, "attribute", "group"], values=list(C.METRICS), variableColumnName="metric",
                         valueColumnName="by_group").where("`group` is not null")
    parts = _mapped(long, ["metric", "group"], "by_group", ["attribute"])
    for c, source in (("difference", "difference"), ("ratio", "ratio"), ("flags", "flag")):
        one = _mapped(disparity.select(*RUN, "attribute", "metric", F.col(source).alias(c)), ["metric"], c, ["attribute"])
        parts = join_by(parts, one, [*RUN, "attribute"], "left")
    whole = parts.select(*RUN, "attribute", F.struct("by_group", "difference", "ratio", "flags").alias("fairness_report"))
    return _mapped(whole, ["attribute"], "fairness_report")


def _text(x) -> Column:
    return F.lit(None if x is None else str(x)).cast("string")


def _config(spec: AuditSpec) -> Column:
    ds = spec.dataset
    return F.struct(
        _text(spec.label_col).alias("label_col"), _text(spec.positive_label).alias("positive_label"),
        F.array(*[F.lit(c) for c in spec.sensitive_cols]).cast("array<string>").alias("sensitive_cols"),
        F.lit(spec.min_group_size).cast("int").alias("min_group_size"),
        F.lit(spec.fairness_threshold).cast("double").alias("fairness_threshold"),
        F.lit(spec.test_size).cast("double").alias("test_size"), F.lit(spec.random_state).cast("int").alias("random_state"),
        F.struct(_text(spec.model_type).alias("type"), F.lit(spec.max_iter).cast("int").alias("max_iter")).alias("model"),
        F.struct(_text(ds.path).alias("path"), _text(ds.format).alias("format"), _text(ds.sep).alias("sep"),
                 F.lit(ds.header).cast("boolean").alias("header"), _text(ds.source).alias("source")).alias("dataset"))


def run_documents(tables: Mapping[str, DataFrame], spec: AuditSpec) -> DataFrame:
    """(run_id, document) of every run in ``tables``, which hold ``run_id``: any of metrics, group_rates with disparity
    (differences, ratios, flags), group_sizes, plan, diagnostics_status and issues.  What a run lacks is null."""
    schema = StructType.fromDDL(SCHEMA)
    runs, parts = None, {}
    for name in ("metrics", "group_rates", "group_sizes", "plan", "diagnostics_status", "issues"):
        if name in tables:
            own = tables[name].select(*RUN).distinct()
            runs = own if runs is None else runs.union(own)
    if runs is None:
        raise ValueError("no table of a run is given")
    docs = runs.distinct()
    if "metrics" in tables:
        fields = [f.name for f in schema["metrics"].dataType.fields]
        parts["metrics"] = tables["metrics"].select(*RUN, F.struct(*fields).alias("metrics"))
    if "group_rates" in tables and "disparity" in tables:
        parts["fairness_report"] = _report(tables["group_rates"], tables["disparity"])
    if "group_sizes" in tables:
        parts["group_sizes"] = _mapped(tables["group_sizes"].select(
            *RUN, "attribute", "group", F.col("n").alias("group_sizes")), ["attribute", "group"], "group_sizes")
    if "plan" in tables:
        parts["plan"] = _listed(tables["plan"], ("tool", "attribute", "reason"), "plan")
    if "diagnostics_status" in tables:
        status = tables["diagnostics_status"]
        good = _listed(status.where("status != 'error'"), ("tool", "attribute", "status", "n_rows"), "executed")
        bad = _listed(status.where("status = 'error'"), ("tool", "attribute", "error"), "errors")
        both = join_by(join_by(status.select(*RUN).distinct(), good, RUN, "left"), bad, RUN, "left")
        parts["diagnostics_run_summary"] = both.select(*RUN, F.struct("executed", "errors").alias("diagnostics_run_summary"))
    if "issues" in tables:
        parts["issues"] = _listed(tables["issues"], ("attribute", "metric", "issue_type", "severity", "evidence"), "issues")
    for part in parts.values():
        docs = join_by(docs, part, RUN, "left")
    docs = docs.withColumn("audit_config", _config(spec))
    cells = [(F.col(f.name) if f.name in docs.columns else F.lit(None)).cast(f.dataType).alias(f.name)
             for f in schema.fields]
    return docs.select(*RUN, F.struct(*cells).alias("document"))


def write_documents(docs: DataFrame, root: str) -> str:
    """A10: the JSON text of every run below ``root``/documents, one folder per run."""
    path = f"{root.rstrip('/')}/documents"
    (docs.select(F.col("run_id").cast("string").alias("run_id"), F.to_json("document").alias("value"))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").text(path))
    return path


def read_documents(spark: SparkSession, root: str, run_id: str | None = None) -> DataFrame:
    """(run_id, document) as they were written; a run filter reads that run's folder."""
    fields = StructType([StructField("value", StringType()), StructField("run_id", StringType())])
    rows = spark.read.schema(fields).text(f"{root.rstrip('/')}/documents", wholetext=True)
    if run_id is not None:
        rows = rows.where(F.col("run_id") == F.lit(str(run_id)))
    return rows.select("run_id", F.from_json("value", StructType.fromDDL(SCHEMA)).alias("document"))


_CELL = "array<struct<path: string, value: string, number: double>>"


def cells(value: Column, kind: DataType, path: Column) -> Column:
    """The scalars of a column of any type as a list of (path, value, number): fields and map keys are joined to the path
    by dots, list elements by their place.  Doubles are shown with four places, numbers as they are."""
    if isinstance(kind, StructType):
        parts = [cells(value[f.name], f.dataType, F.concat(path, F.lit(f".{f.name}"))) for f in kind.fields]
        return F.when(value.isNotNull(), F.concat(*parts)) if parts else F.lit(None).cast(_CELL)
    if isinstance(kind, MapType):
        return F.flatten(F.transform(F.map_entries(value), lambda e: F.coalesce(cells(
            e["value"], kind.valueType, F.concat(path, F.lit("."), e["key"].cast("string"))), F.array().cast(_CELL))))
    if isinstance(kind, ArrayType):
        return F.flatten(F.transform(value, lambda x, i: F.coalesce(cells(
            x, kind.elementType, F.concat(path, F.lit("."), i.cast("string"))), F.array().cast(_CELL))))
    number = value.cast("double") if isinstance(kind, NumericType) and not isinstance(kind, BooleanType) else F.lit(None)
    text = fixed4(value) if kind.typeName() in ("double", "float") else value.cast("string")
    return F.array(F.struct(path.alias("path"), text.alias("value"), number.cast("double").alias("number"))).cast(_CELL)


def flattened(docs: DataFrame, column: str = "document") -> DataFrame:
    """(run_id, path, value, number) of every scalar in the documents; nulls are left out."""
    kind = docs.schema[column].dataType
    every = [F.coalesce(cells(F.col(column)[f.name], f.dataType, F.lit(f.name)), F.array().cast(_CELL))
             for f in kind.fields]
    return docs.select("run_id", F.inline(F.concat(*every))).where("value is not null")
