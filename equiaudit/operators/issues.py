"""Issue records from the disparity table, and checks on issue records.

Severity is always recomputed from the report's difference (never taken from
an issue record).  Every join here is against the disparity table, which has
attributes x 3 rows per run: a bound fixed by the audit spec, so it is
broadcast.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equiaudit import constants as C
from equiaudit.functions import evidence_path, issue_type, severity


def extremes(rates: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per (attribute, metric): the highest and lowest group and their rates (ties by group name)."""
    long = rates.unpivot(ids=[*by, "attribute", "group"], values=list(C.METRICS), variableColumnName="metric",
                         valueColumnName="value")
    return long.groupBy(*by, "attribute", "metric").agg(
        F.min_by(F.struct("group", "value"), F.struct(-F.col("value"), F.col("group"))).alias("hi"),
        F.min_by(F.struct("group", "value"), F.struct(F.col("value"), F.col("group"))).alias("lo"),
    )


def issue_table(flags: DataFrame, rates: DataFrame, threshold: float = C.DEFAULT_FAIRNESS_THRESHOLD,
                by: Sequence[str] = ()) -> DataFrame:
    """One issue per flagged (attribute, metric) with type, severity and evidence lines:
    the difference path, then the by-group paths of the highest and lowest group."""
    ex = extremes(rates, by)
    flagged = flags.where(F.col("flag")).join(F.broadcast(ex), [*by, "attribute", "metric"])
    evidence = F.array(
        evidence_path("attribute", "difference", "metric", "difference"),
        evidence_path("attribute", "by_group", "metric", "hi.value", group="hi.group"),
        evidence_path("attribute", "by_group", "metric", "lo.value", group="lo.group"),
    )
    return flagged.select(
        *by, "attribute", "metric",
        issue_type("metric").alias("issue_type"),
        severity("difference", threshold).alias("severity"),
        evidence.alias("evidence"),
    )


def issues_text(issues: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Issue table with the evidence lines joined by new lines (dashboard form)."""
    return issues.select(*by, "attribute", "metric", "issue_type", "severity",
                         F.concat_ws("\n", "evidence").alias("evidence"))


def issues_flat(issues: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per evidence line."""
    return issues.select(*by, "attribute", "metric", F.posexplode("evidence").alias("line_no", "evidence_line"))


def issue_evidence(disp: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The difference evidence line of every (attribute, metric)."""
    return disp.select(*by, "attribute", "metric",
                       evidence_path("attribute", "difference", "metric", "difference").alias("evidence"))


def recompute_severity(records: DataFrame, disp: DataFrame, threshold: float = C.DEFAULT_FAIRNESS_THRESHOLD,
                       by: Sequence[str] = ()) -> DataFrame:
    """D3 + H9: left join reported issues to the report's difference; severity from that value,
    ``unknown`` when the (attribute, metric) is not in the report."""
    d = disp.select(*by, "attribute", "metric", "difference")
    j = records.join(F.broadcast(d), [*by, "attribute", "metric"], "left")
    return j.withColumn("severity", severity("difference", threshold))


def _valid_metrics_text() -> str:
    return "[" + ", ".join(f"'{m}'" for m in sorted(C.METRICS)) + "]"


def _valid_severities_text() -> str:
    return "[" + ", ".join(f"'{s}'" for s in sorted(C.SEVERITY_LEVELS)) + "]"


def issue_record_errors(records: DataFrame, id_col: str = "record_id") -> DataFrame:
    """One (record_id, error) row per broken rule of an issue record
    (attribute/metric/issue_type/severity columns, evidence as array<string>)."""
    i = F.col(id_col).cast("string")

    def msg(text: str) -> Column:
        return F.concat(F.lit("detected_issues["), i, F.lit(f"].{text}"))

    checks = [
        (F.col("attribute").isNull(), msg("attribute must be a string")),
        (~F.coalesce(F.col("metric").isin(list(C.METRICS)), F.lit(False)),
         msg(f"metric must be one of {_valid_metrics_text()}")),
        (~F.coalesce(F.col("severity").isin(list(C.SEVERITY_LEVELS)), F.lit(False)),
         msg(f"severity must be one of {_valid_severities_text()}")),
        (F.col("issue_type").isNull(), msg("issue_type must be a string")),
        (F.col("evidence").isNull(), msg("evidence must be a list")),
        (F.coalesce(F.exists("evidence", lambda x: x.isNull()), F.lit(False)),
         msg("evidence must hold no nulls")),
    ]
    errs = F.filter(F.array(*[F.when(c, m) for c, m in checks]), lambda x: x.isNotNull())
    return records.select(F.col(id_col), F.explode(errs).alias("error"))
