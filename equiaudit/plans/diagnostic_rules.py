"""Which diagnostics to run next, as joins against a rule table.

The rules are data (a fixed table of metric -> tool), so the choice is a
broadcast equi-join of the flagged disparities with the rules, a distinct,
and an anti join with what is already done.  All inputs are small audit
tables or distinct-reduced record tables.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from equiaudit import constants as C

# Metric -> diagnostic rules (tool, per-attribute?, needs scores?, reason).
RULES = (
    ("selection_rate", "run_feature_distribution_comparison", True, False,
     "selection_rate disparity is flagged for this attribute."),
    ("selection_rate", "run_proxy_detection", True, False,
     "selection_rate disparity is flagged for this attribute."),
    ("true_positive_rate", "run_threshold_sensitivity", True, True,
     "TPR/FPR disparities are flagged for this attribute."),
    ("false_positive_rate", "run_threshold_sensitivity", True, True,
     "TPR/FPR disparities are flagged for this attribute."),
    ("true_positive_rate", "run_slice_scan", False, False,
     "TPR/FPR disparities are flagged."),
    ("false_positive_rate", "run_slice_scan", False, False,
     "TPR/FPR disparities are flagged."),
)
SIZES_REASON = "group sizes are not available yet."


def rules_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        list(RULES), "metric string, tool string, per_attribute boolean, needs_score boolean, reason string"
    )


def registry_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t,) for t in C.TOOLS], "tool string")


def recommended_tests(flags: DataFrame, has_y_score: bool = True, have_group_sizes: bool = True,
                      by: Sequence[str] = ()) -> DataFrame:
    """(…by, tool, attribute, reason) from flagged disparities; attribute null for slice scan."""
    spark = flags.sparkSession
    rules = rules_table(spark)
    if not has_y_score:
        rules = rules.where(~F.col("needs_score"))
    hit = flags.where(F.col("flag")).select(*by, "attribute", "metric").join(F.broadcast(rules), "metric")
    recs = hit.select(
        *by, "tool",
        F.when(F.col("per_attribute"), F.col("attribute")).alias("attribute"),
        "reason",
    ).groupBy(*by, "tool", "attribute").agg(F.min("reason").alias("reason"))
    if not have_group_sizes:
        sizes = flags.select(*by).distinct() if by else spark.range(1).select()
        recs = recs.unionByName(sizes.select(
            *by, F.lit("check_group_sample_sizes").alias("tool"), F.lit(None).cast("string").alias("attribute"),
            F.lit(SIZES_REASON).alias("reason")))
    return recs


def open_tests(recommended: DataFrame, done: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Recommended minus done.  A recommendation without an attribute is done
    when the tool ran for any attribute; one with an attribute only by that attribute."""
    d = done.select(*[F.col(b).alias(f"__b_{b}") for b in by], F.col("tool").alias("__dt"),
                    F.col("attribute").alias("__da")).distinct()
    cond = F.col("tool") == F.col("__dt")
    for b in by:
        cond = cond & (F.col(b) == F.col(f"__b_{b}"))
    cond = cond & (F.col("attribute").isNull() | (F.col("attribute") == F.col("__da")))
    return recommended.join(d, cond, "left_anti")


def diagnostic_plan(flags: DataFrame, done: DataFrame | None = None, has_y_score: bool = True,
                    have_group_sizes: bool = True, by: Sequence[str] = ()) -> DataFrame:
    """The diagnostics still worth running."""
    recs = recommended_tests(flags, has_y_score, have_group_sizes, by)
    return open_tests(recs, done, by) if done is not None else recs


def plan_problems(plan: DataFrame) -> DataFrame:
    """H14 + D5: (tool, attribute, problem, n) for unknown tools and repeated (tool, attribute) requests."""
    spark = plan.sparkSession
    counts = plan.groupBy("tool", "attribute").agg(F.count(F.lit(1)).alias("n"))
    unknown = counts.join(F.broadcast(registry_table(spark)), "tool", "left_anti").withColumn(
        "problem", F.lit("unknown_tool"))
    dupes = counts.where(F.col("n") > 1).withColumn("problem", F.lit("duplicate"))
    return unknown.unionByName(dupes).select("tool", "attribute", "problem", "n")
