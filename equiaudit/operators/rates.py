"""Per-group rates, disparities, flags and findings, all derived from the cube."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from equiaudit import constants as C
from equiaudit.operators.cube import confusion_counts


def _ratio(num, den, undefined: str):
    """num / den; when den == 0 the result is 0.0 (report convention) or null (slice convention)."""
    fallback = F.lit(0.0) if undefined == "zero" else F.lit(None).cast("double")
    return F.when(den > 0, num.cast("double") / den.cast("double")).otherwise(fallback)


def rates_from_counts(counts: DataFrame, by: Sequence[str] = (), undefined: str = "zero",
                      keys: Sequence[str] = ("attribute", "group")) -> DataFrame:
    """Selection rate, TPR, FPR from tp/fp/fn/tn columns."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    n = tp + fp + fn + tn
    return counts.select(
        *by, *keys,
        n.cast("long").alias("n"),
        _ratio(tp + fp, n, undefined).alias("selection_rate"),
        _ratio(tp, tp + fn, undefined).alias("true_positive_rate"),
        _ratio(fp, fp + tn, undefined).alias("false_positive_rate"),
    )


def group_rates(cube: DataFrame, by: Sequence[str] = (), cut_index: int | None = None) -> DataFrame:
    """(attribute, group, n, selection_rate, true_positive_rate, false_positive_rate)."""
    return rates_from_counts(confusion_counts(cube, by, cut_index), by)


def rates_long(rates: DataFrame, by: Sequence[str] = (), keys: Sequence[str] = ("attribute", "group")) -> DataFrame:
    """Rates as (…, metric, value) rows."""
    return rates.unpivot(ids=[*by, *keys], values=list(C.METRICS), variableColumnName="metric",
                         valueColumnName="value")


def disparity(rates: DataFrame, by: Sequence[str] = (), keys: Sequence[str] = ("attribute",)) -> DataFrame:
    """difference = max - min over groups, ratio = min / max (null when max is 0)."""
    long = rates_long(rates, by, [*keys, "group"])
    return long.groupBy(*by, *keys, "metric").agg(
        (F.max("value") - F.min("value")).alias("difference"),
        F.when(F.max("value") > 0, F.min("value") / F.max("value")).otherwise(F.lit(None).cast("double"))
        .alias("ratio"),
    )


def flag(difference, threshold: float):
    """H7: strictly above the threshold; null/NaN -> false."""
    d = F.when(F.isnan(difference), F.lit(None)).otherwise(difference)
    return F.coalesce(d > F.lit(float(threshold)), F.lit(False))


def disparity_flags(disp: DataFrame, threshold: float = C.DEFAULT_FAIRNESS_THRESHOLD) -> DataFrame:
    return disp.withColumn("flag", flag(F.col("difference"), threshold))


def fairness_report(rates: DataFrame, threshold: float = C.DEFAULT_FAIRNESS_THRESHOLD,
                    by: Sequence[str] = ()) -> DataFrame:
    """H1 in long form: one row per (attribute, group, metric) with the group's rate
    next to the attribute's difference, ratio and flag.

    The spread over groups is a window over the (small) rate table partitioned by
    (attribute, metric): no second pass over the cube and no join.
    """
    long = rates_long(rates, by)
    w = Window.partitionBy(*by, "attribute", "metric")
    hi, lo = F.max("value").over(w), F.min("value").over(w)
    diff = hi - lo
    return long.select(
        *by, "attribute", "group", "metric", "value",
        diff.alias("difference"),
        F.when(hi > 0, lo / hi).otherwise(F.lit(None).cast("double")).alias("ratio"),
        flag(diff, threshold).alias("flag"),
    )


def _position(values: Sequence[str], c: str):
    """0-based position of ``c`` in a fixed list (attribute / metric display order)."""
    return F.array_position(F.array(*[F.lit(v) for v in values]), F.col(c)).cast("int") - 1


def findings(flags: DataFrame, attrs: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """H8: flagged (attribute, metric) rows in attribute order, then metric order."""
    return flags.where(F.col("flag")).select(
        *by, "attribute", "metric", "difference",
        _position(attrs, "attribute").alias("attribute_pos"),
        _position(C.METRICS, "metric").alias("metric_pos"),
    )


def rates_pivot(report: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Groups of a long report with the three metrics as columns (explicit pivot values)."""
    return (
        report.groupBy(*by, "attribute", "group")
        .pivot("metric", list(C.METRICS))
        .agg(F.first("value"))
    )


def small_groups(sizes: DataFrame, min_group_size: int = C.DEFAULT_MIN_GROUP_SIZE) -> DataFrame:
    """Group sizes with an ``is_small`` mark (n < min_group_size)."""
    return sizes.withColumn("is_small", F.col("n") < F.lit(int(min_group_size)))


def largest_groups(sizes: DataFrame, k: int = 2, by: Sequence[str] = ()) -> DataFrame:
    """the ``k`` largest groups per attribute; ties by group name.

    The window runs over the group-size table (one row per group), never over records.
    """
    w = Window.partitionBy(*by, "attribute").orderBy(F.desc("n"), F.asc("group"))
    return (
        sizes.withColumn("rank", F.row_number().over(w))
        .where(F.col("rank") <= k)
        .select(*by, "attribute", "rank", "group", "n")
    )


def accuracy(scored: DataFrame, y_true: str = "y_true", y_pred: str = "y_pred", by: Sequence[str] = ()) -> DataFrame:
    """E5: share of rows where the prediction equals the truth (compared as text)."""
    hit = F.coalesce(F.col(y_true).cast("string") == F.col(y_pred).cast("string"), F.lit(False)).cast("int")
    return scored.groupBy(*by).agg(
        F.avg(hit).alias("accuracy"),
        F.count(F.lit(1)).alias("n"),
    )
