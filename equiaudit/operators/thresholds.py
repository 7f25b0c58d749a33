"""H2: threshold sensitivity from the cube's score buckets, and F5: best threshold.

The cube stores, per group, how many cuts each record's score reaches.  The
prediction at cut j is ``bucket >= j``, so all cuts come out of one
conditional aggregation over the (small) cube: no re-scan, no cross join.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equiaudit import constants as C
from equiaudit.operators.cube import BUCKET, N, YT
from equiaudit.operators.rates import disparity, rates_from_counts


def counts_by_cut(cube: DataFrame, cuts: Sequence[float] = C.DEFAULT_CUTS, by: Sequence[str] = ()) -> DataFrame:
    """(…by, attribute, group, threshold, tp, fp, fn, tn) for every cut."""
    pos = F.col(YT) == 1

    def s(cond):
        return F.coalesce(F.sum(F.when(cond, F.col(N))), F.lit(0)).cast("long")

    aggs = [s(pos).alias("__pos"), s(~pos).alias("__neg")]
    for j in range(1, len(cuts) + 1):
        pred = F.col(BUCKET) >= F.lit(j)
        aggs += [s(pos & pred).alias(f"__tp{j}"), s(~pos & pred).alias(f"__fp{j}")]
    wide = cube.where(F.col("group").isNotNull()).groupBy(*by, "attribute", "group").agg(*aggs)
    per_cut = F.array(*[
        F.struct(F.lit(float(t)).alias("threshold"), F.col(f"__tp{j}").alias("tp"), F.col(f"__fp{j}").alias("fp"))
        for j, t in enumerate(cuts, 1)
    ])
    long = wide.select(*by, "attribute", "group", "__pos", "__neg", F.inline(per_cut))
    return long.select(
        *by, "attribute", "group", "threshold", "tp", "fp",
        (F.col("__pos") - F.col("tp")).alias("fn"),
        (F.col("__neg") - F.col("fp")).alias("tn"),
    )


def threshold_sensitivity(cube: DataFrame, cuts: Sequence[float] = C.DEFAULT_CUTS,
                          by: Sequence[str] = ()) -> DataFrame:
    """(…by, attribute, threshold, metric, difference, ratio)."""
    rates = rates_from_counts(counts_by_cut(cube, cuts, by), by, keys=("attribute", "group", "threshold"))
    return disparity(rates, by, keys=("attribute", "threshold"))


def best_threshold(sweep: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """per attribute, the cut with the smallest TPR difference (lowest cut on ties)."""
    wide = sweep.groupBy(*by, "attribute", "threshold").agg(
        F.max(F.when(F.col("metric") == "true_positive_rate", F.col("difference"))).alias("tpr_difference"),
        F.max(F.when(F.col("metric") == "false_positive_rate", F.col("difference"))).alias("fpr_difference"),
    )
    best = wide.groupBy(*by, "attribute").agg(
        F.min_by(F.struct("threshold", "tpr_difference", "fpr_difference"),
                 F.struct("tpr_difference", "threshold")).alias("b")
    )
    return best.select(*by, "attribute", "b.threshold", "b.tpr_difference", "b.fpr_difference")
