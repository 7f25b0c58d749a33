"""The confusion cube: the one large aggregation of an audit.

Every per-group table (sizes, confusion counts, rates, disparities, threshold
sweeps) is derived from a small long table

    (*by, attribute, group, yt, yp, bucket, n)

built with partial (map-side) aggregation, so the shuffle carries at most one
row per key combination and map task, never one row per scored record.
``bucket`` is the number of score cuts at or below the score, so a sweep over
cuts is a sum over buckets rather than one pass per cut.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equiaudit import constants as C
from equiaudit.functions import cut_bucket, positive_flag

YT, YP, BUCKET, OK, N = "yt", "yp", "bucket", "ok", "n"


def confusion_cube(
    scored: DataFrame,
    attrs: Sequence[str],
    positive_label: str,
    *,
    y_true: str = "y_true",
    y_pred: str | None = "y_pred",
    score: str | None = None,
    cuts: Sequence[float] | None = None,
    by: Sequence[str] = (),
    strategy: str = "joint",
    joint_limit: int = 100_000,
) -> DataFrame:
    """Long confusion cube over every attribute in ``attrs``.

    strategy="joint": aggregate on all attributes together, then unpivot the
    small result and re-aggregate (best when the product of attribute
    cardinalities is modest, the usual case).
    strategy="sets": unpivot first (an Expand of len(attrs) rows per record)
    and aggregate once; bounded output for high-cardinality attributes.
    strategy="auto": one sketch pass over the attribute columns (len(attrs)
    numbers to the driver); "joint" when the product of their cardinalities
    stays under ``joint_limit``, else "sets".
    Null attribute values stay null here; callers decide how to show them.
    """
    if not attrs:
        raise ValueError("at least one attribute is needed")
    if strategy == "auto":
        strategy = "joint" if joint_product(scored, attrs) <= joint_limit else "sets"
    by = list(by)
    keys = [F.col(b) for b in by]
    attr_cols = [F.col(a).cast("string").alias(a) for a in attrs]
    yt = positive_flag(y_true, positive_label).alias(YT)
    yp = (positive_flag(y_pred, positive_label) if y_pred else F.lit(0)).alias(YP)
    bk = (cut_bucket(score, cuts) if score and cuts else F.lit(0)).alias(BUCKET)
    # prediction equals truth as text (accuracy); for a binary task it follows from (yt, yp)
    # and adds no cube rows
    ok = (F.coalesce(F.col(y_true).cast("string") == F.col(y_pred).cast("string"), F.lit(False))
          if y_pred else F.lit(False)).alias(OK)
    base = scored.select(*keys, *attr_cols, yt, yp, bk, ok)
    ids = [*by, YT, YP, BUCKET, OK]

    if strategy == "joint":
        joint = base.groupBy(*by, *attrs, YT, YP, BUCKET, OK).agg(F.count(F.lit(1)).alias(N))
        long = joint.unpivot(ids=[*ids, N], values=list(attrs), variableColumnName="attribute",
                             valueColumnName="group")
        return long.groupBy(*by, "attribute", "group", YT, YP, BUCKET, OK).agg(F.sum(N).cast("long").alias(N))
    if strategy == "sets":
        long = base.unpivot(ids=ids, values=list(attrs), variableColumnName="attribute", valueColumnName="group")
        return long.groupBy(*by, "attribute", "group", YT, YP, BUCKET, OK).agg(F.count(F.lit(1)).alias(N))
    raise ValueError(f"unknown cube strategy: {strategy}")


def joint_product(scored: DataFrame, attrs: Sequence[str]) -> float:
    """Estimated product of attribute cardinalities (HyperLogLog, nulls count as a value)."""
    row = scored.agg(*[(F.approx_count_distinct(a) + F.max(F.col(a).isNull().cast("int"))).alias(f"c{i}")
                       for i, a in enumerate(attrs)]).first()
    prod = 1.0
    for i in range(len(attrs)):
        prod *= max(1, row[f"c{i}"] or 0)
    return prod


def group_sizes(cube: DataFrame, by: Sequence[str] = (), null_label: str = C.NULL_GROUP_LABEL) -> DataFrame:
    """Rows per (attribute, group); a null group is shown as ``null_label``."""
    return (
        cube.groupBy(*by, "attribute", "group")
        .agg(F.sum(N).cast("long").alias("n"))
        .select(*by, "attribute", F.coalesce("group", F.lit(null_label)).alias("group"), "n")
    )


def accuracy_from_cube(cube: DataFrame, attribute: str, by: Sequence[str] = ()) -> DataFrame:
    """E5 from the cube: every record appears once per attribute, so one attribute's
    slice (null groups included) holds each record exactly once."""
    one = cube.where(F.col("attribute") == F.lit(attribute))
    return one.groupBy(*by).agg(
        (F.sum(F.when(F.col(OK), F.col(N)).otherwise(0)).cast("double") / F.sum(N).cast("double")).alias("accuracy"),
        F.sum(N).cast("long").alias("n"),
    )


def confusion_counts(cube: DataFrame, by: Sequence[str] = (), cut_index: int | None = None) -> DataFrame:
    """Tp / fp / fn / tn per (attribute, group) over non-null groups.

    With ``cut_index`` j the prediction is ``bucket >= j`` (score cut j) instead of y_pred.
    """
    pred = (F.col(BUCKET) >= F.lit(cut_index)) if cut_index is not None else (F.col(YP) == 1)
    pos = F.col(YT) == 1

    def cnt(cond):
        return F.coalesce(F.sum(F.when(cond, F.col(N))), F.lit(0)).cast("long")

    return (
        cube.where(F.col("group").isNotNull())
        .groupBy(*by, "attribute", "group")
        .agg(
            cnt(pos & pred).alias("tp"),
            cnt(~pos & pred).alias("fp"),
            cnt(pos & ~pred).alias("fn"),
            cnt(~pos & ~pred).alias("tn"),
        )
    )
