"""Exact ROC AUC as a distributed rank-sum.

Per distinct score: positives and negatives.  With ``neg_before`` the
negatives at strictly lower scores, twice the Mann-Whitney statistic is

    2U = sum(pos * (2 * neg_before + neg))        (ties count one half)

and AUC = 2U / (2 * n_pos * n_neg).  All counting is integer (decimal(38,0)
for the products), so the result does not depend on partitioning.

Scores are cut into ranges at approximate quantiles (a bounded list of numbers
from a sketch).  Rows are combined by score where they are read and dealt once,
by key and range; counting ties, ordering a range and adding it up all need that
one exchange.  Only the totals of the ranges (keys x ranges rows) are ordered
across tasks.
"""

from __future__ import annotations

import math
from typing import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from equiaudit.functions import coerce_numeric
from equiaudit.session import shuffle_partitions

_D = "decimal(38,0)"
#: Rows of a range, and the most ranges: what a task sorts does not follow the number of rows.
RANGE_ROWS, MAX_RANGES = 250_000, 1_024


def _combined(rows: DataFrame, by: Sequence[str], bounds: Sequence[float]) -> DataFrame:
    """(…by, __range, __s, __pos, __neg): the rows of a batch added up by key and score, so that a score that many rows
    share travels once per batch."""
    cuts = np.array(bounds, dtype=np.float64)

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = pa.Table.from_batches([batch])
            at = np.searchsorted(cuts, batch.column("__s").to_numpy(zero_copy_only=False), side="right")
            t = t.append_column("__range", pa.array(at.astype(np.int32)))
            yield from t.group_by([*by, "__range", "__s"]).aggregate([("__pos", "sum"), ("__neg", "sum")]).select(
                [*by, "__range", "__s", "__pos_sum", "__neg_sum"]).rename_columns(
                [*by, "__range", "__s", "__pos", "__neg"]).combine_chunks().to_batches()

    schema = StructType([*[rows.schema[b] for b in by], StructField("__range", IntegerType()), rows.schema["__s"],
                         StructField("__pos", LongType()), StructField("__neg", LongType())])
    return rows.mapInArrow(combine, schema)


def _ranges(rows: DataFrame, least: int) -> list[float]:
    """Bounds of about ``RANGE_ROWS`` rows each, of ``least`` ranges at least; one pass counts the rows and sketches them."""
    probs = [i / MAX_RANGES for i in range(1, MAX_RANGES)]
    got = rows.agg(F.count(F.lit(1)).alias("n"), F.percentile_approx("__s", probs, 10 * MAX_RANGES).alias("q")).first()
    want = min(MAX_RANGES, max(least, math.ceil(got["n"] / RANGE_ROWS)))
    q = [got["q"][i * MAX_RANGES // want - 1] for i in range(1, want)] if got["q"] else []
    # infinite scores are in the outer ranges whatever the bounds are
    return sorted({float(x) for x in q if x is not None and math.isfinite(x)})


def auc(df: DataFrame, label: Column, score: str | Column, by: Sequence[str] = (),
        buckets: int | None = None) -> DataFrame:
    """(…by, auc, n_pos, n_neg); ``label`` is a 0/1 column.  Null/NaN scores are skipped;
    AUC is null when one class is absent."""
    by = list(by)
    yt = label.cast("long")
    rows = df.select(*by, coerce_numeric(score).alias("__s"), yt.alias("__pos"), (F.lit(1) - yt).alias("__neg")).where(
        F.col("__s").isNotNull())
    parts = buckets or shuffle_partitions(df.sparkSession)
    bounds = _ranges(rows, parts)
    key = [*by, "__range"]
    # dealt by key and range: the next three steps find their rows together
    dealt = _combined(rows, by, bounds)
    dealt = dealt.repartition(*key) if len(bounds) < parts else dealt.repartition(len(bounds) + 1, *key)
    ties = dealt.groupBy(*key, "__s").agg(F.sum("__pos").alias("__pos"), F.sum("__neg").alias("__neg"))
    lower = Window.partitionBy(*key).orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    pos, neg = F.col("__pos").cast(_D), F.col("__neg").cast(_D)
    before = F.coalesce(F.sum("__neg").over(lower), F.lit(0)).cast(_D)
    ranges = ties.withColumn("__u2", pos * (F.lit(2).cast(_D) * before + neg)).groupBy(*key).agg(
        F.sum("__u2").cast(_D).alias("__u2"), F.sum("__pos").alias("__pos"), F.sum("__neg").alias("__neg"))
    # a few rows of each key: what lies in lower ranges
    earlier = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    below = F.coalesce(F.sum("__neg").over(earlier), F.lit(0)).cast(_D)
    agg = ranges.withColumn("__u2", F.col("__u2") + F.lit(2).cast(_D) * pos * below).groupBy(*by).agg(
        F.sum("__u2").alias("u2"), F.sum("__pos").cast("long").alias("n_pos"),
        F.sum("__neg").cast("long").alias("n_neg"))
    denom = (F.lit(2).cast(_D) * F.col("n_pos").cast(_D) * F.col("n_neg").cast(_D)).cast("double")
    return agg.select(
        *by,
        F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col("u2").cast("double") / denom).alias("auc"),
        "n_pos",
        "n_neg",
    )
