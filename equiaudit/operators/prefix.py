"""Exact running totals and top-k without single-partition windows.

``running_totals`` cuts the (already de-duplicated) input into range buckets
at approximate quantiles of the ordering key, sums each bucket, turns the
bucket sums into offsets on a table of at most ``buckets`` rows per group,
and finishes with a window inside each bucket.  No step holds more than one bucket of rows, so a single
hot group or a skewed key range does not land in one task.

``top_k`` keeps the k best rows per group in two rounds: first within
(group, salt) partitions, then over at most k x salts survivors per group.
"""

from __future__ import annotations

import math
from typing import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from equiaudit.session import cut_lineage, shuffle_partitions

_BK = "__range_bucket"


def range_bounds(df: DataFrame, order: str, buckets: int, accuracy: int = 10000) -> list[float]:
    """Approximate quantile cut points of a numeric column: ``buckets - 1`` numbers
    (a bounded list) from one ``percentile_approx`` aggregate."""
    if buckets <= 1:
        return []
    probs = [i / buckets for i in range(1, buckets)]
    row = df.agg(F.percentile_approx(F.col(order).cast("double"), probs, accuracy).alias("q")).first()
    # infinite keys are in the outer buckets whatever the bounds are
    return sorted({float(x) for x in (row["q"] or []) if x is not None and math.isfinite(x)})


def with_bucket(df: DataFrame, order: str, bounds: Sequence[float], out: str = _BK) -> DataFrame:
    """Add the index of the range bucket holding ``order`` (number of bounds <= value).

    The bounds are fixed numbers, so every use agrees on the bucket whatever the
    partitioning or retries; ``Bucketizer`` finds it by binary search in the JVM.
    """
    if not bounds:
        return df.withColumn(out, F.lit(0))
    tmp = f"{out}__x"
    splits = [float("-inf"), *bounds, float("inf")]
    b = Bucketizer(splits=splits, inputCol=tmp, outputCol=f"{out}__d", handleInvalid="keep")
    res = b.transform(df.withColumn(tmp, F.col(order).cast("double")))
    return res.withColumn(out, F.col(f"{out}__d").cast("int")).drop(tmp, f"{out}__d")


def running_totals(
    df: DataFrame,
    order: str,
    cols: Sequence[str],
    by: Sequence[str] = (),
    buckets: int | None = None,
    suffix: str = "_before",
) -> DataFrame:
    """Add ``<col><suffix>`` = sum of ``col`` over rows strictly before this one in
    ``order`` within ``by``.  Rows must be unique on (by, order); ``order`` numeric."""
    by = list(by)
    n_buckets = buckets or shuffle_partitions(df.sparkSession)
    bounds = range_bounds(df, order, n_buckets)
    ranged = with_bucket(df, order, bounds)
    totals = ranged.groupBy(*by, _BK).agg(*[F.sum(c).alias(f"__t_{c}") for c in cols])
    w_buckets = Window.partitionBy(*by).orderBy(_BK).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *by, _BK, *[F.coalesce(F.sum(f"__t_{c}").over(w_buckets), F.lit(0)).alias(f"__o_{c}") for c in cols]
    )
    # Without grouping keys the offset table has at most one row per bucket: a
    # proven bound, so it is broadcast.  With keys its size follows the number
    # of groups and the join strategy is left to AQE.
    joined = ranged.join(F.broadcast(offsets) if not by else offsets, [*by, _BK])
    w_in = Window.partitionBy(*by, _BK).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return joined.select(
        *df.columns,
        *[(F.col(f"__o_{c}") + F.coalesce(F.sum(c).over(w_in), F.lit(0))).alias(f"{c}{suffix}") for c in cols],
    )


def top_k(
    df: DataFrame,
    by: Sequence[str],
    order: Sequence[Column],
    k: int,
    salt_on: str | None = None,
    salts: int = 32,
    rank_col: str = "rank",
) -> DataFrame:
    """The ``k`` first rows per ``by`` group under the total order ``order``, with a 1-based rank.

    With ``salt_on`` the first round runs per (group, hash(salt_on) % salts),
    so a group with very many candidate rows is split over many tasks.
    """
    by = list(by)
    if salt_on is not None:
        salt = F.pmod(F.xxhash64(F.col(salt_on)), F.lit(salts))
        w1 = Window.partitionBy(*by, salt).orderBy(*order)
        df = df.withColumn("__r1", F.row_number().over(w1)).where(F.col("__r1") <= k).drop("__r1")
    w2 = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w2)).where(F.col(rank_col) <= k)


def numbered(df: DataFrame, order: Sequence[Column], by: Sequence[str] = (), name: str = "idx") -> DataFrame:
    """``df`` with 0, 1, 2 ... in ``order`` within ``by``: rows are range-partitioned and written, so that their ranges
    hold still, ranges are counted, and a window numbers the rows of one range from where it starts."""
    by = list(by)
    ranged = cut_lineage(df.repartitionByRange(*by, *order).withColumn("__part", F.spark_partition_id()))
    sizes = ranged.groupBy(*by, "__part").agg(F.count(F.lit(1)).alias("__n"))  # ranges and keys, not rows
    earlier = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    first = sizes.select(*by, "__part", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__first"))
    inside = F.row_number().over(Window.partitionBy(*by, "__part").orderBy(*order)) - 1
    return ranged.join(first, [*by, "__part"]).withColumn(name, (F.col("__first") + inside).cast("long")).select(
        *df.columns, name)
