"""G1: reproducible stratified train/test split without a window per label.

Rows are ordered by md5(seed | key).  ``exact`` mode takes, per label, the
first ``quota`` rows in that order, like a random permutation cut at the
stratum quota.  It never sorts a whole label: it counts rows per
(label, 20-bit hash prefix) -- at most 1,048,576 rows per label -- finds the
prefix where each label's quota ends, assigns every other row by comparing
prefixes, and ranks only the rows inside that one boundary prefix.
``fraction`` mode keeps a row when its hash, as a number in [0, 1), is below
the test size: one pass, no counts, quota met in expectation.
"""

from __future__ import annotations

import math
from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from equiaudit.session import cut_lineage

_PREFIX_HEX = 5
_NULL = "\u0000null"


def row_hash(key_cols: Sequence[str], seed: int):
    """Hash of the key; keys that differ only in where they hold nulls differ.  Rows with one key get one hash, so
    the key should be unique."""
    marked = [F.coalesce(F.col(c).cast("string"), F.lit(_NULL)) for c in key_cols]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *marked))


def stratum_quotas(counts: dict, test_size: float) -> dict:
    """Test rows per label: ``ceil(test_size * n)`` in total; train quotas by largest
    remainder (ties by label), test = label count - train quota."""
    n = sum(counts.values())
    n_test = int(math.ceil(test_size * n))
    n_train = n - n_test
    labels = sorted(counts, key=lambda k: (k is None, str(k)))
    base = {k: (counts[k] * n_train) // n for k in labels}
    rem = {k: (counts[k] * n_train) % n for k in labels}
    short = n_train - sum(base.values())
    for k in sorted(labels, key=lambda k: (-rem[k], str(k)))[:short]:
        base[k] += 1
    return {k: counts[k] - base[k] for k in labels}


def stratified_split(df: DataFrame, key_cols: Sequence[str], label_col: str, test_size: float = 0.25,
                     seed: int = 42, mode: str = "exact") -> DataFrame:
    """Input columns plus ``is_test`` (boolean)."""
    spark = df.sparkSession
    h = row_hash(key_cols, seed)
    if mode == "fraction":
        as_unit = F.conv(F.substring(h, 1, 12), 16, 10).cast("double") / F.lit(float(16 ** 12))
        return df.withColumn("is_test", as_unit < F.lit(float(test_size)))
    if mode != "exact":
        raise ValueError(f"unknown split mode: {mode}")

    stratum = F.coalesce(F.col(label_col).cast("string"), F.lit(_NULL))
    tagged = df.withColumn("__s", stratum).withColumn("__h", h).withColumn("__p", F.substring("__h", 1, _PREFIX_HEX))
    # at most 2^20 rows per label, read three times below: computed once
    per_prefix = cut_lineage(tagged.groupBy("__s", "__p").agg(F.count(F.lit(1)).alias("__c")))
    # one row per label reaches the driver
    counts = {r["__s"]: r["n"] for r in per_prefix.groupBy("__s").agg(F.sum("__c").alias("n")).collect()}
    quotas = stratum_quotas(counts, test_size)
    quota_df = spark.createDataFrame([(k, int(v)) for k, v in quotas.items()], "__s string, __q long")

    w = Window.partitionBy("__s").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    cum = per_prefix.withColumn("__before", F.coalesce(F.sum("__c").over(w), F.lit(0)))
    # boundary: the prefix holding the quota-th row of each label (absent when the quota is 0)
    boundary = (
        cum.join(F.broadcast(quota_df), "__s")
        .where((F.col("__before") < F.col("__q")) & (F.col("__q") <= F.col("__before") + F.col("__c")))
        .select("__s", F.col("__p").alias("__bp"), (F.col("__q") - F.col("__before")).alias("__need"))
    )
    # one row per label: proven small, broadcast
    marked = tagged.join(F.broadcast(boundary), "__s", "left")
    direct = marked.where(F.col("__bp").isNull() | (F.col("__p") != F.col("__bp"))).withColumn(
        "is_test", F.coalesce(F.col("__p") < F.col("__bp"), F.lit(False))
    )
    wr = Window.partitionBy("__s").orderBy("__h", *key_cols)
    edge = marked.where(F.col("__p") == F.col("__bp")).withColumn(
        "is_test", F.row_number().over(wr) <= F.col("__need")
    )
    return direct.unionByName(edge).select(*df.columns, "is_test")


def split_counts(parts: DataFrame) -> DataFrame:
    """Rows in train and test."""
    return parts.groupBy(F.when(F.col("is_test"), "test").otherwise("train").alias("split")).agg(
        F.count(F.lit(1)).alias("n"))
