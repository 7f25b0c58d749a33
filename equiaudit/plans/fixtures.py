"""Audit inputs derived from the generated test tables.

The test tables carry no classifier output, so a scored view is derived from
``lineitem ⨝ orders ⨝ customer`` with integer arithmetic that DuckDB computes
identically.  Every record keeps its features, so scored rows and features
live in one table and need no positional join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from equiaudit.functions import right_closed_bins
from equiaudit.session import shuffle_partitions

# Fixed values of the scored view.
POSITIVE = "good"
SENSITIVE = ("segment", "priority", "status", "size_group")
SIZE_BINS = (0, 10, 25, 40, 50)
SIZE_LABELS = ("small", "medium", "large", "bulk")
FEATURES = (
    "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
    "o_orderstatus", "o_orderpriority", "o_totalprice", "c_acctbal", "c_mktsegment", "c_nationkey",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: Rows of a part that a task sorts for a join.
PART_ROWS = 500_000


def by_parts(df: DataFrame, key: str, sized: DataFrame) -> DataFrame:
    """``df`` dealt by ``key`` into as many parts as the rows of ``sized`` (a file's: counted in its footers) ask for;
    left to Spark where its own number is enough."""
    parts = -(-sized.count() // PART_ROWS)
    return df.repartition(parts, key) if parts > shuffle_partitions(df.sparkSession) else df


def scored_lineitems(spark: SparkSession, sf_dir: str, with_run: bool = False) -> DataFrame:
    return _scored(spark, sf_dir, with_run)


def _scored(spark: SparkSession, sf_dir: str, with_run: bool) -> DataFrame:
    """Scored records: y_true, y_score, y_pred, four sensitive attributes, features.

    ``run_id`` (order year) is added when ``with_run`` so that many audit runs can be
    computed in one pass.  Join strategy is left to Catalyst/AQE: at scale
    lineitem ⨝ orders is a sort-merge join on the order key and customer is
    broadcast only if its measured size is under the broadcast threshold.
    """
    li = table(spark, sf_dir, "lineitem")
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer")
    # the lines, the most and widest rows, are dealt once, in parts of a bounded number of rows
    j = by_parts(li, "l_orderkey", li).join(by_parts(o.join(c, o.o_custkey == c.c_custkey), "o_orderkey", li),
                                        li.l_orderkey == o.o_orderkey)
    raw = (
        (F.col("l_orderkey") * 7 + F.col("l_partkey") * 13 + F.col("l_linenumber") * 31) % 700
        + F.when(F.col("l_returnflag") == "R", 200).otherwise(0)
        + F.when(F.col("c_mktsegment") == "BUILDING", 90).otherwise(0)
    )
    score = raw.cast("double") / F.lit(1000.0)
    cols = [
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.when(F.col("l_returnflag") == "R", "good").otherwise("bad").alias("y_true"),
        score.alias("y_score"),
        F.col("c_mktsegment").alias("segment"),
        F.col("o_orderpriority").alias("priority"),
        F.col("l_linestatus").alias("status"),
        right_closed_bins("l_quantity", SIZE_BINS, SIZE_LABELS).alias("size_group"),
        *FEATURES,
    ]
    if with_run:
        cols.append(F.year("o_orderdate").cast("string").alias("run_id"))
    cols.append(F.when(score >= F.lit(0.5), "good").otherwise("bad").alias("y_pred"))
    return j.select(*cols)


def orders_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with nulls injected by a fixed rule (the generated tables have none)."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
        F.when(F.col("o_orderkey") % 7 == 0, F.lit(None)).otherwise(F.col("o_totalprice")).alias("o_totalprice_n"),
        F.when(F.col("o_orderkey") % 11 == 0, F.lit(None)).otherwise(F.col("o_orderpriority"))
        .alias("o_orderpriority_n"),
    )
