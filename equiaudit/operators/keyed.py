"""Small helpers for operators that work on many runs at once (``by``)."""

from __future__ import annotations

from functools import reduce
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def same_key(by: Sequence[str], left: str = "", right: str = "__k_") -> Column:
    """Equality of all key columns, null equal to null."""
    return reduce(lambda a, b: a & b, [F.col(f"{left}{b}").eqNullSafe(F.col(f"{right}{b}")) for b in by], F.lit(True))


def join_by(rows: DataFrame, facts: DataFrame, by: Sequence[str], how: str = "inner") -> DataFrame:
    """``rows`` with the columns of ``facts``, which has one row per key (one row in all without keys).  Null keys
    match.  Without keys the one row is broadcast; with keys the strategy follows the size of ``facts``."""
    if not by:
        return rows.join(F.broadcast(facts), F.lit(True), "left" if how == "left" else "inner")
    renamed = facts.withColumnsRenamed({b: f"__k_{b}" for b in by})
    return rows.join(renamed, same_key(by), how).drop(*[f"__k_{b}" for b in by])


def rank_in(by: Sequence[str], order: Sequence[Column]) -> Column:
    """Row number within a key.  For tables of a few rows per key."""
    return F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("int")


def empty_keyed(df: DataFrame, by: Sequence[str], ddl: str) -> DataFrame:
    """An empty table of the key columns as ``df`` has them and the columns of ``ddl``."""
    spark = df.sparkSession
    own = spark.createDataFrame([], ddl).schema.fields
    return spark.createDataFrame([], StructType([df.schema[b] for b in by] + own))
