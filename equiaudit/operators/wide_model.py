"""G6, G7 for text columns of any number of levels.

``StringIndexer`` brings every level to the driver and ships all of them with
every task.  Here the levels are a table, (feature, value, idx), numbered by
range partitions; rows get their numbers by joins (broadcast only for columns
whose counted levels are few), and sparse vectors are built from them by column
expressions.  The fit is the one of ``model.fit``; its weights, which L-BFGS
holds on the driver anyway, become a column of the level table, so scoring is a
join and a sum, without vectors.  A level that training did not have finds no
weight and counts as zeros.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Sequence

import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from equiaudit.functions import positive_flag
from equiaudit.operators.model import FeaturePrep, fit_prep
from equiaudit.operators.prefix import numbered
from equiaudit.session import cut_lineage, spread, stored

#: Levels of a column whose table is broadcast: a bound that is checked against the counted levels.
BROADCAST_LEVELS = 100_000


def level_table(rows: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(feature, value, idx): the distinct values of every column in order, numbered from 0."""
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("value")) for c in cols])
    found = rows.select(F.inline(cells)).where("value is not null").distinct()
    return cut_lineage(numbered(found, [F.asc("value")], by=["feature"], name="idx"))


def _with_level(rows: DataFrame, table: DataFrame, col: str, given: str, out: str, levels: int) -> DataFrame:
    """``rows`` with ``out``: the column ``given`` of the table for their value of ``col``; null for an unseen one."""
    own = table.where(F.col("feature") == col).select(F.col("value").alias(f"__v_{out}"), F.col(given).alias(out))
    own = F.broadcast(own) if levels <= BROADCAST_LEVELS else own
    return rows.join(own, F.col(col) == F.col(f"__v_{out}"), "left").drop(f"__v_{out}")


@dataclass
class WideModel:
    prep: FeaturePrep
    weights: DataFrame  # (feature, value, weight)
    levels: dict[str, int]
    numeric: list[float]
    intercept: float
    classes: list[str]
    score_class: int = 1

    def score(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """``keep`` columns plus y_score and y_pred, as ``model.FittedModel.score``."""
        rows = self.prep.apply(df, list(keep))
        total: Column = F.lit(self.intercept)
        for c, w in zip(self.prep.numeric, self.numeric, strict=True):
            total = total + F.col(f"n__{c}") * F.lit(w)
        for i, c in enumerate(self.prep.categorical):
            rows = _with_level(rows, self.weights, f"c__{c}", "weight", f"__w{i}", self.levels.get(f"c__{c}", 0))
            total = total + F.coalesce(f"__w{i}", F.lit(0.0))
        second = F.lit(1.0) / (F.lit(1.0) + F.exp(-total))
        a, b = self.classes
        return rows.select(*keep, (second if self.score_class else F.lit(1.0) - second).alias("y_score"),
                           F.when(second > 0.5, F.lit(b)).otherwise(F.lit(a)).alias("y_pred"))


def _sparse(numeric: Sequence[str], places: Sequence[tuple[str, int]], size: int) -> Column:
    """A sparse vector's fields from the numeric columns and, for each text column, its number and first place."""
    n = len(numeric)
    here = F.filter(F.array(*[(F.col(i) + F.lit(at)).cast("int") for i, at in places]).cast("array<int>"),
                    lambda x: x.isNotNull())
    return F.struct(
        F.lit(0).cast("tinyint").alias("type"), F.lit(size).cast("int").alias("size"),
        F.concat(F.array(*[F.lit(i) for i in range(n)]).cast("array<int>"), here).alias("indices"),
        F.concat(F.array(*[F.col(c) for c in numeric]).cast("array<double>"),
                 F.transform(here, lambda _: F.lit(1.0))).alias("values"))


def fit_wide(train: DataFrame, features: Sequence[str], label_col: str, positive_label: str, classes: Sequence[str],
             max_iter: int = 2000, scale: bool = True, prep: FeaturePrep | None = None) -> WideModel:
    """``model.fit`` without a list of levels on the driver."""
    known = sorted(str(c) for c in classes)
    if len(set(known)) != 2:
        raise ValueError(f"logistic regression here takes two classes, not {len(set(known))}")
    spark = train.sparkSession
    prep = prep or fit_prep(train, features, scale)
    rows = prep.apply(train, keep=[positive_flag(label_col, known[1]).cast("double").alias("label")])
    text, numeric = [f"c__{c}" for c in prep.categorical], [f"n__{c}" for c in prep.numeric]
    table = level_table(rows, text) if text else spark.createDataFrame([], "feature string, value string, idx long")
    levels = {r["feature"]: r["n"] for r in table.groupBy("feature").agg(F.count(F.lit(1)).alias("n")).collect()}
    places, at = [], len(numeric)
    for i, c in enumerate(text):
        rows = _with_level(rows, table, c, "idx", f"__i{i}", levels.get(c, 0))
        places.append((f"__i{i}", at))
        at += levels.get(c, 0)
    vectors = StructType([StructField("label", DoubleType()), StructField("features", VectorUDT())])
    # written with the fields of a sparse vector and read as one; every pass of the fit reads the shared files
    data = stored(spread(rows.select("label", _sparse(numeric, places, at).alias("features"))), "vectors", vectors)
    fitted = LogisticRegression(maxIter=max_iter, regParam=1.0 / max(prep.rows or 1, 1), elasticNetParam=0.0,
                                standardization=False).fit(data)
    w = fitted.coefficients.toArray()
    parts = [pa.table({"feature": pa.array([c] * levels.get(c, 0), pa.string()),
                       "idx": pa.array(range(levels.get(c, 0)), pa.int64()),
                       "weight": w[first:first + levels.get(c, 0)]}) for c, (_, first) in zip(text, places, strict=True)]
    weights = table.select("feature", "value", F.lit(0.0).alias("weight"))
    if parts:
        own = spark.createDataFrame(pa.concat_tables(parts))
        weights = cut_lineage(table.join(own, ["feature", "idx"]).select("feature", "value", "weight"))
    return WideModel(prep, weights, levels, [float(x) for x in w[:len(numeric)]], float(fitted.intercept), known,
                     known.index(str(positive_label)) if str(positive_label) in known else 1)
