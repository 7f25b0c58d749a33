"""Feature preparation, logistic regression, scoring, proxy detection.

Preparation statistics (exact medians, most frequent values, population
deviations) are single numbers per column computed by distributed
aggregations; the fit is ``pyspark.ml`` L-BFGS over cached feature vectors.
Unknown categories at scoring time encode as all zeros: the indexer keeps an
extra "unseen" index and the encoder drops that last slot.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import TYPE_CHECKING, Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equiaudit import constants as C
from equiaudit.functions import coerce_numeric, positive_flag, text_or_null_token
from equiaudit.operators import profile
from equiaudit.operators.ranking import auc as auc_of
from equiaudit.operators.shift import split_feature_types
from equiaudit.session import spread

if TYPE_CHECKING:
    from equiaudit.operators.wide_model import WideModel


@dataclass
class FeaturePrep:
    numeric: list[str]
    categorical: list[str]
    medians: dict
    modes: dict
    scales: dict | None
    rows: int | None = None
    most_levels: int = 0  # of a text column, estimated

    def apply(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """Imputed (and optionally unit-scaled) feature columns next to the ``keep`` columns."""
        num = []
        for c in self.numeric:
            x = F.coalesce(coerce_numeric(c), F.lit(self.medians.get(c)).cast("double"))
            if self.scales is not None:
                x = x / F.lit(self.scales[c])
            num.append(F.coalesce(x, F.lit(0.0)).alias(f"n__{c}"))
        cat = [F.coalesce(F.col(c).cast("string"), F.lit(self.modes.get(c))).alias(f"c__{c}") for c in self.categorical]
        return df.select(*keep, *num, *cat)


@dataclass
class ColumnFacts:
    rows: int
    num_gaps: list
    cat_gaps: list
    deviations: dict
    most_levels: int


def column_facts(df: DataFrame, num: Sequence[str], cat: Sequence[str]) -> ColumnFacts:
    """One aggregate, one row to the driver: row count, which columns hold a null
    (or NaN), and the population deviation of every numeric column."""
    aggs = [F.count(F.lit(1)).alias("__rows")]
    for i, c in enumerate(num):
        x = coerce_numeric(c)
        aggs += [F.max(x.isNull().cast("int")).alias(f"gn{i}"), F.stddev_pop(x).alias(f"sd{i}")]
    for i, c in enumerate(cat):
        aggs += [F.max(F.col(c).isNull().cast("int")).alias(f"gc{i}"), F.approx_count_distinct(c).alias(f"dc{i}")]
    r = df.agg(*aggs).first()
    return ColumnFacts(
        rows=int(r["__rows"]),
        num_gaps=[c for i, c in enumerate(num) if r[f"gn{i}"]],
        cat_gaps=[c for i, c in enumerate(cat) if r[f"gc{i}"]],
        deviations={c: r[f"sd{i}"] for i, c in enumerate(num)},
        most_levels=max((r[f"dc{i}"] for i in range(len(cat))), default=0),
    )


def _unit(sd) -> float:
    return sd if sd is not None and sd == sd and sd != 0.0 else 1.0


def fit_prep(df: DataFrame, features: Sequence[str], scale: bool) -> FeaturePrep:
    """Imputation statistics are computed only for columns that have gaps: elsewhere
    imputing is a no-op, so skipping the exact median / mode passes changes nothing.
    Deviations come from the same first pass; only gap columns are re-measured after
    imputation."""
    num, cat, _ = split_feature_types(df, features)  # datetimes are left out
    facts = column_facts(df, num, cat)
    medians = profile.column_medians(df, facts.num_gaps)
    modes = profile.column_modes(df, facts.cat_gaps)
    scales = None
    if scale:
        scales = {c: _unit(facts.deviations[c]) for c in num}
        if facts.num_gaps:
            filled = df.select(*[F.coalesce(coerce_numeric(c), F.lit(medians.get(c))).alias(c)
                                 for c in facts.num_gaps])
            scales.update(profile.unit_scale_factors(filled, facts.num_gaps))
    return FeaturePrep(num, cat, medians, modes, scales, facts.rows, facts.most_levels)


def build_pipeline(prep: FeaturePrep, max_iter: int, reg_param: float, label_col: str = "__label") -> Pipeline:
    idx = [f"i__{c}" for c in prep.categorical]
    oh = [f"o__{c}" for c in prep.categorical]
    stages = []
    if prep.categorical:
        stages.append(StringIndexer(inputCols=[f"c__{c}" for c in prep.categorical], outputCols=idx,
                                    handleInvalid="keep", stringOrderType="alphabetAsc"))
        stages.append(OneHotEncoder(inputCols=idx, outputCols=oh, dropLast=True))
    stages.append(VectorAssembler(inputCols=[f"n__{c}" for c in prep.numeric] + oh, outputCol="__features"))
    stages.append(LogisticRegression(featuresCol="__features", labelCol=label_col, maxIter=max_iter,
                                     regParam=reg_param, elasticNetParam=0.0, standardization=False,
                                     fitIntercept=True))
    return Pipeline(stages=stages)


@dataclass
class FittedModel:
    prep: FeaturePrep
    model: PipelineModel
    classes: list[str]  # sorted, as text: prediction 0.0 and 1.0
    score_class: int = 1  # whose probability is y_score

    def score(self, df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
        """``keep`` columns (names) plus y_score (probability of the configured class, or of the second class if the
        configured label is none of the two) and y_pred (label text)."""
        out = self.model.transform(self.prep.apply(df, list(keep)))
        first, second = self.classes
        return out.select(
            *keep,
            vector_to_array("probability")[self.score_class].alias("y_score"),
            F.when(F.col("prediction") == 1.0, F.lit(second)).otherwise(F.lit(first)).alias("y_pred"),
        )


def _fit_prepared(data: DataFrame, prep: FeaturePrep, max_iter: int, positive_label: str,
                  classes: Sequence[str]) -> FittedModel:
    n = prep.rows if prep.rows is not None else data.count()
    model = build_pipeline(prep, max_iter, 1.0 / max(n, 1)).fit(data)
    known = sorted(str(c) for c in classes)
    return FittedModel(prep, model, known, known.index(str(positive_label)) if str(positive_label) in known else 1)


#: Levels of a text column beyond which they are kept in a table, not in a list on the driver.
LISTED_LEVELS = 10_000


def fit(train: DataFrame, features: Sequence[str], label_col: str, positive_label: str, classes: Sequence[str],
        max_iter: int = 2000, scale: bool = True, listed_levels: int = LISTED_LEVELS) -> FittedModel | WideModel:
    """Imputers (+ unit scaler) + one-hot + L2 logistic regression with C = 1.

    Where a text column has more than ``listed_levels`` values (by a sketch), levels and weights are tables
    (``wide_model``); the optimum is the same.

    The C = 1 objective sum(loss) + ||w||^2 / 2 equals Spark's
    mean(loss) + regParam * ||w||^2 / 2 at regParam = 1 / n_train.
    """
    if len(set(map(str, classes))) != 2:
        raise ValueError(f"logistic regression here takes two classes, not {len(set(map(str, classes)))}")
    prep = fit_prep(train, features, scale)
    if prep.most_levels > listed_levels:
        from equiaudit.operators.wide_model import fit_wide

        return fit_wide(train, features, label_col, positive_label, classes, max_iter, scale, prep)
    # fitted on the classes as they are; the configured label only says which one is scored
    second = sorted(str(c) for c in classes)[1]
    data = prep.apply(train, keep=[positive_flag(label_col, second).cast("double").alias("__label")])
    # every L-BFGS iteration is a pass over these rows: spread them over all cores once, then cache
    data = spread(data).persist()
    try:
        return _fit_prepared(data, prep, max_iter, positive_label, classes)
    finally:
        data.unpersist()


def risk_level(auc: float | None) -> str | None:
    """H6 for one driver-side number (same bands as :func:`equiaudit.functions.risk_band`)."""
    if auc is None or auc != auc:
        return None
    for name, lo in C.RISK_BANDS:
        if auc >= lo:
            return name
    return C.RISK_DEFAULT


def proxy_detection(df: DataFrame, attribute: str, features: Sequence[str], max_iter: int = 1000) -> dict:
    """H5: can the features predict a two-valued attribute?  Fits and scores in-sample
    (as audited); returns attribute, classes, accuracy, auc, risk_level, status."""
    # classes of the attribute as text; a missing value is the class "nan" (so a two-valued
    # attribute with gaps has three classes and is unsupported)
    values = df.select(text_or_null_token(attribute).alias("v")).distinct()
    classes = [r["v"] for r in values.orderBy("v").collect()]  # one name for each group
    n = len(classes)
    if n != 2:
        return {"attribute": attribute, "classes": classes, "n_classes": n, "accuracy": None,
                "auc": None, "risk_level": None, "status": "unsupported",
                "error": f"a proxy model takes an attribute of two groups; {attribute} has {n}"}
    y = F.coalesce(F.col(attribute).cast("string"), F.lit("nan")).alias("__y")
    base = df.select(y, *features)
    prep = fit_prep(base, features, scale=False)
    # fitted and scored on the same rows: prepare and cache them once for fit, scoring and AUC
    data = spread(prep.apply(base, keep=["__y", (F.col("__y") == F.lit(classes[1])).cast("double")
                                           .alias("__label")])).persist()
    try:
        m = _fit_prepared(data, prep, max_iter, classes[1], classes)
        scored = m.model.transform(data).select(
            "__label", vector_to_array("probability")[1].alias("y_score"), "prediction")
        acc = scored.agg(F.avg((F.col("prediction") == F.col("__label")).cast("int")).alias("a")).first()["a"]
        a = auc_of(scored, F.col("__label"), "y_score").first()
    finally:
        data.unpersist()
    return {"attribute": attribute, "classes": classes, "n_classes": 2, "accuracy": acc, "auc": a["auc"],
            "risk_level": risk_level(a["auc"]), "status": "ok", "error": None}
