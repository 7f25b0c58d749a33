"""Text columns of many levels: the same model as with a list of levels, without one."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from equiaudit.operators import model
from equiaudit.operators.prefix import numbered
from equiaudit.operators.wide_model import WideModel, fit_wide, level_table


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    c, d, x = rng.integers(0, 40, 1500), rng.integers(0, 5, 1500), rng.normal(size=1500)
    y = rng.random(1500) < 1 / (1 + np.exp(-(x + (c % 7 - 3) / 2 + (d == 1))))
    data = [(i, f"c{a}" if i % 50 else None, f"d{b}", float(v) if i % 31 else None, "yes" if t else "no")
            for i, (a, b, v, t) in enumerate(zip(c, d, x, y))]
    return spark.createDataFrame(data, "id long, c string, d string, x double, y string").cache()


def test_same_scores_as_with_a_list_of_levels(spark, rows):
    listed = model.fit(rows, ["c", "d", "x"], "y", "yes", ["no", "yes"])
    wide = model.fit(rows, ["c", "d", "x"], "y", "yes", ["no", "yes"], listed_levels=10)
    assert isinstance(listed, model.FittedModel) and isinstance(wide, WideModel)
    asked = rows.unionByName(spark.createDataFrame([(-1, "new", "d1", 0.3, "no"), (-2, None, "other", None, "no")],
                                                   rows.schema))
    a, b = ({r.id: (r.y_score, r.y_pred) for r in m.score(asked, keep=["id"]).collect()} for m in (listed, wide))
    assert set(a) == set(b) and len(a) == 1502
    assert max(abs(a[k][0] - b[k][0]) for k in a) < 2e-3
    assert sum(a[k][1] != b[k][1] for k in a) <= 2
    assert wide.levels == {"c__c": 40, "c__d": 5}
    first = fit_wide(rows, ["c", "d", "x"], "y", "no", ["no", "yes"]).score(rows, keep=["id"])
    assert first.where("id = 7").first().y_score == pytest.approx(1 - b[7][0], abs=2e-3)


def test_unseen_levels_are_zeros(spark, rows):
    m = fit_wide(rows, ["c", "x"], "y", "yes", ["no", "yes"])
    one = m.score(spark.createDataFrame([(1, "unseen", 0.0)], "id long, c string, x double")).first()
    assert one.y_score == pytest.approx(1 / (1 + np.exp(-m.intercept)))
    only = fit_wide(rows, ["x"], "y", "yes", ["no", "yes"])  # no text column at all
    assert only.score(rows).count() == 1500
    with pytest.raises(ValueError, match="two classes"):
        fit_wide(rows, ["x"], "y", "yes", ["a", "b", "c"])


def test_many_levels_fit(spark):
    """30,000 levels, of which none is listed."""
    df = spark.range(60_000).select(F.concat(F.lit("level-"), (F.col("id") % 30_000).cast("string")).alias("c"),
                                    (F.hash("id") % 100 / 50.0).alias("x"),
                                    F.when(F.col("id") % 30_000 % 2 == 0, "a").otherwise("b").alias("y"))
    m = model.fit(df, ["c", "x"], "y", "b", ["a", "b"], max_iter=20)
    assert isinstance(m, WideModel) and m.levels == {"c__c": 30_000} and m.weights.count() == 30_000
    got = m.score(df, keep=["y"]).groupBy("y").agg(F.avg("y_score").alias("s"), F.count(F.lit(1)).alias("n")).collect()
    s = {r.y: r.s for r in got}
    assert s["b"] > s["a"] + 0.1 and sum(r.n for r in got) == 60_000


def test_numbers_in_order(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("v"))
    out = numbered(df.repartition(7), [F.asc("v")], by=["k"]).collect()
    for k in range(3):
        own = sorted((r for r in out if r.k == k), key=lambda r: r.v)
        assert [r.idx for r in own] == list(range(len(own)))
    table = level_table(df.select(F.col("k").cast("string").alias("a"), F.col("v").alias("b")), ["a", "b"])
    assert table.groupBy("feature").count().orderBy("feature").collect()[0]["count"] == 3 and table.count() == 1003
