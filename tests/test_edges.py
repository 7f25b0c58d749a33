"""Hand-written edge fixtures."""

import math

import pytest
from pyspark.sql import functions as F

from equiaudit import constants as C
from equiaudit.functions import predicted_at, right_closed_bins, severity, value_map
from equiaudit.operators import cube as cube_ops
from equiaudit.operators import model as model_ops
from equiaudit.operators import rates, shift, slices, thresholds
from equiaudit.spec import validate_binary_label


def _scored(spark, rows):
    return spark.createDataFrame(rows, "y_true string, y_pred string, y_score double, g string")


def test_positive_label_never_occurs(spark):
    df = _scored(spark, [("a", "a", 0.1, "x"), ("b", "a", 0.2, "y"), ("a", "b", 0.9, "y")])
    r = rates.group_rates(cube_ops.confusion_cube(df, ["g"], "zzz"))
    for row in r.collect():
        assert (row.selection_rate, row.true_positive_rate, row.false_positive_rate) == (0.0, 0.0, 0.0)
    d = rates.disparity_flags(rates.disparity(r), 0.05).collect()
    assert all(x.difference == 0.0 and x.ratio is None and x.flag is False for x in d)


def test_slice_without_positives_has_null_tpr(spark):
    rows = [("bad", "good" if i % 2 else "bad", 0.5, "v") for i in range(12)]
    df = spark.createDataFrame(rows, "y_true string, y_pred string, y_score double, f string")
    out = slices.slice_scan(df, ["f"], "good", candidates=["f"]).first()
    assert out.true_positive_rate is None and out.false_positive_rate == 0.5


def test_null_nan_and_on_cut_scores(spark):
    df = spark.createDataFrame([(None,), (float("nan"),), (0.5,), (0.4999,)], "s double")
    got = [r.p for r in df.select(predicted_at("s", 0.5).alias("p")).collect()]
    assert got == [0, 0, 1, 0]


def test_bins_are_right_closed(spark):
    df = spark.createDataFrame([(0.0,), (25.0,), (25.5,), (120.0,), (121.0,), (None,), (float("nan"),)], "a double")
    col = right_closed_bins("a", [0, 25, 40, 60, 120], ["young", "adult", "middle", "senior"])
    assert [r.b for r in df.select(col.alias("b")).collect()] == [None, "young", "adult", "senior", None, None, None]


def test_unmapped_is_null(spark):
    df = spark.createDataFrame([("A91",), ("A95",), ("A99",), (None,)], "p string")
    m = value_map("p", {"A91": "male", "A95": "female"})
    assert [r.s for r in df.select(m.alias("s")).collect()] == ["male", "female", None, None]
    n = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    assert [r.s for r in n.select(value_map("k", {"1": "good", "2": "bad"}).alias("s")).collect()] == \
        ["good", "bad", None]


def test_null_group_in_sizes_not_in_disparity(spark):
    df = _scored(spark, [("good", "good", 0.9, None), ("good", "bad", 0.1, "x"), ("bad", "bad", 0.2, "y")])
    cube = cube_ops.confusion_cube(df, ["g"], "good")
    sizes = {r.group: r.n for r in cube_ops.group_sizes(cube).collect()}
    assert sizes == {"nan": 1, "x": 1, "y": 1}
    groups = {r.group for r in rates.group_rates(cube).collect()}
    assert groups == {"x", "y"}


def test_difference_exactly_at_threshold(spark):
    df = spark.createDataFrame([(0.05,), (0.1,), (0.025,), (0.0249,), (None,), (float("nan"),)], "d double")
    got = df.select(rates.flag(F.col("d"), 0.05).alias("f"), severity("d", 0.05).alias("s")).collect()
    assert [r.f for r in got] == [False, True, False, False, False, False]
    assert [r.s for r in got] == ["moderate", "severe", "mild", "unknown", "unknown", "unknown"]


def test_three_valued_label_is_an_error(spark):
    df = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "y string")
    with pytest.raises(ValueError):
        validate_binary_label(df, "y")
    assert validate_binary_label(df.where("y != 'c'"), "y") == ["a", "b"]


def test_three_valued_attribute_in_proxy(spark):
    df = spark.createDataFrame([(1.0, "a"), (2.0, "b"), (3.0, "c")], "x double, g string")
    assert model_ops.proxy_detection(df, "g", ["x"])["status"] == "unsupported"


def test_one_group_shift(spark):
    df = spark.createDataFrame([(1.0, "a"), (2.0, "a")], "x double, g string")
    assert "error" in shift.feature_distribution(df, "g", ["x"])


def test_all_null_numeric_sorts_first(spark):
    df = spark.createDataFrame([(None, 1.0, "a"), (None, 3.0, "b"), (None, 2.0, "a")], "e double, x double, g string")
    groups = shift.compared_groups(df, "g")
    assert groups == ["a", "b"]
    out = shift.numeric_shift(df, "g", ["x", "e"], groups).orderBy("rank").collect()
    assert out[0].feature == "e" and out[0].abs_mean_diff is None
    assert out[1].feature == "x" and out[1].abs_mean_diff == pytest.approx(1.5)


def test_empty_input(spark):
    df = _scored(spark, [])
    cube = cube_ops.confusion_cube(df, ["g"], "good", score="y_score", cuts=C.DEFAULT_CUTS)
    assert rates.group_rates(cube).count() == 0
    assert thresholds.threshold_sensitivity(cube).count() == 0


def test_truncated_tvd(spark):
    rows = [(v, "a") for v in "pqrstuv"] + [(v, "b") for v in "pppqq"]
    df = spark.createDataFrame(rows, "c string, g string")
    out = shift.categorical_shift(df, "g", ["c"], ["a", "b"]).first()
    # group a keeps 5 of 7 values at 1/7 each; b is p 3/5, q 2/5
    a = {k: 1 / 7 for k in "pqrst"}
    b = {"p": 0.6, "q": 0.4}
    exp = 0.5 * sum(abs(a.get(k, 0) - b.get(k, 0)) for k in set(a) | set(b))
    assert math.isclose(out.total_variation_distance, exp, rel_tol=1e-12)


def test_missing_attribute_value_is_a_proxy_class(spark):
    df = spark.createDataFrame([(1.0, "a"), (2.0, "b"), (3.0, None)], "x double, g string")
    res = model_ops.proxy_detection(df, "g", ["x"])
    assert res["status"] == "unsupported" and res["classes"] == ["a", "b", "nan"]


def test_slice_ties_follow_numeric_value_order(spark):
    rows = [(v, "good", "good") for v in (9, 10) for _ in range(10)]
    df = spark.createDataFrame(rows, "k int, y_true string, y_pred string")
    out = slices.slice_scan(df, ["k"], "good", candidates=["k"]).orderBy("rank").collect()
    assert [r.value for r in out] == ["9", "10"]
