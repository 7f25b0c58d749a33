"""Golden numbers of the stored credit run (250 scored rows, attributes sex and age_group)."""

import pytest
from pyspark.sql import functions as F

from equiaudit import constants as C
from equiaudit.operators import cube as cube_ops
from equiaudit.operators import rates, slices, thresholds
from equiaudit.operators.ranking import auc
from equiaudit.functions import positive_flag

ATTRS = ["sex", "age_group"]


def _rows(df, *keys):
    return {tuple(r[k] for k in keys): r for r in df.collect()}


def test_group_sizes(credit):
    df, _ = credit
    sizes = _rows(cube_ops.group_sizes(cube_ops.confusion_cube(df, ATTRS, "good")), "attribute", "group")
    assert {k: v["n"] for k, v in sizes.items()} == {
        ("sex", "male"): 173, ("sex", "female"): 77,
        ("age_group", "adult"): 135, ("age_group", "middle"): 64, ("age_group", "young"): 41,
        ("age_group", "senior"): 10,
    }


def test_rates_differences_ratios_flags(credit):
    df, _ = credit
    r = rates.group_rates(cube_ops.confusion_cube(df, ATTRS, "good"))
    got = _rows(r, "attribute", "group")
    assert got[("sex", "female")]["selection_rate"] == pytest.approx(0.6883116883116883, abs=0, rel=1e-15)
    assert got[("sex", "male")]["true_positive_rate"] == 0.8780487804878049
    assert got[("age_group", "middle")]["false_positive_rate"] == 0.38095238095238093
    assert got[("age_group", "senior")]["selection_rate"] == 1.0
    d = _rows(rates.disparity_flags(rates.disparity(r), 0.05), "attribute", "metric")
    assert d[("sex", "selection_rate")]["difference"] == pytest.approx(0.10359582613917873, rel=1e-14)
    assert d[("sex", "true_positive_rate")]["difference"] == pytest.approx(0.10881801125703561, rel=1e-14)
    assert d[("sex", "false_positive_rate")]["difference"] == pytest.approx(0.05999999999999994, rel=1e-12)
    assert d[("age_group", "false_positive_rate")]["difference"] == pytest.approx(0.6190476190476191, rel=1e-14)
    assert d[("sex", "selection_rate")]["ratio"] == pytest.approx(0.8691819129775334, rel=1e-14)
    assert d[("age_group", "true_positive_rate")]["ratio"] == pytest.approx(0.6818181818181818, rel=1e-14)
    assert all(v["flag"] for v in d.values())


def test_accuracy(credit):
    df, _ = credit
    assert rates.accuracy(df).first()["accuracy"] == pytest.approx(0.724)


def test_threshold_sweep(credit):
    df, _ = credit
    cube = cube_ops.confusion_cube(df, ["sex"], "good", y_pred=None, score="y_score", cuts=C.DEFAULT_CUTS)
    s = _rows(thresholds.threshold_sensitivity(cube), "threshold", "metric")
    assert s[(0.1, "selection_rate")]["difference"] == pytest.approx(0.010134374296223991, rel=1e-12)
    assert s[(0.1, "false_positive_rate")]["ratio"] == pytest.approx(0.9791666666666666, rel=1e-14)
    # the 0.5 cut reproduces the report (y_pred is the 0.5 cut on every stored row)
    assert s[(0.5, "true_positive_rate")]["difference"] == pytest.approx(0.10881801125703561, rel=1e-14)


def test_slice_scan_order(credit):
    df, feats = credit
    out = slices.slice_scan(df, feats, "good").orderBy("rank").collect()
    assert [c for c in slices.slice_candidates(df, feats)] == [
        "checking_account_status", "credit_history", "savings_account", "employment_status", "installment_rate"]
    assert len(out) == 20
    assert (out[0]["feature"], out[0]["value"], out[0]["n"]) == ("checking_account_status", "A14", 93)
    assert (out[1]["feature"], out[1]["value"], out[1]["n"]) == ("checking_account_status", "A13", 15)
    assert (out[2]["value"], out[2]["n"]) == ("A34", 66)
    assert out[2]["true_positive_rate"] == pytest.approx(0.9607843137254902, rel=1e-14)
    assert (out[3]["feature"], out[3]["value"], out[3]["n"]) == ("savings_account", "A64", 14)


def test_auc_matches_pairwise(credit):
    df, _ = credit
    pdf = df.select("y_true", "y_score").toPandas()
    pos = pdf[pdf.y_true == "good"].y_score.values
    neg = pdf[pdf.y_true != "good"].y_score.values
    pair = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    got = auc(df, positive_flag("y_true", "good"), "y_score", buckets=7).first()["auc"]
    assert got == pytest.approx(pair, rel=1e-12)
    flipped = auc(df.withColumn("y_score", -F.col("y_score")), positive_flag("y_true", "good"), "y_score").first()
    assert flipped["auc"] == pytest.approx(1 - pair, rel=1e-12)


def test_age_group_sweep(credit):
    """Four groups; the 0.9 cut has a group with no false positives (ratio 0.0)."""
    df, _ = credit
    cube = cube_ops.confusion_cube(df, ["age_group"], "good", y_pred=None, score="y_score", cuts=C.DEFAULT_CUTS)
    s = _rows(thresholds.threshold_sensitivity(cube), "threshold", "metric")
    assert s[(0.1, "selection_rate")]["difference"] == pytest.approx(0.046875, rel=1e-14)
    assert s[(0.1, "true_positive_rate")]["ratio"] == pytest.approx(0.9767441860465116, rel=1e-14)
    assert s[(0.5, "false_positive_rate")]["difference"] == pytest.approx(0.6190476190476191, rel=1e-14)
    assert s[(0.9, "true_positive_rate")]["difference"] == pytest.approx(0.48863636363636365, rel=1e-14)
    assert s[(0.9, "false_positive_rate")]["ratio"] == 0.0
    assert s[(0.9, "selection_rate")]["ratio"] == pytest.approx(0.14634146341463414, rel=1e-14)
