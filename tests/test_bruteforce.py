"""Random small scored tables: cube-based report and sweep against a brute-force pandas computation."""

import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from equiaudit import constants as C
from equiaudit.operators import cube as cube_ops
from equiaudit.operators import rates, thresholds

row = st.tuples(
    st.sampled_from(["good", "bad", None]),
    st.sampled_from(["good", "bad"]),
    st.one_of(st.none(), st.just(float("nan")), st.floats(0, 1), st.sampled_from([0.1, 0.5, 0.9])),
    st.sampled_from(["a", "b", "c", None]),
)


def brute(df: pd.DataFrame, attr: str, pred: pd.Series):
    yt = (df["y_true"] == "good").astype(int)
    out = {}
    for g, idx in df.groupby(attr).groups.items():
        t, p = yt.loc[idx], pred.loc[idx]
        pos, neg = int(t.sum()), int(len(t) - t.sum())
        out[g] = (
            float(p.mean()),
            float(((p == 1) & (t == 1)).sum() / pos) if pos else 0.0,
            float(((p == 1) & (t == 0)).sum() / neg) if neg else 0.0,
        )
    diffs = {}
    for i, m in enumerate(C.METRICS):
        vals = [v[i] for v in out.values()]
        diffs[m] = max(vals) - min(vals)
    return diffs


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(row, min_size=1, max_size=40))
def test_report_and_sweep_match_brute_force(spark, rows):
    pdf = pd.DataFrame(rows, columns=["y_true", "y_pred", "y_score", "g"])
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None),
                               "y_true string, y_pred string, y_score double, g string")
    cube = cube_ops.confusion_cube(df, ["g"], "good", score="y_score", cuts=C.DEFAULT_CUTS)
    got = {r.metric: r.difference for r in rates.disparity(rates.group_rates(cube)).collect()}
    if pdf["g"].notna().any():
        exp = brute(pdf, "g", (pdf["y_pred"] == "good").astype(int))
        assert got == pytest.approx(exp, abs=1e-12)
        sweep = {(r.threshold, r.metric): r.difference for r in thresholds.threshold_sensitivity(cube).collect()}
        for t in (0.1, 0.5, 0.9):
            s = pdf["y_score"].astype(float)
            pred = ((s >= t) & s.notna()).astype(int)
            e = brute(pdf, "g", pred)
            for m in C.METRICS:
                assert sweep[(t, m)] == pytest.approx(e[m], abs=1e-12)
    else:
        assert got == {}
