"""Model encoding, the whole audit, and the join-based value map."""

import tempfile

import pytest
from pyspark.sql import functions as F

from equiaudit.operators import model as model_ops
from equiaudit.operators.derive import map_by_join
from equiaudit.operators.split import split_counts, stratified_split
from equiaudit.plans import audit
from equiaudit.plans import fixtures as fx
from equiaudit.sources import audit_store as store
from equiaudit.spec import AuditSpec

from paths import CREDIT_CSV, SF0001


def test_unseen_category_encodes_as_zeros(spark):
    train = spark.createDataFrame([("a", 1.0, "1"), ("b", 2.0, "0"), ("a", 3.0, "1"), ("b", 1.5, "0")],
                                  "c string, x double, y string")
    m = model_ops.fit(train, ["c", "x"], "y", "1", ["0", "1"], max_iter=50)
    test = spark.createDataFrame([("zzz", 1.0)], "c string, x double")
    prepared = m.prep.apply(test)
    vec = m.model.transform(prepared).select("__features").first()[0]
    # one numeric slot + one slot per known level (a, b); the unseen level sets none of them
    assert vec.size == 3 and list(vec.toArray()[1:]) == [0.0, 0.0]
    out = m.score(test.withColumn("k", F.lit(1)), keep=["k"]).first()
    assert 0.0 <= out.y_score <= 1.0 and out.y_pred in ("0", "1")


def test_map_by_join(spark):
    df = spark.createDataFrame([(1,), (2,), (3,)], "k int")
    mp = spark.createDataFrame([("1", "x"), ("2", "y")], "key string, value string")
    got = {r.k: r.m for r in map_by_join(df, "k", mp, "m").collect()}
    assert got == {1: "x", 2: "y", 3: None}


def test_whole_audit_and_store(spark):
    scored = fx.scored_lineitems(spark, SF0001)
    spec = AuditSpec(positive_label="good", sensitive_cols=fx.SENSITIVE, fairness_threshold=0.05)
    out = audit.run_audit(scored, spec, fx.FEATURES)
    status = {(r.tool, r.attribute): r.status for r in out["diagnostics_status"].collect()}
    plan = {(r.tool, r.attribute) for r in out["plan"].collect()}
    assert set(status) == plan and all(v in ("ok", "unsupported") for v in status.values())
    root = tempfile.mkdtemp(prefix="equiaudit-store-")
    for name in ("fairness_report", "issues", "group_sizes"):
        store.write_audit_table(out[name].withColumn("run_id", F.lit("r1")), root, name)
    back = store.read_audit_table(spark, root, "fairness_report", "r1")
    assert back.count() == out["fairness_report"].count()


def test_split_counts(spark):
    o = spark.read.parquet(f"{SF0001}/orders.parquet").select("o_orderkey", "o_orderstatus")
    c = {r.split: r.n for r in split_counts(stratified_split(o, ["o_orderkey"], "o_orderstatus")).collect()}
    n = o.count()
    assert c["test"] == -(-n // 4) and c["train"] == n - c["test"]


def test_whole_audit_many_runs(spark):
    runs = fx.scored_lineitems(spark, SF0001, with_run=True)
    last = [r.run_id for r in runs.select("run_id").distinct().orderBy(F.desc("run_id")).limit(2).collect()]
    runs = runs.where(F.col("run_id").isin(last))
    spec = AuditSpec(positive_label="good", sensitive_cols=fx.SENSITIVE, fairness_threshold=0.05)
    out = audit.run_audit(runs, spec, fx.FEATURES, by=["run_id"])
    n_runs = runs.select("run_id").distinct().count()
    assert out["accuracy"].count() == n_runs
    flags = out["disparity"]
    assert flags.select("run_id").distinct().count() == n_runs
    assert flags.groupBy("run_id").count().where("count != 12").count() == 0  # 4 attributes x 3 metrics
    plan_runs = {r.run_id for r in out["plan"].select("run_id").distinct().collect()}
    flagged_runs = {r.run_id for r in flags.where("flag").select("run_id").distinct().collect()}
    assert plan_runs == flagged_runs
    status = out["diagnostics_status"]
    assert {r.run_id for r in status.select("run_id").distinct().collect()} == plan_runs
    assert status.count() == out["plan"].count()
    acc = {r.run_id: r.accuracy for r in out["accuracy"].collect()}
    direct = {r.run_id: r.accuracy for r in runs.groupBy("run_id").agg(
        F.avg((F.col("y_true") == F.col("y_pred")).cast("int")).alias("accuracy")).collect()}
    assert acc == pytest.approx(direct)


def test_audit_from_config_to_written_tables(spark, tmp_path):
    """The credit file with its features, from reading to diagnostics; numbers follow from the written rows."""
    import pandas as pd

    path = str(tmp_path / "credit.csv")
    pd.read_csv(CREDIT_CSV).drop(columns=["row_index", "y_pred", "y_score"]).to_csv(path, index=False)
    spec = AuditSpec.from_dict({
        "label_col": "y_true", "positive_label": "good", "sensitive_cols": ["sex"], "test_size": 0.4,
        "model": {"max_iter": 60}, "diagnostics": {"run_slice_scan": {"top": 2}},
        "dataset": {"path": path}})
    out = audit.audit_dataset(spark, spec, str(tmp_path), "007")
    m = out["metrics"].first()
    scored = [tuple(r) for r in out["scored"].select("y_true", "y_pred", "sex").collect()]
    assert m.run_id == "007" and m.n_test == len(scored) == 100 and m.n_train == 150
    assert list(m.model_classes) == ["bad", "good"] and list(m.sensitive_cols) == ["sex"]
    assert m.accuracy == pytest.approx(sum(a == b for a, b, _ in scored) / 100) and m.accuracy > 0.6
    rates = {g: sum(p == "good" for _, p, s in scored if s == g) / sum(s == g for *_, s in scored) for g in ("female", "male")}
    got = {r.group: r.value for r in out["fairness_report"].where("metric = 'selection_rate'").collect()}
    assert got == pytest.approx(rates)
    if "slice_scan__all" in out:
        assert out["slice_scan__all"].count() == 2
    assert store.read_audit_table(spark, str(tmp_path), "features").count() == 100
    with pytest.raises(ValueError, match="model type"):
        audit.audit_dataset(spark, AuditSpec(model_type="forest"), str(tmp_path), "x")
