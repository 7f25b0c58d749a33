"""Readers, preparation and the run-partitioned audit store."""

import json
import os
import tempfile

from pyspark.sql import functions as F

from equiaudit.sources import audit_store as store
from equiaudit.sources.readers import feature_columns, prepare, read_dataset
from equiaudit.spec import AuditSpec, DatasetSpec, infer_format


def _tmp():
    return tempfile.mkdtemp(prefix="equiaudit-test-")


def test_regex_delimited_with_schema_and_na(spark):
    d = _tmp()
    data = os.path.join(d, "credit.data")
    with open(data, "w") as f:
        f.write("A11  6 A34 1169 A93 67 1\nA12 48 A32 5951 A92 22 2\n A14 12 ? 2096 A93 49 1\n")
    schema = os.path.join(d, "schema.json")
    with open(schema, "w") as f:
        json.dump({"columns": ["checking", "duration", "history", "amount", "pss", "age", "credit_risk"]}, f)
    cfg = {
        "dataset": {"path": data, "format": "delimited", "sep": r"\s+", "header": False, "schema_path": schema,
                    "na_values": ["?"]},
        "label_col": "credit_risk", "positive_label": "good", "label_map": {"1": "good", "2": "bad"},
        "sensitive_cols": ["sex", "age_group"],
        "derived_columns": {
            "sex": {"type": "map", "source": "pss", "mapping": {"A92": "female", "A93": "male"}},
            "age_group": {"type": "bin", "source": "age", "bins": [0, 25, 40, 60, 120],
                          "labels": ["young", "adult", "middle", "senior"]},
        },
    }
    spec = AuditSpec.from_dict(cfg)
    df = read_dataset(spark, spec.dataset)
    types = dict(df.dtypes)
    assert types["duration"] == "bigint" and types["checking"] == "string"
    rows = df.orderBy("amount").collect()
    assert rows[1].history is None and rows[1].checking == "A14"  # "?" is missing
    prepared = prepare(df, spec).orderBy("amount").collect()
    assert [(r.credit_risk, r.sex, r.age_group) for r in prepared] == [
        ("good", "male", "senior"), ("good", "male", "middle"), ("bad", "female", "young")]
    assert feature_columns(prepare(df, spec), "credit_risk", ["sex", "age_group"])[-2:] == ["pss", "age"]


def test_csv_and_format_inference(spark):
    d = _tmp()
    p = os.path.join(d, "x.csv")
    with open(p, "w") as f:
        f.write("a,b,c\n1,2.5,x\n3,,y\n")
    df = read_dataset(spark, DatasetSpec(path=p))
    assert dict(df.dtypes) == {"a": "bigint", "b": "double", "c": "string"}
    assert infer_format("f.tsv", None) == "tsv" and infer_format("f.data", "") == "delimited"
    assert infer_format("f.bin", None) == "csv" and infer_format("f.csv", "TSV") == "tsv"


def test_audit_store_partitions_by_run(spark):
    root = _tmp()
    a = spark.createDataFrame([("r1", "x", 1), ("r2", "y", 2)], "run_id string, k string, v int")
    store.write_audit_table(a, root, "t")
    store.write_audit_table(spark.createDataFrame([("r2", "z", 3)], "run_id string, k string, v int"), root, "t")
    got = store.read_audit_table(spark, root, "t")
    assert sorted((r.run_id, r.k) for r in got.collect()) == [("r1", "x"), ("r2", "z")]
    one = store.read_audit_table(spark, root, "t", "r1")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and one.count() == 1
    cat = store.run_catalogue({"t": got, "u": got.where("run_id = 'r1'")})
    assert {(r.run_id, r.has_t, r.has_u) for r in cat.collect()} == {("r1", True, True), ("r2", True, False)}
    csv = store.write_rates_csv(got.where(F.col("run_id") == "r1"), os.path.join(root, "rates_csv"))
    assert spark.read.option("header", True).csv(csv).count() == 1


def test_report_json_and_evidence(spark):
    from equiaudit.operators import cube as cube_ops
    from equiaudit.operators import rates as rate_ops

    rows = [("r1", "good", "good", "a"), ("r1", "bad", "good", "b"), ("r1", "good", "bad", "b"),
            ("r2", "good", "good", "a"), ("r2", "bad", "bad", "a")]
    df = spark.createDataFrame(rows, "run_id string, y_true string, y_pred string, g string")
    cube = cube_ops.confusion_cube(df, ["g"], "good", by=["run_id"])
    rates = rate_ops.group_rates(cube, ["run_id"])
    flags = rate_ops.disparity_flags(rate_ops.disparity(rates, ["run_id"]), 0.05)
    out = {r.run_id: json.loads(r.json) for r in store.report_json(rates, flags, ["run_id"]).collect()}
    assert out["r1"]["by_group"]["selection_rate"] == {"a": 1.0, "b": 0.5}
    assert out["r1"]["difference"]["selection_rate"] == 0.5 and out["r1"]["flags"]["selection_rate"] is True
    assert out["r2"]["by_group"]["true_positive_rate"] == {"a": 1.0}
    metrics = store.run_metrics(df, label_col="y_true", positive_label="good", sensitive_cols=["g"], cube=cube)
    m = {r.run_id: (r.accuracy, r.n_test) for r in metrics.collect()}
    assert m == {"r1": (1 / 3, 3), "r2": (1.0, 2)}
    cat = store.run_catalogue({"metrics": metrics, "issues": flags.where("flag")})
    ev = store.evidence_table(metrics, rate_ops.disparity(rates, ["run_id"]), cube_ops.group_sizes(cube, ["run_id"]),
                              cat, ["metrics", "issues"])
    missing = {(r.run_id, r.value) for r in ev.where("path = 'missing'").collect()}
    assert missing == {("r2", "issues")}
    assert {r.value for r in ev.where("path = 'metrics.accuracy'").collect()} == {"0.3333", "1.0000"}


def test_tsv_by_extension(spark):
    d = _tmp()
    p = os.path.join(d, "x.tsv")
    with open(p, "w") as f:
        f.write("id\tscore\tgroup\n1\t0.5\ta\n2\tNA\tb\n")
    df = read_dataset(spark, DatasetSpec(path=p, na_values=["NA"]))
    assert dict(df.dtypes) == {"id": "bigint", "score": "double", "group": "string"}
    assert [r.score for r in df.orderBy("id").collect()] == [0.5, None]
