"""Row numbers that follow the files; runs that appear whole; documents there and back."""

import json

import pytest
from pyspark.sql import functions as F

from equiaudit.operators.split import stratified_split
from equiaudit.plans import audit
from equiaudit.plans import fixtures as fx
from equiaudit.sources import audit_store as store
from equiaudit.sources import documents
from equiaudit.sources.row_numbers import number_rows
from equiaudit.spec import AuditSpec
from paths import CREDIT_CSV, SF0001


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("rows") / "csv")
    spark.range(20_000, numPartitions=3).select("id", (F.col("id") % 2).alias("y"), F.sha2(F.col("id").cast("string"), 256)
                                                 .alias("t")).write.csv(path, header=True)
    return path


@pytest.mark.parametrize("size", ["1g", "400k", "50k"])
def test_rows_and_split_do_not_follow_the_partitioning(spark, files, size):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    try:
        df = spark.read.csv(files, header=True, inferSchema=False).where("y is not null")
        rows = number_rows(df)
        assert rows.columns == ["id", "y", "t", "row_index"]
        n = rows.agg(F.min("row_index"), F.max("row_index"), F.countDistinct("row_index")).first()
        assert tuple(n) == (0, 19_999, 20_000)
        # the three files hold the ids in order
        assert rows.where(F.col("id").cast("long") != F.col("row_index")).count() == 0
        test = stratified_split(rows, ["row_index"], "y").where("is_test")
        assert test.agg(F.sum(F.col("id").cast("long"))).first()[0] == _SPLIT.setdefault(
            "sum", test.agg(F.sum(F.col("id").cast("long"))).first()[0])
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


_SPLIT: dict = {}


def test_empty_and_single_files(spark, tmp_path):
    path = str(tmp_path / "one")
    spark.range(5, numPartitions=1).write.parquet(path)
    assert sorted(r.row_index for r in number_rows(spark.read.parquet(path)).collect()) == list(range(5))
    assert number_rows(spark.read.parquet(path).where("id > 9")).count() == 0


def test_a_run_appears_whole_or_not_at_all(spark, tmp_path):
    root = str(tmp_path)
    assert store.committed_runs(spark, root).count() == 0
    first = store.RunWriter(spark, root, "007")
    kept = first.write(spark.range(3), "scored")
    assert kept.count() == 3 and {r.run_id for r in kept.collect()} == {"007"}
    first.write(spark.range(2), "issues")
    assert store.read_audit_table(spark, root, "scored").count() == 0  # interrupted here, it is not seen
    first.commit()
    assert store.read_audit_table(spark, root, "scored", "007").count() == 3
    again = store.RunWriter(spark, root, "007")
    again.write(spark.range(50), "scored")
    assert store.read_audit_table(spark, root, "scored", "007").count() == 3  # as it was
    other = store.RunWriter(spark, root, "b c/d")
    assert other.write(spark.range(4), "scored").count() == 4
    other.commit()
    again.commit()
    got = {r.run_id: r.n for r in store.read_audit_table(spark, root, "scored").groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n")).collect()}
    assert got == {"007": 50, "b c/d": 4}
    # the second attempt had no issues: those of the first are gone with it
    assert store.read_audit_table(spark, root, "issues").count() == 0
    assert [tuple(r) for r in store.stored_catalogue(spark, root, ["scored", "issues"]).collect()] == [
        ("b c/d", True, False), ("007", True, False)]


@pytest.fixture(scope="module")
def tables(spark):
    runs = fx.scored_lineitems(spark, SF0001, with_run=True).where("run_id in ('1996', '1999')")
    spec = AuditSpec(positive_label="good", sensitive_cols=fx.SENSITIVE, fairness_threshold=0.05)
    out = audit.run_audit(runs, spec, ["l_quantity", "l_returnflag"], by=["run_id"])
    out["metrics"] = store.run_metrics(runs, label_col="y_true", positive_label="good", sensitive_cols=fx.SENSITIVE)
    return out, spec


def test_documents_there_and_back(spark, tables, tmp_path):
    out, spec = tables
    docs = documents.run_documents(out, spec).cache()
    documents.write_documents(docs, str(tmp_path))
    back = documents.read_documents(spark, str(tmp_path))
    assert sorted(map(str, back.collect())) == sorted(map(str, docs.select(*back.columns).collect()))
    assert documents.read_documents(spark, str(tmp_path), "1996").count() == 1
    doc = docs.where("run_id = '1996'").first().document
    text = json.loads(docs.where("run_id = '1996'").select(F.to_json("document")).first()[0])
    assert list(text["fairness_report"]) == sorted(fx.SENSITIVE) and doc.metrics.n_test == 920
    assert all(list(g) == sorted(g) for g in text["group_sizes"].values())
    assert doc.audit_config.fairness_threshold == 0.05 and doc.audit_config.dataset.path is None
    status = {(r.tool, r.attribute): r for r in out["diagnostics_status"].where("run_id = '1996'").collect()}
    assert {(e.tool, e.attribute) for e in doc.diagnostics_run_summary.executed} == {
        k for k, r in status.items() if r.status != "error"}
    assert [(p.tool, p.attribute or "") for p in doc.plan] == sorted((p.tool, p.attribute or "") for p in doc.plan)


def test_every_scalar_of_a_document_is_evidence(spark, tables):
    out, spec = tables
    rows = documents.flattened(documents.run_documents(out, spec)).where("run_id = '1999'").collect()
    found = {r.path: r for r in rows}
    assert len(found) == len(rows)
    for r in out["disparity"].where("run_id = '1999'").collect():
        at = f"fairness_report.{r.attribute}"
        assert found[f"{at}.difference.{r.metric}"].number == r.difference
        assert found[f"{at}.flags.{r.metric}"].value == str(r.flag).lower()
    assert found["audit_config.model.type"].value == "logistic_regression"
    assert found["metrics.sensitive_cols.0"].value == fx.SENSITIVE[0]
    assert {r.value for r in rows if r.path.startswith("plan.") and r.path.endswith(".tool")} == {
        r.tool for r in out["plan"].where("run_id = '1999'").collect()}


def test_flattening_any_nesting(spark):
    df = spark.sql("""select 'r' as run_id, named_struct('a', map('k', array(1, null, 3)), 'b', named_struct('c', 0.5D),
                      'd', cast(null as array<int>), 'e', map('x', cast(null as map<string, int>)), 'f', true) as document""")
    got = sorted((r.path, r.value, r.number) for r in documents.flattened(df).collect())
    assert got == [("a.k.0", "1", 1.0), ("a.k.2", "3", 3.0), ("b.c", "0.5000", 0.5), ("f", "true", None)]


def test_no_tables_no_documents(spark):
    with pytest.raises(ValueError, match="no table"):
        documents.run_documents({}, AuditSpec())


def test_audit_commits_its_run(spark, tmp_path):
    import pandas as pd

    path = str(tmp_path / "credit.csv")
    pd.read_csv(CREDIT_CSV).drop(columns=["row_index", "y_pred", "y_score"]).to_csv(path, index=False)
    spec = AuditSpec.from_dict({"label_col": "y_true", "positive_label": "good", "sensitive_cols": ["sex"],
                                "model": {"max_iter": 30}, "dataset": {"path": path}})
    root = str(tmp_path / "store")
    out = audit.audit_dataset(spark, spec, root, "r1")
    cat = store.stored_catalogue(spark, root, ["metrics", "evidence", "disparity"]).collect()
    assert [tuple(r) for r in cat] == [("r1", True, True, True)]
    doc = documents.read_documents(spark, root, "r1").first().document
    assert doc.metrics.n_test == out["scored"].count() and doc.audit_config.dataset.path == path
    assert out["evidence"].where("path = 'metrics.n_test'").first().number == doc.metrics.n_test
    assert out["sketches"].count() == 21  # the features and age_group
