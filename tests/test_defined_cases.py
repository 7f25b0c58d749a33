"""Cases that ordinary data do not show: odd values, odd files, odd labels."""

import pytest
from pyspark.sql import functions as F

from equiaudit.functions import coerce_numeric, value_map
from equiaudit.operators import derive, issues, model, ranking, shift, split
from equiaudit.sources import audit_store
from equiaudit.sources.readers import read_dataset, schema_columns
from equiaudit.spec import DatasetSpec, validate_binary_label


@pytest.fixture()
def text_file(tmp_path):
    def make(name, text):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    return make


def test_reader_types_and_missing_tokens(spark, text_file):
    path = text_file("a.csv", "i,d,b,s,suffix,gap\n1,1.5,True,x,1d,NA\n2,n/a,False,NaN,2f,\n-3,2e3,TRUE,y,3,?\n")
    df = read_dataset(spark, DatasetSpec(path=path, columns=("other",) * 6, na_values=("?",)))
    assert dict(df.dtypes) == {"i": "bigint", "d": "double", "b": "boolean", "s": "string", "suffix": "string", "gap": "string"}
    assert [tuple(r) for r in df.orderBy("i").collect()] == [
        (-3, 2000.0, True, "y", "3", None), (1, 1.5, True, "x", "1d", None), (2, None, False, None, "2f", None)]


def test_boolean_column_with_a_gap_stays_text(spark, text_file):
    df = read_dataset(spark, DatasetSpec(path=text_file("b.csv", "b,x\nTrue,1\n,2\n")))
    assert dict(df.dtypes)["b"] == "string"


def test_regex_separator_with_and_without_header(spark, text_file, tmp_path):
    for n in (1, 2):
        text_file(f"part{n}.txt", f"a   b  c\n{n}  x\t1\n\n  {n}   \"q\" 2\n")
    df = read_dataset(spark, DatasetSpec(path=str(tmp_path / "part*.txt"), format="delimited", sep=r"\s+", header=True))
    assert df.columns == ["a", "b", "c"]
    assert sorted(map(tuple, df.collect())) == [(1, '"q"', 2), (1, "x", 1), (2, '"q"', 2), (2, "x", 1)]
    schema = text_file("schema.json", '{"columns": ["u", "v"]}')
    df = read_dataset(spark, DatasetSpec(path=text_file("c.data", "1 2\n3 4\n"), schema_path=schema))
    assert df.columns == ["u", "v"] and df.count() == 2
    with pytest.raises(ValueError, match="columns"):
        schema_columns(spark, text_file("bad.json", '{"columns": [1]}'))
    with pytest.raises(ValueError, match="header"):
        read_dataset(spark, DatasetSpec(path=text_file("d.data", "1 2\n")))


def test_numbers_and_maps(spark):
    df = spark.createDataFrame([("1d",), ("2f",), (" 3 ",), ("inf",), ("nan",), (".5e1",), ("x",), (None,)], "s string")
    assert [r[0] for r in df.select(coerce_numeric("s")).collect()] == [None, None, 3.0, float("inf"), None, 5.0, None, None]
    one = spark.createDataFrame([(1,)], "k int")
    assert one.select(value_map("k", {1: "a", "1": "b"})).first()[0] == "b"
    table = spark.createDataFrame([("1", "b"), ("1", "a"), (None, "z")], "key string, value string")
    assert derive.map_by_join(one, "k", table, "out").first()["out"] == "a"


def test_label_error_counts_all_values(spark):
    df = spark.range(150).select((F.col("id") % 130).alias("y"))
    with pytest.raises(ValueError, match="it has 130: .*and more"):
        validate_binary_label(df, "y")
    with pytest.raises(ValueError, match=r"it has 4: \['0', '1', '2', '3'\]"):
        validate_binary_label(df.where("id < 4"), "y")


def test_infinite_scores_rank(spark):
    df = spark.createDataFrame([(float("inf"), 1), (1.0, 1), (0.5, 0), (float("-inf"), 0), (None, 1), (float("nan"), 0)],
                               "s double, y int")
    assert ranking.auc(df, F.col("y"), "s", buckets=4).first()["auc"] == 1.0


def test_shift_with_one_kind_of_feature(spark):
    df = spark.createDataFrame([("a", 1.0, "x"), ("b", 2.0, "y")], "g string, n double, c string")
    assert shift.feature_distribution(df, "g", ["n"])["categorical"].collect() == []
    assert shift.feature_distribution(df, "g", ["c"])["numeric"].collect() == []
    assert shift.top_values(df, "g", []).columns == ["feature", "group", "value", "share", "rank"]


def test_null_evidence_is_reported(spark):
    rows = [(1, "a", "selection_rate", "disparity", "severe", ["x", None]), (2, "a", "selection_rate", "disparity", "severe", ["x"])]
    df = spark.createDataFrame(rows, "record_id int, attribute string, metric string, issue_type string, severity string, "
                                     "evidence array<string>")
    assert [r["record_id"] for r in issues.issue_record_errors(df).collect()] == [1]


def test_split_tells_null_keys_apart(spark):
    df = spark.createDataFrame([(None, "a"), ("a", None)], "x string, y string")
    assert df.select(split.row_hash(["x", "y"], 1)).distinct().count() == 2


def test_run_ids_stay_text(spark, tmp_path):
    df = spark.createDataFrame([("007", 1), ("7", 2), ("r1", 3)], "run_id string, x int")
    audit_store.write_audit_table(df.where("run_id != 'r1'"), str(tmp_path), "t")
    assert audit_store.read_audit_table(spark, str(tmp_path), "t", "007").collect()[0]["x"] == 1
    audit_store.write_audit_table(df.where("run_id = 'r1'"), str(tmp_path), "t")  # the other runs stay
    assert sorted(r["run_id"] for r in audit_store.read_audit_table(spark, str(tmp_path), "t").collect()) == ["007", "7", "r1"]
    assert spark.conf.get("spark.sql.sources.partitionOverwriteMode").lower() == "static"


@pytest.fixture(scope="module")
def two_classes(spark):
    return spark.range(200).select(
        (F.col("id") / 10.0).alias("x"), F.when(F.col("id") < 100, "<=50K").otherwise(">50K").alias("y")).persist()


@pytest.mark.parametrize("label, rising", [(">50K", True), ("<=50K", False), ("unknown", True)])
def test_scores_follow_the_configured_class_or_the_second(two_classes, label, rising):
    m = model.fit(two_classes, ["x"], "y", label, ["<=50K", ">50K"], max_iter=50)
    got = m.score(two_classes.withColumn("x0", F.col("x")), keep=["x0", "y"]).orderBy("x0").collect()
    assert sum(r["y"] == r["y_pred"] for r in got) >= 196
    assert (got[-1]["y_score"] > got[0]["y_score"]) is rising


def test_proxy_names_the_true_number_of_groups(spark):
    df = spark.range(300).select((F.col("id") % 50).cast("string").alias("g"), F.col("id").cast("double").alias("x"))
    got = model.proxy_detection(df, "g", ["x"])
    assert got["status"] == "unsupported" and got["n_classes"] == 50 and "50" in got["error"]
