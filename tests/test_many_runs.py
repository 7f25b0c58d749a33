"""Operators that work on many runs at once give each run what it gets alone; batched fits agree with pyspark.ml."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from equiaudit.operators import logistic, profile, ranking, shift, slices
from equiaudit.plans import fixtures as fx
from paths import SF0001

RUNS = ["1995", "1996", None]


@pytest.fixture(scope="module")
def scored(spark):
    """Scored rows of a few runs, one of them without a name, with gaps."""
    rows = fx.scored_lineitems(spark, SF0001, with_run=True)
    rows = rows.withColumn("run_id", F.when(F.col("run_id") == "1997", F.lit(None)).otherwise(F.col("run_id")))
    rows = rows.where(F.col("run_id").isNull() | F.col("run_id").isin("1995", "1996"))
    key = F.col("l_orderkey") + F.col("l_linenumber")
    return rows.withColumn("c_acctbal", F.when(key % 9 == 0, None).otherwise(F.col("c_acctbal"))).withColumn(
        "o_orderpriority", F.when(key % 7 == 0, None).otherwise(F.col("o_orderpriority"))).withColumn(
        "l_tax", F.when(F.col("run_id") == "1996", F.lit(0.5)).otherwise(F.col("l_tax"))).cache()


def _of(df, run):
    return df.where(F.col("run_id").eqNullSafe(F.lit(run))).drop("run_id")


def _set(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("name", ["slices", "numeric", "categorical", "top", "cardinality"])
def test_each_run_gets_what_it_gets_alone(scored, name):
    num, cat, dt = shift.split_feature_types(scored, fx.FEATURES)
    op = {
        "slices": lambda d, **k: slices.slice_scan(d, fx.FEATURES, fx.POSITIVE, **k),
        "numeric": lambda d, **k: shift.numeric_shift(d, "segment", num, **k).select(
            *k.get("by", []), "rank", "feature", "group_a", "group_b", F.round("mean_a", 6), F.round("mean_b", 6)),
        "categorical": lambda d, **k: shift.categorical_shift(d, "segment", cat + dt, **k).withColumn(
            "total_variation_distance", F.round("total_variation_distance", 9)),
        "top": lambda d, **k: shift.top_values(d, "segment", cat + dt, **k),
        "cardinality": lambda d, **k: slices.column_cardinality(d, fx.FEATURES, **k),
    }[name]
    every = op(scored, by=["run_id"]).cache()
    assert {r.run_id for r in every.select("run_id").distinct().collect()} == set(RUNS)
    for run in RUNS:
        assert _set(_of(every, run)) == _set(op(_of(scored, run)))
    assert op(scored.limit(0), by=["run_id"]).count() == 0


def test_a_column_may_be_narrow_in_one_run_only(scored):
    card = slices.column_cardinality(scored, fx.FEATURES, by=["run_id"]).where("feature = 'l_tax'").collect()
    assert [(r.run_id, r.n_distinct) for r in card] == [("1996", 1)]
    assert slices.slice_scan(scored, ["l_tax"], fx.POSITIVE, by=["run_id"]).select("run_id").distinct().count() == 1


def test_sketches_of_runs_merge_without_their_rows(scored):
    kept = slices.column_sketches(scored, fx.FEATURES, by=["run_id"])
    assert kept.count() == len(RUNS) * len(fx.FEATURES)
    together = {r.feature: r for r in slices.estimated_distinct(slices.merged_sketches(kept)).collect()}
    for c in ("l_returnflag", "o_orderpriority", "l_tax", "l_discount"):
        true = scored.select(c).distinct().count()
        assert together[c].n_distinct == true and together[c].n == scored.count()
    given = slices.slice_scan(scored, fx.FEATURES, fx.POSITIVE, by=["run_id"], sketches=kept)
    assert _set(given) == _set(slices.slice_scan(scored, fx.FEATURES, fx.POSITIVE, by=["run_id"]))
    assert slices.column_sketches(scored, [], by=["run_id"]).count() == 0


FEATURES = ["l_quantity", "c_acctbal", "l_tax", "o_totalprice", "o_orderpriority", "l_returnflag"]


def test_batched_fits_agree_with_pyspark_ml(scored):
    attributes = ["status", "segment", "o_orderstatus"]
    rows = scored.withColumn("o_orderstatus", F.when(F.col("run_id") == "1996", F.lit("F")).otherwise(
        F.when(F.col("o_orderkey") % 2 == 0, "F").otherwise("O"))) if "o_orderkey" in scored.columns else \
        scored.withColumn("o_orderstatus", F.when(F.col("run_id") == "1996", F.lit("F")).otherwise(
            F.when(F.col("l_orderkey") % 2 == 0, "F").otherwise("O")))
    classes = logistic.attribute_classes(rows, attributes, ["run_id"]).cache()
    d = logistic.design(rows, attributes, FEATURES, classes, ["run_id"])
    weights = logistic.fit_all(d)
    rid = {r.rid: r.run_id for r in d.runs.collect()}
    assert {(rid[r], attributes[a]) for r, a in weights} == {
        (r.run_id, r.attribute) for r in classes.where("n_classes = 2").collect()}
    assert not any(attributes[a] == "segment" for _, a in weights)
    names = [f"x{i}" for i in range(len(d.numeric))] + [f"lv{i}" for i in range(len(d.levels))]
    cells = [F.col("x")[i].alias(f"x{i}") for i in range(len(d.numeric))] + [
        F.array_contains("levels", i).cast("double").alias(f"lv{i}") for i in range(len(d.levels))]
    for (r, a), w in weights.items():
        one = d.rows.where(F.col("rid") == r).select(F.col("y")[a].cast("double").alias("label"), *cells)
        data = VectorAssembler(inputCols=names, outputCol="features").transform(one).cache()
        m = LogisticRegression(regParam=1.0 / data.count(), standardization=False, tol=1e-14, maxIter=3000).fit(data)
        theirs = np.concatenate([[m.intercept], m.coefficients.toArray()])
        scale = np.concatenate([[1.0], [max(1.0, abs(v)) for v in theirs[1:]]])
        mine_p = logistic.scored_all(d, {(r, a): w}).agg(F.sum("score")).first()[0]
        assert abs(mine_p / data.count() - data.agg(F.avg("label")).first()[0]) < 1e-9  # the intercept's condition
        x = np.array([[1.0, *row.features.toArray()] for row in data.limit(200).collect()])
        assert np.abs(1 / (1 + np.exp(-x @ w)) - 1 / (1 + np.exp(-x @ theirs))).max() < 1e-6
        assert (np.abs(w - theirs) / scale)[1:].max() < 1e-4


def test_closed_form_of_one_two_valued_column(spark):
    """With one 0/1 column and next to no penalty the fit is the log odds of the two halves."""
    cells = [("a", "yes", 30), ("a", "no", 10), ("b", "yes", 15), ("b", "no", 45)]
    rows = [(c, y) for c, y, n in cells for _ in range(n * 50)]
    df = spark.createDataFrame(rows, "c string, y string")
    classes = logistic.attribute_classes(df, ["y"])
    d = logistic.design(df, ["y"], ["c"], classes)
    (w,) = logistic.fit_all(d).values()
    n = [1500, 500, 750, 2250]
    # the two weights are each other's negative: with the penalty w^2 / 2 each, the residual of a level equals its weight
    pa, pb = (1 / (1 + np.exp(-(w[0] + v))) for v in w[1:])
    assert abs((n[0] - (n[0] + n[1]) * pa) - w[1]) < 1e-8 and abs((n[2] - (n[2] + n[3]) * pb) - w[2]) < 1e-8
    assert abs(w[1] + w[2]) < 1e-8 and abs(w[0] + w[1] - np.log(3)) < 5e-3


def test_proxy_of_every_run_and_attribute(scored):
    out = logistic.proxy_by(scored, ["status", "segment"], FEATURES, by=["run_id"]).collect()
    assert len(out) == 2 * len(RUNS) and {r.run_id for r in out} == set(RUNS)
    for r in out:
        if r.attribute == "segment":
            assert (r.status, r.n_classes, r.auc) == ("unsupported", 5, None) and r.classes.count(",") == 4
        elif r.n_classes == 2:
            assert r.status == "ok" and 0.5 <= r.auc <= 1 and r.accuracy >= 0.5
        else:
            assert r.status == "unsupported"
    alone = logistic.proxy_by(_of(scored, None), ["status"], FEATURES).first()
    mine = next(r for r in out if r.run_id is None and r.attribute == "status")
    assert (alone.status, alone.n_classes) == (mine.status, mine.n_classes)
    if mine.auc is not None:
        assert abs(alone.auc - mine.auc) < 1e-9 and abs(alone.accuracy - mine.accuracy) < 1e-9
    with pytest.raises(ValueError, match="levels"):
        logistic.proxy_by(scored, ["status"], FEATURES, by=["run_id"], max_width=3)


def test_quantiles_by_brackets(spark):
    rng = np.random.default_rng(3)
    n = 60_000
    cols = {"a": rng.normal(size=n).round(3), "b": np.repeat([1.0, 2.0, 3.0], n // 3), "c": rng.exponential(size=n) * 1e9}
    df = spark.createDataFrame([(float(a), float(b), float(c)) for a, b, c in zip(*cols.values())], "a double, b double, c double")
    df = df.withColumn("d", F.lit(None).cast("double")).withColumn("e", F.when(F.col("a") > 2, F.col("a")))
    probs = (0.0, 0.25, 0.5, 0.999, 1.0)
    e = cols["a"][cols["a"] > 2]
    for inside in (profile.INSIDE, 50):  # the second: brackets are narrowed again and again
        got = {r.feature: r for r in profile.exact_quantiles(df, list("abcde"), probs, inside=inside).collect()}
        assert set(got) == set("abce")
        for name, v in {**cols, "e": e}.items():
            assert np.allclose([got[name][f"q{i}"] for i in range(5)], np.quantile(v, probs), rtol=1e-12, atol=1e-12)


def test_quantiles_shuffle_little(spark):
    """No exchange of all distinct values: the rows inside the brackets alone are dealt."""
    df = spark.range(200_000).select((F.xxhash64("id") / 1e9).alias("v0"))
    ranks, brackets = profile._first_brackets(df, 1, (0.5,))
    assert profile._inside(df, brackets).count() < 400


def test_auc_deals_records_once(spark):
    df = spark.range(5000).select((F.col("id") % 3 == 0).cast("int").alias("y"), (F.hash("id") % 100 / 7.0).alias("s"),
                                  (F.col("id") % 2).alias("g"))
    plan = ranking.auc(df, F.col("y"), "s", by=["g"])._jdf.queryExecution().executedPlan().toString()
    # one exchange of records, dealt by key and range, and one of the ranges' totals
    assert plan.count("Range (0, 5000") == 1 and plan.count("Exchange hashpartitioning(g") == 2
    assert plan.count("Exchange ") == 2


def test_auc_with_ties_and_infinite_scores(spark):
    rng = np.random.default_rng(8)
    s = np.concatenate([rng.integers(0, 6, 400) / 5, [np.inf] * 20, [-np.inf] * 20, [0.0, -0.0]])
    y = rng.integers(0, 2, len(s))
    wins = sum((a > s[y == 0]).sum() + 0.5 * (a == s[y == 0]).sum() for a in s[y == 1])
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(s, y)] + [(None, 1), (float("nan"), 0)], "s double, y int")
    for buckets in (1, 3, 50):
        got = ranking.auc(df.repartition(6), F.col("y"), "s", buckets=buckets).first()
        assert abs(got.auc - wins / ((y == 1).sum() * (y == 0).sum())) < 1e-12
        assert (got.n_pos, got.n_neg) == ((y == 1).sum(), (y == 0).sum())


def test_diagnostics_of_all_runs_together(scored):
    from equiaudit.operators import cube as cube_ops
    from equiaudit.plans.audit import AuditContext, run_diagnostics
    from equiaudit.spec import AuditSpec

    spark = scored.sparkSession
    spec = AuditSpec(positive_label=fx.POSITIVE, sensitive_cols=fx.SENSITIVE, fairness_threshold=0.05)
    rows = scored.withColumn("segment", F.when(F.col("run_id") == "1996", F.lit("one")).otherwise(F.col("segment")))
    cube = cube_ops.confusion_cube(rows, fx.SENSITIVE, fx.POSITIVE, by=["run_id"])
    plan = spark.createDataFrame(
        [(r, t, a) for r in RUNS for t, a in [
            ("check_group_sample_sizes", None), ("run_feature_distribution_comparison", "segment"),
            ("run_proxy_detection", "segment"), ("run_slice_scan", None), ("run_bias_probe", None),
            ("run_feature_distribution_comparison", "no_such_column")]] + [("1995", "run_threshold_sensitivity", "status")],
        "run_id string, tool string, attribute string")
    ctx = AuditContext(rows, spec, FEATURES, cube, None, ["run_id"])
    got = {(r.run_id, r.tool, r.attribute): r for r in run_diagnostics(ctx, plan).collect()}
    assert len(got) == plan.count()
    assert got["1996", "run_feature_distribution_comparison", "segment"].status == "error"
    assert got["1995", "run_feature_distribution_comparison", "segment"].status == "ok"
    assert {got[r, "run_proxy_detection", "segment"].status for r in RUNS} == {"unsupported"}
    assert {got[r, "run_bias_probe", None].error for r in RUNS} == {"no diagnostic named run_bias_probe"}
    assert {got[r, "run_feature_distribution_comparison", "no_such_column"].status for r in RUNS} == {"error"}
    assert [k for k in got if k[1] == "run_threshold_sensitivity"] == [("1995", "run_threshold_sensitivity", "status")]
    for run in RUNS:
        alone = slices.slice_scan(_of(rows, run), FEATURES, fx.POSITIVE)
        assert _set(_of(ctx.outputs["run_slice_scan", None, "slice_scan"], run)) == _set(alone)
        assert got[run, "run_slice_scan", None].n_rows == alone.count()


def test_blocks_hold_all_rows_of_their_run(spark):
    """Rows of many runs in any order, some runs of more than a block: blocks of one run each, nothing lost."""
    rows = spark.range(30_000).selectExpr("if(id < 20000, 0, id % 700) as rid", "array(cast(id % 2 as int), -1) as y",
                                          "array(cast(id as double)) as x", "array(cast(id % 5 as int) - 1) as levels")

    def look(batches):
        import pyarrow as pa

        for r, y, x in logistic._parts(batches, 1, 6):
            codes = (x[:, 2:] * [1, 2, 3, 4]).sum(axis=1) - 1
            yield pa.RecordBatch.from_arrays([pa.array([r] * len(x)), pa.array(x[:, 1]), pa.array(y[:, 0].astype(int)),
                                              pa.array(codes)], names=["rid", "x", "y", "code"])

    blocks = logistic._packed(rows.repartition(3))
    assert blocks.agg({"n": "max"}).first()[0] <= 4096
    got = blocks.mapInArrow(look, "rid long, x double, y long, code double")
    want = rows.selectExpr("rid", "x[0] as x", "cast(y[0] as long) as y", "cast(levels[0] as double) as code")
    assert got.count() == 30_000 and got.exceptAll(want).count() == 0


def test_ranges_follow_the_number_of_rows(spark, monkeypatch):
    """What a task sorts for the AUC is bounded, and the AUC does not depend on it."""
    from pyspark.sql import functions as F

    from equiaudit.operators import ranking

    df = spark.range(5_000).selectExpr("cast(pmod(hash(id), 997) as double) as s", "cast(id % 2 as int) as y")
    before = ranking.auc(df, F.col("y"), "s").first()
    monkeypatch.setattr(ranking, "RANGE_ROWS", 100)
    assert len(ranking._ranges(df.selectExpr("s as __s"), 8)) >= 45
    assert ranking.auc(df, F.col("y"), "s").first() == before


def test_parts_follow_the_number_of_rows(spark, monkeypatch):
    """What a task sorts for the join of the scored rows is bounded; few rows are left to Spark."""
    from equiaudit.plans import fixtures as fx

    df = spark.range(1_000)
    assert fx.by_parts(df, "id", df) is df
    monkeypatch.setattr(fx, "PART_ROWS", 10)
    dealt = fx.by_parts(df, "id", df)
    assert dealt.rdd.getNumPartitions() == 100 and dealt.count() == 1_000
