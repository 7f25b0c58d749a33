"""Registered audit queries over the generated test tables.

Each entry takes ``(spark, sf_dir)`` and returns a DataFrame; the library
operators do the work, this module only wires inputs and names outputs so
they line up with the SQL in :mod:`equiaudit.plans.oracle`.
Doubles that come from float sums (means, deviations, quantiles) are rounded
to 6 places at this presentation layer only; rates are ratios of counts and
stay exact.
"""

from __future__ import annotations

import uuid
from typing import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from equiaudit import constants as C
from equiaudit import spec as spec_ops
from equiaudit.functions import coerce_numeric, na_tokens, positive_flag, right_closed_bins, risk_band, value_map
from equiaudit.functions import issue_type as issue_type_of
from equiaudit.operators import cube as cube_ops
from equiaudit.operators import issues as issue_ops
from equiaudit.operators import logistic
from equiaudit.operators import model as model_ops
from equiaudit.operators import profile, ranking, shift, slices, split, thresholds
from equiaudit.operators import rates as rate_ops
from equiaudit.plans import audit as audit_ops
from equiaudit.plans import diagnostic_rules as rules
from equiaudit.plans import fixtures as fx
from equiaudit.session import cut_lineage, ensure_checkpoint_dir
from equiaudit.sources import audit_store as store
from equiaudit.sources import documents
from equiaudit.sources.readers import feature_columns, prepare, read_dataset
from equiaudit.sources.row_numbers import number_rows
from equiaudit.spec import AuditSpec, DatasetSpec

THRESHOLD = C.DEFAULT_FAIRNESS_THRESHOLD
Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(name: str):
    def deco(fn: Query) -> Query:
        REGISTRY[name] = fn
        return fn
    return deco


def _cube(spark, sf_dir, with_run: bool = False, cuts=None, shared: bool = False):
    """The confusion cube of the scored view.

    ``shared``: several tables are derived from the cube.  Catalyst pushes each
    consumer's filters into the cube's aggregation, so the branches would not
    share one plan and each would re-read the scored rows; the (tiny) cube is
    instead written once to the checkpoint folder and read by every branch.
    """
    scored = fx.scored_lineitems(spark, sf_dir, with_run=with_run)
    by = ["run_id"] if with_run else []
    cube = cube_ops.confusion_cube(scored, fx.SENSITIVE, fx.POSITIVE, score="y_score" if cuts else None,
                                   cuts=cuts, by=by)
    return cut_lineage(cube) if shared else cube


def _rates(spark, sf_dir):
    return rate_ops.group_rates(_cube(spark, sf_dir))


# ---------------------------------------------------------------- E1-E5, H1, H7, H8, C5, F1, E15

@query("group_sizes")
def q_group_sizes(spark, sf_dir):
    return cube_ops.group_sizes(_cube(spark, sf_dir))


@query("confusion_by_group")
def q_confusion_by_group(spark, sf_dir):
    return cube_ops.confusion_counts(_cube(spark, sf_dir))


@query("group_rates")
def q_group_rates(spark, sf_dir):
    return _rates(spark, sf_dir)


@query("disparity")
def q_disparity(spark, sf_dir):
    return rate_ops.disparity(_rates(spark, sf_dir))


@query("disparity_flags")
def q_disparity_flags(spark, sf_dir):
    d = rate_ops.disparity_flags(rate_ops.disparity(_rates(spark, sf_dir)), THRESHOLD)
    return d.select("attribute", "metric", "difference", "flag")


@query("fairness_report")
def q_fairness_report(spark, sf_dir):
    return rate_ops.fairness_report(_rates(spark, sf_dir), THRESHOLD)


@query("findings")
def q_findings(spark, sf_dir):
    flags = rate_ops.disparity_flags(rate_ops.disparity(_rates(spark, sf_dir)), THRESHOLD)
    return rate_ops.findings(flags, fx.SENSITIVE)


@query("accuracy")
def q_accuracy(spark, sf_dir):
    return rate_ops.accuracy(fx.scored_lineitems(spark, sf_dir))


@query("rates_pivot")
def q_rates_pivot(spark, sf_dir):
    return rate_ops.rates_pivot(rate_ops.fairness_report(_rates(spark, sf_dir), THRESHOLD))


@query("small_groups")
def q_small_groups(spark, sf_dir):
    return rate_ops.small_groups(cube_ops.group_sizes(_cube(spark, sf_dir)), C.DEFAULT_MIN_GROUP_SIZE)


@query("largest_groups")
def q_largest_groups(spark, sf_dir):
    return rate_ops.largest_groups(cube_ops.group_sizes(_cube(spark, sf_dir)), 2)


# ---------------------------------------------------------------- H2, F5, E10, H6


@query("threshold_sensitivity")
def q_threshold_sensitivity(spark, sf_dir):
    return thresholds.threshold_sensitivity(_cube(spark, sf_dir, cuts=C.DEFAULT_CUTS), C.DEFAULT_CUTS)


@query("best_threshold")
def q_best_threshold(spark, sf_dir):
    sweep = thresholds.threshold_sensitivity(_cube(spark, sf_dir, cuts=C.DEFAULT_CUTS), C.DEFAULT_CUTS)
    return thresholds.best_threshold(sweep)


@query("auc")
def q_auc(spark, sf_dir):
    scored = fx.scored_lineitems(spark, sf_dir)
    return ranking.auc(scored, positive_flag("y_true", fx.POSITIVE), "y_score")


@query("risk_band")
def q_risk_band(spark, sf_dir):
    """Per-group AUC of the score (attribute, group) and its proxy-risk band."""
    scored = fx.scored_lineitems(spark, sf_dir)
    long = scored.select(
        *[F.col(a) for a in fx.SENSITIVE], "y_true", "y_score"
    ).unpivot(ids=["y_true", "y_score"], values=list(fx.SENSITIVE), variableColumnName="attribute",
              valueColumnName="group").where(F.col("group").isNotNull())
    a = ranking.auc(long, positive_flag("y_true", fx.POSITIVE), "y_score", by=["attribute", "group"])
    return a.select("attribute", "group", "auc", risk_band("auc").alias("risk_level"))


# ---------------------------------------------------------------- E9, H3, F4

@query("column_cardinality")
def q_column_cardinality(spark, sf_dir):
    return slices.column_cardinality(fx.scored_lineitems(spark, sf_dir), fx.FEATURES)


@query("slice_scan")
def q_slice_scan(spark, sf_dir):
    return slices.slice_scan(fx.scored_lineitems(spark, sf_dir), fx.FEATURES, fx.POSITIVE)


# ---------------------------------------------------------------- F1, E6-E8, H4

SHIFT_ATTR = "segment"


def _shift_inputs(spark, sf_dir):
    """The compared groups are chosen inside each query's own aggregation (groups=None)."""
    scored = fx.scored_lineitems(spark, sf_dir)
    num, cat, dt = shift.split_feature_types(scored, fx.FEATURES)
    return scored, None, num, cat + dt


@query("numeric_shift")
def q_numeric_shift(spark, sf_dir):
    scored, groups, num, _ = _shift_inputs(spark, sf_dir)
    out = shift.numeric_shift(scored, SHIFT_ATTR, num, groups)
    return out.select("rank", "feature", "group_a", "group_b", *[F.round(c, 6).alias(c) for c in
                                                                 ("mean_a", "mean_b", "abs_mean_diff")])


@query("top_values")
def q_top_values(spark, sf_dir):
    scored, groups, _, cat = _shift_inputs(spark, sf_dir)
    return shift.top_values(scored, SHIFT_ATTR, cat, groups)


@query("categorical_shift")
def q_categorical_shift(spark, sf_dir):
    scored, groups, _, cat = _shift_inputs(spark, sf_dir)
    out = shift.categorical_shift(scored, SHIFT_ATTR, cat, groups)
    return out.select("rank", "feature", "group_a", "group_b",
                      F.round("total_variation_distance", 9).alias("total_variation_distance"))


# ---------------------------------------------------------------- E9, F3, H3, E6, E8, H5 of all runs at once

RUN = ["run_id"]


@query("column_cardinality_by_run")
def q_column_cardinality_by_run(spark, sf_dir):
    return slices.column_cardinality(fx.scored_lineitems(spark, sf_dir, with_run=True), fx.FEATURES, by=RUN)


@query("column_cardinality_stored")
def q_column_cardinality_stored(spark, sf_dir):
    """E9 over all runs from their stored sketches: written by run, read and united without the records."""
    root = _scratch(spark, "sketches")
    store.write_audit_table(slices.column_sketches(fx.scored_lineitems(spark, sf_dir, with_run=True), fx.FEATURES, RUN),
                            root, "sketches")
    every = slices.estimated_distinct(slices.merged_sketches(store.read_audit_table(spark, root, "sketches")))
    return every.where(F.col("n_distinct") <= C.SLICE_MAX_DISTINCT).select("feature", "position", "n", "nulls", "n_distinct")


@query("slice_scan_by_run")
def q_slice_scan_by_run(spark, sf_dir):
    return slices.slice_scan(fx.scored_lineitems(spark, sf_dir, with_run=True), fx.FEATURES, fx.POSITIVE, by=RUN)


@query("numeric_shift_by_run")
def q_numeric_shift_by_run(spark, sf_dir):
    scored = fx.scored_lineitems(spark, sf_dir, with_run=True)
    out = shift.numeric_shift(scored, SHIFT_ATTR, shift.split_feature_types(scored, fx.FEATURES)[0], by=RUN)
    return out.select("run_id", "rank", "feature", "group_a", "group_b",
                      *[F.round(c, 6).alias(c) for c in ("mean_a", "mean_b", "abs_mean_diff")])


@query("categorical_shift_by_run")
def q_categorical_shift_by_run(spark, sf_dir):
    scored = fx.scored_lineitems(spark, sf_dir, with_run=True)
    _, cat, dt = shift.split_feature_types(scored, fx.FEATURES)
    out = shift.categorical_shift(scored, SHIFT_ATTR, cat + dt, by=RUN)
    return out.select("run_id", "rank", "feature", "group_a", "group_b",
                      F.round("total_variation_distance", 9).alias("total_variation_distance"))


#: Columns that do not hold the attribute itself, or nearly so.
PROXY_FEATURES = tuple(c for c in fx.FEATURES if c not in ("l_linestatus", "l_returnflag"))


@query("proxy_by_run")
def q_proxy_by_run(spark, sf_dir):
    """H5 of every run and two attributes, fitted together; segment has five groups and no model."""
    scored = fx.scored_lineitems(spark, sf_dir, with_run=True)
    return logistic.proxy_by(scored, ["status", "segment"], PROXY_FEATURES, by=RUN)


@query("diagnostics_by_run")
def q_diagnostics_by_run(spark, sf_dir):
    """H15 for all runs: each run's plan from its flags, every tool once for the runs that plan it."""
    scored = fx.scored_lineitems(spark, sf_dir, with_run=True)
    cube = cut_lineage(cube_ops.confusion_cube(scored, fx.SENSITIVE, fx.POSITIVE, score="y_score", cuts=C.DEFAULT_CUTS,
                                               by=RUN))
    flags = rate_ops.disparity_flags(rate_ops.disparity(rate_ops.group_rates(cube, RUN), RUN), THRESHOLD)
    spec = AuditSpec(positive_label=fx.POSITIVE, sensitive_cols=fx.SENSITIVE, fairness_threshold=THRESHOLD)
    ctx = audit_ops.AuditContext(scored, spec, PROXY_FEATURES, cube, tuple(C.DEFAULT_CUTS), RUN)
    return audit_ops.run_diagnostics(ctx, rules.diagnostic_plan(flags, None, by=RUN))


# ---------------------------------------------------------------- B1-B6, A5, C2


# Fixed values of the derivation queries.
STATUS_MAP = {"F": "closed", "O": "open"}
SECTOR_MAP = {"AUTOMOBILE": "industry", "BUILDING": "industry", "MACHINERY": "industry", "HOUSEHOLD": "consumer"}
PRICE_BINS = (0, 50000, 150000, 300000, 500000)
PRICE_LABELS = ("low", "mid", "high", "top")
TIER_MAP = {"low": "small", "mid": "small", "high": "big", "top": "big"}
PRIORITY_NA = ("4-NOT SPECIFIED", "5-LOW")


@query("label_map")
def q_label_map(spark, sf_dir):
    o = fx.table(spark, sf_dir, "orders")
    return o.select("o_orderkey", value_map("o_orderstatus", STATUS_MAP).alias("label"))


@query("derive_map")
def q_derive_map(spark, sf_dir):
    c = fx.table(spark, sf_dir, "customer")
    return c.select("c_custkey", value_map("c_mktsegment", SECTOR_MAP).alias("sector"))


@query("derive_bin")
def q_derive_bin(spark, sf_dir):
    o = fx.table(spark, sf_dir, "orders")
    return o.select("o_orderkey", right_closed_bins("o_totalprice", PRICE_BINS, PRICE_LABELS).alias("price_band"))


@query("positive_flag")
def q_positive_flag(spark, sf_dir):
    e = fx.table(spark, sf_dir, "events")
    return e.select("event_id", positive_flag("event_type", "purchase").alias("is_positive"))


@query("coerce_numeric")
def q_coerce_numeric(spark, sf_dir):
    e = fx.table(spark, sf_dir, "events")
    raw = F.when(F.col("event_type") == "error", F.lit("n/a")).otherwise(F.get_json_object("props", "$.k"))
    return e.select("event_id", raw.alias("raw"), coerce_numeric(raw).alias("value"))


@query("na_tokens")
def q_na_tokens(spark, sf_dir):
    o = fx.table(spark, sf_dir, "orders")
    return o.select("o_orderkey", na_tokens("o_orderpriority", PRIORITY_NA).alias("priority"))


@query("label_values")
def q_label_values(spark, sf_dir):
    li = fx.table(spark, sf_dir, "lineitem")
    parts = [spec_ops.label_values(li, c).select(F.lit(c).alias("column"), "value")
             for c in ("l_returnflag", "l_linestatus")]
    return parts[0].unionByName(parts[1])


# ---------------------------------------------------------------- E11-E13, G3-G5, G1

PROFILE_NUMERIC = ("o_totalprice_n", "o_custkey")
PROFILE_ALL = ("o_orderkey", "o_totalprice_n", "o_orderpriority_n", "o_orderstatus")
PROFILE_TEXT = ("o_orderpriority_n", "o_orderstatus", "o_custkey")


@query("numeric_profile")
def q_numeric_profile(spark, sf_dir):
    p = profile.numeric_profile(fx.orders_with_gaps(spark, sf_dir), PROFILE_NUMERIC)
    return p.select("feature", "count", *[F.round(c, 6).alias(c) for c in
                                          ("mean", "std", "min", "q25", "q50", "q75", "max")])


@query("null_profile")
def q_null_profile(spark, sf_dir):
    return profile.null_profile(fx.orders_with_gaps(spark, sf_dir), PROFILE_ALL)


@query("frequent_values")
def q_frequent_values(spark, sf_dir):
    return profile.frequent_values(fx.orders_with_gaps(spark, sf_dir), PROFILE_TEXT)


@query("impute_median")
def q_impute_median(spark, sf_dir):
    o = profile.impute_median(fx.orders_with_gaps(spark, sf_dir), ["o_totalprice_n"])
    return o.select("o_orderkey", F.round("o_totalprice_n", 6).alias("o_totalprice_n"))


@query("impute_mode")
def q_impute_mode(spark, sf_dir):
    o = profile.impute_mode(fx.orders_with_gaps(spark, sf_dir), ["o_orderpriority_n"])
    return o.select("o_orderkey", "o_orderpriority_n")


@query("scale_unit")
def q_scale_unit(spark, sf_dir):
    o = profile.scale_unit(fx.orders_with_gaps(spark, sf_dir), ["o_totalprice"])
    return o.select("o_orderkey", F.round("o_totalprice", 6).alias("o_totalprice"))


@query("stratified_split")
def q_stratified_split(spark, sf_dir):
    o = fx.table(spark, sf_dir, "orders").select(
        "o_orderkey", F.when(F.col("o_orderstatus") != "F", "yes").otherwise("no").alias("label"))
    return split.stratified_split(o, ["o_orderkey"], "label", C.DEFAULT_TEST_SIZE, C.DEFAULT_RANDOM_STATE)


# ---------------------------------------------------------------- H9-H12, H17, B11, D3


# How event rows stand in for reported issue / plan / done records.
RECORD_ATTRS = ("segment", "priority", "status", "size_group", "region")
EVENT_METRIC = {"view": "selection_rate", "click": "true_positive_rate", "purchase": "false_positive_rate",
                "signup": "accuracy"}
RECORD_SEVERITIES = ("mild", "moderate", "severe", "unknown", "extreme")
PLAN_TOOLS = C.TOOLS + ("run_bias_probe",)
EVENT_PLAN_ATTR = {"view": "segment", "click": "priority", "purchase": "status"}
EVENT_DONE_TOOL = {"view": "run_slice_scan", "click": "run_feature_distribution_comparison",
                   "purchase": "run_threshold_sensitivity", "signup": "check_group_sample_sizes",
                   "error": "run_proxy_detection"}
EVENT_DONE_ATTR = {"click": "priority", "purchase": "segment", "error": "status"}


def _pick(values, key_col: str, modulo: int):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(F.col(key_col), F.lit(modulo)) + 1).cast("int"))


def _flags(spark, sf_dir, by=()):
    cube = _cube(spark, sf_dir, with_run=bool(by), shared=True)
    rates = rate_ops.group_rates(cube, by)
    return rates, rate_ops.disparity_flags(rate_ops.disparity(rates, by), THRESHOLD)


def _issue_records(spark, sf_dir):
    e = fx.table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("record_id"),
        _pick(RECORD_ATTRS, "user_id", len(RECORD_ATTRS)).alias("attribute"),
        value_map("event_type", EVENT_METRIC).alias("metric"),
        "event_type", "event_id",
    )


@query("issues")
def q_issues(spark, sf_dir):
    rates, flags = _flags(spark, sf_dir)
    return issue_ops.issues_text(issue_ops.issue_table(flags, rates, THRESHOLD))


@query("issues_flat")
def q_issues_flat(spark, sf_dir):
    rates, flags = _flags(spark, sf_dir)
    return issue_ops.issues_flat(issue_ops.issue_table(flags, rates, THRESHOLD))


@query("issue_evidence")
def q_issue_evidence(spark, sf_dir):
    return issue_ops.issue_evidence(rate_ops.disparity(_rates(spark, sf_dir)))


@query("issue_severity")
def q_issue_severity(spark, sf_dir):
    recs = _issue_records(spark, sf_dir).select("record_id", "attribute", "metric")
    disp = rate_ops.disparity(_rates(spark, sf_dir))
    return issue_ops.recompute_severity(recs, disp, THRESHOLD).select(
        "record_id", "attribute", "metric", "difference", "severity")


@query("issue_check")
def q_issue_check(spark, sf_dir):
    r = _issue_records(spark, sf_dir)
    recs = r.select(
        "record_id",
        F.when(F.col("event_type") == "error", F.lit(None).cast("string")).otherwise(F.col("attribute"))
        .alias("attribute"),
        "metric",
        _pick(RECORD_SEVERITIES, "event_id", len(RECORD_SEVERITIES)).alias("severity"),
        issue_type_of("metric").alias("issue_type"),
        F.when(F.col("metric").isNotNull(), F.array(F.concat(F.lit("fairness_report."), F.col("attribute"))))
        .alias("evidence"),
    )
    return issue_ops.issue_record_errors(recs)


# ---------------------------------------------------------------- H13, H14, D4-D6, H16

@query("diagnostic_plan")
def q_diagnostic_plan(spark, sf_dir):
    _, flags = _flags(spark, sf_dir)
    return rules.diagnostic_plan(flags, None, has_y_score=True, have_group_sizes=True)


@query("open_tests")
def q_open_tests(spark, sf_dir):
    _, flags = _flags(spark, sf_dir)
    e = fx.table(spark, sf_dir, "events")
    done = e.select(value_map("event_type", EVENT_DONE_TOOL).alias("tool"),
                    value_map("event_type", EVENT_DONE_ATTR).alias("attribute"))
    recs = rules.recommended_tests(flags, has_y_score=True)
    return rules.open_tests(recs, done).select("tool", "attribute")


@query("plan_check")
def q_plan_check(spark, sf_dir):
    e = fx.table(spark, sf_dir, "events")
    plan = e.select(_pick(PLAN_TOOLS, "user_id", len(PLAN_TOOLS)).alias("tool"),
                    value_map("event_type", EVENT_PLAN_ATTR).alias("attribute"))
    return rules.plan_problems(plan)


@query("highlights")
def q_highlights(spark, sf_dir):
    sweep = thresholds.threshold_sensitivity(_cube(spark, sf_dir, cuts=C.DEFAULT_CUTS), C.DEFAULT_CUTS)
    best = thresholds.best_threshold(sweep).select(
        F.lit("run_threshold_sensitivity").alias("tool"), "attribute",
        F.concat(F.lit("Best TPR-gap threshold = "), F.col("threshold").cast("string")).alias("detail"),
        F.lit(None).cast("double").alias("n"), F.lit(None).cast("double").alias("selection_rate"),
        F.col("tpr_difference").alias("true_positive_rate"), F.col("fpr_difference").alias("false_positive_rate"),
    )
    top = slices.slice_scan(fx.scored_lineitems(spark, sf_dir), fx.FEATURES, fx.POSITIVE, top=3).select(
        F.lit("run_slice_scan").alias("tool"), F.lit("-").alias("attribute"),
        F.concat("feature", F.lit("="), "value").alias("detail"),
        F.col("n").cast("double").alias("n"), "selection_rate", "true_positive_rate", "false_positive_rate",
    )
    return best.unionByName(top)


# ---------------------------------------------------------------- A10-A14, G10, D1


REQUIRED_TABLES = ("metrics", "fairness_report", "issues")


def _run_tables(spark, sf_dir):
    """Audit tables of every run (run_id = order year), from one cube pass."""
    by = ["run_id"]
    scored = fx.scored_lineitems(spark, sf_dir, with_run=True)
    cube = cut_lineage(cube_ops.confusion_cube(scored, fx.SENSITIVE, fx.POSITIVE, by=by))
    rates = rate_ops.group_rates(cube, by)
    disp = rate_ops.disparity(rates, by)
    flags = rate_ops.disparity_flags(disp, THRESHOLD)
    issues = issue_ops.issue_table(flags, rates, THRESHOLD, by)
    metrics = store.run_metrics(scored, label_col="y_true", positive_label=fx.POSITIVE,
                                sensitive_cols=fx.SENSITIVE, cube=cube)
    sizes = cube_ops.group_sizes(cube, by)
    return dict(scored=scored, rates=rates, disp=disp, flags=flags, issues=issues, metrics=metrics, sizes=sizes)


@query("run_metrics")
def q_run_metrics(spark, sf_dir):
    # n_train is null here (scores come from elsewhere); shown as double so that a null-bearing
    # integer column has one pandas type in both engines
    m = _run_tables(spark, sf_dir)["metrics"]
    return m.withColumn("n_train", F.col("n_train").cast("double"))


@query("run_catalogue")
def q_run_catalogue(spark, sf_dir):
    t = _run_tables(spark, sf_dir)
    return store.run_catalogue({"metrics": t["metrics"], "fairness_report": t["disp"], "issues": t["issues"]})


@query("run_summary")
def q_run_summary(spark, sf_dir):
    t = _run_tables(spark, sf_dir)
    return store.run_summary(store.latest_run(t["metrics"]), t["metrics"], t["flags"], t["issues"])


@query("evidence_table")
def q_evidence_table(spark, sf_dir):
    t = _run_tables(spark, sf_dir)
    cat = store.run_catalogue({"metrics": t["metrics"], "fairness_report": t["disp"], "issues": t["issues"]})
    return store.evidence_table(t["metrics"], t["disp"], t["sizes"], cat, REQUIRED_TABLES, t["rates"])


@query("report_json")
def q_report_json(spark, sf_dir):
    t = _run_tables(spark, sf_dir)
    return store.report_json(t["rates"], t["flags"], by=["run_id"])


@query("run_documents")
def q_run_documents(spark, sf_dir):
    """The document of every run written as JSON, read back and flattened."""
    t = _run_tables(spark, sf_dir)
    spec = AuditSpec(positive_label=fx.POSITIVE, sensitive_cols=fx.SENSITIVE, fairness_threshold=THRESHOLD)
    docs = documents.run_documents(
        {"metrics": t["metrics"], "group_rates": t["rates"], "disparity": t["flags"], "group_sizes": t["sizes"],
         "issues": t["issues"], "plan": rules.diagnostic_plan(t["flags"], None, by=RUN)}, spec)
    root = _scratch(spark, "documents")
    documents.write_documents(docs, root)
    return documents.flattened(documents.read_documents(spark, root))


@query("stored_runs")
def q_stored_runs(spark, sf_dir):
    """Every run written, all but the newest committed; what readers see."""
    root, rows = _scratch(spark, "runs"), cut_lineage(
        fx.scored_lineitems(spark, sf_dir, with_run=True).select("run_id", "l_orderkey", "y_true", "y_pred"))
    names = sorted(r["run_id"] for r in rows.select("run_id").distinct().collect())
    for name in names:
        run = store.RunWriter(spark, root, name)
        run.write(rows.where(F.col("run_id") == name), "scored")
        if name != names[-1]:
            run.commit()
    seen = store.read_audit_table(spark, root, "scored").groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("l_orderkey").alias("keys"))
    return store.stored_catalogue(spark, root, ["scored", "issues"]).join(seen, "run_id")


@query("row_numbers")
def q_row_numbers(spark, sf_dir):
    """Rows of many files numbered in the files' order; the split by number is the same however they are read."""
    path = _scratch(spark, "numbered")
    o = fx.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    o.repartitionByRange(4, "o_orderkey").sortWithinPartitions("o_orderkey").write.csv(path)
    rows = number_rows(read_dataset(spark, DatasetSpec(path=path, format="csv", header=False,
                                                       columns=("o_orderkey", "o_orderstatus"))))
    return split.stratified_split(rows, ["row_index"], "o_orderstatus", C.DEFAULT_TEST_SIZE, C.DEFAULT_RANDOM_STATE)


def _scratch(spark, name):
    """A new folder below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query("scored_store")
def q_scored_store(spark, sf_dir):
    """Scored rows of all runs written by run and read again."""
    root = _scratch(spark, "store")
    rows = fx.scored_lineitems(spark, sf_dir, with_run=True)
    store.write_audit_table(rows.select("run_id", "l_orderkey", "y_true", "y_pred", "y_score"), root, "scored")
    back = store.read_audit_table(spark, root, "scored")
    return back.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("y_pred") == "good").alias("selected"),
                                      F.max("y_score").alias("max_score"), F.sum("l_orderkey").alias("keys"))


def _orders_text(spark, sf_dir):
    """Orders as text, with two ways to say that a value is missing."""
    o = fx.table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    return o.select(
        key.cast("string").alias("key"),
        F.when(key % 7 == 0, "n/a").otherwise(F.col("o_custkey").cast("string")).alias("customer"),
        F.when(key % 11 == 0, "?").otherwise(F.col("o_orderstatus")).alias("status"),
        F.when(key % 2 == 0, "True").otherwise("False").alias("even"),
        F.concat(key.cast("string"), F.lit("d")).alias("code"),
        (key / 4).cast("string").alias("quarter"))


@query("read_csv")
def q_read_csv(spark, sf_dir):
    """A text file with a header, typed by all its values."""
    path = _scratch(spark, "csv")
    _orders_text(spark, sf_dir).write.option("header", True).csv(path)
    return read_dataset(spark, DatasetSpec(path=path, format="csv", na_values=("?",)))


@query("read_delimited")
def q_read_delimited(spark, sf_dir):
    """A2: lines split by a regular expression, columns named by the spec."""
    path, text = _scratch(spark, "lines"), _orders_text(spark, sf_dir)
    text.select(F.concat_ws(" |  ", *text.columns).alias("value")).write.text(path)
    return read_dataset(spark, DatasetSpec(path=path, format="delimited", sep=r"\s*\|\s*", na_values=("?",),
                                           columns=text.columns))


@query("prepared_dataset")
def q_prepared_dataset(spark, sf_dir):
    """A .data file whose columns a JSON file names, prepared; label, attribute and features."""
    path, names = f"{_scratch(spark, 'orders')}.data", _scratch(spark, "columns")
    o = fx.table(spark, sf_dir, "orders")
    o.select(F.concat_ws("   ", "o_orderkey", "o_orderstatus", "o_totalprice").alias("value")).write.text(path)
    spark.createDataFrame([('{"columns": ["key", "status", "price"]}',)], "value string").coalesce(1).write.text(names)
    spec = AuditSpec.from_dict({
        "label_col": "status", "positive_label": "open", "sensitive_cols": ["tier"], "label_map": STATUS_MAP,
        "derived_columns": {"band": {"type": "bin", "source": "price", "bins": PRICE_BINS, "labels": PRICE_LABELS},
                            "tier": {"type": "map", "source": "band", "mapping": TIER_MAP}},
        "dataset": {"path": path, "schema_path": names}})
    data = prepare(read_dataset(spark, spec.dataset), spec)
    spec_ops.require_columns(data, [spec.label_col, *spec.sensitive_cols])
    return data.select(spec.label_col, *spec.sensitive_cols,
                       *feature_columns(data, spec.label_col, spec.sensitive_cols))


@query("pair_shift")
def q_pair_shift(spark, sf_dir):
    """Means of a chosen pair of groups."""
    scored = fx.scored_lineitems(spark, sf_dir)
    out = shift.numeric_shift(scored, SHIFT_ATTR, shift.split_feature_types(scored, fx.FEATURES)[0],
                              groups=["MACHINERY", "BUILDING"])
    return out.select("rank", "feature", "group_a", "group_b",
                      *[F.round(c, 6).alias(c) for c in ("mean_a", "mean_b", "abs_mean_diff")])


@query("feature_store")
def q_feature_store(spark, sf_dir):
    """The features of all runs written by run; the newest run read by its folder."""
    root, rows = _scratch(spark, "features"), fx.scored_lineitems(spark, sf_dir, with_run=True)
    store.write_audit_table(rows.select("run_id", "l_orderkey", *fx.FEATURES), root, "features")
    last = store.read_audit_table(spark, root, "features").agg(F.max("run_id")).first()[0]
    kept = store.read_audit_table(spark, root, "features", last)
    return kept.groupBy("run_id", "c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("quantity"),
                                                      F.max("o_totalprice").alias("top_price"))


@query("rates_csv")
def q_rates_csv(spark, sf_dir):
    """The rates of all groups as a CSV file, read again."""
    path = _scratch(spark, "rates")
    store.write_rates_csv(_rates(spark, sf_dir), path)
    return read_dataset(spark, DatasetSpec(path=path, format="csv"))


@query("score_feature_join")
def q_score_feature_join(spark, sf_dir):
    """Scored orders joined to per-order line features on the row key."""
    o = fx.table(spark, sf_dir, "orders")
    raw = (F.col("o_orderkey") * 37 + F.col("o_custkey") * 11) % 1000
    scored = o.select(
        F.col("o_orderkey").alias("row_index"),
        F.when(F.col("o_orderstatus") == "F", "good").otherwise("bad").alias("y_true"),
        F.when(raw.cast("double") / F.lit(1000.0) >= F.lit(0.5), "good").otherwise("bad").alias("y_pred"),
    )
    li = fx.table(spark, sf_dir, "lineitem")
    feats = li.groupBy(F.col("l_orderkey").alias("row_index")).agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum("l_quantity").alias("total_qty"),
        F.avg("l_discount").alias("avg_discount"))
    # both sides grow with the data: a shuffle (sort-merge) join on the key, no broadcast
    return scored.join(feats, "row_index").select(
        "row_index", "y_true", "y_pred", "n_lines", "total_qty", F.round("avg_discount", 6).alias("avg_discount"))


# ---------------------------------------------------------------- G1-G9, H5, H15 (rows-only checks)


DOC_FEATURES = ("n_chars", "lang", "source")


def _documents(spark, sf_dir):
    d = fx.table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang", "source")
    lab = fx.table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("string").alias("quality"))
    return d.join(lab, "doc_id")


@query("train_score")
def q_train_score(spark, sf_dir):
    """Split, fit and score a quality classifier on documents ⨝ labels; scored test rows."""
    docs = _documents(spark, sf_dir)
    parts = split.stratified_split(docs, ["doc_id"], "quality", C.DEFAULT_TEST_SIZE, C.DEFAULT_RANDOM_STATE)
    train = parts.where(~F.col("is_test"))
    test = parts.where(F.col("is_test"))
    classes = spec_ops.validate_binary_label(docs, "quality")
    m = model_ops.fit(train, DOC_FEATURES, "quality", "1", classes, max_iter=2000)
    test = test.withColumnRenamed("doc_id", "row_index").withColumn("y_true", F.col("quality"))
    scored = m.score(test, keep=["row_index", "y_true", "lang"])
    return scored.select("row_index", "y_true", "y_pred", "y_score", "lang")


@query("proxy_detection")
def q_proxy_detection(spark, sf_dir):
    return logistic.proxy_by(fx.scored_lineitems(spark, sf_dir), ["status"], PROXY_FEATURES)


@query("proxy_unsupported")
def q_proxy_unsupported(spark, sf_dir):
    """An attribute of more than two groups: the true number, and no model."""
    res = model_ops.proxy_detection(fx.scored_lineitems(spark, sf_dir), "segment", fx.FEATURES)
    return spark.createDataFrame([(res["attribute"], ",".join(res["classes"]), res["n_classes"], res["status"])],
                                 "attribute string, classes string, n_classes long, status string")


@query("split_counts")
def q_split_counts(spark, sf_dir):
    o = fx.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return split.split_counts(split.stratified_split(o, ["o_orderkey"], "o_orderstatus", C.DEFAULT_TEST_SIZE,
                                                     C.DEFAULT_RANDOM_STATE))


@query("diagnostics_status")
def q_diagnostics_status(spark, sf_dir):
    scored = fx.scored_lineitems(spark, sf_dir)
    spec = AuditSpec(positive_label=fx.POSITIVE, sensitive_cols=fx.SENSITIVE, fairness_threshold=THRESHOLD)
    ctx = audit_ops.AuditContext(scored, spec, PROXY_FEATURES,
                                 _cube(spark, sf_dir, cuts=C.DEFAULT_CUTS, shared=True), tuple(C.DEFAULT_CUTS))
    plan = [("check_group_sample_sizes", None), ("run_feature_distribution_comparison", "segment"),
            ("run_proxy_detection", "segment"), ("run_proxy_detection", "status"), ("run_slice_scan", None),
            ("run_threshold_sensitivity", "segment"), ("run_bias_probe", "segment")]
    return audit_ops.run_diagnostics(ctx, plan)
