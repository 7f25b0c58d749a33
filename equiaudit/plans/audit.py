"""H15 dispatcher and H18 whole audit.

The dispatcher is a registry of diagnostics keyed by tool name; each planned
(tool, attribute) runs on its own, for all runs that plan it at once, a failure
is recorded and does not stop the others, and only ``ok`` results count as done.  The audit computes the
confusion cube once (checkpointed: it is small) and derives every report
table from it.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from functools import reduce
from typing import Callable, Sequence

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from equiaudit import constants as C
from equiaudit.operators import cube as cube_ops
from equiaudit.operators import issues as issue_ops
from equiaudit.operators import logistic
from equiaudit.operators import model as model_ops
from equiaudit.operators import rates as rate_ops
from equiaudit.operators import shift, slices, thresholds
from equiaudit.operators.keyed import empty_keyed, join_by, same_key
from equiaudit.operators.split import stratified_split
from equiaudit.plans import diagnostic_rules as rules
from equiaudit.session import cut_lineage, kept_once
from equiaudit.sources import audit_store, documents
from equiaudit.sources.readers import feature_columns, prepare, read_dataset
from equiaudit.sources.row_numbers import number_rows
from equiaudit.spec import AuditSpec, require_columns, validate_binary_label


@dataclass
class AuditContext:
    scored: DataFrame
    spec: AuditSpec
    features: Sequence[str]
    cube: DataFrame | None = None
    cube_cuts: tuple | None = None  # score cuts the cube was built with, if any
    by: Sequence[str] = ()  # columns that tell the runs apart; every result carries them
    outputs: dict = field(default_factory=dict)
    #: The attributes of all planned proxy models, which are fitted together, and their results.
    proxy_attributes: Sequence[str] = ()
    proxies: dict = field(default_factory=dict)
    rows_kept: bool = False  # whether ``scored`` is written already


def _options(ctx: AuditContext, tool: str) -> dict:
    return dict(ctx.spec.diagnostic_options.get(tool, {}))


def _sizes(ctx: AuditContext, attribute=None):
    return {"group_sizes": cube_ops.group_sizes(ctx.cube, ctx.by)}


def _distribution(ctx: AuditContext, attribute=None):
    options = _options(ctx, "run_feature_distribution_comparison")
    if not ctx.by:
        res = shift.feature_distribution(ctx.scored, attribute, ctx.features, **options)
        if "error" in res:
            raise ValueError(res["error"])
        return {"numeric_shift": res["numeric"], "categorical_shift": res["categorical"]}
    num, cat, dt = shift.split_feature_types(ctx.scored, ctx.features)
    top = {"top": options["top"]} if "top" in options else {}
    k = {"k": options["k"]} if "k" in options else {}
    return {"numeric_shift": shift.numeric_shift(ctx.scored, attribute, num, by=ctx.by, **top),
            "categorical_shift": shift.categorical_shift(ctx.scored, attribute, cat + dt, by=ctx.by, **top, **k)}


_PROXY = ("attribute string, classes string, n_classes long, accuracy double, auc double, risk_level string, "
          "status string")


def _one_proxy(ctx: AuditContext, df: DataFrame, attribute: str, **options) -> DataFrame:
    res = model_ops.proxy_detection(df, attribute, ctx.features, **options)
    row = [(res["attribute"], ",".join(res["classes"]), res["n_classes"], res["accuracy"], res["auc"],
            res["risk_level"], res["status"])]
    return ctx.scored.sparkSession.createDataFrame(row, _PROXY)


def _proxy(ctx: AuditContext, attribute=None):
    """All planned proxies are fitted together, for all runs; too many levels for that leave L-BFGS, one by one."""
    options = _options(ctx, "run_proxy_detection")
    iterations = {"max_iter": options.pop("max_iter")} if "max_iter" in options else {}
    together = [a for a in ctx.proxy_attributes if a in ctx.scored.columns]
    if attribute not in together:
        together = [attribute]
    key = tuple(together)
    if key not in ctx.proxies:
        try:
            ctx.proxies[key] = cut_lineage(logistic.proxy_by(ctx.scored, together, ctx.features, ctx.by,
                                                                 prepared=ctx.rows_kept, **options))
        except logistic.TooWide:
            ctx.proxies[key] = None
    if ctx.proxies[key] is not None:
        return {"proxy": ctx.proxies[key].where(F.col("attribute") == attribute)}
    if not ctx.by:
        return {"proxy": _one_proxy(ctx, ctx.scored, attribute, **iterations)}
    parts = []
    for run in ctx.scored.select(*ctx.by).distinct().collect():
        own = reduce(lambda d, c: d.where(F.col(c).eqNullSafe(F.lit(run[c]))), ctx.by, ctx.scored)
        parts.append(_one_proxy(ctx, own, attribute, **iterations).select(
            *[F.lit(run[c]).cast(ctx.scored.schema[c].dataType).alias(c) for c in ctx.by], "*"))
    return {"proxy": reduce(DataFrame.unionByName, parts)}


def _slices(ctx: AuditContext, attribute=None):
    return {"slice_scan": slices.slice_scan(ctx.scored, ctx.features, ctx.spec.positive_label, by=ctx.by,
                                             **_options(ctx, "run_slice_scan"))}


def _thresholds(ctx: AuditContext, attribute=None):
    if "y_score" not in ctx.scored.columns:
        raise ValueError("scored rows have no y_score")
    attrs = [attribute] if attribute else list(ctx.spec.sensitive_cols)
    if ctx.cube is not None and ctx.cube_cuts == tuple(C.DEFAULT_CUTS) and set(attrs) <= set(ctx.spec.sensitive_cols):
        # the audit's cube already holds the score buckets: no new pass over the rows
        cube = ctx.cube.where(F.col("attribute").isin(attrs))
    else:
        cube = cube_ops.confusion_cube(ctx.scored, attrs, ctx.spec.positive_label, y_pred=None,
                                       score="y_score", cuts=C.DEFAULT_CUTS, by=ctx.by)
    return {"threshold_sensitivity": thresholds.threshold_sensitivity(cube, C.DEFAULT_CUTS, ctx.by)}


REGISTRY: dict[str, Callable[..., dict]] = {
    "check_group_sample_sizes": _sizes,
    "run_feature_distribution_comparison": _distribution,
    "run_proxy_detection": _proxy,
    "run_slice_scan": _slices,
    "run_threshold_sensitivity": _thresholds,
}
#: Diagnostics that read the records, not the cube.
READ_ROWS = ("run_feature_distribution_comparison", "run_proxy_detection", "run_slice_scan")
_STATUS = "tool string, attribute string, status string, error string, n_rows long"
_NO_PAIR = "a comparison takes two groups"


def _of_runs(df: DataFrame | None, runs: DataFrame | None, by: Sequence[str]) -> DataFrame | None:
    """The rows of the planned runs."""
    if df is None or runs is None:
        return df
    right = runs.withColumnsRenamed({c: f"__k_{c}" for c in by})
    return df.join(right, same_key(by), "left_semi")


def _status_by_run(runs: DataFrame, by: Sequence[str], tool: str, attribute: str | None, kept: dict) -> DataFrame:
    """(…by, tool, attribute, status, error, n_rows): a row for each planned run."""
    counts = reduce(DataFrame.unionByName, [df.select(*by) for df in kept.values()]).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"))
    found = join_by(runs, counts, by, "left")
    status, error = F.lit("ok"), F.lit(None).cast("string")
    if tool == "run_proxy_detection":
        found = join_by(found, kept["proxy"].select(*by, F.col("status").alias("__status")), by, "left")
        status = F.coalesce("__status", F.lit("unsupported"))
    elif tool == "run_feature_distribution_comparison":
        status = F.when(F.col("n_rows").isNull(), "error").otherwise("ok")
        error = F.when(F.col("n_rows").isNull(), _NO_PAIR)
    return found.select(*by, F.lit(tool).alias("tool"), F.lit(attribute).cast("string").alias("attribute"),
                        status.alias("status"), error.alias("error"),
                        F.coalesce("n_rows", F.lit(0)).cast("long").alias("n_rows"))


def run_diagnostics(ctx: AuditContext, plan: Sequence[tuple[str, str | None]] | DataFrame) -> DataFrame:
    """Run planned (tool, attribute) items; returns (…by, tool, attribute, status, error, n_rows).

    The plan is a short list of tools x attributes, or with runs (``ctx.by``) a table (…by, tool, attribute): a tool
    then takes all runs that plan it in one pass, so the number of jobs does not follow the number of runs.  Each
    result is written once to the shared checkpoint folder, so that errors surface here, per item, and later readers
    compute nothing again; so are the columns that the diagnostics read, if several read them.

    What is wrong with the data or the plan makes an ``error`` row; failures of the cluster are raised.
    """
    by, spark = list(ctx.by), ctx.scored.sparkSession
    if isinstance(plan, DataFrame):
        plan = cut_lineage(plan.select(*by, "tool", "attribute").distinct())
        items = [(r["tool"], r["attribute"]) for r in plan.select("tool", "attribute").distinct().collect()]
        items.sort(key=lambda i: (str(i[0]), i[1] or ""))
    else:
        items = list(plan)
        if by:
            raise ValueError("the plan of several runs is a table with their columns")
    if sum(tool in READ_ROWS for tool, _ in items) > 1:
        used = dict.fromkeys(c for c in (*by, "y_true", "y_pred", "y_score", *ctx.spec.sensitive_cols, *ctx.features,
                                         *[a for _, a in items if a]) if c in ctx.scored.columns)
        ctx.scored, ctx.rows_kept = kept_once(ctx.scored.select(*used), "diagnostic-rows"), True
    ctx.proxy_attributes = list(dict.fromkeys(a for tool, a in items if tool == "run_proxy_detection" and a))
    parts = []
    for tool, attribute in items:
        runs = None
        if by:
            runs = plan.where((F.col("tool") == tool) & F.col("attribute").eqNullSafe(F.lit(attribute))).select(*by)
        try:
            if tool not in REGISTRY:
                raise ValueError(f"no diagnostic named {tool}")
            # the proxies of all runs are fitted together, and those that are planned are taken
            own = ctx if tool == "run_proxy_detection" else replace(
                ctx, scored=_of_runs(ctx.scored, runs, by), cube=_of_runs(ctx.cube, runs, by))
            out = REGISTRY[tool](own, attribute)
            kept = {name: cut_lineage(_of_runs(df, runs, by)) for name, df in out.items()}
            if by:
                parts.append(cut_lineage(_status_by_run(runs, by, tool, attribute, kept)))
            else:
                status = kept["proxy"].first()["status"] if tool == "run_proxy_detection" else "ok"
                n = sum(df.count() for df in kept.values())
                parts.append(spark.createDataFrame([(tool, attribute, status, None, n)], _STATUS))
            ctx.outputs |= {(tool, attribute, name): df for name, df in kept.items()}
        except (ValueError, PySparkException) as e:
            text = str(e) if isinstance(e, ValueError) else f"{type(e).__name__}: {e}"
            bad = spark.createDataFrame([(tool, attribute, "error", text, None)], _STATUS)
            parts.append(join_by(runs, bad, []) if by else bad)
    if not parts:
        return empty_keyed(ctx.scored, by, _STATUS)
    return reduce(DataFrame.unionByName, parts)


def run_audit(scored: DataFrame, spec: AuditSpec, features: Sequence[str], run_diagnostics_now: bool = True,
              by: Sequence[str] = ()) -> dict[str, DataFrame]:
    """Cube -> rates -> disparity -> flags -> issues -> plan -> diagnostics."""
    require_columns(scored, ["y_true", "y_pred", *spec.sensitive_cols], "scored rows")
    has_score = "y_score" in scored.columns
    cube = cube_ops.confusion_cube(scored, spec.sensitive_cols, spec.positive_label,
                                   score="y_score" if has_score else None,
                                   cuts=C.DEFAULT_CUTS if has_score else None, by=by)
    # the cube is tiny and every report table reads it: write it once to the shared
    # checkpoint folder so later steps (and retries after a lost executor) never re-scan
    cube = cut_lineage(cube)
    rates = rate_ops.group_rates(cube, by)
    disp = rate_ops.disparity(rates, by)
    flags = rate_ops.disparity_flags(disp, spec.fairness_threshold)
    out = {
        "cube": cube,
        "accuracy": cube_ops.accuracy_from_cube(cube, spec.sensitive_cols[0], by),
        "group_sizes": cube_ops.group_sizes(cube, by),
        "group_rates": rates,
        "disparity": flags,
        "fairness_report": rate_ops.fairness_report(rates, spec.fairness_threshold, by),
        "findings": rate_ops.findings(flags, spec.sensitive_cols, by),
        "small_groups": rate_ops.small_groups(cube_ops.group_sizes(cube, by), spec.min_group_size),
        "issues": issue_ops.issue_table(flags, rates, spec.fairness_threshold, by),
        "plan": rules.diagnostic_plan(flags, None, has_y_score=has_score, by=by),
    }
    if run_diagnostics_now:
        out |= _diagnostics(scored, spec, features, cube, tuple(C.DEFAULT_CUTS) if has_score else None, out["plan"], by)
    return out


def _diagnostics(scored: DataFrame, spec: AuditSpec, features: Sequence[str], cube: DataFrame, cuts: tuple | None,
                 plan: DataFrame, by: Sequence[str]) -> dict[str, DataFrame]:
    """The planned diagnostics of all runs; each run has a plan of its own."""
    ctx = AuditContext(scored, spec, features, cube, cuts, list(by))
    out = {"diagnostics_status": run_diagnostics(ctx, plan)}
    return out | {f"{name}__{attribute or 'all'}": df for (_, attribute, name), df in ctx.outputs.items()}


MODELS = ("logistic_regression",)


def audit_dataset(spark: SparkSession, spec: AuditSpec, root: str, run_id: str,
                  path: str | None = None) -> dict[str, DataFrame]:
    """H18 from the configuration on: read, prepare, validate, split, fit, score, write, audit, diagnose, write.

    Rows are numbered in the order of the files (``row_index``), so the split does not follow the partitioning.  Tables
    of the run, its evidence and its document are written below ``root`` and committed together; returns the tables."""
    if spec.model_type not in MODELS:
        raise ValueError(f"model type {spec.model_type!r} is not one of {list(MODELS)}")
    data = prepare(read_dataset(spark, spec.dataset, path), spec)
    require_columns(data, [spec.label_col, *spec.sensitive_cols], "dataset")
    data = number_rows(data.where(F.col(spec.label_col).isNotNull()))
    classes = validate_binary_label(data, spec.label_col)
    features = [c for c in feature_columns(data, spec.label_col, spec.sensitive_cols) if c != "row_index"]
    parts = cut_lineage(stratified_split(data, ["row_index"], spec.label_col, spec.test_size, spec.random_state))
    train, test = parts.where(~F.col("is_test")), parts.where(F.col("is_test"))
    fitted = model_ops.fit(train, features, spec.label_col, spec.positive_label, classes, spec.max_iter)
    run = audit_store.RunWriter(spark, root, run_id)

    # prepared features are coded columns; the originals come back by the row's number
    y = F.col(spec.label_col).cast("string").alias("y_true")
    scores = fitted.score(test.select("row_index", *features), keep=["row_index"])
    scored = run.write(test.select("row_index", y, *spec.sensitive_cols).join(scores, "row_index"), "scored")
    kept = run.write(test.select("row_index", *features), "features")
    out = run_audit(scored.drop("run_id").join(kept.drop("run_id"), "row_index"), spec, features)
    n_train = train.agg(F.count(F.lit(1)).alias("n_train")).select(F.lit(str(run_id)).alias("run_id"), "n_train")
    out["metrics"] = audit_store.run_metrics(
        scored, label_col=spec.label_col, positive_label=spec.positive_label, sensitive_cols=spec.sensitive_cols,
        model_type=spec.model_type, model_classes=classes, n_train=n_train)
    out["sketches"] = slices.column_sketches(kept, features)
    tables = {name: run.write(df, name) for name, df in out.items()}
    tables["evidence"] = run.write(documents.flattened(documents.run_documents(tables, spec)), "evidence")
    documents.write_documents(documents.run_documents(tables, spec), root)
    run.commit()
    return {name: audit_store.read_audit_table(spark, root, name, run_id) for name in [*tables, "scored", "features"]}


def done_from_status(status: DataFrame) -> DataFrame:
    """Only ``ok`` results count as done."""
    return status.where(F.col("status") == "ok").select("tool", "attribute")
