"""E9 (column cardinality) and H3 (slice scan), for one run or for many at once."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from equiaudit import constants as C
from equiaudit.functions import positive_flag
from equiaudit.operators.keyed import empty_keyed, join_by, rank_in
from equiaudit.operators.rates import rates_from_counts
from equiaudit.session import stored

#: Sketches have 2**12 registers: at most 4 KB, 1.6 % standard error, exact for a few hundred values.
SKETCH_BITS = 12
_SLICES = ("rank int, feature string, value string, n long, selection_rate double, true_positive_rate double, "
           "false_positive_rate double")


def column_sketches(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(…by, feature, position, n, nulls, sketch): a mergeable distinct-count sketch for every key and column, from one
    pass over the rows.

    Stored as an audit table, the sketches of a new run stand beside those of earlier runs, and
    :func:`merged_sketches` unites any of them without a look at their rows.
    """
    by = list(by)
    if not cols:
        return empty_keyed(df, by, "feature string, position int, n long, nulls long, sketch binary")
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, c in enumerate(cols):
        value = F.when(F.col(c).isNotNull(), F.xxhash64(c))
        aggs += [F.count(F.col(c)).alias(f"c{i}"), F.hll_sketch_agg(value, F.lit(SKETCH_BITS)).alias(f"s{i}")]
    wide = df.groupBy(*by).agg(*aggs)
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.lit(i).alias("position"), F.col("n").alias("n"),
                              (F.col("n") - F.col(f"c{i}")).alias("nulls"), F.col(f"s{i}").alias("sketch"))
                     for i, c in enumerate(cols)])
    return wide.where(F.col("n") > 0).select(*by, F.inline(rows))


def merged_sketches(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sketches united by key and column; without ``by`` those of all runs."""
    return sketches.groupBy(*by, "feature").agg(
        F.min("position").alias("position"), F.sum("n").alias("n"), F.sum("nulls").alias("nulls"),
        F.hll_union_agg("sketch").alias("sketch"))


def estimated_distinct(sketches: DataFrame) -> DataFrame:
    """The table with ``n_distinct``: estimated number of values, nulls counted as one; exact for the few values that a
    slice column has."""
    return sketches.withColumn("n_distinct", F.hll_sketch_estimate("sketch") + (F.col("nulls") > 0).cast("long"))


def _near_limit(sketches: DataFrame, cols: Sequence[str], limit: int) -> DataFrame:
    """Sketches of the columns that may have at most ``limit`` values, by a wide margin."""
    return estimated_distinct(sketches).where(
        (F.col("n_distinct") <= 2 * limit + 2) & F.col("feature").isin(list(cols)))


def cardinality_candidates(df: DataFrame, cols: Sequence[str], limit: int = C.SLICE_MAX_DISTINCT) -> list[str]:
    """Columns that may have at most ``limit`` distinct values (nulls included).

    Only columns whose estimate is within a wide margin of the limit go on to an exact count, so wide text columns are
    never counted exactly and never collected.
    """
    near = {r["feature"] for r in _near_limit(column_sketches(df, cols), cols, limit).select("feature").collect()}
    return [c for c in cols if c in near]


def _narrow_values(df: DataFrame, cols: Sequence[str], limit: int, by: Sequence[str], ids: Sequence[str],
                   sketches: DataFrame | None) -> tuple[DataFrame | None, list[str]]:
    """Unpivoted (…by, …ids, feature, value) of the columns that are narrow in the row's own run.

    Only columns that are narrow in some run are read.  Where a run's sketches hold a column to be wide, its values are
    dropped in the scan, before anything is counted or shuffled.
    """
    near = _near_limit(column_sketches(df, cols, by) if sketches is None else sketches, cols, limit)
    # one row per run: joined to the records, and its column names (at most those given) brought to the driver
    near = stored(near.groupBy(*by).agg(F.collect_set("feature").alias("__near")), "near-columns")
    some = {r["c"] for r in near.select(F.explode("__near").alias("c")).distinct().collect()}
    kept = [c for c in cols if c in some]
    if not kept:
        return None, []
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value")) for c in kept])
    rows = df.select(*by, *ids, *[c for c in kept if c not in {*by, *ids}])
    if by:
        rows = join_by(rows, near, by)
        cells = F.filter(cells, lambda x: F.array_contains("__near", x["feature"]))
    return rows.select(*by, *ids, F.inline(cells)), kept


def _positions(cols: Sequence[str]):
    return F.array_position(F.array(*[F.lit(c) for c in cols]), F.col("feature")).cast("int") - 1


def column_cardinality(df: DataFrame, cols: Sequence[str], limit: int = C.SLICE_MAX_DISTINCT,
                       by: Sequence[str] = (), sketches: DataFrame | None = None) -> DataFrame:
    """(…by, feature, position, n_distinct) for columns with at most ``limit`` distinct values incl. null.

    With ``by`` every run has a list of its own.  ``sketches`` (:func:`column_sketches`) saves the first pass.
    """
    by = list(by)
    long, kept = _narrow_values(df, cols, limit, by, [], sketches)
    if not kept:
        return empty_keyed(df, by, "feature string, position int, n_distinct long")
    exact = long.distinct().groupBy(*by, "feature").agg(F.count(F.lit(1)).alias("n_distinct"))
    return exact.where(F.col("n_distinct") <= limit).select(
        *by, "feature", _positions(cols).alias("position"), "n_distinct")


def slice_candidates(df: DataFrame, cols: Sequence[str], limit: int = C.SLICE_MAX_DISTINCT,
                     max_cols: int = C.SLICE_MAX_COLUMNS) -> list[str]:
    """the first ``max_cols`` low-cardinality columns in column order (driver-side on E9 output)."""
    card = column_cardinality(df, cols, limit).select("feature", "position").collect()
    return [r["feature"] for r in sorted(card, key=lambda r: r["position"])][:max_cols]


def _value_counts(long: DataFrame, by: Sequence[str]) -> DataFrame:
    """(…by, feature, value, tp, fp, fn, tn), null values included: partial aggregation, tiny output."""
    def cnt(yt: int, yp: int):
        return F.count_if((F.col("__yt") == yt) & (F.col("__yp") == yp))

    return long.groupBy(*by, "feature", "value").agg(
        cnt(1, 1).alias("tp"), cnt(0, 1).alias("fp"), cnt(1, 0).alias("fn"), cnt(0, 0).alias("tn"))


def slice_scan(
    scored: DataFrame,
    features: Sequence[str],
    positive_label: str,
    *,
    y_true: str = "y_true",
    y_pred: str = "y_pred",
    candidates: Sequence[str] | None = None,
    min_support: int = C.SLICE_MIN_SUPPORT,
    top: int | None = C.SLICE_TOP,
    limit: int = C.SLICE_MAX_DISTINCT,
    max_cols: int = C.SLICE_MAX_COLUMNS,
    by: Sequence[str] = (),
    sketches: DataFrame | None = None,
) -> DataFrame:
    """H3: (…by, rank, feature, value, n, rates) for the slices of the candidate columns.

    Candidates are the first ``max_cols`` feature columns with at most ``limit``
    distinct values (null included), with ``by`` those of each run.  Sketches drop
    clearly wide columns; the exact distinct counts then come out of the same
    aggregation that counts the slices, so the rows of all runs are read twice in
    all (once if ``sketches`` are given).  TPR/FPR are null when undefined (unlike
    the report).  Null values form no slice.  Slices with fewer than
    ``min_support`` rows are dropped; order is selection rate desc, n desc, column
    position, value; ``top`` keeps the best of each run.
    """
    by = list(by)
    places = list(features if candidates is None else candidates)
    flagged = scored.select(*by, positive_flag(y_true, positive_label).alias("__yt"),
                            positive_flag(y_pred, positive_label).alias("__yp"), *[c for c in places if c not in by])
    if candidates is None:
        long, cols = _narrow_values(flagged, places, limit, by, ["__yt", "__yp"], sketches)
    else:
        cols = places
        cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value")) for c in cols])
        long = flagged.select(*by, "__yt", "__yp", F.inline(cells)) if cols else None
    if not cols:
        return empty_keyed(scored, by, _SLICES)
    counts = _value_counts(long, by).withColumn("position", _positions(places))
    if candidates is None:
        # a few values of each column of a run: keep the first max_cols low-cardinality columns, in column order
        counts = counts.withColumn("__d", F.count(F.lit(1)).over(Window.partitionBy(*by, "feature")))
        first = F.dense_rank().over(Window.partitionBy(*by).orderBy("position"))
        counts = counts.where(F.col("__d") <= limit).withColumn("__col_rank", first).where(
            F.col("__col_rank") <= max_cols)
    rates = rates_from_counts(counts.where(F.col("value").isNotNull()), by, undefined="null",
                              keys=("feature", "value", "position")).where(F.col("n") >= min_support)
    # ties keep column order, then each column's own value order: numeric for numeric columns
    numeric = [f.name for f in scored.schema.fields
               if f.name in cols and f.dataType.typeName() in ("byte", "short", "integer", "long", "float",
                                                                "double", "decimal", "boolean")]
    num_key = F.when(F.col("feature").isin(numeric), F.col("value").try_cast("double")) if numeric \
        else F.lit(None).cast("double")
    rates = rates.withColumn("__num", num_key)
    order = [F.desc("selection_rate"), F.desc("n"), F.asc("position"), F.asc_nulls_last("__num"), F.asc("value")]
    # slices are already aggregated (at most limit x max_cols rows of each run)
    ranked = rates.withColumn("rank", rank_in(by, order))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    return ranked.select(*by, "rank", "feature", "value", "n", "selection_rate", "true_positive_rate",
                         "false_positive_rate")
