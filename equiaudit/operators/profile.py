"""E11-E13 column profiles, G3-G5 imputers and scaler.

Quantiles are exact by default, found between brackets that a sketch gives (no
buffer of all values, unlike ``percentile``/``median``, and no shuffle of all
distinct ones); ``method="approx"`` uses ``percentile_approx``.
"""

from __future__ import annotations

import math
from typing import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from equiaudit import constants as C
from equiaudit.functions import coerce_numeric, text_or_null_token
from equiaudit.operators.keyed import join_by
from equiaudit.operators.prefix import running_totals, top_k
from equiaudit.session import cut_lineage


def _numeric_long(df: DataFrame, cols: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), coerce_numeric(c).alias("value")) for c in cols])
    return df.select(*by, F.inline(cells)).where(F.col("value").isNotNull())


#: ``percentile_approx`` is at most this share of the rows off its rank.
_SKETCH = 10_000
#: Distinct values between two brackets that are ranked; a bracket that holds more is narrowed first.
INSIDE = 1_000_000


def exact_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], by: Sequence[str] = (),
                    inside: int = INSIDE) -> DataFrame:
    """(…by, feature, q0, q1, ...) with linear interpolation between order statistics
    (the usual ``(n - 1) * p`` rule); nulls and NaN ignored.

    Without ``by`` by bracketing: a quantile sketch gives two values that the wanted ranks lie between, a pass
    counts the rows below them, and only values inside are shuffled and ranked, about 1 in 2,500 rows.  A bracket
    that holds more than ``inside`` distinct values is narrowed by another sketch of what it holds.  With ``by``
    values are counted and ranked by running totals."""
    if by:
        return _ranked_quantiles(df, cols, probs, list(by))
    spark, cols = df.sparkSession, list(cols)
    fields = ", ".join(["feature string", *[f"q{i} double" for i in range(len(probs))]])
    values = df.select(*[coerce_numeric(c).alias(f"v{i}") for i, c in enumerate(cols)])
    ranks, brackets = _first_brackets(values, len(cols), probs)
    got: dict[tuple[int, int], tuple[float, float]] = {}
    while brackets:
        below, held = _tally(values, brackets)
        small = {k for k in brackets if held[k] <= inside}
        if small:
            got |= _pick(values, {k: brackets[k] for k in small}, {k: (ranks[k], below[k]) for k in small})
        brackets = _narrowed(values, {k: b for k, b in brackets.items() if k not in small}, ranks, below, held)
    rows = []
    for i, c in enumerate(cols):
        if (i, 0) in got:
            between = [got[i, j] for j in range(len(probs))]
            part = [h - math.floor(h) for h in (ranks[i, j] for j in range(len(probs)))]
            rows.append((c, *[lo + (hi - lo) * f if f else lo for (lo, hi), f in zip(between, part, strict=True)]))
    return spark.createDataFrame(rows, fields)


_Key = tuple[int, int]  # column, probability


def _first_brackets(values: DataFrame, n_cols: int, probs: Sequence[float]) -> tuple[dict[_Key, float], dict[_Key, tuple]]:
    """The wanted ranks, counted from 0, and two values around each.  One row reaches the driver."""
    margin = 2.0 / _SKETCH
    asked = [p for q in probs for p in (max(0.0, q - margin), min(1.0, q + margin))]
    row = values.agg(*[F.count(f"v{i}").alias(f"n{i}") for i in range(n_cols)],
                     *[F.min(f"v{i}").alias(f"lo{i}") for i in range(n_cols)],
                     *[F.max(f"v{i}").alias(f"hi{i}") for i in range(n_cols)],
                     *[F.percentile_approx(f"v{i}", asked, _SKETCH).alias(f"q{i}") for i in range(n_cols)]).first()
    ranks, brackets = {}, {}
    for i in range(n_cols):
        n = row[f"n{i}"]
        for j, p in enumerate(probs if n else []):
            ranks[i, j] = (n - 1) * float(p)
            lo, hi = row[f"q{i}"][2 * j], row[f"q{i}"][2 * j + 1]
            # at the ends of a small table the sketch is not asked
            brackets[i, j] = (row[f"lo{i}"] if p <= margin or n < _SKETCH else lo,
                              row[f"hi{i}"] if p >= 1 - margin or n < _SKETCH else hi)
    return ranks, brackets


def _within(key: _Key, bracket: tuple[float, float]) -> Column:
    v = F.col(f"v{key[0]}")
    return (v >= F.lit(bracket[0])) & (v <= F.lit(bracket[1]))


def _tally(values: DataFrame, brackets: dict[_Key, tuple]) -> tuple[dict[_Key, int], dict[_Key, int]]:
    """Exact rows below each bracket, and about how many distinct values it holds.  One row reaches the driver."""
    keys = list(brackets)
    row = values.agg(
        *[F.count_if(F.col(f"v{k[0]}") < F.lit(brackets[k][0])).alias(f"b{i}") for i, k in enumerate(keys)],
        *[F.approx_count_distinct(F.when(_within(k, brackets[k]), F.col(f"v{k[0]}"))).alias(f"d{i}")
          for i, k in enumerate(keys)]).first()
    return {k: row[f"b{i}"] for i, k in enumerate(keys)}, {k: row[f"d{i}"] for i, k in enumerate(keys)}


def _inside(values: DataFrame, brackets: dict[_Key, tuple]) -> DataFrame:
    """(col, prob, value) of the rows in a bracket."""
    cells = F.array(*[F.when(_within(k, b), F.struct(F.lit(k[0]).alias("col"), F.lit(k[1]).alias("prob"),
                                                     F.col(f"v{k[0]}").alias("value"))) for k, b in brackets.items()])
    return values.select(F.inline(F.filter(cells, lambda x: x.isNotNull())))


def _pick(values: DataFrame, brackets: dict[_Key, tuple], wanted: dict[_Key, tuple[float, int]]) -> dict[_Key, tuple]:
    """The values at the ranks on either side, from counts of the distinct values inside the brackets."""
    spark = values.sparkSession
    counts = _inside(values, brackets).groupBy("col", "prob", "value").agg(F.count(F.lit(1)).alias("cnt"))
    asked = spark.createDataFrame([(c, p, math.floor(r) - below, math.ceil(r) - below) for (c, p), (r, below) in wanted.items()],
                                  "col int, prob int, lo long, hi long")
    w = Window.partitionBy("col", "prob").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = counts.withColumn("upto", F.sum("cnt").over(w)).join(F.broadcast(asked), ["col", "prob"])
    # the first value that passes the rank
    rows = upto.groupBy("col", "prob").agg(F.min(F.when(F.col("upto") > F.col("lo"), F.col("value"))).alias("a"),
                                           F.min(F.when(F.col("upto") > F.col("hi"), F.col("value"))).alias("b"))
    return {(r["col"], r["prob"]): (r["a"], r["b"]) for r in rows.collect()}


def _narrowed(values: DataFrame, brackets: dict[_Key, tuple], ranks: dict[_Key, float], below: dict[_Key, int],
              held: dict[_Key, int]) -> dict[_Key, tuple]:
    """Closer brackets from a sketch of what the wide ones hold."""
    if not brackets:
        return {}
    keys, margin = list(brackets), 2.0 / _SKETCH
    sizes = values.agg(*[F.count_if(_within(k, brackets[k])).alias(f"c{i}") for i, k in enumerate(keys)]).first()
    asked = {}
    for i, k in enumerate(keys):
        n = sizes[f"c{i}"]
        asked[k] = [max(0.0, (math.floor(ranks[k]) - below[k]) / n - margin),
                    min(1.0, (math.ceil(ranks[k]) - below[k] + 1) / n + margin)]
    row = values.agg(*[F.percentile_approx(F.when(_within(k, brackets[k]), F.col(f"v{k[0]}")), asked[k], _SKETCH)
                       .alias(f"q{i}") for i, k in enumerate(keys)]).first()
    return {k: tuple(row[f"q{i}"]) for i, k in enumerate(keys)}


def _ranked_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], by: list[str]) -> DataFrame:
    key = [*by, "feature"]
    d = _numeric_long(df, cols, by).groupBy(*key, "value").agg(F.count(F.lit(1)).alias("cnt"))
    d = cut_lineage(d)  # read for bounds, bucket sums, rows and counts: computed once
    rt = running_totals(d, "value", ["cnt"], by=key)
    n = d.groupBy(*key).agg(F.sum("cnt").alias("__n"))
    j = join_by(rt, n, key)
    aggs = []
    for i, p in enumerate(probs):
        h = (F.col("__n") - 1).cast("double") * F.lit(float(p))
        for side, r in (("lo", F.floor(h)), ("hi", F.ceil(h))):
            covers = (F.col("cnt_before") <= r) & (r < F.col("cnt_before") + F.col("cnt"))
            aggs.append(F.max(F.when(covers, F.col("value"))).alias(f"__{side}{i}"))
        aggs.append(F.max(h - F.floor(h)).alias(f"__f{i}"))
    wide = j.groupBy(*key).agg(*aggs)
    return wide.select(
        *key,
        *[(F.col(f"__lo{i}") + (F.col(f"__hi{i}") - F.col(f"__lo{i}")) * F.col(f"__f{i}")).alias(f"q{i}")
          for i in range(len(probs))],
    )


def approx_quantiles(df: DataFrame, cols: Sequence[str], probs: Sequence[float], accuracy: int = 10000) -> DataFrame:
    long = _numeric_long(df, cols)
    q = long.groupBy("feature").agg(F.percentile_approx("value", list(probs), accuracy).alias("q"))
    return q.select("feature", *[F.col("q")[i].alias(f"q{i}") for i in range(len(probs))])


def numeric_profile(df: DataFrame, cols: Sequence[str], method: str = "exact") -> DataFrame:
    """(feature, count, mean, std, min, q25, q50, q75, max); std is the sample deviation."""
    probs = (0.25, 0.5, 0.75)
    long = _numeric_long(df, cols)
    moments = long.groupBy("feature").agg(
        F.count("value").alias("count"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    qf = exact_quantiles if method == "exact" else approx_quantiles
    q = qf(df, cols, probs).select("feature", F.col("q0").alias("q25"), F.col("q1").alias("q50"),
                                   F.col("q2").alias("q75"))
    return moments.join(q, "feature", "left").select(
        "feature", "count", "mean", "std", "min", "q25", "q50", "q75", "max"
    )


def null_profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(feature, dtype, non_null, nulls) in one aggregation."""
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    aggs = []
    for i, c in enumerate(cols):
        aggs += [F.count(c).alias(f"nn{i}"), F.count(F.lit(1)).alias(f"n{i}")]
    wide = df.agg(*aggs)
    rows = F.array(*[
        F.struct(F.lit(c).alias("feature"), F.lit(types[c]).alias("dtype"), F.col(f"nn{i}").alias("non_null"),
                 (F.col(f"n{i}") - F.col(f"nn{i}")).alias("nulls"))
        for i, c in enumerate(cols)
    ])
    return wide.select(F.inline(rows))


def frequent_values(df: DataFrame, cols: Sequence[str], k: int = C.PROFILE_TOP_VALUES) -> DataFrame:
    """(feature, value, count, rank): the k most frequent values per column, null shown as "nan"."""
    long = df.select(*[text_or_null_token(c).alias(c) for c in cols]).unpivot(
        ids=[], values=list(cols), variableColumnName="feature", valueColumnName="value"
    )
    counts = long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("count"))
    top = top_k(counts, ["feature"], [F.desc("count"), F.asc("value")], k, salt_on="value")
    return top.select("feature", "value", "count", F.col("rank").cast("int").alias("rank"))


def column_medians(df: DataFrame, cols: Sequence[str]) -> dict[str, float | None]:
    """One number per column reaches the driver."""
    if not cols:
        return {}
    rows = exact_quantiles(df, cols, (0.5,)).collect()
    got = {r["feature"]: r["q0"] for r in rows}
    return {c: got.get(c) for c in cols}


def column_modes(df: DataFrame, cols: Sequence[str]) -> dict[str, str | None]:
    """Most frequent non-null value per column, smallest on ties (one value per column to the driver).

    Counting is a distributed aggregation; the per-column winner is a salted top-1,
    so no task ever holds all distinct values of a wide text column.
    """
    if not cols:
        return {}
    long = df.select(*[F.col(c).cast("string").alias(c) for c in cols]).unpivot(
        ids=[], values=list(cols), variableColumnName="feature", valueColumnName="value"
    ).where(F.col("value").isNotNull())
    counts = long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("cnt"))
    top = top_k(counts, ["feature"], [F.desc("cnt"), F.asc("value")], 1, salt_on="value").collect()
    got = {r["feature"]: r["value"] for r in top}
    return {c: got.get(c) for c in cols}


def impute_median(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """nulls/NaN in numeric columns replaced by the column's exact median."""
    med = column_medians(df, cols)
    return df.select(*[
        F.coalesce(coerce_numeric(c), F.lit(med[c]).cast("double")).alias(c) if c in med else F.col(c)
        for c in df.columns
    ])


def impute_mode(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Nulls in text columns replaced by the most frequent value (smallest on ties)."""
    mode = column_modes(df, cols)
    return df.select(*[
        F.coalesce(F.col(c).cast("string"), F.lit(mode[c])).alias(c) if c in mode else F.col(c)
        for c in df.columns
    ])


def unit_scale_factors(df: DataFrame, cols: Sequence[str]) -> dict[str, float]:
    """Population standard deviation per column; 0 or undefined -> 1 (column kept as is)."""
    if not cols:
        return {}
    row = df.agg(*[F.stddev_pop(coerce_numeric(c)).alias(c) for c in cols]).first()
    return {c: (row[c] if row[c] not in (None, 0.0) and row[c] == row[c] else 1.0) for c in cols}


def scale_unit(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Divide by the population deviation, no centring."""
    f = unit_scale_factors(df, cols)
    return df.select(*[
        (coerce_numeric(c) / F.lit(f[c])).alias(c) if c in f else F.col(c) for c in df.columns
    ])
