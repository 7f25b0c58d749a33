"""H4: feature-distribution shift between the two largest groups of an attribute.

F1 picks the groups from a per-group count (two rows reach the driver);
E6 computes every numeric mean in one aggregation over the two groups;
E7/E8 unpivot the text columns once, count (group, feature, value), keep the
top-k shares per (group, feature) with a salted two-round top-k, and compare
the two distributions with a (truncated) total variation distance.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType

from equiaudit import constants as C
from equiaudit.functions import coerce_numeric, text_or_null_token
from equiaudit.operators.keyed import empty_keyed, join_by, rank_in
from equiaudit.operators.prefix import top_k


# without columns of a kind its table is empty
_NUMERIC_SHIFT = ("rank int, feature string, group_a string, group_b string, mean_a double, mean_b double, "
                  "abs_mean_diff double")
_CATEGORICAL_SHIFT = "rank int, feature string, group_a string, group_b string, total_variation_distance double"
_TOP_VALUES = "feature string, `group` string, grp_rank int, value string, share double, rank int"


def split_feature_types(df: DataFrame, cols: Sequence[str]) -> tuple[list[str], list[str], list[str]]:
    """(numeric incl. boolean, categorical, datetime) columns in column order."""
    types = {f.name: f.dataType for f in df.schema.fields}
    num, cat, dt = [], [], []
    for c in cols:
        t = types[c]
        if isinstance(t, (NumericType, BooleanType)):
            num.append(c)
        elif t.typeName() in ("date", "timestamp", "timestamp_ntz"):
            dt.append(c)
        else:
            cat.append(c)
    return num, cat, dt


def compared_groups(df: DataFrame, attribute: str) -> list[str]:
    """the two largest groups (n desc, name asc); nulls count as the group "nan"."""
    g = text_or_null_token(attribute).alias("g")
    top = df.select(g).groupBy("g").count().orderBy(F.desc("count"), F.asc("g")).limit(2).collect()
    return [r["g"] for r in top]


def _top_two(sizes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """F1 on a per-group table (…by, g, n): ranks 1 and 2 by n desc, name asc.  Two rounds, so that any number of groups
    is dealt over tasks."""
    return top_k(sizes, by, [F.desc("n"), F.asc("g")], 2, salt_on="g", rank_col="__r")


def _given(sizes: DataFrame, groups: Sequence[str]) -> DataFrame:
    """The rows of ``groups``, ranked as they are listed."""
    return sizes.withColumn("__r", F.array_position(F.array(*[F.lit(x) for x in groups]), F.col("g")).cast("int"))


def numeric_shift(df: DataFrame, attribute: str, numeric: Sequence[str], groups: Sequence[str] | None = None,
                  top: int | None = C.SHIFT_TOP, by: Sequence[str] = ()) -> DataFrame:
    """(…by, rank, feature, group_a, group_b, mean_a, mean_b, abs_mean_diff).

    Without ``groups`` the two largest groups (of each run) are found in the same
    pass: one aggregation gives every group's size and means (a table with one row
    per run and group), and the top two are picked from it.  Null differences sort
    first, then larger differences, then column order.
    """
    by = list(by)
    if not numeric:
        return empty_keyed(df, by, _NUMERIC_SHIFT)
    g = text_or_null_token(attribute).alias("g")
    base = df.select(*by, g, *[coerce_numeric(c).alias(f"x{i}") for i, c in enumerate(numeric)])
    if groups is not None:
        base = base.where(F.col("g").isin(list(groups)))  # C3
    per_group = base.groupBy(*by, "g").agg(F.count(F.lit(1)).alias("n"),
                                           *[F.avg(f"x{i}").alias(f"m{i}") for i in range(len(numeric))])
    two = _given(per_group, groups) if groups is not None else _top_two(per_group, by)

    def pick(r, c):
        return F.max(F.when(F.col("__r") == r, F.col(c)))

    wide = two.groupBy(*by).agg(pick(1, "g").alias("group_a"), pick(2, "g").alias("group_b"),
                                *[pick(1, f"m{i}").alias(f"a{i}") for i in range(len(numeric))],
                                *[pick(2, f"m{i}").alias(f"b{i}") for i in range(len(numeric))])
    rows = F.array(*[
        F.struct(F.lit(c).alias("feature"), F.lit(i).alias("position"),
                 F.col(f"a{i}").alias("mean_a"), F.col(f"b{i}").alias("mean_b"))
        for i, c in enumerate(numeric)
    ])
    long = wide.where(F.col("group_b").isNotNull()).select(*by, "group_a", "group_b", F.inline(rows)).select(
        *by, "feature", "position", "group_a", "group_b", "mean_a", "mean_b",
        F.abs(F.col("mean_a") - F.col("mean_b")).alias("abs_mean_diff"),
    )
    return _ranked(long, [F.col("abs_mean_diff").desc_nulls_first(), F.asc("position")], top,
                   ["feature", "group_a", "group_b", "mean_a", "mean_b", "abs_mean_diff"], by)


def _ranked_top_values(df: DataFrame, attribute: str, categorical: Sequence[str],
                       groups: Sequence[str] | None, k: int | None, by: Sequence[str]) -> DataFrame:
    """(…by, feature, group, grp_rank, value, share, rank); grp_rank 1 is the larger compared group."""
    if not categorical:
        return empty_keyed(df, by, _TOP_VALUES)
    base = df.select(*by, text_or_null_token(attribute).alias("group"),
                     *[text_or_null_token(c).alias(f"c{i}") for i, c in enumerate(categorical)])
    if groups is not None:
        base = base.where(F.col("group").isin(list(groups)))  # C3
    # the compared groups first (two rows of each run), so that values are counted for them alone
    sizes = base.groupBy(*by, F.col("group").alias("g")).agg(F.count(F.lit(1)).alias("n"))
    pair = _given(sizes, groups) if groups is not None else _top_two(sizes, by)
    pair = pair.select(*by, F.col("g").alias("group"), F.col("n").alias("total"), F.col("__r").alias("grp_rank"))
    kept = join_by(base, pair, [*by, "group"]) if by else base.join(F.broadcast(pair), "group")
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"c{i}").alias("value"))
                      for i, c in enumerate(categorical)])
    long = kept.select(*by, "group", "total", "grp_rank", F.inline(cells))
    counts = long.groupBy(*by, "group", "total", "grp_rank", "feature", "value").agg(F.count(F.lit(1)).alias("cnt"))
    # every row has one value per column, so a group's size is the total of each column
    shares = counts.withColumn("share", F.col("cnt").cast("double") / F.col("total").cast("double"))
    order = [F.desc("cnt"), F.asc("value")]
    if k is not None:
        shares = top_k(shares, [*by, "group", "feature"], order, k, salt_on="value")
    else:
        shares = shares.withColumn("rank", F.lit(None).cast("int"))
    return shares.select(*by, "feature", "group", "grp_rank", "value", "share", F.col("rank").cast("int").alias("rank"))


def top_values(df: DataFrame, attribute: str, categorical: Sequence[str], groups: Sequence[str] | None = None,
               k: int | None = C.TVD_TOP_K, by: Sequence[str] = ()) -> DataFrame:
    """(…by, feature, group, value, share, rank): each compared group's k most frequent values
    per column (null shown as "nan"), share of the group's rows; ties by value.

    Two reads of the rows: group sizes, then the values of the two groups compared.
    """
    by = list(by)
    return _ranked_top_values(df, attribute, categorical, groups, k, by).select(
        *by, "feature", "group", "value", "share", "rank")


def categorical_shift(df: DataFrame, attribute: str, categorical: Sequence[str],
                      groups: Sequence[str] | None = None, k: int | None = C.TVD_TOP_K,
                      top: int | None = C.SHIFT_TOP, by: Sequence[str] = ()) -> DataFrame:
    """(…by, rank, feature, group_a, group_b, total_variation_distance) over the top-k shares."""
    by = list(by)
    if not categorical:
        return empty_keyed(df, by, _CATEGORICAL_SHIFT)
    tv = _ranked_top_values(df, attribute, categorical, groups, k, by)

    def side(r, c):
        return F.max(F.when(F.col("grp_rank") == r, F.col(c)))

    per_value = tv.groupBy(*by, "feature", "value").agg(
        F.coalesce(side(1, "share"), F.lit(0.0)).alias("pa"),
        F.coalesce(side(2, "share"), F.lit(0.0)).alias("pb"),
        side(1, "group").alias("ga"), side(2, "group").alias("gb"),
    )
    tvd = per_value.groupBy(*by, "feature").agg(
        (F.lit(0.5) * F.sum(F.abs(F.col("pa") - F.col("pb")))).alias("total_variation_distance"),
        F.max("ga").alias("group_a"), F.max("gb").alias("group_b"),
    ).where(F.col("group_b").isNotNull())
    position = F.array_position(F.array(*[F.lit(c) for c in categorical]), F.col("feature"))
    long = tvd.select(*by, "feature", position.alias("position"), "group_a", "group_b", "total_variation_distance")
    return _ranked(long, [F.desc("total_variation_distance"), F.asc("position")], top,
                   ["feature", "group_a", "group_b", "total_variation_distance"], by)


def _ranked(df: DataFrame, order, top, cols, by: Sequence[str]) -> DataFrame:
    """Rank a per-feature table (one row per column of a run, so a tiny window)."""
    out = df.withColumn("rank", rank_in(by, order))
    if top is not None:
        out = out.where(F.col("rank") <= top)
    return out.select(*by, "rank", *cols)


def feature_distribution(df: DataFrame, attribute: str, features: Sequence[str], k: int | None = C.TVD_TOP_K,
                         top: int | None = C.SHIFT_TOP) -> dict:
    """H4 driver: returns {"groups", "numeric", "categorical"} DataFrames, or an error text."""
    groups = compared_groups(df, attribute)
    if len(groups) < 2:
        return {"attribute": attribute, "error": f"a comparison takes two groups; there are {len(groups)}"}
    num, cat, dt = split_feature_types(df, features)
    return {
        "attribute": attribute,
        "groups": groups,
        "numeric": numeric_shift(df, attribute, num, groups, top),
        "categorical": categorical_shift(df, attribute, cat + dt, groups, k, top),
    }
