"""H5, G8 for many models at once: batched Newton (IRLS) logistic regressions.

One model for every run and attribute, all fitted in the same passes: a pass
adds up loss, gradient X'(p - y) and Hessian X'WX of every model, in each task
and then by key, and the (small) systems are solved key by key.  The number of
passes is that of the slowest model, about ten, whatever the number of models.

The objective of each model is sum(loss) + ||w||^2 / 2 (C = 1) without a
penalty on the intercept, the one that ``model.fit`` gives to ``pyspark.ml``.
Numeric columns are centred and scaled inside, with the penalty scaled along,
so the solution is that of the raw columns.  Levels of text columns are 0/1
columns; a level that a run does not have gets weight 0 there.

Widths: a Hessian has (columns + levels)^2 numbers, so the levels of all text
columns together are bounded by ``max_width``; wider ones need the L-BFGS of
``model.fit``, and ``TooWide`` says so.  Runs are taken ``RUNS_PER_PASS`` at a
time, which bounds what the driver and the tasks hold.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equiaudit.functions import coerce_numeric, risk_band, text_or_null_token
from equiaudit.operators import profile
from equiaudit.operators.keyed import join_by, same_key
from equiaudit.operators.prefix import top_k
from equiaudit.operators.ranking import auc
from equiaudit.operators.shift import split_feature_types
from equiaudit.session import cut_lineage, kept_once, spread, stored

MAX_WIDTH, RUNS_PER_PASS, MAX_PASSES, DECREMENT = 1_000, 500, 100, 1e-12


class TooWide(ValueError):
    """The text columns have more levels than a Hessian should have columns."""


def attribute_classes(df: DataFrame, attributes: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """(…by, attribute, n_classes, classes): all values as text in order, a missing one as "nan"."""
    cells = F.array(*[F.struct(F.lit(a).alias("attribute"), text_or_null_token(a).alias("v")) for a in attributes])
    values = df.select(*by, F.inline(cells)).distinct()
    return values.groupBy(*by, "attribute").agg(
        F.count(F.lit(1)).alias("n_classes"), F.array_sort(F.collect_list("v")).alias("classes"))


@dataclass
class Design:
    """Rows ready for the passes, (rid, y, x, levels): ``rid`` numbers the runs, ``y`` holds 0 / 1 for every attribute
    (-1 where a run has no model for it), ``x`` the numeric columns and ``levels`` the column of each text value.  The
    passes read them as ``blocks``, (rid, n, y, x, levels): n rows of one run, whose arrays are bytes."""

    rows: DataFrame  # not stored
    blocks: DataFrame
    runs: DataFrame  # (rid, …by)
    attributes: list[str]
    numeric: list[str]
    levels: list[tuple[str, str]]

    @property
    def width(self) -> int:
        return 1 + len(self.numeric) + len(self.levels)


def _imputed(df: DataFrame, num: Sequence[str], cat: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Gaps of numeric columns get their run's median, gaps of text columns its most frequent value."""
    gaps = df.agg(*[F.max(coerce_numeric(c).isNull().cast("int")).alias(f"n{i}") for i, c in enumerate(num)],
                  *[F.max(F.col(c).isNull().cast("int")).alias(f"c{i}") for i, c in enumerate(cat)],
                  F.count(F.lit(1)).alias("n")).first()
    num_gaps = [c for i, c in enumerate(num) if gaps[f"n{i}"]]
    cat_gaps = [c for i, c in enumerate(cat) if gaps[f"c{i}"]]
    fill: dict[str, Column] = {}
    if num_gaps:
        med = profile.exact_quantiles(df, num_gaps, (0.5,), by=by)
        med = med.groupBy(*by).agg(*[F.max(F.when(F.col("feature") == c, F.col("q0"))).alias(f"__m{i}")
                                     for i, c in enumerate(num_gaps)])
        df = join_by(df, cut_lineage(med), by, "left")
        fill |= {c: F.col(f"__m{i}") for i, c in enumerate(num_gaps)}
    if cat_gaps:
        cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("value")) for c in cat_gaps])
        counts = df.select(*by, F.inline(cells)).where("value is not null").groupBy(*by, "feature", "value").agg(
            F.count(F.lit(1)).alias("n"))
        best = top_k(counts, [*by, "feature"], [F.desc("n"), F.asc("value")], 1, salt_on="value")
        best = best.groupBy(*by).agg(*[F.max(F.when(F.col("feature") == c, F.col("value"))).alias(f"__t{i}")
                                       for i, c in enumerate(cat_gaps)])
        df = join_by(df, cut_lineage(best), by, "left")
        fill |= {c: F.col(f"__t{i}") for i, c in enumerate(cat_gaps)}
    none = F.lit(None)
    return df.select(
        *[c for c in df.columns if c not in {*num, *cat} and not c.startswith(("__m", "__t"))],
        *[F.coalesce(coerce_numeric(c), fill.get(c, none).cast("double"), F.lit(0.0)).alias(c) for c in num],
        *[F.coalesce(F.col(c).cast("string"), fill.get(c, none).cast("string")).alias(c) for c in cat])


def design(df: DataFrame, attributes: Sequence[str], features: Sequence[str], classes: DataFrame,
           by: Sequence[str] = (), max_width: int = MAX_WIDTH) -> Design:
    """The prepared rows of all runs, written once; ``classes`` is :func:`attribute_classes` of the same rows."""
    by, attributes = list(by), list(attributes)
    num, cat, _ = split_feature_types(df, features)  # datetimes are left out
    runs = classes.select(*by).distinct() if by else classes.limit(1).select()
    runs = cut_lineage(runs.withColumn("rid", F.monotonically_increasing_id()))
    # the second class of each attribute is the one predicted
    wide = classes.where("n_classes = 2").groupBy(*by).agg(
        *[F.max(F.when(F.col("attribute") == a, F.col("classes")[1])).alias(f"__s{i}") for i, a in enumerate(attributes)])
    wide = stored(join_by(runs, wide, by, "inner"), "proxy-runs")  # Catalyst broadcasts it by its size
    shown = join_by(df.select(*by, *[F.col(c).alias(f"f_{c}") for c in [*num, *cat]], *[
        F.col(a).alias(f"a_{a}") for a in attributes]), wide, by)
    codes = [F.when(F.col(f"__s{i}").isNull(), F.lit(-1)).otherwise(
        (text_or_null_token(f"a_{a}") == F.col(f"__s{i}")).cast("int")) for i, a in enumerate(attributes)]
    base = shown.select("rid", F.array(*codes).alias("y"), *[F.col(f"f_{c}").alias(c) for c in [*num, *cat]])
    base = _imputed(base, num, cat, ["rid"])
    levels: list[tuple[str, str]] = []
    if cat:
        cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("value")) for c in cat])
        found = base.select(F.inline(cells)).where("value is not null").distinct().limit(max_width + 1).collect()
        if len(found) > max_width:
            raise TooWide(f"the text columns have more than {max_width} levels; fit such a model with L-BFGS")
        levels = sorted((r["feature"], r["value"]) for r in found)
    at = {lv: i for i, lv in enumerate(levels)}

    def code(c: str) -> Column:
        own = [(v, i) for (f, v), i in at.items() if f == c]
        if not own:
            return F.lit(-1)
        table = F.create_map(*[F.lit(x) for v, i in own for x in (v, i)])
        return F.coalesce(F.element_at(table, F.col(c)), F.lit(-1))

    rows = base.select("rid", F.col("y").cast("array<int>").alias("y"),
                       F.array(*[F.col(c) for c in num]).cast("array<double>").alias("x"),
                       F.array(*[code(c) for c in cat]).cast("array<int>").alias("levels"))
    return Design(rows, stored(_packed(spread(rows)), "proxy-blocks"), runs, attributes, num, levels)


#: Rows of a block, and rows that a task holds before it lets go of unfilled blocks.
_ROWS, _HELD = 4096, 1 << 17
_KINDS = {"y": np.dtype(np.int8), "x": np.dtype(np.float64), "levels": np.dtype(np.int16)}


def _packed(rows: DataFrame) -> DataFrame:
    """Rows (rid, y, x, levels) as blocks of the same columns, the arrays as bytes."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list] = {}
        held = 0

        def blocks(r: int) -> Iterator[pa.RecordBatch]:
            parts = [np.concatenate(p) for p in zip(*waiting.pop(r))]
            for at in range(0, len(parts[0]), _ROWS):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r], pa.int64()), pa.array([len(parts[0][at:at + _ROWS])], pa.int64()),
                     *[pa.array([p[at:at + _ROWS].tobytes()], pa.binary()) for p in parts]], names=["rid", "n", *_KINDS])

        for batch in (b for b in batches if b.num_rows):
            n, rid = batch.num_rows, batch.column("rid").to_numpy(zero_copy_only=False)
            arrays = [batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(k).reshape(n, -1)
                      for c, k in _KINDS.items()]
            for r in np.unique(rid).tolist():
                own = slice(None) if rid[0] == r == rid[-1] and (rid == r).all() else rid == r
                parts = [a[own] for a in arrays]
                waiting.setdefault(r, []).append(parts)
                held += len(parts[0])
                if sum(len(p[0]) for p in waiting[r]) >= _ROWS:
                    held -= sum(len(p[0]) for p in waiting[r])
                    yield from blocks(r)
            if held > _HELD:
                for r in list(waiting):
                    yield from blocks(r)
                held = 0
        for r in list(waiting):
            yield from blocks(r)

    return rows.mapInArrow(pack, "rid long, n long, y binary, x binary, levels binary")


def _parts(batches: Iterator[pa.RecordBatch], n_num: int, width: int):
    """(rid, y, matrix (1, numeric, levels)) of a run's rows, block by block."""
    for batch in batches:
        for rid, n, *arrays in zip(*(batch.column(c) for c in ("rid", "n", *_KINDS)), strict=True):
            y, num, levels = (np.frombuffer(b.as_py(), dtype=k) for b, k in zip(arrays, _KINDS.values(), strict=True))
            n = n.as_py()
            x = np.zeros((n, width))
            x[:, 0] = 1.0
            x[:, 1:1 + n_num] = num.reshape(n, n_num)
            if len(levels):
                levels = levels.reshape(n, -1)
                row, col = np.nonzero(levels >= 0)
                x[row, 1 + n_num + levels[row, col]] = 1.0
            yield rid.as_py(), y.reshape(n, -1), x


def _summed(rows: DataFrame, add, n_num: int, width: int) -> dict[tuple[int, int], np.ndarray]:
    """``add(rid, y, x)`` yields (attribute, numbers) for a run's rows; their sums by run and attribute.  Added up in
    each task, then by key; one row for each model reaches the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for r, y, x in _parts(batches, n_num, width):
            for a, numbers in add(r, y, x):
                if (r, a) in sums:
                    sums[r, a] += numbers
                else:
                    sums[r, a] = numbers
        for (r, a), numbers in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([r]), pa.array([a], pa.int32()), pa.array([numbers.tobytes()])],
                                             names=["rid", "a", "sums"])

    def total(key: Any, frame: pd.DataFrame) -> pd.DataFrame:
        out = np.sum([np.frombuffer(s) for s in frame["sums"]], axis=0)
        return pd.DataFrame({"rid": [key[0]], "a": [key[1]], "sums": [out.tobytes()]})

    schema = "rid long, a int, sums binary"
    got = rows.mapInArrow(run, schema).groupBy("rid", "a").applyInPandas(total, schema).collect()
    return {(r["rid"], r["a"]): np.frombuffer(r["sums"]) for r in got}


@dataclass
class Fit:
    """A model under way: the point last accepted, the step tried from it, and the loss there."""

    mean: np.ndarray  # of the columns
    scale: np.ndarray
    point: np.ndarray
    step: np.ndarray
    loss: float = np.inf
    done: bool = False

    @property
    def tried(self) -> np.ndarray:
        return self.point + self.step

    def weights(self) -> np.ndarray:
        """Intercept and weights of the raw columns."""
        w = self.tried / self.scale
        w[0] -= float(w[1:] @ self.mean[1:])
        return w


def _advance(fit: Fit, numbers: np.ndarray) -> None:
    """One Newton step from loss, gradient and Hessian at the tried point; half the step if it made things worse."""
    k = len(fit.point)
    penalty = np.concatenate([[0.0], 1.0 / fit.scale[1:] ** 2])
    b = fit.tried
    loss = numbers[0] + 0.5 * float((penalty * b * b).sum())
    if not loss <= fit.loss * (1 + 1e-12) and np.abs(fit.step).max() > 1e-12:
        fit.step = fit.step / 2
        return
    gradient = numbers[1:1 + k] + penalty * b
    hessian = np.zeros((k, k))
    hessian[np.triu_indices(k)] = numbers[1 + k:]
    hessian = hessian + np.triu(hessian, 1).T + np.diag(penalty)
    step = -np.linalg.lstsq(hessian, gradient, rcond=None)[0]
    fit.point, fit.loss, fit.step = b, loss, step
    fit.done = bool(-gradient @ step < DECREMENT * max(1.0, abs(loss)))


def fit_all(d: Design, max_passes: int = MAX_PASSES) -> dict[tuple[int, int], np.ndarray]:
    """Raw weights (intercept first) of every (run, attribute) that has two classes."""
    out: dict[tuple[int, int], np.ndarray] = {}
    known = sorted(r["rid"] for r in d.runs.select("rid").collect())  # one number for each run
    for i in range(0, len(known), RUNS_PER_PASS):
        some = known[i:i + RUNS_PER_PASS]
        rows = d.blocks if len(some) == len(known) else d.blocks.where(F.col("rid").isin(some))
        out |= _fit_some(rows, len(d.numeric), d.width, max_passes)
    return out


def _fit_some(rows: DataFrame, n_num: int, width: int, max_passes: int) -> dict[tuple[int, int], np.ndarray]:
    columns = slice(1, 1 + n_num)  # the numeric ones

    def first(r: int, y: np.ndarray, x: np.ndarray):
        yield -1, np.concatenate([[len(x)], x[:, columns].sum(axis=0)])
        for a in range(y.shape[1]):
            if y[0, a] >= 0:
                yield a, np.zeros(1)

    facts = _summed(rows, first, n_num, width)
    means = {r: f[1:] / f[0] for (r, a), f in facts.items() if a < 0}

    def around(r: int, y: np.ndarray, x: np.ndarray):
        yield -1, np.concatenate([[len(x)], ((x[:, columns] - means[r]) ** 2).sum(axis=0)])

    spreads = {r: np.sqrt(f[1:] / f[0]) for (r, _), f in _summed(rows, around, n_num, width).items()}
    fits: dict[tuple[int, int], Fit] = {}
    for r, a in facts:
        if a < 0:
            continue
        mean, scale = np.zeros(width), np.ones(width)
        mean[columns], scale[columns] = means[r], np.where(spreads[r] > 0, spreads[r], 1.0)
        fits[r, a] = Fit(mean, scale, np.zeros(width), np.zeros(width))
    upper = np.triu_indices(width)
    for _ in range(max_passes):
        open_fits = {k: f for k, f in fits.items() if not f.done}
        if not open_fits:
            break

        def sums(r: int, y: np.ndarray, x: np.ndarray, now=open_fits):
            scaled = None
            for a in range(y.shape[1]):
                f = now.get((r, a))
                if f is None:
                    continue
                if scaled is None:
                    scaled = (x - f.mean) / f.scale
                t = scaled @ f.tried
                p = 1.0 / (1.0 + np.exp(-np.clip(t, -500, 500)))
                target = y[:, a].astype(np.float64)
                loss = float((np.logaddexp(0.0, t) - target * t).sum())
                hessian = scaled.T @ (scaled * (p * (1 - p))[:, None])
                yield a, np.concatenate([[loss], scaled.T @ (p - target), hessian[upper]])

        got = _summed(rows, sums, n_num, width)
        for key, f in open_fits.items():
            _advance(f, got[key])
    return {k: f.weights() for k, f in fits.items()}


def scored_all(d: Design, weights: dict[tuple[int, int], np.ndarray]) -> DataFrame:
    """(rid, a, y, score): the probability of the second class, for every row and each of its run's models."""
    n_num, width = len(d.numeric), d.width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r, y, x in _parts(batches, n_num, width):
            for a in range(y.shape[1]):
                w = weights.get((r, a))
                if w is not None:
                    p = 1.0 / (1.0 + np.exp(-np.clip(x @ w, -700, 700)))
                    n = len(p)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(n, r)), pa.array(np.full(n, a, dtype=np.int32)),
                         pa.array(y[:, a].astype(np.int32)), pa.array(p)], names=["rid", "a", "y", "score"])

    return d.blocks.mapInArrow(run, "rid long, a int, y int, score double")


def proxy_by(df: DataFrame, attributes: Sequence[str], features: Sequence[str], by: Sequence[str] = (),
             max_passes: int = MAX_PASSES, max_width: int = MAX_WIDTH, prepared: bool = False) -> DataFrame:
    """H5 for every run and attribute: (…by, attribute, classes, n_classes, accuracy, auc, risk_level, status).

    The rows are read several times, so their columns are written first, unless they are ``prepared`` so already.  Fitted and scored in-sample (as audited).  An attribute that does not have two classes in a run is
    ``unsupported`` there."""
    by, attributes = list(by), list(attributes)
    if not prepared:
        df = kept_once(df.select(*dict.fromkeys([*by, *attributes, *features])), "proxy-rows")
    classes = cut_lineage(attribute_classes(df, attributes, by))
    d = design(df, attributes, features, classes, by, max_width)
    weights = fit_all(d, max_passes)
    rows = stored(scored_all(d, weights), "proxy-scores")
    hit = (F.col("score") > 0.5).cast("int") == F.col("y")
    accuracy = rows.groupBy("rid", "a").agg(F.avg(hit.cast("int")).alias("accuracy"))
    found = accuracy.join(auc(rows, F.col("y"), "score", by=["rid", "a"]).select("rid", "a", "auc"), ["rid", "a"])
    names = F.array(*[F.lit(a) for a in attributes])
    found = join_by(found, d.runs.select("rid", *by), ["rid"]) if by else found
    found = found.select(*by, F.element_at(names, F.col("a") + 1).alias("attribute"), "accuracy", "auc")
    supported = F.col("n_classes") == 2
    right = found.withColumnsRenamed({c: f"__k_{c}" for c in [*by, "attribute"]})
    return classes.join(right, same_key([*by, "attribute"]), "left").select(
        *by, "attribute", F.concat_ws(",", "classes").alias("classes"), F.col("n_classes").cast("long").alias("n_classes"),
        "accuracy", "auc", F.when(supported, risk_band("auc")).alias("risk_level"),
        F.when(supported, "ok").otherwise("unsupported").alias("status"))
