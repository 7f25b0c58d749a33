"""Embedding whitening by polarisation (operator 11).

1. Every vector becomes integers, x = floor(scale * c) + offset, packed into as
   few bytes as it needs: the same integers always give the same bytes, so the
   fit list is ``distinct`` over short binary keys, partly done before the
   shuffle, and copies by the thousand cost one row.
2. One pass over the fit list adds up n and the sums S.
3. A second pass adds up, for every dimension i and every sum of two dimensions
   i + j, the squares of the values centred at round(S / n): integers, so
   sums in any order are exact.  With r = S - n * round(S / n) the squares
   around the true mean follow exactly, n * (n * Q - r * r) for a sum Q of
   squares; half of what the variance of i + j exceeds the variances of i and j
   by is the covariance of i and j.
4. The driver assembles the D x D matrix in whole numbers, divides once, and
   takes its eigenvectors.  Tasks project the rows.
5. A third pass over the fit list adds up the products of the whitened values,
   whose covariance is compared with the identity.

The driver holds D * (D + 1) / 2 numbers of each vector length; tasks hold the
same and a slice of rows, whatever their number.

Defined cases: rows whose vector is null, or holds null, NaN or infinity, are
dropped.  Vectors of another length are a space of their own, fitted by
themselves; empty vectors have no components and give no rows.  x saturates at
2**61 either way.  Components beyond the rank of V (one vector, equal ones,
constant dimensions) have nothing to divide by: whitened is null, explained 0
(null where V is all 0), and they are left out of identity_error, which is 0
if none is left.  ``deviation`` is null where it passes a long; its digits are
then in ``deviation_digits``.  Ids may be null or repeated; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equiaudit.llm.common import written

SCALE, OFFSET, COMPONENTS = 64, 1_000_000, 16
_LIMIT = 1 << 61
#: Sums are sent as high * 2**60 + low.
_LOW = 1 << 60
_WIDTHS = (np.int8, np.int16, np.int32, np.int64)
#: Rows of a slice times their dimensions.
SLICE = 1 << 16


def _packed(x: np.ndarray, offset: int) -> list[bytes]:
    """Each row of ``x`` less ``offset`` in the narrowest integers that hold it, after a byte that tells which."""
    d = x - offset
    size = np.maximum(d.max(axis=1), ~d.min(axis=1)) if d.shape[1] else np.zeros(len(d), dtype=np.int64)
    width = sum((size > np.iinfo(t).max).astype(np.int64) for t in _WIDTHS[:-1])
    out: list[bytes] = [b""] * len(d)
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        kind = np.dtype(_WIDTHS[w]).newbyteorder("<")
        for i, raw in zip(rows.tolist(), d[rows].astype(kind), strict=True):
            out[i] = bytes((int(w),)) + raw.tobytes()
    return out


def _unpacked(keys: list[bytes], dims: int, offset: int) -> np.ndarray:
    d = np.empty((len(keys), dims), dtype=np.int64)
    for i, key in enumerate(keys):
        d[i] = np.frombuffer(key, dtype=np.dtype(_WIDTHS[key[0]]).newbyteorder("<"), offset=1)
    return d + offset


def vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE,
            offset: int = OFFSET) -> DataFrame:
    """(vec_id, dims, key) of the rows whose vector is whole; ``key`` holds the integers."""
    src = rows.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    kind = dict(src.dtypes)["vec_id"]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            dims = lists.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
            for d in np.unique(dims[dims > 0]).tolist():
                at = np.flatnonzero(dims == d)
                step = max(1, SLICE // d)
                for i in range(0, len(at), step):
                    part = lists.take(pa.array(at[i:i + step]))
                    c = part.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, d)
                    good = np.isfinite(c).all(axis=1)
                    with np.errstate(over="ignore"):
                        x = np.clip(np.floor(c[good] * scale), -_LIMIT, _LIMIT).astype(np.int64) + offset
                    keys = _packed(x, offset)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(at[i:i + step][good])), pa.array([d] * len(keys), pa.int32()),
                         pa.array(keys, pa.binary())], names=["vec_id", "dims", "key"])

    return src.where("v is not null").mapInArrow(pack, f"vec_id {kind}, dims int, key binary")


def _blocks(batch: pa.RecordBatch, offset: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(dims, places, integers) for slices of rows of one length."""
    dims = batch.column("dims").to_numpy(zero_copy_only=False)
    keys = batch.column("key")
    for d in np.unique(dims).tolist():
        at = np.flatnonzero(dims == d)
        step = max(1, SLICE // d)
        for i in range(0, len(at), step):
            place = at[i:i + step]
            yield d, place, _unpacked(keys.take(pa.array(place)).to_pylist(), d, offset)


def _exact_sum(x: np.ndarray) -> list[int]:
    """Column sums of integers, without overflow."""
    if x.size and max(abs(int(x.max())), abs(int(x.min()))) >= (1 << 62) // len(x):
        x = x.astype(object)
    return [int(s) for s in x.sum(axis=0)]


def _square_sums(d: np.ndarray) -> list[int]:
    """Sums over the rows of (d_i + d_j)**2 for all i <= j, and of d_i**2 where i = j; row by row of the upper
    triangle."""
    big = bool(d.size) and max(abs(int(d.max())), abs(int(d.min()))) ** 2 * 4 * len(d) >= 1 << 62
    wide, out = d.astype(object) if big else d, []
    for i in range(d.shape[1]):
        pair = wide[:, i + 1:] + wide[:, i:i + 1]
        out.append(int((wide[:, i] * wide[:, i]).sum()))
        out += [int(s) for s in (pair * pair).sum(axis=0)]
    return out


def _totals(fit: DataFrame, offset: int, add) -> dict[int, list[int]]:
    """For each length the sums over the fit list of what ``add`` gives for a block of integers: (dims, integers) ->
    list of whole numbers.  Added up in each task, then by Spark; one number of each kind reaches the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list[int]] = {}
        for batch in batches:
            for d, _, x in _blocks(batch, offset):
                got = add(d, x)
                sums[d] = [a + b for a, b in zip(sums[d], got, strict=True)] if d in sums else got
        for d, values in sums.items():
            high, low = zip(*(divmod(v, _LOW) for v in values), strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array([d] * len(values), pa.int32()), pa.array(range(len(values)), pa.int32()),
                 pa.array([str(h) for h in high]), pa.array(low, pa.int64())], names=["dims", "k", "high", "low"])

    parts = fit.select("dims", "key").mapInArrow(run, "dims int, k int, high string, low long")
    summed = parts.groupBy("dims", "k").agg(F.sum(F.col("high").cast("decimal(38,0)")).cast("string").alias("high"),
                                            F.sum(F.col("low").cast("decimal(38,0)")).cast("string").alias("low"))
    out: dict[int, dict[int, int]] = {}
    for r in summed.collect():
        out.setdefault(r["dims"], {})[r["k"]] = int(r["high"]) * _LOW + int(r["low"])
    return {d: [got[k] for k in range(len(got))] for d, got in out.items()}


@dataclass
class Space:
    """What is known of the vectors of one length: n, S, eigenvalues and unit eigenvectors (as columns), both by
    falling eigenvalue, and the trace; ``usable`` components have an eigenvalue that is not rounding."""

    n: int
    sums: list[int]
    values: np.ndarray
    axes: np.ndarray
    trace: float
    error: float = 0.0

    def __post_init__(self):
        self.centre = [(2 * s + self.n) // (2 * self.n) for s in self.sums]
        self.rest = [s - self.n * m for s, m in zip(self.sums, self.centre, strict=True)]

    @property
    def usable(self) -> np.ndarray:
        return self.values > max(self.trace, 0.0) * len(self.sums) * np.finfo(float).eps * 4

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S / n."""
        d = (x - np.array(self.centre, dtype=np.int64)).astype(np.float64)
        return d - np.array([r / self.n for r in self.rest])

    def whitened(self, x: np.ndarray) -> np.ndarray:
        """By row and component; NaN where there is nothing to divide by."""
        with np.errstate(divide="ignore", invalid="ignore"):
            scale = np.where(self.usable, 1 / np.sqrt(np.where(self.usable, self.values, 1.0)), np.nan)
        return (self.centred(x) @ self.axes) * scale

    def deviations(self, x: np.ndarray) -> list[int]:
        """The sum over dimensions of (n * x - S)**2."""
        d = x - np.array(self.centre, dtype=np.int64)
        top = self.n * max(abs(int(d.max())), abs(int(d.min())), 1) + self.n
        if top * top * max(1, d.shape[1]) < 1 << 62:
            y = self.n * d - np.array(self.rest, dtype=np.int64)
        else:
            y = self.n * d.astype(object) - np.array(self.rest, dtype=object)
        return [int(v) for v in (y * y).sum(axis=1)]


def covariance(n: int, rest: list[int], squares: list[int]) -> np.ndarray:
    """The covariance from sums of squares of all dimensions and pairs: numerators are exact, each is divided once."""
    dims = len(rest)
    first = np.cumsum([0, *range(dims, 0, -1)])
    # n * n times the sum of squares around the mean, divided by n
    around = [[n * squares[first[i] + j - i] - (rest[i] + (rest[j] if j > i else 0)) ** 2 for j in range(i, dims)]
              for i in range(dims)]
    out = np.empty((dims, dims))
    for i in range(dims):
        out[i, i] = around[i][0] / (n * n)
        for j in range(i + 1, dims):
            out[i, j] = out[j, i] = (around[i][j - i] - around[i][0] - around[j][0]) / (2 * n * n)
    return out


def fit_spaces(fit: DataFrame, offset: int = OFFSET, components: int = COMPONENTS) -> dict[int, Space]:
    """A ``Space`` for each length in the fit list (dims, key), which has each vector once."""
    counted = _totals(fit, offset, lambda d, x: [len(x), *_exact_sum(x)])
    spaces = {}
    for d, (n, *sums) in counted.items():
        spaces[d] = Space(n, sums, np.zeros(0), np.zeros((d, 0)), 0.0)
    centres = {d: np.array(s.centre, dtype=np.int64) for d, s in spaces.items()}
    squares = _totals(fit, offset, lambda d, x: _square_sums(x - centres[d]))
    for d, s in spaces.items():
        v = covariance(s.n, s.rest, squares[d])
        values, axes = np.linalg.eigh(v)
        order = np.argsort(-values, kind="stable")[:components]
        axes = axes[:, order]
        axes *= np.where(axes[np.abs(axes).argmax(axis=0), np.arange(len(order))] < 0, -1.0, 1.0)  # one sign
        spaces[d] = Space(s.n, s.sums, np.maximum(values[order], 0.0), axes, float(np.trace(v)))
    _measure(fit, spaces, offset)
    return spaces


def _measure(fit: DataFrame, spaces: dict[int, Space], offset: int) -> None:
    """``error`` of every space: the covariance of the fit list's whitened values against the identity."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for d, _, x in _blocks(batch, offset):
                w = spaces[d].whitened(x)[:, spaces[d].usable]
                w = np.hstack([w, np.ones((len(w), 1))])
                sums[d] = sums.get(d, 0.0) + w.T @ w
        for d, m in sums.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([d] * m.size, pa.int32()), pa.array(range(m.size), pa.int32()), pa.array(m.ravel())],
                names=["dims", "k", "s"])

    got: dict[int, dict[int, float]] = {}
    summed = fit.select("dims", "key").mapInArrow(run, "dims int, k int, s double").groupBy("dims", "k").agg(
        F.sum("s").alias("s"))
    for r in summed.collect():
        got.setdefault(r["dims"], {})[r["k"]] = r["s"]
    for d, sums in got.items():
        side = int(spaces[d].usable.sum()) + 1
        m = np.array([sums[k] for k in range(side * side)]).reshape(side, side) / spaces[d].n
        if side > 1:
            spaces[d].error = float(np.abs(m[:-1, :-1] - np.outer(m[-1, :-1], m[-1, :-1]) - np.eye(side - 1)).max())


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = SCALE,
           offset: int = OFFSET, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error, deviation_digits): one row for each whole
    vector and each of the first ``components`` components."""
    packed = vectors(rows, id_col, vector_col, scale, offset)
    kind = dict(packed.dtypes)["vec_id"]
    fit = written(packed.select("dims", "key").distinct(), "whitening-fit")
    spaces = fit_spaces(fit, offset, components)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, place, x in _blocks(batch, offset):
                s = spaces[d]
                k = len(s.values)
                white, exact = s.whitened(x).ravel(), s.deviations(x)
                fits = [v if v < 1 << 63 else None for v in exact]
                share = s.values / s.trace if s.trace > 0 else np.full(k, np.nan)
                n = len(place)
                wide = np.repeat(np.arange(n), k)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(place[wide])), pa.array(np.tile(np.arange(1, k + 1), n), pa.int32()),
                     pa.array(np.full(n * k, s.n, dtype=np.int64)), pa.array(fits, pa.int64()).take(pa.array(wide)),
                     pa.array(white, from_pandas=True), pa.array(np.tile(share, n), from_pandas=True),
                     pa.array(np.full(n * k, s.error)),
                     pa.array([str(v) if f is None else None for v, f in zip(exact, fits, strict=True)],
                              pa.string()).take(pa.array(wide))],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error",
                           "deviation_digits"])

    return packed.mapInArrow(
        project, f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, "
                 "identity_error double, deviation_digits string")
