"""Operator 11 against plain whole-number and numpy computations."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from equiaudit.llm.whitening import covariance, whiten

SCHEMA = "vec_id long, embedding array<float>, label int"


def _plain(vectors):
    """n, S, exact V and the eigenvalues of the distinct integer vectors."""
    x = sorted({tuple(math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v) for v in vectors})
    n, dims = len(x), len(x[0])
    s = [sum(r[i] for r in x) for i in range(dims)]
    v = np.array([[float(Fraction(sum((n * r[i] - s[i]) * (n * r[j] - s[j]) for r in x), n ** 3)) for j in range(dims)]
                  for i in range(dims)])
    return n, s, v


def _vectors(n, dims, seed):
    rnd = np.random.default_rng(seed)
    base = rnd.normal(size=(n, dims)) @ rnd.normal(size=(dims, dims))
    return base.astype(np.float32)


@pytest.mark.parametrize("dims", [5, 20])
def test_against_plain_computation(spark, dims):
    vecs = _vectors(120, dims, dims).tolist()
    vecs += [vecs[0]] * 40 + [vecs[1]]  # copies count once in the fit, each has its rows
    rows = [(i, v, 0) for i, v in enumerate(vecs)]
    rows += [(900, None, 1), (901, [None] + vecs[0][1:], 1), (902, [float("nan")] + vecs[0][1:], 1),
             (903, [float("inf")] + vecs[0][1:], 1), (0, vecs[5], 1), (None, vecs[6], 1)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("n", F.lit("clash")).withColumn("dims", F.lit(1))
    out = whiten(df.repartition(7)).toPandas()
    n, s, v = _plain(vecs)
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1], axes[:, ::-1]
    k = min(16, dims)
    assert len(out) == (len(vecs) + 2) * k and set(out.n) == {n} and out.identity_error.nunique() == 1
    assert out.identity_error.iloc[0] < 1e-9 and set(out.component) == set(range(1, k + 1))
    for i in (0, 3, 119, 130):
        mine = out[out.vec_id == i]
        x = [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in vecs[i]]
        if i:
            assert set(mine.deviation) == {sum((n * a - b) ** 2 for a, b in zip(x, s))}
            centred = np.array([float(Fraction(n * a - b, n)) for a, b in zip(x, s)])
            for c, w in zip(mine.component, mine.whitened):
                assert abs(abs(w) - abs(centred @ axes[:, c - 1] / math.sqrt(values[c - 1]))) < 1e-8
    first = out[out.vec_id == 3].set_index("component").explained
    assert np.allclose([first[c] for c in range(1, k + 1)], values[:k] / np.trace(v), rtol=1e-9)


def test_covariance_by_polarisation_is_exact():
    rnd = random.Random(1)
    x = [[rnd.randint(-10 ** 6, 10 ** 6) + 10 ** 12 for _ in range(4)] for _ in range(30)]
    n, s = 30, [sum(r[i] for r in x) for i in range(4)]
    centre = [(2 * t + n) // (2 * n) for t in s]
    rest = [t - n * m for t, m in zip(s, centre)]
    d = [[a - m for a, m in zip(r, centre)] for r in x]
    squares = [sum((r[i] + (r[j] if j > i else 0)) ** 2 for r in d) for i in range(4) for j in range(i, 4)]
    got = covariance(n, rest, squares)
    for i in range(4):
        for j in range(4):
            assert got[i, j] == float(Fraction(sum((n * r[i] - s[i]) * (n * r[j] - s[j]) for r in x), n ** 3))


def test_degenerate_tables(spark):
    assert whiten(spark.createDataFrame([], SCHEMA)).count() == 0
    assert whiten(spark.createDataFrame([(1, None, 0), (2, [], 0)], SCHEMA)).count() == 0
    one = whiten(spark.createDataFrame([(1, [0.5, 2.0], 0)] * 3, SCHEMA)).collect()
    assert len(one) == 6 and all(r.whitened is None and r.explained is None and r.deviation == 0 and r.n == 1
                                 and r.identity_error == 0 for r in one)
    # two vectors: one component with variance, the other has nothing to divide by
    two = whiten(spark.createDataFrame([(1, [0.0, 1.0], 0), (2, [1.0, 1.0], 0)], SCHEMA)).collect()
    assert sorted((r.component, r.explained, None if r.whitened is None else abs(r.whitened)) for r in two) == [
        (1, 1.0, 1.0), (1, 1.0, 1.0), (2, 0.0, None), (2, 0.0, None)]


def test_lengths_are_spaces_of_their_own(spark):
    a, b = _vectors(30, 3, 1).tolist(), _vectors(20, 4, 2).tolist()
    both = whiten(spark.createDataFrame([(i, v, 0) for i, v in enumerate(a + b)], SCHEMA))
    alone = whiten(spark.createDataFrame([(i, v, 0) for i, v in enumerate(a)], SCHEMA))
    key = ["vec_id", "component"]
    left = both.where("vec_id < 30").toPandas().sort_values(key).reset_index(drop=True)
    right = alone.toPandas().sort_values(key).reset_index(drop=True)
    assert np.allclose(left.whitened, right.whitened) and (left.deviation == right.deviation).all()
    assert both.where("vec_id >= 30").select("n").distinct().collect()[0].n == 20


def test_huge_values_and_types(spark):
    rows = [(1, [1e300, 0.0]), (2, [-1e300, 1.0]), (3, [0.0, 2.0])]
    out = whiten(spark.createDataFrame(rows, "vec_id string, embedding array<double>").withColumn(
        "vec_id", F.concat(F.lit("v"), "vec_id"))).collect()
    assert len(out) == 6 and {r.vec_id for r in out} == {"v1", "v2", "v3"}
    far = next(r for r in out if r.vec_id == "v1")
    assert far.deviation is None and int(far.deviation_digits) > 1 << 63
    ints = whiten(spark.createDataFrame([(1, [1, 2]), (2, [3, 5])], "vec_id long, embedding array<int>")).collect()
    assert {r.deviation for r in ints} == {64 ** 2 * (2 ** 2 + 3 ** 2)}
