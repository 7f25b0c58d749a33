"""Operator 12 against a brute-force version."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from equiaudit.llm.resampling import cutoff, highest, ranked, resample, run_codes, shifted

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _features(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return [" ".join(w[i:i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)], len(w)


def _bucket(feature):
    return zlib.crc32(feature.encode()) % 10_000


def brute(docs, bench):
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(map(_bucket, _features(text)[0]))
    for text in bench:
        t.update(map(_bucket, _features(text)[0]))
    S, T = sum(s.values()), sum(t.values())

    def gain(b):
        return math.floor(1000 * math.log((t[b] + 1) * (S + 10_000) / ((s[b] + 1) * (T + 10_000))))

    out = []
    for i, text in docs:
        f, n = _features(text)
        w = sum(gain(_bucket(x)) for x in f)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(f), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2 ** 32))), n])
    able = sorted((r for r in out if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    rank = {id(r): k for k, r in enumerate(able[:5 * len(able) // 100], 1)}
    return [tuple(r[:4]) + (rank.get(id(r)),) for r in out]


def _sorted(rows):
    return sorted(map(tuple, rows), key=lambda r: tuple((x is None, x or 0) for x in r))


def test_against_brute_force(spark, docs_of, prose):
    rnd = random.Random(4)
    docs = [(i, prose(rnd.randint(15, 60), i)) for i in range(300)]
    docs += [(1000, None), (1001, ""), (1002, "... !!"), (1003, prose(5000, 9) + " " + "x" * 300_000),
             (1004, "ÀÉ Straße ABC 12 a-b" * 9), (1005, prose(19, 3)), (7, prose(40, 8)), (None, prose(200, 77))]
    bench = [prose(50, 100 + i) for i in range(20)] + [None, ""]
    target = spark.createDataFrame([(i, t) for i, t in enumerate(bench)], "item_id long, text string")
    got = resample(docs_of(*docs).withColumn("score", F.lit("clash")).repartition(5), target)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert {t for _, t in got.dtypes} == {"bigint"}
    assert _sorted(got.collect()) == _sorted(brute(docs, bench))


def test_repeated_rows_take_all_ranks(spark, docs_of, prose):
    docs = [(3, prose(30, 1))] * 70 + [(None, prose(30, 2))] * 70
    got = resample(docs_of(*docs), spark.createDataFrame([], "item_id long, text string")).collect()
    assert len(got) == 140 and sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 8))
    assert _sorted(got) == _sorted(brute(docs, []))


def test_empty_tables(spark, docs_of, prose):
    none = spark.createDataFrame([], "item_id long, text string")
    assert resample(docs_of(), none).count() == 0
    assert [r["rank"] for r in resample(docs_of((1, "short")), none).collect()] == [None]


@pytest.mark.parametrize("cuts", [1, 2, 15])
def test_highest_counts_exactly(spark, cuts):
    rnd = random.Random(cuts)
    values = [rnd.randint(-50, 50) for _ in range(300)] + [10 ** 12, -(10 ** 12)]
    df = spark.createDataFrame([(v,) for v in values], "x long")
    order = sorted(values, reverse=True)
    for wanted in (1, 2, 17, 150, 302):
        v = order[wanted - 1]
        assert highest(df, F.col("x"), wanted, cuts) == (v, sum(x > v for x in values))


def test_cutoff_draws_as_many_as_wanted(spark):
    rnd = random.Random(6)
    rows = [(rnd.choice([None, 1, 2, 3]), rnd.randint(0, 2), i) for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, score long, row long")
    order = sorted(rows, key=lambda r: (-r[1], r[0] is None, r[0] or 0, r[2]))
    for wanted in (1, 13, 44, 90):
        got = df.where(cutoff(df, wanted).drawn()).collect()
        assert sorted(r.row for r in got) == sorted(r[2] for r in order[:wanted])
    assert cutoff(df, 0) is None
    placed = {r.row: r["rank"] for r in ranked(df).collect()}
    assert [placed[r[2]] for r in order] == list(range(1, 91))


def test_codes_of_runs_are_those_of_their_strings():
    rnd = random.Random(2)
    for _ in range(40):
        texts = ["".join(rnd.choices(["a", "Bc", " ", "  ", "-", "7", "é", "漢" * 30, "q" * 70], k=rnd.randint(0, 30)))
                 for _ in range(rnd.randint(1, 6))]
        codes, owner, words = run_codes([t.encode() for t in texts])
        for i, t in enumerate(texts):
            f, n = _features(t)
            assert words[i] == n
            assert sorted(codes[owner == i].tolist()) == sorted(zlib.crc32(x.encode()) for x in f)
    n = np.array([0, 1, 63, 64, 65, 1000, 100_003])
    crc = np.full(len(n), zlib.crc32(b"head"), dtype=np.uint32)
    tails = [bytes(k) for k in n.tolist()]
    joined = [zlib.crc32(b"head" + b) for b in tails]
    assert (shifted(crc, n) ^ np.array([zlib.crc32(b) for b in tails], dtype=np.uint32)).tolist() == joined
