"""Language ID, toxicity: held-out accuracy, defined cases, exact inference."""

import itertools
import random
import zlib

import numpy as np
import pytest

from equiaudit.llm.langid import LanguageModel, Scorer, identify, language_id, train
from equiaudit.llm.toxicity import SpanModel, fit_field, marginals, toxic_spans, toxicity

LETTERS = {"xx": "abcde", "yy": "fghij", "zz": "klmaé"}


def corpus(docs_of, n=240):
    rnd = random.Random(2)
    rows = []
    for i in range(n):
        lang = rnd.choice(list(LETTERS))
        words = ["".join(rnd.choice(LETTERS[lang]) for _ in range(rnd.randint(1, 6))) for _ in range(rnd.randint(5, 40))]
        rows.append((i, " ".join(words), lang if i % 17 else None))
    return rows, docs_of(*rows, (1000, None, None), (1001, "", None), (1002, "12 ½ ² !?", None),
                         (1003, "日本", None), (None, "abc abd", None), (1004, "abcde " * 50_000, None))


def test_held_out_accuracy_and_cases(docs_of):
    rows, df = corpus(docs_of)
    got = {r["doc_id"]: r for r in language_id(df.withColumnRenamed("source", "score")).collect()}
    true = {i: x for i, _, x in rows if x}
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in true)
    held = [i for i in true if got[i]["held_out"]]
    assert sum(got[i]["lang_pred"] == true[i] for i in held) >= 0.97 * len(held)
    assert [got[i]["lang_pred"] for i in (1000, 1001, 1002)] == ["und"] * 3 and got[1000]["score"] == 0
    assert got[1003]["lang_pred"] in LETTERS and abs(got[1003]["score"] - 1 / 3) < 1e-9
    assert got[None]["lang_pred"] == "xx" and got[1004]["lang_pred"] == "xx" and len(got) == len(rows) + 6
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_words_come_before_grams():
    model = LanguageModel(["p", "q"], {"ab": 0}, np.array([[-9.0, -1.0]]), {"a": 0, " a": 1, "abc": 2},
                          np.array([[-1.0, -9.0], [-2.0, -9.0], [-3.0, -4.0]]), 3)
    score = Scorer(model)
    assert score("ab")[0] == "q"  # its n-grams say p
    assert model.unseen("abc").tolist() == [-3.0, -4.0] and model.unseen("a").tolist() == [-2.0, -9.0]
    assert score("!") == ("und", 0.0) and score("zzz")[1] == pytest.approx(0.5)


def test_nothing_to_learn(docs_of):
    df = docs_of((1, "abc", None), (2, None, None))
    assert {(r["lang_pred"], r["score"]) for r in language_id(df).collect()} == {("und", 0.0)}
    assert language_id(docs_of()).collect() == []
    assert identify(docs_of(), train(docs_of())).columns[-2:] == ["lang_pred", "score"]


def test_a_small_language_beside_a_large_one(docs_of, monkeypatch):
    rnd = random.Random(5)

    def texts(letters, n):
        return [" ".join("".join(rnd.choices(letters, k=4)) for _ in range(12)) for _ in range(n)]

    small = texts("fghij", 8)
    rows = [(i, t, "xx") for i, t in enumerate(texts("abcde", 3000))] + [(5000 + i, t, "yy") for i, t in enumerate(small)]
    got = {r["doc_id"]: r["lang_pred"] for r in language_id(docs_of(*rows), sample_rows=40).collect()}
    assert {got[5000 + i] for i in range(8)} == {"yy"} and got[0] == "xx"
    model = train(docs_of(*rows), max_words=50, max_grams=400)
    often = {w for w in " ".join(small).split() if " ".join(small).split().count(w) > 1}
    assert often and often <= set(model.words) and len(model.words) <= 100
    assert sum(set(g) <= set("fghij ") for g in model.grams if len(g) == 4) > 30  # pooled: 0
    monkeypatch.setattr("equiaudit.llm.langid.MAX_CELLS", 4)
    assert 25 <= len(train(docs_of(*rows), max_words=50).words) <= 50


@pytest.mark.parametrize("starts", [[0], [0, 1], [0, 3, 7]])
def test_marginals_by_enumeration(starts):
    rng = np.random.default_rng(len(starts))
    u, first, move = rng.normal(size=9) * 2, rng.normal(size=2), rng.normal(size=(2, 2))
    total, weighted = 0.0, np.zeros(9)
    for y in itertools.product((0, 1), repeat=9):
        s = sum((first[y[t]] if t in starts else move[y[t - 1], y[t]]) + u[t] * y[t] for t in range(9))
        total += np.exp(s)
        weighted += np.exp(s) * np.array(y)
    assert marginals(u, np.array(starts), first, move) == pytest.approx(weighted / total)


def test_long_chains_are_stable():
    p = marginals(np.tile([-40.0, 40.0, 0.0], 60_000), np.array([0]), np.zeros(2), np.array([[5.0, -5.0], [-5.0, 5.0]]))
    assert np.isfinite(p).all() and ((p >= 0) & (p <= 1)).all()


def test_fit_learns_runs():
    y = np.array(([0] * 8 + [1] * 4) * 30, dtype=np.int8)
    f = np.where(y == 1, 1, 0).astype(np.int32)
    f[::5] = 2  # tokens without a hint take their neighbours' label
    w, bias, first, move = fit_field(f, np.ones(len(y), np.int16), np.full(30, 12), y, 3)
    p = marginals(bias + w[f], np.arange(0, len(y), 12), first, move)
    assert (p[f != 2].round() == y[f != 2]).all() and move[1, 1] > move[1, 0]


def test_toxicity_held_out(spark, docs_of):
    rnd = random.Random(4)
    plain = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 7))) for _ in range(300)]
    rows, labels = [], []
    for i in range(400):
        words = rnd.choices(plain, k=rnd.randint(10, 60))
        bad = i % 5 == 0
        if bad:
            for _ in range(rnd.randint(1, 3)):
                words.insert(rnd.randrange(len(words)), rnd.choice(("Wretch", "stink" + rnd.choice(("er", "ing", "o", "ish")))))
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    labels += [(1000, None), (1001, 1), (7777, 1)]
    rows += [(1000, None), (1001, ""), (1002, "stinkable you"), (None, "wretch")]
    told = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity(docs_of(*rows), told).collect()}
    held = [i for i in range(400) if got[i]["held_out"]]
    assert held == [i for i in range(400) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert sum(got[i]["predicted"] == (i % 5 == 0) for i in held) >= 0.97 * len(held)
    assert got[1000]["score"] == got[1001]["score"] == 0 and got[1000]["spans"] == []
    assert got[1002]["score"] > 0.5 and [tuple(s) for s in got[1002]["spans"]][0][0] == 0, got[1002]
    for i, t in rows[:400:5]:
        words = {t[s["start"]:s["end"]].lower()[:5] for s in got[i]["spans"]}
        assert not words or any(w in ("wretc", "stink") for w in words)


def test_without_labels(spark, docs_of):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["score"] for r in toxicity(docs_of((1, "a b"), (2, None)), none).collect()} == {0.0}
    model = SpanModel(constant=0.25)
    assert [r["score"] for r in toxic_spans(docs_of((1, "a"), (2, " ")), model).orderBy("doc_id").collect()] == [0.25, 0.0]
