import math

import pytest

from equiaudit.llm.mixture import mixed_documents, mixture, source_targets


def water(sizes, most=3):
    """Shares by weight 1, 2, 3, ...; what is over ``most`` times a size goes to the others."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(most * sizes[s] for s in full)
        free = sum(weight[s] for s in order if s not in full)
        target = {s: most * sizes[s] if s in full else rest * weight[s] / free for s in order}
        over = {s for s in order if target[s] > most * sizes[s]}
        if not over:
            return target
        full |= over


@pytest.mark.parametrize("sizes", [
    {"a": 100, "b": 100, "c": 100}, {"a": 1000, "b": 1, "c": 2}, {"b": 5, None: 7, "ä": 50, "z": 1, "A": 900}, {"x": 0, "y": 9}])
def test_targets(spark, sizes):
    df = spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, size long")
    got = {r["source"]: r["target"] for r in source_targets(df).collect()}
    assert got == pytest.approx(water(sizes))


def test_budget_is_met_exactly_and_reruns_agree(docs_of, prose):
    rows = [(i, prose(1 + i * 7 % 40, i), "en", f"s{i % 5}" if i % 3 else "hot") for i in range(400)]
    df = docs_of(*rows)
    a = sorted(tuple(r) for r in mixture(df, rows_per_range=20).collect())
    assert a == sorted(tuple(r) for r in mixture(df.repartition(7), rows_per_range=20).collect())
    source = {i: s for i, _, _, s in rows}
    for s in set(source.values()):
        own = [r for r in a if source[r[0]] == s]
        assert sum(r[4] for r in own) == round(own[0][3])
        assert all(0 <= r[4] <= 3 * r[1] for r in own)
        epochs = {r[4] // r[1] for r in own}
        assert max(epochs) - min(epochs) <= 1
        assert sum(1 for r in own if r[4] % r[1]) <= 1  # the document at the cut


def test_null_and_empty(docs_of):
    got = {r["doc_id"]: r for r in mixture(docs_of(
        (1, None, "en", None), (2, "", "en", "a"), (3, "one two", "en", None), (None, " \t", "en", "a"))).collect()}
    assert got[1]["size"] == 0 and got[2]["target"] == 0.0 and got[3]["source_size"] == 2 and got[3]["taken"] == 2
    assert mixture(docs_of()).collect() == []


def test_documents_of_the_mix(docs_of, prose):
    rows = [(i, prose(30, i).replace(" ", "\n", 3), "en", "small" if i < 4 else "wide") for i in range(40)]
    df = docs_of(*rows).withColumnRenamed("n_chars", "taken")
    taken = {r["doc_id"]: r["taken"] for r in mixture(df).collect()}
    text, words = {r[0]: r[1] for r in rows}, {}
    for r in mixed_documents(df).collect():
        assert text[r["doc_id"]].startswith(r["text"]) and r.asDict().keys() == dict.fromkeys(df.columns).keys()
        words[r["doc_id"]] = words.get(r["doc_id"], 0) + len(r["text"].split())
    assert words == {i: n for i, n in taken.items() if n}
    assert not math.isclose(sum(words.values()), 0)
