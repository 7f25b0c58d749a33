import random
import re
import string

import pytest

from equiaudit.llm import near_dedup as nd
from equiaudit.llm.components import components
from equiaudit.llm.shingles import shingle_sets, word_hashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    name = list(range(len(rows)))

    def find(i):
        while name[i] != i:
            i = name[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and (c := len(a & b)) * 100 >= 75 * (len(a) + len(b) - c):
                name[find(i)] = find(j)
    least = {}
    for i in range(len(rows)):
        least[find(i)] = min(least.get(find(i), rows[i][0]), rows[i][0])
    return sorted((rows[i][0], len(sets[i]), least[find(i)], least[find(i)] == rows[i][0]) for i in range(len(rows)))


def mutated(text, share, rnd):
    return " ".join(f"{w}{rnd.randint(0, 9**6)}" if rnd.random() < share else w for w in text.split())


def test_groups_of_all_sizes_against_brute_force(docs_of, prose):
    rnd = random.Random(5)
    texts = [prose(rnd.randint(1, 60), i) for i in range(60)]
    for i in range(12):
        texts += [mutated(texts[i], rnd.choice((0, 0.01, 0.03, 0.06)), rnd) for _ in range(rnd.randint(1, 6))]
    base = prose(80, 999)  # a large group of near copies, from hardly changed to beyond the limit
    texts += [mutated(base, rnd.random() * 0.12, rnd) for _ in range(150)]
    texts += [None, "", " \n", "A b", "a B", "a b c", "é É", "a  b"] + [texts[3]] * 40
    rows = list(enumerate(texts))
    rnd.shuffle(rows)
    got = sorted(tuple(r) for r in nd.near_duplicates(docs_of(*rows)).collect())
    assert got == brute(rows)


def test_exact_comparison_finds_links_that_stars_miss(spark, docs_of, prose):
    """Without confirmed stars every group is one document; the blockwise comparison finds the same links."""
    rnd = random.Random(8)
    base = prose(60, 4)
    rows = [(i, mutated(base, rnd.random() * 0.1, rnd)) for i in range(60)]
    reps = nd.sketches(docs_of(*rows), "doc_id", "text").withColumnRenamed("doc_id", "rep").persist()
    buckets = nd.bucket_rows(reps)
    sets = nd.full_sets(docs_of(*rows), reps.select("rep", "s1", "s2"), "doc_id", "text")
    alone = reps.selectExpr("rep", "rep as component")
    links = nd.links_between(alone, buckets, sets, block=2000)
    joined = {r["node"]: r["component"] for r in components(links).collect()}
    assert {i: joined.get(i, i) for i, _ in rows} == {r[0]: r[2] for r in brute(rows)}


def test_null_and_repeated_ids_and_extra_columns(docs_of):
    df = docs_of((None, "a b"), (None, "only here"), (2, "A B"), (3, "x y z"), (3, "x y z")).withColumnRenamed("lang", "kept")
    got = sorted(map(str, (tuple(r) for r in nd.near_duplicates(df).collect())))
    assert got == sorted(map(str, [(None, 1, 2, False), (None, 1, None, True), (2, 1, 2, True), (3, 1, 3, True),
                                   (3, 1, 3, True)]))
    assert nd.near_duplicates(docs_of()).collect() == []


def test_tensored_keys_cost_the_square_root(spark):
    """m * m keys of 2k minhashes come from 2mk minhashes."""
    assert len(nd._families(nd.TABLES, nd.HASHES)) == 2 * nd.TABLES * nd.HASHES == 48
    reps = spark.createDataFrame([(i, [7] * 24) for i in (1, 2)], "rep long, halves array<long>")
    assert nd.bucket_rows(reps).count() == 2 * 144


def test_word_hashes_do_not_depend_on_blocks(monkeypatch, prose):
    from equiaudit.llm import shingles as sh

    texts = [prose(300, 1), None, "", "é" * 500, " \t".join("abc"), prose(50, 2)]
    whole = word_hashes(texts, True)
    monkeypatch.setattr(sh, "BLOCK", 64)
    parts = word_hashes(texts, True)
    assert (whole[0] == parts[0]).all() and whole[1].tolist() == [300, 0, 0, 1, 3, 50]
    assert [len(s) for s in shingle_sets(texts, 5)] == [len(shingles(t)) for t in texts]


@pytest.mark.parametrize("n", [2, 9, 60])
def test_components_of_a_path(spark, n):
    ids = random.Random(n).sample(range(1000), n)
    df = spark.createDataFrame(list(zip(ids, ids[1:], strict=False)) + [(5000, 5000)], "a long, b long")
    assert {r["component"] for r in components(df).collect()} == {min(ids)}


def test_ids_of_another_type(spark, prose):
    p = prose(40, 1)
    df = spark.createDataFrame([("b", p), ("a", p + " x"), ("c", prose(40, 2))], "name string, body string")
    got = {r["doc_id"]: r["component_id"] for r in nd.near_duplicates(df, "name", "body").collect()}
    assert got == {"a": "a", "b": "a", "c": "c"}
