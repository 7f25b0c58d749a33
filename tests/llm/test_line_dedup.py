import hashlib
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from equiaudit.llm.line_dedup import deduplicated, edit_distance, line_counts, probes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def brute(rows, most, per):
    seen, out = [], {}
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        left = []
        lines = t.split("\n") if t is not None else []
        for x in lines:
            if not WORD.search(x):
                left.append(x)
                continue
            if not any(x == y or abs(len(x) - len(y)) <= (e := min(most, min(len(x), len(y)) // per))
                       and distance(x, y) <= e for y in seen):
                left.append(x)
            seen.append(x)
        out[i] = (len(lines), len(lines) - len(left), hashlib.sha256("\n".join(left).encode()).hexdigest())
    return out


def edited(line, n, rnd):
    s = list(line)
    for _ in range(n):
        i = rnd.randrange(len(s))
        s[i:i + rnd.randint(0, 1)] = rnd.choice(("", "x", "é", "ß"))
    return "".join(s)


@pytest.mark.parametrize("most, per", [(0, 20), (1, 3), (1, 20), (2, 5), (2, 20), (3, 12), (5, 20)])
def test_against_brute_force(docs_of, prose, most, per):
    """Lines of all bands of length, and on their edges, with up to one edit more than is allowed."""
    rnd = random.Random(100 * most + per)
    kinds = [prose(rnd.randint(1, 16), i) for i in range(25)]
    kinds += [prose(40, 100 + e)[:per * e + k] for e in range(1, most + 2) for k in (-1, 0, 1, most)]
    rows = [(i, "\n".join(edited(rnd.choice(kinds), rnd.randint(0, most + 1), rnd) for _ in range(rnd.randint(0, 6))))
            for i in range(70)]
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, "Les.\nLes.\nles."), (104, " " * 30 + "\n" + " " * 30),
             (105, "  \t\n  \t"), (None, kinds[0])]
    got = {r["doc_id"]: tuple(r)[1:] for r in line_counts(docs_of(*rows), max_edits=most, chars_per_edit=per).collect()}
    assert got == brute(rows, most, per)


@pytest.mark.parametrize("hot_rows", [0, 3])
def test_split_segments_lose_no_pair(monkeypatch, docs_of, prose, hot_rows):
    """Lines with one common half: whether their segments are split or not, the same lines go."""
    from equiaudit.llm import line_dedup

    rnd = random.Random(hot_rows)
    common = prose(6, 1)
    rows = [(i, edited(common + " " + prose(5, 10 + i % 40), rnd.randint(0, 3), rnd)) for i in range(150)]
    pairs = line_dedup.meeting_pairs
    monkeypatch.setattr(line_dedup, "meeting_pairs", lambda *a: pairs(*a, hot_rows=hot_rows))
    got = {r["doc_id"]: tuple(r)[1:] for r in line_counts(docs_of(*rows)).collect()}
    assert got == brute(rows, 2, 20)


def test_probes_cover_every_place():
    """However the edits lie, some segment is unchanged at a probed place (all pairs of gaps tried)."""
    for edits in (1, 2, 3):
        places = {(less, k, shift) for e, less, k, shift in probes(edits) if e == edits}
        for moves in itertools.product((-1, 0, 1), repeat=edits):  # each edit deletes, replaces or inserts
            for where in itertools.combinations_with_replacement(range(edits + 1), edits):
                grown = sum(moves)
                if 0 <= grown:
                    assert any((grown, k, sum(m for m, w in zip(moves, where, strict=True) if w < k)) in places
                               for k in range(edits + 1) if k not in where)


def test_a_hot_line_and_a_long_one(docs_of, prose):
    hot, long = prose(12, 1), prose(8_000, 2)
    rows = [(i, f"{hot}\n{prose(10, 100 + i)}") for i in range(300)]
    rows += [(500, long), (501, long[:-1] + "Q"), (502, long + "!!"), (503, long + "!!!!!")]
    got = {r["doc_id"]: r["n_removed"] for r in line_counts(docs_of(*rows)).collect()}
    assert {i for i, n in got.items() if not n} == {0, 500, 503}


@pytest.mark.parametrize("edits", [1, 2, 4])
def test_banded_distance(spark, edits):
    rnd = random.Random(edits)
    pairs = []
    for _ in range(400):
        a = "".join(rnd.choice("abé") for _ in range(rnd.randint(edits + 1, 25)))
        b = edited(a, rnd.randint(0, 6), rnd)
        if abs(len(a) - len(b)) <= edits < len(b):
            pairs.append((a, b))
    got = spark.createDataFrame(pairs, "a string, b string")
    got = got.withColumns({"distance": edit_distance(F.col("a"), F.col("b"), edits), "true": F.levenshtein("a", "b")})
    for r in got.collect():
        assert r["distance"] == r["true"] if r["true"] <= edits else r["distance"] > edits, r


def test_equal_short_lines(docs_of, prose):
    p = prose(9, 1)
    df = docs_of((1, f"Les.\n{p}\n \n\nÀ"), (2, "Les.\n \n\nles.\nÀ\nÀ b"), (3, f"{p}x\nLes.\nles.\nLes,"), (4, "Les."))
    got = {r["doc_id"]: r["text"] for r in deduplicated(df).collect()}
    assert got == {1: f"Les.\n{p}\n \n\nÀ", 2: " \n\nles.\nÀ b", 3: "Les,", 4: ""}


def test_other_columns_pass_and_repeated_rows_agree(docs_of, prose):
    p, q = prose(9, 1), prose(9, 2)
    df = docs_of((1, p), (1, p), (2, f"{p}\n{q}"), (None, f"{q}\n{p}")).withColumnsRenamed({"lang": "no", "source": "of"})
    got = sorted((str(r["doc_id"]), r["text"], r["no"], r["of"]) for r in deduplicated(df).collect())
    assert got == [("1", "", "en", "s"), ("1", "", "en", "s"), ("2", "", "en", "s"), ("None", f"{q}\n{p}", "en", "s")]
    assert line_counts(docs_of()).collect() == []


def test_native(docs_of, prose):
    plan = deduplicated(docs_of((1, prose(9, 1)), (2, prose(9, 1))))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_few_and_many_removed_lines_alike(spark, docs_of, prose):
    """A document that loses 10, 64, 65 or 5,000 lines keeps the others in order, a first empty line too."""
    from equiaudit.llm.line_dedup import deduplicated

    lines = [prose(8, i) for i in range(5_000)]
    docs = [(0, "\n".join(lines))] + [(k, "\n" + "\n".join(
        x for i, line in enumerate(lines[:n]) for x in ([line, f"own {k} {i} " + prose(9, 10_000 * k + i)] if i < 70 else [line])))
        for k, n in ((1, 10), (2, 64), (3, 65), (4, 5_000))]
    got = {r["doc_id"]: r["text"] for r in deduplicated(docs_of(*docs)).collect()}
    assert got[0] == docs[0][1]
    for k, n in ((1, 10), (2, 64), (3, 65), (4, 5_000)):
        assert got[k].split("\n") == [""] + [f"own {k} {i} " + prose(9, 10_000 * k + i) for i in range(min(n, 70))]


def test_signatures_part_lines_of_one_family(spark, docs_of):
    """Lines that share all segments but one and differ there by more than the edits do not meet, however many; numbers
    beyond the signature's largest one lose no similar pair."""
    from equiaudit.llm import line_dedup as L

    common = "the same words again and again " * 4
    rows = [(i, common + "".join(c * (3 * ((i >> k) & 1)) for k, c in enumerate(" hld")) + "zyxwv")
            for i in range(16)]
    rows += [(50 + i, "e" * (31 + i) + "q" * 30) for i in range(3)]
    lines = L.lines_of(docs_of(*rows), "doc_id", "text").withColumns(
        {"h1": F.xxhash64("line"), "code": F.encode("line", "UTF-32"), "n": F.char_length("line")})
    first = lines.select("h1", "n", L.signature(F.col("line")).alias("signature"),
                         L.index_keys(F.col("code"), F.col("n"), 2, 20).alias("index_keys"),
                         L.probe_keys(F.col("code"), F.col("n"), 2, 20).alias("probe_keys"))
    for hot_rows in (0, 1_000):
        assert L.meeting_pairs(first, 2, 20, hot_rows).count() == 3
    got = {r["doc_id"]: r["n_removed"] for r in line_counts(docs_of(*rows)).collect()}
    assert {i for i, n in got.items() if n} == {51, 52}
