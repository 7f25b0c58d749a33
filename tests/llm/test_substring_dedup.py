import hashlib
import random
import re

import numpy as np
import pytest

from equiaudit.llm.substring_dedup import _least, remove_repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window):
    words = [WORD.findall(t or "") for _, t in rows]
    places = {}
    for d, w in enumerate(words):
        for i in range(len(w) - window + 1):
            places.setdefault(tuple(w[i:i + window]), []).append((d, i))
    gone = {(d, i + k) for p in places.values() if len(p) > 1 for d, i in p for k in range(window)}
    out = []
    for d, w in enumerate(words):
        left = [x for i, x in enumerate(w) if (d, i) not in gone]
        out.append((rows[d][0], len(w), len(w) - len(left), hashlib.sha256(" ".join(left).encode()).hexdigest()))
    return sorted(out, key=str)


def run(df, **options):
    return sorted((tuple(r) for r in remove_repeats(df, **options).collect()), key=str)


@pytest.mark.parametrize("window, anchor", [(35, 12), (8, 3), (5, 5)])
def test_passages_against_brute_force(docs_of, prose, window, anchor):
    rnd = random.Random(window)
    passages = [prose(rnd.randint(window - 2, 3 * window), 100 + i) for i in range(6)]
    texts = []
    for i in range(60):
        parts = [prose(rnd.randint(0, 40), 1000 + i)]
        for _ in range(rnd.randint(0, 2)):
            p = rnd.choice(passages).split()
            a = rnd.randint(0, len(p) // 3)
            parts += [" ".join(p[a:]), prose(rnd.randint(0, 9), 2000 + i)]
        texts.append("\n".join(parts))
    texts += ["a " * 100, "a b " * 60, "b a " * 60, None, "", " \n", prose(window, 5), prose(window, 5), prose(window - 1, 6),
              prose(window - 1, 6), "Ab " * window, "aB " * window, texts[0], texts[0]]
    rows = list(enumerate(texts))
    assert run(docs_of(*rows), window=window, anchor=anchor) == brute(rows, window)


def test_whole_long_texts_null_and_repeated_ids(docs_of, prose):
    long = prose(30_000, 3)
    rows = [(1, long), (2, "start " + " ".join(long.split()[29_900:])), (None, prose(50, 7)), (None, prose(50, 8)),
            (4, prose(60, 9)), (4, prose(60, 9)), (4, prose(70, 10))]
    got = run(docs_of(*rows).withColumnRenamed("lang", "start"))
    assert got == brute(rows, 35)
    assert run(docs_of()) == []


def test_kept_text(docs_of, prose):
    p = prose(40, 1)
    got = {r["doc_id"]: r["kept_text"] for r in remove_repeats(
        docs_of((1, f"one\n{p} two"), (2, f"{p}"), (3, "x\ty")), keep_text=True).collect()}
    assert got == {1: "one two", 2: "", 3: "x y"}


@pytest.mark.parametrize("w", [1, 2, 3, 7, 24])
def test_least_of_runs(w):
    x = np.random.default_rng(w).integers(0, 1 << 60, 200, dtype=np.uint64)
    assert (_least(x, w) == np.lib.stride_tricks.sliding_window_view(x, w).min(axis=1)).all()
