import zlib

import numpy as np
import pytest

from equiaudit.llm.packing import Encoder, Plan, pack, pieces_of, public_paths


def test_fast_ids_equal_the_tokenizers(prose):
    fast, full = Encoder(*public_paths()), Encoder(public_paths()[0])
    texts = ["", " ", "\n\n \t x", "don't I'LL", "日本語 é́ 🙂", "a" * 3000, " " * 500, "1234567 ½ ²", "<|endoftext|> x<|endoftext|>",
             "\x00\x7f ﻿", prose(200, 1)]
    for t in texts:
        assert fast(t).tolist() == full(t).tolist() == full.full.encode(t, add_special_tokens=False).ids, t


def pieces(df, **options):
    return [r.asDict() for r in pack(df, **options).collect()]


def check(rows, got, sequence):
    encoder = Encoder(public_paths()[0])
    docs = {i: np.append(encoder(t or ""), np.uint32(1)) for i, t, *_ in rows}
    by_doc, by_sequence = {}, {}
    for p in got:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_sequence.setdefault(p["sequence_id"], []).append(p)
    assert by_doc.keys() == docs.keys()
    for i, ps in by_doc.items():
        at = 0
        for p in sorted(ps, key=lambda p: p["start"]):
            assert p["start"] == at and p["length"] > 0 and p["doc_tokens"] == len(docs[i])
            at += p["length"]
            assert p["ids_crc32"] == zlib.crc32(docs[i][p["start"]:at].astype("<u4").tobytes())
        assert at == len(docs[i])
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for k, ps in by_sequence.items():
        at = 0
        for p in sorted(ps, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at == sequence or k == len(by_sequence) - 1


@pytest.mark.parametrize("window", [64, 1024])
def test_pieces_and_proportions(docs_of, prose, window):
    rows = [(i, prose(i * 13 % 90, i), "en", ["a", "b", None, "hot", "hot", "hot"][i % 6]) for i in range(240)]
    rows += [(900, None), (901, ""), (902, prose(9000, 5))]
    got = pieces(docs_of(*rows).repartition(5), sequence=64, window=window)
    check(rows, got, 64)
    totals, n = {}, sum(p["length"] for p in got)
    for p in got:
        totals[p["source"]] = totals.get(p["source"], 0) + p["length"]
    # every run of whole windows holds each source's share, up to what a deficit carries
    for k in (1, 2, n // window // 2):
        seen = {}
        for p in got:
            at = p["sequence_id"] * 64 + p["offset"]
            seen[p["source"]] = seen.get(p["source"], 0) + max(0, min(p["length"], k * window - at))
        for s, t in totals.items():
            assert abs(seen.get(s, 0) - k * window * t / n) <= len(totals) + 1


def test_given_proportions_end_early(docs_of, prose):
    rows = [(i, prose(60, i), "en", "ab"[i % 2]) for i in range(80)]
    got = pieces(docs_of(*rows), sequence=64, window=512, proportions={"a": 3, "b": 1})
    check(rows, got, 64)
    first = [p for p in got if p["sequence_id"] < 24]
    a = sum(p["length"] for p in first if p["source"] == "a")
    assert abs(a / sum(p["length"] for p in first) - 0.75) < 0.01


@pytest.mark.parametrize("proportions", [None, {"a": 3, "b": 1, None: 0.01, "hot": 2.5}])
def test_the_same_pieces_by_tables(docs_of, prose, proportions):
    rows = [(i, prose(i * 13 % 90, i), "en", ["a", "b", None, "hot", "hot", "hot"][i % 6]) for i in range(120)]
    rows += [(900, None, "en", "b"), (901, "", "en", None), (902, prose(3000, 5), "en", "hot")]
    df = docs_of(*rows).repartition(5, "doc_id")
    got = [sorted(map(str, pieces(df, sequence=64, window=96, proportions=proportions, local_sources=n))) for n in (100, 0)]
    assert got[0] == got[1] and len(got[0]) > len(rows)


def test_more_sources_than_the_driver_holds(docs_of, prose):
    rows = [(i, prose(2, i), "en", f"site{i}") for i in range(10_050)]
    got = pieces(docs_of(*rows))
    assert {p["source"] for p in got} == {s for *_, s in rows}
    check(rows, got, 2048)


def test_edges(docs_of):
    assert pieces(docs_of()) == []
    assert sorted(p["ids_crc32"] for p in pieces(docs_of((None, None), (1, ""), (1, "")))) == [zlib.crc32(b"\1\0\0\0")] * 3
    with pytest.raises(ValueError, match="sources"):
        pack(docs_of((1, "x", "en", "a"), (2, "x", "en", "b")), max_sources=1)


def test_plan_places_every_token_once():
    rng = np.random.default_rng(1)
    sizes = [int(x) for x in rng.integers(1, 4000, 7)]
    plan = Plan(sizes, [float(x) for x in rng.random(7) + 0.1], 100)
    found = []
    for s, size in enumerate(sizes):
        cuts = np.unique(np.concatenate([[0], rng.integers(0, size, 20), [size]]))
        start, n = cuts[:-1], np.diff(cuts)
        p = pieces_of(start, n, np.full(len(n), s), plan, 32)
        found += [q * 32 + o + i for q, o, k in zip(p["sequence_id"], p["offset"], p["length"], strict=True) for i in range(k)]
    assert sorted(found) == list(range(sum(sizes)))
