"""Operator 13 against the public library, and its parts against plain definitions."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from equiaudit.llm import byte_bpe
from equiaudit.llm.byte_bpe import Codec, Transducer, Utf8, codec, encode_decode, public_paths, rank_file

TEXTS = [None, "", " ", "\n\n  \t x", "It's  the 'quick' brown fox's 1234 jumps!!  ", "naïve  日本語 текст 🙂🙂 á",
         " lead", "a  b   c\n d \n\n", "x" * 500, "　wide　 space ", "tab\t and\x1cseparators\x85 "]


@pytest.fixture(scope="module")
def public():
    import tiktoken

    path, pattern = public_paths()
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=rank_file(path), special_tokens={})


def _expected(public, text):
    ids = public.encode_ordinary(text or "")
    return (len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(),
            hashlib.sha256((text or "").encode()).hexdigest())


def test_query_agrees_with_the_library(spark, docs_of, prose, public):
    long = prose(30_000, 3) + "  \n" + "z" * 20_000
    texts = [*TEXTS, long, prose(50, 1), prose(50, 1)]
    docs = docs_of(*[(i if i else None, t) for i, t in enumerate(texts)]).withColumn("n_tokens", F.lit("clash"))
    out = encode_decode(docs)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    got = sorted((tuple(r)[1:] for r in out.collect()))
    assert got == sorted(_expected(public, t) for t in texts)
    assert encode_decode(docs.limit(0)).count() == 0


def test_round_trip_and_invalid_bytes(spark):
    df = spark.createDataFrame([(1, "héllo wörld")], "doc_id long, text string")
    row = encode_decode(df, keep=True).first()
    assert row.decoded == "héllo wörld" and len(row.ids) == 4 * row.n_tokens
    bad = df.select("doc_id", F.expr("cast(x'61FF62' as string)").alias("text"))
    assert encode_decode(bad, keep=True).first().decoded == "a�b"


def test_any_bytes_and_small_tables(public):
    """Random pieces, with tables so small that most work is done without the automaton."""
    ranks, rnd = rank_file(public_paths()[0]), random.Random(5)
    tokens = list(ranks)
    for states in (20, 5_000):
        t = Transducer(ranks, max_states=states, max_pairs=50)
        for k in range(400):
            raw = (bytes(rnd.choices(b"aeinst hr", k=rnd.randint(1, 60))) if k % 3 == 0 else
                   b"".join(rnd.choices(tokens, k=rnd.randint(1, 9))) if k % 3 == 1 else rnd.randbytes(rnd.randint(1, 30)))
            assert t.encode(raw) == public._encode_single_piece(raw)
        assert len(t.readings) <= states and len(t.pairs) <= 50


def test_pairs_are_those_that_the_merges_leave():
    t, rnd = Transducer(rank_file(public_paths()[0])), random.Random(7)
    tokens = list(t.tokens)
    for _ in range(3_000):
        a, b = rnd.choice(tokens), rnd.choice(tokens)
        assert t.follows(a, b) == (t.merged(t.tokens[a] + t.tokens[b]) == [a, b])


def test_lookahead_is_bounded():
    """No token waits for more bytes than the longest token has."""
    t, raw = Transducer(rank_file(public_paths()[0])), b"internationalisation" * 40
    longest, given, sent = max(map(len, t.ranks)), 0, 0

    def feed():
        nonlocal given
        for given, byte in enumerate(raw, 1):
            yield byte

    class Bytes:
        def __iter__(self):
            return feed()

    for part in t.stream(Bytes()):
        sent += sum(len(t.tokens[i]) for i in part)
        assert given - sent <= 2 * longest
    assert sent == len(raw)


def test_texts_in_words_equal_texts_as_a_whole(public):
    path, pattern = public_paths()
    rnd, own = random.Random(3), Codec(rank_file(path), pattern, max_chunks=30)
    assert own.at_spaces
    for _ in range(600):
        text = "".join(rnd.choices([" ", " ", "\n", "\t", "a", "word", "'s", "7", "!", "é", "　"], k=rnd.randint(0, 25)))
        assert list(own.encode(text)) == public.encode_ordinary(text) and "".join(own.decode(own.encode(text))) == text
    other = Codec(rank_file(path), r"\S+|\s+")
    assert not other.at_spaces and "".join(other.decode(other.encode("a b  c"))) == "a b  c"


def test_incremental_utf8():
    text = "aß漢🙂\u0000z"
    for cut in range(1, 5):
        m, raw = Utf8(), text.encode()
        assert "".join(m.feed(raw[i:i + cut]) for i in range(0, len(raw), cut)) + m.end() == text
    rnd = random.Random(2)
    for _ in range(3_000):
        raw = bytes(rnd.choices([0x41, 0x80, 0xBF, 0xC2, 0xE0, 0xA0, 0xED, 0x9F, 0xF0, 0x90, 0xF4, 0x8F, 0xFF, 0xC0], k=8))
        m = Utf8()
        assert "".join(m.feed(raw[i:i + 1]) for i in range(8)) + m.end() == raw.decode("utf-8", "replace")


def test_decoder_takes_ids_that_end_inside_a_character():
    own = codec(*public_paths())
    ids = own.encode("🙂")
    assert len(ids) > 1 and "".join(own.decode(ids[:1])) == "�"
    with pytest.raises(KeyError):
        list(own.decode([10 ** 6]))


def test_codec_is_shared_by_a_worker():
    assert byte_bpe.codec(*public_paths()) is byte_bpe.codec(*public_paths())
