"""Byte-level BPE encoding and decoding (operator 13).

The merges of a rank file are compiled into a finite-state transducer that
reads a piece byte by byte and writes token ids.

* A sequence of tokens is what the merges make of a piece exactly if every two
  neighbours, merged by themselves, stay as they are.  So the nondeterministic
  transducer only has to know the last token it wrote and the bytes of the
  token it is reading: at the end of a token it may write it if the pair with
  the last one holds.
* It is determinised lazily.  A state is the set of readings that are still
  possible, each with the tokens that it would write and the others would not;
  a transition is worked out when a text first takes it and kept in the
  automaton.  Tokens on which all readings agree are written at once: no
  reading lags more than one token's bytes behind, so the lookahead is bounded
  by the longest token.
* Every prefix has one reading that ends with it, which gives the last tokens
  at the end of a piece.

Decoding feeds token after token to an incremental UTF-8 state machine: its
state is what is missing of the character that the bytes so far began, so ids
may be cut anywhere, inside a character too.

Automaton, pairs of tokens and the ids of words are kept within bounds per
Python worker; where the automaton is full, the readings are carried on without
it, which changes no result.  Texts go through in slices of bounded bytes and
no rows are shuffled.

Defined cases: a null text is the empty text: no ids, and the digests of the
empty string.  Bytes that are not UTF-8 count as U+FFFD.  Null ids pass
through, repeated rows are encoded each by itself, other columns are ignored,
an empty table gives no rows.  Ids outside the vocabulary are an error.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equiaudit.llm.common import byte_slices

#: States of the automaton, pairs of tokens and words that a worker remembers.  When a table is full, the rest is worked
#: out each time; after LATE times its size of such work it is built anew, for the texts may have changed.
MAX_STATES, MAX_PAIRS, MAX_CHUNKS, LATE = 100_000, 200_000, 300_000, 50
#: Longer words are not remembered.
CHUNK_CHARS = 48
#: The end of the public pattern: white space before a word goes by itself but for one space.
SPACE_RULES = r"| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Ids that are decoded at a time.
RUN = 4096


_BYTES = [bytes((i,)) for i in range(256)]


class Transducer:
    """Ids of pieces by the merge ranks in ``ranks`` (bytes -> id; every single byte has one)."""

    def __init__(self, ranks: dict[bytes, int], max_states: int = MAX_STATES, max_pairs: int = MAX_PAIRS):
        self.ranks, self.max_states, self.max_pairs = ranks, max_states, max_pairs
        self.tokens = {i: b for b, i in ranks.items()}
        self.open = {raw[:k] for raw in ranks for k in range(1, len(raw))}
        self.never = max(self.tokens, default=0) + 1
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.edges: tuple[dict, dict] = ({}, {})
        self.pairs: dict[int, bool] = {}
        self._begin()

    def _begin(self) -> None:
        self.late = 0
        #: By state: its readings, (bytes of the unfinished token, last token, tokens not written yet), the longest
        #: first, and the tokens to write if the piece ends there.
        self.readings: list[tuple] = []
        self.last: list[tuple[int, ...]] = []
        self.states: dict[tuple, int] = {}
        #: By state and byte: 256 times the next state, negative where tokens are written; 0 is not worked out yet.
        self.next = array("i", bytes(4 * 256 * self.max_states))
        self.written: dict[int, tuple[int, ...]] = {}
        self._state(())  # 0 is no state
        self.start = self._state(((b"", -1, ()),)) << 8

    def _state(self, readings: tuple) -> int:
        got = self.states.get(readings)
        if got is None:
            got = self.states[readings] = len(self.readings)
            self.readings.append(readings)
            self.last.append(readings[-1][2] if readings and not readings[-1][0] else ())
        return got

    def merged(self, raw: bytes, but: int = -1) -> list[int]:
        """What the merges (without that of the token ``but``) make of a short string: always the pair of the least
        rank, the first of equals."""
        parts = [raw[i:i + 1] for i in range(len(raw))]
        while len(parts) > 1:
            found = [(self.ranks[p + q], i) for i, (p, q) in enumerate(zip(parts, parts[1:], strict=False))
                     if self.ranks.get(p + q, but) != but]
            if not found:
                break
            i = min(found)[1]
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return [self.ranks[p] for p in parts]

    def _split(self, token: int) -> tuple[int, int] | None:
        """The two tokens that the merges put together last to make ``token``; None for a byte."""
        if token not in self.halves:
            raw = self.tokens[token]
            parts = self.merged(raw, token) if len(raw) > 1 else []
            self.halves[token] = tuple(parts) if len(parts) == 2 else None
        return self.halves[token]

    def _edge(self, token: int, side: int) -> tuple[tuple[bytes, float], ...]:
        """The tokens that stand at one end of ``token`` while it is made, from its byte to itself, each with the rank
        of the merge that it goes into."""
        got = self.edges[side].get(token)
        if got is None:
            halves = self._split(token)
            below = self._edge(halves[side], side) if halves else ()
            got = (*((raw, token if raw is below[-1][0] else rank) for raw, rank in below),
                   (self.tokens[token], self.never))
            self.edges[side][token] = got
        return got

    def follows(self, last: int, token: int) -> bool:
        """Whether ``token`` may stand after ``last`` (-1: at the beginning): while both are made, no merge across
        their border comes before the next merge on either side.  Of equal ranks the left one comes first."""
        if last < 0:
            return True
        key = last << 32 | token
        held = self.pairs.get(key)
        if held is None:
            left, right, i, j = self._edge(last, 1), self._edge(token, 0), 0, 0
            while True:
                (a, up), (b, down) = left[i], right[j]
                across = self.ranks.get(a + b, self.never)
                if across < up and across <= down and across != self.never:
                    held = False
                    break
                if up == down == self.never:
                    held = True
                    break
                i, j = (i + 1, j) if up <= down else (i, j + 1)
            if len(self.pairs) < self.max_pairs:
                self.pairs[key] = held
        return held

    def _step(self, at: int, byte: int) -> int:
        readings, done = [], None
        for part, last, waiting in self.readings[at >> 8]:
            part += _BYTES[byte]
            if part in self.open:
                readings.append((part, last, waiting))
            if done is None:
                token = self.ranks.get(part)
                if token is not None and self.follows(last, token):
                    done = (b"", token, (*waiting, token))
        if done is None:
            raise ValueError("the ranks do not hold every byte")
        readings.append(done)
        first = readings[0][2]
        same = len(first)
        for _, _, waiting in readings[1:]:
            same = min(same, len(waiting))
            while waiting[:same] != first[:same]:
                same -= 1
        if same:
            readings = [(part, last, waiting[same:]) for part, last, waiting in readings]
            self.written[at | byte] = first[:same]
        step = self._state(tuple(readings)) << 8
        self.next[at | byte] = step = -step if same else step
        return step

    def _simulate(self, readings: Iterable[tuple], raw: bytes) -> list[int]:
        """The rest of a piece by the nondeterministic transducer: every reading is carried on, none is kept."""
        open_, ranks, follows = self.open, self.ranks.get, self.follows
        now = []
        for part, last, waiting in readings:
            chain = None  # (tokens before, token): readings share what they have in common
            for token in waiting:
                chain = (chain, token)
            now.append((part, last, chain))
        for byte in raw:
            one, on, done = _BYTES[byte], [], None
            for part, last, chain in now:
                part += one
                if part in open_:
                    on.append((part, last, chain))
                if done is None:
                    token = ranks(part)
                    if token is not None and follows(last, token):
                        done = (b"", token, (chain, token))
            on.append(done)
            now = on
        self.late += len(raw)
        out, chain = [], now[-1][2]
        while chain:
            chain, token = chain
            out.append(token)
        return out[::-1]

    def stream(self, raw: bytes) -> Iterator[tuple[int, ...]]:
        """Ids of one piece, each as soon as it is certain."""
        if self.late > LATE * self.max_states:
            self._begin()  # the texts have changed
        at, steps = self.start, self.next
        for i, byte in enumerate(raw):
            step = steps[at | byte]
            if not step:
                if len(self.readings) >= self.max_states:
                    yield tuple(self._simulate(self.readings[at >> 8], raw[i:]))
                    return
                step = self._step(at, byte)
            if step < 0:
                yield self.written[at | byte]
                step = -step
            at = step
        yield self.last[at >> 8]

    def encode(self, raw: bytes) -> list[int]:
        """Ids of one piece.  A piece that is a token is that token."""
        token = self.ranks.get(raw)
        return [token] if token is not None else [i for part in self.stream(raw) for i in part]


class Utf8:
    """Incremental UTF-8: ``feed`` takes bytes cut anywhere and returns the characters that are complete; what can
    not be UTF-8 becomes U+FFFD."""

    def __init__(self):
        self.need, self.low, self.high, self.held = 0, 0x80, 0xBF, b""

    def _begin(self, b: int) -> bool:
        """Enter the character that ``b`` begins; False if none begins so."""
        if 0xC2 <= b <= 0xDF:
            self.need = 1
        elif 0xE0 <= b <= 0xEF:
            self.need, self.low, self.high = 2, 0xA0 if b == 0xE0 else 0x80, 0x9F if b == 0xED else 0xBF
        elif 0xF0 <= b <= 0xF4:
            self.need, self.low, self.high = 3, 0x90 if b == 0xF0 else 0x80, 0x8F if b == 0xF4 else 0xBF
        else:
            return False
        self.held = bytes((b,))
        return True

    def feed(self, raw: bytes) -> str:
        if not self.need and raw.isascii():
            return raw.decode("ascii")
        out = []
        for b in raw:
            if self.need and self.low <= b <= self.high:
                self.need, self.low, self.high, self.held = self.need - 1, 0x80, 0xBF, self.held + bytes((b,))
                if not self.need:
                    out.append(self.held.decode("utf-8"))
                continue
            if self.need:  # the character was cut short, and b is looked at anew
                out.append(self.end())
            if b < 0x80:
                out.append(chr(b))
            elif not self._begin(b):
                out.append("�")
        return "".join(out)

    def end(self) -> str:
        """U+FFFD if a character is incomplete."""
        cut = "�" if self.need else ""
        self.need, self.low, self.high, self.held = 0, 0x80, 0xBF, b""
        return cut


def rank_file(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Codec:
    """Texts to ids and back."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, max_chunks: int = MAX_CHUNKS):
        import regex

        self.transducer, self.max_chunks = Transducer(ranks), max_chunks
        self.pieces = regex.compile(pattern).findall
        #: Whether no piece goes on over the border of a word and a single space that a word follows.
        self.at_spaces = pattern.endswith(SPACE_RULES)
        self.known: dict[str, array] = {}
        self.unknown = 0
        self.text = {i: raw.decode("utf-8") if _complete(raw) else None for raw, i in ranks.items()}

    def _encoded(self, part: str) -> array:
        encode, out = self.transducer.encode, array("I")
        for piece in self.pieces(part):
            out.extend(encode(piece.encode("utf-8", "replace")))
        return out

    def _chunk(self, word: str) -> array:
        """Ids of a space and ``word``, which neither begins nor ends with white space; short ones are remembered."""
        ids = self._encoded(" " + word)
        self.unknown += 1
        if self.unknown > LATE * self.max_chunks:
            self.known.clear()
            self.unknown = 0
        if len(self.known) < self.max_chunks and len(word) <= CHUNK_CHARS:
            self.known[word] = ids
        return ids

    def encode(self, text: str) -> array:
        if not self.at_spaces:
            return self._encoded(text)
        known, words = self.known.get, text.split(" ")
        out, held = array("I"), words[0]  # what waits for a word without white space at its ends
        for word in words[1:]:
            ids = known(word)
            if ids is None or held is not None:
                if not word or word[0].isspace() or word[-1].isspace():
                    held = f"{held or ''} {word}"
                    continue
                if held is not None and held[-1:].strip():  # ends with a word
                    out += self._encoded(held)
                    held = None
                if held is not None:
                    ids, held = self._encoded(f"{held} {word}"), None
                elif ids is None:
                    ids = self._chunk(word)
            out += ids
        return out + self._encoded(held) if held else out

    def decode(self, ids: Iterable[int]) -> Iterator[str]:
        """The text in parts, as ids come.  Where the machine is between characters, runs of tokens that are whole
        characters pass it without a look at their bytes."""
        machine, tokens, ids = Utf8(), self.transducer.tokens, iter(ids)
        while run := list(islice(ids, RUN)):
            whole = [self.text[i] for i in run]
            if machine.need or None in whole:
                yield "".join([t if t is not None and not machine.need else machine.feed(tokens[i])
                               for i, t in zip(run, whole, strict=True)])
            else:
                yield "".join(whole)
        yield machine.end()


def _complete(raw: bytes) -> bool:
    try:
        raw.decode("utf-8")
    except UnicodeDecodeError:
        return False
    return True


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One codec per Python worker, whose automaton serves all its tasks."""
    return Codec(rank_file(path), pattern)


def public_paths() -> tuple[str, str]:
    """The rank file and the pattern of pieces."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def encode_decode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks_path: str | None = None,
                  pattern: str | None = None, keep: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256), with ``keep`` also ``ids`` (little-endian unsigned 32-bit) and
    ``decoded``."""
    path, split = (ranks_path, pattern) if ranks_path and pattern else public_paths()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    kind = dict(rows.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, split)
        gc.disable()  # tables of numbers and strings hold no cycles
        for whole in batches:
            for batch in byte_slices(whole, 1):
                n, ids_hex, text_hex, kept, back = [], [], [], [], []
                for raw in batch.column(1):
                    ids = own.encode((raw.as_py() or b"").decode("utf-8", "replace"))
                    packed = np.frombuffer(ids, dtype=np.uint32).astype("<u4", copy=False).tobytes() if ids else b""
                    digest = hashlib.sha256()
                    for part in own.decode(ids):
                        digest.update(part.encode())
                    n.append(len(ids))
                    ids_hex.append(hashlib.sha256(packed).hexdigest())
                    text_hex.append(digest.hexdigest())
                    kept.append(packed if keep else None)
                    back.append("".join(own.decode(ids)) if keep else None)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_hex, pa.string()),
                     pa.array(text_hex, pa.string()), pa.array(kept, pa.binary()), pa.array(back, pa.string())],
                    names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"])
        gc.enable()

    out = rows.mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string, ids binary, "
                               "decoded string")
    return out if keep else out.drop("ids", "decoded")
