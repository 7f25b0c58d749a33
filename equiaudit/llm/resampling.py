"""Target-distribution importance resampling (operator 12).

1. Every text is cut into words and runs of one to three words, each hashed to
   a bucket by CRC-32.  CRC-32 is linear, so the code of a run follows from
   those of its words: whole slices of texts are hashed with array arithmetic,
   and no run is ever built as a string.
2. Tasks count buckets in arrays, Spark adds the arrays up: ``buckets`` numbers
   for the corpus and for the target reach the driver and make the gains.
3. A second pass adds the gains of each text's buckets up to its weight, adds
   Gumbel noise from a digest of its id, and writes the scores.
4. The cutoff is found by bisection: jobs count exactly, over the written
   scores, how many lie above some thresholds, until one score is left; among
   documents of that score the same is done on the id, and among rows of one id
   on a number that each written row has.
5. The drawn rows are range-partitioned by score and id; sizes of the ranges
   give each its first rank.

Drawing the highest of weight plus Gumbel noise is sampling without replacement
in proportion to exp(weight).

Defined cases: a null text has no words and no features, weight 0, and is
not drawn, like every text with fewer than ``min_words`` words.  A null id has
the noise of the empty id and comes last among ties.  Rows that are there twice
tie in score and id; any of them is drawn first, the same one on every read.
Ids are whole numbers.  An empty target or corpus counts as zeros; an empty
table gives no rows.  Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from equiaudit.llm.common import byte_slices, written

BUCKETS, RUN, MIN_WORDS, PERCENT, SEED = 10_000, 3, 20, 5, "42"
#: Thresholds that one job counts; 1 is plain bisection.
CUTS = 15
#: Longer words are hashed one by one.
SHORT = 24

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A"):ord("Z") + 1] += 32
_IN_WORD = np.zeros(256, dtype=bool)
_IN_WORD[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def _byte_table() -> np.ndarray:
    """CRC-32 register after one byte, by the register's low byte."""
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> 1) ^ np.uint32(0xEDB88320), out >> 1).astype(np.uint32)
    return out


_STEP = _byte_table()


def _after(crc: np.ndarray, code: np.ndarray) -> np.ndarray:
    return _STEP[(crc ^ code) & 0xFF] ^ (crc >> np.uint32(8))


def _shift_tables(n: int, times: int) -> np.ndarray:
    """[k, j, b]: what k * ``times`` zero bytes make of the register whose byte j is b, for k below ``n``."""
    basis = (np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]).astype(np.uint32)
    out = np.empty((n, 4, 256), dtype=np.uint32)
    out[0] = basis
    if n > 1:
        one = basis
        for _ in range(times):
            one = _after(one, np.uint32(0))
        out[1] = one
        for k in range(2, n):
            out[k] = _through(out[1], out[k - 1])
    return out


def _through(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return (table[0][crc & 0xFF] ^ table[1][(crc >> np.uint32(8)) & 0xFF] ^ table[2][(crc >> np.uint32(16)) & 0xFF] ^
            table[3][crc >> np.uint32(24)])


_SHIFT = _shift_tables(64, 1)
_SHIFT_64 = _shift_tables(2, 64)[1]


def shifted(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The registers after ``length`` zero bytes each: what comes after a text turns its CRC into this."""
    low = length & 63
    at = (low << 8).astype(np.int64)
    flat = _SHIFT.transpose(1, 0, 2).reshape(4, -1)
    out = (flat[0][at | (crc & 0xFF)] ^ flat[1][at | ((crc >> np.uint32(8)) & 0xFF)] ^
           flat[2][at | ((crc >> np.uint32(16)) & 0xFF)] ^ flat[3][at | (crc >> np.uint32(24))])
    table, left = _SHIFT_64, length >> 6
    while left.any():  # longer ones: 64, 128, 256 ... bytes at a time
        odd = np.flatnonzero(left & 1)
        out[odd] = _through(table, out[odd])
        table, left = _through(table, table), left >> 1
    return out


def _word_codes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of each word: a byte of all words at a time, long words by themselves."""
    length = end - start
    order = np.argsort(length, kind="stable")
    sizes = length[order]
    crc = np.full(len(start), 0xFFFFFFFF, dtype=np.uint32)
    begins = start[order]
    for k in range(min(SHORT, int(sizes[-1])) if len(sizes) else 0):
        live = int(np.searchsorted(sizes, k, side="right"))
        crc[live:] = _after(crc[live:], raw[begins[live:] + k])
    crc ^= np.uint32(0xFFFFFFFF)
    for i in range(int(np.searchsorted(sizes, SHORT, side="right")), len(sizes)):
        crc[i] = zlib.crc32(raw[begins[i]:begins[i] + sizes[i]])
    out = np.empty_like(crc)
    out[order] = crc
    return out


def run_codes(texts: list[bytes], run: int = RUN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """CRC-32 codes of all runs of 1 to ``run`` words of the texts, the text that each belongs to, and the number of
    words of each text."""
    raw = _LOWER[np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], _IN_WORD[raw]])))
    start, end = edge[::2], edge[1::2]
    begin = np.cumsum([0, *(len(t) + 1 for t in texts)])
    text = np.searchsorted(begin, start, side="right") - 1
    code = _word_codes(raw, start, end)
    # behind a space: CRC of " " and the word
    spaced = shifted(np.full(len(code), zlib.crc32(b" "), dtype=np.uint32), end - start) ^ code
    codes, owner, last = [code], [text], code
    for k in range(1, run):
        n = len(code) - k
        if n <= 0:
            break
        same = text[k:] == text[:n]
        last = shifted(last[:n], end[k:] - start[k:] + 1) ^ spaced[k:]
        codes.append(last[same])
        owner.append(text[:n][same])
    return np.concatenate(codes), np.concatenate(owner), np.bincount(text, minlength=len(texts))


def _blocks(batch: pa.RecordBatch, column: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for part in byte_slices(batch, column):
        yield part, [raw or b"" for raw in part.column(column).to_pylist()]


def bucket_counts(docs: DataFrame, text_col: str = "text", buckets: int = BUCKETS, run: int = RUN) -> np.ndarray:
    """How often each bucket occurs in all texts: exact, ``buckets`` numbers."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for _, texts in _blocks(batch, 0):
                total += np.bincount(run_codes(texts, run)[0] % np.uint32(buckets), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["bucket", "n"])

    rows = docs.select(F.col(text_col).cast("binary")).mapInArrow(count, "bucket int, n long")
    out = np.zeros(buckets, dtype=np.int64)
    for r in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """By bucket, a thousand times the logarithm of how much more frequent it is in the target, rounded down."""
    k, s_all, t_all = len(corpus), int(corpus.sum()), int(target.sum())
    # in doubles, product by product
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + k) / ((s + 1.0) * (t_all + k))))
                     for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], dtype=np.int64)


def noise(doc_id: object, seed: str = SEED) -> int:
    """A thousand times Gumbel noise from a digest of the id, rounded down."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", run: int = RUN,
           seed: str = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch, texts in _blocks(whole, 1):
                codes, owner, words = run_codes(texts, run)
                order = np.argsort(owner, kind="stable")
                sums = np.concatenate([[0], np.cumsum(gain[codes[order] % np.uint32(len(gain))])])
                n = np.bincount(owner, minlength=len(texts))
                last = np.cumsum(n)
                weight = sums[last] - sums[last - n]
                extra = np.array([noise(i, seed) for i in batch.column(0).to_pylist()], dtype=np.int64)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(words.astype(np.int64)), pa.array(n.astype(np.int64)), pa.array(weight),
                     pa.array(weight + extra)], names=["doc_id", "n_words", "n_features", "weight", "score"])

    return rows.mapInArrow(score, "doc_id long, n_words long, n_features long, weight long, score long")


def highest(rows: DataFrame, value: Column, wanted: int, cuts: int = CUTS) -> tuple[int, int]:
    """The ``wanted``-th highest of the whole numbers ``value`` and how many are above it, by bisection: each job counts
    exactly how many lie above each of ``cuts`` thresholds.  There must be that many."""
    numbers = rows.select(value.cast("long").alias("v"))
    low, high = numbers.agg(F.min("v"), F.max("v")).first()
    above = 0  # how many are above ``high``; the sought one is in low .. high
    while low < high:
        step = max(1, (high - low + 1) // (cuts + 1))
        marks = [m for m in range(low + step, high + 1, step)][:cuts]  # each asks: how many are >= m?
        counts = numbers.agg(*[F.count(F.when(F.col("v") >= m, 1)).alias(f"m{i}") for i, m in enumerate(marks)]).first()
        enough = [m for m, n in zip(marks, counts, strict=True) if n >= wanted]
        short = [(m, n) for m, n in zip(marks, counts, strict=True) if n < wanted]
        low = max([low, *enough])
        if short:
            high, above = short[0][0] - 1, short[0][1]
    return low, above


@dataclass
class Cutoff:
    """Rows before this place in the order are drawn, and the one at it: by falling score, then id (null last), then
    the written row's number."""

    score: int
    doc_id: int | None
    row: int

    def drawn(self) -> Column:
        same = F.col("doc_id").isNull() if self.doc_id is None else F.col("doc_id") == F.lit(self.doc_id)
        earlier = F.col("doc_id").isNotNull() if self.doc_id is None else F.col("doc_id") < F.lit(self.doc_id)
        tied = F.coalesce(earlier, F.lit(False)) | (F.coalesce(same, F.lit(False)) & (F.col("row") <= self.row))
        return (F.col("score") > self.score) | ((F.col("score") == self.score) & tied)


def cutoff(rows: DataFrame, wanted: int, cuts: int = CUTS) -> Cutoff | None:
    """The place of the ``wanted``-th row of the written table (score, doc_id, row)."""
    if wanted < 1:
        return None
    score, above = highest(rows, F.col("score"), wanted, cuts)
    tied, left = rows.where(F.col("score") == score), wanted - above
    named = tied.where("doc_id is not null")
    n = named.count()
    if left <= n:
        lowest, before = highest(named, -F.col("doc_id"), left, cuts)
        doc_id, left, tied = -lowest, left - before, named.where(F.col("doc_id") == -lowest)
    else:
        doc_id, left, tied = None, left - n, tied.where("doc_id is null")
    row, _ = highest(tied, -F.col("row"), left, cuts)
    return Cutoff(score, doc_id, -row)


def ranked(rows: DataFrame) -> DataFrame:
    """``rows`` with ``rank``: 1, 2, 3 ... by falling score, id and row, counted within ranges of that order."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")]
    ranges = written(rows.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "drawn")
    # one row per range
    sizes = ranges.groupBy("part").agg(F.count(F.lit(1)).alias("size"))
    first = sizes.select("part", F.coalesce(F.sum("size").over(
        Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("part").orderBy(*order))
    return ranges.join(F.broadcast(first), "part").withColumn("rank", (F.col("before") + inside).cast("long")).drop(
        "part", "before")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             target_text_col: str = "text", buckets: int = BUCKETS, run: int = RUN, min_words: int = MIN_WORDS,
             percent: int = PERCENT, seed: str = SEED, cuts: int = CUTS) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every document; ``rank`` is null for those that are not drawn."""
    gain = gains(bucket_counts(docs, text_col, buckets, run), bucket_counts(target, target_text_col, buckets, run))
    rows = written(scored(docs, gain, id_col, text_col, run, seed).withColumn(
        "row", F.monotonically_increasing_id()), "scores")
    able = rows.where(F.col("n_words") >= min_words)
    last = cutoff(able, percent * able.count() // 100, cuts)
    out = ["doc_id", "n_features", "weight", "score", "rank"]
    none = F.lit(None).cast("long")
    if last is None:
        return rows.withColumn("rank", none).select(*out)
    chosen = (F.col("n_words") >= min_words) & last.drawn()
    return ranked(rows.where(chosen)).select(*out).unionByName(
        rows.where(~chosen).withColumn("rank", none).select(*out))
