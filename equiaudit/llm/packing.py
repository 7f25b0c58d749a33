"""Mixture-controlled packing (operator 5).

Each source is a queue of tokens.  A window is served by deficit round-robin:
in every window a queue may send its quantum (the window's tokens times its
target proportion); what a whole number of tokens leaves over stays as its
deficit and is added in the next window.  After k windows a queue has sent
``min(all, floor(k * quantum))`` tokens, so a task can place any token of any
queue by itself, and deficits carry over windows and partitions without a
pass over the windows.  By default the proportions are those of the corpus, so
all queues end together; a queue that ends early leaves the others' ratio as
it is.

1. One pass encodes the texts (once) and writes ids, with each document's
   start in its queue counted inside its task.
2. Sums per (source, task) become the tasks' starts in the queues.
3. A second pass places the documents: it cuts them at the ends of windows and
   of sequences.  Sequences follow each other without gaps, so only the
   corpus's last one is not full.  Token data are never shuffled while the
   tasks' sums are small enough for Spark to broadcast them.

The driver and each task hold the queues' sizes up to ``local_sources``
sources.  Beyond, the sizes stay in Spark tables: every queue lists the windows
in which it sends, sums by window give the places of its shares, and the
documents' cuts are joined to these by source and window.  The pieces are the
same.

Defined cases: a null or empty text has the end id only.  Null sources are one
queue, null ids pass through, repeated rows are documents of their own, other
columns are ignored.  An empty table gives no pieces.  Any number of sources is
packed, unless ``max_sources`` sets a bound: more are then an error.
"""

from __future__ import annotations

import base64
import os
import zlib
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from equiaudit.llm.common import TEXT_ROWS, text_or_empty, written

SEQUENCE = 2048
#: Tokens of a window: sixteen sequences.
WINDOW_TOKENS = 16 * SEQUENCE
#: Sources whose sizes the driver and each task hold.
LOCAL_SOURCES = 10_000
#: Windows whose sizes one task adds up.
WINDOWS_PER_BLOCK = 10_000
END_ID = 1


def public_paths() -> tuple[str, str]:
    """The tokenizer's file, and the same vocabulary as ranks for the faster library."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


class Encoder:
    """Ids of the tokenizer in ``json_path``.  With ``ranks_path`` (the same vocabulary) texts are encoded from the
    ranks, which gives the same ids several times faster; texts that hold an added token go to the tokenizer."""

    def __init__(self, json_path: str, ranks_path: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(json_path)
        self.added = [t.content for t in self.full.get_added_tokens_decoder().values()]
        self.fast = None
        if ranks_path:
            import public_tokenizers
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                          special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is None or any(x in text for x in self.added):
            return np.array(self.full.encode(text, add_special_tokens=False).ids, dtype="<u4")
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)


def encoded(docs: DataFrame, id_col: str, text_col: str, source_col: str, paths: tuple[str, str | None]) -> DataFrame:
    """(doc_id, source, part, local, n, ids): ``local`` is the start in the source's tokens of this task; ids are
    little-endian, two bytes each if the vocabulary allows it."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"),
                       text_or_empty(text_col).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, sent = Encoder(*paths), TaskContext.get().partitionId(), {}
        wide = encoder.full.get_vocab_size(with_added_tokens=True) > 1 << 16
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                local, n, out = [], [], []
                for source, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                    ids = np.append(encoder(text), np.uint32(END_ID))
                    local.append(sent.get(source, 0))
                    sent[source] = local[-1] + len(ids)
                    n.append(len(ids))
                    out.append(ids.astype("<u4" if wide else "<u2").tobytes())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), batch.column(1), pa.array([part] * len(n), pa.int32()), pa.array(local, pa.int64()),
                     pa.array(n, pa.int64()), pa.array(out, pa.binary())],
                    names=["doc_id", "source", "part", "local", "n", "ids"])

    return rows.mapInArrow(encode, f"doc_id {kind}, source string, part int, local long, n long, ids binary")


class Plan:
    """What each queue has sent after k windows, and where a window's share of a queue starts in the whole order."""

    def __init__(self, sizes: list[int], weights: list[float], window: int):
        self.n = np.array(sizes, dtype=np.int64)
        w = np.array(weights, dtype=np.float64)
        self.quantum = window * w / w.sum()
        self.windows = int(np.max(np.ceil(self.n / self.quantum))) if len(sizes) else 0

    def sent(self, k: np.ndarray, s: np.ndarray | slice) -> np.ndarray:
        n = self.n[s]
        return np.where(k >= self.windows, n, np.minimum(n, np.floor(k * self.quantum[s]).astype(np.int64)))

    def window_of(self, x: np.ndarray, s: np.ndarray) -> np.ndarray:
        """The k with sent(k) <= x < sent(k + 1), for tokens x of the queues s."""
        k = np.minimum((x / self.quantum[s]).astype(np.int64), self.windows - 1)
        while (low := self.sent(k, s) > x).any():
            k -= low
        while (high := self.sent(k + 1, s) <= x).any():
            k += high
        return k

    def starts(self, k: np.ndarray, s: np.ndarray) -> np.ndarray:
        """Place of the first token that queue s sends in window k: all earlier windows, then earlier queues."""
        found, at = np.unique(k, return_inverse=True)
        out = np.empty(len(k), dtype=np.int64)
        step = max(1, 2_000_000 // max(1, len(self.n)))
        for i in range(0, len(found), step):
            ks = found[i:i + step, None]
            before, after = self.sent(ks, slice(None)), self.sent(ks + 1, slice(None))
            share = after - before
            base = before.sum(axis=1, keepdims=True) + np.cumsum(share, axis=1) - share
            here = (at >= i) & (at < i + step)
            out[here] = base[at[here] - i, s[here]]
        return out


def _spread(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices and values of lo..hi (both included) for each entry."""
    count = hi - lo + 1
    i = np.repeat(np.arange(len(lo)), count)
    return i, lo[i] + np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count)


def pieces_of(start: np.ndarray, n: np.ndarray, s: np.ndarray, plan: Plan, sequence: int) -> dict[str, np.ndarray]:
    """Cut documents [start, start + n) of the queues s at windows and sequences."""
    i, k = _spread(plan.window_of(start, s), plan.window_of(start + n - 1, s))
    sent = plan.sent(k, s[i])
    lo, hi = np.maximum(start[i], sent), np.minimum(start[i] + n[i], plan.sent(k + 1, s[i]))
    full = hi > lo
    i, k, lo, hi, sent = (x[full] for x in (i, k, lo, hi, sent))
    g = plan.starts(k, s[i]) + lo - sent
    j, q = _spread(g // sequence, (g + hi - lo - 1) // sequence)
    first, last = np.maximum(g[j], q * sequence), np.minimum(g[j] + (hi - lo)[j], (q + 1) * sequence)
    return {"row": i[j], "start": lo[j] - start[i[j]] + first - g[j], "length": last - first, "sequence_id": q,
            "offset": first - q * sequence}


def in_queues(rows: DataFrame, sums: DataFrame) -> DataFrame:
    """(doc_id, source, start, n, ids): the documents with their starts in their queues."""
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = written(sums.select(F.col("source").alias("s"), F.col("part").alias("p"),
                                 F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")), "token-starts")
    placed = rows.join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p")))
    return placed.select("doc_id", "source", (F.col("before") + F.col("local")).alias("start"), "n", "ids")


class RowPlan(Plan):
    """A plan of some rows' queues: each row brings its queue's size and quantum."""

    def __init__(self, sizes: np.ndarray, quantum: np.ndarray, windows: int):
        self.n, self.quantum, self.windows = sizes.astype(np.int64), quantum.astype(np.float64), windows

    def cuts(self, start: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """(row, window, from, to, sent before) for the tokens [start, end) of the rows' queues, without empty cuts.
        A queue that sends less than a token a window is asked by token, others by window; about a million at a time."""
        every = np.arange(len(start))
        first, last = self.window_of(start, every), self.window_of(end - 1, every)
        by_token = last - first >= end - start
        lo, hi = np.where(by_token, start, first), np.where(by_token, end - 1, last)
        row, at, done = 0, 0, (-1, -1)
        while row < len(start):  # a slice may end inside a row
            ends = np.cumsum(hi[row:] - lo[row:] + 1) - at
            stop = row + int(np.searchsorted(ends, 1_000_000)) + 1
            part = np.arange(row, min(stop, len(start)))
            a, b = lo[part].copy(), hi[part].copy()
            a[0] += at
            if ends[len(part) - 1] > 1_000_000:
                b[-1] -= ends[len(part) - 1] - 1_000_000
                row, at = int(part[-1]), int(b[-1] + 1 - lo[part[-1]])
            else:
                row, at = int(part[-1]) + 1, 0
            i, k = _spread(a, b)
            i = part[i]
            token = by_token[i]
            if token.any():
                k[token] = self.window_of(k[token], i[token])
                # two tokens of a row in one window (the last, which takes what is left) are one cut
                keep = np.ones(len(k), dtype=bool)
                keep[0] = (int(i[0]), int(k[0])) != done
                keep[1:] = (i[1:] != i[:-1]) | (k[1:] != k[:-1])
                done = int(i[-1]), int(k[-1])
                i, k = i[keep], k[keep]
            sent = self.sent(k, i)
            x, y = np.maximum(start[i], sent), np.minimum(end[i], self.sent(k + 1, i))
            full = y > x
            yield i[full], k[full], x[full], y[full], sent[full]


def pack_by_tables(rows: DataFrame, sums: DataFrame, proportions: Mapping[str | None, float] | None, sequence: int,
                   window: int) -> DataFrame:
    """``pack`` for any number of sources: the queues' sizes and the windows' places are tables."""
    spark = rows.sparkSession
    queues = sums.groupBy("source").agg(F.sum("n").alias("size"))
    if proportions:
        given = spark.createDataFrame([(k, float(w)) for k, w in proportions.items()], "s string, weight double")
        queues = queues.join(given, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    else:
        queues = queues.withColumn("weight", F.col("size").cast("double"))
    queues = written(queues, "queue-sizes")
    if (missing := queues.where("weight is null").first()) is not None:
        raise KeyError(missing["source"])
    whole = queues.agg(F.sum("weight")).first()[0]
    queues = written(queues.select("source", "size", (F.lit(float(window)) * F.col("weight") / F.lit(whole)).alias("quantum")),
                     "queues")
    windows = int(queues.agg(F.max(F.ceil(F.col("size") / F.col("quantum")))).first()[0])

    def shares(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                size, quantum = (batch.column(c).to_numpy(zero_copy_only=False) for c in (1, 2))
                for i, k, x, y, _ in RowPlan(size, quantum, windows).cuts(np.zeros_like(size), size):
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(i)), pa.array(k), pa.array(y - x)],
                                                     names=["source", "k", "share"])

    sent = queues.repartition(F.xxhash64("source")).mapInArrow(shares, "source string, k long, share long")
    sent = written(sent, "queue-shares")
    blocks = written(sent.groupBy("k").agg(F.sum("share").alias("n")).withColumn(
        "block", F.expr(f"k div {WINDOWS_PER_BLOCK}")), "window-sizes")

    def earlier(n: str, by: WindowSpec) -> Column:
        return F.coalesce(F.sum(n).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))

    starts = blocks.groupBy("block").agg(F.sum("n").alias("n")).select(
        "block", earlier("n", Window.orderBy("block")).alias("base"))  # one row per block of windows
    starts = blocks.join(starts, "block").select(
        "k", (F.col("base") + earlier("n", Window.partitionBy("block").orderBy("k"))).alias("base"))
    own = Window.partitionBy("k").orderBy(F.col("source").asc_nulls_last())
    places = sent.join(starts, "k").select(F.col("source").alias("s"), F.col("k").alias("w"),
                                           (F.col("base") + earlier("share", own)).alias("place"))

    placed = in_queues(rows, sums).join(queues.withColumnRenamed("source", "q"), F.col("source").eqNullSafe(F.col("q")))
    placed = placed.select("doc_id", "source", "start", "n", "size", "quantum", "ids")
    kind = dict(placed.dtypes)["doc_id"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                start, n, size, quantum = (batch.column(c).to_numpy(zero_copy_only=False) for c in (2, 3, 4, 5))
                blobs, held, ids = batch.column(6), -1, b""
                for i, k, x, y, sent in RowPlan(size, quantum, windows).cuts(start, start + n):
                    out, first = [], x - start[i]
                    for row, a, b in zip(i.tolist(), first.tolist(), (y - start[i]).tolist(), strict=True):
                        if row != held:
                            blob, held = blobs[row].as_py(), row
                            ids = np.frombuffer(blob, "<u2" if len(blob) == 2 * n[row] else "<u4").astype("<u4").tobytes()
                        out.append(ids[4 * a:4 * b])
                    take = pa.array(i)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(take), batch.column(1).take(take), pa.array(k), pa.array(first),
                         pa.array(x - sent), pa.array(y - x), pa.array(n[i]), pa.array(out, pa.binary())],
                        names=["doc_id", "source", "k", "first", "after", "length", "doc_tokens", "ids"])

    cuts = placed.mapInArrow(cut, f"doc_id {kind}, source string, k long, first long, after long, length long, "
                                  "doc_tokens long, ids binary")
    at = cuts.join(places, F.col("source").eqNullSafe(F.col("s")) & (F.col("k") == F.col("w")))
    at = at.withColumn("g", F.col("place") + F.col("after")).withColumn("sequence_id", F.explode(F.sequence(
        F.expr(f"g div {sequence}"), F.expr(f"(g + length - 1) div {sequence}"))))
    lo = F.greatest(F.col("g"), F.col("sequence_id") * sequence)
    hi = F.least(F.col("g") + F.col("length"), (F.col("sequence_id") + 1) * sequence)
    at = at.withColumns({"lo": lo, "hi": hi})
    skipped, length = F.col("lo") - F.col("g"), F.col("hi") - F.col("lo")
    part = F.substring("ids", (skipped * 4 + 1).cast("int"), (length * 4).cast("int"))
    return at.select("doc_id", (F.col("first") + skipped).alias("start"), length.alias("length"),
                     F.crc32(part).alias("ids_crc32"), "doc_tokens", "sequence_id",
                     (F.col("lo") - F.col("sequence_id") * sequence).alias("offset"), "source")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
         proportions: Mapping[str | None, float] | None = None, paths: tuple[str, str | None] | None = None,
         sequence: int = SEQUENCE, window: int = WINDOW_TOKENS, max_sources: int | None = None,
         local_sources: int = LOCAL_SOURCES) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, source), one row per piece."""
    rows = written(encoded(docs, id_col, text_col, source_col, paths or public_paths()), "tokens", TEXT_ROWS)
    sums = written(rows.groupBy("source", "part").agg(F.sum("n").alias("n")), "token-sums")
    sources = sums.groupBy("source").agg(F.sum("n").alias("n")).orderBy(F.col("source").asc_nulls_last())
    if max_sources is not None and sources.limit(max_sources + 1).count() > max_sources:
        raise ValueError(f"more than {max_sources} sources; mix by a coarser column")
    found = sources.limit(local_sources + 1).collect()
    if len(found) > local_sources:
        return pack_by_tables(rows, sums, proportions, sequence, window)
    sizes = [r["n"] for r in found]
    weights = [float(proportions[r["source"]]) for r in found] if proportions else [float(x) for x in sizes]
    plan, number = Plan(sizes, weights, window), {r["source"]: i for i, r in enumerate(found)}

    placed = in_queues(rows, sums)
    kind = dict(placed.dtypes)["doc_id"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                start, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in (2, 3))
                s = np.array([number[x] for x in batch.column(1).to_pylist()], dtype=np.int64)
                p = pieces_of(start, n, s, plan, sequence)
                sums, held, ids = [], -1, None
                blobs = batch.column(4)
                for row, a, length in zip(p["row"].tolist(), p["start"].tolist(), p["length"].tolist(), strict=True):
                    if row != held:
                        blob, held = blobs[row].as_py(), row
                        ids = np.frombuffer(blob, "<u2" if len(blob) == 2 * n[row] else "<u4").astype("<u4")
                    sums.append(zlib.crc32(ids[a:a + length]))
                take = pa.array(p["row"])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(take), pa.array(p["start"]), pa.array(p["length"]), pa.array(sums, pa.int64()),
                     pa.array(n[p["row"]]), pa.array(p["sequence_id"]), pa.array(p["offset"]),
                     batch.column(1).take(take)],
                    names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source"])

    return placed.mapInArrow(cut, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, "
                                  "sequence_id long, offset long, source string")
