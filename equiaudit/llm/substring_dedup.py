"""Removal of repeated passages over a compacted de Bruijn graph (operator 8).

The edges of the graph are the windows of ``window`` words, its nodes the
words that neighbouring windows share.  An edge that occurs twice or more,
anywhere, is removed: every word that it covers goes, in all its places.

1. Each window is filed under its anchor, the least of its ``anchor``-word
   k-mers by hash (the first, if there are equals).  Neighbouring windows with
   the same anchor occurrence form a segment: a nonbranching path of the
   document, on average a dozen edges, named by a hash of its words.  Only
   segments with their source coordinates go on, not windows.
2. Equal windows have equal anchors.  Anchors that occur once are dropped by an
   aggregation and a join.
3. Segments under one anchor are compacted: equal ones become one path with a
   multiplicity.  A path with two or more places is repeated as a whole.
4. Where an anchor has several paths the graph branches.  Only there single
   windows are compared: one source of each path is read again by its
   coordinates, and windows found under two paths are repeated.
5. Repeated paths and windows lead back through their coordinates to spans of
   documents, whose union is cut out of the texts.

Words, windows and paths are compared by 64-bit hashes, always together with
their anchor's hash of another 64 bits.

Defined cases: null and empty texts have no words, nothing removed and the
digest of the empty text.  Texts shorter than a window lose nothing.  Rows with
the same id and text are separate places of the same words, so they lose all
windows.  Null ids are ids like others; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equiaudit.llm.common import byte_slices, written
from equiaudit.llm.shingles import Powers, mix, word_hashes

WINDOW, ANCHOR = 35, 12
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_POWERS = Powers(0xD1342543DE82EF95)
_PLACE = np.uint64(0xFFFFFFFF)


class Rolling:
    """Hashes of runs of words from prefix sums over all words of a batch."""

    def __init__(self, h: np.ndarray):
        self.up, self.down = _POWERS(len(h) + 1)
        self.sums = np.zeros(len(h) + 1, dtype=np.uint64)
        np.cumsum(h * self.up[:len(h)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, length: np.ndarray | int) -> np.ndarray:
        return mix((self.sums[start + length] - self.sums[start]) * self.down[start] + np.uint64(length)
                   if np.isscalar(length) else
                   (self.sums[start + length] - self.sums[start]) * self.down[start] + length.astype(np.uint64))


def _least(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every run of ``w`` neighbours, by doubling."""
    out, have, done = x, 1, None
    length = len(x) - w + 1
    at = 0
    while w:
        if w & have:
            part = out[at:at + length]
            done = part if done is None else np.minimum(done, part)
            at += have
            w -= have
        if w:
            out = np.minimum(out[:-have], out[have:])
            have *= 2
    return done


def segments_of(h: np.ndarray, n: np.ndarray, window: int, anchor: int) -> dict[str, np.ndarray]:
    """Segments of the texts whose word hashes ``h`` follow each other, ``n`` words each."""
    begin = np.cumsum(n) - n
    count = np.maximum(n - window + 1, 0)
    total = int(count.sum())
    if not total:
        e = np.empty(0, dtype=np.int64)
        return {"row": e, "start": e, "n": e, "anchor": e, "content": e}
    rolling = Rolling(h)
    kmer = rolling(np.arange(len(h) - anchor + 1), anchor)
    # the hash's upper half, then the place: of equal ones the first is the least
    order = (kmer & ~_PLACE) | np.arange(len(kmer), dtype=np.uint64)
    best = _least(order, window - anchor + 1)
    row = np.repeat(np.arange(len(n)), count)
    at = np.arange(total) - np.repeat(np.cumsum(count) - count, count) + begin[row]
    place = (best[at] & _PLACE).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (row[1:] != row[:-1])]))
    size = np.diff(np.concatenate([new, [total]]))
    first = at[new]
    return {"row": row[new], "start": first - begin[row[new]], "n": size, "anchor": kmer[place[new]].view(np.int64),
            "content": rolling(first, size + window - 1).view(np.int64)}


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(id_col, text_col).alias("of"),
                       F.col(text_col).alias("text"))


def segments(docs: DataFrame, id_col: str, text_col: str, window: int, anchor: int) -> DataFrame:
    """(doc_id, of, start, n, anchor, content): ``n`` windows from word ``start`` on; (doc_id, of) names the row."""
    rows = _rows(docs, id_col, text_col)
    kind = dict(rows.dtypes)["doc_id"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in byte_slices(whole, 2):
                s = segments_of(*word_hashes(batch.column(2).to_pylist(), lower=False), window, anchor)
                take = pa.array(s["row"])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(take), batch.column(1).take(take), pa.array(s["start"], pa.int32()),
                     pa.array(s["n"], pa.int32()), pa.array(s["anchor"]), pa.array(s["content"])],
                    names=["doc_id", "of", "start", "n", "anchor", "content"])

    return rows.mapInArrow(cut, f"doc_id {kind}, of long, start int, n int, anchor long, content long")


def _with_places(docs: DataFrame, places: DataFrame, how: str) -> DataFrame:
    """Rows of documents with ``places``, the list of (start, n, ...) that belongs to them."""
    p = places.select(F.col("doc_id").alias("p_id"), F.col("of").alias("p_of"), "places")
    on = (F.col("of") == F.col("p_of")) & F.col("doc_id").eqNullSafe(F.col("p_id"))
    return docs.join(p, on, how).drop("p_id", "p_of")


def branch_windows(docs: DataFrame, paths: DataFrame, window: int) -> DataFrame:
    """(anchor, code, doc_id, of, start, single) for every window of the paths' sources."""
    listed = paths.groupBy("doc_id", "of").agg(F.collect_list(F.struct("start", "n", "anchor", "single")).alias("places"))
    # a row that is there twice is read twice; its windows are repeated anyway
    rows = _with_places(docs, listed, "inner").select("doc_id", "of", "text", "places")
    kind = dict(rows.dtypes)["doc_id"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in byte_slices(whole, 2):
                h, words = word_hashes(batch.column(2).to_pylist(), lower=False)
                places = batch.column(3)
                per_row = np.diff(places.offsets.to_numpy())
                flat = places.flatten()
                start, n, anchor, single = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(4))
                row = np.repeat(np.repeat(np.arange(batch.num_rows), per_row), n)
                j = np.repeat(np.arange(len(n)), n)
                own = start[j] + np.arange(len(j)) - np.repeat(np.cumsum(n) - n, n)
                code = Rolling(h)(own + (np.cumsum(words) - words)[row], window)
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor[j]), pa.array(code.view(np.int64)), batch.column(0).take(take),
                     batch.column(1).take(take), pa.array(own, pa.int32()), pa.array(single[j])],
                    names=["anchor", "code", "doc_id", "of", "start", "single"])

    return rows.mapInArrow(read, f"anchor long, code long, doc_id {kind}, of long, start int, single boolean")


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                   anchor: int = ANCHOR) -> DataFrame:
    """(doc_id, of, start, n): runs of ``n`` windows from word ``start`` on that all occur elsewhere too."""
    every = written(segments(docs, id_col, text_col, window, anchor), "segments")
    twice = every.groupBy("anchor").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("anchor")
    kept = written(every.join(twice, "anchor"), "repeated-anchors")
    paths = kept.groupBy("anchor", "content").agg(
        F.count(F.lit(1)).alias("c"), F.min(F.struct("doc_id", "of", "start", "n")).alias("at"))
    paths = written(paths, "paths")
    whole = kept.join(paths.where("c > 1").select("anchor", "content"), ["anchor", "content"]).select(
        "doc_id", "of", "start", "n")

    branches = paths.groupBy("anchor").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("anchor")
    open_paths = paths.join(branches, "anchor").select("anchor", (F.col("c") == 1).alias("single"), "at.*")
    rows = _rows(docs, id_col, text_col)
    wins = written(branch_windows(rows, open_paths, window), "branch-windows")
    met = wins.groupBy("anchor", "code").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("anchor", "code")
    single = wins.where("single").join(met, ["anchor", "code"]).select("doc_id", "of", "start", F.lit(1).alias("n"))
    return whole.unionByName(single)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
                   anchor: int = ANCHOR, keep_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256), with ``keep_text`` also ``kept_text``: the words that stay, joined by
    single spaces."""
    spans = repeated_spans(docs, id_col, text_col, window, anchor)
    listed = spans.groupBy("doc_id", "of").agg(F.collect_list(F.struct("start", "n")).alias("places"))
    rows = _with_places(_rows(docs, id_col, text_col), listed, "left").select("doc_id", "text", "places")
    kind = dict(rows.dtypes)["doc_id"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in byte_slices(whole, 1):
                n, removed, digests, texts = [], [], [], []
                for text, places in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                    words = _WORD.findall((text or "").encode("utf-8", "surrogatepass"))
                    n.append(len(words))
                    if places.is_valid:
                        start, size = (places.values.field(i).to_numpy(zero_copy_only=False) for i in range(2))
                        depth = np.bincount(start, minlength=len(words) + 1) - np.bincount(
                            np.minimum(start + size + window - 1, len(words)), minlength=len(words) + 1)
                        keep = np.cumsum(depth[:-1]) == 0
                        words = [words[i] for i in np.flatnonzero(keep)]
                    left = b" ".join(words)
                    removed.append(n[-1] - len(words))
                    digests.append(hashlib.sha256(left).hexdigest())
                    texts.append(left if keep_text else None)
                columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests),
                           pa.array(texts, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(
                    columns, names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"])

    out = rows.mapInArrow(
        cut, f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string, kept_text string")
    return out if keep_text else out.drop("kept_text")
