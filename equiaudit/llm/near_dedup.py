"""Near-duplicates by MinHash with tensored banding (operator 2).

A document's set is its distinct five-word shingles.  Two collections of ``m``
hashes of ``k`` minhashes each are drawn; a table key combines one of the first
with one of the second.  So ``m * m`` keys of ``2k`` minhashes cost ``2mk``
minhashes instead of ``2km²``.  A pair of similarity s shares a key unless one
collection misses: with m = 12, k = 2 and s = 0.75 in 1 of 10,000 cases.

1. Documents with equal sets become one representative (the smallest id).
2. Halves of keys that only one representative has cannot match.  They are
   counted first (24 per document); keys are formed from the rest alone.
3. Each key's bucket is reduced to its least member by partial aggregation, and
   every member gets one partner: the one that is least in most of its buckets.
   Links are confirmed on the full sets, and joined to groups.
4. What is left are members of one bucket in different groups.  A document can
   only link to another group if enough of its shingles occur outside its own:
   a link to y needs an overlap of 3/7 of both sizes, and the overlap is no
   more than those shingles.  The documents that can are compared exactly with
   those of other groups that they meet in buckets, directly or by way of
   others, in blocks of bounded size; nothing is capped.
5. Groups that found links are joined; a component is named by its smallest id.

Copies never expand into pairs, and buckets never into all their pairs.  Sets
are compared as sets of 64-bit shingle hashes.

Defined cases: documents without words (or null texts) have size 0, are linked
with nothing and kept.  Rows with one id are one node.  A row with a null id
goes with its exact copies only, and a component of null ids alone has a null
name; all its rows are kept.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from equiaudit.llm.common import TEXT_ROWS, written
from equiaudit.llm.components import components
from equiaudit.llm.shingles import mix, shingle_sets

WORDS, PERCENT = 5, 75
TABLES, HASHES = 12, 2
#: Shingles of a block in the exact comparison of groups.
BLOCK = 1 << 17


def _families(tables: int, hashes: int) -> np.ndarray:
    rng = np.random.Generator(np.random.PCG64(7))
    return rng.integers(0, 1 << 63, (2 * tables * hashes, 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def sketches(docs: DataFrame, id_col: str, text_col: str, words: int = WORDS, tables: int = TABLES,
             hashes: int = HASHES) -> DataFrame:
    """(doc_id, n, s1, s2, first, second): set size, 128-bit name of the set, the two collections."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = dict(rows.dtypes)["doc_id"]
    family = _families(tables, hashes)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                sets = shingle_sets(batch.column(1).to_pylist(), words)
                n = np.array([len(s) for s in sets], dtype=np.int64)
                full = n > 0
                halves = np.zeros((len(sets), 2 * tables), dtype=np.uint64)
                s1, s2 = np.zeros(len(sets), dtype=np.uint64), np.zeros(len(sets), dtype=np.uint64)
                if full.any():
                    every = np.concatenate(sets)
                    starts = (np.cumsum(n) - n)[full]
                    s1[full] = np.add.reduceat(every, starts)
                    s2[full] = np.add.reduceat(mix(every), starts)
                    least = np.stack([np.minimum.reduceat(every * a + b, starts) for a, b in family], axis=1)
                    least = least.reshape(len(starts), 2 * tables, hashes)
                    half = np.arange(2 * tables, dtype=np.uint64)[None] + np.zeros((len(starts), 1), dtype=np.uint64)
                    for k in range(hashes):
                        half = mix(half * np.uint64(0x9E3779B97F4A7C15) + least[:, :, k])
                    halves[full] = half
                flat = pa.array(halves.view(np.int64).ravel())
                slots = pa.FixedSizeListArray.from_arrays(flat, 2 * tables).cast(pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(n), pa.array(s1.view(np.int64)), pa.array(s2.view(np.int64)), slots],
                    names=["doc_id", "n", "s1", "s2", "halves"])

    return rows.mapInArrow(sketch, f"doc_id {kind}, n long, s1 long, s2 long, halves array<long>")


def bucket_rows(reps: DataFrame, tables: int = TABLES) -> DataFrame:
    """(rep, key): keys from halves that at least two representatives have."""
    half = reps.select("rep", F.posexplode("halves").alias("slot", "half"))
    common = half.groupBy("half").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("half")
    own = half.join(common, "half").groupBy("rep").agg(F.collect_list(F.struct("slot", "half")).alias("own"))
    first = F.filter("own", lambda x: x["slot"] < tables)
    second = F.filter("own", lambda x: x["slot"] >= tables)
    # at most tables * tables keys of one document
    keys = F.flatten(F.transform(first, lambda a: F.transform(second, lambda b: F.xxhash64(
        a["slot"], a["half"], b["slot"], b["half"]))))
    return own.select("rep", F.explode(keys).alias("key"))


def full_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, words: int = WORDS) -> DataFrame:
    """(rep, n, items) of the wanted representatives (rep, s1, s2), from their whole texts."""
    rows = docs.select(F.col(id_col).alias("rep"), F.col(text_col).alias("text"))
    rows = rows.join(wanted, "rep").select("rep", "s1", "s2", "text")
    kind = dict(rows.dtypes)["rep"]

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                found = shingle_sets(batch.column(3).to_pylist(), words)
                sums = [int(s.sum().view(np.int64)) if len(s) else 0 for s in found]
                same = pa.array([a == b for a, b in zip(sums, batch.column(1).to_pylist(), strict=True)])
                out = pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([len(s) for s in found], pa.int64()),
                     pa.array([s.view(np.int64) for s in found], pa.list_(pa.int64()))], names=["rep", "n", "items"])
                yield out.filter(same)  # other rows with this id have sets of their own

    return rows.mapInArrow(sets, f"rep {kind}, n long, items array<long>")


def _linked(common: Column | int, a: Column, b: Column, percent: int) -> Column:
    return 100 * common >= percent * (a + b - common)


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Those of the pairs (a, b) whose full sets are similar enough."""
    left, right = (sets.select(F.col("rep").alias(x), F.col("n").alias(f"n{x}"), F.col("items").alias(f"i{x}"))
                   for x in "ab")
    small, large = F.least("na", "nb"), F.greatest("na", "nb")
    both = pairs.join(left, "a").join(right, "b").where(100 * small >= percent * large)
    common = F.size(F.array_intersect("ia", "ib"))
    return both.where(_linked(common, F.col("na"), F.col("nb"), percent)).select("a", "b")


def _compare(percent: int):
    def compare(docs: pd.DataFrame) -> pd.DataFrame:
        """Links between the two blocks of the group, or within its one block."""
        i, j = docs["i"].iloc[0], docs["j"].iloc[0]
        x, y = (docs[docs["block"] == k] for k in (i, j))
        n, most, group = (x[c].to_numpy()[:, None] for c in ("n", "most", "component"))
        n2, most2, group2 = (y[c].to_numpy()[None] for c in ("n", "most", "component"))
        able = (group != group2) & (n2 <= most) & (n <= most2)
        able &= 100 * np.minimum(n, n2) >= percent * np.maximum(n, n2)
        if i == j:
            able = np.triu(able, 1)
        xs, ys = ([np.asarray(s) for s in d["items"]] for d in (x, y))
        joined, out = set(), []
        for a, b in zip(*np.nonzero(able), strict=True):
            pair = group[a, 0], group2[0, b]
            if pair not in joined:  # one link joins two groups
                c = len(np.intersect1d(xs[a], ys[b], assume_unique=True))
                if 100 * c >= percent * (len(xs[a]) + len(ys[b]) - c):
                    joined.add(pair)
                    out.append(pair)
        return pd.DataFrame(out, columns=["a", "b"])

    return compare


def links_between(groups: DataFrame, buckets: DataFrame, sets: DataFrame, percent: int = PERCENT,
                  block: int = BLOCK) -> DataFrame:
    """Links (a, b) between groups: for any two groups whose members meet in a bucket and that hold a link, one at
    least.  ``groups``: (rep, component) for every representative in a bucket."""
    kind = dict(sets.dtypes)["rep"]
    keyed = buckets.join(groups, "rep")
    span = keyed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi")
    mixed = written(keyed.join(span.select("key"), "key"), "mixed-buckets")
    active = mixed.select("rep", "component").distinct()

    # shingles that occur in two groups, and how many of them each document has
    own = sets.join(active, "rep")
    shingle = own.select("rep", "component", F.explode("items").alias("item"))
    shared = shingle.groupBy("item").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
    shared = shared.where("lo < hi").select("item")
    outside = shingle.join(shared, "item").groupBy("rep").agg(F.count(F.lit(1)).alias("outside"))
    # 100 c >= p (n + n2 - c), c <= outside: the other's size is at most ``most``
    most = F.floor((100 + percent) * F.col("outside") / percent - F.col("n"))
    alive = written(own.join(outside, "rep").withColumn("most", most).where(100 * F.col("most") >= percent * F.col("n"))
                    .select("rep", "component", "n", "most"), "alive")

    # families: groups that meet in buckets, directly or by way of others
    met = mixed.join(alive.select("rep"), "rep").select("key", "component").distinct()
    least = met.groupBy("key").agg(F.min("component").alias("lo"))
    family = components(met.join(least, "key").select(F.col("component").alias("a"), F.col("lo").alias("b")))
    family = family.select(F.col("node").alias("component"), F.col("component").alias("family"))
    members = written(alive.join(family, "component"), "families")
    sizes = members.groupBy("family").agg(F.ceil(F.sum("n") / block).cast("int").alias("blocks"))
    members = members.join(sizes, "family").withColumn("block", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))
    members = members.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = members.select("family", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"),
                           "block", "rep", "component", "n", "most").join(sets.select("rep", "items"), "rep")
    return pairs.groupBy("family", "i", "j").applyInPandas(_compare(percent), f"a {kind}, b {kind}")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS,
                    percent: int = PERCENT, tables: int = TABLES, hashes: int = HASHES) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per row of ``docs``."""
    rows = written(sketches(docs, id_col, text_col, words, tables, hashes), "sketches", TEXT_ROWS)
    classes = rows.where("n > 0").groupBy("s1", "s2").agg(F.min("doc_id").alias("rep"), F.first("halves").alias("halves"))
    classes = written(classes, "classes")
    reps = classes.where(F.col("rep").isNotNull())
    buckets = written(bucket_rows(reps, tables), "buckets")

    least = buckets.groupBy("key").agg(F.min("rep").alias("to"), F.max("rep").alias("hi")).where("to < hi")
    tied = written(buckets.join(least.select("key", "to"), "key"), "tied")  # members of buckets of two or more
    stars = tied.where("rep != to").groupBy("rep", "to").agg(F.count(F.lit(1)).alias("c"))
    best = stars.groupBy("rep").agg(F.max_by("to", F.struct("c", "to")).alias("to"))
    pairs = written(best.select(F.col("rep").alias("a"), F.col("to").alias("b")), "pairs")

    members = tied.select("rep").distinct()
    wanted = reps.join(members, "rep").select("rep", "s1", "s2")
    sets = written(full_sets(docs, wanted, id_col, text_col, words), "sets", TEXT_ROWS)
    links = written(confirmed(pairs, sets, percent), "links")
    first = written(components(links), "groups")
    groups = members.join(first.withColumnRenamed("node", "rep"), "rep", "left").select(
        "rep", F.coalesce("component", "rep").alias("component"))
    groups = written(groups, "all-groups")
    more = written(links_between(groups, tied.select("rep", "key"), sets, percent), "more-links")

    join = components(more)
    final = groups.join(join.withColumnRenamed("component", "joined"), F.col("component") == F.col("node"), "left")
    final = final.select("rep", F.coalesce("joined", "component").alias("component"))
    named = classes.select("s1", "s2", "rep").join(final, "rep", "left").select(
        "s1", "s2", F.coalesce("component", "rep").alias("component"))
    words_in = rows.where("n > 0").select("doc_id", "n", "s1", "s2").join(named, ["s1", "s2"])
    empty = rows.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component"))
    return words_in.select("doc_id", "n", "component").unionByName(empty).select(
        "doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"),
        F.col("doc_id").eqNullSafe(F.col("component")).alias("kept"))
