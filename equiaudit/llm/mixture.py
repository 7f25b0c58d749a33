"""Mixing sources to target weights (operator 6).

1. Each row gets its word count and a hash-random key (MD5 of its id and
   text), the same on every run.
2. Targets: sources in code point order weigh 1, 2, 3, 1, ... and share all
   words; a target stops at ``max_epochs`` times its source's size and the
   excess goes to the others by weight until none is above.  The loop sends
   two sums per round to the driver, not the sources.
3. Within a source, rows are ordered by the key.  The key's leading hex digits
   cut the order into ranges of even size, so a source that holds a third of
   all rows is sorted by many tasks.  Sums per range become offsets, and a
   window inside each range completes the exact prefix sum of words.
4. A row is taken whole for every full epoch that its source's budget holds,
   and once more as far as the remaining budget reaches; the document at the
   cut gives its first words only.

Defined cases: a null text has size 0, null sources form one source (last in
order), null ids are ids like others.  Rows with equal keys (same id, text)
are ordered arbitrarily, which the result cannot show.  An empty table gives
an empty result; a source without words has target 0.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from equiaudit.llm.common import n_words, text_or_empty, written
from equiaudit.session import shuffle_partitions

WEIGHTS = (1, 2, 3)
MAX_EPOCHS = 3
ROWS_PER_RANGE = 100_000


def _measured(docs: DataFrame, id_col: str, text_col: str, source_col: str, *carry: Column) -> DataFrame:
    text = text_or_empty(text_col)
    key = F.md5(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("|"), text))
    return docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
                       n_words(text).alias("size"), key.alias("key"), *carry)


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, size) -> (source, sid, source_size, weight, target); ``sid`` is the rank in code point order."""
    spark = sizes.sparkSession
    in_order = F.col("source").asc_nulls_last()
    parts = written(sizes.repartitionByRange(shuffle_partitions(spark), in_order)
                    .withColumn("part", F.spark_partition_id()), "sources")
    local = F.row_number().over(Window.partitionBy("part").orderBy(in_order))
    # one row per partition of the table of sources
    skipped = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = parts.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", skipped.alias("before"))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]),
                          (F.pmod(F.col("sid"), F.lit(len(weights))) + 1).cast("int"))
    ranked = written(
        parts.join(starts, "part").withColumn("sid", F.col("before") + local - 1)
        .select("source", "sid", F.col("size").alias("source_size"), weight.cast("long").alias("weight")), "ranked")

    big = lambda c: F.col(c).cast("decimal(38,0)")
    total = int(ranked.agg(F.sum("source_size")).first()[0] or 0)
    num, den = total, int(ranked.agg(F.sum("weight")).first()[0] or 1)
    while True:  # the share of weight 1 is num / den; it only rises
        above = big("weight") * F.lit(num).cast("decimal(38,0)") > (
            big("source_size") * F.lit(max_epochs * den).cast("decimal(38,0)"))
        capped, free = ranked.agg(F.sum(F.when(above, F.col("source_size"))),
                                  F.sum(F.when(~above, F.col("weight")))).first()
        now = total - max_epochs * int(capped or 0), int(free or 1)
        if now == (num, den):
            break
        num, den = now
    shared = (big("weight") * F.lit(num).cast("decimal(38,0)")).cast("double") / F.lit(float(den))
    target = F.when(above, (F.col("source_size") * max_epochs).cast("double")).otherwise(shared)
    return ranked.withColumn("target", target)


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
            weights: Sequence[int] = WEIGHTS, max_epochs: int = MAX_EPOCHS,
            rows_per_range: int = ROWS_PER_RANGE, carry: bool = False) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every row; with ``carry`` also ``row``, the whole input row."""
    rows = written(_measured(docs, id_col, text_col, source_col), "sizes")
    n_rows = rows.count()
    digits = max(1, math.ceil(math.log(max(1, n_rows / rows_per_range), 16)))
    targets = written(source_targets(rows.groupBy("source").agg(F.sum("size").alias("size")), weights, max_epochs),
                      "targets")

    if carry:  # the row itself is sorted with its key; it is not joined back by an id that may repeat
        rows = _measured(docs, id_col, text_col, source_col, F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    ranged = rows.withColumn("rng", F.substring("key", 1, digits)).withColumnRenamed("source", "src")
    ranged = ranged.join(targets, F.col("src").eqNullSafe(F.col("source"))).drop("src", "source")
    sums = (rows if not carry else docs.transform(lambda d: _measured(d, id_col, text_col, source_col)))
    sums = sums.withColumn("rng", F.substring("key", 1, digits)).withColumnRenamed("source", "src")
    sums = sums.groupBy("src", "rng").agg(F.sum("size").alias("words"))
    sums = sums.join(targets.select("source", "sid"), F.col("src").eqNullSafe(F.col("source")))
    before = F.coalesce(F.sum("words").over(
        Window.partitionBy("sid").orderBy("rng").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sums.select("sid", "rng", before.alias("offset"))

    inside = Window.partitionBy("sid", "rng").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("offset") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.expr("cast(round(target) as bigint) div source_size")).otherwise(F.lit(0))
    out = ranged.join(offsets, ["sid", "rng"]).withColumn("start", start).withColumn("epochs", epochs)
    rest = budget - F.col("epochs") * F.col("source_size") - F.col("start")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest))
    return out.select("doc_id", "size", "source_size", "target",
                      (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"),
                      *(["row"] if carry else []))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                    **options) -> DataFrame:
    """The mix itself, with the columns of ``docs``: one row per full epoch of a document, and one whose text ends
    at the source's cut.  Rows without words are kept once."""
    taken = mixture(docs, id_col, text_col, source_col, carry=True, **options)
    whole = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.expr("taken div greatest(size, 1)")).cast("int")
    left = F.when(F.col("size") == 0, F.lit(0)).otherwise(F.expr("taken % greatest(size, 1)")).cast("int")
    copies = taken.select("row", F.explode(F.concat(
        F.array_repeat(F.lit(-1), whole), F.when(left > 0, F.array(left)).otherwise(F.array().cast("array<int>")))
    ).alias("words"))
    text = F.col(f"row.`{text_col}`")
    # a cut before white space that follows a word: each piece is one word with the white space before it
    pieces = F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    cut = F.array_join(F.slice(pieces, F.lit(1), F.col("words")), "")
    return copies.select(*[
        F.when(F.col("words") < 0, text).otherwise(cut).alias(c) if c == text_col else F.col(f"row.`{c}`").alias(c)
        for c in docs.columns])
