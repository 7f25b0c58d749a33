"""Exact de-duplication with the heavy hitters split off (operator 10).

1. One pass computes the SHA-256 of each normalised text; only (id, digest)
   goes on.
2. Misra-Gries (``DataFrame.freqItems``) names every digest that more than
   ``support`` of all rows share, and at most about ``1 / support`` digests
   altogether.
3. The candidates are counted exactly.  The verified winners, with the id that
   stays and the group's size, are broadcast: their number is bounded by
   ``1 / support`` at any input size.  Rows of winners are decided on the map
   side and are never shuffled by digest.
4. The remaining digests are aggregated (partial sums before the shuffle) and
   joined back.  No such digest has more than ``support`` of the rows.

Defined cases: a null text counts as empty; empty texts are a group like any
other.  A null id never wins against a non-null one; if all ids of a group are
null, ``keep_id`` is null and its rows are kept.  Rows that repeat an id and
its text all carry the same verdict.  Other columns are ignored, whatever
their names.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equiaudit.llm.common import lower_ascii, text_or_empty, written

#: A digest with more than this share of all rows is found by Misra-Gries for sure.
SUPPORT = 1 / 1024


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                support: float = SUPPORT) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), one row per row of ``docs``."""
    digest = F.sha2(lower_ascii(text_or_empty(text_col)), 256)
    rows = written(docs.select(F.col(id_col).alias("doc_id"), digest.alias("text_sha256")), "digests")

    frequent = rows.freqItems(["text_sha256"], support)
    candidates = frequent.select(F.explode("text_sha256_freqItems").alias("text_sha256"))
    # bounded by the summary's size, 1 / support entries
    winners = written(
        _groups(rows.join(F.broadcast(candidates), "text_sha256")).where("group_size > 1"), "winners")
    hot = rows.join(F.broadcast(winners), "text_sha256")
    rest = rows.join(F.broadcast(winners), "text_sha256", "left_anti")
    cold = rest.join(_groups(rest), "text_sha256")
    return hot.unionByName(cold).select(
        "doc_id", "keep_id", "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def _groups(rows: DataFrame) -> DataFrame:
    return rows.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
