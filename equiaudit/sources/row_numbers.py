"""Row numbers that follow the files, not the partitions they are read in.

Rows are numbered by file, then by their place in it.  A reader may cut files
into other blocks and deal the blocks to other tasks: each block knows where it
starts in its file, and rows of a block stay in order, so the counts of the
blocks, in order, give every block its first number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from equiaudit.session import cut_lineage


def number_rows(df: DataFrame, name: str = "row_index") -> DataFrame:
    """``df``, just read from files (and filtered or projected), with ``name``: 0, 1, 2 ... in the order of the files.

    The rows are written once, so that later reads see the same numbers.  One row per block is ordered in one task."""
    marked = df.select("*", F.col("_metadata.file_path").alias("__file"),
                       F.col("_metadata.file_block_start").alias("__block"),
                       F.monotonically_increasing_id().alias("__at"))
    rows = cut_lineage(marked)
    blocks = rows.groupBy("__file", "__block").agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__file", "__block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    number = (F.col("__before") + F.col("__at") - F.col("__first")).cast("long")
    return rows.join(blocks, ["__file", "__block"]).select(*[F.col(f"`{c}`") for c in df.columns], number.alias(name))
