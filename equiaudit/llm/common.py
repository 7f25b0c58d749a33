"""Helpers shared by the training-data operators."""

from __future__ import annotations

import string
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from equiaudit.session import ensure_checkpoint_dir

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: The same characters as a set, for translate().
WHITE = " \t\n\x0b\x0c\r"
#: Rows of whole texts that Spark hands to a Python worker at once; the operators cut these again.
TEXT_ROWS = 1024
_ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(col: str | Column) -> Column:
    return F.coalesce(F.col(col) if isinstance(col, str) else col, F.lit(""))


def lower_ascii(col: Column) -> Column:
    """Lower-case A-Z and leave every other character as it is."""
    return F.translate(col, string.ascii_uppercase, string.ascii_lowercase)


def n_words(col: Column) -> Column:
    return F.regexp_count(col, F.lit(WORD)).cast("long")


def held_out(id_col: str, parts: int, part: int) -> Column:
    """Whether the CRC-32 of the id as text leaves ``part``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), F.lit(parts)) == part


def byte_slices(batch: pa.RecordBatch, column: int, size: int = 1 << 20, rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` whose texts in ``column`` have about ``size`` bytes at most (a longer text is a slice by
    itself), so that what a task holds does not follow the length of texts."""
    begin = np.cumsum(np.concatenate([[0], _byte_lengths(batch.column(column))]))
    at = 0
    while at < batch.num_rows:
        end = int(np.searchsorted(begin, begin[at] + size, side="right")) - 1
        end = min(max(end, at + 1), at + rows, batch.num_rows)
        yield batch.slice(at, end - at)
        at = end


def _byte_lengths(texts: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    return pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def training_sample(rows: DataFrame, id_col: str, n: int, salt: str = "sample", total: int | None = None) -> DataFrame:
    """About ``n`` rows, chosen by a hash of the id; all if there are fewer.  A sample of a sample needs another salt.
    ``total`` is the number of rows, if it is known."""
    share = min(1.0, n / max(1, rows.count() if total is None else total))
    kept = F.pmod(F.xxhash64(F.col(id_col), F.lit(salt)), F.lit(1 << 53)).cast("double")
    return rows.where(kept < share * (1 << 53)) if share < 1 else rows


def training_sample_by(rows: DataFrame, id_col: str, by: str, n: int, salt: str = "sample") -> DataFrame:
    """About ``n`` rows of each value of ``by`` that is not null, chosen by a hash of the id; all of a value's rows if
    there are fewer."""
    counts = rows.where(F.col(by).isNotNull()).groupBy(F.col(by).alias("__by")).agg(F.count(F.lit(1)).alias("__rows"))
    kept = F.pmod(F.xxhash64(F.col(id_col), F.lit(salt)), F.lit(1_000_000_000))
    both = rows.join(F.broadcast(written(counts, "sample-counts")), F.col(by) == F.col("__by"))
    return both.where(kept < F.lit(n * 1.0e9) / F.col("__rows")).select(*[F.col(f"`{c}`") for c in rows.columns])


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def arrow_rows(spark: SparkSession, rows: int | None) -> Iterator[None]:
    """Jobs started inside send Python workers ``rows`` rows at once, unless the session sets a number of its own.
    Spark's 10,000 whole texts are tens of megabytes, held several times over by a task and its worker."""
    if rows is None or spark.conf.get(_ARROW_ROWS, None) is not None:
        yield
        return
    spark.conf.set(_ARROW_ROWS, str(rows))
    try:
        yield
    finally:
        spark.conf.unset(_ARROW_ROWS)


def written(df: DataFrame, name: str, batch_rows: int | None = None) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet below the shared checkpoint folder and read it again.

    Every executor can read the files, so a lost executor costs no more than
    its running tasks.  The files stay until ``drop_scratch`` removes them,
    because lazy results built on them may still be read.  ``batch_rows``
    bounds the rows handed to a Python worker at once (see ``arrow_rows``).
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with arrow_rows(spark, batch_rows):
        df.write.parquet(path)
    _MADE.append(path)
    return spark.read.schema(df.schema).parquet(path)


_MADE: list[str] = []


def scratch_mark() -> int:
    """The number of scratch tables so far, for ``drop_scratch``."""
    return len(_MADE)


def drop_scratch(spark: SparkSession, mark: int = 0) -> int:
    """Delete the scratch tables that this process has written since ``mark``; call it when what was built on them is
    stored."""
    n = 0
    while len(_MADE) > mark:
        path = spark._jvm.org.apache.hadoop.fs.Path(_MADE.pop())
        n += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return n
