"""Session helpers for tests, the bench and local runs.

On a cluster the session is given; nothing here overrides settings that are
already present, and the checkpoint folder is read from
``spark.checkpoint.dir`` (a shared folder the cluster names) and only set
for local runs where it is missing.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_LOCAL_CONF = {
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.driver.memory": "8g",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cores: int | str = "*", app: str = "equiaudit", extra: dict | None = None) -> SparkSession:
    b = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for k, v in {**_LOCAL_CONF, **(extra or {})}.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str | None:
    """Return the shared checkpoint folder, setting a local one only when none is configured
    and the master is local (tests).  Sessions without a SparkContext handle (Spark Connect)
    keep whatever the server is configured with."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 -- remote session: the server owns the folder
        return d
    d = d or sc.getCheckpointDir()
    if not d:
        if sc.master != "local" and not sc.master.startswith("local["):  # local-cluster[...] has separate workers
            raise RuntimeError("set spark.checkpoint.dir to a shared folder (a machine-local one does not "
                               "survive executor loss)")
        d = tempfile.mkdtemp(prefix="equiaudit-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    sc.setCheckpointDir(d)
    return d


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (survives executor loss; never ``localCheckpoint``)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str, schema: StructType | None = None) -> DataFrame:
    """``df`` written as Parquet below the shared checkpoint folder and read again, with ``schema`` as that (a type of
    its own may stand for the fields it is kept in)."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(schema or df.schema).parquet(path)


def kept_once(df: DataFrame, name: str) -> DataFrame:
    """``stored`` for rows that several steps read, each some of the columns; columns without a type are checkpointed."""
    plain = all(f.dataType.typeName() != "void" for f in df.schema.fields)
    return stored(df, name) if plain and df.columns else cut_lineage(df)


def shuffle_partitions(spark: SparkSession) -> int:
    try:
        return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    except Exception:  # noqa: BLE001
        return int(os.environ.get("EQUIAUDIT_PARTITIONS", "8"))


def spread(df: DataFrame, min_partitions: int | None = None) -> DataFrame:
    """Round-robin repartition for data that is then read many times (a fit's passes), so that a file
    written as one row group keeps all cores busy.  One shuffle; runs no job."""
    try:
        want = min_partitions or df.sparkSession.sparkContext.defaultParallelism
    except Exception:  # noqa: BLE001 -- remote session: leave partitioning to Spark
        return df
    return df.repartition(max(want, shuffle_partitions(df.sparkSession)))
