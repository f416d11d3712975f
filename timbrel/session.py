"""Session helpers: table reading and lineage cutting that survives executor loss."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` under ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors share, as the session names it.

    ``spark.checkpoint.dir`` is set by the cluster. A private temporary folder is
    used only when it is unset and the master is local (tests); a real cluster
    without the setting is an error, as a machine-local folder would be lost.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        if sc.getCheckpointDir() is None:
            sc.setCheckpointDir(path)
        return path
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="timbrel-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably in the shared folder and forget its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as parquet into the shared folder and read it back.

    Smaller than a checkpoint for narrow numeric tables, and columns can be pruned
    when it is read again.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/timbrel-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._timbrel_path = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete the files behind tables of :func:`written`, once nothing lazy reads them any more; others are left alone."""
    for df in tables:
        path = getattr(df, "_timbrel_path", None)
        if path:
            at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def finished(df: DataFrame, label: str, *tables: DataFrame | None) -> DataFrame:
    """``df`` written, and the intermediate ``tables`` it came from deleted."""
    out = written(df, label)
    discard(*tables)
    return out


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of queries that are over; else they stay until the driver happens to collect its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def standing_on(df: DataFrame, table: DataFrame) -> DataFrame:
    """``df``, which reads the written ``table`` and is discarded with it."""
    df._timbrel_path = table._timbrel_path
    return df


def bounded(df: DataFrame, max_rows: int) -> DataFrame:
    """``df`` marked for a broadcast if it has at most ``max_rows`` rows, as it is otherwise."""
    return F.broadcast(df) if is_small(df, max_rows) else df


def is_small(df: DataFrame, max_rows: int) -> bool:
    """Whether ``df`` has at most ``max_rows`` rows, found without a full count."""
    return df.limit(max_rows + 1).count() <= max_rows
