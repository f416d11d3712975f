"""Path probes through the cluster's own file system, so they hold on shared storage too."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(p)


def first_existing(spark: SparkSession, candidates: list[str]) -> str | None:
    """The first candidate that exists."""
    return next((p for p in candidates if exists(spark, p)), None)


def children(spark: SparkSession, path: str) -> list[str]:
    """Paths right under a folder; a handful, as corpora have few top folders."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return sorted(s.getPath().toString() for s in fs.listStatus(p)) if fs.exists(p) else []


def files(spark: SparkSession, glob: str, pattern: str) -> DataFrame:
    """``(path, name)`` of files; contents are never read, as only the path column is selected."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(glob).select("path")
    return found.withColumn("name", F.element_at(F.split("path", "/"), -1))
