"""JSON-lines files in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timbrel.rubric import NAMES
from timbrel.sources import paths

SCORES = "struct<" + ",".join(f"{n}:double" for n in NAMES) + ">"
TRAINING = f"utterance_id string, audio_path string, transcript string, context_turns array<string>, target_output string, scores {SCORES}, oracle_scores {SCORES}"


def read_training(spark: SparkSession, path: str) -> DataFrame:
    """Training rows; blank and malformed lines and rows without a target are skipped."""
    df = spark.read.schema(TRAINING + ", _bad string").json(path, mode="PERMISSIVE", columnNameOfCorruptRecord="_bad")
    return df.where("_bad is null and target_output <> ''").drop("_bad")


def write_jsonl(df: DataFrame, path: str) -> None:
    """One JSON object a row; null fields are left out. Files stay as many as there are partitions."""
    df.write.mode("overwrite").json(path)


def write_chat(df: DataFrame, path: str) -> None:
    """``messages`` and, where there are any, ``audios`` of each row; rows of ``is_val`` go to ``val_`` beside it."""
    base, _, name = path.rpartition("/")
    chat = df.select("is_val", "messages", F.when(F.size("audios") > 0, F.col("audios")).alias("audios"))
    write_jsonl(chat.where("not is_val").drop("is_val"), path)
    held = chat.where("is_val").drop("is_val")
    if not held.isEmpty():
        write_jsonl(held, f"{base}/val_{name}")


def flat(df: DataFrame) -> DataFrame:
    """System, input and output text of each chat, with the first audio path or null."""
    m = F.col("messages")
    return df.select(
        "utterance_id", *(F.try_element_at(m, F.lit(i + 1))["content"].alias(n) for i, n in enumerate(("system", "input", "output"))), F.try_element_at("audios", F.lit(1)).alias("audio_path")
    )


META = "batch string, processed long, failed long, n_samples long"


def append_checkpoint(df: DataFrame, path: str, batch: str, processed: int, failed: int = 0, key: str = "utterance_id") -> None:
    """Adds the rows of one batch whose key is not there yet, then its counts, exactly once.

    A batch has a folder of its own, which a repeated call replaces, and counts only once its
    meta row stands; so a batch that broke off half way leaves nothing behind.
    """
    spark = df.sparkSession
    done, _ = read_checkpoint(spark, path, df.schema)
    if f"batch={batch}" in [p.rsplit("/", 1)[-1] for p in paths.children(spark, f"{path}/meta")]:
        return
    df.dropDuplicates([key]).join(done.select(key), key, "left_anti").select(*df.columns).write.mode("overwrite").json(f"{path}/rows/batch={batch}")
    n = spark.read.schema(df.schema).json(f"{path}/rows/batch={batch}").count()
    spark.createDataFrame([(batch, processed, failed, n)], META).coalesce(1).write.mode("overwrite").json(f"{path}/meta/batch={batch}")


def read_checkpoint(spark: SparkSession, path: str, schema) -> tuple[DataFrame, dict[str, int]]:
    """Rows of all finished batches, and the sums of their counts: ``processed``, ``failed`` and ``n_samples``."""
    finished = [p for p in paths.children(spark, f"{path}/meta") if paths.exists(spark, f"{p}/_SUCCESS")]
    if not finished:
        return spark.createDataFrame([], schema), {"processed": 0, "failed": 0, "n_samples": 0}
    meta = spark.read.schema(META).json(finished).agg(F.sum("processed").alias("processed"), F.sum("failed").alias("failed"), F.sum("n_samples").alias("n_samples")).first()
    rows = spark.read.schema(schema).json([f"{path}/rows/{p.rsplit('/', 1)[-1]}" for p in finished])
    return rows, meta.asDict()
