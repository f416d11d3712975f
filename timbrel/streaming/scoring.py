"""Incremental scoring of response files, and rolling score windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timbrel.functions.columns import score_struct, with_scores

RESPONSES = "utterance_id string, k int, response string, at timestamp"


def responses(spark: SparkSession, folder: str, per_trigger: int | None = None) -> DataFrame:
    """A stream of response records from JSON files as they arrive."""
    r = spark.readStream.schema(RESPONSES)
    return (r.option("maxFilesPerTrigger", per_trigger) if per_trigger else r).json(folder)


def scored(stream: DataFrame) -> DataFrame:
    """Adds the parsed score struct and the number of dimensions found."""
    df, found = with_scores(stream, "response")
    held = sum((F.when(c.isNotNull(), 1).otherwise(0) for c in found.values()), F.lit(0))
    return df.withColumn("scores", score_struct(found)).withColumn("n_dims_parsed", held).drop("_pairs")


def windowed_means(stream: DataFrame, width: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Mean overall score per event-time window; records later than the watermark are left out."""
    s = scored(stream).withWatermark("at", late)
    return s.groupBy(F.window("at", width)).agg(F.count("*").alias("n"), F.avg("scores.overall_emotional_quality").alias("mean_overall"))


def run_available(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Processes what is there and stops; the checkpoint makes a later call take up what is new."""
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
