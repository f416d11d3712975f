"""Operators over ordered rows: dialogue context, runs, sliding windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def context_turns(df: DataFrame, dialogue: str, order: list[str], speaker: str, text: str, n: int = 3) -> DataFrame:
    """``context_turns``: the ``n`` turns before each row as ``[speaker] text``; none for the first."""
    w = Window.partitionBy(dialogue).orderBy(*order).rowsBetween(-n, -1)
    said = F.concat(F.lit("["), F.coalesce(speaker, F.lit("")), F.lit("] "), F.coalesce(text, F.lit("")))
    return df.withColumn("context_turns", F.collect_list(said).over(w))


def dialogue_stats(df: DataFrame, dialogue: str, speaker: str) -> DataFrame:
    """Length and number of distinct speakers of each dialogue, by a map-side aggregate."""
    return df.groupBy(dialogue).agg(F.count("*").alias("dialogue_length"), F.count_distinct(speaker).alias("n_speakers"))


def multi_party(df: DataFrame, dialogue: str, speaker: str, least: int = 3) -> DataFrame:
    """Rows of dialogues with at least ``least`` speakers."""
    many = dialogue_stats(df, dialogue, speaker).where(F.col("n_speakers") >= least).select(dialogue)
    return df.join(many, dialogue, "left_semi")


def runs(df: DataFrame, group: str, order: str, flag: Column) -> DataFrame:
    """``(group, start, stop, length)`` of maximal runs of rows where ``flag`` holds.

    ``order`` numbers the rows of a group from 0 without holes; ``stop`` is the row after
    the run. The difference of a row's number and its number among flagged rows is
    constant within a run.
    """
    w = Window.partitionBy(group).orderBy(order)
    hit = df.where(flag).select(group, order).withColumn("_g", F.col(order) - F.row_number().over(w))
    return hit.groupBy(group, "_g").agg(F.min(order).alias("start"), (F.max(order) + 1).alias("stop"), F.count("*").alias("length")).drop("_g")


def sliding_counts(events: DataFrame, spans: DataFrame, group: str, at: str, duration: str, width: float = 1.0, step: float = 0.5) -> DataFrame:
    """``(group, start, n)``: events in each window of ``width`` that starts every ``step``; empty windows count 0.

    Windows start before ``duration - width``. An event is sent to the few windows that
    can hold it, so windows and events meet on equal keys.
    """
    size = F.ceil((F.col(duration) - width) / step).cast("int")
    windows = spans.where(F.col(duration) > width).select(group, F.explode(F.sequence(F.lit(0), F.greatest(size - 1, F.lit(0)))).alias("_i"))
    last = F.floor(F.col(at) / step).cast("int")
    reach = int(-(-width // step))
    held = (
        events.select(group, F.col(at).alias("_t"), F.explode(F.sequence(F.greatest(last - reach, F.lit(0)), last)).alias("_i"))
        .where((F.col("_t") >= F.col("_i") * step) & (F.col("_t") < F.col("_i") * step + width))
        .groupBy(group, "_i").agg(F.count("*").alias("n"))
    )
    return windows.join(held, [group, "_i"], "left").select(group, (F.col("_i") * step).alias("start"), F.coalesce("n", F.lit(0)).alias("n"))


def rate_variation(counts: DataFrame, group: str, width: float = 1.0) -> DataFrame:
    """Population spread of the windows' rates."""
    return counts.groupBy(group).agg(F.stddev_pop(F.col("n") / width).alias("rate_std"), F.count("*").alias("n_windows"))
