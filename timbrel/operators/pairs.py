"""Matched pairs: rows alike in all keys but one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def matched_pairs(df: DataFrame, keys: list[str], by: Column, a: str, b: str, row: Column, order: Column) -> DataFrame:
    """``(keys.., a, b)``: for each key the last row with value ``a`` and the last with ``b``, where both exist.

    One aggregation with map-side combine instead of a self join.
    """
    last = lambda v: F.max_by(F.when(by == v, row), F.when(by == v, order))
    return df.where(by.isin(a, b)).groupBy(*keys).agg(last(a).alias("a"), last(b).alias("b")).where("a is not null and b is not null")


def controlled_pairs(df: DataFrame, emotion_a: str, emotion_b: str, row: str = "utterance_id", order: str = "ordinal") -> DataFrame:
    """Same speaker, statement, repetition and intensity; two emotions."""
    keys = ["speaker_id", "statement", "repetition", "intensity"]
    return matched_pairs(df, keys, F.col("categorical_emotion"), emotion_a, emotion_b, F.col(row), F.col(order))


def intensity_pairs(df: DataFrame, emotion: str, row: str = "utterance_id", order: str = "ordinal") -> DataFrame:
    """Same speaker, statement and repetition of one emotion; normal and strong."""
    of = df.where(F.col("categorical_emotion") == emotion)
    return matched_pairs(of, ["speaker_id", "statement", "repetition"], F.col("emotion_intensity"), "normal", "strong", F.col(row), F.col(order))
