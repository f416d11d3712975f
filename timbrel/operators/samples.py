"""Filters, limits and summaries over utterance tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timbrel.functions.columns import category, corpus_name, speaker_name, split_name


def canonical(df: DataFrame) -> DataFrame:
    """``df`` with the label columns that it has as they are meant: corpus, split, category and speaker."""
    read = {"dataset_name": corpus_name, "split": split_name, "categorical_emotion": category, "speaker_id": speaker_name}
    return df.withColumns({n: f(n) for n, f in read.items() if n in df.columns})


def by_emotion(df: DataFrame, emotions: list[str], col: str = "categorical_emotion") -> DataFrame:
    return df.where(F.col(col).isin(emotions))


def by_speaker(df: DataFrame, speaker: str, col: str = "speaker_id") -> DataFrame:
    return df.where(F.col(col) == speaker)


def duration_band(df: DataFrame, low: float = 0.5, high: float = 30.0, col: str = "duration_sec") -> DataFrame:
    """Rows whose length is within the band; a length of 0 or less means that it is not known, and passes."""
    return df.where((F.col(col) <= 0) | F.col(col).between(low, high))


def first_n(df: DataFrame, n: int | None, order: list[str]) -> DataFrame:
    """The first ``n`` rows in corpus order; all of them for None or 0."""
    return df.orderBy(*order).limit(n) if n else df


def at_index(df: DataFrame, i: int, order: list[str]) -> DataFrame:
    """The row at place ``i``, found by a top-k rather than by numbering all rows."""
    top = df.orderBy(*order).limit(i + 1)
    return top.orderBy(*(F.desc(c) for c in order)).limit(1) if i >= 0 else df.limit(0)


def remaining(df: DataFrame, done: DataFrame, key: str = "utterance_id") -> DataFrame:
    """Rows not processed yet, by key rather than by offset, so failures are taken up again."""
    return df.join(done.select(key).distinct(), key, "left_anti")


def open_work(df: DataFrame, done: DataFrame, target: int, order: list[str], key: str = "utterance_id") -> DataFrame:
    """The first remaining rows in corpus order, as many as ``target`` results still lack."""
    lacking = target - done.select(key).distinct().count()
    return remaining(df, done, key).orderBy(*order).limit(max(lacking, 0))


def emotion_distribution(df: DataFrame, col: str = "categorical_emotion") -> DataFrame:
    return df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("emotion")).agg(F.count("*").alias("n"))


def speakers(df: DataFrame, col: str = "speaker_id") -> DataFrame:
    return df.where(F.col(col) != "").select(F.col(col).alias("speaker")).distinct()


def summary(df: DataFrame, by: list[str]) -> DataFrame:
    """Counts of samples, speakers, transcripts and context, per group."""
    return df.groupBy(*by).agg(
        F.count("*").alias("n_samples"),
        F.count_distinct(F.when(F.col("speaker_id") != "", F.col("speaker_id"))).alias("n_speakers"),
        F.count_if(F.col("transcript") != "").alias("with_transcript"),
        F.count_if(F.size("context_turns") > 0).alias("with_context"),
        F.count_if(F.col("categorical_emotion").isNotNull()).alias("with_emotion"),
    )


def union_corpora(*parts: DataFrame) -> DataFrame:
    """All parts one after another; ``ordinal`` is renumbered within (part, old ordinal) order only when asked for by a sort."""
    tagged = [p.withColumn("part", F.lit(i)) for i, p in enumerate(parts)]
    out = tagged[0]
    for p in tagged[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def first_per_group(df: DataFrame, group: str, order: list[str], per_group: int | None, groups: int | None) -> DataFrame:
    """The first rows of each of the first groups in name order: the bounded sample statistics are fitted on. None means all."""
    named = df.where(F.col(group) != "")
    rows = named
    if groups is not None:
        chosen = named.select(group).distinct().orderBy(group).limit(groups)
        rows = df.join(F.broadcast(chosen), group)  # at most ``groups`` rows
    if per_group is None:
        return rows
    w = Window.partitionBy(group).orderBy(*order)
    return rows.withColumn("_r", F.row_number().over(w)).where(f"_r <= {int(per_group)}").drop("_r")
