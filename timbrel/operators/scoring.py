"""Scores: derivation from labels, verification, aggregation over annotators and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timbrel.functions.columns import clamp, half_step
from timbrel.rubric import NAMES, NEUTRAL


def oracle_scores(valence: Column, arousal: Column, dataset: Column, emotion: Column, intensity: Column, has_context: Column) -> dict[str, Column]:
    """Target scores of a labelled utterance, in half steps.

    Mean ratings give valence, arousal and, by distance from the middle, intensity; acted
    corpora count as fitting, conversational ones a little less; context makes
    transitions a little better than neutral. The overall score is the mean of the
    unrounded others.
    """
    neutral = F.lit(NEUTRAL)
    rated = valence.isNotNull() & arousal.isNotNull()
    acted = emotion.isNotNull() & (dataset == "ravdess")
    spoken = emotion.isNotNull() & dataset.isin("iemocap", "meld")
    strength = F.when(rated, clamp(2.0 + F.abs(arousal - 3.0) * 1.5)).otherwise(neutral)
    strength = F.when(acted & (intensity == "strong"), F.least(strength + 1.0, F.lit(5.0))).otherwise(strength)
    fit = F.when(acted, 4.0).when(spoken, 3.5).otherwise(neutral)
    raw = {
        "emotional_intensity": strength, "emotional_appropriateness": fit, "emotional_consistency": fit,
        "valence_accuracy": F.when(rated, clamp(valence)).otherwise(neutral), "arousal_accuracy": F.when(rated, clamp(arousal)).otherwise(neutral),
        "transition_smoothness": F.when(has_context, 3.5).otherwise(neutral),
    }
    total = raw["emotional_intensity"]
    for n in list(raw)[1:]:
        total = total + raw[n]
    raw["overall_emotional_quality"] = clamp(total / 6)
    return {n: half_step(raw[n]) for n in NAMES}


def score_match(generated: str, oracle: str, tolerance: float = 0.5) -> Column:
    """Struct of matches between two score structs; a missing generated score is neutral."""
    per = [
        F.struct(F.lit(n).alias("dimension"), F.coalesce(F.col(generated)[n], F.lit(NEUTRAL)).alias("generated"), F.col(oracle)[n].alias("oracle")) for n in NAMES
    ]
    deviation = F.transform(F.filter(F.array(*per), lambda x: x["oracle"].isNotNull()), lambda x: x.withField("deviation", F.abs(x["generated"] - x["oracle"])))
    return F.struct(
        F.size(F.filter(deviation, lambda x: x["deviation"] <= tolerance)).alias("n_matched"),
        F.size(deviation).alias("n_total"),
        F.coalesce(F.array_max(F.transform(deviation, lambda x: x["deviation"])), F.lit(0.0)).alias("max_deviation"),
    )


def verified_attempts(df: DataFrame, key: str, attempt: str, deviation: str, tolerance: float = 0.5) -> DataFrame:
    """``(key, attempt, forced)``: the first attempt within tolerance, else the last one with the target forced on it."""
    ok = F.min(F.when(F.col(deviation) <= tolerance, F.col(attempt)))
    return df.groupBy(key).agg(F.coalesce(ok, F.max(attempt)).alias("attempt"), ok.isNull().alias("forced"))


def aggregate_scores(df: DataFrame, key: str, names: tuple[str, ...], method: str = "mean") -> DataFrame:
    """Mean or, for any other method, median of each score over the rows of a key, clamped, to two places."""
    f = F.avg if method == "mean" else F.median
    return df.groupBy(key).agg(*(F.bround(clamp(f(n)), 2).alias(n) for n in names), F.count("*").alias("n_annotators"))


def agreement(df: DataFrame, key: str, names: tuple[str, ...]) -> DataFrame:
    """One less the variance ratio of each score over the rows of a key; 1 for a single row."""
    def one(n):
        v = F.var_pop(n)
        return F.when(F.count(n) < 2, 1.0).otherwise(1 - v / F.greatest(v + 1e-8, F.lit(1.0))).alias(n)

    return df.groupBy(key).agg(*map(one, names))


def k_average(df: DataFrame, key: str, names: tuple[str, ...]) -> DataFrame:
    """Mean to two and population spread to three places of each score over the samples of a key."""
    cols = [c for n in names for c in (F.bround(F.avg(F.coalesce(n, F.lit(NEUTRAL))), 2).alias(n), F.bround(F.stddev_pop(F.coalesce(n, F.lit(NEUTRAL))), 3).alias(f"{n}_std"))]
    return df.groupBy(key).agg(*cols, F.count("*").alias("k_samples"))


def k_best(df: DataFrame, key: str, index: str, names: tuple[str, ...]) -> DataFrame:
    """``(key, best)``: the sample nearest to the rounded means; the first of equal ones."""
    mean = k_average(df, key, names).select(key, *(F.col(n).alias(f"_{n}") for n in names))
    terms = [F.pow(F.coalesce(n, F.lit(NEUTRAL)) - F.col(f"_{n}"), 2) for n in names]
    distance = terms[0]
    for t in terms[1:]:
        distance = distance + t
    return df.join(mean, key).groupBy(key).agg(F.min_by(index, F.struct(F.round(distance, 9), index)).alias("best"))


def score_stats(df: DataFrame, struct: str, names: tuple[str, ...] = NAMES) -> DataFrame:
    """``(dimension, mean, std, min, max)``: one pass over the table, one row per dimension."""
    flat = df.select(F.explode(F.array(*(F.struct(F.lit(n).alias("dimension"), F.coalesce(F.col(struct)[n], F.lit(NEUTRAL)).alias("v")) for n in names))).alias("x"))
    return flat.groupBy("x.dimension").agg(F.avg("x.v").alias("mean"), F.stddev_pop("x.v").alias("std"), F.min("x.v").alias("min"), F.max("x.v").alias("max"))


def valid_scores(df: DataFrame, struct: str) -> DataFrame:
    """Adds ``invalid``: the dimensions whose score is missing or off the scale."""
    bad = [F.when(~F.coalesce(F.col(struct)[n].between(1.0, 5.0), F.lit(False)), F.lit(n)) for n in NAMES]
    return df.withColumn("invalid", F.array_compact(F.array(*bad)))
