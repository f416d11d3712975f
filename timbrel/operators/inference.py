"""Scoring with repeated samples: prompts, generation, parsing, averages and the best sample."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timbrel.functions.columns import sections, with_scores
from timbrel.functions.prompts import inference_prompt
from timbrel.operators.generator import Generator, generate, mock
from timbrel.rubric import NAMES, NEUTRAL


def summarize(responses: DataFrame, key: str = "id", index: str = "k", text: str = "response") -> DataFrame:
    """``(key, scores, score_stds, reasoning, evidence, k_samples, best_sample_idx)`` out of ``(key, index, text)`` rows.

    Means to two and spreads to three places; the best sample is the first of those
    nearest to the rounded means. One aggregation: the few samples of a key are held as
    an array while the means are known.
    """
    df, found = with_scores(responses, text)
    s = sections(F.coalesce(text, F.lit("")))
    scores = F.struct(*(F.coalesce(c, F.lit(NEUTRAL)).alias(n) for n, c in found.items()))
    one = df.select(key, scores.alias("s"), F.struct(F.col(index).alias("k"), scores.alias("s"), s["reasoning"].alias("reasoning"), s["evidence"].alias("evidence")).alias("x"))
    per = one.groupBy(key).agg(
        F.struct(*(F.bround(F.avg(f"s.{n}"), 2).alias(n) for n in NAMES)).alias("scores"), F.struct(*(F.bround(F.stddev_pop(f"s.{n}"), 3).alias(n) for n in NAMES)).alias("score_stds"),
        F.count("*").alias("k_samples"), F.collect_list("x").alias("all"),
    )

    def distance(x):
        total = F.lit(0.0)
        for n in NAMES:
            total = total + F.pow(x["s"][n] - F.col("scores")[n], 2)
        return F.round(total, 9)

    best = F.array_min(F.transform("all", lambda x: F.struct(distance(x).alias("d"), x["k"].alias("k"), x["reasoning"].alias("reasoning"), x["evidence"].alias("evidence"))))
    return per.withColumn("best", best).select(key, "scores", "score_stds", "best.reasoning", "best.evidence", "k_samples", F.col("best.k").alias("best_sample_idx"))


def predict(samples: DataFrame, generator: Generator = mock, k: int = 4) -> DataFrame:
    """Results of ``k`` generated responses for each utterance of ``(utterance_id, transcript, context_turns)``."""
    asked = samples.select("utterance_id", inference_prompt(F.col("transcript"), F.col("context_turns")).alias("prompt"))
    return summarize(generate(asked, "utterance_id", "prompt", generator, k)).withColumnRenamed("id", "utterance_id")


def report(results: DataFrame) -> DataFrame:
    """Mean and spread of each dimension over all results, and the mean spread within samples."""
    x = results.select(F.explode(F.array(*(F.struct(F.lit(n).alias("dimension"), F.col("scores")[n].alias("v"), F.col("score_stds")[n].alias("s")) for n in NAMES))).alias("x"))
    return x.groupBy("x.dimension").agg(F.round(F.avg("x.v"), 6).alias("mean"), F.round(F.stddev_pop("x.v"), 6).alias("std"), F.round(F.avg("x.s"), 6).alias("mean_k_std"))
