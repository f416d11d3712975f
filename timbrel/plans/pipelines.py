"""Whole flows: clips to feature text, samples to verified training rows, rows to files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timbrel.functions import columns as C
from timbrel.functions import prompts as P
from timbrel.operators import normalize, samples, scoring, signal
from timbrel.operators.generator import Generator, generate, mock
from timbrel.rubric import DIMENSIONS, NAMES, NEUTRAL
from timbrel.session import cut
from timbrel.sources.jsonl import write_jsonl
from timbrel.taxonomy import SCALARS


def feature_texts(clips: DataFrame, boundary_space: str = "raw", per_speaker: int | None = None, speakers: int | None = None) -> DataFrame:
    """``(utterance_id, features)`` of clips ``(utterance_id, speaker_id, content)``.

    Features are extracted once and kept. Statistics and cut points are fitted on all
    utterances of all speakers, or with ``per_speaker`` and ``speakers`` on the first
    utterances of the first speakers (5 and 50 are those of the reference); clips that
    cannot be decoded are left out of both. ``boundary_space`` says whether cut points come
    from raw or normalised values.
    """
    wide = cut(signal.extract(clips, ["utterance_id", "speaker_id"])).where("error is null")
    wide = wide.select("utterance_id", F.coalesce("speaker_id", F.lit("unknown")).alias("speaker"), F.array(*SCALARS).alias("x"))
    long = normalize.long_features(wide, ["utterance_id", "speaker"], "x", SCALARS)
    fit = long
    if per_speaker is not None or speakers is not None:
        fit = normalize.long_features(samples.first_per_group(wide, "speaker", ["utterance_id"], per_speaker, speakers), ["utterance_id", "speaker"], "x", SCALARS)
    stats = normalize.speaker_stats(fit)
    z = normalize.znorm(long, stats)
    cuts = normalize.quantile_cuts(fit) if boundary_space == "raw" else normalize.quantile_cuts(normalize.znorm(fit, stats), "z")
    binned = normalize.discretize(z, cuts)
    per = binned.groupBy("utterance_id").agg(F.collect_list(F.struct("feature", "value", "bin")).alias("x"))  # one entry a scalar
    as_map = lambda c: F.map_from_arrays(F.transform("x", lambda e: e["feature"]), F.transform("x", lambda e: e[c]))
    return per.select("utterance_id", P.feature_text(F.col("utterance_id"), as_map("value"), as_map("bin")).alias("features"))


def _evidence(df: DataFrame, generator: Generator, batch: bool) -> DataFrame:
    """Adds ``evidence``: parsed evidence of all dimensions, by one call each or one call for all."""
    if batch:
        asked = df.select("utterance_id", P.batch_prompt(F.col("transcript"), F.col("context_turns"), F.col("features")).alias("prompt"))
        got = generate(asked, "utterance_id", "prompt", generator).select(F.col("id").alias("utterance_id"), P.parsed_batch(F.col("response"), C.unfenced(F.col("response"))).alias("evidence"))
        return df.join(got, "utterance_id")
    rubric = F.array(*(F.struct(*(F.lit(getattr(d, n)).alias(n) for n in ("name", "title", "definition", "task"))) for d in DIMENSIONS))
    each = df.select("utterance_id", "transcript", "context_turns", "features", F.posexplode(rubric).alias("i", "d"))
    prompt = P.evidence_prompt(F.col("d.title"), F.col("d.definition"), F.col("d.task"), F.col("features"), F.col("transcript"), F.col("context_turns"))
    asked = each.select(F.concat_ws("\x1f", F.col("i").cast("string"), "utterance_id").alias("call"), prompt.alias("prompt"))
    got = generate(asked, "call", "prompt", generator)
    parsed = P.parsed_evidence(F.col("response"), C.unfenced(F.col("response")))
    names = F.array(*(F.lit(n) for n in NAMES))
    one = got.select(F.substring_index("id", "\x1f", 1).cast("int").alias("i"), F.expr("substring(id, instr(id, '\x1f') + 1)").alias("utterance_id"), parsed.alias("p"))
    entry = F.struct("i", F.element_at(names, F.col("i") + 1).alias("dimension"), *(F.col(f"p.{n}").alias(n) for n in P.EVIDENCE_FIELDS))
    per = one.groupBy("utterance_id").agg(F.array_sort(F.collect_list(entry)).alias("evidence"))
    return df.join(per, "utterance_id")


def synthesize(df: DataFrame, generator: Generator = mock, batch: bool = False, attempts: int = 3, tolerance: float = 0.5, verify: bool = True) -> DataFrame:
    """Training rows of samples ``(utterance_id, audio_path, transcript, context_turns, features, oracle)``.

    Evidence is generated and parsed, then a judgment towards the ``oracle`` score struct.
    A judgment off by more than the tolerance is asked for again, only for the samples it
    is off for, at most ``attempts`` times; the last one then gets the oracle scores.
    ``is_fallback`` marks responses without a score section, ``forced`` forced scores.
    """
    held = cut(_evidence(df, generator, batch))
    log = P.evidence_text(F.col("utterance_id"), F.col("transcript"), F.col("context_turns"), F.col("features"), F.col("evidence"))
    open_ = held.withColumn("log", log).withColumn("prompt", P.judgment_prompt(F.col("log"), F.col("oracle")))
    done = None
    for attempt in range(attempts):
        # the attempt is part of what a generator sees, so that a deterministic one can vary
        got = generate(open_.select("utterance_id", F.concat("prompt", F.lit(" " * attempt)).alias("prompt")), "utterance_id", "prompt", generator)
        got, found = C.with_scores(got.select(F.col("id").alias("utterance_id"), "response"), "response")
        scored = F.instr("response", "[SCORES]") > 0
        own = F.struct(*(F.coalesce(c, F.lit(NEUTRAL)).alias(n) for n, c in found.items()))
        reasoning = F.when(F.instr("response", "[REASONING]") > 0, C.sections(F.col("response"))["reasoning"]).otherwise(C.strip(F.substring_index("response", "[SCORES]", 1)))
        judged = got.select("utterance_id", reasoning.alias("reasoning"), F.when(scored, own).alias("own"), (~scored).alias("is_fallback"))
        tried = open_.join(judged, "utterance_id").withColumn("scores", F.coalesce("own", "oracle")).drop("own").withColumn("attempt", F.lit(attempt + 1))
        tried = cut(tried.withColumn("m", scoring.score_match("scores", "oracle", tolerance)))
        fine = F.col("m.max_deviation") <= tolerance if verify else F.lit(True)
        last = attempt == attempts - 1
        kept = tried.where(fine | F.lit(last)).withColumn("forced", ~fine)
        done = kept if done is None else done.union(kept)
        if last or not verify:
            break
        open_ = tried.where(~fine).drop("reasoning", "scores", "is_fallback", "attempt", "m")
        if open_.isEmpty():
            break
    final = done.withColumn("scores", F.when(F.col("forced"), F.col("oracle")).otherwise(F.col("scores")))
    output = P.target_output(F.col("log"), F.col("reasoning"), F.col("scores"))
    return final.select(
        "utterance_id", "audio_path", "transcript", "context_turns", output.alias("target_output"), "scores", F.col("oracle").alias("oracle_scores"), "reasoning",
        F.col("m.n_matched").alias("n_matched"), "attempt", "forced", "is_fallback",
    )


def synthesis_stats(rows: DataFrame, tolerance: float = 0.5) -> DataFrame:
    """One row: counts, match rate with the oracle, share of forced and fallback rows, and a struct of score statistics."""
    m = rows.withColumn("m", scoring.score_match("scores", "oracle_scores", tolerance))
    per = [F.struct(F.avg(f"scores.{n}").alias("mean"), F.stddev_pop(f"scores.{n}").alias("std"), F.min(f"scores.{n}").alias("min"), F.max(f"scores.{n}").alias("max")).alias(n) for n in NAMES]
    share = lambda c: F.avg(F.col(c).cast("double"))
    return m.agg(F.count("*").alias("n_samples"), F.avg(F.col("m.n_matched") / len(NAMES)).alias("oracle_match_rate"), share("forced").alias("forced_rate"), share("is_fallback").alias("fallback_rate"), F.struct(*per).alias("score_statistics"))


def write_synthesis(rows: DataFrame, folder: str) -> None:
    """Full rows, training rows and statistics as JSON lines under ``folder``."""
    write_jsonl(rows, f"{folder}/cot_training_data.jsonl")
    write_jsonl(rows.select("utterance_id", "audio_path", "transcript", "context_turns", "target_output", "scores", "oracle_scores"), f"{folder}/sft_training_data.jsonl")
    write_jsonl(synthesis_stats(rows), f"{folder}/synthesis_stats.json")
