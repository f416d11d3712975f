"""Training examples: chat format, exact-size seeded split, summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timbrel.functions.prompts import messages


def examples(df: DataFrame, audio_dir: str | None = None) -> DataFrame:
    """``(utterance_id, messages, audios, scores)`` of rows with a target; relative audio paths are put under ``audio_dir``."""
    path = F.coalesce("audio_path", F.lit(""))
    if audio_dir:
        path = F.when((path != "") & ~path.startswith("/"), F.concat(F.lit(audio_dir.rstrip("/") + "/"), path)).otherwise(path)
    return df.where("target_output <> ''").select(
        *(c for c in df.columns if c not in ("messages", "audios")),
        messages(F.col("transcript"), F.col("context_turns"), F.col("target_output")).alias("messages"),
        F.when(path != "", F.array(path)).otherwise(F.array().cast("array<string>")).alias("audios"),
    )


#: Rows among which the last place of a split is found by sorting them.
MAX_SORTED = 100_000


def with_split(df: DataFrame, key: str, ratio: float, seed: int, max_sorted: int = MAX_SORTED) -> DataFrame:
    """Adds ``is_val``: exactly ``floor(n * ratio)`` rows, the lowest by seeded hash of ``key``; none of 10 rows or fewer.

    The cut-off comes from histograms of the hash, twelve bits at a time, until few rows are left in
    doubt; only these are sorted. Rows of one key share a hash, so more of them than that are sorted too.
    """
    n = df.count()
    take = int(n * ratio) if ratio > 0 and n > 10 else 0
    if not take:
        return df.withColumn("is_val", F.lit(False))
    h = F.xxhash64(F.lit(seed), key)
    digit = lambda level: F.shiftrightunsigned(h, 52 - 12 * level).bitwiseAND(F.lit(4095)).cast("int")
    level, rest, below, open_ = 0, F.lit(True), F.lit(False), take
    while True:
        counts = df.where(rest).groupBy(digit(level).alias("d")).count().orderBy("d").collect()  # at most 4096 rows
        upto = 0
        for r in counts:
            if upto + r["count"] >= open_:
                break
            upto += r["count"]
        below, rest, open_ = below | rest & (digit(level) < r.d), rest & (digit(level) == r.d), open_ - upto
        level += 1
        if r["count"] <= max_sorted or level == 5:
            break
    ranked = df.where(rest).selectExpr("*", f"row_number() over (order by xxhash64({seed}, {key}), {key}) as _r")
    return df.where(~rest).withColumn("is_val", below).unionByName(ranked.withColumn("is_val", F.col("_r") <= open_).drop("_r"))


def summary(df: DataFrame) -> DataFrame:
    """Counts and answer lengths of training examples; "with context" looks for the word in the request, as a request with context has it."""
    ask, answer = F.col("messages")[1]["content"], F.length(F.col("messages")[2]["content"])
    return df.agg(
        F.count("*").alias("n"), F.count_if(F.size("audios") > 0).alias("with_audio"), F.count_if(F.lower(ask).contains("context")).alias("with_context"),
        F.round(F.avg(answer), 6).alias("mean_length"), F.max(answer).cast("long").alias("max_length"), F.min(answer).cast("long").alias("min_length"),
    )


def label_mask(df: DataFrame, prompt_ids: str, answer_ids: str, batch: str, max_length: int, pad_id: int = 0, ignore: int = -100) -> DataFrame:
    """Adds ``input_ids``, ``attention_mask`` and ``labels`` of token id arrays, padded at the end to the longest row of a ``batch``.

    Labels of the prompt and of padding are ``ignore``, those of the answer its ids. Rows are cut at
    ``max_length``. Null arrays are empty.
    """
    none = F.array().cast("array<int>")
    prompt, answer = F.coalesce(F.col(prompt_ids).cast("array<int>"), none), F.coalesce(F.col(answer_ids).cast("array<int>"), none)
    whole = df.withColumns({
        "_ids": F.slice(F.concat(prompt, answer), 1, max_length), "_labels": F.slice(F.concat(F.transform(prompt, lambda _: F.lit(ignore)), answer), 1, max_length),
    }).withColumn("_n", F.size("_ids"))
    longest = whole.groupBy(batch).agg(F.max("_n").alias("_longest"))
    padded = whole.join(longest, whole[batch].eqNullSafe(longest[batch]), "left").drop(longest[batch])
    fill = lambda x, v: F.concat(x, F.array_repeat(F.lit(v), F.col("_longest") - F.col("_n")))
    return padded.withColumns({
        "input_ids": fill(F.col("_ids"), pad_id), "attention_mask": fill(F.transform("_ids", lambda _: F.lit(1)), 0), "labels": fill(F.col("_labels"), ignore)
    }).drop("_ids", "_labels", "_n", "_longest")
