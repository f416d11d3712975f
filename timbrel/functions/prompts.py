"""Prompt and response texts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from timbrel.functions.columns import indented, numbered
from timbrel.rubric import DIMENSIONS, NAMES, NEUTRAL, TITLES

#: Wording of the training and inference prompts.
SYSTEM = (
    "You are an expert speech emotion evaluator. Given a speech utterance, analyze its emotional expressivity by examining acoustic features, "
    "then provide a detailed chain-of-thought assessment and scores across 7 emotion dimensions on a 1-5 scale."
)
ASK = "<|audio|>\nEvaluate the emotional expressivity of this speech utterance.\n"
CONTEXT = "Conversational context (preceding turns):\n"
PROVIDE = (
    "Provide:\n1. [EVIDENCE] - Acoustic feature analysis per dimension\n"
    "2. [REASONING] - Chain-of-thought connecting evidence to scores\n3. [SCORES] - Ratings for all 7 emotion dimensions (1-5)"
)
#: Wording of the synthesis prompts.
STRUCTURE = (
    "Provide your analysis in the following structure:\n1. Inferred emotional context from transcript and preceding turns\n"
    "2. Detected emotional cues from acoustic features (cite specific values)\n3. {title} assessment with supporting evidence\n"
    "4. Strengths of the emotional delivery for this dimension\n5. Issues or areas of concern\n"
)
JUDGE = "You are synthesizing a global emotional quality judgment from detailed evidence.\n\n"
JUDGE_TASK = (
    "Task: Synthesize a coherent chain-of-thought assessment that:\n1. Connects acoustic evidence to emotion scores across all 7 dimensions\n"
    "2. Identifies cross-dimensional patterns (e.g., high intensity but poor appropriateness)\n3. Weighs dimension importance for this specific context\n"
    "4. Produces final scores for each dimension with clear justification\n\nFormat your response as:\n[REASONING]\n<your chain-of-thought analysis>\n[SCORES]\n"
)
TARGETS = "\nTarget scores (your reasoning must arrive at these naturally):\n"
BATCH = "Analyze the emotional expressivity of this utterance across all evaluation dimensions.\n\n"
EVIDENCE_FIELDS = ("emotional_context", "detected_cues", "alignment_assessment", "strengths", "issues")
EVIDENCE_TITLES = ("Emotional Context", "Detected Cues", "Alignment Assessment", "Strengths", "Issues")


def rubric_description(names: tuple[str, ...] = NAMES) -> str:
    """The rubric as prompt text; a constant, so it is built once."""
    out = ["=== Emotion Evaluation Rubric ===", "Rate each dimension on a 1-5 Likert scale.", ""]
    for d in DIMENSIONS:
        if d.name in names:
            scale = [f"  {i} ({label}): {text}" for i, (label, text) in enumerate(d.anchors, 1)]
            out += [f"### {d.title}", f"Definition: {d.definition}", "Scale:", *scale, ""]
    return "\n".join(out)


def _text(c) -> Column:
    return F.coalesce(F.lit(c) if isinstance(c, str) else c, F.lit(""))


def join(*parts) -> Column:
    """Concatenation of columns and literal texts; null columns count as empty."""
    return F.concat(*map(_text, parts))


def _block(turns: Column, head: str, body: Column, tail: str) -> Column:
    return F.when(F.size(F.coalesce(turns, F.array().cast("array<string>"))) > 0, join(head, body, tail)).otherwise(F.lit(""))


def user_prompt(transcript: Column, turns: Column) -> Column:
    """The request of a training or inference example."""
    return join(ASK, _block(turns, CONTEXT, indented(turns), "\n\n"), 'Transcript: "', transcript, '"\n\n', PROVIDE)


def inference_prompt(transcript: Column, turns: Column) -> Column:
    """The request with plain role marks, for models without a chat template."""
    return join(f"<|system|>\n{SYSTEM}\n<|user|>\n", user_prompt(transcript, turns), "\n<|assistant|>\n")


def evidence_prompt(title: Column, definition: Column, task: Column, features: Column, transcript: Column, turns: Column) -> Column:
    """The request for evidence on one dimension of the rubric."""
    first, last = STRUCTURE.split("{title}")
    return join(
        "You are evaluating the ", title, " of a speech utterance.\n\nDefinition: ", definition, "\n",
        _block(turns, "\nConversational Context (preceding turns):\n", numbered(turns), "\n"),
        '\nTranscript: "', transcript, '"\n\n', features, "\n\nTask: ", task, "\n\n", first, title, last,
    )


def judgment_prompt(evidence: Column, oracle: Column | None = None) -> Column:
    """The request for a judgment; with target scores if a score struct is given."""
    targets = F.lit("")
    if oracle is not None:
        lines = F.concat_ws("\n", *(join(f"  {n}: ", oracle[n].cast("string")) for n in NAMES))
        targets = F.when(oracle.isNotNull(), join(TARGETS, lines, "\n")).otherwise(F.lit(""))
    scores = "".join(f"{n}: <score>\n" for n in NAMES)
    return join(JUDGE, rubric_description(), "\n\n=== Evidence Log ===\n", evidence, "\n", targets, "\n", JUDGE_TASK, scores)


def batch_prompt(transcript: Column, turns: Column, features: Column) -> Column:
    """The request for evidence on all dimensions at once, as JSON."""
    shape = "{\n  \"dimension_name\": {\n" + ",\n".join(f'    "{n}": "..."' for n in EVIDENCE_FIELDS) + "\n  },\n  ...\n}"
    return join(
        BATCH, 'Transcript: "', transcript, '"\n', _block(turns, "\nConversational Context:\n", indented(turns), "\n"), "\n", features, "\n\n", rubric_description(),
        "\n\nFor EACH dimension, provide analysis in this JSON format:\n", shape, "\n\nCover all 7 dimensions. Ground ALL observations in specific acoustic feature values.",
    )


def evidence_text(utterance: Column, transcript: Column, turns: Column, features: Column, evidence: Column) -> Column:
    """The evidence log; ``evidence`` is an array of structs of the dimension and the evidence fields."""
    named = F.create_map(*(F.lit(x) for kv in TITLES.items() for x in kv))
    part = F.transform(
        evidence, lambda e: join("\n## ", F.coalesce(named[e["dimension"]], e["dimension"]), *(x for t, f in zip(EVIDENCE_TITLES, EVIDENCE_FIELDS) for x in (f"\n{t}: ", e[f])))
    )
    context = _block(turns, "\n\nConversational Context:\n", indented(turns), "")
    parts = F.when(F.size(evidence) > 0, join("\n", F.array_join(part, "\n"))).otherwise(F.lit(""))
    return join("=== Evidence Log for Utterance: ", utterance, ' ===\nTranscript: "', transcript, '"', context, "\n\n", features, "\n\n--- Dimension-Level Evidence ---", parts)


def target_output(evidence: Column, reasoning: Column, scores: Column) -> Column:
    """The sectioned answer a model is trained on."""
    lines = F.concat_ws("\n", *(join(f"{n}: ", F.coalesce(scores[n], F.lit(NEUTRAL)).cast("string")) for n in NAMES))
    return join("[EVIDENCE]\n", evidence, "\n\n[REASONING]\n", reasoning, "\n\n[SCORES]\n", lines)


def messages(transcript: Column, turns: Column, answer: Column) -> Column:
    """The three chat messages of a training example."""
    pair = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(pair("system", F.lit(SYSTEM)), pair("user", user_prompt(transcript, turns)), pair("assistant", answer))


def collated(chat: Column) -> Column:
    """All messages as one text with role marks."""
    return F.array_join(F.transform(chat, lambda m: join("<|", m["role"], "|>\n", m["content"])), "\n")


def parsed_evidence(response: Column, unfenced: Column) -> Column:
    """The evidence fields of a JSON response; its first 500 characters as context if it is no JSON object."""
    kind = "struct<" + ",".join(f"{n}:string" for n in EVIDENCE_FIELDS) + ",_bad:string>"
    data = F.from_json(unfenced, kind, {"columnNameOfCorruptRecord": "_bad"})
    broken = data.isNull() | data["_bad"].isNotNull()
    return F.struct(
        *(F.when(broken, F.coalesce(response.substr(1, 500), F.lit("")) if i == 0 else F.lit("")).otherwise(F.coalesce(data[n], F.lit(""))).alias(n) for i, n in enumerate(EVIDENCE_FIELDS)),
        broken.alias("is_fallback"),
    )


def parsed_batch(response: Column, unfenced: Column) -> Column:
    """Evidence of all dimensions out of one JSON response, by name or title; blank where missing, a note where unreadable."""
    one = "struct<" + ",".join(f"{n}:string" for n in EVIDENCE_FIELDS) + ">"
    data = F.from_json(unfenced, f"map<string,{one}>")
    note = F.lit("Parse error - see raw response")

    def of(d):
        own = F.coalesce(data[d.name], data[d.title])
        return F.struct(F.lit(d.name).alias("dimension"), *(F.when(data.isNull(), note if i == 0 else F.lit("")).otherwise(F.coalesce(own[n], F.lit(""))).alias(n) for i, n in enumerate(EVIDENCE_FIELDS)))

    return F.array(*map(of, DIMENSIONS))


#: Lines of the feature text: section, label, scalar, text before the value, decimals, factor, text after it.
FEATURE_LINES = [
    ("## Prosodic Features (vowel-level)", "Pitch level", "pitch_level_mean", "mean=", 1, 1, " Hz"),
    ("", "Pitch variation", "pitch_variation_mean", "std=", 1, 1, " Hz"),
    ("", "Pitch slope", "pitch_slope_mean", "mean=", 1, 1, " Hz/s"),
    ("", "Intensity level", "intensity_level_mean", "mean=", 1, 1, " dB"),
    ("", "Intensity variation", "intensity_variation_mean", "std=", 1, 1, " dB"),
    ("", "Vowel durations", "duration_mean", "mean=", 1, 1000, " ms"),
    ("## Voice Quality Features", "Jitter", "jitter", "", 2, 1, "%"),
    ("", "Shimmer", "shimmer", "", 2, 1, "%"),
    ("", "HNR", "hnr", "", 1, 1, " dB"),
    ("", "Spectral tilt", "spectral_tilt", "", 2, 1, " dB/oct"),
    ("## Temporal Features", "Speech rate", "speech_rate", "", 1, 1, " syl/s"),
    ("", "Speech rate variation", "speech_rate_variation", "", 2, 1, ""),
    ("", "Mean pause duration", "pause_duration_mean", "", 0, 1000, " ms"),
    ("", "Pause frequency", "pause_frequency", "", 2, 1, "/s"),
    ("## Formant Features", "F1 mean", "f1_mean", "", 0, 1, " Hz"),
    ("", "F2 mean", "f2_mean", "", 0, 1, " Hz"),
    ("", "Vowel space area", "vowel_space_area", "", 0, 1, " Hz²"),
]


def feature_text(utterance: Column, values: Column, bins: Column) -> Column:
    """The feature block of a prompt from two maps by scalar name: values, and bin labels (``N/A`` if missing)."""
    parts = ["=== Acoustic Features for Utterance: ", utterance, " ===\n"]
    for head, label, name, before, places, factor, after in FEATURE_LINES:
        if head:
            parts.append(f"\n{head}")
        shown = F.format_string(f"%.{places}f", F.bround(values[name] * factor, places))
        parts += [f"\n  {label}: ", F.coalesce(bins[name], F.lit("N/A")), f" ({before}", shown, f"{after})"]
        if name in ("duration_mean", "spectral_tilt", "pause_frequency"):
            parts.append("\n")
    return join(*parts)
