"""Queries over scores, responses, prompts and repeated samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from timbrel.functions import columns as C
from timbrel.functions import prompts as P
from timbrel.operators import generator, samples, scoring, sft
from timbrel.plans.corpus import ES, VA
from timbrel.rubric import DIMENSIONS, NAMES, TITLES
from timbrel.session import table
from timbrel.sources.jsonl import SCORES

_FEATURES = "=== Acoustic Features ==="


def _cot(spark, sf_dir):
    return table(spark, sf_dir, "cot_samples")


def _labelled(spark, sf_dir):
    """Samples with the mean of their on-scale ratings, brought to 1 to 5."""
    s = samples.canonical(table(spark, sf_dir, "emotion_samples")).select("sample_id", "utterance_id", F.col("dataset_name").alias("dataset"), "categorical_emotion", "emotion_intensity", F.coalesce(F.size("context_turns"), F.lit(0)).alias("n_context")).distinct()
    top = F.when(F.col("dataset_name") == "msp_podcast", 7.0).otherwise(5.0)
    a = samples.canonical(table(spark, sf_dir, "vad_annotations")).where(F.col("valence").between(1.0, top) & F.col("arousal").between(1.0, top))
    fit = lambda c: 1 + (F.col(c) - 1) * 4 / (top - 1)
    per = a.groupBy("utterance_id").agg(F.round(F.avg(fit("valence")), 6).alias("v"), F.round(F.avg(fit("arousal")), 6).alias("a"))
    return s.join(per, "utterance_id", "left")


def oracle_scores(spark, sf_dir):
    x = _labelled(spark, sf_dir)
    cols = scoring.oracle_scores(F.col("v"), F.col("a"), F.col("dataset"), F.col("categorical_emotion"), F.col("emotion_intensity"), F.col("n_context") > 0)
    return x.select("sample_id", *(c.alias(n) for n, c in cols.items()))


def parse_scores(spark, sf_dir):
    """Scores of every response, 3 where there is none, and how many were found."""
    df, found = C.with_scores(_cot(spark, sf_dir), "target_output")
    held = sum((F.when(c.isNotNull(), 1).otherwise(0) for c in found.values()), F.lit(0))
    return df.select("cot_id", *(F.coalesce(c, F.lit(3.0)).alias(n) for n, c in found.items()), held.cast("long").alias("n_dims_parsed"))


def extract_sections(spark, sf_dir):
    s = C.sections(F.coalesce("target_output", F.lit("")))
    return _cot(spark, sf_dir).select("cot_id", s["evidence"].alias("evidence"), s["reasoning"].alias("reasoning"))


def judgment_parse(spark, sf_dir):
    """Reasoning and scores of a response; without any section all of it is reasoning and scores are the target's."""
    t = F.coalesce("target_output", F.lit(""))
    df, found = C.with_scores(_cot(spark, sf_dir), "target_output")
    o = F.col("oracle_scores")
    scored = F.instr(t, "[SCORES]") > 0
    reasoning = F.when(F.instr(t, "[REASONING]") > 0, C.sections(t)["reasoning"]).when(scored, C.strip(F.substring_index(t, "[SCORES]", 1))).otherwise(C.strip(t))
    value = lambda n: F.when(scored, F.coalesce(found[n], F.lit(3.0))).otherwise(F.coalesce(o[n], F.lit(3.0)))
    return df.select("cot_id", reasoning.alias("reasoning"), *(value(n).alias(n) for n in NAMES), (~scored).alias("is_fallback"))


def _fenced(spark, sf_dir):
    """Evidence responses as a model gives them: JSON in code fences, some of it broken."""
    text = F.regexp_replace(F.coalesce("reasoning", F.lit("")), r'["\\\n\t​]', " ")
    body = F.concat(F.lit('{"detected_cues": "'), text, F.lit('", "strengths": "ok"'), F.when(F.col("cot_id") % 7 == 0, "").otherwise("}"))
    return _cot(spark, sf_dir).select("cot_id", F.concat(F.lit("```json\n"), body, F.lit("\n```")).alias("response"))


def fence_json(spark, sf_dir):
    e = P.parsed_evidence(F.col("response"), C.unfenced(F.col("response")))
    return _fenced(spark, sf_dir).select("cot_id", e.alias("e")).select("cot_id", "e.emotional_context", "e.detected_cues", "e.strengths", "e.is_fallback")


def batch_evidence(spark, sf_dir):
    """Evidence of all dimensions out of one JSON response by name or title, blank where missing."""
    text = F.regexp_replace(F.coalesce("reasoning", F.lit("")), r'["\\\n\t​]', " ")
    body = F.concat(F.lit('{"emotional_intensity": {"issues": "'), text, F.lit('"}, "Valence Accuracy": {"strengths": "clear"}'), F.when(F.col("cot_id") % 5 == 0, "").otherwise("}"))
    x = _cot(spark, sf_dir).select("cot_id", F.explode(P.parsed_batch(body, C.unfenced(body))).alias("e"))
    return x.select("cot_id", "e.dimension", "e.emotional_context", "e.strengths", "e.issues")


def score_match(spark, sf_dir):
    c = _cot(spark, sf_dir).where("oracle_scores is not null and scores is not null")
    m = c.select("cot_id", scoring.score_match("scores", "oracle_scores").alias("m"))
    return m.select("cot_id", F.col("m.n_matched").cast("long").alias("n_matched"), F.col("m.n_total").cast("long").alias("n_total"), F.round("m.max_deviation", 6).alias("max_deviation"))


def verify_attempts(spark, sf_dir):
    """Lines of an order stand for attempts, with the discount as deviation."""
    li = table(spark, sf_dir, "lineitem")
    a = li.groupBy("l_orderkey", "l_linenumber").agg(F.min(F.col("l_discount") * 10).alias("dev"))
    return scoring.verified_attempts(a, "l_orderkey", "l_linenumber", "dev", 0.25)


def forced_rate(spark, sf_dir):
    """Share of keys whose target had to be forced, which a match rate alone would hide."""
    v = verify_attempts(spark, sf_dir)
    return v.agg(F.count("*").alias("n"), F.count_if("forced").alias("n_forced"), F.round(F.avg(F.col("forced").cast("double")), 6).alias("forced_rate"))


def score_stats(spark, sf_dir):
    s = scoring.score_stats(_cot(spark, sf_dir).where("scores is not null"), "scores")
    return s.select("dimension", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "min", "max")


def oracle_match_rate(spark, sf_dir):
    c = _cot(spark, sf_dir).where("oracle_scores is not null and scores is not null")
    m = c.select(scoring.score_match("scores", "oracle_scores").alias("m"))
    return m.agg(F.count("*").alias("n"), F.round(F.avg(F.col("m.n_matched") / 7), 6).alias("match_rate"))


def score_validation(spark, sf_dir):
    v = scoring.valid_scores(_cot(spark, sf_dir), "scores")
    return v.groupBy(F.array_join("invalid", ",").alias("invalid")).agg(F.count("*").alias("n"))


def mean_score(spark, sf_dir):
    total = sum((F.col("scores")[n] for n in NAMES[1:]), F.col("scores")[NAMES[0]])
    return _cot(spark, sf_dir).where("scores is not null").select("cot_id", F.round(total / 7, 6).alias("mean_score"))


def _lines(spark, sf_dir):
    """Order lines as repeated samples of three half-step scores."""
    li = table(spark, sf_dir, "lineitem")
    half = lambda c: 1 + F.floor(c) % 9 / 2
    k = F.struct("l_linenumber", "l_partkey", "l_suppkey")
    return li.select("l_orderkey", k.alias("k"), half(F.col("l_quantity")).alias("s1"), half(F.col("l_partkey").cast("double")).alias("s2"), half(F.col("l_suppkey").cast("double")).alias("s3"))


_S = ("s1", "s2", "s3")


def aggregate_mean(spark, sf_dir):
    a = scoring.aggregate_scores(_lines(spark, sf_dir), "l_orderkey", _S)
    return a.select("l_orderkey", *_S, "n_annotators")


def aggregate_median(spark, sf_dir):
    return scoring.aggregate_scores(_lines(spark, sf_dir), "l_orderkey", _S, "median")


def agreement(spark, sf_dir):
    a = scoring.agreement(_lines(spark, sf_dir), "l_orderkey", _S)
    return a.select("l_orderkey", *(F.round(n, 6).alias(n) for n in _S))


def k_average(spark, sf_dir):
    """Means and spreads of every order, whatever its number of lines."""
    a = scoring.k_average(_lines(spark, sf_dir), "l_orderkey", _S)
    return a.select("l_orderkey", *_S, *(f"{n}_std" for n in _S), "k_samples")


def k_best(spark, sf_dir):
    """The line of every order that is nearest to the order's means."""
    b = scoring.k_best(_lines(spark, sf_dir), "l_orderkey", "k", _S)
    return b.select("l_orderkey", F.col("best.l_linenumber").alias("line"), F.col("best.l_partkey").alias("part"))


def rubric_table(spark, sf_dir):
    rows = [(d.name, d.title, i, label, text) for d in DIMENSIONS for i, (label, text) in enumerate(d.anchors, 1)]
    return spark.createDataFrame(rows, "dimension string, title string, score long, label string, description string")


def evidence_prompt(spark, sf_dir):
    """A request for evidence per sample and dimension; the seven rows of the rubric are unfolded in place, without a join."""
    s = table(spark, sf_dir, "emotion_samples").select("sample_id", "transcript", "context_turns").distinct()
    rubric = F.array(*(F.struct(F.lit(d.name).alias("name"), F.lit(d.title).alias("title"), F.lit(d.definition).alias("definition"), F.lit(d.task).alias("task")) for d in DIMENSIONS))
    s = s.withColumn("d", F.explode(rubric))
    text = P.evidence_prompt(F.col("d.title"), F.col("d.definition"), F.col("d.task"), F.lit(_FEATURES), F.col("transcript"), F.col("context_turns"))
    return s.select("sample_id", F.col("d.name").alias("dimension"), F.md5(text).alias("prompt_md5"), F.length(text).cast("long").alias("n_chars"))


def judgment_prompt(spark, sf_dir):
    text = P.judgment_prompt(F.col("reasoning"), F.col("oracle_scores"))
    return _cot(spark, sf_dir).select("cot_id", F.md5(text).alias("prompt_md5"), F.length(text).cast("long").alias("n_chars"))


def batch_prompt(spark, sf_dir):
    text = P.batch_prompt(F.col("transcript"), F.col("context_turns"), F.lit(_FEATURES))
    return _cot(spark, sf_dir).select("cot_id", F.md5(text).alias("prompt_md5"), F.length(text).cast("long").alias("n_chars"))


def evidence_text(spark, sf_dir):
    one = F.array(F.struct(F.lit("valence_accuracy").alias("dimension"), *(F.lit(n).alias(n) for n in P.EVIDENCE_FIELDS)))
    text = P.evidence_text(F.col("utterance_id"), F.col("transcript"), F.col("context_turns"), F.lit(_FEATURES), one)
    return _cot(spark, sf_dir).select("cot_id", text.alias("evidence"))


def target_output(spark, sf_dir):
    s = C.sections(F.coalesce("target_output", F.lit("")))
    return _cot(spark, sf_dir).where("scores is not null").select("cot_id", P.target_output(s["evidence"], F.col("reasoning"), F.col("scores")).alias("output"))


def sft_messages(spark, sf_dir):
    e = sft.examples(_cot(spark, sf_dir), "/data")
    return e.select("cot_id", F.md5(F.col("messages")[1]["content"]).alias("ask_md5"), F.col("messages")[2]["content"].alias("answer"), F.array_join("audios", ",").alias("audios"))


def inference_prompt(spark, sf_dir):
    return _cot(spark, sf_dir).select("cot_id", F.md5(P.inference_prompt(F.col("transcript"), F.col("context_turns"))).alias("prompt_md5"))


def collated_chat(spark, sf_dir):
    e = sft.examples(_cot(spark, sf_dir))
    return e.select("cot_id", F.md5(P.collated(F.col("messages"))).alias("chat_md5"))


def json_round_trip(spark, sf_dir):
    """Score structs to JSON and back."""
    c = _cot(spark, sf_dir).where("scores is not null")
    back = F.from_json(F.to_json("scores"), SCORES)
    return c.select("cot_id", *(back[n].alias(n) for n in NAMES))


def mock_k_samples(spark, sf_dir):
    """Four stand-in responses a prompt, parsed, averaged, and the best of them."""
    asked = _cot(spark, sf_dir).where("cot_id is not null and prompt is not null").dropDuplicates(["cot_id"])
    r = generator.generate(asked, "cot_id", "prompt", k=4)
    r, found = C.with_scores(r, "response")
    scored = r.select("id", "k", *(F.coalesce(c, F.lit(3.0)).alias(n) for n, c in found.items()))
    best = scoring.k_best(scored, "id", "k", NAMES)
    return scoring.k_average(scored, "id", NAMES).join(best, "id")


_F = (
    oracle_scores, parse_scores, extract_sections, judgment_parse, fence_json, batch_evidence, score_match, verify_attempts, forced_rate, score_stats, oracle_match_rate, score_validation,
    mean_score, aggregate_mean, aggregate_median, agreement, k_average, k_best, rubric_table, evidence_prompt, judgment_prompt, batch_prompt, evidence_text, target_output, sft_messages,
    inference_prompt, collated_chat, json_round_trip, mock_k_samples,
)
QUERIES = {f.__name__: f for f in _F}


def _q(text: str) -> str:
    """A SQL literal; line breaks as they are."""
    return "'" + text.replace("'", "''") + "'"


_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


def _strip(x: str) -> str:
    return _STRIP.format(x)


_LINES = f"""with l as (select cot_id, target_output, oracle_scores, list_transform(string_split(target_output, chr(10)), lambda x: {_strip('x')}) as l from cot_samples),
t as (select *, case when list_position(l, '[SCORES]') > 0 then l[list_position(l, '[SCORES]') + 1:] else [] end as s from l),
p as (select *, list_filter(list_transform(s, lambda x: {{'k': {_strip("split_part(x, ':', 1)")}, 'v': {_strip("substr(x, strpos(x, ':') + 1)")}}}), lambda y: regexp_matches(y.v, '{_NUMBER}')) as kv from t)
"""


def _score(n: str) -> str:
    return f"least(5.0, greatest(1.0, try_cast(list_filter(kv, lambda z: z.k = '{n}')[-1].v as double)))"


def _section(t: str, start: str, end: str) -> str:
    rest = f"substr({t}, strpos({t}, '{start}') + {len(start)})"
    return f"case when strpos({t}, '{start}') = 0 then '' else {_strip(f'split_part({rest}, {_q(end)}, 1)')} end"


_T = "coalesce(target_output, '')"
_HALF = "1 + (floor({0})::bigint % 9) / 2"
_K = f"""with x as (select l_orderkey, {{'a': l_linenumber, 'b': l_partkey, 'c': l_suppkey}} as k, 1 + floor(l_quantity)::bigint % 9 / 2.0::double as s1, 1 + l_partkey % 9 / 2.0::double as s2, 1 + l_suppkey % 9 / 2.0::double as s3 from lineitem)
"""
_CTX = "case when len(context_turns) > 0 then {0} || array_to_string(list_transform(context_turns, lambda x: '  ' || x), chr(10)) || {1} else '' end"
_ASK = f"{_q(P.ASK)} || {_CTX.format(_q(P.CONTEXT), 'chr(10) || chr(10)')} || 'Transcript: \"' || coalesce(transcript, '') || '\"' || chr(10) || chr(10) || {_q(P.PROVIDE)}"
_FIRST, _LAST = P.STRUCTURE.split("{title}")
_NUM_CTX = "case when len(context_turns) > 0 then chr(10) || 'Conversational Context (preceding turns):' || chr(10) || array_to_string(list_transform(range(1, len(context_turns) + 1), lambda i: '  Turn ' || i || ': ' || context_turns[i]), chr(10)) || chr(10) else '' end"
_RUBRIC = "(values " + ", ".join(f"({_q(d.name)}, {_q(d.title)}, {_q(d.definition)}, {_q(d.task)})" for d in DIMENSIONS) + ") d(name, title, definition, task)"
_EVIDENCE = f"""'You are evaluating the ' || title || ' of a speech utterance.' || chr(10) || chr(10) || 'Definition: ' || definition || chr(10) || {_NUM_CTX} || chr(10) || 'Transcript: "' || coalesce(transcript, '') || '"' || chr(10) || chr(10)
  || {_q(_FEATURES)} || chr(10) || chr(10) || 'Task: ' || task || chr(10) || chr(10) || {_q(_FIRST)} || title || {_q(_LAST)}"""
_ORACLE_LINES = " || chr(10) || ".join(f"'  {n}: ' || oracle_scores.{n}" for n in NAMES)
_JUDGE = f"""{_q(P.JUDGE)} || {_q(P.rubric_description())} || chr(10) || chr(10) || '=== Evidence Log ===' || chr(10) || coalesce(reasoning, '') || chr(10)
  || case when oracle_scores is not null then {_q(P.TARGETS)} || {_ORACLE_LINES} || chr(10) else '' end || chr(10) || {_q(P.JUDGE_TASK)} || {_q(''.join(f'{n}: <score>' + chr(10) for n in NAMES))}"""
_SHAPE = "{\n  \"dimension_name\": {\n" + ",\n".join(f'    "{n}": "..."' for n in P.EVIDENCE_FIELDS) + "\n  },\n  ...\n}"
_BATCH = f"""{_q(P.BATCH)} || 'Transcript: "' || coalesce(transcript, '') || '"' || chr(10) || {_CTX.format("chr(10) || 'Conversational Context:' || chr(10)", 'chr(10)')} || chr(10) || {_q(_FEATURES)} || chr(10) || chr(10) || {_q(P.rubric_description())}
  || {_q(chr(10) * 2 + 'For EACH dimension, provide analysis in this JSON format:' + chr(10))} || {_q(_SHAPE)} || {_q(chr(10) * 2 + 'Cover all 7 dimensions. Ground ALL observations in specific acoustic feature values.')}"""
_JSON_TEXT = r"""regexp_replace(coalesce(reasoning, ''), '["\\' || chr(10) || chr(9) || chr(8203) || ']', ' ', 'g')"""
_PART = "".join(f"\n{t}: {f}" for t, f in zip(P.EVIDENCE_TITLES, P.EVIDENCE_FIELDS))
SQL = {
    "oracle_scores": f"""with s as (select distinct sample_id, utterance_id, dataset_name as dataset, categorical_emotion as e, emotion_intensity as i, coalesce(len(context_turns), 0) as n from {ES}),
      r as (select utterance_id, round(avg(1 + (valence - 1) * 4 / (top - 1)), 6) as v, round(avg(1 + (arousal - 1) * 4 / (top - 1)), 6) as a
        from (select *, case when dataset_name = 'msp_podcast' then 7.0::double else 5.0::double end as top from {VA}) where valence between 1 and top and arousal between 1 and top group by 1),
      x as (select s.*, case when v is null then 3 else least(5, greatest(1, v)) end::double as va, case when a is null then 3 else least(5, greatest(1, a)) end::double as aa,
        case when a is null then 3::double else least(5, greatest(1, 2 + abs(a - 3) * 1.5::double)) end as base,
        case when e is not null and dataset = 'ravdess' then 4::double when e is not null and dataset in ('iemocap', 'meld') then 3.5::double else 3::double end as fit, case when n > 0 then 3.5::double else 3::double end as tr
        from s left join r using (utterance_id)),
      y as (select *, case when e is not null and dataset = 'ravdess' and i = 'strong' then least(base + 1, 5) else base end as inten from x),
      z as (select *, least(5, greatest(1, (inten + fit + fit + va + aa + tr) / 6)) as overall from y)
      select sample_id, round_even(inten * 2, 0) / 2 as emotional_intensity, round_even(fit * 2, 0) / 2 as emotional_appropriateness, round_even(fit * 2, 0) / 2 as emotional_consistency,
        round_even(va * 2, 0) / 2 as valence_accuracy, round_even(aa * 2, 0) / 2 as arousal_accuracy, round_even(tr * 2, 0) / 2 as transition_smoothness, round_even(overall * 2, 0) / 2 as overall_emotional_quality from z""",
    "parse_scores": _LINES + "select cot_id, " + ", ".join(f"case when {_score(n)} is null or len(list_filter(kv, lambda z: z.k = '{n}')) = 0 then 3.0 else {_score(n)} end as {n}" for n in NAMES)
    + ", " + " + ".join(f"(len(list_filter(coalesce(kv, []), lambda z: z.k = '{n}')) > 0)::bigint" for n in NAMES) + " as n_dims_parsed from p",
    "extract_sections": f"select cot_id, {_section(_T, '[EVIDENCE]', '[REASONING]')} as evidence, {_section(_T, '[REASONING]', '[SCORES]')} as reasoning from cot_samples",
    "score_match": "with m as (select cot_id, [" + ", ".join(f"abs(coalesce(scores.{n}, 3) - oracle_scores.{n})" for n in NAMES) + """] as d from cot_samples where oracle_scores is not null and scores is not null)
      select cot_id, len(list_filter(d, lambda x: x <= 0.5)) as n_matched, len(list_filter(d, lambda x: x is not null)) as n_total, round(list_max(d), 6) as max_deviation from m""",
    "verify_attempts": """with a as (select l_orderkey, l_linenumber, min(l_discount * 10) as dev from lineitem group by 1, 2)
      select l_orderkey, coalesce(min(l_linenumber) filter (dev <= 0.25), max(l_linenumber)) as attempt, min(l_linenumber) filter (dev <= 0.25) is null as forced from a group by 1""",
    "forced_rate": """with a as (select l_orderkey, min(l_discount * 10) as dev from lineitem group by 1)
      select count(*) as n, count(*) filter (dev > 0.25) as n_forced, round(avg((dev > 0.25)::int::double), 6) as forced_rate from a""",
    "score_stats": " union all ".join(f"select '{n}' as dimension, round(avg(coalesce(scores.{n}, 3)), 6) as mean, round(stddev_pop(coalesce(scores.{n}, 3)), 6) as std, min(coalesce(scores.{n}, 3)) as min, max(coalesce(scores.{n}, 3)) as max from cot_samples where scores is not null" for n in NAMES),
    "oracle_match_rate": "select count(*) as n, round(avg((" + " + ".join(f"(coalesce(abs(coalesce(scores.{n}, 3) - oracle_scores.{n}) <= 0.5, false))::int" for n in NAMES) + ") / 7.0::double), 6) as match_rate from cot_samples where oracle_scores is not null and scores is not null",
    "score_validation": "select array_to_string(list_filter([" + ", ".join(f"case when not coalesce(scores.{n} between 1 and 5, false) then '{n}' end" for n in NAMES) + "], lambda x: x is not null), ',') as invalid, count(*) as n from cot_samples group by 1",
    "mean_score": "select cot_id, round((" + " + ".join(f"scores.{n}" for n in NAMES) + ") / 7, 6) as mean_score from cot_samples where scores is not null",
    "aggregate_mean": _K + "select l_orderkey, " + ", ".join(f"round_even(least(5, greatest(1, avg({n}))), 2) as {n}" for n in _S) + ", count(*) as n_annotators from x group by 1",
    "aggregate_median": _K + "select l_orderkey, " + ", ".join(f"round_even(least(5, greatest(1, median({n}))), 2) as {n}" for n in _S) + ", count(*) as n_annotators from x group by 1",
    "agreement": _K + "select l_orderkey, " + ", ".join(f"round(case when count({n}) < 2 then 1 else 1 - var_pop({n}) / greatest(var_pop({n}) + 1e-8, 1) end, 6) as {n}" for n in _S) + " from x group by 1",
    "k_average": _K + "select l_orderkey, " + ", ".join(f"round_even(avg({n}), 2) as {n}, round_even(stddev_pop({n}), 3) as {n}_std" for n in _S) + ", count(*) as k_samples from x group by 1",
    "k_best": _K + ", m as (select l_orderkey, " + ", ".join(f"round_even(avg({n}), 2) as m_{n}" for n in _S) + ", count(*) as n from x group by 1), d as (select x.l_orderkey, k, round(" + " + ".join(f"pow({n} - m_{n}, 2)" for n in _S)
    + ", 9) as dist from x join m using (l_orderkey)) select l_orderkey, k.a as line, k.b as part from d qualify row_number() over (partition by l_orderkey order by dist, k.a, k.b, k.c) = 1",
    "rubric_table": "select * from (values " + ", ".join(f"({_q(d.name)}, {_q(d.title)}, {i}::bigint, {_q(a)}, {_q(b)})" for d in DIMENSIONS for i, (a, b) in enumerate(d.anchors, 1)) + ") r(dimension, title, score, label, description)",
    "evidence_prompt": f"with s as (select distinct sample_id, transcript, context_turns from emotion_samples), t as (select sample_id, name as dimension, {_EVIDENCE} as p from s, {_RUBRIC}) select sample_id, dimension, md5(p) as prompt_md5, length(p) as n_chars from t",
    "judgment_prompt": f"with t as (select cot_id, {_JUDGE} as p from cot_samples) select cot_id, md5(p) as prompt_md5, length(p) as n_chars from t",
    "batch_prompt": f"with t as (select cot_id, {_BATCH} as p from cot_samples) select cot_id, md5(p) as prompt_md5, length(p) as n_chars from t",
    "evidence_text": f"""select cot_id, '=== Evidence Log for Utterance: ' || coalesce(utterance_id, '') || ' ===' || chr(10) || 'Transcript: "' || coalesce(transcript, '') || '"' || {_CTX.format("chr(10) || chr(10) || 'Conversational Context:' || chr(10)", "''")}
      || chr(10) || chr(10) || {_q(_FEATURES)} || chr(10) || chr(10) || '--- Dimension-Level Evidence ---' || chr(10) || chr(10) || '## {TITLES["valence_accuracy"]}' || {_q(_PART)} as evidence from cot_samples""",
    "target_output": f"select cot_id, '[EVIDENCE]' || chr(10) || {_section(_T, '[EVIDENCE]', '[REASONING]')} || chr(10) || chr(10) || '[REASONING]' || chr(10) || coalesce(reasoning, '') || chr(10) || chr(10) || '[SCORES]' || chr(10) || " + " || chr(10) || ".join(f"'{n}: ' || coalesce(scores.{n}, 3.0)" for n in NAMES) + " as output from cot_samples where scores is not null",
    "sft_messages": f"select cot_id, md5({_ASK}) as ask_md5, target_output as answer, case when coalesce(audio_path, '') = '' then '' when audio_path like '/%' then audio_path else '/data/' || audio_path end as audios from cot_samples where target_output <> ''",
    "inference_prompt": f"select cot_id, md5({_q('<|system|>' + chr(10) + P.SYSTEM + chr(10) + '<|user|>' + chr(10))} || {_ASK} || {_q(chr(10) + '<|assistant|>' + chr(10))}) as prompt_md5 from cot_samples",
    "collated_chat": f"select cot_id, md5({_q('<|system|>' + chr(10) + P.SYSTEM + chr(10) + '<|user|>' + chr(10))} || {_ASK} || {_q(chr(10) + '<|assistant|>' + chr(10))} || target_output) as chat_md5 from cot_samples where target_output <> ''",
    "json_round_trip": "select cot_id, " + ", ".join(f"scores.{n} as {n}" for n in NAMES) + " from cot_samples where scores is not null",
    "fence_json": f"""with t as (select cot_id, {_JSON_TEXT} as x from cot_samples)
      select cot_id, case when cot_id % 7 = 0 then substr('```json' || chr(10) || '{{"detected_cues": "' || x || '", "strengths": "ok"' || chr(10) || '```', 1, 500) else '' end as emotional_context,
        case when cot_id % 7 = 0 then '' else x end as detected_cues, case when cot_id % 7 = 0 then '' else 'ok' end as strengths, cot_id % 7 = 0 as is_fallback from t""",
    "batch_evidence": f"""with t as (select cot_id, {_JSON_TEXT} as x from cot_samples)
      select cot_id, name as dimension, case when cot_id % 5 = 0 then 'Parse error - see raw response' else '' end as emotional_context, case when cot_id % 5 <> 0 and name = 'valence_accuracy' then 'clear' else '' end as strengths,
        case when cot_id % 5 <> 0 and name = 'emotional_intensity' then x else '' end as issues from t, {_RUBRIC}""",
    "judgment_parse": _LINES + f", j as (select *, {_T} as t from p) select cot_id, case when contains(t, '[REASONING]') then {_section('t', '[REASONING]', '[SCORES]')} when contains(t, '[SCORES]') then {_strip(chr(115) + 'plit_part(t, ' + chr(39) + '[SCORES]' + chr(39) + ', 1)')} else {_strip('t')} end as reasoning, "
    + ", ".join(f"case when contains(t, '[SCORES]') then case when len(list_filter(coalesce(kv, []), lambda z: z.k = '{n}')) = 0 then 3.0 else {_score(n)} end else coalesce(oracle_scores.{n}, 3.0) end as {n}" for n in NAMES) + ", not contains(t, '[SCORES]') as is_fallback from j",
}
