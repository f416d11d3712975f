"""Queries over utterances, dialogues, annotations and pairs."""

from __future__ import annotations

from pyspark.sql import functions as F

from timbrel.functions import columns as C
from timbrel.operators import frames, pairs, samples, sft
from timbrel.session import table
from timbrel.sources import corpora
from timbrel.taxonomy import CORPORA, EMOTIONS, INTENSITIES, LABELS, NO_SPEAKER, PARTITION_SPLITS, SPLITS, STATEMENTS

_SAMPLES = "emotion_samples"


def _s(spark, sf_dir):
    """Samples with their labels as they are meant."""
    return samples.canonical(table(spark, sf_dir, _SAMPLES))


def label_map(spark, sf_dir):
    s = _s(spark, sf_dir)
    dataset, raw = F.col("dataset_name"), F.col("emotion_raw_label")
    return s.groupBy(dataset.alias("dataset"), raw.alias("raw"), C.canonical_label(dataset, raw).alias("canonical")).agg(F.count("*").alias("n"))


def emotion_distribution(spark, sf_dir):
    return samples.emotion_distribution(_s(spark, sf_dir))


def distinct_speakers(spark, sf_dir):
    return samples.speakers(_s(spark, sf_dir))


def dataset_summary(spark, sf_dir):
    return samples.summary(_s(spark, sf_dir), ["dataset_name"])


def filter_by_emotion(spark, sf_dir):
    return samples.by_emotion(_s(spark, sf_dir), ["happy", "sad"]).select("sample_id", "utterance_id", "categorical_emotion")


def filter_by_speaker(spark, sf_dir):
    return samples.by_speaker(_s(spark, sf_dir), "actor_00001").select("sample_id", "utterance_id", "speaker_id")


def duration_band(spark, sf_dir):
    return samples.duration_band(_s(spark, sf_dir)).select("sample_id", "duration_sec")


def cap_first_n(spark, sf_dir):
    """The first 100 utterances in corpus order; the limit is the operator."""
    return samples.first_n(_s(spark, sf_dir).select("sample_id", "utterance_id").distinct(), 100, ["sample_id"])


def row_at_index(spark, sf_dir):
    return samples.at_index(_s(spark, sf_dir).select("sample_id", "utterance_id").distinct(), 41, ["sample_id"])


def resume_remaining(spark, sf_dir):
    """Samples without an answer in cot_samples."""
    return samples.remaining(_s(spark, sf_dir).select("sample_id", "utterance_id").distinct(), table(spark, sf_dir, "cot_samples"))


def union_corpora(spark, sf_dir):
    s = _s(spark, sf_dir).select("sample_id", "dataset_name", "categorical_emotion")
    parts = [s.where(F.col("dataset_name") == d) for d in ("ravdess", "iemocap", "msp_podcast", "meld")]
    return samples.union_corpora(*parts).groupBy("part", "dataset_name").agg(F.count("*").alias("n"), F.count("categorical_emotion").alias("with_emotion"))


def vad_rescale(spark, sf_dir):
    a = samples.canonical(table(spark, sf_dir, "vad_annotations"))
    fit = lambda c: F.when(F.col("dataset_name") == "msp_podcast", C.rescale(F.col(c), 7.0)).otherwise(C.rescale(F.col(c), 5.0))
    return a.select("utterance_id", "annotator_id", *(F.round(F.nanvl(fit(c), F.lit(None)), 6).alias(c) for c in ("valence", "arousal", "dominance")))


def mean_vad(spark, sf_dir):
    a = table(spark, sf_dir, "vad_annotations").where(F.col("valence").isNotNull() & ~F.isnan("valence"))
    return a.groupBy("utterance_id").agg(F.round(F.avg("valence"), 6).alias("valence"), F.count("*").alias("n_annotators"))


def min_annotators(spark, sf_dir):
    a = table(spark, sf_dir, "vad_annotations")
    return a.groupBy("utterance_id").agg(F.count_distinct(C.person_name()).alias("n_annotators")).where("n_annotators >= 3")


def safe_float_default(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", C.number_or(F.get_json_object("props", "$.k"), 4.0).alias("k"), C.number_or(F.col("event_type"), 4.0).alias("d"))


def emotion_filter_default(spark, sf_dir):
    """Dialogue labels stripped, lower-cased and mapped; unknown ones are ``other``."""
    m = table(spark, sf_dir, "meld_utterances")
    raw = F.lower(C.strip(F.coalesce("emotion", F.lit("neutral"))))
    return m.groupBy(raw.alias("raw"), C.canonical_label(F.lit("meld"), raw).alias("canonical")).agg(F.count("*").alias("n"))


def _turns(spark, sf_dir):
    """One row per dialogue turn: the first version to arrive."""
    m = table(spark, sf_dir, "meld_utterances").where("dialogue_id is not null and utterance_id is not null")
    first = F.min_by(F.struct("speaker", "utterance", "emotion"), F.struct("loaded_at", "speaker", "utterance", "emotion"))
    return m.groupBy("dialogue_id", "utterance_id").agg(first.alias("r")).select("dialogue_id", "utterance_id", "r.*")


def context_window(spark, sf_dir):
    t = frames.context_turns(_turns(spark, sf_dir), "dialogue_id", ["utterance_id"], "speaker", "utterance")
    return t.select("dialogue_id", "utterance_id", F.array_join("context_turns", " | ").alias("context"))


def context_last_n(spark, sf_dir):
    return _s(spark, sf_dir).select("sample_id", F.array_join(C.last_turns(F.col("context_turns"), 2), " | ").alias("context"))


def turn_numbering(spark, sf_dir):
    return _s(spark, sf_dir).select("sample_id", C.numbered(F.coalesce("context_turns", F.array().cast("array<string>"))).alias("context"))


def filter_after_context(spark, sf_dir):
    """Filtered rows keep context from dropped ones."""
    t = frames.context_turns(_turns(spark, sf_dir), "dialogue_id", ["utterance_id"], "speaker", "utterance")
    return t.where(F.lower(C.strip("emotion")).isin("joy", "anger")).select("dialogue_id", "utterance_id", F.size("context_turns").cast("long").alias("n_context"))


def dialogue_stats(spark, sf_dir):
    return frames.dialogue_stats(_turns(spark, sf_dir), "dialogue_id", "speaker")


def multi_party(spark, sf_dir):
    return frames.multi_party(_turns(spark, sf_dir), "dialogue_id", "speaker").select("dialogue_id", "utterance_id", "speaker")


def dialogue_ids(spark, sf_dir):
    return table(spark, sf_dir, "meld_utterances").where("dialogue_id is not null").select("dialogue_id").distinct()


def one_dialogue(spark, sf_dir):
    return _turns(spark, sf_dir).where("dialogue_id = 1").orderBy("utterance_id")


def _acted(spark, sf_dir):
    s = _s(spark, sf_dir).where("dataset_name = 'ravdess'").select("sample_id", "utterance_id").distinct()
    return corpora.parse_coded_names(s.withColumn("stem", F.col("utterance_id"))).withColumn("ordinal", F.col("sample_id"))


def coded_names(spark, sf_dir):
    cols = ["sample_id", "utterance_id", "channel", "categorical_emotion", "emotion_raw_label", "emotion_intensity", "statement", "repetition", "actor", "gender", "speaker_id", "transcript"]
    return _acted(spark, sf_dir).select(*cols)


def controlled_pairs(spark, sf_dir):
    return pairs.controlled_pairs(_acted(spark, sf_dir), "happy", "sad")


def intensity_pairs(spark, sf_dir):
    return pairs.intensity_pairs(_acted(spark, sf_dir), "angry")


def partition_lines(spark, sf_dir):
    lines = table(spark, sf_dir, "raw_lines").where(F.col("file_name").like("partition%"))
    return corpora.parse_partitions(lines, ["line_id"], "raw_text")


def consensus_ratings(spark, sf_dir):
    """Partition lines of the podcast corpus with their label and the mean ratings, on 1 to 5, of at least three annotators."""
    podcast = F.col("dataset_name") == "msp_podcast"
    part = partition_lines(spark, sf_dir).withColumn("utterance_id", F.regexp_replace("utterance_id", r"\.wav", ""))
    s = _s(spark, sf_dir).where(podcast).groupBy("utterance_id").agg(F.min("emotion_raw_label").alias("emotion_raw_label"))
    rated = _rated(spark, sf_dir).where("n_annotators >= 3")
    means = (F.round(n, 6).alias(n) for n in ("valence", "arousal", "dominance"))
    return part.join(rated, "utterance_id").join(s, "utterance_id").select("utterance_id", "partition", "emotion_raw_label", *means, "n_annotators")


def _rated(spark, sf_dir):
    """Mean ratings of the podcast corpus."""
    return corpora.rated_labels(samples.canonical(table(spark, sf_dir, "vad_annotations")).where("dataset_name = 'msp_podcast'"), ["labelled_at", "loaded_at"])


def podcast_join(spark, sf_dir):
    """Records of the podcast corpus in the sample table stand for its partition file: joined with labels of at least three annotators, per split."""
    s = table(spark, sf_dir, _SAMPLES).where(C.corpus_name() == "msp_podcast")
    partitions = s.groupBy("utterance_id").agg(F.max(F.initcap(C.outer("split"))).alias("partition"))
    labels = _rated(spark, sf_dir).join(s.groupBy("utterance_id").agg(F.min("emotion_raw_label").alias("emotion_raw_label")), "utterance_id")
    parts = [corpora.podcast_samples(partitions, labels, None, split, normalize=False).withColumn("split", F.lit(split)) for split in PARTITION_SPLITS]
    own = F.col("vad_annotations")[0]
    return samples.union_corpora(*parts).select("utterance_id", "split", "partition", "categorical_emotion", F.round(own["valence"], 6).alias("valence"), F.round(own["arousal"], 6).alias("arousal"), "n_annotators")


def consensus_join(spark, sf_dir):
    """Partition lines joined with mean ratings of enough annotators, counted per partition and label."""
    return consensus_ratings(spark, sf_dir).groupBy("partition", "emotion_raw_label").agg(F.count("*").alias("n"))


def annotator_list(spark, sf_dir):
    """Samples with all their raters, in order, as text; samples without any have an empty list."""
    a = table(spark, sf_dir, "vad_annotations").groupBy("utterance_id").agg(F.array_sort(F.collect_set(F.upper(F.trim("annotator_id")))).alias("who"))
    s = _s(spark, sf_dir).select("utterance_id").distinct()
    return s.join(a, "utterance_id", "left").select("utterance_id", F.coalesce(F.array_join("who", ","), F.lit("")).alias("annotators"), F.coalesce(F.size("who"), F.lit(0)).cast("long").alias("n"))


def podcast_splits(spark, sf_dir):
    """Splits of the partition names."""
    p = partition_lines(spark, sf_dir)
    of = {n: s for s, names in PARTITION_SPLITS.items() for n in names}
    return p.groupBy(F.coalesce(C.lookup(F.col("partition"), of), F.lit("none")).alias("split")).agg(F.count("*").alias("n"))


def transcript_join(spark, sf_dir):
    """Samples with the text of their dialogue turn, empty where there is none, and whether its audio is named."""
    t = _turns(spark, sf_dir).select(F.format_string("dia%d_utt%d", "dialogue_id", "utterance_id").alias("utterance_id"), "utterance")
    s = _s(spark, sf_dir).select("sample_id", "utterance_id", "audio_path").distinct()
    return s.join(t, "utterance_id", "left").select("sample_id", F.coalesce("utterance", F.lit("")).alias("transcript"), (F.coalesce(F.length("audio_path"), F.lit(0)) > 0).alias("has_audio"))


def missing_labels(spark, sf_dir):
    """Canonical labels that a corpus never uses."""
    s = _s(spark, sf_dir).groupBy(F.col("dataset_name").alias("dataset")).agg(F.collect_set("categorical_emotion").alias("held"))
    return s.select("dataset", F.array_join(F.array_sort(F.array_except(F.array(*map(F.lit, EMOTIONS)), "held")), ",").alias("missing"))


def sft_split(spark, sf_dir):
    """Training answers with an exact-size seeded split."""
    c = table(spark, sf_dir, "cot_samples").where("cot_id is not null").dropDuplicates(["cot_id"])
    return sft.with_split(c.select("cot_id"), "cot_id", 0.1, 42)


def sft_split_sizes(spark, sf_dir):
    return sft_split(spark, sf_dir).groupBy("is_val").agg(F.count("*").alias("n"))


def sft_summary(spark, sf_dir):
    return sft.summary(sft.examples(table(spark, sf_dir, "cot_samples")))


_F = (
    label_map, emotion_distribution, distinct_speakers, dataset_summary, filter_by_emotion, filter_by_speaker, duration_band, cap_first_n, row_at_index, resume_remaining,
    union_corpora, vad_rescale, mean_vad, min_annotators, safe_float_default, emotion_filter_default, context_window, context_last_n, turn_numbering, filter_after_context,
    dialogue_stats, multi_party, dialogue_ids, one_dialogue, coded_names, controlled_pairs, intensity_pairs, partition_lines, consensus_ratings, podcast_join, consensus_join, annotator_list, podcast_splits,
    transcript_join, missing_labels, sft_split, sft_split_sizes, sft_summary,
)
QUERIES = {f.__name__: f for f in _F}


def _values(rows) -> str:
    q = lambda x: "'" + x.replace("'", "''") + "'"
    return "(values " + ", ".join("(" + ", ".join(map(q, r)) + ")" for r in rows) + ")"


def _outer(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def _case(x: str, of: dict[str, str]) -> str:
    return f"case {x} " + " ".join(f"when '{k}' then '{v}'" for k, v in of.items()) + " end"


_CORPUS = _case(r"lower(regexp_replace(dataset_name, '[\s_-]+', '', 'g'))", CORPORA)
_SPLIT = _case(f"lower({_outer('split')})", SPLITS)
_CATEGORY = _case(f"lower({_outer('categorical_emotion')})", {x: x for x in EMOTIONS})
_SPEAKER = f"case when lower({_outer('speaker_id')}) not in ({', '.join(map(repr, NO_SPEAKER))}) then lower({_outer('speaker_id')}) end"
#: The tables with their labels as they are meant.
ES = f"(select * replace ({_CORPUS} as dataset_name, {_SPLIT} as split, {_CATEGORY} as categorical_emotion, {_SPEAKER} as speaker_id) from emotion_samples)"
VA = f"(select * replace ({_CORPUS} as dataset_name) from vad_annotations)"
_LABELS = _values((d, k, v) for d, m in LABELS.items() for k, v in m.items())
_TURNS = """with t as (select dialogue_id, utterance_id, speaker, utterance, emotion from meld_utterances where dialogue_id is not null and utterance_id is not null
  qualify row_number() over (partition by dialogue_id, utterance_id order by loaded_at, speaker nulls first, utterance nulls first, emotion nulls first) = 1)
"""
_CONTEXT = """array_agg('[' || coalesce(speaker, '') || '] ' || coalesce(utterance, '')) over (partition by dialogue_id order by utterance_id rows between 3 preceding and 1 preceding)"""
_ACTED = f"""with s as (select distinct sample_id, utterance_id, string_split(utterance_id, '-') as p from {ES} where dataset_name = 'ravdess'),
a as (select sample_id, utterance_id, case when p[2] = '01' then 'speech' else 'song' end as channel,
  coalesce(l.v, 'other') as categorical_emotion, p[3] as emotion_raw_label, case p[4] {' '.join(f"when '{k}' then '{v}'" for k, v in INTENSITIES.items())} else 'normal' end as emotion_intensity,
  p[4] as intensity, p[5] as statement, p[6] as repetition, try_cast(p[7] as int) as actor, case when try_cast(p[7] as int) % 2 = 1 then 'M' else 'F' end as gender,
  'Actor_' || lpad(cast(try_cast(p[7] as int) as varchar), greatest(2, length(cast(try_cast(p[7] as int) as varchar)))::int, '0') as speaker_id,
  case p[5] {' '.join(f"when '{k}' then '{v}'" for k, v in STATEMENTS.items())} else '' end as transcript
  from s left join {_LABELS} l(d, k, v) on l.d = 'ravdess' and l.k = p[3] where len(p) = 7 and p[1] <> '02')
"""
_PARTS = r"""with r as (select line_id, regexp_replace(raw_text, '^\s+|\s+$', '', 'g') as t from raw_lines where file_name like 'partition%'),
f as (select line_id, case when contains(t, ';') then string_split(t, ';') when contains(t, ',') then string_split(t, ',') else regexp_split_to_array(t, '\s+') end as f from r),
p as (select regexp_replace(f[1], '^\s+|\s+$', '', 'g') as utterance_id, regexp_replace(f[2], '^\s+|\s+$', '', 'g') as partition from f where len(f) >= 2
  qualify row_number() over (partition by regexp_replace(f[1], '^\s+|\s+$', '', 'g') order by line_id desc) = 1)
"""
#: A test for NaN that column statistics cannot undo.
RATED = "valence::varchar <> 'nan' and arousal::varchar <> 'nan'"
_PERSON = f"nullif(upper({_outer('annotator_id')}), '')"
_RATED = f"""s as (select utterance_id, min(emotion_raw_label) as emotion_raw_label from (select *, {_CORPUS} as corpus from emotion_samples) where corpus = 'msp_podcast' group by 1),
      a as (select *, {_PERSON} as person, case when dominance::varchar <> 'nan' and dominance between 1 and 7 then dominance end as d from {VA}
        where dataset_name = 'msp_podcast' and {RATED} and valence between 1 and 7 and arousal between 1 and 7 and utterance_id is not null and {_PERSON} is not null),
      l as (select * from a qualify row_number() over (partition by utterance_id, person order by labelled_at desc nulls last, loaded_at desc nulls last, valence desc, arousal desc, d desc nulls last) = 1),
      m as (select utterance_id, avg(valence) as v, avg(arousal) as a, avg(d) as d, count(*) as n_annotators from l group by 1 having count(*) >= 3)"""
_JOINED = _RATED + f""", t as (select utterance_id, max(upper(left({_outer('raw_split')}, 1)) || lower(substr({_outer('raw_split')}, 2))) as partition
        from (select *, {_CORPUS} as corpus, split as raw_split from emotion_samples) where corpus = 'msp_podcast' group by 1),
      j as (select m.utterance_id, partition, case when partition in ('Train') then 'train' when partition in ('Validation', 'Development') then 'val' when partition in ('Test1', 'Test2', 'Test') then 'test' end as split,
      coalesce(e.v, 'other') as categorical_emotion, round(1 + (m.v - 1) * 4 / 6, 6) as valence, round(1 + (m.a - 1) * 4 / 6, 6) as arousal, n_annotators
      from m join s using (utterance_id) join t using (utterance_id) left join {_LABELS} e(d, k, v) on e.d = 'msp_podcast' and e.k = emotion_raw_label where partition in ('Train', 'Validation', 'Development', 'Test1', 'Test2', 'Test'))
"""
SQL = {
    "label_map": f"""select dataset_name as dataset, emotion_raw_label as raw, coalesce(l.v, 'other') as canonical, count(*) as n
      from {ES} left join {_LABELS} l(d, k, v) on l.d = dataset_name and l.k = emotion_raw_label group by 1, 2, 3""",
    "emotion_distribution": f"select categorical_emotion as emotion, count(*) as n from {ES} where categorical_emotion is not null group by 1",
    "distinct_speakers": f"select distinct speaker_id as speaker from {ES} where speaker_id <> ''",
    "dataset_summary": f"""select dataset_name, count(*) as n_samples, count(distinct nullif(speaker_id, '')) as n_speakers, count(*) filter (transcript <> '') as with_transcript,
      count(*) filter (len(context_turns) > 0) as with_context, count(categorical_emotion) as with_emotion from {ES} group by 1""",
    "filter_by_emotion": f"select sample_id, utterance_id, categorical_emotion from {ES} where categorical_emotion in ('happy', 'sad')",
    "filter_by_speaker": f"select sample_id, utterance_id, speaker_id from {ES} where speaker_id = 'actor_00001'",
    "duration_band": "select sample_id, duration_sec from emotion_samples where duration_sec <= 0 or duration_sec between 0.5 and 30",
    "cap_first_n": "select distinct sample_id, utterance_id from emotion_samples order by sample_id limit 100",
    "row_at_index": "select distinct sample_id, utterance_id from emotion_samples order by sample_id limit 1 offset 41",
    "resume_remaining": "select distinct sample_id, utterance_id from emotion_samples s where not exists (select 1 from cot_samples c where c.utterance_id = s.utterance_id)",
    "union_corpora": f"""select case dataset_name when 'ravdess' then 0 when 'iemocap' then 1 when 'msp_podcast' then 2 else 3 end as part, dataset_name, count(*) as n, count(categorical_emotion) as with_emotion
      from {ES} where dataset_name in ('ravdess', 'iemocap', 'msp_podcast', 'meld') group by 1, 2""",
    "vad_rescale": "select utterance_id, annotator_id, " + ", ".join(f"round(case when {c}::varchar = 'nan' then null when dataset_name = 'msp_podcast' then 1 + ({c} - 1) * 4 / 6 else {c} end, 6) as {c}" for c in ("valence", "arousal", "dominance")) + f" from {VA}",
    "mean_vad": "select utterance_id, round(avg(valence), 6) as valence, count(*) as n_annotators from vad_annotations where valence is not null and valence::varchar <> 'nan' group by 1",
    "min_annotators": f"select utterance_id, count(distinct {_PERSON}) as n_annotators from vad_annotations group by 1 having count(distinct {_PERSON}) >= 3",
    "safe_float_default": "select event_id, coalesce(try_cast(json_extract_string(props, '$.k') as double), 4.0) as k, coalesce(try_cast(event_type as double), 4.0) as d from events",
    "emotion_filter_default": f"""with r as (select lower(regexp_replace(coalesce(emotion, 'neutral'), '^\\s+|\\s+$', '', 'g')) as raw from meld_utterances)
      select raw, coalesce(l.v, 'other') as canonical, count(*) as n from r left join {_LABELS} l(d, k, v) on l.d = 'meld' and l.k = raw group by 1, 2""",
    "context_window": _TURNS + f"select dialogue_id, utterance_id, coalesce(array_to_string({_CONTEXT}, ' | '), '') as context from t",
    "context_last_n": "select sample_id, coalesce(array_to_string(context_turns[-2:], ' | '), '') as context from emotion_samples",
    "turn_numbering": """select sample_id, coalesce(array_to_string(list_transform(range(1, len(context_turns) + 1), lambda i: '  Turn ' || i || ': ' || context_turns[i]), chr(10)), '') as context from emotion_samples""",
    "filter_after_context": _TURNS + ", c as (select *, row_number() over (partition by dialogue_id order by utterance_id) as r from t) select dialogue_id, utterance_id, least(r - 1, 3) as n_context from c where lower(regexp_replace(emotion, '^\\s+|\\s+$', '', 'g')) in ('joy', 'anger')",
    "dialogue_stats": _TURNS + "select dialogue_id, count(*) as dialogue_length, count(distinct speaker) as n_speakers from t group by 1",
    "multi_party": _TURNS + "select dialogue_id, utterance_id, speaker from t where dialogue_id in (select dialogue_id from t group by 1 having count(distinct speaker) >= 3)",
    "dialogue_ids": "select distinct dialogue_id from meld_utterances where dialogue_id is not null",
    "one_dialogue": _TURNS + "select * from t where dialogue_id = 1",
    "coded_names": _ACTED + "select sample_id, utterance_id, channel, categorical_emotion, emotion_raw_label, emotion_intensity, statement, repetition, actor, gender, speaker_id, transcript from a",
    "controlled_pairs": _ACTED + """select speaker_id, statement, repetition, intensity, arg_max(utterance_id, sample_id) filter (categorical_emotion = 'happy') as a, arg_max(utterance_id, sample_id) filter (categorical_emotion = 'sad') as b
      from a group by all having a is not null and b is not null""",
    "intensity_pairs": _ACTED + """select speaker_id, statement, repetition, arg_max(utterance_id, sample_id) filter (emotion_intensity = 'normal') as a, arg_max(utterance_id, sample_id) filter (emotion_intensity = 'strong') as b
      from a where categorical_emotion = 'angry' group by all having a is not null and b is not null""",
    "partition_lines": _PARTS + "select utterance_id, partition from p",
    "consensus_ratings": _PARTS + f""", {_RATED}
      select m.utterance_id, p.partition, emotion_raw_label, round(1 + (v - 1) * 4 / 6, 6) as valence, round(1 + (a - 1) * 4 / 6, 6) as arousal, round(1 + (d - 1) * 4 / 6, 6) as dominance, n_annotators
      from p join m on m.utterance_id = replace(p.utterance_id, '.wav', '') join s on s.utterance_id = m.utterance_id""",
    "podcast_join": "with " + _JOINED + "select utterance_id, split, partition, categorical_emotion, valence, arousal, n_annotators from j",
    "consensus_join": _PARTS + f", {_RATED} select p.partition, emotion_raw_label, count(*) as n from p join m on m.utterance_id = replace(p.utterance_id, '.wav', '') join s on s.utterance_id = m.utterance_id group by 1, 2",
    "annotator_list": """with a as (select utterance_id, list_sort(list(distinct upper(trim(annotator_id, ' '))) filter (annotator_id is not null)) as who from vad_annotations group by 1), s as (select distinct utterance_id from emotion_samples)
      select utterance_id, coalesce(array_to_string(who, ','), '') as annotators, coalesce(len(who), 0) as n from s left join a using (utterance_id)""",
    "podcast_splits": _PARTS + "select case " + " ".join(f"when partition in ({', '.join(repr(x) for x in names)}) then '{s}'".replace(",)", ")") for s, names in PARTITION_SPLITS.items()) + " else 'none' end as split, count(*) as n from p group by 1",
    "transcript_join": _TURNS + """, s as (select distinct sample_id, utterance_id, audio_path from emotion_samples)
      select sample_id, coalesce(t.utterance, '') as transcript, coalesce(length(audio_path), 0) > 0 as has_audio from s left join t on s.utterance_id = 'dia' || t.dialogue_id || '_utt' || t.utterance_id""",
    "missing_labels": f"""with e(x) as {_values((x,) for x in EMOTIONS)}, d as (select distinct dataset_name as dataset from {ES})
      select dataset, coalesce(string_agg(x, ',' order by x) filter (not exists (select 1 from {ES} s where s.dataset_name = dataset and s.categorical_emotion = x)), '') as missing from d, e group by 1""",
    "sft_split_sizes": "with n as (select count(distinct cot_id) as n from cot_samples) select unnest([false, true]) as is_val, unnest([n - floor(n * 0.1)::bigint, floor(n * 0.1)::bigint]) as n from n",
    "sft_summary": """select count(*) as n, count(*) filter (coalesce(audio_path, '') <> '') as with_audio, count(*) filter (len(context_turns) > 0 or contains(lower(transcript), 'context')) as with_context,
      round(avg(length(target_output)), 6) as mean_length, max(length(target_output)) as max_length, min(length(target_output)) as min_length from cot_samples where target_output <> ''""",
}
