"""Queries of the corpus readers: source files are written out of the test tables, and read as a user would read a corpus.

The files are written to the shared folder by all tasks, each of them anew for a query.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from timbrel.functions import columns as C
from timbrel.operators import samples, sft
from timbrel.plans.corpus import _CORPUS, _LABELS, RATED, _outer
from timbrel.rubric import NAMES
from timbrel.session import shared_dir, table
from timbrel.sources import corpora
from timbrel.taxonomy import SAMPLE


def _folder(spark, name: str) -> str:
    return f"{shared_dir(spark)}/timbrel-{name}-{uuid.uuid4().hex}"


def _csv(df, path: str) -> str:
    df.write.csv(path, header=True, quote='"', escape='"', emptyValue="", nullValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return path


def read_multi_party(spark, sf_dir):
    """The training file of the dialogue corpus with one row per turn, the first version to arrive, and its context."""
    m = table(spark, sf_dir, "meld_utterances").where("dialogue_id is not null and utterance_id is not null")
    cols = ["speaker", "utterance", "emotion", "sentiment", "season", "episode", "start_time", "end_time"]
    first = m.groupBy("dialogue_id", "utterance_id").agg(F.min(F.struct("loaded_at", *cols)).alias("r")).select("dialogue_id", "utterance_id", *(f"r.{c}" for c in cols))
    names = ["Dialogue_ID", "Utterance_ID", "Speaker", "Utterance", "Emotion", "Sentiment", "Season", "Episode", "StartTime", "EndTime"]
    root = _folder(spark, "multi-party")
    _csv(first.toDF(*names).select(*names[:2], *(F.coalesce(c, F.lit("")).alias(c) for c in names[2:])), f"{root}/train/train_sent_emo.csv")
    read = corpora.read_multi_party(spark, root)
    shown = F.array_join("context_turns", " | ").alias("context")
    return read.select("utterance_id", "speaker_id", "transcript", shown, "categorical_emotion", "emotion_raw_label", "sentiment", F.col("metadata")["n_speakers"].cast("long").alias("n_speakers"), F.col("metadata")["length"].cast("long").alias("length"))


def read_podcast(spark, sf_dir):
    """Partition, consensus and detailed files of the podcast corpus, read back for all splits; a record's ratings are counted and their mean taken, the consensus among them."""
    s = table(spark, sf_dir, "emotion_samples").where((C.corpus_name() == "msp_podcast") & F.col("utterance_id").isNotNull())
    a = samples.canonical(table(spark, sf_dir, "vad_annotations")).where("dataset_name = 'msp_podcast' and utterance_id is not null")
    root = _folder(spark, "podcast")
    part = s.groupBy("utterance_id").agg(F.max(F.initcap(C.outer("split"))).alias("p")).where("p is not null")
    part.select(F.concat_ws(";", "utterance_id", "p")).write.text(f"{root}/Partitions/partition.txt")
    rated = corpora.rated_labels(a, ["labelled_at", "loaded_at"], normalize=False)
    label = rated.join(s.groupBy("utterance_id").agg(F.coalesce(F.min("emotion_raw_label"), F.lit("")).alias("label"), F.coalesce(F.min(F.trim("speaker_id")), F.lit("")).alias("who")), "utterance_id")
    dominance = F.coalesce(F.col("dominance").cast("string"), F.lit("none"))  # not a number, so it is read as 4
    _csv(label.select(F.concat("utterance_id", F.lit(".wav")).alias("FileName"), F.col("label").alias("EmoClass"), F.col("valence").alias("Valence"), F.col("arousal").alias("Arousal"), dominance.alias("Dominance"), F.col("n_annotators").alias("NumAnnotators"), F.col("who").alias("SpkrID")), f"{root}/Labels/labels_consensus.csv")
    details = a.where("valence between 1 and 7 and arousal between 1 and 7").select(F.concat("utterance_id", F.lit(".wav")).alias("FileName"), F.coalesce("annotator_id", F.lit("")).alias("WorkerID"), F.col("valence").alias("Valence"), F.col("arousal").alias("Arousal"), F.lit("x").alias("Dominance"))
    _csv(details, f"{root}/Labels/labels_detailed.csv")
    parts = [corpora.read_podcast(spark, root, split, detailed=True).drop("ordinal") for split in ("train", "val", "test")]
    ratings = F.col("vad_annotations")
    return samples.union_corpora(*parts).select(
        "utterance_id", "split", "categorical_emotion", F.size(ratings).cast("long").alias("n_ratings"), F.round(C.mean_of(ratings, "valence"), 5).alias("mean_valence"), F.round(ratings[0]["dominance"], 5).alias("dominance")
    )


def _dyadic(spark, sf_dir):
    s = table(spark, sf_dir, "emotion_samples").where((C.corpus_name() == "iemocap") & F.col("utterance_id").isNotNull() & F.col("sample_id").isNotNull())
    return s.select("sample_id", "utterance_id", F.coalesce("emotion_raw_label", F.lit("xxx")).alias("raw"), F.coalesce("transcript", F.lit("")).alias("transcript")).distinct()


def evaluation_lines(spark, sf_dir):
    """Evaluation lines of the dyadic corpus, every seventh of another shape, and their fields."""
    i = F.col("sample_id")
    number = lambda c: F.concat(c.cast("string"), F.lit(".5"))
    line = F.concat(F.lit("["), number(i % 90), F.lit(" - "), number(i % 90 + i % 5 + 1), F.lit("]\t"), F.col("utterance_id"), F.lit("\t"), F.col("raw"), F.lit("\t["), number(i % 4), F.lit(", "), number(i % 3), F.when(i % 7 == 0, "").otherwise(", 2.25"), F.lit("]"))
    e = corpora.parse_evaluations(_dyadic(spark, sf_dir).drop("utterance_id", "transcript").join(_dyadic(spark, sf_dir).select("sample_id", line.alias("value")), "sample_id").drop("raw"))
    return e.select("sample_id", "utterance_id", "start_time", "end_time", "emotion_raw_label", "categorical_emotion", *(F.col("vad")[n].alias(n) for n in ("valence", "arousal", "dominance")), "gender", "dialog_id")


def spoken_lines(spark, sf_dir):
    """Transcript lines of the dyadic corpus, every fifth a comment; the last of several of an utterance wins."""
    i = F.col("sample_id")
    said = F.regexp_replace("transcript", r"\s+", " ")
    line = F.concat(F.when(i % 5 == 0, "; ").otherwise(""), F.col("utterance_id"), F.lit(" [00"), (i % 90).cast("string"), F.lit(".10-0"), (i % 90 + 1).cast("string"), F.lit(".20]: "), said)
    return corpora.parse_spoken_lines(_dyadic(spark, sf_dir).select("sample_id", line.alias("value")), ["sample_id", "value"])


_SAMPLE = ["utterance_id", "dataset_name", "split", "audio_path", "sample_rate", "duration_sec", "speaker_id", "gender", "transcript", "context_turns", "categorical_emotion", "emotion_raw_label", "sentiment", "emotion_intensity"]
_RESULT = ["utterance_id", "reasoning", "evidence", "k_samples", "scores", "score_stds", "elapsed_seconds"]


def _round_trip(df, key: str, names: list[str]):
    """The fields of ``names`` to JSON and back, arrays and structs shown as text."""
    kinds = {f.name: f.dataType for f in df.schema}
    schema = ", ".join(f"{n} {kinds[n].simpleString()}" for n in names)
    back = df.select(key, F.from_json(F.to_json(F.struct(*names)), schema).alias("r"))
    shown = lambda n: F.array_join(f"r.{n}", " | ", "null") if kinds[n].typeName() == "array" else F.concat_ws(",", *(F.coalesce(F.col(f"r.{n}.{x.name}").cast("string"), F.lit("null")) for x in kinds[n])) if kinds[n].typeName() == "struct" else F.col(f"r.{n}")
    return back.select(key, *(shown(n).alias(n) for n in names))


def sample_round_trip(spark, sf_dir):
    """Records of the sample table to JSON and back."""
    return _round_trip(table(spark, sf_dir, "emotion_samples"), "sample_id", _SAMPLE)


def result_round_trip(spark, sf_dir):
    """Inference results to JSON and back."""
    return _round_trip(table(spark, sf_dir, "inference_results"), "result_id", _RESULT)


def label_mask(spark, sf_dir):
    """Prompts and answers with word lengths for ids, in batches of eight, padded and masked."""
    c = table(spark, sf_dir, "cot_samples").where("cot_id is not null").dropDuplicates(["cot_id"])
    ids = lambda n: F.when(F.length(n) > 0, F.transform(F.split(n, " "), F.length))
    masked = sft.label_mask(c.select("cot_id", F.floor(F.col("cot_id") / 8).alias("batch"), ids("prompt").alias("p"), ids("reasoning").alias("a")), "p", "a", "batch", 512)
    return masked.select("cot_id", "batch", *(F.array_join(n, ",").alias(n) for n in ("input_ids", "attention_mask", "labels")))


_F = (read_multi_party, read_podcast, evaluation_lines, spoken_lines, sample_round_trip, result_round_trip, label_mask)
QUERIES = {f.__name__: f for f in _F}

assert all(n in SAMPLE for n in _SAMPLE)


def _strip(x: str) -> str:
    return f"trim({x}, e' \\t\\n\\r\\x0b\\x0c')"


_ROWS = ("speaker", "utterance", "emotion", "sentiment", "season", "episode", "start_time", "end_time")
NULL = "'null'"
_IDS = "list_transform(string_split(nullif({0}, ''), ' '), lambda x: length(x))"
SQL = {
    "read_multi_party": f"""with t as (select dialogue_id, utterance_id, speaker, utterance, emotion, sentiment from meld_utterances where dialogue_id is not null and utterance_id is not null
        qualify row_number() over (partition by dialogue_id, utterance_id order by loaded_at, {', '.join(f'{c} nulls first' for c in _ROWS)}) = 1),
      c as (select dialogue_id, utterance_id, {_strip("coalesce(speaker, '')")} as s, {_strip("coalesce(utterance, '')")} as u, lower({_strip("coalesce(nullif(emotion, ''), 'neutral')")}) as e, lower({_strip("coalesce(sentiment, '')")}) as f from t),
      n as (select dialogue_id as d, count(distinct s) as n_speakers, count(*) as length from c group by 1)
      select 'meld_dia' || dialogue_id || '_utt' || utterance_id as utterance_id, s as speaker_id, u as transcript,
        coalesce(array_to_string(array_agg('[' || s || '] ' || u) over (partition by dialogue_id order by utterance_id rows between 3 preceding and 1 preceding), ' | '), '') as context,
        coalesce(l.v, 'other') as categorical_emotion, e as emotion_raw_label, f as sentiment, n_speakers, length from c join n on d = dialogue_id left join {_LABELS} l(ds, k, v) on l.ds = 'meld' and l.k = e""",
    "read_podcast": f"""with s as (select utterance_id, coalesce(min(emotion_raw_label), '') as label, max(upper(left({_outer('raw_split')}, 1)) || lower(substr({_outer('raw_split')}, 2))) as p
        from (select *, {_CORPUS} as corpus, split as raw_split from emotion_samples) where corpus = 'msp_podcast' and utterance_id is not null group by 1),
      a as (select *, nullif(upper({_outer('annotator_id')}), '') as person, case when dominance::varchar <> 'nan' and dominance between 1 and 7 then dominance end as d from (select *, {_CORPUS} as corpus from vad_annotations)
        where corpus = 'msp_podcast' and utterance_id is not null and {RATED} and valence between 1 and 7 and arousal between 1 and 7),
      l as (select * from a where person is not null qualify row_number() over (partition by utterance_id, person order by labelled_at desc nulls last, loaded_at desc nulls last, valence desc, arousal desc, d desc nulls last) = 1),
      m as (select utterance_id, avg(valence) as v, avg(d) as d, count(*) as n from l group by 1 having count(*) >= 3),
      x as (select utterance_id, count(*) as k, sum(1 + (valence - 1) * 4 / 6) as t from a group by 1)
      select m.utterance_id, case when p = 'Train' then 'train' when p in ('Validation', 'Development') then 'val' else 'test' end as split, coalesce(e.v, 'other') as categorical_emotion, k + 1 as n_ratings,
        round((t + 1 + (m.v - 1) * 4 / 6) / (k + 1), 5) as mean_valence, round(1 + (coalesce(m.d, 4) - 1) * 4 / 6, 5) as dominance
      from m join s using (utterance_id) join x using (utterance_id) left join {_LABELS} e(ds, kk, v) on e.ds = 'msp_podcast' and e.kk = {_strip("coalesce(nullif(label, ''), 'O')")}
      where p in ('Train', 'Validation', 'Development', 'Test1', 'Test2', 'Test')""",
    "evaluation_lines": f"""with s as (select distinct sample_id as i, utterance_id, coalesce(emotion_raw_label, 'xxx') as raw from (select *, {_CORPUS} as corpus from emotion_samples) where corpus = 'iemocap' and utterance_id is not null and sample_id is not null),
      r as (select *, coalesce(e.v, 'other') as c from s left join {_LABELS} e(d, k, v) on e.d = 'iemocap' and e.k = lower(left(raw, 3)) where i % 7 <> 0 and regexp_full_match(raw, '\\w+') and regexp_full_match(utterance_id, '\\S+'))
      select i as sample_id, utterance_id, i % 90 + 0.5::double as start_time, i % 90 + i % 5 + 1.5::double as end_time, lower(raw) as emotion_raw_label, case c when 'excited' then 'happy' else c end as categorical_emotion,
        i % 4 + 0.5::double as valence, i % 3 + 0.5::double as arousal, 2.25::double as dominance, case when string_split(utterance_id, '_')[-1] like 'F%' then 'F' else 'M' end as gender, regexp_replace(utterance_id, '_[^_]*$', '') as dialog_id from r""",
    "spoken_lines": f"""with s as (select distinct sample_id as i, utterance_id, coalesce(transcript, '') as t from (select *, {_CORPUS} as corpus from emotion_samples) where corpus = 'iemocap' and utterance_id is not null and sample_id is not null)
      select utterance_id, {_strip("regexp_replace(t, '[ \t\n\x0b\f\r]+', ' ', 'g')")} as transcript from s where i % 5 <> 0 and regexp_full_match(utterance_id, '\\S+')
      qualify row_number() over (partition by utterance_id order by i desc, t desc) = 1""",
    "sample_round_trip": "select sample_id, " + ", ".join("coalesce(array_to_string(list_transform(context_turns, lambda x: coalesce(x, 'null')), ' | '), case when context_turns is not null then '' end) as context_turns" if n == "context_turns" else n for n in _SAMPLE) + " from emotion_samples",
    "result_round_trip": "select result_id, utterance_id, reasoning, evidence, k_samples, " + ", ".join(f"concat_ws(',', {', '.join(f'coalesce({n}.{d}::varchar, {NULL})' for d in NAMES)}) as {n}" for n in ("scores", "score_stds")) + ", elapsed_seconds from inference_results",
    "label_mask": f"""with c as (select cot_id, floor(cot_id / 8)::bigint as batch, coalesce({_IDS.format('any_value(prompt)')}, []) as p, coalesce({_IDS.format('any_value(reasoning)')}, []) as a from cot_samples where cot_id is not null group by 1, 2),
      w as (select *, (p || a)[1:512] as ids, (list_transform(p, lambda x: -100) || a)[1:512] as l from c), m as (select *, max(len(ids)) over (partition by batch) - len(ids) as k from w)
      select cot_id, batch, array_to_string(ids || list_transform(range(k), lambda x: 0), ',') as input_ids, array_to_string(list_transform(ids, lambda x: 1) || list_transform(range(k), lambda x: 0), ',') as attention_mask,
        array_to_string(l || list_transform(range(k), lambda x: -100), ',') as labels from m""",
}
