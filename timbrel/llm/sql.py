"""DuckDB SQL of the training-data queries that SQL can express on whole tables."""

_TURNS = r"""
with t as (
  select distinct dialogue_id as conv, utterance_id as turn,
    nullif(lower(regexp_replace(coalesce(speaker, ''), '^\s+|\s+$', '', 'g')), '') as spk,
    nullif(trim(regexp_replace(coalesce(utterance, ''), '\s+', ' ', 'g')), '') as txt
  from meld_utterances where dialogue_id is not null),
n as (select conv, turn, min(spk) as s1, max(spk) as s2, min(txt) as t1, max(txt) as t2, bool_or(spk is null or txt is null) as blank
      from t where turn is not null group by 1, 2),
shape as (select conv, min(turn) as lo, max(turn) as hi, count(*) as n, bool_or(blank) as blank,
      bool_or(s1 <> s2 or t1 <> t2) as conflict, coalesce(min(s1) = max(s2), true) as one from n group by 1),
q as (select distinct cast(regexp_extract(utterance_id, '^dia([0-9]+)_utt', 1) as bigint) as conv,
      cast(regexp_extract(utterance_id, '_utt([0-9]+)$', 1) as bigint) as turn, coalesce(context_turns, []) as c
      from emotion_samples where lower(regexp_replace(dataset_name, '[\s_-]+', '', 'g')) = 'meld' and regexp_full_match(utterance_id, 'dia[0-9]+_utt[0-9]+')),
k as (select q.* from q where conv in (select conv from t)),
told as (select conv, turn, lower('[' || coalesce(spk, '') || '] ' || coalesce(txt, '')) as said from t where turn is not null),
placed as (select conv, turn - len(c) + i as at, lower(trim(regexp_replace(c[i + 1], '\s+', ' ', 'g'))) as said
      from (select *, unnest(range(len(c))) as i from k where len(c) <= 3)),
bad as (
  select conv, 'no_number' as reason from t where turn is null
  union select conv, 'hole' from shape where lo <> 0 or hi <> n - 1
  union select conv, 'blank' from shape where blank
  union select conv, 'conflict' from shape where coalesce(conflict, false)
  union select conv, 'one_speaker' from shape where one
  union select conv, 'missing_turn' from k where not exists (select 1 from n where n.conv = k.conv and n.turn = k.turn)
  union select conv, 'context' from k where len(c) <> least(turn, 3)
  union select conv, 'context' from placed p where not exists (select 1 from told d where d.conv = p.conv and d.turn = p.at
      and regexp_replace(d.said, '\s+', ' ', 'g') = p.said))
"""

_SAMPLES = r"""
with s as (
  select distinct sample_id,
    case lower(regexp_replace(dataset_name, '[\s_-]+', '', 'g')) when 'iemocap' then 'iemocap' when 'meld' then 'meld'
      when 'msppodcast' then 'msp_podcast' when 'ravdess' then 'ravdess' end as corpus,
    case when lower(regexp_replace(split, '^\s+|\s+$', '', 'g')) = 'train' then 'train'
      when lower(regexp_replace(split, '^\s+|\s+$', '', 'g')) in ('val', 'validation', 'dev', 'development') then 'val'
      when lower(regexp_replace(split, '^\s+|\s+$', '', 'g')) in ('test', 'test1', 'test2') then 'test' end as part,
    lower(regexp_replace(categorical_emotion, '^\s+|\s+$', '', 'g')) as category,
    lower(regexp_replace(speaker_id, '^\s+|\s+$', '', 'g')) as speaker
  from emotion_samples where sample_id is not null)
"""
_RATINGS = r"""
with t as (
  select case lower(regexp_replace(dataset_name, '[\s_-]+', '', 'g')) when 'msppodcast' then 7.0::double when 'iemocap' then 5.0::double end as top,
    lower(regexp_replace(dataset_name, '[\s_-]+', '', 'g')) as corpus, utterance_id as item,
    upper(regexp_replace(annotator_id, '^\s+|\s+$', '', 'g')) as person, valence, arousal, labelled_at, loaded_at from vad_annotations),
ok as (
  select * from t where person <> '' and item is not null and top is not null and valence::varchar <> 'nan' and arousal::varchar <> 'nan'
    and valence between 1 and top and arousal between 1 and top
  qualify row_number() over (partition by corpus, item, person order by labelled_at desc nulls last, loaded_at desc nulls last, valence desc, arousal desc) = 1),
r as (select corpus, item, person, 1 + (valence - 1) * 4 / (top - 1) as v, 1 + (arousal - 1) * 4 / (top - 1) as a from ok),
o as (
  select person, v, a, count(*) over w as n, (sum(v) over w - v) / (count(*) over w - 1) as ov, (sum(a) over w - a) / (count(*) over w - 1) as oa
  from r window w as (partition by corpus, item)),
c as (
  select person, count(*) as n, coalesce(case when isnan(corr(v, ov)) then 0 else corr(v, ov) end, 0) as rv, coalesce(case when isnan(corr(a, oa)) then 0 else corr(a, oa) end, 0) as ra
  from o where n > 1 group by person)
"""

SQL = {
    "p1_found": _TURNS + "select distinct conv as dialogue_id from bad",
    "p1_reasons": _TURNS + "select conv as dialogue_id, reason from bad",
    "p1_conversations": _TURNS
    + """, r as (select distinct conv, turn, array_to_string(list_transform(string_split(spk, ' '), lambda x: upper(x[1]) || x[2:]), ' ') as speaker, txt as text from t where conv not in (select conv from bad)),
      f as (select conv, speaker, min(turn) as first from r group by 1, 2), g as (select conv, speaker, 'speaker_' || row_number() over (partition by conv order by first, speaker) as role from f)
      select conv as dialogue_id, turn, role, speaker, text from r join g using (conv, speaker)""",
    "p2_found": _SAMPLES
    + """select dataset_name, categorical_emotion from target_shares t
      where (select count(*) from s where s.corpus = t.dataset_name and s.category = t.categorical_emotion) < greatest(min_rows, round(target_share * sample_rows))""",
    "p3_files": _SAMPLES.replace("from emotion_samples where", r""", nullif(regexp_replace(lower(regexp_extract(regexp_replace(audio_path, '^\s+|\s+$', '', 'g'), '([^/\\]*)$', 1)), '[.](wav|flac|mp3)$', ''), '') as file from emotion_samples where""")
    + """, f as (select distinct sample_id, corpus, file, part = 'train' as t from s where corpus is not null and file is not null and part is not null),
      n as (select *, count(*) filter (t) over w as n_train, count(*) filter (not t) over w as n_held from f window w as (partition by corpus, file))
      select distinct sample_id, corpus as dataset_name, file, case when t then n_held else n_train end as n_links from n where n_train > 0 and n_held > 0""",
    "p5_found": _SAMPLES
    + """select corpus as dataset_name, speaker as speaker_id from s
      where corpus is not null and part is not null and speaker not in ('', 'unknown', 'n/a') group by 1, 2 having count(distinct part) > 1""",
    "p7_found": _RATINGS + "select person as annotator_id from c where n >= 30 and (rv + ra) / 2 < 0.35",
    "p7_agreement": _RATINGS + "select person as annotator_id, n as n_shared, round(rv, 6) as r_valence, round(ra, 6) as r_arousal from c",
    "p8_round_trip": "select doc_id, coalesce(text, '') as text from documents",
}
