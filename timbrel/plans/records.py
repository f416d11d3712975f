"""Queries over raw source records (problem 6)."""

from __future__ import annotations

from pyspark.sql import functions as F

from timbrel.session import table
from timbrel.sources import raw_lines as R


def p6_found(spark, sf_dir):
    bad = R.rejects(R.parse_records(table(spark, sf_dir, "raw_lines"))).where("reason <> 'unknown_file'")
    return bad.select("line_id", "reason").distinct()


def p6_dialogue_rows(spark, sf_dir):
    return R.valid_dialogue_rows(R.parse_records(table(spark, sf_dir, "raw_lines")))


def p6_partition_rows(spark, sf_dir):
    return R.valid_partition_rows(R.parse_records(table(spark, sf_dir, "raw_lines")))


def p6_repairs(spark, sf_dir):
    """What each reject lacks: edits of the cheapest repair."""
    bad = R.rejects(R.parse_records(table(spark, sf_dir, "raw_lines")))
    return bad.select("line_id", "kind", "reason", F.col("edit_cost").cast("long").alias("edit_cost"), F.array_join("edits", " ").alias("edits"))


QUERIES = {f.__name__: f for f in (p6_found, p6_dialogue_rows, p6_partition_rows, p6_repairs)}

_FIELD = '"[^"]*(?:""[^"]*)*"|[^",]*'
#: Each raw line with its kind, its quoting state and its fields.
_PARSED = f"""
with raw as (
  select line_id, file_name, coalesce(raw_text, '') as t,
    case when file_name like '%\\_sent\\_emo\\_%.csv' escape '\\' then 'dialogue'
         when regexp_matches(file_name, '(^|/)partition_[^/]*[.]txt$') then 'partition' end as kind
  from raw_lines),
split as (
  select *,
    case when kind = 'dialogue' then not regexp_full_match(t, '(?:{_FIELD})(?:,(?:{_FIELD}))*') else contains(t, '"') end as misquoted,
    case when kind = 'dialogue' then regexp_extract_all(',' || t, ',({_FIELD})', 1)
         when contains(t, ';') then string_split(t, ';')
         when contains(t, ',') then string_split(t, ',')
         else list_filter(regexp_split_to_array(t, '\\s+'), lambda x: x <> '') end as f
  from raw where kind is not null),
fields as (
  select line_id, file_name, kind, misquoted, len(f) as n,
    list_transform(f, lambda x: case when kind = 'dialogue' and x like '"%' then replace(x[2:-2], '""', '"') else x end) as f
  from split),
judged as (
  select *, case when misquoted then 'quoting'
    when n <> case kind when 'dialogue' then 10 else 2 end then 'column_count'
    when kind = 'partition' and trim(f[2], e' \\t\\r\\n') not in ('Train', 'Validation', 'Development', 'Test1', 'Test2', 'Test') then 'invalid_value'
    when kind = 'dialogue' and (
      not regexp_full_match(trim(f[1], e' \\t\\r\\n'), '[0-9]+') or not regexp_full_match(trim(f[2], e' \\t\\r\\n'), '[0-9]+')
      or regexp_full_match(f[3], '\\s*') or regexp_matches(f[3], '[\\x{{FFFD}}\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f-\\x{{9f}}]')
      or lower(trim(f[5], e' \\t\\r\\n')) not in ('neutral', 'joy', 'sadness', 'anger', 'fear', 'disgust', 'surprise'))
      then 'invalid_value' end as reason
  from fields)
"""
SQL = {
    "p6_found": _PARSED + "select distinct line_id, reason from judged where reason is not null",
    "p6_dialogue_rows": _PARSED
    + """select line_id, file_name, cast(trim(f[1]) as bigint) as dialogue_id, cast(trim(f[2]) as bigint) as utterance_id, f[3] as utterance,
      trim(f[4]) as speaker, lower(trim(f[5])) as emotion, lower(trim(f[6])) as sentiment, f[7] as season, f[8] as episode, f[9] as start_time, f[10] as end_time
      from judged where kind = 'dialogue' and reason is null""",
    "p6_partition_rows": _PARSED + "select line_id, file_name, trim(f[1]) as utterance_id, trim(f[2]) as partition from judged where kind = 'partition' and reason is null",
}
