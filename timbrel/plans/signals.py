"""Queries of feature normalisation and of signal operators.

Embeddings stand for speakers' feature vectors, event streams for energy frames; clips
are synthetic, as the test tables hold no audio.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from timbrel.functions.prompts import FEATURE_LINES, feature_text
from timbrel.operators import frames, normalize, samples, signal
from timbrel.session import table
from timbrel.taxonomy import BINS, SCALARS


def _long(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("string").alias("speaker"), "embedding")
    return normalize.long_features(e, ["vec_id", "speaker"], "embedding", SCALARS)


def _z(spark, sf_dir):
    long = _long(spark, sf_dir)
    return normalize.znorm(long, normalize.speaker_stats(long))


def speaker_stats(spark, sf_dir):
    s = normalize.speaker_stats(_long(spark, sf_dir))
    return s.select("speaker", "feature", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


def znorm(spark, sf_dir):
    return _z(spark, sf_dir).select("vec_id", "feature", F.round("z", 5).alias("z"))


def quantile_cuts(spark, sf_dir):
    c = normalize.quantile_cuts(_long(spark, sf_dir))
    return c.select("feature", F.posexplode("cuts").alias("i", "cut")).select("feature", F.col("i").cast("long").alias("i"), F.round("cut", 6).alias("cut"))


def _counts(df):
    return df.groupBy("feature", "bin").agg(F.count("*").alias("n"))


def discretize_raw(spark, sf_dir):
    """Cut points of raw values against normalised values, which is the default of the method."""
    return _counts(normalize.discretize(_z(spark, sf_dir), normalize.quantile_cuts(_long(spark, sf_dir))))


def discretize_z(spark, sf_dir):
    z = _z(spark, sf_dir)
    return _counts(normalize.discretize(z, normalize.quantile_cuts(z, "z")))


def fit_sample(spark, sf_dir):
    """The first five vectors of the first fifty speakers, on which statistics are fitted."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.col("label").cast("string").alias("speaker"))
    return samples.first_per_group(e, "speaker", ["vec_id"], 5, 50)


def feature_means(spark, sf_dir):
    """Means of per-segment arrays, 0 of an empty one."""
    e = table(spark, sf_dir, "embeddings")
    mean = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double")) / F.size("embedding")
    return e.select("vec_id", F.round(F.when(F.size("embedding") > 0, mean).otherwise(0.0), 5).alias("mean"))


def _frames(spark, sf_dir):
    """Events of a user in time order as energy frames: a running number and the value."""
    e = table(spark, sf_dir, "events").where("user_id is not null")
    return e.selectExpr("user_id", "ts", "value", "cast(row_number() over (partition by user_id order by ts, event_id) - 1 as bigint) as i")


def pauses(spark, sf_dir):
    """Low-value runs of at least two events."""
    return frames.runs(_frames(spark, sf_dir), "user_id", "i", F.col("value") <= 50).where("length >= 2").select("user_id", "start", "stop", "length")


def segments(spark, sf_dir):
    """Runs above the user's 40 % point; the whole stream where there is none."""
    f = _frames(spark, sf_dir)
    cut = f.groupBy("user_id").agg(F.percentile("value", F.lit(0.4)).alias("cut"), F.count("*").alias("n"))
    joined = f.join(cut, "user_id")
    r = frames.runs(joined, "user_id", "i", F.col("value") > F.col("cut"))
    return cut.join(r, "user_id", "left").select("user_id", F.coalesce("start", F.lit(0)).alias("start"), F.coalesce("stop", "n").alias("stop"))


def temporal(spark, sf_dir):
    """Mean pause length and pauses per event."""
    p = pauses(spark, sf_dir).groupBy("user_id").agg(F.avg("length").alias("m"), F.count("*").alias("k"))
    n = _frames(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n"))
    return n.join(p, "user_id", "left").select("user_id", F.round(F.coalesce("m", F.lit(0.0)), 6).alias("pause_mean"), F.round(F.coalesce("k", F.lit(0)) / F.greatest("n", F.lit(0.1)), 6).alias("pause_frequency"))


def _days(spark, sf_dir):
    e = table(spark, sf_dir, "events").where("user_id is not null and ts is not null")
    return e.select("user_id", ((F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lit("2024-01-01 00:00:00").cast("timestamp"))) / F.lit(86400e6)).alias("day"))


def local_rate(spark, sf_dir):
    """Events in one-day windows every half day, empty windows included, and the spread of their rates."""
    d = _days(spark, sf_dir)
    span = d.groupBy("user_id").agg(F.ceil(F.max("day")).cast("double").alias("duration"))
    counts = frames.sliding_counts(d, span, "user_id", "day", "duration")
    r = frames.rate_variation(counts, "user_id")
    return r.select("user_id", F.round("rate_std", 6).alias("rate_std"), "n_windows")


def tilt_slope(spark, sf_dir):
    """Slope of value over log2 of a frame's place, as a spectral tilt is."""
    f = _frames(spark, sf_dir).where("i > 0")
    return f.groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.regr_slope("value", F.log2("i")), 5).alias("slope")).where("n >= 2").select("user_id", "slope")


def vowel_space(spark, sf_dir):
    """Half the product of two 10-90 % ranges, 0 below ten values."""
    e = table(spark, sf_dir, "embeddings").select("label", F.col("embedding")[14].cast("double").alias("f1"), F.col("embedding")[15].cast("double").alias("f2"))
    p = lambda c, q: F.percentile(c, F.lit(q))
    area = 0.5 * (p("f1", 0.9) - p("f1", 0.1)) * (p("f2", 0.9) - p("f2", 0.1))
    return e.groupBy("label").agg(F.round(F.when(F.count("*") < 10, 0.0).otherwise(area), 6).alias("area"))


def feature_block(spark, sf_dir):
    """The feature text of every vector, with bin labels."""
    z = _z(spark, sf_dir)
    binned = normalize.discretize(z, normalize.quantile_cuts(z, "z"))
    pairs = F.collect_list(F.struct("feature", "value", "bin"))
    per = binned.groupBy("vec_id").agg(pairs.alias("x"))
    values = F.map_from_arrays(F.transform("x", lambda e: e["feature"]), F.transform("x", lambda e: F.floor(F.abs(e["value"]) * 8) / 8))
    labels = F.map_from_arrays(F.transform("x", lambda e: e["feature"]), F.transform("x", lambda e: e["bin"]))
    return per.select("vec_id", feature_text(F.col("vec_id").cast("string"), values, labels).alias("text"))


def frame_rms(spark, sf_dir):
    f = signal.frame_energy(signal.synthetic(spark), ["clip_id"])
    return f.select("clip_id", "frame", F.round("db", 6).alias("db"))


def clip_pauses(spark, sf_dir):
    """Pauses of synthetic clips by the run operator over frame energies."""
    f = signal.frame_energy(signal.synthetic(spark), ["clip_id"])
    r = frames.runs(f, "clip_id", "frame", F.col("db") <= signal.SILENCE_DB)
    return r.select("clip_id", F.round(F.col("length") * signal.HOP / signal.RATE, 4).alias("seconds")).where(F.col("seconds") >= signal.MIN_PAUSE)


def clip_features(spark, sf_dir):
    """Prosody, voice quality, temporal and formant scalars of synthetic clips."""
    return signal.extract(signal.synthetic(spark), ["clip_id", "f0"])


_FN = (
    speaker_stats, znorm, quantile_cuts, discretize_raw, discretize_z, fit_sample, feature_means, pauses, segments, temporal, local_rate, tilt_slope, vowel_space, feature_block,
    frame_rms, clip_pauses, clip_features,
)
QUERIES = {f.__name__: f for f in _FN}

_L = "with names as (select unnest([" + ", ".join(f"'{n}'" for n in SCALARS) + f"""]) as feature, unnest(range(1, {len(SCALARS) + 1})) as i),
l as (select vec_id, label::varchar as speaker, feature, embedding[i]::double as value from embeddings, names),
st as (select speaker, feature, avg(value) as mean, stddev_pop(value) + 1e-8 as std from l group by 1, 2),
z as (select l.*, (value - mean) / std as z from l join st using (speaker, feature))
"""
_BIN = "case " + " ".join(f"when len(list_filter(cuts, lambda c: c < z)) = {i} then '{b}'" for i, b in enumerate(BINS)) + " end"
_CUTS = ", cu as (select feature, quantile_cont({0}, [0.2, 0.4, 0.6, 0.8]) as cuts from z group by 1)"
_E = "with f as (select user_id, value, row_number() over (partition by user_id order by ts, event_id) - 1 as i from events where user_id is not null)\n"
_RUN = ", {1} as (select user_id, min(i) as start, max(i) + 1 as stop, count(*) as length from (select user_id, i, i - row_number() over (partition by user_id order by i) as g from {2} where {0}) group by user_id, g)"


def _line(name: str, before: str, places: int, factor: int, after: str, label: str) -> str:
    v = f"printf('%.{places}f', round_even((floor(max(abs(value)) filter (feature = '{name}') * 8) / 8) * {factor}, {places}))"
    return f"chr(10) || '  {label}: ' || max(bin) filter (feature = '{name}') || ' ({before}' || {v} || '{after})'"


_TEXT = "'=== Acoustic Features for Utterance: ' || vec_id || ' ===' || chr(10)"
for _head, _label, _name, _before, _places, _factor, _after in FEATURE_LINES:
    if _head:
        _TEXT += f" || chr(10) || '{_head}'"
    _TEXT += " || " + _line(_name, _before, _places, _factor, _after, _label)
    if _name in ("duration_mean", "spectral_tilt", "pause_frequency"):
        _TEXT += " || chr(10)"
SQL = {
    "speaker_stats": _L + "select speaker, feature, round(mean, 6) as mean, round(std, 6) as std from st",
    "znorm": _L + "select vec_id, feature, round(z, 5) as z from z",
    "quantile_cuts": _L + _CUTS.format("value") + " select feature, unnest(range(4)) as i, round(unnest(cuts), 6) as cut from cu",
    "discretize_raw": _L + _CUTS.format("value") + f" select feature, {_BIN} as bin, count(*) as n from z join cu using (feature) group by 1, 2",
    "discretize_z": _L + _CUTS.format("z") + f" select feature, {_BIN} as bin, count(*) as n from z join cu using (feature) group by 1, 2",
    "fit_sample": """with s as (select distinct label::varchar as speaker from embeddings order by 1 limit 50)
      select label::varchar as speaker, vec_id from embeddings where label::varchar in (select speaker from s) qualify row_number() over (partition by label order by vec_id) <= 5""",
    "feature_means": "select vec_id, round(coalesce(list_avg(list_transform(embedding, lambda x: x::double)), 0), 5) as mean from embeddings",
    "pauses": _E + _RUN.format("value <= 50", "r", "f") + " select user_id, start, stop, length from r where length >= 2",
    "segments": _E + ", c as (select user_id, quantile_cont(value, 0.4) as cut, count(*) as n from f group by 1), g as (select f.*, cut from f join c using (user_id))" + _RUN.format("value > cut", "r", "g")
    + " select c.user_id, coalesce(start, 0) as start, coalesce(stop, n) as stop from c left join r using (user_id)",
    "temporal": _E + _RUN.format("value <= 50", "r", "f") + """, p as (select user_id, avg(length) as m, count(*) as k from r where length >= 2 group by 1), n as (select user_id, count(*) as n from f group by 1)
      select n.user_id, round(coalesce(m, 0), 6) as pause_mean, round(coalesce(k, 0) / n::double, 6) as pause_frequency from n left join p using (user_id)""",
    "local_rate": """with d as (select user_id, (epoch_us(ts) - epoch_us(timestamp '2024-01-01 00:00:00')) / 86400e6 as day from events where user_id is not null and ts is not null),
      s as (select user_id, ceil(max(day)) as duration from d group by 1), w as (select user_id, unnest(range(0, ceil((duration - 1) / 0.5)::bigint)) as i from s where duration > 1),
      c as (select w.user_id, w.i, count(d.day) as n from w left join d on d.user_id = w.user_id and d.day >= w.i * 0.5::double and d.day < w.i * 0.5::double + 1 group by 1, 2)
      select user_id, round(stddev_pop(n), 6) as rate_std, count(*) as n_windows from c group by 1""",
    "tilt_slope": _E + "select user_id, round(regr_slope(value, log2(i)), 5) as slope from f where i > 0 group by 1 having count(*) >= 2",
    "vowel_space": "select label, round(case when count(*) < 10 then 0 else 0.5 * (quantile_cont(embedding[15]::double, 0.9) - quantile_cont(embedding[15]::double, 0.1)) * (quantile_cont(embedding[16]::double, 0.9) - quantile_cont(embedding[16]::double, 0.1)) end, 6) as area from embeddings group by 1",
    "feature_block": _L + _CUTS.format("z") + f", b as (select vec_id, feature, value, {_BIN} as bin from z join cu using (feature)) select vec_id, {_TEXT} as text from b group by vec_id",
}
