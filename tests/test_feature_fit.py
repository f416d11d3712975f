"""What the statistics of feature_texts are fitted on."""

from pyspark.sql import functions as F

from timbrel.operators import normalize
from timbrel.plans import pipelines
from timbrel.taxonomy import SCALARS


def test_fitted_on_all_speakers_and_utterances(spark, monkeypatch):
    clips = spark.range(60 * 7).select(F.format_string("u%04d", "id").alias("utterance_id"), F.format_string("s%02d", F.floor(F.col("id") / 7)).alias("speaker_id"), *(((F.col("id") * 37 + i) % 101).cast("double").alias(n) for i, n in enumerate(SCALARS)), F.lit(None).cast("string").alias("error"))
    monkeypatch.setattr(pipelines.signal, "extract", lambda clips, keep: clips)
    seen, stats = [], normalize.speaker_stats
    monkeypatch.setattr(normalize, "speaker_stats", lambda fit: seen.append(fit) or stats(fit))
    fitted = lambda: seen[-1].agg(F.count_distinct("speaker").alias("s"), F.count_distinct("utterance_id").alias("u")).first()

    pipelines.feature_texts(clips)
    assert tuple(fitted()) == (60, 420)
    pipelines.feature_texts(clips, per_speaker=5, speakers=50)
    assert tuple(fitted()) == (50, 250)
    pipelines.feature_texts(clips, per_speaker=5)
    assert tuple(fitted()) == (60, 300)
    pipelines.feature_texts(clips, speakers=50)
    assert tuple(fitted()) == (50, 350)
