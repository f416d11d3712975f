import pandas as pd
from pyspark.sql import functions as F

from timbrel.operators import inference, scoring, signal
from timbrel.plans import pipelines
from timbrel.rubric import NAMES


def clips(spark):
    return signal.synthetic(spark, 6).select(F.concat(F.lit("u"), F.col("clip_id").cast("string")).alias("utterance_id"), F.when(F.col("clip_id") < 3, "a").otherwise("b").alias("speaker_id"), "content")


def prepared(spark, text=None):
    s = clips(spark).select("utterance_id", F.lit("x.wav").alias("audio_path"), F.lit("Hello.").alias("transcript"), F.array(F.lit("[A] Hi.")).alias("context_turns"))
    cols = scoring.oracle_scores(F.lit(4.0), F.lit(2.0), F.lit("meld"), F.lit("sad"), F.lit(""), F.lit(True))
    oracle = F.struct(*(c.alias(n) for n, c in cols.items())).alias("oracle")
    f = text if text is not None else s.select("utterance_id", F.lit("features").alias("features"))
    return s.join(f, "utterance_id").select("*", oracle)


def judge(good_on):
    """Answers evidence with JSON and judgments with the scores in the prompt, off target before attempt ``good_on``."""
    def run(batches):
        for pdf in batches:
            out = []
            for p in pdf["prompt"]:
                if "[SCORES]" not in p:
                    out.append('```json\n{"detected_cues": "a held pause"}\n```')
                    continue
                attempt = len(p) - len(p.rstrip(" "))
                target = {n: p.split(f"  {n}: ")[1].split("\n")[0] for n in NAMES}
                off = 0 if attempt >= good_on else 2
                out.append("[REASONING]\nIt fits.\n[SCORES]\n" + "\n".join(f"{n}: {float(v) - off}" for n, v in target.items()))
            yield pdf.assign(response=out)

    return run


def test_features_to_text(spark):
    for space in ("raw", "z"):
        rows = pipelines.feature_texts(clips(spark), space).collect()
        assert len(rows) == 6 and all(r.features.startswith(f"=== Acoustic Features for Utterance: {r.utterance_id}") and "F1 mean: " in r.features for r in rows)


def test_synthesis_verifies_and_retries(spark, tmp_path):
    rows = pipelines.synthesize(prepared(spark), judge(1)).collect()
    assert len(rows) == 6 and {(r.attempt, r.forced, r.is_fallback) for r in rows} == {(2, False, False)}
    assert "Detected Cues: a held pause" in rows[0].target_output and rows[0].target_output.endswith("overall_emotional_quality: 3.5") and rows[0].reasoning == "It fits."
    assert rows[0].target_output.count("\n## ") == 7
    forced = pipelines.synthesize(prepared(spark), judge(9))
    assert {(r.attempt, r.forced, r.n_matched) for r in forced.collect()} == {(3, True, 0)} or all(r.forced for r in forced.collect())
    assert all(r.scores == r.oracle_scores for r in forced.collect())
    pipelines.write_synthesis(forced, str(tmp_path))
    stats = spark.read.json(f"{tmp_path}/synthesis_stats.json").first()
    assert stats.n_samples == 6 and stats.forced_rate == 1.0 and stats.oracle_match_rate == 1.0
    assert spark.read.json(f"{tmp_path}/sft_training_data.jsonl").count() == 6


def test_an_outage_is_marked(spark):
    def silent(batches):
        for pdf in batches:
            yield pdf.assign(response="")

    rows = pipelines.synthesize(prepared(spark), silent, batch=True).collect()
    assert all(r.is_fallback and not r.forced and r.scores == r.oracle_scores and r.reasoning == "" for r in rows)


def test_prediction(spark):
    s = prepared(spark).select("utterance_id", "transcript", "context_turns")
    rows = inference.predict(s, k=4).collect()
    assert len(rows) == 6 and all(r.k_samples == 4 and 0 <= r.best_sample_idx < 4 and r.evidence == "stand-in" for r in rows)
    assert {r.dimension for r in inference.report(inference.predict(s, k=2)).collect()} == set(NAMES)


def test_summary_of_known_samples(spark):
    text = lambda v: "[EVIDENCE]\ne\n[REASONING]\nr%s\n[SCORES]\nvalence_accuracy: %s" % (v, v)
    df = spark.createDataFrame(pd.DataFrame({"id": ["u"] * 4, "k": [0, 1, 2, 3], "response": [text(1), text(3), text(5), "none"]}))
    r = inference.summarize(df).first()
    assert r.scores.valence_accuracy == 3.0 and r.best_sample_idx == 1 and r.reasoning == "r3" and abs(r.score_stds.valence_accuracy - 1.414) < 1e-9 and r.scores.arousal_accuracy == 3.0
