import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from timbrel.functions import columns as C
from timbrel.functions import prompts as P
from timbrel.operators import frames, generator, normalize, pairs, samples, scoring, sft, skew
from timbrel.rubric import DIMENSIONS, NAMES


def one(spark, column, text="x"):
    return spark.createDataFrame([(text,)], "t string").select(column.alias("v")).first().v


@pytest.mark.parametrize("text, want", [("4", 4.0), (" 4.5\n", 4.5), (".5", 0.5), ("1e1", 10.0), ("4d", None), ("0x1p2", None), ("1_0", None), ("", None), (None, None), ("nan", None)])
def test_number(spark, text, want):
    assert one(spark, C.number(F.col("t")), text) == want


def test_half_step_and_clamp(spark):
    rows = spark.createDataFrame([(1.25,), (1.75,), (6.0,), (None,)], "x double").select(C.half_step(F.col("x")).alias("h"), C.clamp(F.col("x")).alias("c")).collect()
    assert [r.h for r in rows] == [1.0, 2.0, 6.0, None]
    assert [r.c for r in rows] == [1.25, 1.75, 5.0, None]


def parsed(spark, text):
    df, found = C.with_scores(spark.createDataFrame([(text,)], "t string"), "t")
    return df.select(*(c.alias(n) for n, c in found.items())).first().asDict()


def test_scores_of_a_response(spark):
    text = "junk: 9\nvalence_accuracy: 1\n [SCORES] \nvalence_accuracy: 2\n- Anger: 4\nvalence_accuracy: 9.5\narousal_accuracy: high\narousal_accuracy:  2.5 \n4. Confidence: 3\nno colon"
    got = parsed(spark, text)
    assert got["valence_accuracy"] == 5.0 and got["arousal_accuracy"] == 2.5 and got["emotional_intensity"] is None


@pytest.mark.parametrize("text", [None, "", "no section", "[SCORES]", "[SCORES] \nx", "text [SCORES]\nvalence_accuracy: 3"])
def test_responses_without_scores(spark, text):
    assert set(parsed(spark, text).values()) == {None}


@pytest.mark.parametrize(
    "text, evidence, reasoning",
    [("[EVIDENCE]\na\n[REASONING]\n b \n[SCORES]\nc", "a", "b"), ("[REASONING] b", "", "b"), ("[EVIDENCE] a", "a", ""), ("", "", ""), ("[SCORES]\n[REASONING]x", "", "x")],
)
def test_sections(spark, text, evidence, reasoning):
    s = C.sections(F.col("t"))
    assert (one(spark, s["evidence"], text), one(spark, s["reasoning"], text)) == (evidence, reasoning)


@pytest.mark.parametrize("text, want", [('```json\n{"a": 1}\n```', '{"a": 1}'), ('{"a": 1}', '{"a": 1}'), ("``` {} ```", "``` {}"), ('  ```\n{}```  ', "{}")])
def test_unfenced(spark, text, want):
    assert one(spark, C.unfenced(F.col("t")), text) == want


def test_evidence_json(spark):
    good, bad = '{"issues": "none", "extra": 1}', '{"issues": ' + "x" * 600
    e = lambda t: one(spark, P.parsed_evidence(F.col("t"), C.unfenced(F.col("t"))), t)
    assert (e(good).issues, e(good).strengths, e(good).is_fallback) == ("none", "", False)
    assert e(bad).is_fallback and len(e(bad).emotional_context) == 500 and e(bad).issues == ""


def test_rubric():
    assert len(DIMENSIONS) == 7 and all(len(d.anchors) == 5 for d in DIMENSIONS)
    text = P.rubric_description(("valence_accuracy",))
    assert text.startswith("=== Emotion Evaluation Rubric ===") and "### Valence Accuracy" in text and "### Arousal Accuracy" not in text


def test_prompts_have_context_only_if_there_is_any(spark):
    df = spark.createDataFrame([("hi", ["[A] one", "[B] two"]), ("hi", []), ("hi", None), (None, None)], "t string, c array<string>")
    texts = [r[0] for r in df.select(P.user_prompt(F.col("t"), F.col("c"))).collect()]
    assert "  [A] one\n  [B] two\n\n" in texts[0] and "Conversational" not in texts[1] and texts[1] == texts[2] and 'Transcript: ""' in texts[3]


def test_last_turns(spark):
    df = spark.createDataFrame([([str(i) for i in range(n)],) for n in (0, 1, 5)] + [(None,)], "c array<string>")
    assert [r[0] for r in df.select(C.last_turns(F.col("c"), 3)).collect()] == [[], ["0"], ["2", "3", "4"], []]


def test_context_is_never_longer_than_n_and_kept_by_filters(spark):
    df = spark.createDataFrame([(d, i, f"s{i % 2}", f"t{i}") for d in range(3) for i in range(d * 3)], "d int, i int, s string, t string")
    got = frames.context_turns(df, "d", ["i"], "s", "t", 2).where("i % 2 = 1").collect()
    assert all(len(r.context_turns) == min(2, r.i) for r in got)
    assert next(r for r in got if r.d == 2 and r.i == 3).context_turns == ["[s1] t1", "[s0] t2"]


def test_runs_against_a_loop(spark):
    rng = random.Random(5)
    data = [(g, i, rng.random() < 0.6) for g in range(4) for i in range(rng.randrange(0, 40))]
    got = {tuple(r) for r in frames.runs(spark.createDataFrame(data, "g int, i long, f boolean"), "g", "i", F.col("f")).select("g", "start", "stop").collect()}
    want = set()
    for g in range(4):
        flags = [f for h, _, f in data if h == g] + [False]
        start = None
        for i, f in enumerate(flags):
            if f and start is None:
                start = i
            if not f and start is not None:
                want.add((g, start, i))
                start = None
    assert got == want


def test_sliding_windows_keep_empty_ones(spark):
    ev = spark.createDataFrame([("a", 0.2), ("a", 1.0), ("a", 3.9), ("b", 0.1)], "g string, t double")
    sp = spark.createDataFrame([("a", 4.0), ("b", 0.5)], "g string, d double")
    got = {(r.g, r.start): r.n for r in frames.sliding_counts(ev, sp, "g", "t", "d").collect()}
    want = {("a", s): sum(s <= t < s + 1 for t in (0.2, 1.0, 3.9)) for s in np.arange(0, 3, 0.5)}
    assert got == want


def test_normalisation_and_bins(spark):
    rng = np.random.default_rng(1)
    data = [(i, f"s{i % 3}", "f", float(v)) for i, v in enumerate(rng.normal(size=200))] + [(999, "new", "f", 2.5)]
    long = spark.createDataFrame(data, "id int, speaker string, feature string, value double")
    stats = normalize.speaker_stats(long.where("speaker <> 'new'"))
    z = normalize.znorm(long, stats)
    assert z.where("id = 999").first().z == 2.5
    own = np.array([v for i, s, _, v in data if s == "s1"])
    assert abs(z.where("id = 1").first().z - (data[1][3] - own.mean()) / (own.std() + 1e-8)) < 1e-9
    cuts = normalize.quantile_cuts(z.where("speaker <> 'new'"), "z")
    bins = normalize.discretize(z, cuts).orderBy("z").toPandas()
    order = {b: i for i, b in enumerate(normalize.BINS)}
    assert bins["bin"].map(order).is_monotonic_increasing
    got = np.searchsorted(cuts.first().cuts, bins["z"])
    assert (bins["bin"].map(order).to_numpy() == got).all()
    assert normalize.discretize(z, cuts.limit(0)).select("bin").distinct().first().bin == "medium"


def test_pairs_are_last_wins_and_need_both(spark):
    rows = [(1, "A", "s", "r", "i", "happy", "u1"), (2, "A", "s", "r", "i", "happy", "u2"), (3, "A", "s", "r", "i", "sad", "u3"), (4, "B", "s", "r", "i", "sad", "u4")]
    df = spark.createDataFrame(rows, "ordinal int, speaker_id string, statement string, repetition string, intensity string, categorical_emotion string, utterance_id string")
    got = pairs.controlled_pairs(df, "happy", "sad").collect()
    assert [(r.a, r.b) for r in got] == [("u2", "u3")]
    swapped = pairs.controlled_pairs(df, "sad", "happy").collect()
    assert [(r.b, r.a) for r in swapped] == [("u2", "u3")]


def test_verified_attempts(spark):
    df = spark.createDataFrame([("a", 1, 0.9), ("a", 2, 0.5), ("a", 3, 0.1), ("b", 1, 0.9), ("b", 2, 0.8)], "k string, n int, d double")
    assert {tuple(r) for r in scoring.verified_attempts(df, "k", "n", "d").collect()} == {("a", 2, False), ("b", 2, True)}


def test_best_sample_is_the_first_nearest(spark):
    df = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 3.0), ("a", 2, 3.0), ("a", 3, 5.0)], "k string, i int, s double")
    assert scoring.k_best(df, "k", "i", ("s",)).first().best == 1
    a = scoring.k_average(df, "k", ("s",)).first()
    assert a.s == 3.0 and abs(a.s_std - 1.414) < 1e-9


def test_acted_oracle_scores(spark):
    df = spark.createDataFrame([(None, None, "ravdess", "happy", "normal"), (None, None, "ravdess", "happy", "strong"), (4.4, 5.0, "meld", "sad", ""), (4.4, 5.0, "x", None, None)], "v double, a double, d string, e string, i string")
    cols = scoring.oracle_scores(*(F.col(c) for c in "vadei"), F.lit(False))
    rows = df.select(*(c.alias(n) for n, c in cols.items())).collect()
    assert [r.overall_emotional_quality for r in rows[:2]] == [3.5, 3.5]
    assert [r.emotional_intensity for r in rows] == [3.0, 4.0, 5.0, 5.0]
    assert rows[2].valence_accuracy == 4.5 and rows[3].emotional_appropriateness == 3.0
    assert all(1 <= r[n] <= 5 for r in rows for n in NAMES)


def test_agreement_of_one_rater(spark):
    df = spark.createDataFrame([("a", 2.0), ("b", 1.0), ("b", 5.0)], "k string, s double")
    assert {r.k: r.s for r in scoring.agreement(df, "k", ("s",)).collect()} == {"a": 1.0, "b": pytest.approx(1 - 4 / (4 + 1e-8))}


@pytest.mark.parametrize("n, ratio, held", [(10, 0.5, 0), (11, 0.5, 5), (200, 0.1, 20), (200, 0.0, 0), (0, 0.1, 0)])
def test_split_is_exact_and_stable(spark, n, ratio, held):
    df = spark.range(n)
    a = sft.with_split(df, "id", ratio, 42)
    assert a.count() == n and a.where("is_val").count() == held
    assert a.where("is_val").collect() == sft.with_split(df.repartition(3), "id", ratio, 42).where("is_val").orderBy("id").collect() or held


def test_hot_join_keeps_every_row(spark):
    big = spark.createDataFrame([(0, i) for i in range(500)] + [(i, i) for i in range(1, 60)] + [(None, 1)], "k int, v int")
    small = big.where("k is not null").groupBy("k").agg(F.count("*").alias("rows"))
    got = skew.hot_join(big, small, ["k"], least=100)
    assert got.count() == 559 and got.where("k = 0").count() == 500
    assert set(got.columns) == {"k", "v", "rows"}
    assert skew.hot_join(big, small.limit(0), ["k"]).count() == 0


def test_filters(spark):
    df = spark.createDataFrame([(1, "happy", "a", 0.0), (2, "sad", "", 0.2), (3, None, None, 40.0), (4, "happy", "b", 30.0)], "id int, categorical_emotion string, speaker_id string, duration_sec double")
    assert [r.id for r in samples.duration_band(df).collect()] == [1, 4]
    assert samples.by_emotion(df, []).count() == 0
    assert sorted(r.speaker for r in samples.speakers(df).collect()) == ["a", "b"]
    assert samples.first_n(df, 0, ["id"]).count() == 4 and samples.first_n(df, 2, ["id"]).count() == 2
    assert samples.at_index(df, 2, ["id"]).first().id == 3 and samples.at_index(df, -1, ["id"]).count() == 0


def test_retrying_generator():
    calls = []

    def flaky(prompt):
        calls.append(prompt)
        if prompt == "never" or len(calls) < 3:
            raise OSError
        return prompt.upper()

    waits = []
    run = generator.with_retry(flaky, tries=3, delay=1, sleep=waits.append)
    out = next(run(iter([pd.DataFrame({"prompt": ["ok", "never"]})])))
    assert out["response"].tolist() == ["OK", ""] and waits == [1, 2, 1, 2]


def test_mock_samples_are_stable(spark):
    df = spark.createDataFrame([("a", "p"), ("b", "q")], "id string, prompt string")
    a, b = (sorted(map(tuple, generator.generate(df, "id", "prompt", k=3).collect())) for _ in range(2))
    assert a == b and len(a) == 6


def test_outer_white_space_is_what_unicode_counts(spark):
    import sys

    from timbrel.functions.columns import WHITE_SPACE, outer

    assert {c for c in map(chr, range(sys.maxunicode + 1)) if c.isspace()} - set(WHITE_SPACE) == set("\x1c\x1d\x1e\x1f") and all(c.isspace() for c in WHITE_SPACE)
    df = spark.createDataFrame([(f"{c}a {c} b{c}{c}",) for c in WHITE_SPACE] + [("",), (WHITE_SPACE,), (None,), ("\u200b x",)], "t string")
    got = [r[0] for r in df.select(outer("t")).collect()]
    assert got[-4:] == ["", "", None, "\u200b x"] and all(x == f"a {c} b" for x, c in zip(got, WHITE_SPACE))
    assert df.where(F.regexp_replace("t", r"(?U)^\s+|\s+$", "") != outer("t")).count() == 0
