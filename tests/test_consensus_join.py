"""consensus_join counts only utterances with enough valid ratings; the given tables share no ids, so this needs its own."""

import datetime

import pytest

from timbrel.plans import corpus


def at(day):
    return datetime.datetime(2024, 1, day)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("podcast"))
    nan = float("nan")
    lines = [("u1.wav ; Train", 1), ("u2 ; Train", 2), ("u3,Test1", 3), ("u4 ; Train", 4), ("u5 Test1", 5), ("u6 ; Train", 6)]
    spark.createDataFrame([(n, "partition_00.txt", n, t) for t, n in lines], "line_id long, file_name string, line_no int, raw_text string").write.parquet(f"{out}/raw_lines.parquet")
    names = {"u3": "MSP-Podcast"}
    spark.createDataFrame([(n, names.get(n, "msp_podcast"), "H") for n in ("u1", "u2", "u3", "u4", "u5")] + [("u6", "meld", "S")], "utterance_id string, dataset_name string, emotion_raw_label string").write.parquet(f"{out}/emotion_samples.parquet")
    rows = [
        ("u1", "A", 1.0, 2.0, 4.0, 1), ("u1", "b", 4.0, 2.0, nan, 1), ("u1", " c ", 7.0, 2.0, 7.0, 2), ("u1", "C", 1.0, 7.0, 1.0, 1),  # three persons; the later of C counts
        ("u2", "A", 1.0, 1.0, 1.0, 1), ("u2", "B", 2.0, 2.0, 2.0, 1), ("u2", "a", 3.0, 3.0, 3.0, 2),  # two persons
        ("u3", "A", 2.0, 3.0, None, 1), ("u3", "B", 2.0, 3.0, None, 1), ("u3", "C", 2.0, 3.0, None, 1), ("u3", "D", 9.0, 3.0, 2.0, 1),  # the fourth is off the scale
        ("u4", "A", 1.0, 1.0, 1.0, 1), ("u4", "B", nan, 2.0, 2.0, 1), ("u4", None, 3.0, 3.0, 3.0, 2), ("u4", " ", 3.0, 3.0, 3.0, 2), ("u4", "C", None, 1.0, 1.0, 1),  # one valid
    ]  # u5 has no rating; u6 is of another corpus
    rows = [(u, "msp_podcast", p, v, a, d, at(t), at(t)) for u, p, v, a, d, t in rows] + [("u6", "msp_podcast", p, 2.0, 2.0, 2.0, at(1), at(1)) for p in "ABC"]
    spark.createDataFrame(rows, "utterance_id string, dataset_name string, annotator_id string, valence double, arousal double, dominance double, labelled_at timestamp_ntz, loaded_at timestamp_ntz").write.parquet(f"{out}/vad_annotations.parquet")
    return out


WANT = {("u1", "Train", "H", 3.0, 1.666667, 4.0, 3), ("u3", "Test1", "H", 1.666667, 2.333333, None, 3)}


def keys(rows):
    return {tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in rows}


def test_means_of_enough_annotators(spark, folder):
    got = corpus.consensus_ratings(spark, folder)
    assert got.columns == ["utterance_id", "partition", "emotion_raw_label", "valence", "arousal", "dominance", "n_annotators"]
    assert keys(got.collect()) == WANT


def test_sql_of_the_means(folder):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("raw_lines", "emotion_samples", "vad_annotations"):
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    assert keys(con.execute(corpus.SQL["consensus_ratings"]).fetchall()) == WANT


def test_join_counts_only_rated_utterances(spark, folder):
    assert keys(corpus.consensus_join(spark, folder).collect()) == {("Train", "H", 1), ("Test1", "H", 1)}
