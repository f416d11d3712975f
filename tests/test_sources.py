import json

import pytest
from pyspark.sql import functions as F

from timbrel.operators import samples, sft
from timbrel.sources import corpora, jsonl
from timbrel.streaming import scoring as streaming


@pytest.fixture(scope="module")
def acted(tmp_path_factory):
    root = tmp_path_factory.mktemp("acted")
    for actor in (1, 2, 21):
        d = root / "audio" / f"Actor_{actor:02d}"
        d.mkdir(parents=True)
        for e in ("01", "03", "04", "99"):
            for i in ("01", "02"):
                (d / f"03-01-{e}-{i}-01-01-{actor:02d}.wav").write_bytes(b"RIFF")
        (d / f"02-01-03-01-01-01-{actor:02d}.wav").write_bytes(b"RIFF")
        (d / f"03-02-03-01-02-01-{actor:02d}.wav").write_bytes(b"RIFF")
        (d / "odd-name.wav").write_bytes(b"RIFF")
    return str(root)


def test_acted_corpus(spark, acted):
    df = corpora.read_acted(spark, acted)
    assert df.count() == 16
    rows = df.orderBy("ordinal").collect()
    assert rows[0].speaker_id == "Actor_01" and rows[0].gender == "M" and rows[-1].speaker_id == "Actor_02"
    assert rows[0].transcript == "Kids are talking by the door." and {r.categorical_emotion for r in rows} == {"neutral", "happy", "sad", "other"}
    assert corpora.read_acted(spark, acted, speech_only=False).count() == 18
    assert corpora.read_acted(spark, acted, include_neutral=False).count() == 12
    assert corpora.read_acted(spark, acted, "val").count() == 8
    assert corpora.read_acted(spark, acted, max_samples=3).count() == 3
    assert corpora.read_acted(spark, acted + "/audio/Actor_01").count() == 0


@pytest.fixture(scope="module")
def dyadic(tmp_path_factory):
    root = tmp_path_factory.mktemp("dyadic")
    base = root / "Session1" / "dialog"
    (base / "EmoEvaluation").mkdir(parents=True)
    (base / "transcriptions").mkdir()
    (base / "EmoEvaluation" / "Ses01F_impro01.txt").write_text(
        "% header\n[6.0 - 8.5]\tSes01F_impro01_M000\texc\t[2.5, 3.5, 4.0]\n[1.0 - 2.0]\tSes01F_impro01_F000\tneu\t[2.0, 2.5, 3.0]\nC-E1:\tNeutral\n"
    )
    (base / "EmoEvaluation" / "Ses01F_script01_1.txt").write_text("[1.0 - 2.0]\tSes01F_script01_1_F000\tzzz\t[2.0, 2.5, 3.0]\n")
    (base / "transcriptions" / "Ses01F_impro01.txt").write_text("; note\nSes01F_impro01_F000 [001.0-002.0]: Old.\nSes01F_impro01_F000 [001.0-002.0]: Hello there.\n")
    return str(root)


def test_dyadic_corpus(spark, dyadic):
    rows = corpora.read_dyadic(spark, dyadic).orderBy("ordinal").collect()
    assert [r.utterance_id for r in rows] == ["Ses01F_impro01_F000", "Ses01F_impro01_M000", "Ses01F_script01_1_F000"]
    assert rows[0].transcript == "Hello there." and rows[1].context_turns == ["[S01_F] Hello there."] and rows[0].context_turns == []
    assert rows[1].categorical_emotion == "happy" and rows[2].categorical_emotion == "other" and rows[1].duration_sec == 2.5
    assert rows[2].metadata["dialog_id"] == "Ses01F_script01_1" and rows[0].vad_annotations[0].valence == 2.0
    assert corpora.read_dyadic(spark, dyadic, include_scripted=False).count() == 2
    assert corpora.read_dyadic(spark, dyadic, merge_excited=False, emotions=["excited"]).count() == 1
    parity = corpora.read_dyadic(spark, dyadic, parity=True).collect()
    assert {r.gender for r in parity} == {"M"}
    assert corpora.read_dyadic(spark, dyadic, "test").count() == 0


@pytest.fixture(scope="module")
def podcast(tmp_path_factory):
    root = tmp_path_factory.mktemp("podcast")
    (root / "Partitions").mkdir()
    (root / "Labels").mkdir()
    (root / "Partitions" / "partition.txt").write_text("a; Train\nb,Train\nc Test1\nd;Train\na;Development\nx\n")
    (root / "Labels" / "labels_consensus.csv").write_text("FileName,EmoClass,Valence,Arousal,Dominance,NumAnnotators,SpkrID,Gender\na.wav,H,7,4,1,5,1,Male\nb.wav,Q,bad,4,4,3,2,Female\nd.wav,A,1,1,1,2,3,\n")
    (root / "Labels" / "labels_detailed.csv").write_text("FileName,WorkerID,Valence,Arousal,Dominance\nb.wav,w1,1,1,1\nb.wav,w2,7,7,7\n")
    return str(root)


def test_podcast_corpus(spark, podcast):
    rows = corpora.read_podcast(spark, podcast, detailed=True).collect()
    assert [r.utterance_id for r in rows] == ["b"]
    assert rows[0].categorical_emotion == "other" and [v.valence for v in rows[0].vad_annotations] == [3.0, 1.0, 5.0]
    assert [r.utterance_id for r in corpora.read_podcast(spark, podcast, "val").collect()] == ["a"]
    assert corpora.read_podcast(spark, podcast, min_annotators=1).count() == 2
    assert corpora.read_podcast(spark, podcast + "/Labels").count() == 0


@pytest.fixture(scope="module")
def multi_party(tmp_path_factory):
    root = tmp_path_factory.mktemp("multi")
    d = root / "train" / "train_splits"
    d.mkdir(parents=True)
    (d / "dia0_utt1.wav").write_bytes(b"RIFF")
    (root / "train" / "train_sent_emo.csv").write_text(
        "Sr,Utterance,Speaker,Emotion,Sentiment,Dialogue_ID,Utterance_ID,Season,Episode,StartTime,EndTime\n"
        '1,"Hi, ""you"".",Ann, JOY ,positive,0,1,1,2,a,b\n2,First.,Bob,neutral,neutral,0,0,1,2,a,b\n3,Lost.,Bob,anger,negative,x,0,1,2,a,b\n4,Third.,Cid,wow,,0,2,1,2,a,b\n'
    )
    return str(root)


def test_multi_party_corpus(spark, multi_party):
    rows = corpora.read_multi_party(spark, multi_party).orderBy("ordinal").collect()
    assert [r.utterance_id for r in rows] == ["meld_dia0_utt0", "meld_dia0_utt1", "meld_dia0_utt2"]
    assert rows[2].context_turns == ["[Bob] First.", '[Ann] Hi, "you".'] and rows[1].categorical_emotion == "happy" and rows[2].categorical_emotion == "other"
    assert rows[0].metadata["n_speakers"] == "3" and rows[1].audio_path.endswith("dia0_utt1.wav") and rows[0].audio_path == ""
    only = corpora.read_multi_party(spark, multi_party, require_audio=True).collect()
    assert len(only) == 1 and only[0].context_turns == ["[Bob] First."]
    assert corpora.read_multi_party(spark, multi_party, "test").count() == 0


def test_training_files(spark, tmp_path):
    lines = [json.dumps({"utterance_id": f"u{i}", "audio_path": "a.wav" if i else "", "transcript": "t", "context_turns": ["c"], "target_output": f"out {i}", "scores": {"valence_accuracy": 3.0}}) for i in range(12)]
    (tmp_path / "in.jsonl").write_text("\n".join([*lines, "", "{broken", json.dumps({"utterance_id": "none", "target_output": ""})]))
    df = jsonl.read_training(spark, str(tmp_path / "in.jsonl"))
    assert df.count() == 12
    ex = sft.with_split(sft.examples(df, "/data"), "utterance_id", 0.25, 1)
    assert ex.where("utterance_id = 'u1'").first().audios == ["/data/a.wav"] and ex.where("utterance_id = 'u0'").first().audios == []
    jsonl.write_chat(ex, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 9 and spark.read.json(str(tmp_path / "val_out")).count() == 3
    flat = jsonl.flat(ex).where("utterance_id = 'u0'").first()
    assert flat.output == "out 0" and flat.audio_path is None


def test_checkpoint_counts_each_batch_and_row_once(spark, tmp_path):
    path, kind = str(tmp_path / "ck"), "utterance_id string, n int"
    rows = lambda *ids: spark.createDataFrame([(i, 1) for i in ids], kind)
    assert jsonl.read_checkpoint(spark, path, kind)[1] == {"processed": 0, "failed": 0, "n_samples": 0}
    jsonl.append_checkpoint(rows("a", "b", "b"), path, "0", 3, 1)
    jsonl.append_checkpoint(rows("b", "c"), path, "1", 2)
    jsonl.append_checkpoint(rows("c", "d"), path, "1", 2)  # already there
    rows("x").write.json(f"{path}/rows/batch=2")  # broke off before its meta row
    done, meta = jsonl.read_checkpoint(spark, path, kind)
    assert sorted(r.utterance_id for r in done.collect()) == ["a", "b", "c"] and meta == {"processed": 5, "failed": 1, "n_samples": 3}
    jsonl.append_checkpoint(rows("y"), path, "2", 1)
    done, _ = jsonl.read_checkpoint(spark, path, kind)
    assert done.count() == 4
    work = samples.open_work(rows("e", "a", "d", "c", "f"), done, 6, ["utterance_id"])
    assert [r.utterance_id for r in work.collect()] == ["d", "e"] and samples.open_work(rows("e"), done, 3, ["utterance_id"]).count() == 0


def test_label_mask(spark):
    df = spark.createDataFrame([(1, 0, [5, 6], [7]), (2, 0, [5], [7, 8, 9, 10]), (3, 1, None, [1]), (4, 1, [2], None)], "id int, b int, p array<int>, a array<int>")
    got = {r.id: r for r in sft.label_mask(df, "p", "a", "b", 4).collect()}
    assert (got[1].input_ids, got[1].attention_mask, got[1].labels) == ([5, 6, 7, 0], [1, 1, 1, 0], [-100, -100, 7, -100])
    assert (got[2].input_ids, got[2].labels) == ([5, 7, 8, 9], [-100, 7, 8, 9]) and got[3].labels == [1] and got[4].labels == [-100]


def test_streaming_scores(spark, tmp_path):
    src, out, ck = (str(tmp_path / n) for n in ("src", "out", "ck"))
    text = "[SCORES]\noverall_emotional_quality: 4\n"
    row = lambda i: spark.createDataFrame([(f"u{i}", i, text)], "utterance_id string, k int, response string").withColumn("at", F.current_timestamp())
    row(0).write.mode("append").json(src)
    streaming.run_available(streaming.scored(streaming.responses(spark, src)), out, ck)
    row(1).write.mode("append").json(src)
    streaming.run_available(streaming.scored(streaming.responses(spark, src)), out, ck)
    got = spark.read.parquet(out).collect()
    assert len(got) == 2 and {r.n_dims_parsed for r in got} == {1} and got[0].scores.overall_emotional_quality == 4.0
    batch = streaming.windowed_means(spark.read.schema(streaming.RESPONSES).json(src)).collect()
    assert sum(r.n for r in batch) == 2 and batch[0].mean_overall == 4.0
