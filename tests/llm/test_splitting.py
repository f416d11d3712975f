import random

from timbrel.llm import splitting as S

SMP = "sample_id long, dataset_name string, split string, speaker_id string, audio_path string, component int"
TGT = "split_name string, target_share double, tolerance double"
TARGETS = [("train", 0.8, 0.02), ("val", 0.1, 0.02), ("test", 0.1, 0.02), ("none", None, None)]


def test_torn_speakers(spark):
    rows = [(1, "meld", "train", "Ann ", None), (2, "MELD", "Test1", " ann", None), (3, "meld", "train", "Bob", None), (4, "iemocap", "val", "bob", None), (5, "meld", "train", "unknown", None), (6, "meld", "test", "N/A", None), (7, "meld", "train", "Cid", None), (8, "meld", "odd", "Cid", None), (9, "meld", "val", None, None), (10, None, "val", "Bob", None)]
    df = spark.createDataFrame([(*r, 0) for r in rows], SMP)
    assert [tuple(r) for r in S.torn_speakers(df).collect()] == [("meld", "ann", ["test", "train"])]
    assert S.torn_speakers(df.limit(0)).count() == 0


def corpus(spark):
    rng = random.Random(1)
    rows = []
    for i in range(6000):
        u = rng.random()
        who = "big" if u < 0.07 else f"s{rng.randrange(400)}" if u < 0.95 else None
        rows.append((i, "msp_podcast", rng.choice(["train", "val", "test"]), who, f"/a/f{i if rng.random() < 0.99 else rng.randrange(6000)}.wav", 0))
    return spark.createDataFrame(rows + rows[:50], SMP)


def test_related_records_stay_together_and_shares_are_met(spark):
    df, t = corpus(spark), spark.createDataFrame(TARGETS, TGT)
    for keys in (["spelling", "speaker"], ["spelling", "speaker", "file"]):
        a = S.assign(df, t, keys)
        assert a.count() == 6000 and a.where("new_split is null").count() == 0
        assert a.groupBy("component").agg({"new_split": "max"}).count() == a.select("component", "new_split").distinct().count()
        both = a.join(S.records(df), "sample_id")
        for k in keys:
            seen = {}
            for r in both.where(f"{k} is not null").select(k, "new_split").distinct().collect():
                assert seen.setdefault(r[0], r[1]) == r[1]
        report = {r.split_name: r for r in S.split_report(a, t).collect()}
        if "file" not in keys:
            assert all(report[n].met for n in ("train", "val", "test"))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, S.assign(df.repartition(5), t, ["spelling", "speaker", "file"]).collect()))


def test_empty(spark):
    df, t = corpus(spark), spark.createDataFrame(TARGETS, TGT)
    assert S.assign(df.limit(0), t).count() == 0 and {r.share for r in S.split_report(S.assign(df.limit(0), t), t).collect()} == {None}
