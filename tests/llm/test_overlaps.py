import random

import pytest

from timbrel.llm import overlaps as O
from timbrel.llm.words import words

SCHEMA = "sample_id long, dataset_name string, split string, audio_path string, transcript string, cls int, key int"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(left[j - 1] + (x != y), left[j] + 1, row[-1] + 1))
    return row[-1]


def build(seed=0):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(60)]
    hot = "did you see how".split()
    base, rows = [], []
    for n in [10, 11, 12, 12, 13, 17, 18, 18, 19, 24, 25, 30, 36, 60] * 3:
        w = rng.choices(vocab, k=n)
        if rng.random() < 0.6:
            at = rng.choice([0, n - 4, rng.randrange(n - 3)])
            w[at : at + 4] = hot
        base.append(w)
    base.append(hot * 3)
    base.append(hot + rng.choices(vocab, k=4) + hot)
    for w in base:
        rows.append(("train", " ".join(w)))
        for _ in range(5):
            v = list(w)
            for _ in range(rng.randrange(0, len(w) // 6 + 2)):
                i, op = rng.randrange(len(v)), rng.randrange(3)
                if op == 0:
                    v[i] = rng.choice(vocab)
                elif op == 1 and len(v) > 5:
                    del v[i]
                else:
                    v.insert(i, rng.choice(vocab))
            rows.append((rng.choice(["val", "test", "train"]), " ".join(v).upper() + "!"))
    return [(i, "meld", s, None, t, 0, 0) for i, (s, t) in enumerate(rows)]


@pytest.mark.parametrize("least, sieve", [(10_000, 28), (3, 28), (3, 1), (10_000, 1)])
def test_near_pairs_against_brute_force(spark, least, sieve, monkeypatch):
    monkeypatch.setattr(O, "HOT_LEAST", least)
    monkeypatch.setattr(O, "SIEVE_BITS", sieve)
    rows = build(least)
    got = {tuple(r) for r in O.overlap_pairs(O.overlaps(spark.createDataFrame(rows, SCHEMA))).collect()}
    tr = [(r[0], words(r[4])) for r in rows if r[2] == "train"]
    he = [(r[0], words(r[4])) for r in rows if r[2] != "train"]
    want = {tuple(sorted((i, j))) for i, a in tr for j, b in he if min(len(a), len(b)) >= 10 and distance(a, b) <= max(len(a), len(b)) // 6}
    assert got == want and want


def test_disjoint_pieces_avoid_hot_places_where_they_can():
    import numpy as np

    hot = np.zeros(20 - 3, bool)
    hot[[0, 5, 10]] = True
    at = O._disjoint(hot, 4)
    assert len(at) == 4 and not hot[at].any() and all(b - a >= 4 for a, b in zip(at, at[1:]))
    assert O._disjoint(np.ones(12 - 3, bool), 3) == [0, 4, 8]


LONG = "one two three four five six seven eight nine ten eleven twelve"


def test_files_splits_and_odd_rows(spark):
    rows = [
        (1, "MSP-Podcast", "Train ", "/a/B_1.WAV", LONG, 0, 0), (2, "msppodcast", "dev", "c\\b_1.flac", None, 0, 0), (3, "meld", "val", "x/b_1.wav", "", 0, 0), (4, "msp_podcast", "unassigned", "b_1.wav", LONG, 0, 0),
        (5, "msp_podcast", "test2", None, LONG.upper(), 0, 0), (6, None, "test", "b_1.wav", LONG + " more", 0, 0), (7, "msp_podcast", "TEST", " ", "short text", 0, 0), (8, "msp_podcast", None, "b_1.wav", LONG, 0, 0),
        (1, "MSP-Podcast", "train", "/a/b_1.wav", LONG, 0, 0), (9, "meld", "train", "x/B_1", "w " * 20_000, 0, 0), (None, "meld", "val", "x/b_1.wav", LONG, 0, 0),
    ]
    found = O.overlaps(spark.createDataFrame(rows, SCHEMA))
    assert {tuple(r) for r in O.overlap_pairs(found).collect()} == {(1, 2), (1, 5), (1, 6), (3, 9)}
    kinds = {(r.held_id, r.kind): r.containment for r in found.collect()}
    assert kinds[5, "exact"] == 1.0 and 0.8 < kinds[6, "near"] < 1 and kinds[2, "file"] is None
    files = {r.sample_id: r.n_links for r in O.file_classes(O.records(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert files == {1: 1, 2: 1, 3: 1, 9: 1}
    report = {(r.split, r.dataset_name, r.kind): r.n_records for r in O.overlap_report(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert report["val", "msp_podcast", "file"] == 1 and report["test", "unknown", "near"] == 1


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert O.overlaps(df).count() == 0 and O.overlap_report(df).count() == 0


def test_disk_holds_no_texts_and_no_table_that_is_done_with(spark, monkeypatch):
    from pathlib import Path

    stored, here = {}, Path(O.written(spark.range(1), "here")._timbrel_path.removeprefix("file:")).parent
    old = set(here.iterdir())
    write = O.written
    monkeypatch.setattr(O, "written", lambda df, label: stored.setdefault(label, df) and write(df, label))
    rows = build(1)
    assert O.overlap_pairs(O.overlaps(spark.createDataFrame(rows, SCHEMA))).count()
    assert not any({"words", "code_a", "words_a"} & set(df.columns) for label, df in stored.items() if label != "texts")
    left = {x.name.split("-", 1)[1].rsplit("-", 1)[0] for x in set(here.iterdir()) - old}
    assert "similar" in left and not left & {"coded", "classes", "held", "train", "met", "texts"}


def test_frequent_ngrams_and_sieves_against_counts(spark):
    import numpy as np

    codes = spark.createDataFrame([("abcd" * 9,), ("abcdefgh",), ("xyzwabcd",)] * 5, "code string").repartition(3)
    found = codes.mapInArrow(O._gram_counts, "block long, low binary, n binary").repartition("block").mapInArrow(O._frequent(45), "key long").collect()
    # 40 times each bcda, cdab and dabc; abcd 55 times with those of the other texts
    assert [r.key for r in found] == [int(O.Texts(["abcd"]).key[0] >> O._COUNTED)]
    keys = np.random.default_rng(3).integers(0, 1 << 62, 4000)
    laid = spark.createDataFrame([(int(k), bool(i % 2)) for i, k in enumerate(keys)], "key long, long boolean")
    sieves = O._sieves(laid)
    assert all(O._has(sieves[bool(i)], keys[i::2].view(np.uint64)).all() for i in (0, 1))
    assert O._has(sieves[True], keys[::2].view(np.uint64)).mean() < 0.05
