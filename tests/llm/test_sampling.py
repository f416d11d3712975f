import itertools

from hypothesis import given, settings
from hypothesis import strategies as st

from timbrel.llm import sampling as M

SMP = "sample_id long, dataset_name string, categorical_emotion string, drawn int, bucket int"
TGT = "dataset_name string, categorical_emotion string, target_share double, min_rows long, sample_rows long"


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9), st.integers(0, 3)), min_size=1, max_size=4), st.integers(0, 999))
def test_no_allocation_deviates_less(rows, seed):
    have = {i: a for i, (a, _, _) in enumerate(rows)}
    target = {i: t for i, (_, t, _) in enumerate(rows)}
    floor = {i: m for i, (_, _, m) in enumerate(rows)}
    total = sum(target.values())
    got = M.allocate(have, target, floor, total, seed)
    low = {i: min(floor[i], have[i]) for i in have}
    low = M._floors(have, floor, total)
    size = min(total, sum(have.values()))
    assert sum(got.values()) == size and all(low[i] <= got[i] <= have[i] for i in have)
    best = min(sum(abs(c - target[i]) for i, c in enumerate(x)) for x in itertools.product(*(range(low[i], have[i] + 1) for i in have)) if sum(x) == size)
    assert sum(abs(got[i] - target[i]) for i in have) == best


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 9), st.integers(0, 9), st.integers(0, 5)), min_size=1, max_size=4), st.integers(-3, 3), st.integers(0, 999))
def test_records_are_missing_where_there_are_fewer_than_wanted(rows, more, seed):
    have = {i: a for i, (a, _, _) in enumerate(rows)}
    target = {i: t for i, (_, t, _) in enumerate(rows)}
    floor = {i: m for i, (_, _, m) in enumerate(rows)}
    total = max(0, sum(target.values()) + more)
    drawn = M.allocate(have, target, floor, total, seed)
    assert sum(drawn.values()) <= total
    short = M.unmet(drawn, have, target, floor, total)
    want = {i: max(target[i], floor[i]) for i in have}
    assert {i for i, (_, cause) in short.items() if cause == "records"} == {i for i in have if have[i] < want[i]}
    assert {i: n for i, (n, _) in short.items()} == {i: want[i] - drawn[i] for i in have if drawn[i] < want[i]}


def test_floors_take_room_and_never_exceed_the_sample():
    drawn = M.allocate({"a": 500, "b": 500}, {"a": 90, "b": 10}, {"a": 0, "b": 50}, 100)
    assert drawn == {"a": 50, "b": 50}
    assert M.unmet(drawn, {"a": 500, "b": 500}, {"a": 90, "b": 10}, {"a": 0, "b": 50}, 100) == {"a": (40, "room")}
    drawn = M.allocate({"a": 500, "b": 500}, {"a": 50, "b": 50}, {"a": 80, "b": 80}, 100)
    assert drawn == {"a": 50, "b": 50}
    assert M.unmet(drawn, {"a": 500, "b": 500}, {"a": 50, "b": 50}, {"a": 80, "b": 80}, 100) == {"a": (30, "room"), "b": (30, "room")}


def frames(spark):
    rows = [(i, "Meld ", " Happy", 0, 0) for i in range(300)] + [(1000 + i, "RAVDESS", "sad", 0, 0) for i in range(7)] + [(2000 + i, "msp-podcast", "??", 0, 0) for i in range(50)]
    rows += [(0, "meld", "happy", 0, 0), (None, "meld", "happy", 0, 0), (3000, None, None, 0, 0)]
    targets = [("meld", "happy", 0.5, 5, 40), ("ravdess", "sad", 0.4, 5, 40), ("iemocap", "calm", 0.1, 2, 40), ("x", None, None, None, None)]
    return spark.createDataFrame(rows, SMP), spark.createDataFrame(targets, TGT)


def test_report_and_sample(spark):
    s, t = frames(spark)
    got = {(r[0], r[1]): r for r in M.report(s, t).collect()}
    assert got["meld", "happy"].available == 300 and got["meld", "happy"].drawn == 33 and got["meld", "happy"].short == 0
    assert got["ravdess", "sad"].drawn == 7 and got["ravdess", "sad"].short == 9 and got["iemocap", "calm"].short == 4 and got["iemocap", "calm"].cause == "records"
    drawn = M.draw(s, t).collect()
    assert len(drawn) == 40 == len({r.sample_id for r in drawn}) and sum(r.dataset_name == "ravdess" for r in drawn) == 7
    assert sorted(map(tuple, drawn)) == sorted(map(tuple, M.draw(s.repartition(3), t).collect()))
    assert sorted(map(tuple, drawn)) != sorted(map(tuple, M.draw(s, t, seed=1).collect()))


def test_the_sample_does_not_depend_on_how_many_are_sorted(spark, monkeypatch):
    s, t = frames(spark)
    want = sorted(map(tuple, M.draw(s, t).collect()))
    monkeypatch.setattr(M, "MAX_SORTED", 0)
    assert sorted(map(tuple, M.draw(s, t).collect())) == want


def test_empty(spark):
    s, t = frames(spark)
    assert M.draw(s.limit(0), t).count() == 0 and M.draw(s, t.limit(0)).count() == 0
    assert {r.short for r in M.report(s.limit(0), t).collect()} == {20, 16, 4}
