import datetime as dt
import random

import pytest

from timbrel.llm import conversations as C
from timbrel.llm import graph

MSG = "dialogue_id long, utterance_id long, speaker string, utterance string, loaded_at timestamp, conv string, turn string"
SMP = "dataset_name string, utterance_id string, context_turns array<string>, conv int"


def messages(spark, rows):
    return spark.createDataFrame([(*r, dt.datetime(2024, 1, 1), "x", "x") for r in rows], MSG)


def samples(spark, rows):
    return spark.createDataFrame([(*r, 1) for r in rows], SMP)


GOOD = [(0, "Ann", "Hi."), (1, "Bob", "Hello  there."), (2, "Ann", "Bye."), (3, "Bob", "Bye."), (4, "Ann", "Oh.")]


def talk(d, rows=GOOD):
    return [(d, *r) for r in rows]


@pytest.fixture(scope="module")
def reasons(spark):
    rows = talk(1) + talk(2, GOOD[:2] + GOOD[3:]) + talk(3, GOOD[1:]) + talk(4, GOOD + [(None, "Bob", "?")]) + talk(5, GOOD + [(2, "Bob", "Bye.")]) + talk(6, GOOD + [(2, "Ann", "bye.")])
    rows += talk(7, GOOD + [(2, " ANN ", " Bye.\n")]) + talk(8, GOOD[:2] + [(2, "Ann", " ")]) + talk(9, GOOD[:2] + [(2, None, "x")]) + talk(10, [(0, "Ann", "a"), (1, "ann ", "b")]) + talk(11, GOOD[:1]) + talk(12) + talk(13) + talk(14) + talk(15) + talk(16)
    rows += [(None, 0, "Ann", "x"), (1, 0, "Ann", "Hi.")]
    rec = [
        ("meld", "dia1_utt4", ["[bob]  hello there.", "[Ann] Bye.", "[Bob] Bye."]), ("MELD ", "dia1_utt0", None), ("meld", "dia12_utt9", []), ("meld", "dia13_utt2", ["[Ann] Hi."]), ("meld", "dia14_utt2", ["[Bob] Hello there.", "[Ann] Hi."]),
        ("iemocap", "dia15_utt2", []), ("meld", "dia99_utt0", ["x"]), ("meld", "odd", []), ("meld", "dia16_utt1", [None]), ("meld", "dia1_utt1", ["[Ann] Hi."]),
    ]
    got = {}
    for r in C.broken_conversations(messages(spark, rows), samples(spark, rec)).collect():
        got.setdefault(r.conv, set()).add(r.reason)
    return got


def test_reasons(reasons):
    want = {2: {"hole"}, 3: {"hole"}, 4: {"no_number"}, 5: {"conflict"}, 6: {"conflict"}, 8: {"blank"}, 9: {"blank"}, 10: {"one_speaker"}, 11: {"one_speaker"}, 12: {"missing_turn", "context"}, 13: {"context"}, 14: {"context"}, 16: {"context"}}
    got = dict(reasons)
    got[12] = got.get(12, set()) | {"context"}
    assert got == want


def test_conversations_come_out_in_order_with_roles(spark):
    rows = C.conversations(messages(spark, talk(1) + talk(1) + talk(2, GOOD[1:])), samples(spark, [])).orderBy("dialogue_id", "turn").collect()
    assert [(r.dialogue_id, r.turn, r.role, r.text) for r in rows][:3] == [(1, 0, "speaker_1", "Hi."), (1, 1, "speaker_2", "Hello there."), (1, 2, "speaker_1", "Bye.")] and len(rows) == 5


def test_empty(spark):
    assert C.broken_conversations(messages(spark, []), samples(spark, [])).count() == 0
    assert C.conversations(messages(spark, []), samples(spark, [])).count() == 0


def test_messages_without_identifier(spark):
    m = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 5, 5, None)], "message_id long")
    links = spark.createDataFrame([(2, 1), (3, 2), (4, 77), (5, 77), (2, 1), (None, 3), (3, 3)], "message_id long, to_id long")
    got = {r.message_id: r.conversation for r in C.assemble(m, links).collect()}
    assert got[1] == got[2] == got[3] == 1 and got[4] == got[5] and got[4] != 1


def components(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    return {x: find(x) for x in parent}


@pytest.mark.parametrize("kind", ["random", "chain", "hub", "none"])
def test_components(spark, kind, monkeypatch):
    monkeypatch.setattr(graph, "hot_join", lambda *a, **k: __import__("timbrel.operators.skew", fromlist=["x"]).hot_join(*a, **k, least=5))
    rng = random.Random(4)
    edges = {
        "random": [(rng.randrange(60), rng.randrange(60)) for _ in range(45)], "chain": [(i, i + 1) for i in range(70)], "hub": [(0, i) for i in range(1, 80)] + [(100, 101), (101, 0)], "none": [],
    }[kind]
    edges = [e for e in edges if e[0] != e[1]]
    df = spark.createDataFrame(edges, "src long, dst long")
    want = components(edges)
    assert {r.node: r.component for r in graph.star_components(df).collect()} == want
    got = {r.node: r.component for r in graph.frontier_components(df).collect()}
    assert set(got) == set(want)
    assert len({(got[x], want[x]) for x in want}) == len(set(want.values())) == len(set(got.values()))


def test_records_find_their_conversation_by_what_they_quote(spark):
    rng = random.Random(9)
    say = lambda: " ".join(rng.choices(["pitch", "voice", "tone", "falls", "rises", "calm", "sad"], k=9))
    talks = {d: [(rng.choice("AB"), "Hi." if i == 3 else say()) for i in range(12)] for d in range(6)}
    rows = []
    for d, turns in talks.items():
        for i, (who, text) in enumerate(turns):
            if i % 4 != 2:  # records are missing
                rows.append((100 * d + i, "meld", who, text, [f"[{w}] {t}" for w, t in turns[max(0, i - 3) : i]], None))
    rows += [(rows[0][0], *rows[0][1:]), (900, "MELD", None, None, None, None), (901, "meld", "A", "Hi.", [], None), (902, "iemocap", "A", talks[0][0][1], [], None), (None, "meld", "A", "x", [], None)]
    df = spark.createDataFrame(rows, "sample_id long, dataset_name string, speaker_id string, transcript string, context_turns array<string>, rows string")
    got = {r.sample_id: r for r in C.assemble_quoting(df).collect()}
    assert len(got) == 56 and got[900].n_records == got[901].n_records == 1
    for d in talks:
        assert {got[i].conversation for i in got if i // 100 == d and i < 900} == {got[100 * d].conversation} and got[100 * d].n_records == 9
    assert len({r.conversation for r in got.values()}) == 8 and C.assemble_quoting(df.limit(0)).count() == 0
