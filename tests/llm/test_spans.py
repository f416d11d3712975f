import random

import numpy as np
import pytest

from timbrel.llm import spans as S

SCHEMA = "doc_id long, text string, cls int, chain int"


def shares(a, b, n=400):
    if a is None or b is None or len(a) < n or len(b) < n:
        return False
    held = {a[i : i + n] for i in range(len(a) - n + 1)}
    return any(b[i : i + n] in held for i in range(len(b) - n + 1))


def brute(docs):
    by = {}
    for d, t in docs:
        if d is not None:
            by.setdefault(d, []).append(t)
    ids = sorted(by)
    return {(x, y) for i, x in enumerate(ids) for y in ids[i + 1 :] if any(shares(a, b) for a in by[x] for b in by[y])}


@pytest.fixture(scope="module")
def docs():
    rng = random.Random(11)
    vocab = ["".join(rng.choices("abcdefghij", k=rng.randrange(2, 9))) for _ in range(300)]
    say = lambda n: " ".join(rng.choices(vocab, k=n))
    out, spans = [], [say(100)[:400], say(100)[:399], say(150)[:700], "".join(chr(0x4E00 + rng.randrange(500)) for _ in range(420)), "=" * 450, "ab" * 230, ("-" * 30 + "\n") * 14]
    for k, s in enumerate(spans):
        for _ in range(3):
            out.append((len(out), say(rng.randrange(0, 60)) + s + say(rng.randrange(0, 60))))
    notice = say(60)[:290]  # too short to link, on many records
    out += [(len(out) + i, f"{say(40)} {notice} {say(40)}") for i in range(25)]
    hub = say(120)[:500]
    first = len(out)
    out += [(first + i, f"{say(30)} {hub} {say(30)}") for i in range(20)]
    whole = say(120)
    out += [(5000, whole), (5001, whole), (5002, whole + " x"), (5003, None), (5004, ""), (5005, "short"), (None, whole), (5001, whole), (5006, " " * 500), (5007, "a" + " " * 450 + "b"), (5008, "q" * 70_000), (5009, "q" * 400)]
    return out


@pytest.mark.parametrize("cap", [16, 2])
def test_pairs_against_brute_force(spark, docs, cap):
    got = S.document_pairs(spark.createDataFrame([(*x, 0, 0) for x in docs], SCHEMA), max_group=cap).collect()
    assert {tuple(r) for r in got} == brute(docs) and len(got) == len(set(map(tuple, got)))


@pytest.mark.parametrize("cap", [16, 2])
def test_share_of_each_record(spark, docs, cap):
    got = {(r.doc_id, r.n_chars): r for r in S.shared_share(spark.createDataFrame([(*x, 0, 0) for x in docs], SCHEMA), max_group=cap).collect()}
    assert {d for d, _ in got} == {x for p in brute(docs) for x in p}
    texts = {t for d, t in docs if t and d is not None}
    count = lambda t: len({d for d, x in docs if x == t and d is not None})
    windows = {}
    for t in texts:
        for w in {t[i : i + 400] for i in range(len(t) - 399)}:
            windows[w] = windows.get(w, 0) + count(t)
    for (d, n), r in got.items():
        (t,) = {x for y, x in docs if y == d and x and len(x) == n}
        covered = {k for i in range(n - 399) if windows[t[i : i + 400]] > 1 for k in range(i, i + 400)}
        assert (r.shared_chars, r.n_copies) == (len(covered), count(t) - 1)


def test_empty_and_unrelated(spark):
    assert S.document_pairs(spark.createDataFrame([], SCHEMA)).count() == 0
    assert S.document_pairs(spark.createDataFrame([(1, "x" * 399, 0, 0), (2, "x" * 399, 0, 0)], SCHEMA)).count() == 0
    with pytest.raises(ValueError):
        S.document_pairs(spark.createDataFrame([], SCHEMA), min_chars=100)


@pytest.mark.parametrize("alphabet", ["ab", "abcdefghijklmnopqrstuvwxyz ", "".join(map(chr, range(0x4E00, 0x4F00)))])
def test_a_window_keeps_a_chain_in_any_surroundings(alphabet):
    rng = random.Random(2)
    text = lambda n: "".join(rng.choices(alphabet, k=n))
    for _ in range(150):
        span = text(400)
        keys = [S.chains(*S._codes([text(rng.randrange(0, 300)) + span + text(rng.randrange(0, 300))]))[0] for _ in range(2)]
        assert np.isin(*keys).any()


def test_windows_hash_by_content():
    a, b = S._codes(["xyz" * 50 + "hello world" * 5])[0], S._codes(["hello world" * 5])[0]
    assert np.isin(S._windows(b, 0, 99, 20), S._windows(a, 0, 999, 20)).all()
    assert len(S._windows(b, 0, 99, 56)) == 0
